"""Golden cases of the operators, and what SQL twins cannot say."""

import json
import random
import re
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from factloom.functions import parsers, rules, spans
from factloom.operators import answers, bloom, chunking, evidence, extraction, facts, joins, maintenance, occurrences, prompts, reconcile, registry, vectors
from factloom.plans import catalog, catalog_more, catalog_writes  # noqa: F401 - the others add to the first
from factloom.plans.derived import ANSWERS
from factloom.sources import documents


def financials(spark, text):
    return extraction.financials(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("financials.*").first()


def test_complete_financial_text(spark):
    text = "\n\n".join(["Raised ₹5 Cr in Seed round", "Current valuation ₹25 Cr", "Annual revenue ₹8 Cr", "EBITDA ₹2 Cr", "ARR ₹10 Cr", "Monthly burn rate ₹40 Lakhs", "Runway 24 months", "EBITDA margin 28%"])
    f = financials(spark, text)
    assert (f.raise_amount, f.valuation, f.revenue, f.ebitda, f.arr, f.burn_rate) == tuple(map(D, ("50000000", "250000000", "80000000", "20000000", "100000000", "4000000")))
    assert (f.margin, f.runway_months, f.currency) == (D(28), 24, "INR")


@pytest.mark.parametrize(("text", "kind"), [("Pre-money valuation: ₹10 Cr.", "pre_money"), ("Post-money valuation: ₹12 Cr.", "post_money"), ("valued at $3M", "unspecified")])
def test_valuation_types(spark, text, kind):
    assert financials(spark, text).valuation_type == kind


def test_margin_needs_its_term(spark):
    assert financials(spark, "Revenue grew 95% YoY.").margin is None
    assert financials(spark, "The company achieved a 32.5% EBITDA margin.").margin == D("32.5")
    assert financials(spark, "FY2025 revenue: INR 12 crore.").revenue == D(120000000)


def test_money_offsets_match_a_plain_scan(spark):
    pattern = re.compile(parsers.MONEY.replace("(?iuU)", "(?i)"))
    texts = ["₹5 Cr and $3.5M, é €7", "usd 5M 24 months 5 L", "a\n₹800\nRevenue 1,20,000 lakh 😀 £2", "", "5 M 5 B ₹8 months"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", parsers.money_occurrences(F.col("t")).alias("m")).collect()
    for r in rows:
        assert [(m.text, m.start, m.end) for m in r.m] == [(x[0], x.start(), x.end()) for x in pattern.finditer(texts[r.i])]


@pytest.mark.parametrize(("text", "b2c"), [("B2B rather than consumer", False), ("we are not a consumer app", False), ("not consumer", False), ("a plain consumer app", True), ("mail", False)])
def test_negated_signals(spark, text, b2c):
    s = spark.createDataFrame([(text,)], "t string").select(extraction.signals(F.col("t")).alias("s")).first().s
    assert ("b2c" in s.business_models) == b2c
    assert ("consumer" in s.markets) == b2c
    assert s.technologies == []


def test_risks_need_whole_phrases(spark):
    r = lambda t: spark.createDataFrame([(t,)], "t string").select(extraction.risks(F.col("t")).alias("r")).first().r
    assert r("a major customer, a foundry, a regulated market").confidence == 0.25
    found = r("Burn rate is known; patent pending.")
    assert (found.financial_risks, found.legal_risks, found.severity["high_burn"]) == (["high_burn"], ["patent_pending"], "high")


def test_entities(spark):
    text = "Startup: Acme\r\nFounders: Ann, bob; Bob,,  ANN\nSectors:\n"
    e = spark.createDataFrame([(text,)], "t string").select(extraction.entities(F.col("t")).alias("e")).first().e
    assert e.founders == ["Ann", "bob"]
    assert e.sectors == []


FACTS = "company_id long, seq long, field string, value_str string, value_num decimal(20,4), status string, source_document_id string, source_name string, source_authority string, period string, section string, confidence double"


def fact(seq, field, num, authority="mis", status="fact", text=None, confidence=0.5):
    return (1, seq, field, text, None if num is None else D(num), status, "d", "n", authority, None, None, confidence)


def test_conflict_and_preference(spark):
    df = spark.createDataFrame([fact(1, "ebitda", "336997.88"), fact(2, "ebitda", "844000", "transaction_document"), fact(3, "revenue", "5", "company_document"), fact(4, "revenue", "5"), fact(5, "revenue", "9", status="projection"), fact(6, "revenue", "5")], FACTS)
    c = facts.conflicts(df).collect()
    assert [(r.field, r.n_values) for r in c] == [("ebitda", 2)]
    assert [(r.field, r.seq) for r in facts.resolved(df).collect()] == [("revenue", 4)]
    assert facts.dedupe_facts(df).count() == 5


def test_ratios(spark):
    row = {"post_money": D("400000000"), "pre_money": None, "valuation_cap": None, "revenue": D("100000000"), "ebitda": D("20000000"), "growth": D(40), "ltv": D(3), "cac": D(0), "gross_profit": D("50000000"), "gross_margin_given": None, "ebitda_margin_given": None, "runway_given": None, "cash": D(6), "burn_rate": D(2)}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} decimal(20,4)" for k in row))
    m = facts.financial_metrics(df).first()
    assert (m.revenue_multiple, m.ebitda_multiple, m.ebitda_margin, m.gross_margin, m.runway, m.valuation_to_growth, m.ltv_cac) == (4, 20, 20, 50, 3, D("0.1"), None)


def test_chunks_cover_the_text(spark):
    for size, overlap in ((10, 3), (7, 0), (5, 4)):
        texts = ["x" * n for n in range(30)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
        got = {}
        for r in chunking.chunk_text(df, size, overlap).orderBy("doc_id", "idx").collect():
            got.setdefault(r.doc_id, []).append((r.start_offset, r.end_offset))
        for i, t in enumerate(texts):
            expect, s = [], 0
            while t:
                expect.append((s, min(s + size, len(t))))
                if s + size >= len(t):
                    break
                s += size - overlap
            assert got.get(i, []) == expect
    with pytest.raises(ValueError):
        chunking.chunk_text(df, 5, 5)


def test_touching_ranges_do_not_overlap(spark):
    c = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 5, 9)], "doc_id int, idx int, start_offset int, end_offset int")
    s = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 5, 9)], "doc_id int, idx int, start_offset int, end_offset int")
    assert sorted(map(tuple, joins.overlapping(c, s).collect())) == [(1, 0, 0), (1, 1, 1)]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]
    bad = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="differ in length"):
        bad.select(vectors.cosine(F.col("a"), F.col("b"))).collect()


def test_entity_items_are_computed_once_and_customers_spread(spark):
    text = "Founders: " + ", ".join(f"Name {k % 300}" if k % 2 else f"NAME  {k % 300}" for k in range(900)) + "\nCompany: x"
    e = extraction.entities(F.col("t"))
    founders = spark.createDataFrame([(text,), (None,)], "t string").select(e["founders"].alias("f"))
    assert [r.f for r in founders.collect()] == [[f"Name {k}" if k % 2 else f"NAME {k}" for k in range(300)], None]
    assert founders._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1
    assert catalog.QUERIES["x2_entity_lists"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_top_k_ties_threshold_and_blocks(spark):
    import numpy as np

    r = np.random.default_rng(3)
    m = r.integers(-3, 4, (300, 8)).astype(float)
    m[100:140] = m[7]  # ties, by position
    m[50] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(999, None)], "pos long, embedding array<double>")
    q = rows.where("pos % 20 = 7 or pos = 50 or pos = 999").withColumnRenamed("pos", "query_id")
    got = vectors.top_k(q, rows, k=7, threshold=0.25, block=37).orderBy("query_id", "rank").collect()
    want = []
    for i in sorted(r_.query_id for r_ in q.where("embedding is not null").collect()):
        sims = [(-(sum(a * b for a, b in zip(m[i], v)) / d) if (d := (sum(a * a for a in m[i]) ** 0.5) * (sum(b * b for b in v) ** 0.5)) else 0.0, p) for p, v in enumerate(m)]
        want += [(i, p, n + 1) for n, (s, p) in enumerate(sorted(x for x in sims if -x[0] >= 0.25)[:7])]
    assert [(x.query_id, x.pos, x["rank"]) for x in got] == want
    one = spark.createDataFrame([(1, [3.0, 4.0])], "pos long, embedding array<double>")
    assert vectors.top_k(one.withColumnRenamed("pos", "query_id"), one, threshold=1.0).count() == 1  # equal to the threshold
    with pytest.raises(Exception, match="differ in length"):
        vectors.top_k(one.withColumnRenamed("pos", "query_id"), spark.createDataFrame([(1, [3.0])], "pos long, embedding array<double>")).collect()
    plan = vectors.top_k(q, rows)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Broadcast" not in plan


def test_a_document_of_very_many_lines_meets_its_chunks(spark):
    lines = 1_000_000
    docs = spark.createDataFrame([(1, "ab\n" * lines), (2, ""), (3, None), (4, "x" * 30_000 + "\n\ny")], "doc_id long, text string")
    segments = docs.select("doc_id", F.posexplode(spans.line_spans(F.col("text"))).alias("idx", "s")).select("doc_id", "idx", "s.*")
    assert segments.where("doc_id = 1").count() == lines + 1
    chunks = chunking.chunk_text(docs)
    found = joins.overlapping(chunks, segments)
    at = {r.doc_id: r["n"] for r in found.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    step = [(k * 800, min(k * 800 + 1000, 3 * lines)) for k in range(-(-(3 * lines - 1000) // 800) + 1)]
    assert at[1] == sum(min(lines, -(-e // 3)) - s // 3 - (1 if s % 3 == 2 else 0) + 0 for s, e in step)
    tail = [(s, min(s + 1000, 30_003)) for s in range(0, 30_003, 800) if s == 0 or s + 200 < 30_003]
    want = sum((s < e2 and e > s2) for s, e in tail for s2, e2 in ((0, 30_000), (30_001, 30_001), (30_002, 30_003)))
    assert at[4] == want and found.distinct().count() == found.count()


GOLDEN = [  # written by hand: text, stage, lists that are not empty, risks with their severities
    ("Pre-seed SaaS for hospital payment, not a consumer app. CCTV in Bengaluru; solo founder, burn rate.", "pre_seed", {"business_models": ["saas"], "industry": ["fintech", "healthcare"], "geographies": ["india"], "markets": ["surveillance"], "themes": ["surveillance"]}, {"solo_founder": "high", "high_burn": "high"}),
    ("A prototype; seed round. RISC-V SoC, edge AI! No revenue, FDA", "idea", {"industry": ["semiconductor"], "technologies": ["ai"], "themes": ["edge_ai"]}, {"prototype_stage": "high", "pre_revenue": "medium", "regulatory_approval": "high"}),
    ("Enterprise buyers rather than end users; socks, chips, aim.", None, {"business_models": ["b2b"], "markets": ["enterprise"]}, {}),
    ("consumer first, then not consumer\nkey hires", None, {"business_models": ["b2c"], "markets": ["consumer"]}, {"hiring_dependency": "medium"}),
    ("\u0130 not a consumer; LLM_x llm", None, {"technologies": ["ai"], "themes": ["ai"]}, {}),
    ("", None, {}, {}),
]


def test_golden_signals_and_risks(spark):
    rows = spark.createDataFrame([(k, g[0]) for k, g in enumerate(GOLDEN)], "k int, t string")
    for r in rows.select("k", extraction.signals(F.col("t")).alias("s"), extraction.risks(F.col("t")).alias("r")).collect():
        _, stage, lists, found = GOLDEN[r.k]
        assert (r.s.stage, {n: r.s[n] for n in rules.SIGNAL_LISTS if r.s[n]}, r.r.severity) == (stage, lists, found), GOLDEN[r.k]
        assert round(r.s.confidence, 6) == round(min(1, 0.25 + 0.08 * ((stage is not None) + sum(map(len, lists.values())))), 6)
        assert round(r.r.confidence, 6) == round(min(1, 0.25 + 0.08 * len(found)), 6)
    text = GOLDEN[4][0]
    spans_ = evidence.signal_evidence(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert {text[x.start_offset : x.end_offset] for x in spans_} == {"llm"}


def test_reconcile_aliases_conflicts_and_current(spark):
    rows = [
        fact(1, "amount_raising", "5", "company_document"), fact(2, "raise_amount", "7"),  # no field of its own is in conflict: the better source
        fact(3, "valuation_cap", "30"), fact(4, "valuation", "40"), fact(5, "valuation", "50"),  # the alias is in conflict: the own field stays
        fact(6, "revenue", "1"), fact(7, "revenue", "2"), fact(8, "ebitda", "3", "investor_summary", confidence=None), fact(9, "ebitda", "3.0"),
        fact(10, "tam", "10", "company_document"), fact(11, "tam", "20", "transaction_document"), fact(12, "cash", "9", status="projection"),
        fact(13, "business_model", None, text=" B2B "), fact(14, "business_model", None, text="b2b"), fact(15, "business_model", None, text="Marketplace"), fact(16, "competitor", None, text="X"), fact(17, "competitor", None, text="x "),
    ]
    df = spark.createDataFrame(rows, FACTS)
    current = spark.createDataFrame([(1, "financials", "revenue", D(99), None), (1, "financials", "cash", D(5), None), (1, "market", "tam", D(1), None), (1, "fundraising", "valuation_cap", D(2), None), (2, "financials", "debt", D(4), None)], "company_id long, family string, field string, value_num decimal(20,4), value_str string")
    told = lambda d: {(r.company_id, r.family, r.field): r.value_num if r.value_num is not None else r.texts or r.value_str for r in reconcile.reconciled(reconcile.field_states(d), current).collect()}
    want = {(1, "fundraising", "amount_raising"): D(7), (1, "fundraising", "valuation_cap"): D(30), (1, "financials", "revenue"): D(99), (1, "traction", "revenue"): None, (1, "financials", "ebitda"): D(3), (1, "market", "tam"): D(20),
            (1, "financials", "cash"): D(5), (1, "business_model", "business_model"): "B2B, Marketplace", (1, "market", "competitors"): ["X"], (2, "financials", "debt"): D(4)}
    assert told(df) == {k: v for k, v in want.items() if v is not None}
    signed = df.union(spark.createDataFrame([fact(20, "pre_money_valuation", "8", "transaction_document")], FACTS))
    assert (1, "fundraising", "valuation_cap") not in told(signed) and told(signed)[1, "fundraising", "pre_money_valuation"] == 8
    assert {r.field: r.n_facts for r in reconcile.conflicts_of(reconcile.field_states(df)).collect()} == {"revenue": 2, "valuation": 2, "tam": 2, "competitor": 2}
    assert sum("source_document_id" in x for x in re.findall(r"Exchange hashpartitioning.*", reconcile.field_states(df)._jdf.queryExecution().executedPlan().toString())) == 1  # facts themselves move once


def test_top_k_meets_every_block_when_partitions_stay_apart(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0 + i]) for i in range(200)], "pos long, embedding array<double>")
    q = rows.where("pos % 20 = 0").withColumnRenamed("pos", "query_id")
    ranked = lambda block: sorted(map(tuple, vectors.top_k(q, rows, k=200, threshold=-1.0, block=block).select("query_id", "pos", "rank").collect()))
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")  # else so small blocks end in one partition, where any two keys meet
    try:
        found = ranked(3)
        assert len(found) == 10 * 200 and found == ranked(4096)
    finally:
        spark.conf.set(name, before)


def test_top_k_has_the_ties_of_the_sql(spark):
    import duckdb
    import numpy as np

    r = np.random.default_rng(11)
    base = r.normal(size=(12, 24)).astype(np.float32)
    m = np.concatenate([base * np.float32(s) for s in (1, 3, 7, 0.1, 11)] + [base + base * r.integers(-1, 2, base.shape).astype(np.float32) * np.float32(2**-23) for _ in range(20)])  # multiples, and copies but for a last bit
    m = m.astype(float)  # like the tables, values of 32 bits, whose products are exact
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "pos long, embedding array<double>")
    q = rows.where("pos < 12").withColumnRenamed("pos", "query_id")
    con = duckdb.connect()
    con.execute("CREATE TABLE v (pos BIGINT, e DOUBLE[])")
    con.executemany("INSERT INTO v VALUES (?, ?)", [(i, v.tolist()) for i, v in enumerate(m)])
    want = con.execute("""
SELECT query_id, pos, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, pos) AS rank FROM (
 SELECT q.pos AS query_id, v.pos, list_cosine_similarity(q.e, v.e) AS similarity FROM v q CROSS JOIN v WHERE q.pos < 12) QUALIFY rank <= 30""").fetchall()
    got = vectors.top_k(q, rows, k=30, block=50).select("query_id", "pos", "similarity", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    pairs = q.crossJoin(rows.withColumnRenamed("embedding", "other")).select("query_id", "pos", vectors.cosine(F.col("embedding"), F.col("other")).alias("s"))
    assert {(a, b, s) for a, b, s, _ in want} <= set(map(tuple, pairs.collect()))


def test_budget_stops_at_the_first_overflow(spark):
    hits = spark.createDataFrame([("q", 1, 0.9, "a", "c", "xxxx"), ("q", 2, 0.8, "a", "c", ""), ("q", 3, 0.7, "b", "c", "xxxxxxxx"), ("q", 4, 0.6, "b", "c", "x")], "query_id string, pos long, similarity double, document_id string, chunk_id string, text string")
    assert [r.pos for r in vectors.budget(hits, 10).collect()] == [1]


def reference_object(text):
    """What Python's decoder finds: the whole, the fence, or the first object that decodes."""
    bare = re.sub(r"(?is)<think>.*?</think>", "", text).strip()
    try:
        return bare if isinstance(json.loads(bare), dict) else None
    except json.JSONDecodeError:
        pass
    if m := re.search(r"(?is)```(?:json)?\s*(.*?)\s*```", bare):
        try:
            return m[1].strip() if isinstance(json.loads(m[1].strip()), dict) else None
        except json.JSONDecodeError:
            return None
    for k, c in enumerate(bare):
        if c == "{":
            try:
                return bare[k : k + json.JSONDecoder().raw_decode(bare[k:])[1]]
            except json.JSONDecodeError:
                continue
    return None


def test_answers(spark):
    rows = [a[0] for a in ANSWERS]
    rows += ["<think>{}</think>```json\n{\"a\":1}\n```", "[1]", "text {\"b\":2} more", "{broken", "", "12", '"{}"', "true {}", "{}", "{} {}", "{{}", "{{{}}}", 'x { "a": [1, {"b": "}"}] } y', '{"a":"\\\\"} "}', "``` ```", "```json\n[1]\n``` {}", '{"a":1}}', '{"a":1,}{"b":[]}', "[] {}", '\\{"a":1}', '{"a":"' + "\\n" * 20000 + '"} z', "{" * 300 + '{"k":1}']
    r = random.Random(4)
    pieces = ["{", "}", "[", "]", '"', "\\", ":", ",", '"a"', "1", '{"a":1}', '{"b":"}"}', " ", "x", "null"]
    rows += ["".join(r.choice(pieces) for _ in range(r.randrange(1, 14))) for _ in range(800)]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(answers.answer_object(F.col("t"))).collect()]
    want = [reference_object(t) for t in rows]
    assert [x for x in zip(rows, got, want) if x[1] != x[2]] == []
    assert [a[1] for a in ANSWERS] == want[: len(ANSWERS)]
    with pytest.raises(KeyError):
        prompts.fill_template("{x}", query=F.lit(""))


def test_text_files_fall_back_to_latin1(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("café\r\nx".encode("latin-1"))
    (tmp_path / "b.md").write_bytes("café".encode())
    got = {r.title: (r.text, r.encoding, r.extension) for r in documents.read_text_documents(spark, str(tmp_path)).collect()}
    assert got == {"a": ("café\nx", "latin-1", "txt"), "b": ("café", "utf-8", "md")}


def test_registry_keeps_the_first(spark):
    x = registry.Extractors()
    x.add("n", lambda df: F.char_length("text"))
    x.add("n", lambda df: F.lit(-1))
    x.add("kind", lambda df: chunking.classify(F.col("text"))["document_type"], F.col("doc_id") > 1)
    got = x.apply(spark.createDataFrame([(1, "equity"), (2, "equity")], "doc_id int, text string")).select("extras.*").collect()
    assert [tuple(r) for r in got] == [(6, None), (6, "cap_table")]
    df = registry.embed(spark.createDataFrame([("ab",)], "text string"), "text", lambda ts: [[float(len(t))] for t in ts])
    assert df.first().embedding == [2.0]


def test_the_filter_keeps_new_keys_out_of_the_exchange(spark):
    known = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    incoming = spark.range(15_000, 60_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("k")).union(spark.createDataFrame([(-1, None)], "id long, k string"))
    maybe, new = bloom.split_by_key(incoming, known, "k")
    assert 5_000 <= maybe.count() < 5_000 + 800 and maybe.where("id < 20000").count() == 5_000  # none known is lost, few others pass
    out = bloom.unknown_rows(incoming, known, "k")
    assert (out.count(), out.agg(F.min("id")).first()[0], out.where("id between 15000 and 19999").count()) == (40_001, -1, 0)
    empty = bloom.unknown_rows(incoming, known.limit(0), "k")
    assert empty.count() == 45_001
    plan = re.sub(r"\n\nSubqueries.*", "", out._jdf.queryExecution().explainString(out._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")), flags=re.S)
    assert plan.index("Filter", plan.index("LeftAnti")) > plan.index("LeftAnti")  # below the join, before its exchange


def test_cascade_reaches_every_level(spark):
    refs = spark.createDataFrame([("b", 1, "a", 1), ("c", 5, "b", 1), ("c", 6, "c", 5), ("c", 7, "c", 6), ("c", 7, "b", 1), ("c", 8, "b", 2)] + [("d", k + 1, "d", k) for k in range(30)] + [("d", 0, "c", 7)], "name string, id long, parent_name string, parent_id long")
    got = maintenance.cascade_closure(spark.createDataFrame([("a", 1)], "name string, id long"), refs).collect()
    assert sorted(map(tuple, got)) == sorted([("a", 1), ("b", 1), ("c", 5), ("c", 6), ("c", 7)] + [("d", k) for k in range(31)])


def test_cascade_ends_in_circles_and_joins_large_levels(spark):
    kind = "name string, id long, parent_name string, parent_id long"
    refs = spark.createDataFrame([("a", 1, "b", 2), ("b", 2, "a", 1), ("b", 3, "b", 3), ("b", 3, "b", 2), ("b", None, "b", 3), ("b", None, "a", 1), ("c", 4, None, None), ("c", 5, "c", None)], kind)
    gone = spark.createDataFrame([("a", 1), ("a", 1), ("c", None)], "name string, id long")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    for threshold in (before, "-1"):
        spark.conf.set(name, threshold)
        try:
            got = maintenance.cascade_closure(gone, refs).collect()
        finally:
            spark.conf.set(name, before)
        assert sorted(map(tuple, got), key=repr) == sorted([("a", 1), ("b", 2), ("b", 3), ("b", None), ("c", None)], key=repr)


def test_accepted_and_rejected_rows_and_their_counts(spark):
    rows = spark.createDataFrame([(1, "ok", 0), (2, "", 5), (3, "x" * 256, -1), (4, None, None), (5, "x" * 255, 3)], "id int, title string, file_size int")
    good, bad, counts = maintenance.accept_and_reject(rows, maintenance.limits(rows.columns, maintenance.DOCUMENT_LENGTHS), "test")
    assert sorted(r.id for r in good.collect()) == [1, 4, 5] and good.columns == rows.columns
    assert {r.id: r.violations for r in bad.collect()} == {2: ["title"], 3: ["title", "file_size"]}
    assert counts == {"rows": 5, "accepted": 3, "title": 2, "file_size": 1}


def test_an_unknown_member_is_an_error(spark):
    df = spark.createDataFrame([("seed",), ("SEED round",), (None,)], "v string")
    values = {"SEED": "SEED round"}
    assert [r[0] for r in df.select(maintenance.resolve_enum(F.col("v"), values)).collect()] == ["SEED round", "SEED round", None]
    with pytest.raises(Exception, match="not a member: other"):
        spark.createDataFrame([("other",)], "v string").select(maintenance.resolve_enum(F.col("v"), values)).collect()


def test_evidence_of_a_custom_extractor(spark):
    x = registry.Extractors()
    x.add("years", lambda df: F.regexp_count("text", F.lit("20[0-9]{2}")), F.col("doc_id") > 0)
    with pytest.raises(KeyError):
        x.add_evidence("other", lambda text: ())
    x.add_evidence("years", lambda text: (("year", m.start(), m.end()) for m in re.finditer("20[0-9]{2}", text)))
    docs = spark.createDataFrame([(0, "2001"), (1, "in 2024, 2025"), (2, None), (3, "none")], "doc_id int, text string")
    assert sorted(map(tuple, x.evidence(docs).collect())) == [(1, "years", "year", 3, 7, "2024"), (1, "years", "year", 9, 13, "2025")]


def test_patch_null_is_a_change(spark):
    rows = spark.createDataFrame([(1, "a", 2), (2, "b", 3)], "id int, name string, n int")
    p = spark.createDataFrame([(1, "name", None), (2, "n", "9")], "id int, column string, value string")
    assert sorted(map(tuple, maintenance.patch(rows, p, ["name", "n"]).collect())) == [(1, None, 2), (2, "b", 9)]


def test_line_context(spark):
    df = spark.createDataFrame([("one\ntwo two\nthree",)], "t string")
    r = df.select(spans.line_context(F.col("t"), F.lit(5), F.lit(6)), spans.clipped_context(F.col("t"), F.lit(8), F.lit(9), 2)).first()
    assert tuple(r) == ("two two", "o two")


def evidence_of(spark, text, find):
    rows = find(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    return [(r.field_name, text[r.start_offset : r.end_offset], r.text) for r in rows]


def test_evidence_is_the_occurrence_itself(spark):
    text = "Raised INR 5 Cr now.\nRevenue INR 5 Cr.\nPost-money valuation INR 5 Cr.\nEBITDA margin is 12%."
    assert evidence_of(spark, text, evidence.financial_evidence) == [
        ("raise_amount", "INR 5 Cr", "Raised INR 5 Cr now."),
        ("revenue", "INR 5 Cr", "Revenue INR 5 Cr."),
        ("valuation", "INR 5 Cr", "Post-money valuation INR 5 Cr."),
        ("margin", "EBITDA margin is 12%", "EBITDA margin is 12%."),
    ]


def test_label_and_rule_evidence(spark):
    text = "Startup:  \nCompany: X\nFounders: A, B\nnot a consumer app, but end users\nsolo founder; CCTV"
    assert evidence_of(spark, text, evidence.entity_evidence) == [("company_name", "Company: X", "Company: X"), ("founders", "Founders: A, B", "Founders: A, B")]
    found = evidence_of(spark, text, evidence.signal_evidence)
    assert ("business_models", "end users", "not a consumer app, but end users") in found
    assert not [f for f in found if f[0] == "markets" and f[1] == "consumer"]
    assert evidence_of(spark, text, evidence.risk_evidence) == [("founder_risks", "solo founder", "solo founder; CCTV")]


def test_every_signal_keyword_speaks_alone(spark):
    cases = [(n, k, f"x {k.upper()}, y") for n, (_, _, kws) in enumerate(rules.SIGNALS) for k in kws] + [(n, "", f"x{kws[0]}y") for n, (_, _, kws) in enumerate(rules.SIGNALS)]
    for r in spark.createDataFrame(cases, "n int, k string, text string").select("n", "k", extraction.signals(F.col("text")).alias("s")).collect():
        field, value, _ = rules.SIGNALS[r.n]
        if field != "stage" or r.k:
            assert (value in ([r.s.stage] if field == "stage" else r.s[field])) == bool(r.k), r.k


def test_occurrences_match_a_plain_scan(spark):
    rng = random.Random(5)
    texts = [None, "", "the", "\nthe\n", "thethe the\n\nİthe", *("".join(rng.choices(["the", "t", "é", "\n", " he ", "x" * 45], k=rng.randrange(60))) for _ in range(60)), "ab the " * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in occurrences.occurrences(rows, "the").collect())
    want = []
    for k, t in enumerate(texts):
        spans_of = [(i * 800, min(len(t), i * 800 + 1000)) for i in range(len(t) // 800 + 1)] if t else []
        for m in re.finditer("the", t or ""):
            a, b = m.span()
            begin, stop = t.rfind("\n", 0, a) + 1, (t + "\n").index("\n", b)
            chunk = next((i for i, (x, y) in enumerate(spans_of) if x <= a and b <= y), None)
            want.append((k, a, b, begin, stop, t[max(begin, a - 40) : min(stop, b + 40)], chunk))
    assert got == sorted(want)
    across = occurrences.occurrences(spark.createDataFrame([(1, "one\ntwo three\nfour")], "doc_id long, text string"), "e\nt").first()
    assert (across.start_offset, across.line_start, across.line_end, across.context) == (2, 0, 13, "one\ntwo three")
    with pytest.raises(ValueError):
        occurrences.occurrence_spans(F.col("text"), "")


def test_patches_keep_keys_unique(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, None, "x"), (4, "", "x"), (5, "e", "x")], "id long, name string, sector string")
    asks = [(1, "name", "b"), (1, "sector", "lost"), (2, "name", "b"), (2, "sector", "kept"), (3, "name", "new"), (4, "name", "new"), (5, "name", None), (9, "name", "new"), (9, "name", "z")]
    left, outcomes = maintenance.patch_unique(rows, spark.createDataFrame(asks, "id long, column string, value string"), ["name", "sector"], "name")
    assert {tuple(r) for r in left.collect()} == {(1, "a", "x"), (2, "b", "kept"), (3, "new", "x"), (4, "", "x"), (5, None, "x")}
    assert {tuple(r) for r in outcomes.collect()} == {(1, "clash"), (2, "updated"), (3, "updated"), (4, "clash"), (5, "updated"), (9, "not_found")}
    none, told = maintenance.patch_unique(rows, spark.createDataFrame([], "id long, column string, value string"), ["name"], "name")
    assert none.count() == 5 and told.count() == 0


def test_the_form_asked_for_is_the_form_that_is_valid(spark):
    company, metrics = F.struct(F.lit("Né").alias("name"), F.lit(None).cast("string").alias("sector")), F.struct(F.lit("1.5000").alias("runway"))
    system, user = spark.range(1).select(F.inline(prompts.analysis_messages(company, metrics))).collect()
    assert (system.role, system.content, user.role) == ("system", prompts.ANALYST, "user")
    data, form = (json.JSONDecoder().raw_decode(user.content, m.start())[0] for m in re.finditer(r"(?m)^\{", user.content))
    assert data == {"startup": {"name": "Né"}, "deterministic_financial_metrics": {"runway": "1.5000"}}
    assert set(form) == {*answers.TEXTS, *answers.LISTS, answers.RECOMMENDATION} and len(form) == 15
    assert form[answers.RECOMMENDATION].split(" | ") == list(answers.RECOMMENDATIONS)
