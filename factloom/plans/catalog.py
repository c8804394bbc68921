"""Registered queries and their DuckDB twins, named by inventory row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import parsers, rules, spans
from factloom.operators import answers, chunking, evidence, extraction, facts, joins, listing, maintenance, prompts, vectors
from factloom.plans.derived import ANSWERS, duck, quoted, spark_table
from factloom.sources import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Tables = Callable[[str], DataFrame]


def query(oracle: str | None = None):
    """Register a function of tables(name); the oracle may name derived tables in braces."""

    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark_table(spark, sf_dir, name))
        if oracle:
            ORACLES[f.__name__] = duck(oracle)
        return f

    return put


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memos to figures, facts and ratios."""
    return QUERIES["m1_financial_metrics"](spark, sf_dir)


def _docs(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", "text")


def _num(c, digits: int = 6):
    return F.round(F.col(c).cast("double"), digits).alias(c.split(".")[-1])


# --- sources -----------------------------------------------------------------


@query("""
WITH p AS (SELECT conv_id AS doc_id, turn, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM conversations)
SELECT doc_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY turn, t)) AS text_md5, count(*)::BIGINT AS page_count FROM p GROUP BY doc_id""")
def s2_assemble_pages(t: Tables) -> DataFrame:
    docs, _ = documents.assemble_pages(t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text"))
    return docs.select("doc_id", F.md5("text").alias("text_md5"), F.col("page_count").cast("long").alias("page_count"))


@query("""
WITH p AS (SELECT conv_id AS doc_id, turn, length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS n, text FROM conversations),
o AS (SELECT *, row_number() OVER w - 1 AS idx, coalesce(sum(n + 2) OVER (PARTITION BY doc_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY turn, text))
SELECT doc_id, idx::BIGINT AS idx, s::BIGINT AS start_offset, (s + n)::BIGINT AS end_offset, (idx + 1)::BIGINT AS page FROM o""")
def s2_page_segments(t: Tables) -> DataFrame:
    _, seg = documents.assemble_pages(t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text"))
    return seg.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("idx", "start_offset", "end_offset", "page")))


@query("""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
q AS (SELECT doc_id, i, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS x FROM p)
SELECT doc_id, md5(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (x <> ''), '')) AS text_md5, count(*)::BIGINT AS paragraph_count FROM q GROUP BY doc_id""")
def s3_assemble_paragraphs(t: Tables) -> DataFrame:
    paras = _docs(t).select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    return documents.assemble_paragraphs(paras).select("doc_id", F.md5("text").alias("text_md5"), "paragraph_count")


@query("""
SELECT id, CASE WHEN mime_type = 'text/plain' OR regexp_matches(lower(filename), '\\.(txt|text|md)$') THEN 'text' WHEN mime_type = 'application/pdf' OR lower(filename) LIKE '%.pdf' THEN 'pdf' WHEN lower(filename) LIKE '%.docx' THEN 'docx' END AS handler FROM {files}""")
def s4_route_documents(t: Tables) -> DataFrame:
    return t("files").select("id", documents.route(F.col("mime_type"), F.col("filename")).alias("handler"))


@query("""
SELECT id, CASE WHEN id % 6 = 3 OR (id % 6 = 0 AND id % 4 = 2) THEN regexp_replace(filename, '(.)\\.[^.]+$', '\\1') WHEN id % 6 = 0 THEN 'Untitled' ELSE title END AS title FROM {files}""")
def s5_resolve_title(t: Tables) -> DataFrame:
    """Every second file is a DOCX, where only a blank title says nothing."""
    kind = F.when(F.col("id") % 4 == 2, "pdf").otherwise("docx")
    given = F.when(F.col("id") % 6 == 0, F.lit("\tUntitled \n")).when(F.col("id") % 6 == 3, F.lit(" \n")).otherwise(F.concat(F.lit(" "), "title"))
    return t("files").select("id", documents.resolve_title(kind, given, F.col("filename")).alias("title"))


@query("""
WITH n AS (SELECT id, filename, regexp_replace(filename, '\\.[^.]*$', '') AS stem FROM {files} WHERE NOT starts_with(filename, '.')),
d AS (SELECT *, replace(replace(lower(stem), '-', '_'), ' ', '_') AS f, array_to_string(list_transform(regexp_extract_all(replace(stem, '_', ' '), '[A-Za-z]+|[^A-Za-z]+'), lambda x: upper(x[1]) || lower(x[2:])), '') AS titled FROM n)
SELECT filename, CASE WHEN id % 6 = 3 THEN 'Given ' || id::VARCHAR ELSE titled END AS title, CASE WHEN id % 6 = 0 THEN 'TERM_SHEET' WHEN contains(f, 'pitch') AND contains(f, 'deck') THEN 'PITCH_DECK' WHEN contains(f, 'financial') AND contains(f, 'model') THEN 'FINANCIAL_MODEL' WHEN contains(f, 'financials') THEN 'FINANCIAL_MODEL'
 WHEN contains(f, 'business') AND contains(f, 'plan') THEN 'BUSINESS_PLAN' WHEN contains(f, 'term') AND contains(f, 'sheet') THEN 'TERM_SHEET' WHEN contains(f, 'sha') THEN 'SHA' WHEN contains(f, 'cap') AND contains(f, 'table') THEN 'CAP_TABLE'
 WHEN contains(f, 'demo') THEN 'PRODUCT_DEMO' ELSE 'OTHER' END AS document_type FROM d""")
def s6_discover_documents(t: Tables) -> DataFrame:
    """Every third file has metadata: a title without a type, or a type with an empty title."""
    files, half = t("files"), F.col("id") % 6 == 0
    given = files.where("id % 3 = 0").select("filename", F.when(half, "").otherwise(F.concat(F.lit("Given "), F.col("id").cast("string"))).alias("given_title"), F.when(half, "TERM_SHEET").alias("given_type"))
    docs, _ = documents.discover(files.select("filename"), given)
    return docs


@query("SELECT id, startup_id::VARCHAR || '/' || id::VARCHAR || '/' || filename AS path, sha256(content) AS hash FROM {files}")
def s8_storage_path_and_hash(t: Tables) -> DataFrame:
    return t("files").select("id", documents.storage_path(F.col("startup_id").cast("string"), F.col("id").cast("string"), F.col("filename")).alias("path"), documents.content_hash(F.col("content").cast("binary")).alias("hash"))


@query("SELECT id, startup_id, mode, status, recommendation, created_at FROM {analyses}")
def s11_history_projection(t: Tables) -> DataFrame:
    return documents.history_item(t("analyses"))


# --- listings ----------------------------------------------------------------


@query("SELECT * FROM {startups} WHERE id = 7")
def r1_by_primary_key(t: Tables) -> DataFrame:
    return listing.by_key(t("startups"), id=7)


@query("SELECT id, name FROM {startups} WHERE name = 'Supplier#000000003'")
def r2_startup_by_name(t: Tables) -> DataFrame:
    return listing.by_key(t("startups"), name="Supplier#000000003").select("id", "name")


@query("SELECT id, full_name FROM {founders}")
def r3_founders_by_name(t: Tables) -> DataFrame:
    return listing.listed(t("founders"), "full_name").select("id", "full_name")


@query("SELECT id, name, sector FROM {startups} WHERE status = 'ACTIVE'")
def r4_active_startups(t: Tables) -> DataFrame:
    return listing.listed(t("startups"), "name", where=F.col("status") == "ACTIVE").select("id", "name", "sector")


@query("SELECT id, name FROM {startups} WHERE sector = 'NATION_3'")
def r5_startups_by_sector(t: Tables) -> DataFrame:
    return listing.listed(t("startups"), "name", where=F.col("sector") == "NATION_3").select("id", "name")


@query("SELECT id, name FROM {startups} WHERE name ILIKE '%r#0%1%' OR legal_name ILIKE '%r#0%1%'")
def r6_startup_search(t: Tables) -> DataFrame:
    return listing.listed(t("startups"), "name", where=listing.keyword("R#0%1", "name", "legal_name")).select("id", "name")


@query("SELECT id, full_name FROM {founders} WHERE full_name ILIKE '%#0000000_2%'")
def r7_founder_search(t: Tables) -> DataFrame:
    return listing.listed(t("founders"), "full_name", where=listing.keyword("#0000000_2", "full_name")).select("id", "full_name")


@query("SELECT id, startup_id, created_at FROM {founders} WHERE startup_id = 12")
def r8_founders_by_startup(t: Tables) -> DataFrame:
    return listing.listed(t("founders"), "created_at", where=F.col("startup_id") == 12).select("id", "startup_id", "created_at")


@query("SELECT id, email FROM {founders} WHERE email = 'f12@example.com'")
def r9_founder_by_email(t: Tables) -> DataFrame:
    return listing.by_key(t("founders"), email="f12@example.com").select("id", "email")


@query("SELECT id, startup_id, document_type, status FROM {files} WHERE status = 'UPLOADED' AND document_type = 'ECONOMY'")
def r10_documents_by_type_and_status(t: Tables) -> DataFrame:
    return listing.listed(listing.by_key(t("files"), status="UPLOADED", document_type="ECONOMY"), F.desc("created_at")).select("id", "startup_id", "document_type", "status")


@query("SELECT id, title, created_at FROM {files}")
def r10_documents_all(t: Tables) -> DataFrame:
    return listing.documents(t("files")).select("id", "title", "created_at")


@query("SELECT id, title, created_at FROM {files} WHERE startup_id = 12")
def r10_documents_by_startup(t: Tables) -> DataFrame:
    return listing.documents(t("files"), startup_id=12).select("id", "title", "created_at")


@query("SELECT id, document_type, created_at FROM {files} WHERE document_type = 'STANDARD'")
def r10_documents_by_type(t: Tables) -> DataFrame:
    return listing.documents(t("files"), document_type="STANDARD").select("id", "document_type", "created_at")


@query("SELECT id, status, created_at FROM {files} WHERE status = 'UPLOADED'")
def r10_documents_by_status(t: Tables) -> DataFrame:
    return listing.documents(t("files"), status="UPLOADED").select("id", "status", "created_at")


@query("SELECT id, title FROM {files} WHERE title ILIKE '%RING%'")
def r11_document_title_search(t: Tables) -> DataFrame:
    return listing.listed(t("files"), "title", where=listing.keyword("RING", "title")).select("id", "title")


@query("SELECT id FROM {files} WHERE sha256(content) = sha256('small ring Brand#2')")
def r12_document_by_hash(t: Tables) -> DataFrame:
    return t("files").where(documents.content_hash(F.col("content").cast("binary")) == F.sha2(F.lit("small ring Brand#2").cast("binary"), 256)).select("id")


@query("SELECT id, startup_id, mode FROM {analyses} WHERE id = 33 AND startup_id = (SELECT startup_id FROM {analyses} WHERE id = 33)")
def r14_scoped_lookup(t: Tables) -> DataFrame:
    own = t("analyses").where("id = 33")
    return own.join(own.select("startup_id"), "startup_id", "left_semi").select("id", "startup_id", "mode")


@query("""
WITH g AS (SELECT startup_id, count(*) AS n, min(round_id) AS round_id FROM {rounds} WHERE status = 'OPEN' GROUP BY startup_id)
SELECT startup_id, CASE WHEN n = 1 THEN round_id END AS round_id, n > 1 AS ambiguous FROM g""")
def r16_open_round(t: Tables) -> DataFrame:
    one, many = joins.open_rounds(t("rounds"))
    return one.select("startup_id", "round_id", F.lit(False).alias("ambiguous")).unionByName(many.select("startup_id", F.lit(None).cast("long").alias("round_id"), F.lit(True).alias("ambiguous")))


@query("SELECT id, s_name AS name, 'Makes ' || (id % 6)::VARCHAR AS description, CASE WHEN id % 5 <> 0 THEN 'Industry ' || (id % 4)::VARCHAR END AS industry, n_name AS sector, ['idea', 'mvp', 'growth'][(id % 3 + 1)::INTEGER] AS stage, (1990 + id % 40)::INTEGER AS founded_year, n_name AS headquarters FROM (SELECT s_suppkey AS id, s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey)")
def r17_company_projection(t: Tables) -> DataFrame:
    return listing.company_projection(t("startups"))


# --- joins -------------------------------------------------------------------


@query("""
SELECT s.id, coalesce(f.n, 0)::BIGINT AS n_founders, coalesce(d.n, 0)::BIGINT AS n_documents, f.first AS first_founder
FROM {startups} s LEFT JOIN (SELECT startup_id, count(*) AS n, min(full_name) AS first FROM {founders} GROUP BY 1) f ON f.startup_id = s.id LEFT JOIN (SELECT startup_id, count(*) AS n FROM {files} GROUP BY 1) d ON d.startup_id = s.id""")
def j1_company_bundle(t: Tables) -> DataFrame:
    out = joins.bundle(t("startups").select("id"), founders=t("founders").select(F.col("startup_id").alias("id"), F.col("full_name").alias("item")), files=t("files").select(F.col("startup_id").alias("id"), F.col("title").alias("item")))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return out.select("id", F.when(F.col("founders").isNull(), 0).otherwise(n("founders")).cast("long").alias("n_founders"), F.when(F.col("files").isNull(), 0).otherwise(n("files")).cast("long").alias("n_documents"), F.get("founders", F.lit(0)).alias("first_founder"))


@query("SELECT f.id, (s.id IS NOT NULL) AS accepted FROM {founders} f LEFT JOIN {startups} s ON s.id = f.startup_id")
def j2_parent_exists(t: Tables) -> DataFrame:
    good, bad = joins.parent_exists(t("founders"), t("startups").select(F.col("id").alias("startup_id")), "startup_id")
    return good.select("id", F.lit(True).alias("accepted")).union(bad.select("id", F.lit(False).alias("accepted")))


@query("""
WITH h AS (SELECT doc_id AS id, sha256(text) AS hash FROM documents), i AS (SELECT * FROM h WHERE id % 3 <> 0)
SELECT i.id, CASE WHEN i.hash IN (SELECT hash FROM h WHERE id % 3 = 0) THEN 'reused' WHEN i.id = min(i.id) OVER (PARTITION BY i.hash) THEN 'created' ELSE 'duplicate' END AS outcome FROM i""")
def j3_new_by_hash(t: Tables) -> DataFrame:
    hashed = _docs(t).select(F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    return joins.tag_by_hash(hashed.where("id % 3 <> 0"), hashed.where("id % 3 = 0")).select("id", "outcome")


@query("""
WITH n AS (SELECT c_custkey AS id, '  ' || upper(c_name) || chr(9) || (c_custkey % 3)::VARCHAR AS name FROM customer),
k AS (SELECT id, name, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS k FROM n)
SELECT id, CASE WHEN count(*) OVER (PARTITION BY k) > 1 THEN 'error' WHEN k IN (SELECT lower(c_name || ' 1') FROM customer) THEN 'reused' ELSE 'created' END AS outcome FROM k""")
def j4_founder_reconcile(t: Tables) -> DataFrame:
    c = t("customer")
    incoming = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("  "), F.upper("c_name"), F.lit("\t"), (F.col("c_custkey") % 3).cast("string")).alias("name"))
    return joins.reconcile_names(c.select(F.concat("c_name", F.lit(" 1")).alias("name")), incoming).select("id", "outcome")


_CHUNKS = """(SELECT doc_id, i AS idx, i * 800 AS s, least(i * 800 + 1000, n) AS e, substr(text, i * 800 + 1, 1000) AS text
FROM (SELECT doc_id, text, length(text) AS n, unnest(range(CASE WHEN length(text) <= 1000 THEN 1 ELSE CAST(ceil((length(text) - 1000) / 800.0) AS BIGINT) + 1 END)) AS i FROM documents WHERE length(text) > 0))"""


@query(f"""
WITH seg AS (SELECT doc_id, i - 1 AS seg_idx, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, length(x) AS n
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
SELECT c.doc_id, c.idx::BIGINT AS idx, seg.seg_idx::BIGINT AS seg_idx FROM {_CHUNKS} c JOIN seg ON seg.doc_id = c.doc_id AND c.s < seg.s + seg.n AND c.e > seg.s""")
def j5_segment_overlap(t: Tables) -> DataFrame:
    docs = _docs(t)
    segments = docs.select("doc_id", F.posexplode(spans.line_spans(F.col("text"))).alias("idx", "s")).select("doc_id", "idx", "s.start_offset", "s.end_offset")
    out = joins.overlapping(chunking.chunk_text(docs), segments)
    return out.select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("seg_idx").cast("long").alias("seg_idx"))


@query(f"""
WITH e AS (SELECT doc_id, strpos(text, 'the') - 1 AS s FROM documents WHERE strpos(text, 'the') > 0)
SELECT e.doc_id, e.s::BIGINT AS start_offset, min(c.idx)::BIGINT AS chunk_idx FROM e LEFT JOIN {_CHUNKS} c ON c.doc_id = e.doc_id AND c.s <= e.s AND e.s + 3 <= c.e GROUP BY 1, 2""")
def j7_evidence_chunk(t: Tables) -> DataFrame:
    docs = _docs(t).where(F.contains("text", F.lit("the")))
    n = F.char_length("text")
    found = docs.select("doc_id", (F.locate("the", F.col("text")) - 1).alias("start_offset"), F.when(n <= 1000, 1).otherwise(F.ceil((n - 1000) / 800) + 1).alias("n_chunks")).withColumn("end_offset", F.col("start_offset") + 3)
    return joins.containing_chunk(found).select("doc_id", F.col("start_offset").cast("long").alias("start_offset"), F.col("chunk_idx").cast("long").alias("chunk_idx"))


# --- chunks and text ---------------------------------------------------------


@query(f"SELECT doc_id, idx::BIGINT AS idx, md5(text) AS text_md5, s::BIGINT AS start_offset, e::BIGINT AS end_offset FROM {_CHUNKS}")
def c1_chunk_text(t: Tables) -> DataFrame:
    c = chunking.chunk_text(_docs(t))
    return c.select("doc_id", F.col("idx").cast("long").alias("idx"), F.md5("text").alias("text_md5"), F.col("start_offset").cast("long").alias("start_offset"), F.col("end_offset").cast("long").alias("end_offset"))


@query("SELECT doc_id, string_split(text, chr(10))[3] AS line FROM {memos}")
def c3_line_context(t: Tables) -> DataFrame:
    second = F.char_length(F.substring_index("text", "\n", 2)) + 1
    return t("memos").select("doc_id", spans.line_context(F.col("text"), second + 2, second + 3).alias("line"))


@query("SELECT doc_id, substr(string_split(text, chr(10))[2], 1, 11 + 40) AS context FROM {memos}")
def c4_occurrence_context(t: Tables) -> DataFrame:
    start = F.char_length(F.substring_index("text", "\n", 1)) + 1
    return t("memos").select("doc_id", spans.clipped_context(F.col("text"), start + 10, start + 11).alias("context"))


@query("""
SELECT doc_id, array_to_string(list_distinct_ordered, '|') AS sections FROM (
 SELECT doc_id, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: starts_with(x, '#') OR ends_with(x, ':')), lambda x: CASE WHEN starts_with(x, '#') THEN x ELSE left(x, length(x) - 1) END) AS list_distinct_ordered FROM {memos})""")
def c5_sections(t: Tables) -> DataFrame:
    return t("memos").select("doc_id", F.array_join(chunking.sections(F.col("text")), "|").alias("sections"))


@query("""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(lower(text), '[^\x00-\x7F]', '_', 'g'), '\\b[A-Za-z]{2,}[A-Za-z0-9+\\-]*\\b')) AS word FROM documents),
c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE word NOT IN ('the','and','for','with','from','this','that','have','will','your','into','their','about','page','document','company') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank FROM c)
SELECT doc_id, rank::BIGINT AS rank, word, n FROM r WHERE rank <= 20""")
def c6_keyword_top20(t: Tables) -> DataFrame:
    return chunking.keywords(_docs(t)).select("doc_id", F.col("rank").cast("long").alias("rank"), "word", "n")


@query("""
SELECT doc_id, coalesce(title, string_split(text, chr(10))[1]) AS title,
 CASE WHEN lower(coalesce(title, '')) LIKE '%pitch%' THEN 'Pitch Deck' WHEN lower(coalesce(title, '')) LIKE '%term sheet%' THEN 'Term Sheet' WHEN lower(coalesce(title, '')) LIKE '%sha%' THEN 'Shareholders Agreement' WHEN lower(coalesce(title, '')) LIKE '%financial%' THEN 'Financial Statement' END AS document_type FROM {memos}""")
def c7_title_and_type(t: Tables) -> DataFrame:
    m = extraction.metadata(F.col("title"), F.col("text"))
    return t("memos").select("doc_id", m["title"].alias("title"), m["document_type"].alias("document_type"))


_SCORE = " ".join(f"UNION ALL SELECT doc_id, {i} AS place, '{name}' AS name, {' + '.join(f'''(CASE WHEN contains(t, '{k}') THEN 1 ELSE 0 END)''' for k in kws)} AS score FROM l" for i, (name, kws) in enumerate(rules.CLASSES))[len("UNION ALL ") :]


@query(f"""
WITH l AS (SELECT doc_id, lower(text) AS t FROM documents), s AS ({_SCORE}),
g AS (SELECT doc_id, max(score) AS top, arg_min(name, struct_pack(a := -score, b := place)) AS best, count(*) FILTER (score > 0) AS n FROM s GROUP BY doc_id)
SELECT doc_id, CASE WHEN top > 0 THEN best END AS document_type, greatest(n - 1, 0)::BIGINT AS n_secondary, round(least(1.0, top / 5.0), 6)::DOUBLE AS confidence FROM g""")
def c9_classify(t: Tables) -> DataFrame:
    c = chunking.classified(_docs(t))
    return c.select("doc_id", "class.document_type", F.size("class.secondary").cast("long").alias("n_secondary"), _num("class.confidence"))


_MULT = "CASE lower(regexp_extract(m, '\\d\\s*([A-Za-z]+)\\s*$', 1)) WHEN 'cr' THEN 10000000 WHEN 'lakh' THEN 100000 WHEN 'million' THEN 1000000 WHEN 'b' THEN 1000000000 ELSE 1 END"
_MONEY = r"(?i)(?:(?:₹|\$|USD|INR|EUR|GBP|£|€)\s*\d+(?:,\d{2,3})*(?:\.\d+)?\s*(?:Cr|Crore|Crores|L|Lakh|Lakhs|M|Million|Millions|B|Billion|Billions|K|Thousand|Thousands)?\b|\d+(?:,\d{2,3})*(?:\.\d+)?\s*(?:Cr|Crores?|Lakhs?|Millions?|Billions?|Thousands?|[LBK])\b)"


@query(f"""
WITH o AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_MONEY.replace("{2,3}", "{{2,3}}")}')) AS m, generate_subscripts(regexp_extract_all(text, '{_MONEY.replace("{2,3}", "{{2,3}}")}'), 1) AS i FROM {{memos}})
SELECT doc_id, (i - 1)::BIGINT AS idx, (regexp_extract(m, '\\d+')::BIGINT * {_MULT})::DOUBLE AS amount, CASE WHEN m LIKE 'INR%' OR m LIKE 'USD%' THEN substr(m, 1, 3) ELSE '' END AS currency FROM o""".replace("{{2,3}}", "{2,3}"))
def p1_money_amounts(t: Tables) -> DataFrame:
    return t("memos").select("doc_id", F.posexplode(parsers.money_occurrences(F.col("text"))).alias("idx", "m")).select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("m.amount").cast("double").alias("amount"), "m.currency")


@query("SELECT doc_id, (doc_id % 40)::DOUBLE AS percent, (CASE WHEN doc_id % 2 = 0 THEN doc_id % 30 ELSE 12 * (doc_id % 30) END)::INTEGER AS months FROM {memos}")
def p3_percent_and_duration(t: Tables) -> DataFrame:
    return t("memos").select("doc_id", parsers.percentage(F.col("text")).cast("double").alias("percent"), parsers.duration_months(F.col("text")).alias("months"))


# --- extractors --------------------------------------------------------------


@query("""
SELECT m.doc_id, CASE WHEN m.doc_id % 7 = 6 THEN NULL ELSE c_name END AS company_name, 'Ann ' || m.doc_id::VARCHAR || '|bob' AS founders, 0.45::DOUBLE AS confidence FROM {memos} m JOIN customer ON c_custkey = m.doc_id""")
def x2_entities(t: Tables) -> DataFrame:
    return t("memos").select("doc_id", extraction.entities(F.col("text")).alias("e")).select("doc_id", "e.company_name", F.array_join("e.founders", "|").alias("founders"), _num("e.confidence"))


#: An amount without a unit takes the line end after it along, so the phrase on the next line is the nearest to it.
_FIN = """(SELECT c.c_custkey AS doc_id, r.rev, r.n, CASE WHEN c.c_custkey % 4 <> 1 THEN CAST(FLOOR(r.rev / 5) AS BIGINT) WHEN c.c_custkey % 5 <> 0 THEN r.rev WHEN c.c_custkey % 3 = 2 THEN r.n * 1000000 ELSE r.n * 100000 END AS raise_amount,
 CASE WHEN c.c_custkey % 4 = 1 AND c.c_custkey % 5 = 0 AND c.c_custkey % 3 = 2 THEN 'USD' ELSE 'INR' END AS currency,
 CASE WHEN c.c_custkey % 4 < 3 THEN (r.n + 3) * 10000000 END AS valuation, CASE c.c_custkey % 4 WHEN 0 THEN 'pre_money' WHEN 1 THEN 'post_money' WHEN 2 THEN 'valuation_cap' ELSE 'unspecified' END AS valuation_type,
 CASE WHEN c.c_custkey % 5 = 0 THEN NULL ELSE r.rev END AS revenue, CASE WHEN c.c_custkey % 4 = 1 THEN NULL ELSE CAST(FLOOR(r.rev / 5) AS BIGINT) END AS ebitda, c.c_custkey % 40 AS margin,
 CASE WHEN c.c_custkey % 2 = 0 THEN c.c_custkey % 30 ELSE 12 * (c.c_custkey % 30) END AS runway
FROM customer c JOIN (SELECT o_custkey, CAST(SUM(CAST(FLOOR(o_totalprice) AS BIGINT)) AS BIGINT) AS rev, COUNT(*) AS n FROM orders GROUP BY o_custkey) r ON r.o_custkey = c.c_custkey)"""


@query(f"""
SELECT doc_id, currency, raise_amount::DOUBLE AS raise_amount, valuation::DOUBLE AS valuation, valuation_type, revenue::DOUBLE AS revenue, ebitda::DOUBLE AS ebitda, margin::DOUBLE AS margin, runway::INTEGER AS runway_months,
 round(0.25 + 0.1 * (3 + (revenue IS NOT NULL)::INT + (ebitda IS NOT NULL)::INT), 6)::DOUBLE AS confidence FROM {_FIN}""")
def x5_financials(t: Tables) -> DataFrame:
    money = [F.col(f"financials.{c}").cast("double").alias(c) for c in ("raise_amount", "valuation", "revenue", "ebitda", "margin")]
    return extraction.financials(t("memos")).select("doc_id", "financials.currency", *money, "financials.valuation_type", "financials.runway_months", _num("financials.confidence"))


@query("""
SELECT doc_id, CASE WHEN shape IN (0, 1, 3, 4) THEN 'INR' WHEN shape IN (2, 5) THEN 'USD' END AS currency, (CASE WHEN shape IN (1, 2, 3, 4) THEN a END)::DOUBLE AS revenue, (CASE WHEN shape = 4 THEN b END)::DOUBLE AS ebitda,
 (CASE shape WHEN 0 THEN a WHEN 3 THEN b WHEN 5 THEN b END)::DOUBLE AS arr, (CASE shape WHEN 0 THEN b WHEN 1 THEN b WHEN 4 THEN c END)::DOUBLE AS burn_rate FROM {ledgers}""")
def x7_metrics_in_order(t: Tables) -> DataFrame:
    """Lines that name several metrics, metrics inside other words, more money than metrics; money at a line's end also belongs to the next line (shape 1)."""
    found = extraction.financials(t("ledgers"))
    return found.select("doc_id", "financials.currency", *(F.col(f"financials.{c}").cast("double").alias(c) for c in ("revenue", "ebitda", "arr", "burn_rate")))


def _holds(kws: tuple[str, ...]) -> str:
    return "regexp_matches(t, '(^|[^a-z0-9_])(" + "|".join(kws).replace("-", "\\-") + ")($|[^a-z0-9_])')"


def _sorted_list(pairs: list[tuple[str, str]]) -> str:
    return "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {h} THEN '{v}' END" for v, h in pairs) + "], lambda x: x IS NOT NULL)), '|')"


def _signal_sql(name: str) -> str:
    return _sorted_list([(v, _holds(k) + (" AND NOT contains(t, 'not a consumer')" if v in ("b2c", "consumer") else "")) for f, v, k in rules.SIGNALS if f == name])


@query(f"""
WITH l AS (SELECT doc_id, lower(text) AS t FROM {{memos}})
SELECT doc_id, CASE WHEN {_holds(rules.SIGNALS[0][2])} THEN 'idea' WHEN {_holds(rules.SIGNALS[1][2])} THEN 'pre_seed' WHEN {_holds(rules.SIGNALS[2][2])} THEN 'seed' WHEN {_holds(rules.SIGNALS[3][2])} THEN 'series_a' END AS stage,
 {", ".join(f"{_signal_sql(n)} AS {n}" for n in rules.SIGNAL_LISTS)} FROM l""")
def x13_signals(t: Tables) -> DataFrame:
    return t("memos").select("doc_id", extraction.signals(F.col("text")).alias("s")).select("doc_id", "s.stage", *(F.array_join(f"s.{n}", "|").alias(n) for n in rules.SIGNAL_LISTS))


@query(f"""
WITH l AS (SELECT doc_id, lower(text) AS t FROM {{memos}}), r AS (SELECT doc_id, {", ".join(_sorted_list([(v, _holds(k)) for f, v, _, k in rules.RISKS if f == n]) + f" AS {n}" for n in rules.RISK_LISTS)}, {_sorted_list([(f"{v}={s}", _holds(k)) for _, v, s, k in rules.RISKS])} AS severity FROM l)
SELECT *, round(least(1.0, 0.25 + 0.08 * ({" + ".join(f"(CASE WHEN {n} = '' THEN 0 ELSE len(string_split({n}, '|')) END)" for n in rules.RISK_LISTS)})), 6)::DOUBLE AS confidence FROM r""")
def x17_risks(t: Tables) -> DataFrame:
    severity = F.array_join(F.array_sort(F.transform(F.map_entries("r.severity"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    return t("memos").select("doc_id", extraction.risks(F.col("text")).alias("r")).select("doc_id", *(F.array_join(f"r.{n}", "|").alias(n) for n in rules.RISK_LISTS), severity.alias("severity"), _num("r.confidence"))


_TITLE = "coalesce(title, string_split(text, chr(10))[1])"
_COUNT = lambda c: f"(CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, '|')) END)"
_STAGE = "CASE " + " ".join(f"WHEN {_holds(k)} THEN '{v}'" for f, v, k in rules.SIGNALS if f == "stage") + " END"
_LISTS = ", ".join([f"{_signal_sql(n)} AS {n}" for n in rules.SIGNAL_LISTS] + [_sorted_list([(v, _holds(k)) for f, v, _, k in rules.RISKS if f == n]) + f" AS {n}" for n in rules.RISK_LISTS])
#: Every document's components, from the twins of the extractors.
_PROFILE = f"""(SELECT p.doc_id, p.title, CASE WHEN p.doc_id % 7 = 6 THEN NULL ELSE c_name END AS company_name, f.revenue, p.stage, {_COUNT("market_risks")} AS n_market_risks,
 0.45 AS entities, 0.25 + 0.1 * (3 + (f.revenue IS NOT NULL)::INT + (f.ebitda IS NOT NULL)::INT) AS financials,
 least(1.0, 0.25 + 0.08 * ((p.stage IS NOT NULL)::INT + {" + ".join(map(_COUNT, rules.SIGNAL_LISTS))})) AS signals, least(1.0, 0.25 + 0.08 * ({" + ".join(map(_COUNT, rules.RISK_LISTS))})) AS risks
 FROM (SELECT doc_id, {_TITLE} AS title, {_STAGE} AS stage, {_LISTS} FROM (SELECT *, lower(text) AS t FROM {{memos}})) p JOIN customer ON c_custkey = p.doc_id JOIN {_FIN} f ON f.doc_id = p.doc_id)"""


@query(f"SELECT doc_id, title, company_name, revenue::DOUBLE AS revenue, stage, n_market_risks::INTEGER AS n_market_risks, round((1.0 + entities + financials + signals + risks) / 5, 6)::DOUBLE AS confidence FROM {_PROFILE}")
def x19_profiles(t: Tables) -> DataFrame:
    p = extraction.profiles(t("memos"))
    return p.select("doc_id", "metadata.title", "entities.company_name", F.col("financials.revenue").cast("double").alias("revenue"), "signals.stage", F.size("risks.market_risks").alias("n_market_risks"), _num("confidence"))


@query(f"""
SELECT doc_id, 5 AS expected, (CASE WHEN company_name IS NULL THEN 4 ELSE 5 END)::INTEGER AS available, CASE WHEN company_name IS NULL THEN 'entities' ELSE '' END AS missing_components,
 1.0::DOUBLE AS metadata_confidence, round(CASE WHEN company_name IS NULL THEN 1.0 ELSE entities END, 6)::DOUBLE AS entities_confidence, round(financials, 6)::DOUBLE AS financials_confidence, round(signals, 6)::DOUBLE AS signals_confidence, round(risks, 6)::DOUBLE AS risks_confidence FROM {_PROFILE}""")
def x21_quality_metadata(t: Tables) -> DataFrame:
    p = extraction.profiles(t("memos")).withColumn("entities", F.when(F.col("entities.company_name").isNotNull(), F.col("entities")))
    q = p.select("doc_id", extraction.quality_metadata(p).alias("q"))
    return q.select("doc_id", "q.expected", "q.available", F.array_join("q.missing_components", "|").alias("missing_components"), *(F.round(F.col("q.component_confidence")[c], 6).alias(f"{c}_confidence") for c in extraction.COMPONENTS))


def _lined(rows: str, more: str = "") -> str:
    """Evidence rows (doc_id, field_name, value, s, e) with the line or lines that the span touches; memos are one chunk each."""
    head, tail = "string_split(substr(m.text, 1, s), chr(10))", "string_split(substr(m.text, e + 1), chr(10))"
    return f"""SELECT r.doc_id, field_name, value, s::INTEGER AS start_offset, e::INTEGER AS end_offset,
 substr(m.text, s - length({head}[-1]) + 1, e + length({tail}[1]) - s + length({head}[-1])) AS text, 0 AS chunk_index{more} FROM ({rows}) r JOIN {{memos}} m ON m.doc_id = r.doc_id WHERE s IS NOT NULL"""


_MEMO = f"(SELECT f.*, m.text FROM {_FIN} f JOIN {{memos}} m ON m.doc_id = f.doc_id)"
_AT = lambda before: f"strpos(text, '{before}') - 1 + {len(before)}"
_REVENUE = (f"({_AT('Revenue: ')})", f"({_AT('Revenue: ')}) + 5 + length(revenue::VARCHAR)")  # the money takes the line end along
_EBITDA = (f"({_AT('EBITDA: ')})", f"({_AT('EBITDA: ')}) + 5 + length(ebitda::VARCHAR)")
_RAISED = ("CASE WHEN doc_id % 3 = 2 THEN strpos(text, 'USD ') - 1 ELSE " + _AT("raising ") + " END", "CASE WHEN doc_id % 3 = 2 THEN strpos(text, 'USD ') - 1 + 12 + length(n::VARCHAR) ELSE " + _AT("raising ") + " + 9 + length(n::VARCHAR) END")
_PICK = lambda k: f"CASE WHEN ebitda IS NOT NULL THEN {_EBITDA[k]} WHEN revenue IS NOT NULL THEN {_REVENUE[k]} ELSE {_RAISED[k]} END"
_CR = "strpos(text, 'INR ' || (n + 3)::VARCHAR || ' Cr') - 1"
_MONEY_ROWS = f"""
SELECT doc_id, 'revenue' AS field_name, NULL::VARCHAR AS value, CASE WHEN revenue IS NOT NULL THEN {_REVENUE[0]} END AS s, {_REVENUE[1]} AS e FROM {_MEMO}
UNION ALL SELECT doc_id, 'ebitda', NULL, CASE WHEN ebitda IS NOT NULL THEN {_EBITDA[0]} END, {_EBITDA[1]} FROM {_MEMO}
UNION ALL SELECT doc_id, 'raise_amount', NULL, {_PICK(0)}, {_PICK(1)} FROM {_MEMO}
UNION ALL SELECT doc_id, 'valuation', valuation_type, CASE WHEN valuation IS NOT NULL THEN {_CR} END, {_CR} + 7 + length((n + 3)::VARCHAR) FROM {_MEMO}
UNION ALL SELECT doc_id, 'margin', NULL, strpos(text, 'EBITDA margin') - 1, strpos(text, 'EBITDA margin') - 1 + 15 + length(margin::VARCHAR) FROM {_MEMO}"""
_ENTITY_ROWS = """
SELECT doc_id, 'company_name' AS field_name, NULL::VARCHAR AS value, CASE WHEN doc_id % 7 <> 6 THEN 0 END AS s, strpos(text, chr(10)) - 1 AS e FROM {memos}
UNION ALL SELECT doc_id, 'founders', NULL, strpos(text, 'Founders:') - 1, strpos(text, 'Founders:') - 1 + length(string_split(text, chr(10))[2]) FROM {memos}"""


def _rule_rows(found: list[tuple[str, str, tuple[str, ...]]]) -> str:
    """The first keyword of each rule, in order; RE2 has no look-behind, so what stands before the keyword is part of the match."""

    def start(k: str) -> str:
        word = k.replace("-", "\\-")
        pattern = f"(?s)^(.*?(?:^|[^a-z0-9_])){word}(?:$|[^a-z0-9_])"
        return f"CASE WHEN regexp_matches(t, '{pattern}') THEN struct_pack(s := length(regexp_extract(t, '{pattern}', 1)), e := length(regexp_extract(t, '{pattern}', 1)) + {len(k)}) END"

    holds = lambda f, v: "NOT contains(t, 'not a consumer')" if (f, v) in rules.GUARDED else f"coalesce({_STAGE} = '{v}', false)" if f == "stage" else "true"
    each = ", ".join(f"struct_pack(field_name := '{f}', value := '{v}', span := CASE WHEN {holds(f, v)} THEN coalesce({', '.join(map(start, k))}) END)" for f, v, k in found)
    return f"SELECT doc_id, r.field_name, r.value, r.span.s AS s, r.span.e AS e FROM (SELECT doc_id, unnest([{each}]) AS r FROM (SELECT doc_id, lower(text) AS t FROM {{memos}}))"


_SIGNAL_ROWS = _rule_rows(list(rules.SIGNALS))
_RISK_ROWS = _rule_rows([(f, v, k) for f, v, _, k in rules.RISKS])


@query(_lined(_ENTITY_ROWS))
def x4_entity_evidence(t: Tables) -> DataFrame:
    return evidence.entity_evidence(t("memos")).drop("extractor")


@query(_lined(_MONEY_ROWS))
def x12_financial_evidence(t: Tables) -> DataFrame:
    return evidence.financial_evidence(t("memos")).drop("extractor")


@query(_lined(_SIGNAL_ROWS))
def x16_signal_evidence(t: Tables) -> DataFrame:
    return evidence.signal_evidence(t("memos")).drop("extractor")


@query(_lined(_RISK_ROWS))
def x18_risk_evidence(t: Tables) -> DataFrame:
    return evidence.risk_evidence(t("memos")).drop("extractor")


@query(f"""
SELECT e.doc_id AS document_id, NULL::INTEGER AS page, field_name AS section, text AS source_text, round((1.0 + entities + financials + signals + risks) / 5, 4)::DOUBLE AS confidence
FROM ({" UNION ALL ".join(map(_lined, (_ENTITY_ROWS, _MONEY_ROWS, _SIGNAL_ROWS, _RISK_ROWS)))}) e JOIN {_PROFILE} p ON p.doc_id = e.doc_id""")
def f5_analysis_evidence(t: Tables) -> DataFrame:
    found = evidence.analysis_evidence(evidence.profile_evidence(t("memos")), extraction.profiles(t("memos")))
    return found.withColumn("confidence", F.col("confidence").cast("double"))


# --- facts -------------------------------------------------------------------


@query(f"""
SELECT doc_id, u.field, u.v AS value_num, 'fact' AS status FROM (SELECT doc_id, unnest([struct_pack(field := 'raise_amount', v := raise_amount::DOUBLE), struct_pack(field := 'valuation', v := valuation::DOUBLE), struct_pack(field := 'revenue', v := revenue::DOUBLE),
 struct_pack(field := 'ebitda', v := ebitda::DOUBLE), struct_pack(field := 'runway_months', v := runway::DOUBLE), struct_pack(field := 'ebitda_margin', v := margin::DOUBLE)]) AS u FROM {_FIN}) WHERE u.v IS NOT NULL""")
def f1_financial_facts(t: Tables) -> DataFrame:
    return facts.financial_facts(extraction.profiles(t("memos"))).select("doc_id", "field", F.col("value_num").cast("double").alias("value_num"), "status")


@query(f"""
WITH l AS (SELECT doc_id, lower(text) AS t FROM {{memos}}), v AS (SELECT doc_id, {_signal_sql('markets')} AS m, {_signal_sql('geographies')} AS g, {_signal_sql('business_models')} AS b FROM l)
SELECT doc_id, field, unnest(string_split(v, '|')) AS value_str FROM (SELECT doc_id, 'market_description' AS field, m AS v FROM v UNION ALL SELECT doc_id, 'geographic_market', g FROM v UNION ALL SELECT doc_id, 'business_model', b FROM v) WHERE v <> ''""")
def f2_signal_facts(t: Tables) -> DataFrame:
    return facts.signal_facts(extraction.profiles(t("memos"))).select("doc_id", "field", "value_str")


@query("""
SELECT id, CASE WHEN id % 4 = 0 THEN 'mis' WHEN id % 4 = 1 THEN 'transaction_document' WHEN id % 4 = 2 THEN 'financial_model' WHEN title ILIKE '%investor%' THEN 'investor_summary' ELSE 'company_document' END AS authority FROM {files}""")
def f3_source_authority(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(F.lit("Financial Statement"), F.lit("term_sheet"), F.lit("Financial Model"), F.lit(None)), (F.col("id") % 4 + 1).cast("int"))
    return t("files").select("id", facts.source_authority(kind, F.col("title")).alias("authority"))


@query("""
WITH v AS (SELECT company_id, field, seq, trim(value_str) AS v FROM {facts} WHERE status = 'fact' AND value_str IS NOT NULL), f AS (SELECT company_id, field, v, min(seq) AS s FROM v GROUP BY 1, 2, 3)
SELECT company_id, field, string_agg(v, ', ' ORDER BY s) AS merged FROM f GROUP BY 1, 2""")
def f4_merge_descriptive(t: Tables) -> DataFrame:
    return facts.aggregate_text(t("facts"), folded=False)


@query("""
SELECT company_id, field, value_str, value_num::DOUBLE AS value_num, status, source_authority, period, min(seq) AS seq FROM {facts} GROUP BY company_id, field, value_str, value_num, status, source_document_id, source_name, source_authority, period, section""")
def f6_dedupe_facts(t: Tables) -> DataFrame:
    return facts.dedupe_facts(t("facts")).select("company_id", "field", "value_str", F.col("value_num").cast("double").alias("value_num"), "status", "source_authority", "period", "seq")


_CONFLICT = "(SELECT company_id, field, count(*) AS n_facts, count(DISTINCT coalesce(value_num::VARCHAR, value_str, '∅')) AS n_values FROM {facts} WHERE status = 'fact' AND field NOT IN ('market_description', 'business_model') GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT coalesce(value_num::VARCHAR, value_str, '∅')) > 1)"


@query(f"SELECT company_id, field, n_facts, n_values FROM {_CONFLICT}")
def f7_conflicts(t: Tables) -> DataFrame:
    return facts.conflicts(t("facts")).select("company_id", "field", "n_facts", "n_values")


_PREFERRED = """(SELECT company_id, field, seq, value_num, value_str FROM (SELECT *, row_number() OVER (PARTITION BY company_id, field ORDER BY CASE source_authority WHEN 'mis' THEN 100 WHEN 'transaction_document' THEN 95 WHEN 'financial_model' THEN 90 WHEN 'company_document' THEN 80 WHEN 'investor_summary' THEN 70 ELSE 0 END DESC, confidence DESC, seq) AS rn FROM {facts} WHERE status = 'fact') WHERE rn = 1)"""


@query(f"SELECT company_id, field, seq, value_num::DOUBLE AS value_num, value_str FROM {_PREFERRED}")
def f8_preferred(t: Tables) -> DataFrame:
    return facts.preferred(t("facts")).select("company_id", "field", "seq", F.col("value_num").cast("double").alias("value_num"), "value_str")


@query(f"SELECT p.company_id, p.field, p.seq FROM {_PREFERRED} p ANTI JOIN {_CONFLICT} c ON c.company_id = p.company_id AND c.field = p.field")
def f9_resolved(t: Tables) -> DataFrame:
    return facts.resolved(t("facts")).select("company_id", "field", "seq")


@query("""
WITH v AS (SELECT company_id, field, seq, trim(value_str) AS v FROM {facts} WHERE status = 'fact' AND value_str IS NOT NULL), f AS (SELECT company_id, field, lower(v) AS k, arg_min(v, seq) AS v, min(seq) AS s FROM v GROUP BY 1, 2, 3)
SELECT company_id, field, string_agg(v, ', ' ORDER BY s) AS merged FROM f GROUP BY 1, 2""")
def f10_aggregate_text(t: Tables) -> DataFrame:
    return facts.aggregate_text(t("facts"))


@query(f"""
WITH d AS (SELECT company_id, count(*) AS n_facts FROM (SELECT DISTINCT company_id, field, value_str, value_num, status, source_document_id, source_name, source_authority, period, section FROM {{facts}}) GROUP BY 1)
SELECT d.company_id, d.n_facts, coalesce(c.n, 0)::BIGINT AS n_conflicts FROM d LEFT JOIN (SELECT company_id, count(*) AS n FROM {_CONFLICT.replace("FROM {facts}", "FROM (SELECT DISTINCT company_id, field, value_str, value_num, status, source_document_id, source_name, source_authority, period, section FROM {facts})")} GROUP BY 1) c ON c.company_id = d.company_id""")
def f16_reconcile(t: Tables) -> DataFrame:
    return facts.reconcile(t("facts"), ["revenue", "ebitda"]).select("company_id", "n_facts", "n_conflicts")


@query("""
WITH f AS (SELECT unnest(['revenue', 'ebitda', 'business_model', 'burn_rate']) AS field), c AS (SELECT DISTINCT company_id FROM {facts}),
g AS (SELECT company_id, field, count(*) FILTER (status = 'fact') AS nf, count(DISTINCT coalesce(value_num::VARCHAR, value_str, '∅')) FILTER (status = 'fact') AS nv, count(*) FILTER (status = 'projection') AS np, count(*) FILTER (status = 'derived') AS nd, count(*) AS n, count(DISTINCT source_name) AS ns FROM {facts} GROUP BY 1, 2)
SELECT c.company_id, f.field, CASE WHEN nf >= 2 AND nv > 1 AND f.field <> 'business_model' THEN 'CONFLICT' WHEN nf > 0 THEN 'POPULATED' WHEN np = n THEN 'PROJECTED_ONLY' WHEN nd = n THEN 'DERIVED_ONLY' WHEN n > 0 THEN 'UNSUPPORTED' ELSE 'MISSING' END AS coverage, coalesce(ns, 0)::BIGINT AS n_sources
FROM c CROSS JOIN f LEFT JOIN g ON g.company_id = c.company_id AND g.field = f.field""")
def f17_coverage(t: Tables) -> DataFrame:
    all_ = t("facts")
    fields = all_.sparkSession.createDataFrame([(f,) for f in ("revenue", "ebitda", "business_model", "burn_rate")], "field string")
    return facts.coverage(all_, fields)


@query(f"""
WITH m AS (SELECT *, CASE WHEN doc_id % 4 = 1 THEN nullif(valuation, 0) WHEN doc_id % 4 = 0 THEN valuation WHEN doc_id % 4 = 2 THEN valuation END AS v FROM {_FIN})
SELECT doc_id, round(v::DOUBLE / nullif(revenue, 0), 6) AS revenue_multiple, round(v::DOUBLE / nullif(ebitda, 0), 6) AS ebitda_multiple, margin::DOUBLE AS ebitda_margin, round(v::DOUBLE / nullif(revenue, 0) / nullif(margin, 0), 6) AS valuation_to_growth FROM m""")
def m1_financial_metrics(t: Tables) -> DataFrame:
    p = extraction.financials(t("memos"))
    typed = lambda k: F.when(F.col("financials.valuation_type") == k, F.col("financials.valuation"))
    none = F.lit(None).cast("decimal(20,4)")
    base = p.select("doc_id", typed("post_money").alias("post_money"), typed("pre_money").alias("pre_money"), typed("valuation_cap").alias("valuation_cap"), "financials.revenue", "financials.ebitda", F.col("financials.margin").alias("ebitda_margin_given"), F.col("financials.margin").alias("growth"),
                    none.alias("ltv"), none.alias("cac"), none.alias("gross_profit"), none.alias("gross_margin_given"), none.alias("runway_given"), none.alias("cash"), F.col("financials.burn_rate").alias("burn_rate"))
    return facts.financial_metrics(base).select("doc_id", *map(_num, ("revenue_multiple", "ebitda_multiple", "ebitda_margin", "valuation_to_growth")))


@query("""
SELECT mode, count(*)::BIGINT AS n_runs, sum(completion_tokens)::BIGINT AS tokens, sum(seconds)::BIGINT AS seconds, min(CASE WHEN finish_reason <> 'length' THEN max_tokens END)::BIGINT AS enough_tokens, round(sum(completion_tokens)::DOUBLE / sum(seconds), 6) AS tokens_per_second FROM {runs} GROUP BY mode""")
def m2_run_metrics(t: Tables) -> DataFrame:
    return facts.run_metrics(t("runs")).select("mode", "n_runs", "tokens", "seconds", F.col("enough_tokens").cast("long").alias("enough_tokens"), _num("tokens_per_second"))


# --- vectors and context -----------------------------------------------------

_HITS = """(SELECT query_id, pos, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, pos) AS rank FROM (
 SELECT q.query_id, v.pos, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS similarity FROM {queries} q CROSS JOIN {vectors} v) WHERE similarity >= 0.0 QUALIFY rank <= 5)"""


@query("""
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def v1_cosine(t: Tables) -> DataFrame:
    a, b = t("embeddings"), t("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query(f"SELECT query_id, pos, rank::BIGINT AS rank, round(similarity, 6) AS similarity FROM {_HITS}")
def v2_topk(t: Tables) -> DataFrame:
    return vectors.top_k(t("queries"), t("vectors")).select("query_id", "pos", F.col("rank").cast("long").alias("rank"), _num("similarity"))


@query("""
WITH c AS (SELECT vec_id % 300 AS id, vec_id AS pos, vec_id AS payload FROM embeddings), a AS (SELECT id, min(pos) AS pos, max(payload) AS payload FROM c GROUP BY id) SELECT * FROM a""")
def v3_upsert(t: Tables) -> DataFrame:
    e = t("embeddings").select((F.col("vec_id") % 300).alias("id"), F.col("vec_id").alias("pos"), F.col("vec_id").alias("payload"))
    return vectors.upsert(e.where("payload < 300"), e.where("payload >= 300"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x)) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS total FROM embeddings")
def v5_normalise(t: Tables) -> DataFrame:
    return t("embeddings").select("vec_id", F.round(F.aggregate(vectors.normalise(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"SELECT h.query_id, v.document_id, round(max(similarity), 6) AS best, count(*)::BIGINT AS n_chunks FROM {_HITS} h JOIN {{vectors}} v ON v.pos = h.pos GROUP BY 1, 2")
def v8_best_per_document(t: Tables) -> DataFrame:
    hits = vectors.top_k(t("queries"), t("vectors")).join(t("vectors").select("pos", "document_id"), "pos")
    return hits.groupBy("query_id", "document_id").agg(F.round(F.max("similarity"), 6).alias("best"), F.count("*").alias("n_chunks"))


def _hits(t: Tables) -> DataFrame:
    return vectors.top_k(t("queries"), t("vectors")).join(t("vectors").select("pos", "document_id", "chunk_id", "text"), "pos").drop("rank")


@query(f"SELECT h.query_id, v.document_id, row_number() OVER (PARTITION BY h.query_id ORDER BY min(rank))::BIGINT AS place, round(max(similarity), 6) AS score, count(*)::BIGINT AS n_blocks FROM {_HITS} h JOIN {{vectors}} v ON v.pos = h.pos GROUP BY 1, 2")
def v12_group_by_document(t: Tables) -> DataFrame:
    return vectors.documents_of(_hits(t)).select("query_id", "document_id", F.col("place").cast("long").alias("place"), _num("score"), "n_blocks")


@query(f"""
WITH h AS (SELECT h.query_id, h.similarity, h.pos, v.document_id, v.chunk_id, v.text FROM {_HITS} h JOIN {{vectors}} v ON v.pos = h.pos), d AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, document_id, chunk_id, text ORDER BY pos) = 1),
b AS (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY similarity DESC, pos ROWS UNBOUNDED PRECEDING) AS used FROM d)
SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY similarity DESC, pos) AS context, count(*)::BIGINT AS n_blocks, count(DISTINCT document_id)::BIGINT AS n_documents FROM b WHERE used <= 35 GROUP BY 1""")
def v14_retrieve_context(t: Tables) -> DataFrame:
    return vectors.retrieve_context(t("queries"), t("vectors"), limit=35)


# --- prompts and answers -----------------------------------------------------


@query("SELECT doc_id, 'Q: ' || coalesce(title, '-') || chr(10) || 'C: ' || text AS prompt FROM {memos}")
def l2_fill_template(t: Tables) -> DataFrame:
    return t("memos").select("doc_id", prompts.fill_template("Q: {query}\nC: {context}", query=F.coalesce("title", F.lit("-")), context=F.col("text")).alias("prompt"))


@query("SELECT conv_id, turn, md5(regexp_replace(text, '\\s+$', '') || CASE WHEN turn % 2 = 0 THEN chr(10) || '/think' ELSE chr(10) || '/no_think' END) AS text_md5 FROM conversations WHERE role = 'user'")
def l5_thinking_directive(t: Tables) -> DataFrame:
    c = t("conversations").where("role = 'user'")
    text = F.concat(F.regexp_replace("text", r"\s+$", ""), F.when(F.col("turn") % 3 == 0, " /no_think").otherwise(""))
    return c.select("conv_id", "turn", F.md5(prompts.thinking_directive(text, F.col("turn") % 2 == 0)).alias("text_md5"))


#: What each shape of answer must give, as written beside it by hand; the rest are objects of unknown names.
_ANSWER = f"""(SELECT run_id, CASE run_id % {len(ANSWERS) + 1} {" ".join(f"WHEN {k} THEN {quoted(a[1])}" for k, a in enumerate(ANSWERS))} ELSE text END AS obj FROM {{answers}} WHERE finish_reason <> 'length')"""
_OK, _SAID = (f"CASE run_id % {len(ANSWERS) + 1} {' '.join(f'WHEN {k} THEN {put(a[at])}' for k, a in enumerate(ANSWERS))} ELSE {rest} END" for at, rest, put in ((2, "false", lambda x: str(bool(x)).lower()), (3, "NULL", quoted)))


@query(f"SELECT run_id, obj FROM {_ANSWER}")
def l6_parse_answers(t: Tables) -> DataFrame:
    good, _ = prompts.usable(t("answers"))
    return good.select("run_id", answers.answer_object(F.col("text")).alias("obj"))


@query(f"""
SELECT run_id, {_OK} AS ok, {_SAID} AS preliminary_recommendation, CASE WHEN run_id % {len(ANSWERS) + 1} = 0 THEN 'x' WHEN run_id % {len(ANSWERS) + 1} = 10 THEN 'a ' || chr(125) || ' " b' WHEN {_OK} THEN '' END AS texts,
 CASE WHEN run_id % {len(ANSWERS) + 1} = 0 THEN 'a,b' WHEN run_id % {len(ANSWERS) + 1} = 10 THEN 'r' || chr(123) || ',]' WHEN {_OK} THEN '' END AS lists, CASE WHEN run_id % {len(ANSWERS) + 1} = 16 THEN 'v' END AS valuation_assessment FROM {_ANSWER} WHERE obj IS NOT NULL""")
def l7_validate_answers(t: Tables) -> DataFrame:
    good, _ = prompts.usable(t("answers"))
    out = good.select("run_id", answers.answer_object(F.col("text")).alias("obj")).where("obj is not null").select("run_id", answers.validate_answer(F.col("obj")).alias("v"))
    texts = F.when(F.col("v.ok"), F.concat_ws(",", *(F.col(f"v.{n}") for n in answers.TEXTS if n != "valuation_assessment")))
    lists = F.when(F.col("v.ok"), F.concat_ws(",", *(F.col(f"v.{n}") for n in answers.LISTS)))
    return out.select("run_id", "v.ok", "v.preliminary_recommendation", texts.alias("texts"), lists.alias("lists"), "v.valuation_assessment")


@query("SELECT run_id FROM {answers} WHERE finish_reason = 'length'")
def l8_truncated_answers(t: Tables) -> DataFrame:
    return prompts.usable(t("answers"))[1].select("run_id")


@query("SELECT id, mode = 'deep' AS thinking, CASE mode WHEN 'deep' THEN 1024 ELSE 768 END::INTEGER AS max_tokens, '3.7.5' AS version FROM {analyses}")
def l9_run_settings(t: Tables) -> DataFrame:
    return prompts.run_settings(t("analyses")).select("id", "thinking", "max_tokens", "version")


# --- pages and maintenance ---------------------------------------------------


@query("""
WITH r AS (SELECT id, startup_id, row_number() OVER (PARTITION BY startup_id ORDER BY created_at DESC, id DESC) AS rn, count(*) OVER (PARTITION BY startup_id) AS total FROM {analyses})
SELECT id, startup_id, rn::BIGINT AS rn, total::BIGINT AS total, ceil(total / 4.0)::BIGINT AS total_pages, true AS has_previous, ceil(total / 4.0) > 2 AS has_next FROM r WHERE rn > 4 AND rn <= 8""")
def a1_history_page(t: Tables) -> DataFrame:
    out = joins.page_of(t("analyses"), "startup_id", "created_at", "id", page=2, size=4)
    return out.select("id", "startup_id", F.col("rn").cast("long").alias("rn"), "total", F.col("total_pages").cast("long").alias("total_pages"), "has_previous", "has_next")


@query("""
WITH i AS (SELECT s_suppkey AS id, ' ' || CASE WHEN s_suppkey % 4 = 0 THEN 'Same' ELSE s_name END AS name FROM supplier), x AS (SELECT id, trim(name) AS name FROM i)
SELECT id, name, NOT (name IN (SELECT s_name FROM supplier WHERE s_suppkey % 5 = 0)) AND id = min(id) OVER (PARTITION BY name) AS inserted FROM x""")
def t1_insert_startups(t: Tables) -> DataFrame:
    s = t("supplier")
    incoming = s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit(" "), F.when(F.col("s_suppkey") % 4 == 0, "Same").otherwise(F.col("s_name"))).alias("name"))
    good, bad = maintenance.insert_unique(s.where("s_suppkey % 5 = 0").select(F.col("s_name").alias("name")), incoming, "name", "id")
    return good.select("id", "name", F.lit(True).alias("inserted")).union(bad.select("id", "name", F.lit(False).alias("inserted")))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'new ' || id::VARCHAR ELSE name END AS name, CASE WHEN id % 4 = 0 THEN NULL ELSE sector END AS sector FROM {startups}")
def t4_patch(t: Tables) -> DataFrame:
    s = t("startups").select("id", "name", "sector")
    changes = s.where("id % 3 = 0").select("id", F.lit("name").alias("column"), F.concat(F.lit("new "), F.col("id").cast("string")).alias("value"))
    changes = changes.union(s.where("id % 4 = 0").select("id", F.lit("sector"), F.lit(None).cast("string")))
    return maintenance.patch(s, changes, ["name", "sector"])


@query("""
SELECT 'founders' AS name, count(*)::BIGINT AS n FROM {founders} WHERE startup_id % 10 <> 0 UNION ALL SELECT 'files', count(*)::BIGINT FROM {files} WHERE startup_id % 10 <> 0""")
def t5_cascade_delete(t: Tables) -> DataFrame:
    gone = t("files").select(F.col("startup_id").alias("id")).union(t("founders").select(F.col("startup_id").alias("id"))).where("id % 10 = 0").distinct()
    founders, files = maintenance.cascade(gone, [(t("founders"), "", "startup_id"), (t("files"), "", "startup_id")])
    return founders.agg(F.lit("founders").alias("name"), F.count("*").alias("n")).union(files.agg(F.lit("files"), F.count("*")))


@query("SELECT id, CASE WHEN file_size < 10 AND length(title) > 10 THEN 'size|title' WHEN file_size < 10 THEN 'size' WHEN length(title) > 10 THEN 'title' ELSE '' END AS violations FROM {files}")
def t6_row_validation(t: Tables) -> DataFrame:
    v = maintenance.violations({"size": F.col("file_size") >= 10, "title": F.char_length("title") <= 10})
    return t("files").select("id", F.array_join(v, "|").alias("violations"))


@query("SELECT id, CASE lower(document_type) WHEN 'economy' THEN 'economy class' WHEN 'standard' THEN 'standard class' END AS resolved FROM {files}")
def t7_enum_resolution(t: Tables) -> DataFrame:
    values, kind = {"ECONOMY": "economy class", "STANDARD": "standard class"}, F.lower("document_type")
    return t("files").select("id", F.when(maintenance.is_member(kind, values), maintenance.resolve_enum(kind, values)).alias("resolved"))


# --- more rows of the inventory ------------------------------------------------


@query("SELECT id, 'F' || id::VARCHAR || '.txt' AS filename FROM {files} WHERE id % 5 = 0 AND id % 2 = 1")
def j8_metadata_without_file(t: Tables) -> DataFrame:
    named = t("files").select("id", F.concat(F.lit("F"), F.col("id").cast("string"), F.lit(".txt")).alias("filename"))
    given = named.where("id % 5 = 0").select("filename", "id", F.lit(None).cast("string").alias("given_title"), F.lit(None).cast("string").alias("given_type"))
    _, missing = documents.discover(named.where("id % 2 = 0").select("filename"), given)
    return missing.select("id", "filename")


@query(f"SELECT doc_id, idx::BIGINT AS idx, doc_id::VARCHAR || '/' || lang || '/' || idx::VARCHAR AS metadata FROM {_CHUNKS} JOIN documents USING (doc_id)")
def c2_chunk_metadata(t: Tables) -> DataFrame:
    chunks = chunking.chunk_metadata(chunking.chunk_text(_docs(t)), t("documents").select("doc_id", F.col("lang").alias("title")))
    return chunks.select("doc_id", F.col("idx").cast("long").alias("idx"), F.concat_ws("/", *(F.col("metadata")[k] for k in ("document_id", "title", "chunk_index"))).alias("metadata"))


_RESOLVED = f"(SELECT p.* FROM {_PREFERRED} p ANTI JOIN {_CONFLICT} c ON c.company_id = p.company_id AND c.field = p.field)"


@query(f"SELECT company_id, max(value_num) FILTER (field = 'valuation')::DOUBLE AS valuation, max(value_num) FILTER (field = 'raise_amount')::DOUBLE AS raise_amount FROM {_PREFERRED} GROUP BY company_id")
def f13_resolution_ignoring_conflicts(t: Tables) -> DataFrame:
    out = facts.pivot_resolved(t("facts"), ["valuation", "raise_amount"], ignore_conflicts=True)
    return out.select("company_id", F.col("valuation").cast("double").alias("valuation"), F.col("raise_amount").cast("double").alias("raise_amount"))


@query("""
SELECT query_id, pos, rank::BIGINT AS rank FROM (SELECT query_id, pos, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, pos) AS rank FROM (
 SELECT q.query_id, v.pos, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS similarity FROM {queries} q CROSS JOIN {vectors} v) WHERE similarity >= 0.2) WHERE rank <= 3""")
def v4_similar_documents(t: Tables) -> DataFrame:
    return vectors.top_k(t("queries"), t("vectors"), k=3, threshold=0.2).select("query_id", "pos", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT h.query_id, v.document_id, v.chunk_id, v.text, min(h.pos) AS pos FROM {_HITS} h JOIN {{vectors}} v ON v.pos = h.pos GROUP BY 1, 2, 3, 4")
def v9_context_dedupe(t: Tables) -> DataFrame:
    return vectors.dedupe_hits(_hits(t)).select("query_id", "document_id", "chunk_id", "text", "pos")


@query(f"""
SELECT query_id, pos, used::BIGINT AS used FROM (SELECT h.query_id, h.pos, sum(length(v.text)) OVER (PARTITION BY h.query_id ORDER BY h.similarity DESC, h.pos ROWS UNBOUNDED PRECEDING) AS used FROM {_HITS} h JOIN {{vectors}} v ON v.pos = h.pos) WHERE used <= 30""")
def v11_context_budget(t: Tables) -> DataFrame:
    return vectors.budget(_hits(t), limit=30).select("query_id", "pos", "used")


@query("""
SELECT id, email, startup_id < 60 AND (email IS NULL OR id = min(CASE WHEN startup_id < 60 THEN id END) OVER (PARTITION BY email)) AS inserted FROM {founders}""")
def t2_insert_founders(t: Tables) -> DataFrame:
    f = t("founders").select("id", "email", "startup_id")
    parents = f.where("startup_id < 60").select("startup_id")
    known, orphans = joins.parent_exists(f, parents, "startup_id")
    good, bad = maintenance.insert_unique(f.limit(0).select("email"), known.select("id", "email"), "email", "id")
    return good.select("id", "email", F.lit(True).alias("inserted")).union(bad.select("id", "email", F.lit(False).alias("inserted"))).union(orphans.select("id", "email", F.lit(False)))
