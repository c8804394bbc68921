"""More registered queries: reconciliation families, unions, projections, insertions and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import parsers
from factloom.operators import chunking, extraction, facts, joins, listing, maintenance, occurrences, prompts, reconcile, registry, vectors
from factloom.plans.catalog import _CHUNKS, _CONFLICT, _FIN, _PREFERRED, Tables, _num, query
from factloom.sources import documents

# --- resolution families -----------------------------------------------------

#: The fields of facts under the names of a market and of traction.
_AS_MARKET = {"market_description": "market_description", "revenue": "tam", "ebitda": "sam", "valuation": "som", "raise_amount": "market_growth_rate", "business_model": "competitor"}
_AS_TRACTION = {"revenue": "revenue", "ebitda": "customers", "valuation": "orders", "raise_amount": "churn_rate", "amount_raising": "active_users"}


def _renamed(t: Tables, names: dict[str, str]) -> DataFrame:
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return t("facts").withColumn("field", table[F.col("field")]).where("field is not null")


def _named(sql: str, names: dict[str, str]) -> str:
    """The SQL over facts with the fields renamed."""
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items())
    return sql.replace("{facts}", f"(SELECT * REPLACE (CASE field {cases} END AS field) FROM {{facts}} WHERE field IN ({', '.join(repr(a) for a in names)}))")


_TEXTS = """(WITH v AS (SELECT company_id, field, seq, trim(value_str) AS v FROM {facts} WHERE status = 'fact' AND trim(value_str) <> ''), f AS (SELECT company_id, field, lower(v) AS k, arg_min(v, seq) AS v, min(seq) AS s FROM v GROUP BY 1, 2, 3)
SELECT company_id, field, string_agg(v, ', ' ORDER BY s) AS merged FROM f GROUP BY 1, 2)"""


@query(
    _named(
        f"""SELECT c.company_id, any_value(d.merged) AS market_description, max(CASE WHEN p.field = 'tam' THEN value_num END)::DOUBLE AS tam, max(CASE WHEN p.field = 'sam' THEN value_num END)::DOUBLE AS sam,
 max(CASE WHEN p.field = 'som' THEN value_num END)::DOUBLE AS som, max(CASE WHEN p.field = 'market_growth_rate' THEN value_num END)::DOUBLE AS market_growth_rate, any_value(r.merged) AS competitors
FROM (SELECT DISTINCT company_id FROM {{facts}}) c LEFT JOIN {_PREFERRED} p ON p.company_id = c.company_id LEFT JOIN {_TEXTS} d ON d.company_id = c.company_id AND d.field = 'market_description'
LEFT JOIN {_TEXTS} r ON r.company_id = c.company_id AND r.field = 'competitor' GROUP BY c.company_id""",
        _AS_MARKET,
    )
)
def f13_market(t: Tables) -> DataFrame:
    out = facts.market(_renamed(t, _AS_MARKET))
    return out.select("company_id", "market_description", *(F.col(c).cast("double").alias(c) for c in ("tam", "sam", "som", "market_growth_rate")), F.array_join("competitors", ", ").alias("competitors"))


@query(
    _named(
        f"""WITH r AS (SELECT p.company_id, p.field, p.value_num FROM {_PREFERRED} p ANTI JOIN {_CONFLICT} x ON x.company_id = p.company_id AND x.field = p.field),
w AS (SELECT c.company_id, {", ".join(f"max(CASE WHEN field = '{v}' THEN value_num END) AS {v}" for v in _AS_TRACTION.values())} FROM (SELECT DISTINCT company_id FROM {{facts}}) c LEFT JOIN r ON r.company_id = c.company_id GROUP BY 1)
SELECT company_id, CASE WHEN coalesce({", ".join(_AS_TRACTION.values())}) IS NULL THEN 7.0 ELSE revenue END::DOUBLE AS revenue, {", ".join(f"{v}::DOUBLE AS {v}" for v in list(_AS_TRACTION.values())[1:])} FROM w""",
        _AS_TRACTION,
    )
)
def f14_traction(t: Tables) -> DataFrame:
    own = _renamed(t, _AS_TRACTION)
    known = own.select("company_id").distinct().withColumn("revenue", F.lit(7).cast("decimal(20,4)"))
    return facts.traction(own, known).select("company_id", *(F.col(c).cast("double").alias(c) for c in _AS_TRACTION.values()))


@query(f"SELECT company_id, merged AS business_model FROM {_TEXTS} WHERE field = 'business_model'")
def f15_business_model(t: Tables) -> DataFrame:
    return facts.business_model(t("facts"))


_SAFE_FIELDS = {
    "financials": "revenue gross_sales gross_profit gross_margin ebitda ebitda_margin net_profit cash debt burn_rate runway_months contribution_profit_per_order",
    "fundraising": "amount_raised pre_money_valuation post_money_valuation instrument investor_commitments",
    "traction": "revenue revenue_growth_yoy customers paying_customers active_users repeat_customer_rate orders churn_rate customer_acquisition_cost average_order_value top_customer_concentration",
}
_RECONCILED = f"""(WITH d AS (SELECT company_id, field, value_str, value_num, status, source_document_id, source_name, source_authority, period, section, min(seq) AS seq, arg_min(confidence, seq) AS confidence FROM {{source_facts}} GROUP BY ALL),
f AS (SELECT *, coalesce(value_num::DOUBLE::VARCHAR, value_str) AS v, CASE source_authority WHEN 'mis' THEN 100 WHEN 'transaction_document' THEN 95 WHEN 'financial_model' THEN 90 WHEN 'company_document' THEN 80 WHEN 'investor_summary' THEN 70 ELSE 0 END AS p FROM d WHERE status = 'fact'),
x AS (SELECT company_id, field FROM f WHERE field NOT IN ('market_description', 'business_model') GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT v) > 1),
best AS (SELECT company_id, field, v, p, confidence, seq FROM f QUALIFY row_number() OVER (PARTITION BY company_id, field ORDER BY p DESC, confidence DESC, seq) = 1),
safe AS (SELECT * FROM best ANTI JOIN x USING (company_id, field)),
texts AS (SELECT company_id, field, string_agg(t, ', ' ORDER BY s) AS v FROM (SELECT company_id, field, arg_min(trim(value_str), seq) AS t, min(seq) AS s FROM f WHERE trim(value_str) <> '' GROUP BY company_id, field, lower(trim(value_str))) GROUP BY 1, 2),
pairs AS (SELECT company_id, a AS target, field, v, p, confidence, seq FROM best JOIN (VALUES ('amount_raising', 'amount_raising', 0), ('amount_raising', 'raise_amount', 1), ('valuation_cap', 'valuation_cap', 0), ('valuation_cap', 'valuation', 1)) w(a, b, r) ON b = field
 QUALIFY row_number() OVER (PARTITION BY company_id, a ORDER BY p DESC, confidence DESC, r) = 1),
bad AS (SELECT company_id, CASE WHEN field IN ('amount_raising', 'raise_amount') THEN 'amount_raising' WHEN field IN ('valuation_cap', 'valuation') THEN 'valuation_cap' END AS target FROM x),
found AS ({" UNION ALL ".join(f"SELECT company_id, '{k}' AS family, field, v FROM safe WHERE field IN ({', '.join(repr(x) for x in v.split())})" for k, v in _SAFE_FIELDS.items())}
 UNION ALL SELECT company_id, 'market', field, v FROM best WHERE field IN ('tam', 'sam', 'som', 'market_growth_rate', 'geographic_market')
 UNION ALL SELECT company_id, 'market', CASE field WHEN 'competitor' THEN 'competitors' ELSE field END, v FROM texts WHERE field IN ('market_description', 'competitor')
 UNION ALL SELECT company_id, 'business_model', field, v FROM texts WHERE field = 'business_model'
 UNION ALL SELECT company_id, 'fundraising', target, v FROM pairs ANTI JOIN bad USING (company_id, target)
 UNION ALL SELECT s.company_id, 'fundraising', 'valuation_cap', s.v FROM safe s JOIN bad ON bad.company_id = s.company_id AND bad.target = 'valuation_cap' WHERE s.field = 'valuation_cap'),
signed AS (SELECT DISTINCT company_id FROM f WHERE field = 'pre_money_valuation' AND source_authority = 'transaction_document'),
merged AS (SELECT coalesce(a.company_id, c.company_id) AS company_id, coalesce(a.family, c.family) AS family, coalesce(a.field, c.field) AS field, coalesce(a.v, c.value_num::DOUBLE::VARCHAR, c.value_str) AS v FROM (SELECT DISTINCT * FROM found) a FULL JOIN {{current_figures}} c ON c.company_id = a.company_id AND c.family = a.family AND c.field = a.field)
SELECT m.* FROM merged m WHERE v IS NOT NULL AND NOT (field = 'valuation_cap' AND company_id IN (SELECT company_id FROM signed)))"""


@query(f"SELECT company_id, family, field, v AS value FROM {_RECONCILED}")
def f16_reconciled_fields(t: Tables) -> DataFrame:
    rows = reconcile.reconciled(reconcile.field_states(t("source_facts")), t("current_figures"))
    return rows.select("company_id", "family", "field", F.coalesce(F.col("value_num").cast("double").cast("string"), "value_str", F.array_join("texts", ", ")).alias("value"))


_FAMILY = lambda name, fields: f"SELECT company_id, {', '.join(f'max(v) FILTER (field = {x!r}) AS {x}' for x in fields)} FROM {_RECONCILED} WHERE family = '{name}' GROUP BY company_id"
_RAISING = ("amount_raising", "amount_raised", "pre_money_valuation", "post_money_valuation", "valuation_cap", "instrument", "investor_commitments")


def _family(t: Tables, name: str, texts: tuple[str, ...] = ()) -> DataFrame:
    rows = reconcile.reconciled(reconcile.field_states(t("source_facts")), t("current_figures")).where(F.col("family") == name)
    wide = reconcile.families(rows).select("company_id", f"{name}.*")
    return wide.select("company_id", *(F.col(c) if c in texts else F.col(c).cast("double").cast("string").alias(c) for c in wide.columns if c != "company_id"))


@query(_FAMILY("financials", _SAFE_FIELDS["financials"].split()))
def f11_financial_resolution(t: Tables) -> DataFrame:
    return _family(t, "financials")


@query(_FAMILY("fundraising", _RAISING))
def f12_fundraising(t: Tables) -> DataFrame:
    return _family(t, "fundraising", ("instrument", "investor_commitments"))


@query("""
WITH d AS (SELECT DISTINCT company_id, field, value_str, value_num, source_document_id, source_name, source_authority, period, section FROM {source_facts} WHERE status = 'fact' AND field NOT IN ('market_description', 'business_model')),
v AS (SELECT company_id, field, coalesce(value_num::DOUBLE::VARCHAR, trim(value_str)) AS v, coalesce(value_num::VARCHAR, value_str) AS k, count(*) AS n FROM d GROUP BY ALL)
SELECT company_id, field, sum(n)::BIGINT AS n_facts, count(*)::BIGINT AS n_values, string_agg(v || ' x' || n::VARCHAR, '; ' ORDER BY v, n) AS told FROM v GROUP BY 1, 2 HAVING count(*) > 1""")
def f16_conflicts(t: Tables) -> DataFrame:
    found = reconcile.conflicts_of(reconcile.field_states(t("source_facts")))
    told = F.array_sort(F.transform("values", lambda v: F.struct(F.coalesce(v["text"].try_cast("double").cast("string"), v["text"]).alias("v"), v["n"])))
    return found.select("company_id", "field", "n_facts", F.size("values").cast("long").alias("n_values"), F.array_join(F.transform(told, lambda v: F.concat(v["v"], F.lit(" x"), v["n"].cast("string"))), "; ").alias("told"))


@query(f"""
SELECT company_id, max(v) FILTER (family = 'financials' AND field = 'revenue') AS revenue, max(v) FILTER (family = 'traction' AND field = 'churn_rate') AS churn_rate, max(v) FILTER (field = 'competitors') AS competitors, max(v) FILTER (field = 'business_model') AS business_model,
 count(*) FILTER (family = 'fundraising')::BIGINT AS n_fundraising, count(*) FILTER (family = 'market')::BIGINT AS n_market FROM {_RECONCILED} GROUP BY company_id""")
def f16_families(t: Tables) -> DataFrame:
    wide = reconcile.families(reconcile.reconciled(reconcile.field_states(t("source_facts")), t("current_figures")))
    number = lambda c: F.col(c).cast("double").cast("string")
    known = lambda s: sum((F.col(f"{s}.{f}").isNotNull().cast("long") for f in wide.schema[s].dataType.names), F.lit(0).cast("long"))
    return wide.select("company_id", number("financials.revenue").alias("revenue"), number("traction.churn_rate").alias("churn_rate"), "market.competitors", "business_model.business_model", known("fundraising").alias("n_fundraising"), known("market").alias("n_market"))


#: What stands at the canonical paths: companies by their number have the names of their sources, one more, one less, or nothing.
_CANONICAL = """(SELECT company_id, 'input.revenue' AS path, ' ' || CAST(company_id % 50 AS STRING) || '.0' AS value_str FROM {facts} WHERE company_id % 7 <> 0 GROUP BY company_id
 UNION ALL SELECT company_id, 'input.business_model', CASE company_id % 4 WHEN 0 THEN 'b2b, SaaS,hardware ' WHEN 1 THEN 'saas, B2B, hardware, other' WHEN 2 THEN 'SaaS,hardware' ELSE ' Hardware,,b2b , saas,SAAS' END FROM {facts} WHERE company_id % 7 <> 0 GROUP BY company_id)"""


@query(f"""
WITH f AS (SELECT company_id, field, value_str, value_num FROM {{facts}} WHERE field IN ('revenue', 'business_model') AND status = 'fact'),
s AS (SELECT DISTINCT company_id, trim(lower(value_str)) AS v FROM f WHERE field = 'business_model'), c AS (SELECT DISTINCT company_id, trim(lower(u)) AS v FROM (SELECT company_id, unnest(string_split(value_str, ',')) AS u FROM {_CANONICAL} WHERE path = 'input.business_model') WHERE trim(u) <> ''),
d AS (SELECT company_id FROM s ANTI JOIN c USING (company_id, v) UNION SELECT company_id FROM c ANTI JOIN s USING (company_id, v))
SELECT f.company_id, f.field, 'input.' || f.field AS path, count(*)::BIGINT AS n, CASE WHEN f.field = 'business_model' THEN CASE WHEN f.company_id IN (SELECT company_id FROM d) THEN 0 ELSE count(*) END ELSE count(*) FILTER (f.value_num = f.company_id % 50 AND f.company_id % 7 <> 0) END::BIGINT AS n_preserved,
 CASE WHEN f.field = 'business_model' THEN f.company_id NOT IN (SELECT company_id FROM d) ELSE count(*) FILTER (f.value_num = f.company_id % 50 AND f.company_id % 7 <> 0) > 0 END AS preserved FROM f GROUP BY 1, 2""")
def f18_canonical_path(t: Tables) -> DataFrame:
    own = t("facts").where("status = 'fact' and field in ('revenue', 'business_model')")
    companies = t("facts").where("company_id % 7 <> 0").select("company_id").distinct()
    k = F.col("company_id") % 4
    models = companies.select("company_id", F.lit("input.business_model").alias("path"), F.when(k == 0, "b2b, SaaS,hardware ").when(k == 1, "saas, B2B, hardware, other").when(k == 2, "SaaS,hardware").otherwise(" Hardware,,b2b , saas,SAAS").alias("value_str"))
    figures = companies.select("company_id", F.lit("input.revenue").alias("path"), F.format_string(" %d.0", F.col("company_id") % 50).alias("value_str"))
    paths = own.sparkSession.createDataFrame([("revenue", "input.revenue"), ("business_model", "input.business_model")], "field string, path string")
    return facts.preserved(own, models.union(figures).withColumn("value_num", F.lit(None).cast("decimal(20,4)")), paths)


# --- unions and ranges -------------------------------------------------------


@query(f"""
WITH v AS (SELECT doc_id, doc_id % 50 AS company_id, 1 AS k, raise_amount::DOUBLE AS v FROM {_FIN} UNION ALL SELECT doc_id, doc_id % 50, 2, valuation::DOUBLE FROM {_FIN} UNION ALL SELECT doc_id, doc_id % 50, 3, revenue::DOUBLE FROM {_FIN} UNION ALL SELECT doc_id, doc_id % 50, 4, ebitda::DOUBLE FROM {_FIN})
SELECT company_id, doc_id, row_number() OVER (PARTITION BY company_id ORDER BY doc_id DESC, k)::BIGINT AS place, v AS value_num FROM v WHERE v IS NOT NULL""")
def j10_union_of_profiles(t: Tables) -> DataFrame:
    memos = t("memos")
    fields = ("raise_amount", "valuation", "revenue", "ebitda")
    rows = extraction.financials(memos).select("doc_id", F.posexplode(F.array(*(F.col(f"financials.{c}") for c in fields))).alias("seq", "value_num")).where("value_num is not null")
    order = memos.select("doc_id", (F.col("doc_id") % 50).alias("company_id"), (-F.col("doc_id")).alias("doc_pos"))
    return joins.union_of_profiles(rows, order).select("company_id", "doc_id", F.col("place").cast("long").alias("place"), F.col("value_num").cast("double").alias("value_num"))


@query("""
WITH e AS (SELECT * FROM {facts} WHERE seq % 3 <> 0), l AS (SELECT company_id, max(seq) AS last FROM e GROUP BY 1)
SELECT company_id, seq, field FROM e UNION ALL SELECT i.company_id, coalesce(l.last, 0) + i.seq, i.field FROM {facts} i LEFT JOIN l ON l.company_id = i.company_id WHERE i.seq % 3 = 0""")
def j11_existing_and_incoming(t: Tables) -> DataFrame:
    return facts.with_incoming(t("facts").where("seq % 3 <> 0"), t("facts").where("seq % 3 = 0")).select("company_id", "seq", "field")


@query(f"""
WITH r AS (SELECT doc_id, length(text) AS n, (doc_id * 37) % 3000 AS s, (doc_id * 37) % 3000 + (doc_id % 5) * 450 AS e FROM documents WHERE text IS NOT NULL)
SELECT r.doc_id, coalesce(string_agg(c.idx::VARCHAR, ',' ORDER BY c.idx), '') AS chunks FROM r LEFT JOIN {_CHUNKS} c ON c.doc_id = r.doc_id AND r.e > r.s AND c.s < r.e AND c.e > r.s GROUP BY r.doc_id""")
def j6_chunks_of_range(t: Tables) -> DataFrame:
    start = (F.col("doc_id") * 37) % 3000
    ranges = t("documents").where("text is not null").select("doc_id", F.char_length("text").alias("n_chars"), start.alias("start_offset"), (start + (F.col("doc_id") % 5) * 450).alias("end_offset"))
    return joins.chunks_of_range(ranges).select("doc_id", F.array_join(F.transform("chunks", lambda x: x.cast("string")), ",").alias("chunks"))


@query("""
SELECT s.id, (SELECT count(*) FROM {founders} f WHERE f.startup_id = s.id)::BIGINT AS n_founders, (SELECT count(*) FROM {files} d WHERE d.startup_id = s.id)::BIGINT AS n_documents, (SELECT count(*) FROM {rounds} r WHERE r.startup_id = s.id)::BIGINT AS n_rounds FROM {startups} s""")
def j1_company_with_rounds(t: Tables) -> DataFrame:
    child = lambda name, item: t(name).select(F.col("startup_id").alias("id"), F.col(item).alias("item"))
    out = joins.bundle(t("startups").select("id"), founders=child("founders", "full_name"), files=child("files", "title"), rounds=child("rounds", "round_id"))
    n = lambda c, name: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long").alias(name)
    return out.select("id", n("founders", "n_founders"), n("files", "n_documents"), n("rounds", "n_rounds"))


# --- entities ----------------------------------------------------------------

_MORE = ("investors", "accelerators", "locations", "sectors", "products", "technologies")


@query("SELECT c_custkey AS doc_id, " + ", ".join(f"CASE WHEN c_custkey % {k + 2} = 0 THEN '' ELSE '{n} a|N' || (c_custkey % 9)::VARCHAR || '|B c' END AS {n}" for k, n in enumerate(_MORE)) + ", round(0.25 + 0.1 * (" + " + ".join(f"(c_custkey % {k + 2} <> 0)::INT" for k in range(len(_MORE))) + "), 6)::DOUBLE AS confidence FROM customer")
def x2_entity_lists(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    line = lambda k, n: F.when(key % (k + 2) == 0, "").otherwise(F.concat(F.lit(f" {n.upper()[:1]}{n[1:]} :  {n} a;N"), (key % 9).cast("string"), F.lit(f" , {n.upper()} A;; B  c\n{n}: later\n")))
    customers = t("customer")
    n_tasks = 4 * customers.sparkSession.sparkContext.defaultParallelism  # a customer costs far more than it weighs: splits by size would leave all to a task or two
    docs = customers.repartition(n_tasks, "c_custkey").select(key.alias("doc_id"), F.concat(*(line(k, n) for k, n in enumerate(_MORE))).alias("text"))
    found = docs.select("doc_id", extraction.entities(F.col("text")).alias("e"))
    return found.select("doc_id", *(F.array_join(f"e.{n}", "|").alias(n) for n in _MORE), _num("e.confidence"))


# --- parsers -----------------------------------------------------------------


@query(f"""
SELECT doc_id, CASE WHEN revenue IS NOT NULL THEN revenue WHEN ebitda IS NOT NULL THEN ebitda WHEN doc_id % 3 = 2 THEN n * 1000000 ELSE n * 100000 END::DOUBLE AS amount, CASE WHEN revenue IS NULL AND ebitda IS NULL AND doc_id % 3 = 2 THEN 'USD' ELSE 'INR' END AS currency FROM {_FIN}""")
def p2_first_money(t: Tables) -> DataFrame:
    return t("memos").select("doc_id", parsers.first_money(F.col("text")).alias("m")).select("doc_id", F.col("m.amount").cast("double").alias("amount"), "m.currency")


# --- listings ----------------------------------------------------------------


def _users(t: Tables) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.concat(F.lit("User"), F.col("c_custkey").cast("string"), F.lit("@Example.com")).alias("email"), (F.col("c_custkey") % 3 != 0).alias("is_active"), (F.col("c_custkey") % 50 == 0).alias("is_superuser"))


@query("""
SELECT 'startup' AS kind, id, title FROM {files} WHERE startup_id = 12 UNION ALL SELECT 'search', id, title FROM {files} WHERE title ILIKE '%ring%' UNION ALL SELECT 'all', id, title FROM {files}""")
def r13_document_listings(t: Tables) -> DataFrame:
    f, kind = t("files"), lambda df, k: df.select(F.lit(k).alias("kind"), "id", "title")
    return kind(listing.documents(f, startup_id=12, search="ring"), "startup").union(kind(listing.documents(f, search="ring"), "search")).union(kind(listing.documents(f), "all"))


@query("""
WITH u AS (SELECT c_custkey AS id, c_name AS full_name, 'User' || c_custkey::VARCHAR || '@Example.com' AS email FROM customer)
SELECT 'active' AS kind, id FROM u WHERE id % 3 <> 0 UNION ALL SELECT 'super', id FROM u WHERE id % 50 = 0 UNION ALL SELECT 'search', id FROM u WHERE email ILIKE '%r12%' OR full_name ILIKE '%r12%' UNION ALL SELECT 'email', id FROM u WHERE lower(email) = 'user77@example.com'""")
def r15_users(t: Tables) -> DataFrame:
    u, kind = _users(t), lambda df, k: df.select(F.lit(k).alias("kind"), "id")
    return kind(listing.users(u, active=True), "active").union(kind(listing.users(u, superusers=True), "super")).union(kind(listing.users(u, search="r12"), "search")).union(kind(listing.users(u, email="USER77@example.com"), "email"))


@query("""
SELECT c_custkey AS founder_id, c_name AS name, c_mktsegment AS role, 'n ' || c_nationkey::VARCHAR AS background,
 CASE WHEN c_custkey % 4 = 0 AND c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN 'Previous companies: Acme' WHEN c_custkey % 3 = 0 THEN (c_custkey % 20)::VARCHAR || ' years experience' ELSE (c_custkey % 20)::VARCHAR || ' years experience; Previous companies: Acme' END AS relevant_experience, NULL::VARCHAR AS analysis_notes FROM customer""")
def r18_founder_projection(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    rows = t("customer").select(c.alias("id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("designation"), F.concat(F.lit("n "), F.col("c_nationkey").cast("string")).alias("education"), F.when(c % 4 != 0, (c % 20).cast("int")).alias("experience_years"), F.when(c % 3 == 0, "").otherwise("Acme").alias("previous_companies"), F.lit(None).cast("string").alias("notes"))
    return listing.founder_projection(rows)


@query("""
SELECT k.id AS id, s.name IS NOT NULL AS startup_found, f.email IS NOT NULL AS email_found FROM (SELECT id, name FROM {startups}) k
LEFT JOIN (SELECT DISTINCT name FROM {startups} WHERE status = 'ACTIVE') s ON s.name = k.name LEFT JOIN (SELECT DISTINCT email FROM {founders} WHERE startup_id < 30) f ON f.email = 'f' || k.id::VARCHAR || '@example.com'""")
def r2_r9_existence(t: Tables) -> DataFrame:
    wanted = t("startups").select("id", "name", F.concat(F.lit("f"), F.col("id").cast("string"), F.lit("@example.com")).alias("email"))
    by_name = listing.exists_by_key(t("startups").where("status = 'ACTIVE'"), wanted, "name").withColumnRenamed("found", "startup_found")
    return listing.exists_by_key(t("founders").where("startup_id < 30"), by_name, "email").select("id", "startup_found", F.col("found").alias("email_found"))


@query("""
SELECT id, startup_id, mode, status, recommendation, created_at, analysis_version, model_name, thinking_enabled, max_tokens, temperature, finish_reason, prompt_tokens, completion_tokens, (id % 900 + id % 700)::BIGINT AS total_tokens, inference_time_seconds, investment_thesis,
 input_snapshot, metrics_snapshot, result_snapshot, error_message FROM {analyses}""")
def s11_history_detail(t: Tables) -> DataFrame:
    return documents.history_detail(t("analyses"))


# --- maintenance and vectors -------------------------------------------------


@query("""
WITH i AS (SELECT id, startup_id, sha256(content) AS h FROM {files} WHERE id % 5 <> 0), p AS (SELECT id FROM {startups} WHERE id < 80), k AS (SELECT DISTINCT sha256(content) AS h FROM {files} WHERE id % 5 = 0),
f AS (SELECT h, min(id) AS first FROM i WHERE startup_id IN (SELECT id FROM p) GROUP BY 1)
SELECT i.id, CASE WHEN i.startup_id NOT IN (SELECT id FROM p) THEN 'no_startup' WHEN i.h NOT IN (SELECT h FROM k) AND f.first = i.id THEN 'created' ELSE 'duplicate' END AS outcome,
 CASE WHEN i.startup_id IN (SELECT id FROM p) AND i.h NOT IN (SELECT h FROM k) AND f.first = i.id THEN 'UPLOADED' END AS status FROM i LEFT JOIN f ON f.h = i.h""")
def t3_insert_documents(t: Tables) -> DataFrame:
    hashed = t("files").select("id", "startup_id", documents.content_hash(F.col("content").cast("binary")).alias("file_hash"))
    return maintenance.insert_documents(hashed.where("id % 5 = 0"), hashed.where("id % 5 <> 0"), t("startups").where("id < 80")).select("id", "outcome", "status")


@query("""
SELECT 'left' AS kind, vec_id AS id, vec_id * 2 AS payload FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT 'got', vec_id, CASE WHEN vec_id % 3 <> 0 THEN vec_id * 2 END FROM embeddings WHERE vec_id % 7 = 0 UNION ALL SELECT 'count', count(*), NULL FROM embeddings WHERE vec_id % 3 <> 0""")
def v3_remove_get_count(t: Tables) -> DataFrame:
    all_ = t("embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") * 2).alias("payload"))
    left = vectors.remove(all_, all_.where("id % 3 = 0"))
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), "id", "payload")
    n = left.agg(F.count("*").alias("id")).withColumn("payload", F.lit(None).cast("long"))
    return kind(left, "left").union(kind(vectors.get(left, all_.where("id % 7 = 0")), "got")).union(kind(n, "count"))


@query("""
SELECT 'kept' AS kind, vec_id AS id, vec_id + 100 AS pos, vec_id * 3 AS payload FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT 'cleared', 0, NULL, NULL""")
def v3_clear(t: Tables) -> DataFrame:
    """An index is cleared and half of the vectors put in again, at new positions."""
    all_ = t("embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), (F.col("vec_id") * 2).alias("payload"))
    empty = vectors.clear(all_)
    again = vectors.upsert(empty, all_.where("id % 2 = 0").withColumns({"pos": F.col("pos") + 100, "payload": F.col("id") * 3}))
    none = F.lit(None).cast("long")
    return again.select(F.lit("kept").alias("kind"), "id", "pos", "payload").union(empty.agg(F.count("*").alias("n")).select(F.lit("cleared"), "n", none, none))


@query("SELECT doc_id, length(text)::DOUBLE AS n_chars, (length(text) - length(replace(text, 'a', '')))::DOUBLE AS n_a FROM documents WHERE text IS NOT NULL")
def v6_embedding_function(t: Tables) -> DataFrame:
    docs = t("documents").where("text is not null").select("doc_id", "text")
    out = registry.embed(docs, "text", lambda texts: [[float(len(x)), float(x.count("a"))] for x in texts])
    return out.select("doc_id", F.get("embedding", F.lit(0)).alias("n_chars"), F.get("embedding", F.lit(1)).alias("n_a"))


@query(f"SELECT doc_id, count(*)::BIGINT AS n_chunks FROM {_CHUNKS} GROUP BY 1")
def u3_chunker_by_name(t: Tables) -> DataFrame:
    steps = registry.Steps()
    steps.add("fixed", chunking.chunk_text, filters=("size", "overlap"))
    return steps.run("fixed", t("documents").select("doc_id", "text"), size=1000, overlap=200).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


# --- prompts and snapshots ---------------------------------------------------


@query("""
SELECT pos, '[Document: ' || document_id || ' | Chunk: ' || CASE WHEN pos % 3 = 0 THEN 'None' ELSE chunk_id END || ' | Relevance: ' || printf('%.4f', (pos % 8) / 8.0) || ']' || chr(10) || text AS block FROM {vectors}""")
def l1_context_block(t: Tables) -> DataFrame:
    return t("vectors").select("pos", prompts.context_block(F.col("document_id"), F.when(F.col("pos") % 3 != 0, F.col("chunk_id")), (F.col("pos") % 8) / 8.0, F.col("text")).alias("block"))


_PAYLOAD = """'{"startup":{"id":' || id::VARCHAR || ',"name":"' || name || '"' || CASE WHEN id % 3 = 0 THEN '' ELSE ',"sector":"' || sector || '"' END || '},"deterministic_financial_metrics":{"multiple":"' || (id % 90)::VARCHAR || '.5000"}}'"""


def _company(t: Tables) -> DataFrame:
    company = F.struct("id", "name", F.when(F.col("id") % 3 != 0, F.col("sector")).alias("sector"))
    metrics = F.struct(((F.col("id") % 90) + F.lit(0.5)).cast("decimal(20,4)").cast("string").alias("multiple"))
    return t("startups").select("id", company.alias("company"), metrics.alias("metrics"))


#: The payload's SQL, its braces out of the way of the names of tables.
_PAYLOAD = _PAYLOAD.replace("{\"", "' || chr(123) || '\"").replace("}", "' || chr(125) || '")


@query(f"SELECT id, {_PAYLOAD} AS payload FROM {{startups}}")
def l3_analysis_payload(t: Tables) -> DataFrame:
    return _company(t).select("id", prompts.analysis_payload(F.col("company"), F.col("metrics")).alias("payload"))


#: The form of an answer, written out by hand.
_FORM = (
    '"company_overview": "string or null", "founder_assessment": "string or null", "product_assessment": "string or null", "market_assessment": "string or null", "traction_assessment": "string or null", '
    '"financial_assessment": "string or null", "valuation_assessment": "string or null", "business_model_assessment": "string or null", "competitive_assessment": "string or null", "investment_thesis": "string or null", '
    '"strengths": ["string"], "risks": ["string"], "missing_information": ["string"], "key_observations": ["string"], "preliminary_recommendation": "insufficient_information | promising | needs_further_diligence | concerns"'
)


@query(f"""
SELECT id, 'system' AS role, 'You assess startups for an investor. Rely on the given data alone, never fill gaps with guesses, and answer with one JSON object.' AS content FROM {{startups}}
UNION ALL SELECT id, 'user', 'Assess this startup.' || chr(10) || chr(10) || 'Data:' || chr(10) || {_PAYLOAD} || chr(10) || chr(10) || 'Answer with a JSON object of this form and nothing else:' || chr(10) || chr(123) || '{_FORM}' || chr(125) || chr(10)
 || 'Use null where the data do not suffice and name what is missing under missing_information.' FROM {{startups}}""")
def l4_analysis_messages(t: Tables) -> DataFrame:
    return _company(t).select("id", F.inline(prompts.analysis_messages(F.col("company"), F.col("metrics"))))


@query("""
SELECT startup_id, id, 'completed' AS status, CASE WHEN id % 2 = 0 THEN mode ELSE 'model-x' END AS model_name, chr(123) || '"mode":"' || mode || '"' || chr(125) AS input_snapshot, chr(123) || '"tokens":' || id::VARCHAR || chr(125) AS metrics_snapshot,
 chr(123) || '"preliminary_recommendation":"' || recommendation || '"' || CASE WHEN id % 3 = 0 THEN '' ELSE ',"investment_thesis":"t"' END || chr(125) AS result_snapshot, recommendation, CASE WHEN id % 3 <> 0 THEN 't' END AS investment_thesis FROM {analyses}""")
def s10_analysis_snapshots(t: Tables) -> DataFrame:
    runs = t("analyses").select(
        "startup_id", "id", F.when(F.col("id") % 2 == 0, F.col("mode")).alias("model_name"), F.struct("mode").alias("input"), F.struct(F.col("id").alias("tokens")).alias("metrics"),
        F.struct(F.col("recommendation").alias("preliminary_recommendation"), F.when(F.col("id") % 3 != 0, "t").alias("investment_thesis")).alias("result"),
    )
    return documents.analysis_snapshots(runs, "model-x")


@query(f"""
WITH m AS (SELECT *, rev % 1000 + 1 AS ltv, n % 7 AS cac, rev // 3 AS gross, n * 100 AS cash, n % 3 AS burn FROM {_FIN})
SELECT doc_id, round(ltv::DOUBLE / nullif(cac, 0), 6) AS ltv_cac, round(gross::DOUBLE / nullif(revenue, 0) * 100, 4) AS gross_margin, round(cash::DOUBLE / nullif(burn, 0), 6) AS runway FROM m""")
def m1_unit_economics(t: Tables) -> DataFrame:
    d = lambda c: c.cast("decimal(20,4)")
    sums = t("orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.sum(F.floor("o_totalprice").cast("long")).alias("rev"), F.count("*").alias("n"))
    none = F.lit(None).cast("decimal(20,4)")
    base = extraction.financials(t("memos")).join(sums, "doc_id").select(
        "doc_id", none.alias("post_money"), none.alias("pre_money"), none.alias("valuation_cap"), "financials.revenue", "financials.ebitda", none.alias("ebitda_margin_given"), none.alias("growth"), d(F.col("rev") % 1000 + 1).alias("ltv"), d(F.col("n") % 7).alias("cac"),
        d(F.floor(F.col("rev") / 3)).alias("gross_profit"), none.alias("gross_margin_given"), none.alias("runway_given"), d(F.col("n") * 100).alias("cash"), d(F.col("n") % 3).alias("burn_rate"),
    )
    return facts.financial_metrics(base).select("doc_id", _num("ltv_cac"), _num("gross_margin", 4), _num("runway"))


@query(f"""
WITH p AS (SELECT doc_id, unnest(string_split(text, 'the')) AS x, generate_subscripts(string_split(text, 'the'), 1) AS i, len(string_split(text, 'the')) AS n FROM documents),
 o AS (SELECT * FROM (SELECT doc_id, i, n, sum(length(x) + 3) OVER (PARTITION BY doc_id ORDER BY i) - 3 AS s FROM p) WHERE i < n),
 l AS (SELECT doc_id, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, length(x) AS m
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
 h AS (SELECT o.doc_id, o.s, l.b, l.b + l.m AS e FROM o ASOF JOIN l ON l.doc_id = o.doc_id AND o.s >= l.b),
 c AS (SELECT h.doc_id, h.s, min(k.idx) AS idx FROM h LEFT JOIN {_CHUNKS} k ON k.doc_id = h.doc_id AND k.s <= h.s AND h.s + 3 <= k.e GROUP BY 1, 2)
SELECT h.doc_id, h.s::BIGINT AS start_offset, h.b::BIGINT AS line_start, h.e::BIGINT AS line_end, substr(d.text, greatest(h.b, h.s - 40)::BIGINT + 1, (least(h.e, h.s + 43) - greatest(h.b, h.s - 40))::BIGINT) AS context, c.idx::BIGINT AS chunk_idx
FROM h JOIN documents d USING (doc_id) JOIN c ON c.doc_id = h.doc_id AND c.s = h.s""")
def c3_c4_j7_every_occurrence(t: Tables) -> DataFrame:
    """Line, context and chunk of every occurrence of a phrase."""
    found = occurrences.occurrences(t("documents").select("doc_id", "text"), "the")
    return found.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("start_offset", "line_start", "line_end")), "context", F.col("chunk_idx").cast("long").alias("chunk_idx"))


@query("""
WITH s AS (SELECT s_suppkey AS id, s_name AS name, n_name AS sector FROM supplier JOIN nation ON n_nationkey = s_nationkey), f AS (SELECT min(id) AS first FROM s WHERE id % 9 = 3)
SELECT id, CASE WHEN id = first THEN 'Same' ELSE name END AS name, CASE WHEN id = first OR id % 9 = 6 THEN 'moved' ELSE sector END AS sector, CASE WHEN id % 9 = 0 OR id % 9 = 3 AND id <> first THEN 'clash' WHEN id % 3 = 0 THEN 'updated' END AS outcome FROM s, f
UNION ALL SELECT -id, NULL, NULL, 'not_found' FROM s WHERE id % 3 = 1""")
def t4_patch_unique(t: Tables) -> DataFrame:
    """Patches that ask for a name of another row, for a new name that others ask for, too, for their own name, and for rows that there are not."""
    s = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("sector"))
    k = F.col("id")
    name = F.when(k % 9 == 0, F.format_string("Supplier#%09d", F.abs(k - 1))).when(k % 9 == 6, F.col("name")).otherwise("Same")
    asks = s.where("id % 3 < 2").select(F.when(k % 3 == 0, k).otherwise(-k).alias("id"), F.explode(F.create_map(F.lit("name"), name, F.lit("sector"), F.lit("moved"))).alias("column", "value"))
    left, outcomes = maintenance.patch_unique(s, asks, ["name", "sector"], "name")
    return left.join(outcomes, "id", "full")
