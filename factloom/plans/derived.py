"""Business tables derived from the given ones, by SQL that Spark and DuckDB read alike.

Names in braces are tables, given or derived.  Amounts are whole numbers, so
that both engines write the same text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Every field that a source may tell of.
SOURCE_FIELDS = (
    "revenue gross_sales gross_profit gross_margin ebitda ebitda_margin net_profit cash debt burn_rate runway_months contribution_profit_per_order amount_raised pre_money_valuation post_money_valuation instrument investor_commitments amount_raising raise_amount "
    "valuation_cap valuation market_description tam sam som market_growth_rate geographic_market competitor revenue_growth_yoy customers paying_customers active_users repeat_customer_rate orders churn_rate customer_acquisition_cost average_order_value "
    "top_customer_concentration business_model"
).split()

#: Shapes of answers, written by hand: the text, its object, whether that is a valid answer, and its recommendation.
ANSWERS = (
    ('{"preliminary_recommendation":"promising","strengths":["a"," b "],"company_overview":" x "}', '{"preliminary_recommendation":"promising","strengths":["a"," b "],"company_overview":" x "}', True, "promising"),
    ('<think>maybe {"x":1}</think>\n{"preliminary_recommendation":"concerns"}', '{"preliminary_recommendation":"concerns"}', True, "concerns"),
    ('Here:\n```json\n{"strengths":["a","b","c","d"]}\n```', '{"strengths":["a","b","c","d"]}', False, None),
    ("no object here", None, None, None),
    ('{"preliminary_recommendation":"perhaps"}', '{"preliminary_recommendation":"perhaps"}', False, None),
    ('note {draft} then {"preliminary_recommendation":"needs_further_diligence"}', '{"preliminary_recommendation":"needs_further_diligence"}', True, "needs_further_diligence"),
    ('{"preliminary_recommendation":"promising"} and {"x":1}', '{"preliminary_recommendation":"promising"}', True, "promising"),
    ('[1] {"a":{"b":1}} tail }', '{"a":{"b":1}}', False, None),
    ('[{"company_overview":"x"}]', None, None, None),
    ('```json\n{broken\n``` {"a":1}', None, None, None),
    ('say {"company_overview":"a } \\" b","risks":["r{", "]"]} end', '{"company_overview":"a } \\" b","risks":["r{", "]"]}', True, "insufficient_information"),
    ('{"risks":"none"}', '{"risks":"none"}', False, None),
    ('{"market_assessment":null,"missing_information":[]}', '{"market_assessment":null,"missing_information":[]}', True, "insufficient_information"),
    ('{"founder_assessment":3}', '{"founder_assessment":3}', False, None),
    ('{"key_observations":["a",null]}', '{"key_observations":["a",null]}', False, None),
    ('```\n{"recommendation":"invest"}\n```', '{"recommendation":"invest"}', False, None),
    ('{"traction_assessment":"t" {"valuation_assessment":"v"}', '{"valuation_assessment":"v"}', True, "insufficient_information"),
)


def quoted(text: str | None) -> str:
    """A text as an SQL expression that both engines and the names in braces leave alone."""
    if text is None:
        return "CAST(NULL AS STRING)"
    for c in "{}\\\n":
        text = text.replace(c, f"' || chr({ord(c)}) || '")
    return f"('{text}')"


DERIVED = {
    "memos": """
SELECT c.c_custkey AS doc_id,
 CASE c.c_custkey % 6 WHEN 0 THEN 'Pitch deck' WHEN 1 THEN 'Term Sheet' WHEN 2 THEN 'Shareholders pact' WHEN 3 THEN 'Promise report' WHEN 4 THEN 'Financial statement' ELSE NULL END AS title,
 CASE WHEN c.c_custkey % 7 = 6 THEN 'Company:' ELSE 'Company: ' || c.c_name END || chr(10)
 || 'Founders: Ann ' || CAST(c.c_custkey AS STRING) || ', bob; Bob' || chr(10)
 || CASE WHEN c.c_custkey % 5 = 0 THEN '' ELSE 'Revenue: INR ' || CAST(r.rev AS STRING) || chr(10) END
 || CASE WHEN c.c_custkey % 4 = 1 THEN '' ELSE 'EBITDA: INR ' || CAST(CAST(FLOOR(r.rev / 5) AS BIGINT) AS STRING) || chr(10) END
 || CASE WHEN c.c_custkey % 3 = 2 THEN 'Raised USD ' || CAST(r.n AS STRING) || ' Million in a seed round' ELSE 'Currently raising INR ' || CAST(r.n AS STRING) || ' Lakh' END || chr(10)
 || CASE c.c_custkey % 4 WHEN 0 THEN 'Pre-money valuation: INR ' WHEN 1 THEN 'Post-money valuation: INR ' WHEN 2 THEN 'Valuation cap: INR ' ELSE 'Minimum ticket INR ' END || CAST(r.n + 3 AS STRING) || ' Cr' || chr(10)
 || 'EBITDA margin ' || CAST(c.c_custkey % 40 AS STRING) || '%' || chr(10)
 || 'Runway is ' || CAST(c.c_custkey % 30 AS STRING) || CASE WHEN c.c_custkey % 2 = 0 THEN ' months.' ELSE ' years.' END || chr(10)
 || '# Summary' || chr(10)
 || CASE c.c_mktsegment WHEN 'BUILDING' THEN 'B2B marketplace for enterprise buyers in India' WHEN 'AUTOMOBILE' THEN 'hospital diagnostic AI, patent pending' WHEN 'MACHINERY' THEN 'not a consumer app; chip prototype'
    WHEN 'HOUSEHOLD' THEN 'consumer subscription, single customer, no revenue' ELSE 'burn rate and key hires: surveillance cctv, FDA' END || chr(10) AS text
FROM {customer} c JOIN (SELECT o_custkey, CAST(SUM(CAST(FLOOR(o_totalprice) AS BIGINT)) AS BIGINT) AS rev, COUNT(*) AS n FROM {orders} GROUP BY o_custkey) r ON r.o_custkey = c.c_custkey""",
    "facts": """
SELECT company_id, seq, field, value_str, value_num, status, source_document_id, source_name, source_authority, period, section, confidence FROM (
 SELECT o_custkey % 97 AS company_id, o_orderkey AS seq,
  CASE o_orderkey % 8 WHEN 0 THEN 'revenue' WHEN 1 THEN 'ebitda' WHEN 2 THEN 'valuation' WHEN 3 THEN 'raise_amount' WHEN 4 THEN 'amount_raising' WHEN 5 THEN 'pre_money_valuation' WHEN 6 THEN 'business_model' ELSE 'market_description' END AS field,
  CASE WHEN o_orderkey % 8 >= 6 THEN CASE o_custkey % 4 WHEN 0 THEN ' SaaS' WHEN 1 THEN 'saas' WHEN 2 THEN 'Hardware' ELSE 'B2B ' END END AS value_str,
  CASE WHEN o_orderkey % 8 < 6 THEN CAST(CAST(FLOOR(o_totalprice / 250000) AS BIGINT) AS DECIMAL(20,4)) END AS value_num,
  CASE o_orderstatus WHEN 'P' THEN 'projection' ELSE CASE WHEN o_orderkey % 29 = 0 THEN 'derived' ELSE 'fact' END END AS status,
  CAST(o_custkey AS STRING) AS source_document_id, 'doc ' || CAST(o_custkey % 5 AS STRING) AS source_name,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'mis' WHEN '2-HIGH' THEN 'transaction_document' WHEN '3-MEDIUM' THEN 'financial_model' WHEN '5-LOW' THEN 'investor_summary' ELSE 'company_document' END AS source_authority,
  'FY' || CAST(2020 + o_orderkey % 3 AS STRING) AS period, 'notes' AS section, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS confidence
 FROM {orders})
UNION ALL
SELECT o_custkey % 97, o_orderkey + 1000000000, 'revenue', CAST(NULL AS STRING), CAST(CAST(FLOOR(o_totalprice / 250000) AS BIGINT) AS DECIMAL(20,4)), 'fact', CAST(o_custkey AS STRING), 'doc ' || CAST(o_custkey % 5 AS STRING), 'mis', 'FY2020', 'notes', CAST(0.5 AS DOUBLE)
FROM {orders} WHERE o_orderkey % 24 = 0 AND o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P'""",
    "source_facts": f"""
SELECT company_id, seq, field, CASE WHEN textual THEN CASE pick WHEN 0 THEN ' SaaS' WHEN 1 THEN 'saas' WHEN 2 THEN 'Hardware' WHEN 3 THEN ' ' ELSE 'B2B ' END END AS value_str, CASE WHEN NOT textual THEN value_num END AS value_num,
 status, source_document_id, source_name, source_authority, period, section, confidence FROM (
 SELECT o_custkey % 211 AS company_id, o_orderkey AS seq, f.field, f.field IN ('instrument', 'investor_commitments', 'geographic_market', 'market_description', 'business_model', 'competitor') AS textual, o_custkey % 5 AS pick,
  CAST(CAST(FLOOR(o_totalprice / 250000) AS BIGINT) AS DECIMAL(20,4)) AS value_num, CASE WHEN o_orderkey % 11 = 0 THEN 'projection' ELSE 'fact' END AS status, CAST(o_custkey % 3 AS STRING) AS source_document_id, 'doc' AS source_name,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'mis' WHEN '2-HIGH' THEN 'transaction_document' WHEN '3-MEDIUM' THEN 'financial_model' WHEN '5-LOW' THEN 'investor_summary' ELSE 'company_document' END AS source_authority,
  'FY2024' AS period, 'notes' AS section, CAST(o_orderkey % 4 AS DOUBLE) / 4 AS confidence
 FROM {{orders}} JOIN (SELECT field, k FROM {{numbered_fields}}) f ON f.k = o_orderkey % {len(SOURCE_FIELDS)})""",
    "numbered_fields": " UNION ALL ".join(f"SELECT '{f}' AS field, {k} AS k" for k, f in enumerate(SOURCE_FIELDS)),
    "current_figures": """
SELECT company_id, family, field, CASE WHEN textual THEN NULL ELSE CAST(company_id + 1000 AS DECIMAL(20,4)) END AS value_num, CASE WHEN textual THEN 'current' END AS value_str FROM (
 SELECT c.company_id, f.family, f.field, f.field IN ('instrument', 'investor_commitments', 'geographic_market', 'market_description', 'business_model') AS textual
 FROM (SELECT DISTINCT o_custkey % 211 AS company_id FROM {orders}) c JOIN (SELECT 'financials' AS family, 'cash' AS field UNION ALL SELECT 'financials', 'ebitda' UNION ALL SELECT 'fundraising', 'valuation_cap' UNION ALL SELECT 'fundraising', 'amount_raising'
  UNION ALL SELECT 'fundraising', 'instrument' UNION ALL SELECT 'market', 'tam' UNION ALL SELECT 'market', 'market_description' UNION ALL SELECT 'traction', 'revenue' UNION ALL SELECT 'traction', 'orders' UNION ALL SELECT 'business_model', 'business_model') f ON c.company_id % 3 < 2)""",
    "startups": """
SELECT s_suppkey AS id, s_name AS name, s_name || ' Ltd' AS legal_name, n_name AS sector, CASE WHEN s_suppkey % 3 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status, CAST(1990 + s_suppkey % 40 AS INT) AS founded_year,
 'Makes ' || CAST(s_suppkey % 6 AS STRING) AS description, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'Industry ' || CAST(s_suppkey % 4 AS STRING) END AS industry, CASE s_suppkey % 3 WHEN 0 THEN 'idea' WHEN 1 THEN 'mvp' ELSE 'growth' END AS stage, n_name AS headquarters
FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey""",
    "founders": """
SELECT c_custkey AS id, c_custkey % 100 AS startup_id, c_name AS full_name, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'f' || CAST(c_custkey % 700 AS STRING) || '@example.com' END AS email, c_custkey AS created_at FROM {customer}""",
    "files": """
SELECT p_partkey AS id, p_partkey % 100 AS startup_id, p_name AS title, p_type AS document_type, CASE WHEN p_size > 25 THEN 'UPLOADED' ELSE 'PROCESSED' END AS status, p_name || ' ' || p_brand AS content, p_partkey % 977 AS created_at, p_size AS file_size,
 CASE p_partkey % 9 WHEN 0 THEN 'My Pitch-Deck' WHEN 1 THEN 'financial_model_v2' WHEN 2 THEN 'Q1 financials' WHEN 3 THEN 'business plan' WHEN 4 THEN 'term-sheet' WHEN 5 THEN 'cap table' WHEN 6 THEN '.hidden demo' WHEN 7 THEN 'share_notes' ELSE 'readme' END
 || '_' || CAST(p_partkey AS STRING) || CASE p_partkey % 7 WHEN 0 THEN '.TXT' WHEN 1 THEN '.pdf' WHEN 2 THEN '.docx' WHEN 3 THEN '.md' WHEN 4 THEN '.text' WHEN 5 THEN '.csv' ELSE '.bin' END AS filename,
 CASE p_partkey % 5 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'text/csv' WHEN 3 THEN 'TEXT/PLAIN' ELSE 'application/octet-stream' END AS mime_type
FROM {part}""",
    "analyses": """
SELECT o_orderkey AS id, o_custkey AS startup_id, CASE WHEN o_orderkey % 3 = 0 THEN 'deep' ELSE 'standard' END AS mode, o_orderstatus AS status, CASE o_orderpriority WHEN '1-URGENT' THEN 'promising' WHEN '2-HIGH' THEN 'concerns' WHEN '3-MEDIUM' THEN 'needs_further_diligence' ELSE 'insufficient_information' END AS recommendation, o_orderdate AS created_at, 'x' AS input_snapshot,
 '3.7.5' AS analysis_version, 'model-' || CAST(o_orderkey % 2 AS STRING) AS model_name, o_orderkey % 3 = 0 AS thinking_enabled, CASE WHEN o_orderkey % 3 = 0 THEN 1024 ELSE 768 END AS max_tokens, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS temperature, CASE WHEN o_orderkey % 11 = 0 THEN 'length' ELSE 'stop' END AS finish_reason,
 o_orderkey % 900 AS prompt_tokens, o_orderkey % 700 AS completion_tokens, CAST(o_orderkey % 90 AS DOUBLE) / 2 AS inference_time_seconds, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'thesis ' || CAST(o_orderkey % 5 AS STRING) END AS investment_thesis,
 'm' || CAST(o_orderkey % 8 AS STRING) AS metrics_snapshot, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'r' || CAST(o_orderkey % 9 AS STRING) END AS result_snapshot, CASE WHEN o_orderkey % 13 = 0 THEN 'failed' END AS error_message FROM {orders}""",
    "ledgers": """
SELECT o_orderkey AS doc_id, o_orderkey % 7 AS shape, a, b, c, CASE o_orderkey % 7
 WHEN 0 THEN 'ARR INR ' || CAST(a AS STRING) || chr(10) || 'Monthly burn USD ' || CAST(b AS STRING) || chr(10)
 WHEN 1 THEN 'Annual recurring revenue INR ' || CAST(a AS STRING) || chr(10) || 'Sales INR ' || CAST(b AS STRING) || chr(10) || 'Burn rate INR ' || CAST(c AS STRING) || chr(10)
 WHEN 2 THEN 'Revenue USD ' || CAST(a AS STRING) || ', later INR ' || CAST(b AS STRING) || chr(10)
 WHEN 3 THEN 'ARR and revenue INR ' || CAST(a AS STRING) || ', then INR ' || CAST(b AS STRING) || chr(10)
 WHEN 4 THEN 'Burn, income, EBITDA: INR ' || CAST(a AS STRING) || ', INR ' || CAST(b AS STRING) || ', INR ' || CAST(c AS STRING) || chr(10)
 WHEN 5 THEN 'Fee INR ' || CAST(a AS STRING) || ' paid' || chr(10) || 'Barred: USD ' || CAST(b AS STRING) || chr(10)
 ELSE 'Nothing told' || chr(10) END AS text FROM (SELECT o_orderkey, CAST(FLOOR(o_totalprice) AS BIGINT) AS a, CAST(FLOOR(o_totalprice / 7) AS BIGINT) + 11 AS b, o_custkey + 1000 AS c FROM {orders})""",
    "rounds": """
SELECT l_orderkey * 10 + l_linenumber AS round_id, l_orderkey AS startup_id, CASE WHEN l_linestatus = 'O' AND l_quantity > 30 THEN 'OPEN' ELSE 'CLOSED' END AS status FROM {lineitem}""",
    "investments": """
SELECT event_id AS id, event_id % 2000 AS round_id, CASE WHEN event_id % 3 = 0 AND event_id > 0 THEN CAST(FLOOR(event_id / 3) AS BIGINT) END AS follows FROM {events}""",
    "references": """
SELECT 'founder' AS name, id, 'company' AS parent_name, startup_id AS parent_id FROM {founders}
UNION ALL SELECT 'file', id, 'company', startup_id FROM {files}
UNION ALL SELECT 'round', round_id, 'company', startup_id FROM {rounds}
UNION ALL SELECT 'investment', id, 'round', round_id * 10 + 1 FROM {investments}
UNION ALL SELECT 'investment', id, 'investment', follows FROM {investments} WHERE follows IS NOT NULL""",
    "vectors": """
SELECT vec_id AS pos, 'd' || CAST(vec_id % 50 AS STRING) AS document_id, 'c' || CAST(vec_id % 7 AS STRING) AS chunk_id, 'passage ' || CAST(vec_id % 90 AS STRING) AS text, embedding FROM {embeddings}""",
    "queries": """
SELECT vec_id AS query_id, embedding FROM {embeddings} WHERE vec_id % 20 = 0""",
    "answers": f"""
SELECT event_id AS run_id, CASE WHEN event_id % 11 = 0 THEN 'length' ELSE 'stop' END AS finish_reason,
 CASE event_id % {len(ANSWERS) + 1} {" ".join(f"WHEN {k} THEN {quoted(a[0])}" for k, a in enumerate(ANSWERS))} ELSE props END AS text
FROM {{events}}""",
    "runs": """
SELECT event_type AS mode, CAST(FLOOR(value) AS BIGINT) AS completion_tokens, event_id % 7 AS seconds, CASE WHEN event_id % 5 = 0 THEN 'length' ELSE 'stop' END AS finish_reason, 256 * (1 + event_id % 4) AS max_tokens FROM {events}""",
}


def spark_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or the derived one of that name."""
    if name in GIVEN:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needed = set(re.findall(r"\{(\w+)\}", DERIVED[name]))
    return spark.sql(DERIVED[name], **{t: spark_table(spark, sf_dir, t) for t in needed})


def duck(sql: str) -> str:
    """SQL for DuckDB: {name} of a derived table becomes its query, of a given one its name."""

    def put(m: re.Match) -> str:
        return f"({duck(DERIVED[m[1]])})" if m[1] in DERIVED else m[1]

    return re.sub(r"\{(\w+)\}", put, sql)
