"""Reconciliation of all of a company's facts into five families of fields, over current values, in mergeable states.

Facts cross one exchange, on their own identity, where repeats meet.  From
there on only states move: of a value (how often, first, best source), of a
field (values, conflict, best fact, first texts) and of a target, to which one
or several fields lead.  A company with very many facts spreads over tasks, and
no state is larger than the distinct values of one field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.spans import fold, strip
from factloom.operators.facts import FACT_KEY, MARKET_SCALARS, NO_CONFLICT, TRACTION, priority, value_key

# The fields of the financial and fundraising families.
FINANCIALS = ("revenue", "gross_sales", "gross_profit", "gross_margin", "ebitda", "ebitda_margin", "net_profit", "cash", "debt", "burn_rate", "runway_months", "contribution_profit_per_order")
FUNDRAISING = ("amount_raised", "pre_money_valuation", "post_money_valuation", "instrument", "investor_commitments")

#: (family, target, field, rank of the field, how): "safe" gives nothing in conflict, "best" the preferred fact whatever
#: its conflicts, "text" and "list" all texts; "all" gives nothing if any of its fields is in conflict; "cap" is "all",
#: else its own field if that is safe; "signed" only tells of a transaction document, which clears the target.
ROUTES = (
    *(("financials", f, f, 0, "safe") for f in FINANCIALS),
    *(("fundraising", f, f, 0, "safe") for f in FUNDRAISING),
    ("fundraising", "amount_raising", "amount_raising", 0, "all"),
    ("fundraising", "amount_raising", "raise_amount", 1, "all"),
    ("fundraising", "valuation_cap", "valuation_cap", 0, "cap"),
    ("fundraising", "valuation_cap", "valuation", 1, "cap"),
    ("fundraising", "valuation_cap", "pre_money_valuation", 2, "signed"),
    ("market", "market_description", "market_description", 0, "text"),
    *(("market", f, f, 0, "best") for f in MARKET_SCALARS),
    ("market", "competitors", "competitor", 0, "list"),
    *(("traction", f, f, 0, "safe") for f in TRACTION),
    ("business_model", "business_model", "business_model", 0, "text"),
)


def value_states(facts: DataFrame) -> DataFrame:
    """(company_id, field, value, n, seq, best, signed): one row per distinct value of a field's facts."""
    once = facts.where("status = 'fact'").groupBy(*FACT_KEY).agg(F.min(F.struct("seq", "confidence")).alias("first"))
    best = F.max(F.struct(priority(F.col("source_authority")).alias("p"), F.coalesce("first.confidence", F.lit(0.0)).cast("double").alias("c"), (-F.col("first.seq")).alias("s"), "value_num", "value_str"))
    value = value_key(F.col("value_num"), F.col("value_str")).alias("value")
    return once.groupBy("company_id", "field", value).agg(F.count("*").alias("n"), F.min("first.seq").alias("seq"), best.alias("best"), F.bool_or(F.col("source_authority") == "transaction_document").alias("signed"))


def field_states(facts: DataFrame) -> DataFrame:
    """(company_id, field, n_facts, conflict, best, signed, values): the state of each field; values by their first fact."""
    one = value_states(facts)
    text = strip(F.coalesce(F.col("best.value_str"), F.col("best.value_num").cast("string")))
    values = F.sort_array(F.collect_list(F.struct("seq", text.alias("text"), "n")))
    out = one.groupBy("company_id", "field").agg(F.sum("n").alias("n_facts"), F.count("*").alias("n_values"), F.max("best").alias("best"), F.bool_or("signed").alias("signed"), values.alias("values"))
    return out.withColumn("conflict", (F.col("n_values") > 1) & ~F.col("field").isin(*NO_CONFLICT)).drop("n_values")


def conflicts_of(states: DataFrame) -> DataFrame:
    """(company_id, field, n_facts, values): the fields whose facts disagree, each value with its first fact and number."""
    return states.where("conflict").select("company_id", "field", "n_facts", "values")


def _texts(values: Column) -> Column:
    """Distinct texts, case folded, in first-seen order."""
    told = F.filter(values, lambda v: v["text"] != "")
    folded = F.transform(told, lambda v: fold(v["text"]))
    return F.transform(F.filter(F.transform(told, lambda v, k: F.struct(v["text"].alias("text"), (F.array_position(folded, fold(v["text"])) == k + 1).alias("first"))), lambda v: v["first"]), lambda v: v["text"])


def reconciled(states: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """(company_id, family, field, value_num, value_str, texts) from field_states(); current has the same first five columns.

    What no fact decides stays as in current, but for a cap that a transaction
    document's pre-money valuation clears.
    """
    routes = F.array(*(F.struct(F.lit(a).alias("family"), F.lit(b).alias("target"), F.lit(c).alias("of"), F.lit(d).alias("rank"), F.lit(e).alias("how")) for a, b, c, d, e in ROUTES))
    led = states.select("*", F.inline(F.filter(routes, lambda r: r["of"] == F.col("field"))))
    told = F.col("how") != "signed"
    order = F.struct(F.col("best.p"), F.col("best.c"), -F.col("rank"), F.col("best.s"))
    own = F.when(told & (F.col("rank") == 0) & ~F.col("conflict"), F.col("best"))
    one = led.groupBy("company_id", "family", F.col("target").alias("field")).agg(
        F.max(F.when(told, F.col("how"))).alias("how"), F.bool_or(told & F.col("conflict")).alias("blocked"), F.max_by(F.col("best"), F.when(told, order)).alias("best"), F.max(own).alias("own"),
        F.bool_or(~told & F.col("signed")).alias("cleared"), F.max(F.when(F.col("how").isin("text", "list"), F.col("values"))).alias("values"),
    )
    texts = F.when(F.col("how").isin("text", "list"), _texts(F.col("values")))
    found = F.when(F.col("how").isin("text", "list") | F.col("cleared"), None).when((F.col("how") == "best") | ~F.col("blocked"), F.col("best")).when(F.col("how") == "cap", F.col("own"))
    out = one.select("company_id", "family", "field", "cleared", "how", found.alias("found"), texts.alias("texts"))
    joined = F.when(F.col("how") == "text", F.nullif(F.array_join("texts", ", "), F.lit("")))
    out = out.select("company_id", "family", "field", "cleared", F.col("found.value_num").alias("value_num"), F.coalesce(joined, "found.value_str").alias("value_str"), F.when(F.col("how") == "list", F.col("texts")).alias("texts"))
    if current is not None:
        old = current.select("company_id", "family", "field", F.col("value_num").alias("old_num"), F.col("value_str").alias("old_str"))
        stays = F.coalesce(F.col("value_num").cast("string"), "value_str").isNull() & F.coalesce(F.size("texts") <= 0, F.lit(True)) & ~F.coalesce("cleared", F.lit(False))
        out = out.join(old, ["company_id", "family", "field"], "full").select("company_id", "family", "field", F.when(stays, F.col("old_num")).otherwise(F.col("value_num")).alias("value_num"), F.when(stays, F.col("old_str")).otherwise(F.col("value_str")).alias("value_str"), "texts")
    some = F.coalesce(F.col("value_num").cast("string"), "value_str").isNotNull() | (F.size("texts") > 0)
    return out.select("company_id", "family", "field", "value_num", "value_str", "texts").where(some)


def families(rows: DataFrame) -> DataFrame:
    """One row per company with a struct of each family's fields, from reconciled()."""
    text = F.coalesce(F.array_join("texts", ", "), F.col("value_str"), F.col("value_num").cast("string"))
    of = lambda family, field: F.max(F.when((F.col("family") == family) & (F.col("field") == field), text)).alias(f"{family}.{field}")
    targets = list(dict.fromkeys((r[0], r[1]) for r in ROUTES))
    wide = rows.groupBy("company_id").agg(*(of(*x) for x in targets))
    names = list(dict.fromkeys(f for f, _ in targets))
    return wide.select("company_id", *(F.struct(*(F.col(f"`{f}.{x}`").alias(x) for g, x in targets if g == f)).alias(f) for f in names))
