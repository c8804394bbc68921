"""Facts from profiles, their reconciliation by source authority, and ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.spans import fold, strip

# Priorities of sources, and the fields that may differ without a conflict.
PRIORITY = {"mis": 100, "transaction_document": 95, "financial_model": 90, "company_document": 80, "investor_summary": 70, "llm_extraction": 10, "unknown": 0}
NO_CONFLICT = ("market_description", "business_model")
FACT_KEY = ("company_id", "field", "value_str", "value_num", "status", "source_document_id", "source_name", "source_authority", "period", "section")


def financial_facts(profiled: DataFrame) -> DataFrame:
    """(doc_id, field, value_num, status, confidence): seven financial fields, one row for each that is known."""
    names = {"raise_amount": "raise_amount", "valuation": "valuation", "revenue": "revenue", "ebitda": "ebitda", "burn_rate": "burn_rate", "runway_months": "runway_months", "ebitda_margin": "margin"}
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"financials.{c}").cast("decimal(20,4)").alias("value_num")) for f, c in names.items()))
    return profiled.select("doc_id", "confidence", F.inline(rows)).where("value_num is not null").select("doc_id", "field", "value_num", F.lit("fact").alias("status"), "confidence")


def signal_facts(profiled: DataFrame) -> DataFrame:
    lists = {"market_description": "markets", "geographic_market": "geographies", "business_model": "business_models"}

    def named(field: str, column: str) -> Column:
        return F.transform(F.col(f"signals.{column}"), lambda v: F.struct(F.lit(field).alias("field"), v.alias("value_str")))

    rows = F.flatten(F.array(*(named(f, c) for f, c in lists.items())))
    return profiled.select("doc_id", "confidence", F.inline(rows)).select("doc_id", "field", "value_str", F.lit("fact").alias("status"), "confidence")


def source_authority(document_type: Column, title: Column) -> Column:
    kind, name = F.lower(F.coalesce(document_type, F.lit(""))), F.lower(title)
    return (
        F.when(kind.contains("mis") | name.contains("mis") | (kind.contains("financial") & ~kind.contains("model")), "mis")
        .when(kind.rlike("transaction|term_sheet|investment_note"), "transaction_document")
        .when(kind.contains("projection") | kind.contains("model"), "financial_model")
        .when(name.contains("investor"), "investor_summary")
        .otherwise("company_document")
    )


def priority(authority: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv)), authority), F.lit(0))


def value_key(num: Column, text: Column) -> Column:
    """A value's identity: numbers by amount, texts as they are, and null as a value of its own."""
    return F.coalesce(num.cast("string"), text, F.lit("∅"))


def dedupe_facts(facts: DataFrame) -> DataFrame:
    """The first (least seq) of equal facts; an aggregation, so that equal facts meet before the shuffle."""
    rest = [c for c in facts.columns if c not in FACT_KEY]
    return facts.groupBy(*FACT_KEY).agg(F.min_by(F.struct(*rest), F.col("seq")).alias("_first")).select(*FACT_KEY, *(F.col(f"_first.{c}").alias(c) for c in rest)).select(*facts.columns)


def conflicts(facts: DataFrame) -> DataFrame:
    """(company_id, field, n_facts, n_values, values): fields with facts that disagree; the period does not matter."""
    real = facts.where((F.col("status") == "fact") & ~F.col("field").isin(*NO_CONFLICT))
    key = value_key(F.col("value_num"), F.col("value_str"))
    found = real.groupBy("company_id", "field").agg(F.count("*").alias("n_facts"), F.count_distinct(key).alias("n_values"), F.sort_array(F.collect_list(F.struct("seq", "value_num", "value_str", "source_authority"))).alias("values"))
    return found.where("n_facts >= 2 and n_values > 1").withColumn("requires_diligence", F.lit(True))


def preferred(facts: DataFrame) -> DataFrame:
    """(company_id, field, ...): per field the fact of the highest priority, then confidence, then the first."""
    real = facts.where(F.col("status") == "fact")
    order = F.struct(priority(F.col("source_authority")).alias("p"), F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col("seq")).alias("s"))
    best = real.groupBy("company_id", "field").agg(F.max_by(F.struct("seq", "value_num", "value_str", "source_authority", "confidence"), order).alias("_best"))
    return best.select("company_id", "field", "_best.*")


def resolved(facts: DataFrame) -> DataFrame:
    """preferred() where the field is not in conflict."""
    return preferred(facts).join(conflicts(facts).select("company_id", "field"), ["company_id", "field"], "left_anti")


def aggregate_text(facts: DataFrame, folded: bool = True) -> DataFrame:
    """(company_id, field, merged): distinct texts in first-seen order, joined by commas."""
    value = strip(F.col("value_str"))
    real = facts.where((F.col("status") == "fact") & (value != "")).select("company_id", "field", "seq", value.alias("v"), (fold(value) if folded else value).alias("k"))
    first = real.groupBy("company_id", "field", "k").agg(F.min(F.struct("seq", "v")).alias("f"))
    return first.groupBy("company_id", "field").agg(F.array_join(F.transform(F.sort_array(F.collect_list("f")), lambda x: x["v"]), ", ").alias("merged"))


def pivot_resolved(facts: DataFrame, fields: list[str], ignore_conflicts: bool = False) -> DataFrame:
    """One row per company with a column for each field."""
    base = preferred(facts) if ignore_conflicts else resolved(facts)
    return base.groupBy("company_id").pivot("field", fields).agg(F.first("value_num"))


# The fields of a market and of traction.
MARKET_SCALARS = ("tam", "sam", "som", "market_growth_rate", "geographic_market")
TRACTION = ("revenue", "revenue_growth_yoy", "customers", "paying_customers", "active_users", "repeat_customer_rate", "orders", "churn_rate", "customer_acquisition_cost", "average_order_value", "top_customer_concentration")


def distinct_texts(facts: DataFrame, field: str) -> DataFrame:
    """(company_id, values): the distinct texts of a field, case folded, in first-seen order."""
    value = strip(F.coalesce("value_str", F.col("value_num").cast("string")))
    first = facts.where((F.col("status") == "fact") & (F.col("field") == field) & (value != "")).groupBy("company_id", fold(value).alias("k")).agg(F.min(F.struct("seq", value.alias("v"))).alias("f"))
    return first.groupBy("company_id").agg(F.transform(F.sort_array(F.collect_list("f")), lambda x: x["v"]).alias("values"))


def market(facts: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """(company_id, market_description, five scalars, competitors): texts joined, scalars by preference whatever their
    conflicts, competitors as a list; what no fact gives stays as in current."""
    text = aggregate_text(facts.where("field = 'market_description'")).select("company_id", F.col("merged").alias("market_description"))
    value = F.coalesce("value_str", F.col("value_num").cast("string"))
    scalars = preferred(facts.where(F.col("field").isin(*MARKET_SCALARS))).groupBy("company_id").pivot("field", list(MARKET_SCALARS)).agg(F.first(value))
    rivals = distinct_texts(facts, "competitor").withColumnRenamed("values", "competitors")
    out = facts.select("company_id").distinct()
    for part in (text, scalars, rivals):
        out = out.join(part, "company_id", "left")
    return out if current is None else _over(out, current)


def _over(found: DataFrame, current: DataFrame) -> DataFrame:
    """found, with nulls taken from current (company_id, some of the columns)."""
    have = [c for c in found.columns if c != "company_id" and c in current.columns]
    old = current.select("company_id", *(F.col(c).alias(f"_old_{c}") for c in have))
    out = found.join(old, "company_id", "left")
    return out.select("company_id", *(F.coalesce(c, f"_old_{c}").alias(c) if c in have else F.col(c) for c in found.columns if c != "company_id"))


def traction(facts: DataFrame, revenue: DataFrame | None = None, current: DataFrame | None = None) -> DataFrame:
    """(company_id, eleven fields): the fields without conflicts; where none is known, revenue (company_id, revenue) stands for traction."""
    found = facts.select("company_id").distinct().join(pivot_resolved(facts.where(F.col("field").isin(*TRACTION)), list(TRACTION)), "company_id", "left")
    if current is not None:
        found = _over(found, current)
    if revenue is None:
        return found
    none = F.coalesce(*map(F.col, TRACTION)).isNull()
    return found.join(revenue.select("company_id", F.col("revenue").alias("_known")), "company_id", "left").withColumn("revenue", F.when(none, F.col("_known")).otherwise(F.col("revenue"))).drop("_known")


def business_model(facts: DataFrame) -> DataFrame:
    """(company_id, business_model): the distinct models, joined."""
    return aggregate_text(facts.where("field = 'business_model'")).select("company_id", F.col("merged").alias("business_model"))


def preserved(facts: DataFrame, canonical: DataFrame, paths: DataFrame) -> DataFrame:
    """(company_id, field, path, n, n_preserved, preserved): whether what the sources say of a field stands at its canonical path.

    facts (company_id, field, value_str, value_num), canonical (company_id,
    path, value_str, value_num), paths (field, path).  A business model is
    preserved if the union of the names in all of a company's values is the set
    of names at the path; any other field if some value equals the canonical
    one, numbers by value, also those written as texts, texts as they are.
    """
    number = lambda s: F.coalesce(F.col(f"{s}.value_num"), F.expr(f"try_cast(trim({s}.value_str) AS decimal(20,4))"))
    names = lambda s: F.filter(F.transform(F.split(F.coalesce(F.col(f"{s}.value_str"), F.lit("")), ","), lambda x: F.lower(strip(x))), lambda x: x != "")
    same = F.coalesce(number("f").eqNullSafe(number("c")) & number("f").isNotNull(), F.lit(False)) | F.coalesce(number("f").isNull() & (F.col("f.value_str") == F.col("c.value_str")), F.lit(False))
    joined = facts.alias("f").join(paths.alias("p"), F.col("f.field") == F.col("p.field")).join(canonical.alias("c"), (F.col("f.company_id") == F.col("c.company_id")) & (F.col("p.path") == F.col("c.path")), "left")
    rows = joined.select("f.company_id", "f.field", "p.path", same.alias("same"), names("f").alias("own"), names("c").alias("theirs"))
    # names meet in one set per task before the shuffle, so a company's facts are never held as rows
    found = rows.groupBy("company_id", "field", "path").agg(F.count("*").alias("n"), F.count_if("same").alias("n_same"), F.collect_set("own").alias("own"), F.first("theirs").alias("theirs"))
    sets = F.array_sort(F.array_distinct(F.flatten("own"))) == F.array_sort(F.array_distinct("theirs"))
    model = F.col("field") == "business_model"
    kept = F.when(model, sets).otherwise(F.col("n_same") > 0)
    return found.select("company_id", "field", "path", "n", F.when(model, F.when(sets, F.col("n")).otherwise(0)).otherwise(F.col("n_same")).cast("long").alias("n_preserved"), kept.alias("preserved"))


def with_incoming(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing facts and then incoming ones, numbered on in that order."""
    last = existing.groupBy("company_id").agg(F.max("seq").alias("_last"))
    later = incoming.join(last, "company_id", "left").withColumn("seq", F.coalesce(F.col("_last"), F.lit(0)) + F.col("seq")).drop("_last")
    return existing.unionByName(later)


def reconcile(facts: DataFrame, fields: list[str]) -> DataFrame:
    """Deduplicated, resolved and pivoted, with the number of facts and conflicts per company."""
    clean = dedupe_facts(facts)
    wide = pivot_resolved(clean, fields)
    n = clean.groupBy("company_id").agg(F.count("*").alias("n_facts"))
    c = conflicts(clean).groupBy("company_id").agg(F.count("*").alias("n_conflicts"))
    return n.join(c, "company_id", "left").join(wide, "company_id", "left").withColumn("n_conflicts", F.coalesce("n_conflicts", F.lit(0)))


def coverage(facts: DataFrame, fields: DataFrame) -> DataFrame:
    """(company_id, field, coverage, n_sources) for every company and listed field."""
    real = F.col("status") == "fact"
    key = value_key(F.col("value_num"), F.col("value_str"))
    grouped = facts.groupBy("company_id", "field").agg(
        F.count(F.when(real, 1)).alias("n_fact"), F.count_distinct(F.when(real, key)).alias("n_values"), F.count(F.when(F.col("status") == "projection", 1)).alias("n_proj"),
        F.count(F.when(F.col("status") == "derived", 1)).alias("n_derived"), F.count("*").alias("n"), F.count_distinct("source_name").alias("n_sources"),
    )
    every = facts.select("company_id").distinct().crossJoin(F.broadcast(fields))  # the field list is a constant of this module's callers
    out = every.join(grouped, ["company_id", "field"], "left")
    state = (
        F.when((F.col("n_fact") >= 2) & (F.col("n_values") > 1) & ~F.col("field").isin(*NO_CONFLICT), "CONFLICT").when(F.col("n_fact") > 0, "POPULATED").when((F.col("n_proj") > 0) & (F.col("n_proj") == F.col("n")), "PROJECTED_ONLY")
        .when((F.col("n_derived") > 0) & (F.col("n_derived") == F.col("n")), "DERIVED_ONLY").when(F.col("n") > 0, "UNSUPPORTED").otherwise("MISSING")
    )
    return out.select("company_id", "field", state.alias("coverage"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("decimal(28,10)"), F.nullif(b.cast("decimal(20,4)"), F.lit(0).cast("decimal(20,4)"))).cast("decimal(28,10)")


def financial_metrics(df: DataFrame) -> DataFrame:
    """Seven ratios beside the columns of df; zero or unknown denominators give null, a zero valuation is passed over."""
    nz = lambda c: F.nullif(F.col(c).cast("decimal(20,4)"), F.lit(0).cast("decimal(20,4)"))
    valuation = F.coalesce(nz("post_money"), nz("pre_money"), nz("valuation_cap"))
    multiple = ratio(valuation, F.col("revenue"))
    hundred = F.lit(100).cast("decimal(20,4)")
    return df.withColumns({
        "revenue_multiple": multiple, "ebitda_multiple": ratio(valuation, F.col("ebitda")), "ltv_cac": ratio(F.col("ltv"), F.col("cac")),
        "gross_margin": F.coalesce(F.col("gross_margin_given").cast("decimal(28,10)"), (ratio(F.col("gross_profit"), F.col("revenue")) * hundred).cast("decimal(28,10)")),
        "ebitda_margin": F.coalesce(F.col("ebitda_margin_given").cast("decimal(28,10)"), (ratio(F.col("ebitda"), F.col("revenue")) * hundred).cast("decimal(28,10)")),
        "runway": F.coalesce(F.col("runway_given").cast("decimal(28,10)"), ratio(F.col("cash"), F.col("burn_rate"))), "valuation_to_growth": ratio(multiple, F.col("growth")),
    })


def run_metrics(runs: DataFrame) -> DataFrame:
    """Per mode: runs, tokens, seconds, tokens a second (0 without time), and the least token budget that was not cut off."""
    g = runs.groupBy("mode").agg(F.count("*").alias("n_runs"), F.sum("completion_tokens").alias("tokens"), F.sum("seconds").alias("seconds"), F.min(F.when(F.col("finish_reason") != "length", F.col("max_tokens"))).alias("enough_tokens"))
    return g.withColumn("tokens_per_second", F.when(F.col("seconds") > 0, F.col("tokens") / F.col("seconds")).otherwise(0.0))
