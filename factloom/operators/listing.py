"""Look-ups and ordered listings; predicates reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_key(rows: DataFrame, **equal: object) -> DataFrame:
    for c, v in equal.items():
        rows = rows.where(F.col(c) == v)
    return rows


def listed(rows: DataFrame, *order: Column | str, where: Column | None = None) -> DataFrame:
    return (rows if where is None else rows.where(where)).orderBy(*order)


def keyword(term: str, *columns: str) -> Column:
    """Case-insensitive substring of any of the columns; % and _ of the term act as wildcards."""
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).ilike(f"%{term}%")
    return out


def exists(rows: DataFrame, where: Column) -> bool:
    return not rows.where(where).isEmpty()


def exists_by_key(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """wanted with found: whether any row has its key; a null key is never found."""
    have = rows.select(F.col(key).alias("_have")).where("_have is not null").distinct()
    return wanted.join(have, wanted[key] == F.col("_have"), "left").withColumn("found", F.col("_have").isNotNull()).drop("_have")


def documents(rows: DataFrame, startup_id: object = None, search: str | None = None, document_type: str | None = None, status: str | None = None) -> DataFrame:
    """The document listing that the given filters ask for: of a type or status, then of a startup, else by title, else all; newest first but for titles."""
    for c, v in (("document_type", document_type), ("status", status)):
        if v is not None:
            rows = rows.where(F.col(c) == v)
    if startup_id is not None:
        return listed(rows, F.desc("created_at"), where=F.col("startup_id") == startup_id)
    if search:
        return listed(rows, "title", where=keyword(search, "title"))
    return listed(rows, F.desc("created_at"))


def users(rows: DataFrame, active: bool = False, superusers: bool = False, search: str | None = None, email: str | None = None) -> DataFrame:
    """Users by name: active ones, superusers, those whose e-mail or name has the term, or the one of an e-mail in lower case."""
    if active:
        rows = rows.where("is_active")
    if superusers:
        rows = rows.where("is_superuser")
    if search:
        rows = rows.where(keyword(search, "email", "full_name"))
    if email is not None:
        rows = rows.where(F.lower("email") == email.lower())
    return listed(rows, "full_name")


def founder_projection(rows: DataFrame) -> DataFrame:
    """(founder_id, name, role, background, relevant_experience, analysis_notes): no contact data."""
    years = F.when(F.col("experience_years").isNotNull(), F.concat(F.col("experience_years").cast("string"), F.lit(" years experience")))
    before = F.when(F.col("previous_companies") != "", F.concat(F.lit("Previous companies: "), F.col("previous_companies")))
    return rows.select(F.col("id").alias("founder_id"), F.col("full_name").alias("name"), F.col("designation").alias("role"), F.col("education").alias("background"), F.nullif(F.concat_ws("; ", years, before), F.lit("")).alias("relevant_experience"), F.col("notes").alias("analysis_notes"))


# What an analysis is told of a company.
COMPANY = ("name", "description", "industry", "sector", "stage", "founded_year", "headquarters")


def company_projection(rows: DataFrame) -> DataFrame:
    """(id, seven fields): a company as the input of an analysis has it."""
    return rows.select("id", *COMPANY)
