"""Batch forms of inserts, patches, deletes and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from factloom.sources.shared import shared_path, written


def insert_unique(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(inserted, rejected): trimmed keys that are new, the first of each; a null or empty key never clashes."""
    trimmed = incoming.withColumn(key, F.trim(key))
    own = F.nullif(F.col(key), F.lit(""))
    first = trimmed.where(own.isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
    have = existing.select(F.trim(key).alias(key)).distinct().withColumn("_known", F.lit(True))
    out = trimmed.join(first, key, "left").join(have, key, "left").withColumn("_ok", own.isNull() | (F.col("_known").isNull() & (F.col(order) == F.col("_first")))).drop("_first", "_known")
    return out.where("_ok").drop("_ok"), out.where("not _ok").drop("_ok")


def insert_documents(existing: DataFrame, incoming: DataFrame, parents: DataFrame) -> DataFrame:
    """incoming (id, startup_id, file_hash, ..) with outcome (created, no_startup, duplicate), status and version.

    The parent must exist and the hash be new; of incoming rows with one hash the
    first with a parent is created.  A null hash never clashes.
    """
    known = existing.select(F.col("file_hash").alias("_h")).where("_h is not null").distinct()
    homes = parents.select(F.col("id").alias("_p")).distinct()
    out = incoming.join(homes, F.col("startup_id") == F.col("_p"), "left").join(known, F.col("file_hash") == F.col("_h"), "left")
    first = out.where("_p is not null and file_hash is not null").groupBy(F.col("file_hash").alias("_k")).agg(F.min("id").alias("_first"))
    out = out.join(first, F.col("file_hash") == F.col("_k"), "left")
    fresh = F.col("file_hash").isNull() | (F.col("_h").isNull() & (F.col("id") == F.col("_first")))
    outcome = F.when(F.col("_p").isNull(), "no_startup").when(fresh, "created").otherwise("duplicate")
    out = out.withColumn("outcome", outcome).drop("_p", "_h", "_k", "_first")
    made = F.col("outcome") == "created"
    return out.withColumns({"status": F.when(made, "UPLOADED"), "version": F.when(made, 1)})


def patch(rows: DataFrame, patches: DataFrame, columns: list[str]) -> DataFrame:
    """rows (id, ...) with the columns that patches (id, column, value) name replaced; an explicit null is a change."""
    wide = patches.groupBy("id").agg(*(F.max(F.col("column") == c).alias(f"_has_{c}") for c in columns), *(F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"_new_{c}") for c in columns))
    out = rows.join(wide, "id", "left")
    return out.select(*(F.when(F.col(f"_has_{c}"), F.col(f"_new_{c}").cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))


def patch_unique(rows: DataFrame, patches: DataFrame, columns: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(rows after the patches, outcomes (id, outcome)): a patch that changes the key to one that a row has is left out whole.

    outcome is updated, clash or not_found.  Keys are held against the rows as
    they stood; of patches that ask for the same new key, the one with the
    least id is made.  A null or empty key never clashes, nor does the key that
    the row has already.
    """
    asked = patches.where((F.col("column") == key) & (F.col("value") != "")).groupBy("id").agg(F.max("value").alias("_want"))
    changed = asked.join(rows.select("id", F.col(key).alias("_now")), "id").where(~F.col("_want").eqNullSafe(F.col("_now"))).select("id", "_want")
    known = rows.select(F.col(key).alias("_want")).where("_want is not null").distinct().withColumn("_known", F.lit(True))
    first = changed.groupBy("_want").agg(F.min("id").alias("_first"))
    clash = changed.join(first, "_want").join(known, "_want", "left").where((F.col("id") != F.col("_first")) | F.col("_known")).select("id", F.lit(True).alias("_clash"))
    there = rows.select("id", F.lit(True).alias("_there"))
    outcome = F.when(F.col("_there").isNull(), "not_found").when(F.col("_clash"), "clash").otherwise("updated")
    outcomes = patches.select("id").distinct().join(there, "id", "left").join(clash, "id", "left").select("id", outcome.alias("outcome"))
    made = patches.join(outcomes.where("outcome = 'updated'"), "id", "left_semi")
    return patch(rows, made, columns), outcomes


def cascade(deleted: DataFrame, tree: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """What is left of each child table (rows, own key, parent key), parents first: rows whose parent goes, go too."""
    gone, left = deleted.select(F.col("id").alias("_gone")), []
    for rows, own, parent in tree:
        left.append(rows.join(gone, rows[parent] == F.col("_gone"), "left_anti"))
        gone = rows.join(gone, rows[parent] == F.col("_gone"), "left_semi").select(F.col(own).alias("_gone")) if own else gone
    return left


def cascade_closure(deleted: DataFrame, references: DataFrame) -> DataFrame:
    """(name, id): the deleted rows (name, id) of tables and all that goes with them, over references of any depth.

    references (name, id, parent_name, parent_id) has a row for each foreign
    key, also those of a table to itself; circles end.  Level by level: what the
    level before removed, written to the shared folder, meets only the
    references to tables of its names.  A small level is sent to the references
    (its size is known), so that they are not shuffled; a large one is joined.
    """
    spark, path, kind = deleted.sparkSession, shared_path(deleted.sparkSession, "gone"), deleted.select("name", "id").schema
    found, level, gone = deleted.select("name", "id").distinct(), 0, None
    while True:
        found.write.parquet(f"{path}/level={level}")
        parents = spark.read.schema(kind).parquet(f"{path}/level={level}").select(F.col("name").alias("parent_name"), F.col("id").alias("parent_id"))
        gone = spark.read.schema(kind).parquet(path).select("name", "id")
        names = [r.parent_name for r in parents.where("parent_name is not null").select("parent_name").distinct().collect()]
        if not names:
            return gone
        known = gone.toDF("_name", "_id")
        children = references.where(F.col("parent_name").isin(names)).join(parents, ["parent_name", "parent_id"], "left_semi").select("name", F.col("id").cast(kind["id"].dataType).alias("id")).distinct()
        found = children.join(known, F.col("name").eqNullSafe(F.col("_name")) & F.col("id").eqNullSafe(F.col("_id")), "left_anti")
        level += 1


# The least and greatest length of a document's and a company's texts, and the least of its numbers.
DOCUMENT_LENGTHS = {"title": (1, 255), "description": (0, 2000), "filename": (1, 255), "original_filename": (1, 255), "mime_type": (1, 100), "file_hash": (1, 128), "storage_path": (1, 1024)}
COMPANY_LENGTHS = {"name": (1, 255), "legal_name": (0, 255), "sector": (0, 100), "industry": (0, 100), "website": (0, 255), "headquarters": (0, 255)}
LEAST = {"file_size": 0, "version": 1}


def limits(columns: list[str], lengths: dict[str, tuple[int, int]]) -> dict[str, Column]:
    """The checks of the columns there are, by column."""
    checks = {c: F.char_length(c).between(*lengths[c]) for c in columns if c in lengths}
    return checks | {c: F.col(c) >= n for c, n in LEAST.items() if c in columns}


def accept_and_reject(rows: DataFrame, checks: dict[str, Column], name: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(accepted, rejected, counts): rows that pass all checks, the rest with their violations, and how many each check rejects.

    One pass: both sides are written to the shared folder, apart from each
    other, while the counts are observed.
    """
    seen = Observation(name)
    counted = [F.count_if(F.array_contains("violations", c)).alias(f"bad_{c}") for c in checks]
    judged = rows.withColumn("violations", violations(checks)).withColumn("accepted", F.size("violations") == 0)
    judged = judged.observe(seen, F.count("*").alias("rows"), F.count_if("accepted").alias("accepted"), *counted)
    both = written(judged, name, "accepted")
    told = {k.removeprefix("bad_"): v for k, v in seen.get.items()}
    return both.where("accepted").drop("accepted", "violations"), both.where("not accepted").drop("accepted"), told


def violations(checks: dict[str, Column]) -> Column:
    """Names of the checks that do not hold; a check that is null holds."""
    return F.array_compact(F.array(*(F.when(~c, F.lit(name)) for name, c in checks.items())))


def resolve_enum(value: Column, values: dict[str, str]) -> Column:
    """A member by its value, else by its name in upper case; null stays null, and anything else is an error."""
    by_name = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    known = F.when(value.isin(*values.values()), value).otherwise(F.element_at(by_name, F.upper(value)))
    return F.when(value.isNotNull(), F.coalesce(known, F.raise_error(F.concat(F.lit("not a member: "), value)).cast("string")))


def is_member(value: Column, values: dict[str, str]) -> Column:
    return value.isin(*values.values()) | F.upper(value).isin(*values)
