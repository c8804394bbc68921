"""MinHash near-duplicates: banded minima find pairs, signatures and full sets confirm them, stars join them.

A document's set is its distinct five-word shingles (A-Z lower-cased, words
split at ASCII white space).  Documents of equal sets form a class.  Each class
has a signature of minima of universal hashes (a*x+b mod 2^32, a odd); a band
of six equal minima makes classes candidates.  A bucket of a band is never
expanded into all its pairs: its classes are compared with one pivot, links
are joined to components, and only classes of different components that still
share a bucket are compared in the next round, until none are left unseen.

At a similarity of exactly 0.75 a pair shares none of the 50 bands with
probability 6e-5, at 0.8 with 3e-7.  Sets hold 64-bit hashes of shingles and
classes 64-bit hashes of sets, so unlike ones are taken as alike with
probability 2^-64 a pair.

Defined cases: a null, empty or blank text has the empty set and is linked
with nothing; fewer words than a shingle make one shingle of the whole
sequence; equal rows (also of one id) are one class; a null id takes part like
any other row, and its own component is null unless its class has an id; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from factloom.llm.common import drop, slices, staged, tidy
from factloom.llm.components import connected_components

BANDS, ROWS = 50, 6
HASHES = BANDS * ROWS
_RNG = np.random.default_rng(20240607)
_A = (_RNG.integers(0, 1 << 31, HASHES, np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, HASHES, np.uint32)
_P = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(64)], np.uint64)


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    ws = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    width = min(width, len(ws))
    n = len(ws) - width + 1
    s = np.full(n, width, np.uint64)
    for k in range(width):
        s += h[k : k + n] * _P[k]
    s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def signature(hashes: np.ndarray) -> np.ndarray:
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 256):
        np.minimum(least, (x[k : k + 256, None] * _A + _B).min(axis=0), out=least)
    return least


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class, signature); the last two are null for the empty set."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                n, cls, sigs = [], [], []
                for t in b.column(1):
                    s = shingle_hashes(t.as_py())
                    n.append(len(s))
                    cls.append(_class(s) if len(s) else None)
                    sigs.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "class", "signature"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(sign, f"doc_id {kind}, n_shingles long, class long, signature binary")


def shared_buckets(signed: DataFrame) -> DataFrame:
    """(bucket, class) of the band buckets that hold more than one class."""
    band = lambda k: F.xxhash64(k, F.substring("signature", k * (4 * ROWS) + 1, F.lit(4 * ROWS)))
    bands = signed.where("class is not null").select("class", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("bucket"))
    more = bands.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    return bands.join(more.select("bucket"), "bucket").select("bucket", "class").distinct()


def _agreeing(pairs: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree in so many minima at least."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint32).reshape(-1, HASHES) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(m := pa.array((x == y).sum(axis=1) >= least)), b.column(1).filter(m)], names=["a", "b"])

    side = lambda k: sigs.select(F.col("class").alias(k), F.col("signature").alias(f"s{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(agree, "a long, b long")


def _class(hashes: np.ndarray) -> int:
    return int(xxhash.xxh3_64_intdigest(hashes.tobytes())) - (1 << 63)


def _with_class(df: DataFrame, text: str, name: str) -> DataFrame:
    """df and the class of each row's text, null for the empty set."""
    place = df.columns.index(text)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                found = pa.array([_class(s) if len(s := shingle_hashes(t.as_py())) else None for t in b.column(place)], pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, name])

    return df.mapInArrow(classes, StructType([*df.schema.fields, StructField(name, LongType())]))


def _of_class(texts: DataFrame) -> DataFrame:
    """The rows (class, text) whose text is of the class; rows that share an id need not be."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                yield b.filter(pa.array([len(s := shingle_hashes(t.as_py())) > 0 and _class(s) == c for c, t in zip(b.column(0).to_pylist(), b.column(1))], pa.bool_()))

    return texts.mapInArrow(check, "class long, text string")


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """(class, shingles) of texts (class, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_hashes(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], names=["class", "shingles"])

    return texts.mapInArrow(sets, "class long, shingles binary")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            m = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(m), b.column(1).filter(m)], names=["a", "b"])

    side = lambda k: sets.select(F.col("class").alias(k), F.col("shingles").alias(f"s{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(confirm, "a long, b long")


def _bucket_pairs(members: DataFrame, sets: DataFrame, least: int, percent: int, large: int, block: int) -> DataFrame:
    """Pairs that join different components in the buckets of members (bucket, class, component, n).

    Buckets of up to ``large`` classes are compared whole, many to a task; of a
    larger one a member goes to every pair of blocks that its own block is in,
    so a task holds two blocks whatever the bucket's size.  Pairs whose
    signatures agree are measured on their full sets; a pair leaves its task if
    it passes and joins components that no pair before it in the task has joined.
    """
    bundles = max(1, members.count() // 4000)
    blocks = F.when(F.col("n") > large, F.ceil(F.col("n") / block)).otherwise(1)
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    task = F.when(F.col("n") > large, F.xxhash64("bucket", "i", "j")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(bundles)))
    dealt = dealt.select(task.alias("task"), "bucket", "class", "component", "own", "i", "j").join(sets, "class")

    def compare(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("bucket")
        bucket, own, comp, cls, i, j = (t.column(c).to_numpy() for c in ("bucket", "own", "component", "class", "i", "j"))
        s = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        over: dict[int, int] = {}  # components joined so far, as a forest

        def top(c: int) -> int:
            while c in over:
                c = over[c]
            return c

        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        found = set()
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            right = np.flatnonzero(own[lo:hi] == j[lo]) + lo
            for x in np.flatnonzero(own[lo:hi] == i[lo]) + lo:
                y = right[comp[right] > comp[x]] if i[lo] == j[lo] else right[comp[right] != comp[x]]
                for k in y[(s[y] == s[x]).sum(axis=1) >= least].tolist():
                    one, two = top(int(comp[x])), top(int(comp[k]))
                    if one == two:
                        continue
                    u, v = sets[x], sets[k]
                    both = int(np.count_nonzero(v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u))
                    if 100 * both >= percent * (len(u) + len(v) - both):
                        over[two] = one
                        found.add((min(cls[x], cls[k]), max(cls[x], cls[k])))
        return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    return dealt.groupBy("task").applyInArrow(compare, "a long, b long").distinct()


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75, large: int = 64, block: int = 512) -> tuple[DataFrame, DataFrame]:
    """(signed, groups): (doc_id, n_shingles, class) of each document, and (node, component) for the linked classes.

    First each class of a bucket meets two pivots: the bucket's smallest set
    (where a passage common to all makes the bucket, no other is more alike to
    each) and the class that shares the most buckets (of copies with changes,
    most often what they were copied from).  Then classes that are still in
    different components meet within their buckets.
    """
    least = int(HASHES * (percent / 100 - 0.13))
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    whole = staged(signatures(own), "signatures")
    members = staged(shared_buckets(whole), "buckets")
    degree = members.groupBy("class").agg(F.count("*").alias("degree"))
    sigs = staged(whole.join(degree, "class").groupBy("class", "degree").agg(F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"), F.min("doc_id").alias("doc_id")), "candidates")
    signed = staged(whole.drop("signature"), "classes")
    drop(whole)
    del whole, degree
    tidy(spark)
    sized = members.join(sigs.select("class", "n_shingles", "degree"), "class")
    pivots = sized.groupBy("bucket").agg(F.min(F.struct("n_shingles", "class")).getField("class").alias("least"), F.max(F.struct("degree", "class")).getField("class").alias("most"))
    met = members.join(pivots, "bucket").select("class", F.explode(F.array_distinct(F.array("least", "most"))).alias("pivot")).where("class != pivot")
    stars = met.select(F.least("class", "pivot").alias("a"), F.greatest("class", "pivot").alias("b")).distinct()
    pairs = staged(_agreeing(stars, sigs, least), "pairs")
    del sized, pivots, met, stars
    tidy(spark)
    named = sigs.where("doc_id is not null").select("class", F.col("doc_id").alias("of"))
    nameless = sigs.where("doc_id is null").select("class")  # classes of rows without an id alone
    texts = _of_class(own.join(named, F.col("doc_id") == F.col("of")).select("class", "text"))
    if not nameless.isEmpty():
        texts = texts.union(_with_class(own.where("doc_id is null").select("text"), "text", "class").join(nameless, "class", "left_semi").select("class", "text").dropDuplicates(["class"]))
    texts = staged(texts, "candidate-texts")
    if texts.count() > sigs.count():  # rows of one id stand for their class more than once
        twice, texts = texts, staged(texts.dropDuplicates(["class"]), "candidate-texts")
        drop(twice)
    sets = lambda classes: _shingle_sets(texts.join(classes.distinct(), "class", "left_semi"))
    links = staged(_linked(pairs, sets(pairs.select(F.explode(F.array("a", "b")).alias("class"))), percent), "links")
    drop(pairs)
    tidy(spark)
    groups = connected_components(links.toDF("u", "v"))
    labelled = members.join(groups.withColumnRenamed("node", "class"), "class", "left").select("bucket", "class", F.coalesce("component", "class").alias("component"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    open_ = staged(labelled.join(mixed.select("bucket", "n"), "bucket"), "open")
    drop(members, groups)
    found = staged(_bucket_pairs(open_, sigs.select("class", "signature").join(sets(open_.select("class")), "class"), least, percent, large, block), "links")
    drop(open_, sigs, texts)
    tidy(spark)
    joined = connected_components(links.union(found).toDF("u", "v"))
    drop(links, found)
    return signed, joined


def _labelled(signed: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, class."""
    labelled = signed.join(groups.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = labelled.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    out = labelled.join(least, "component", "left").withColumn("component_id", F.coalesce("least", "doc_id"))
    kept = F.when(F.col("least").isNull() & F.col("component").isNotNull(), F.col("class") == F.col("component")).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "class")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least id reachable), kept (it is that id).

    Where no row of a component has an id, the rows of its least class are kept.
    """
    return _labelled(*near_duplicate_classes(docs, doc_id, text, percent)).drop("class")


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """The rows of docs whose id is the least of its component; rows equal in id and text count once.

    Rows that share an id, or have none, are told apart by class; of rows
    without an id one is kept for each component that has no id at all.
    """
    signed, groups = near_duplicate_classes(docs, doc_id, text, percent)
    found = staged(_labelled(signed, groups), "near-duplicates")
    drop(signed, groups)
    kept = found.where("kept").select("doc_id", "class")
    shared = found.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id")
    rows = docs.select(F.struct("*").alias("row"))  # so that no name of docs meets one of these
    own = F.col("row")[doc_id]
    if shared.isEmpty():
        return rows.join(kept, own == F.col("doc_id"), "left_semi").select("row.*")
    shared = staged(shared, "shared-ids")
    same = own.eqNullSafe(F.col("doc_id"))
    single = rows.join(shared, same, "left_anti").join(kept, own == F.col("doc_id"), "left_semi")
    more = _with_class(rows.join(shared, same, "left_semi").select("row", F.col("row")[text].cast("string").alias("text")), "text", "of")
    more = more.join(kept.distinct(), same & F.col("of").eqNullSafe(F.col("class")), "left_semi")
    once = F.when(own.isNull() & F.col("of").isNotNull(), F.col("of").cast("string")).otherwise(F.col("text"))
    more = more.select("row", own.alias("id"), "of", once.alias("once")).dropDuplicates(["id", "of", "once"])
    return single.select("row.*").union(more.select("row.*"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS k FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k : k + 4], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS d, doc_id AS o FROM documents UNION SELECT r.d, b.y FROM r JOIN b ON b.x = r.o),
m AS (SELECT d, min(o) AS component_id FROM r GROUP BY d)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN m ON m.d = doc_id
"""
