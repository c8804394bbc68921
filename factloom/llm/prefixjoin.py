"""N-gram Jaccard join by grouped prefixes: documents of one prefix and size are one group until they are verified.

A document's set is its distinct three-word shingles (A-Z lower-cased, words
split at ASCII white space), as 64-bit hashes.  Documents of equal sets form a
class.  All shingles stand in one order, the rarest first, and a class's
prefix is its first n - ceil(0.9 n) + 1 shingles: two sets of a Jaccard
similarity of 0.9 share one of their prefixes.  The order is taken from counts
over all documents, kept in a table of a fixed number of cells by hash: its
size does not grow, and what is off in a cell is about the root of what other
shingles add, so at any size a shingle far more frequent than that comes late.
The order decides on cost alone; any order gives the same links.

1. Classes of one prefix and size are one group; groups meet by the shingles
   of their prefixes.  Shingles that the same groups share are one bucket,
   and a bucket is cut where its sizes leave a gap too wide for a link.
2. Each group meets two pivots of each of its buckets, and each class the first
   of its group, where size and places in the prefixes leave 0.9 possible.
   Pairs are filtered by parity bitmaps (bit h of a set is the parity of its
   shingles of hash h; two bitmaps differ in no more bits than the sets in
   shingles, so a pair with too many is surely unlike); what passes is verified
   on full sets and joined to components.
3. Buckets that still hold several components are expanded to their classes,
   and those of different components are compared by bitmap.  What passes is
   verified in a forest per bucket; a bucket in which some pair of the forest
   failed gives all its open pairs in a last round.

No link is lost, copies are never expanded, and no bucket is held by one task:
large ones are compared in pairs of blocks.  The last two rounds are quadratic
in the classes of a bucket that no verified link joins.

Defined cases: a null, empty or blank text has the empty set and is linked
with nothing; fewer words than a shingle make one shingle of the whole
sequence; equal rows (also of one id) are one class; a null id takes part like
any other row, and its own component is null unless its class has an id; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import drop, slices, staged, tidy
from factloom.llm.components import connected_components
from factloom.llm.minhash import shingle_hashes
from factloom.operators.bloom import key_filter, maybe_known

#: Cells of the table of counts, and of one piece of it: 4 MB in all, whatever the corpus.
CELLS, PIECE = 1 << 20, 1 << 10
_SHIFT = np.uint64(64 - 20)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _signed(h: int) -> int:
    return h - (1 << 63)


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, print, n, class, piece, counts) of docs (doc_id, print, text); each task ends with its counts of shingles by cell."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        ids = None
        for whole in batches:
            ids = whole.column(0).type
            for b in slices(whole, 2):
                n, cls, seen = [], [], []
                for t in b.column(2):
                    s = shingle_hashes(t.as_py(), width)
                    n.append(len(s))
                    cls.append(_signed(xxhash.xxh3_64_intdigest(s.tobytes())) if len(s) else None)
                    seen.append(s)
                np.add.at(cells, (np.concatenate(seen) >> _SHIFT).astype(np.int64), 1)
                empty = pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), *empty], names=["doc_id", "print", "n", "class", "piece", "counts"])
        if ids is not None:
            parts = np.minimum(cells, 0xFFFF).astype(np.uint16).reshape(-1, PIECE)
            some = np.flatnonzero(parts.any(axis=1))
            for at in range(0, len(some), 256):
                k = some[at : at + 256]
                none = [pa.nulls(len(k), x) for x in (ids, pa.int64(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*none, pa.array(k, pa.int64()), pa.array([parts[x].tobytes() for x in k], pa.binary())], names=["doc_id", "print", "n", "class", "piece", "counts"])

    return docs.mapInArrow(profile, f"doc_id {kind}, print long, n long, class long, piece long, counts binary")


def shingle_counts(profiled: DataFrame) -> np.ndarray:
    """The counts of all tasks, summed by piece: CELLS numbers, whatever the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, np.uint16).astype(np.uint64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["piece", "counts"])

    pieces = profiled.where("piece is not null").select("piece", "counts").repartition("piece").mapInArrow(add, "piece long, counts binary")
    out = np.zeros((CELLS // PIECE, PIECE), np.uint64)
    for r in pieces.toLocalIterator():
        out[r.piece] = np.frombuffer(bytes(r.counts), np.uint64)
    return np.minimum(out.reshape(-1), 0xFFFFFFFF).astype(np.uint32)


def prefixes(docs: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """(class, group, n, prefix, level, bits) of docs (text), rarest shingles first; a task gives each class once."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, seen = shared.value, set()
        for whole in batches:
            for b in slices(whole, 0):
                rows = []
                for t in b.column(0):
                    s = shingle_hashes(t.as_py(), width)
                    if not len(s) or (cls := _signed(xxhash.xxh3_64_intdigest(s.tobytes()))) in seen:
                        continue
                    seen.add(cls)
                    first = s[np.lexsort((s, rare[(s >> _SHIFT).astype(np.int64)]))[: prefix_length(len(s), percent)]]
                    level = max(8, int(len(s) - 1).bit_length())
                    rows.append((cls, _signed(xxhash.xxh3_64_intdigest(first.tobytes(), len(s))), len(s), first.view(np.int64), level, parity_bits(s, level)))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["class", "group", "n", "prefix", "level", "bits"])

    return docs.mapInArrow(prefix, "class long, group long, n long, prefix array<long>, level int, bits binary")


def parity_bits(s: np.ndarray, level: int) -> bytes:
    """The parities of the shingles by hash, as 2^level bits."""
    return np.packbits(np.bincount((s & np.uint64((1 << level) - 1)).astype(np.int64), minlength=1 << level).astype(np.uint8) & 1).tobytes()


def halved(bits: bytes) -> bytes:
    """Parity bits of one level less."""
    both = np.frombuffer(bits, np.uint8).reshape(2, -1)
    return (both[0] ^ both[1]).tobytes()


def most_apart(n: np.ndarray | int, m: np.ndarray | int, percent: int):
    """The most shingles that sets of n and m have apart with 100 * intersection >= percent * union."""
    return (100 - percent) * (n + m) // (100 + percent)


def shared_buckets(groups: DataFrame) -> DataFrame:
    """(bucket, group, n, place, classes) of prefix shingles that several groups share; shingles of the same groups are one bucket."""
    posted = groups.select(F.posexplode("prefix").alias("place", "bucket"), "group", "n", "classes")
    mark = F.bit_xor(F.xxhash64("group")).alias("mark")
    held = posted.groupBy("bucket").agg(F.count("*").alias("groups"), F.sum("classes").alias("classes"), mark)
    kept = staged(held.where("classes > 1").groupBy("groups", "mark").agg(F.min("bucket").alias("bucket")).select("bucket"), "kept")
    tidy(groups.sparkSession)
    wanted, bits = key_filter(kept, "bucket")
    near = posted.where(maybe_known(F.col("bucket"), wanted.scalar(), bits))  # most shingles of a prefix are no other's
    members = staged(near.join(kept.hint("merge"), "bucket").select("bucket", "group", "n", "place", "classes"), "buckets")
    drop(kept)
    return members


def chained_buckets(members: DataFrame, percent: int) -> DataFrame:
    """The members (bucket, group, n, place) with each bucket cut where sizes are too far apart; parts of the same groups are one bucket.

    Sizes fall in bands, four to the ratio that the share allows; sets whose
    bands are six apart are surely unlike, so a bucket is cut at every gap of
    six bands, and nothing on one side of it links with the other.
    """
    banded = members.withColumn("band", F.floor(F.log("n") * (4 / math.log(100 / percent))) if percent < 100 else F.col("n") * 6)
    bands = banded.groupBy("bucket").agg(F.array_sort(F.collect_set("band")).alias("bands"))
    cuts = F.filter("bands", lambda x, k: (k > 0) & (x - F.get("bands", F.greatest(k - 1, F.lit(0))) > 5))
    cut = bands.select("bucket", cuts.alias("cuts"))
    chain = F.size(F.filter("cuts", lambda x: x <= F.col("band")))
    parts = banded.join(cut, "bucket").select(F.when(F.size("cuts") == 0, F.col("bucket")).otherwise(F.xxhash64("bucket", chain)).alias("bucket"), "group", "n", "place", "classes")
    mark = F.bit_xor(F.xxhash64("group")).alias("mark")
    held = parts.groupBy("bucket").agg(F.count("*").alias("groups"), F.sum("classes").alias("classes"), mark).where("classes > 1")
    kept = held.groupBy("groups", "mark").agg(F.min("bucket").alias("bucket")).select("bucket")
    out = staged(parts.join(kept, "bucket").select("bucket", "group", "n", "place"), "chained")
    drop(members)
    tidy(members.sparkSession)
    return out


def _possible(n: str, m: str, p: str, q: str, percent: int) -> F.Column:
    """Whether sets of n and m whose prefixes hold one shingle at places p and q can be as alike."""
    most = F.least(p, q) + 1 + F.least(F.col(n) - F.col(p), F.col(m) - F.col(q)) - 1
    return 100 * most >= percent * (F.col(n) + F.col(m) - most)


def star_pairs(members: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): first classes of groups that meet a pivot of a bucket, and classes that meet the first of their group."""
    degree = members.groupBy("group").agg(F.count("*").alias("degree"))
    known = members.join(degree, "group")
    known = known.withColumn("row", F.struct("group", "n", "place"))
    pivots = known.groupBy("bucket").agg(F.max(F.struct("degree", "row")).getField("row").alias("most"), F.min(F.struct("n", "row")).getField("row").alias("least"))
    met = members.join(pivots, "bucket").select("group", "n", "place", F.explode(F.array_distinct(F.array("most", "least"))).alias("pivot"))
    met = met.select("group", "n", "place", F.col("pivot.group").alias("other"), F.col("pivot.n").alias("m"), F.col("pivot.place").alias("q"))
    met = met.where(F.col("group") != F.col("other")).where(_possible("n", "m", "place", "q", percent))
    met = met.select(F.least("group", "other").alias("x"), F.greatest("group", "other").alias("y")).distinct()
    first = lambda k: groups.select(F.col("group").alias(k), F.col("first").alias(f"f{k}"))
    return met.join(first("x"), "x").join(first("y"), "y").select(F.least("fx", "fy").alias("a"), F.greatest("fx", "fy").alias("b"))


def possible_pairs(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the bitmaps (class, n, bits) leave possible."""

    def pass_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for n, m, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist()):
                if 100 * min(n, m) < percent * max(n, m):
                    ok.append(False)
                    continue
                if len(x) != len(y):
                    x, y = (halved(x), y) if len(x) > len(y) else (x, halved(y))
                ok.append((int.from_bytes(x) ^ int.from_bytes(y)).bit_count() <= most_apart(n, m, percent))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda k: bitmaps.select(F.col("class").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"s{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(pass_, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) and whether the full sets of their texts (class, text) have 100 * intersection >= percent * union."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, np.ndarray] = {}  # a few sets, as pivots come again and again

        def of(cls: int, text: pa.Scalar) -> np.ndarray:
            if (found := last.pop(cls, None)) is None:
                found = shingle_hashes(text.as_py(), width)
                if len(last) > 15:
                    last.pop(next(iter(last)))
            last[cls] = found
            return found

        for b in batches:
            ok = []
            for c, d, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                x, y = of(c, x), of(d, y)
                both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    side = lambda k: texts.select(F.col("class").alias(k), F.col("text").alias(f"s{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(confirm, "a long, b long, linked boolean")


def open_members(members: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(bucket, class, n, component) of buckets with several components, expanded to classes; groups is (node, component)."""
    labelled = classes.select("class", "group").join(groups.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    whole = members.join(labelled, "group").select("bucket", "class", "n", "component")
    mixed = whole.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("classes")).where("lo < hi and classes > 2")
    return whole.join(mixed.select("bucket"), "bucket")


def passing_pairs(opened: DataFrame, bitmaps: DataFrame, percent: int, forest: bool, large: int, block: int) -> DataFrame:
    """(bucket, a, b) of different components whose bitmaps leave them possible: a forest of them in each bucket, or all.

    A bucket of up to ``large`` classes a level is compared whole, many to a
    task; of a larger one a member goes to every pair of blocks that its own
    block is in, so a task holds two blocks whatever the bucket's size.
    """
    whole = opened.join(bitmaps.select("class", "level"), "class")
    rows = whole.withColumn("own", F.lit(True)).union(whole.withColumn("level", F.col("level") - 1).withColumn("own", F.lit(False)))
    sized = rows.groupBy("bucket", "level").agg(F.count("*").alias("held"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("own").alias("any")).where("lo < hi and any")
    dealt = rows.join(sized.select("bucket", "level", "held"), ["bucket", "level"])
    parts = F.when(F.col("held") > large, F.ceil(F.col("held") / block)).otherwise(1)
    dealt = dealt.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    bundles = max(1, sized.agg(F.sum("held")).first()[0] or 0) // 4000 + 1
    i, j = F.least("part", "other"), F.greatest("part", "other")
    task = F.when(F.col("parts") > 1, F.xxhash64("bucket", "level", i, j)).otherwise(F.pmod(F.xxhash64("bucket", "level"), F.lit(bundles)))
    dealt = dealt.select(task.alias("task"), "bucket", "level", "class", "n", "component", "own", "part", i.alias("i"), j.alias("j")).join(bitmaps.select("class", "bits"), "class")

    def compare(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by([("bucket", "ascending"), ("level", "ascending"), ("class", "ascending")])
        bucket, level, cls, n, comp, own, part, i, j = (t.column(c).to_numpy() for c in ("bucket", "level", "class", "n", "component", "own", "part", "i", "j"))
        bits = [x if o else halved(x) for x, o in zip(t.column("bits").to_pylist(), own)]
        cuts = [0, *(np.flatnonzero((np.diff(bucket) != 0) | (np.diff(level) != 0)) + 1).tolist(), len(bucket)]
        found: list[tuple[int, int, int]] = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            over: dict[int, int] = {}  # components joined so far, as a forest

            def top(c: int) -> int:
                while c in over:
                    c = over[c]
                return c

            m = np.frombuffer(b"".join(bits[lo:hi]), np.uint64).reshape(hi - lo, -1)  # 128 bits at least
            at = np.arange(lo, hi)
            right = at[part[lo:hi] == j[lo]]
            for x in at[part[lo:hi] == i[lo]]:
                y = right[right > x] if i[lo] == j[lo] else right
                y = y[(comp[y] != comp[x]) & (own[y] | own[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
                if len(y):
                    apart = np.bitwise_count(m[y - lo] ^ m[x - lo]).sum(axis=1)
                    y = y[apart <= most_apart(n[y], n[x], percent)]
                for k in y.tolist():
                    if forest:
                        one, two = top(int(comp[x])), top(int(comp[k]))
                        if one == two:
                            continue
                        over[two] = one
                    found.append((int(bucket[x]), int(min(cls[x], cls[k])), int(max(cls[x], cls[k]))))
        return pa.table([pa.array([p[c] for p in found], pa.int64()) for c in range(3)], names=["bucket", "a", "b"])

    return dealt.groupBy("task").applyInArrow(compare, "bucket long, a long, b long").distinct()


def _texts(own: DataFrame, profiled: DataFrame, pairs: DataFrame) -> DataFrame:
    """(class, text) of the classes of the pairs, one text each; a filter of their prints keeps other texts out of the shuffle."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    named = profiled.where("class is not null").groupBy("class").agg(F.min(F.struct("doc_id", "print")).alias("of")).join(asked, "class")
    named = staged(named.select("class", F.col("of.doc_id").alias("of_id"), F.col("of.print").alias("of_print")), "named")
    held, bits = key_filter(named, "of_print")
    near = own.where(maybe_known(F.col("print"), held.scalar(), bits))
    texts = staged(near.join(named.hint("merge"), (F.col("print") == F.col("of_print")) & F.col("doc_id").eqNullSafe(F.col("of_id"))).select("class", "text"), "texts")
    if texts.count() > named.count():  # equal rows stand for their class more than once
        twice, texts = texts, staged(texts.dropDuplicates(["class"]), "texts")
        drop(twice)
    drop(named)
    tidy(own.sparkSession)
    return texts


def similar_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90, large: int = 64, block: int = 512) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, class) of each document, and (node, component) of the linked classes."""
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("print"), F.col(text).cast("string").alias("text"))
    profiled = staged(profiles(own, width), "profiles")
    counts = shingle_counts(profiled)
    signed = profiled.where("piece is null").select("doc_id", F.col("n").alias("n_shingles"), "class")
    once = [F.first(c).alias(c) for c in ("group", "n", "prefix", "level", "bits")]
    classes = staged(prefixes(own.select("text"), counts, width, percent).groupBy("class").agg(*once), "prefixes")
    tidy(spark)
    groups = classes.groupBy("group").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.count("*").alias("classes"))
    members = chained_buckets(shared_buckets(groups), percent)
    tidy(spark)
    firsts = classes.groupBy("group").agg(F.min("class").alias("first"))
    within = classes.select("class", "group").join(firsts, "group").where("class != first").select(F.least("class", "first").alias("a"), F.greatest("class", "first").alias("b"))
    met = staged(star_pairs(members, firsts, percent).union(within).distinct(), "met")
    tidy(spark)
    bitmaps = classes.select("class", "n", "level", "bits")
    pairs = staged(possible_pairs(met, bitmaps, percent), "pairs")
    drop(met)
    texts = _texts(own, profiled, pairs)
    links = staged(verified(pairs, texts, width, percent).where("linked").select("a", "b"), "links")
    drop(pairs, texts)
    tidy(spark)
    joined = connected_components(links.toDF("u", "v"))
    failed = None
    for forest in (True, False):
        opened = staged(open_members(members, classes, joined), "open")
        if failed is not None:
            before, opened = opened, staged(opened.join(failed, "bucket", "left_semi"), "open")
            drop(before, failed)
        tried = staged(passing_pairs(opened, bitmaps, percent, forest, large, block), "pairs")
        drop(opened)
        if tried.isEmpty():
            drop(tried)
            break
        pairs = tried.select("a", "b").distinct()
        texts = _texts(own, profiled, pairs)
        found = staged(verified(pairs, texts, width, percent), "found")
        failed = staged(tried.join(found.where("not linked"), ["a", "b"]).select("bucket").distinct(), "failed")
        more = staged(links.union(found.where("linked").select("a", "b")), "links")
        drop(links, tried, texts, found, joined)
        links = more
        tidy(spark)
        joined = connected_components(links.toDF("u", "v"))
        if failed.isEmpty():
            drop(failed)
            break
    drop(links, members, classes)
    tidy(spark)
    return signed, joined


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: doc_id, n_shingles (set size), component_id (the least id reachable by links)."""
    signed, groups = similar_classes(docs, doc_id, text, width, percent)
    labelled = signed.join(groups.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = labelled.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return labelled.join(least, "component", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS k FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k : k + 2], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS d, doc_id AS o FROM documents UNION SELECT r.d, b.y FROM r JOIN b ON b.x = r.o),
m AS (SELECT d, min(o) AS component_id FROM r GROUP BY d)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN m ON m.d = doc_id
"""
