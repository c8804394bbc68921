"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for Java's and Python's regular expressions: anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a new local one where it is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(spark, "_factloom_dir", None)
        if found is None:
            found = f"file://{tempfile.mkdtemp(prefix='factloom-')}"
            spark._factloom_dir = found
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone already
            return


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/factloom-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``staged`` wrote, once nothing reads them any more."""
    for df in tables:
        path = df._factloom_path
        _remove(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that are done: it does so when the driver's objects are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Cuts the lineage in a way that outlives any executor, and gives the
    planner the true size of what follows.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._factloom_path = path
    return out


def slices(batch: pa.RecordBatch, column: int, chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of text in one column, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + chars, "right")))
        yield batch.slice(at, to - at)
        at = to


_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hash_spans(data: bytes, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of data, which are read side by side, eight bytes at a time."""
    u = np.uint64
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    h = length.astype(u) * u(0x9E3779B97F4A7C15)
    of, k = slice(None), 0
    while True:
        at, left = begin[of], length[of] - k
        x = (h[of] ^ (eight[at + k] & _BYTES[np.minimum(left, 8)])) * u(0xBF58476D1CE4E5B9)
        h[of] = x ^ (x >> u(31))
        k += 8
        of = np.flatnonzero((length > k) & (length <= 64)) if k == 8 else of[length[of] > k]
        if not len(of):
            break
    for i in np.flatnonzero(length > 64).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[begin[i] : begin[i] + length[i]])
    h = (h ^ (h >> u(30))) * u(0x94D049BB133111EB)
    return h ^ (h >> u(31))


def keep_rows(df: DataFrame, column: str, keeps: Callable[[list[str | None]], np.ndarray]) -> DataFrame:
    """The rows of df whose value of column passes; keeps(values) gives a mask. All columns pass through, whatever their names."""
    place = df.columns.index(column)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                yield b.filter(pa.array(keeps(b.column(place).to_pylist()), pa.bool_()))

    return df.mapInArrow(kept, df.schema)


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes; bytes.split() splits at exactly the six bytes that WORD excludes."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
