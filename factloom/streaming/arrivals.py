"""Streams of arriving documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_by_hash(stream: DataFrame, content: str, at: str, delay: str = "1 hour") -> DataFrame:
    """The first document of each content hash within the watermark."""
    return stream.withColumn("hash", F.sha2(F.col(content), 256)).withWatermark(at, delay).dropDuplicatesWithinWatermark(["hash"])
