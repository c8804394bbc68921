"""Extractors and embedding functions that a caller adds."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Extractors:
    """Named extractors in the order they were added; adding a name again changes nothing."""

    def __init__(self) -> None:
        self._found: dict[str, tuple[Callable[[DataFrame], Column], Column | None]] = {}
        self._shown: dict[str, Callable[[str], Iterable[tuple[str, int, int]]]] = {}

    def add(self, name: str, extract: Callable[[DataFrame], Column], supports: Column | None = None) -> None:
        self._found.setdefault(name, (extract, supports))

    def add_evidence(self, name: str, find: Callable[[str], Iterable[tuple[str, int, int]]]) -> None:
        """find(text) gives (field, start, end) of what shows the extractor's result; an extractor without it has no evidence."""
        if name not in self._found:
            raise KeyError(name)
        self._shown.setdefault(name, find)

    def names(self) -> list[str]:
        return list(self._found)

    def evidence(self, docs: DataFrame) -> DataFrame:
        """(doc_id, extractor, field_name, start_offset, end_offset, text): the evidence of every extractor that
        supports a row, by a table function that is joined to each document (doc_id, text)."""
        out = None
        for name, find in self._shown.items():
            supports = self._found[name][1]
            rows = docs if supports is None else docs.where(supports)
            found = rows.select("doc_id", "text").lateralJoin(_evidence_function(find)(F.col("text").outer()))
            found = found.select("doc_id", F.lit(name).alias("extractor"), "field_name", "start_offset", "end_offset", "shown").withColumnRenamed("shown", "text")
            out = found if out is None else out.unionByName(found)
        if out is None:
            raise ValueError("no extractor has evidence")
        return out

    def apply(self, docs: DataFrame) -> DataFrame:
        """docs with a struct column extras, a field for each extractor, null where it does not support the row."""
        fields = [(f(docs) if s is None else F.when(s, f(docs))).alias(n) for n, (f, s) in self._found.items()]
        return docs.withColumn("extras", F.struct(*fields)) if fields else docs


def _evidence_function(find: Callable[[str], Iterable[tuple[str, int, int]]]):
    class Evidence:
        def eval(self, text: str):
            for field, start, end in find(text) if text is not None else ():
                yield field, start, end, text[start:end]

    return F.udtf(Evidence, returnType="field_name string, start_offset int, end_offset int, shown string")


class Steps:
    """Named chunkers or retrievers, each a function of a DataFrame; filters that a step does not support are an error when the plan is made."""

    def __init__(self) -> None:
        self._found: dict[str, tuple[Callable[..., DataFrame], frozenset[str]]] = {}

    def add(self, name: str, step: Callable[..., DataFrame], filters: tuple[str, ...] = ()) -> None:
        self._found.setdefault(name, (step, frozenset(filters)))

    def run(self, name: str, df: DataFrame, **filters: object) -> DataFrame:
        step, known = self._found[name]
        if unknown := filters.keys() - known:
            raise ValueError(f"{name} has no filters {sorted(unknown)}")
        return df.transform(step, **filters)


def embed(df: DataFrame, text: str, function: Callable[[list[str]], list[list[float]]], batch: int = 256) -> DataFrame:
    """df with a column embedding from a function of texts, called on batches inside the tasks."""
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for k in range(0, len(p), batch):
                part = p.iloc[k : k + batch].copy()
                part["embedding"] = function(part[text].tolist())
                yield part

    return df.mapInPandas(run, schema)
