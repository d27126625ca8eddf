"""Encoders and pair scorers are plug-ins: a function of a pandas series, run in Arrow batches, or an SQL expression.

Neural models are not part of this library. The defaults, a hashed bag of words and the share of query
terms covered, are plain stand-ins: they rank, but not as a trained model would.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as text_functions
from ..functions import vector
from .batches import Batches, Entry
from .scratch import written


class TextEncoder(Protocol):
    """Texts to vectors of one size."""

    name: str
    dim: int

    def column(self, text: Column) -> Column: ...

    def query(self, text: str) -> list[float]: ...


class HashedWords:
    """Counts of words by bucket of their MD5."""

    def __init__(self, dim: int = 32):
        self.name, self.dim = f"hashed-words-{dim}", dim

    def column(self, text: Column) -> Column:
        return vector.hashed_words(text_functions.tokens(text), self.dim)

    def query(self, text: str) -> list[float]:
        return vector.hashed_query(text, self.dim)


def unit_vector(v: list[float]) -> list[float] | None:
    """A vector of length 1; a zero vector has no direction."""
    size = sum(x * x for x in v) ** 0.5
    return [x / size for x in v] if size else None


class BatchEncoder:
    """A model: ``make()`` loads it once in each worker, and gives a function of a list of texts."""

    def __init__(self, name: str, dim: int, make: Callable[[], Callable[[list[str]], list[list[float]]]], batch_size: int = 32, normalize: bool = True):
        self.name, self.dim, self.make, self.batch_size, self.normalize = name, dim, make, batch_size, normalize

    def column(self, text: Column) -> Column:
        make, size, unit = self.make, self.batch_size, self.normalize

        @F.pandas_udf("array<double>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            run = make()
            for batch in batches:
                texts = batch.fillna("").tolist()
                made = [v for i in range(0, len(texts), size) for v in run(texts[i : i + size])]
                yield pd.Series([unit_vector(v) for v in made] if unit else made, dtype=object)

        return encode(text)

    def query(self, text: str) -> list[float]:
        v = list(self.make()([text])[0])
        return unit_vector(v) or v if self.normalize else v


class Coverage:
    """The default pair scorer."""

    name = "coverage"

    def column(self, query: str, passage: Column) -> Column:
        return text_functions.coverage(passage, query)

    def pairs(self, query: Column, passage: Column) -> Column:
        return text_functions.pair_coverage(passage, query)


class PairScorer(Protocol):
    """Scores of passages for a query, or for a query each; higher is better."""

    name: str

    def column(self, query: str, passage: Column) -> Column: ...

    def pairs(self, query: Column, passage: Column) -> Column: ...


class BatchScorer:
    """A model of pairs: ``make()`` gives a function of a query and a list of passages."""

    def __init__(self, name: str, make: Callable[[], Callable[[str, list[str]], list[float]]], batch_size: int = 16):
        self.name, self.make, self.batch_size = name, make, batch_size

    def column(self, query: str, passage: Column) -> Column:
        make, size = self.make, self.batch_size

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            run = make()
            for batch in batches:
                texts = batch.fillna("").tolist()
                yield pd.Series([float(s) for i in range(0, len(texts), size) for s in run(query, texts[i : i + size])], dtype="float64")

        return score(passage)

    def pairs(self, query: Column, passage: Column) -> Column:
        make, size = self.make, self.batch_size

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            run = make()
            for queries, texts in batches:
                out = pd.Series(0.0, index=texts.index)
                for q, own in texts.fillna("").groupby(queries.fillna(""), sort=False):
                    found = [float(s) for i in range(0, len(own), size) for s in run(q, own.iloc[i : i + size].tolist())]
                    out.loc[own.index] = found
                yield out

        return score(query, passage)


def content_key(text: Column, name: str) -> Column:
    """The key of a cached vector: encoder and content, not the fragment's id."""
    return F.sha2(F.concat_ws("\x1f", F.lit(name), text), 256)


def pair_cache_key(query: Column, passage: Column) -> Column:
    """MD5 of a pair joined by a bar; pairs with bars of their own can meet, see ``pair_key``."""
    return F.md5(F.concat(query, F.lit("|"), passage))


def pair_key(query: Column, passage: Column) -> Column:
    """A key that different pairs never share as text: the query's length goes before it."""
    return F.sha2(F.concat(F.length(query).cast("string"), F.lit(":"), query, passage), 256)


class VectorCache:
    """A table ``key, vector`` in committed batches; what it doesn't have is computed once and appended."""

    SCHEMA = "key string, vector array<double>"

    def __init__(self, spark, path: str):
        self.spark, self.batches = spark, Batches(spark, path)

    def read(self) -> DataFrame:
        return self.batches.read("vectors", self.SCHEMA)

    def encode(self, rows: DataFrame, text_col: str, encoder: TextEncoder, out: str = "embedding") -> DataFrame:
        """``rows`` with the vectors of their texts. The cache is read once, for what is asked alone; each missing text is encoded once."""
        keyed = rows.withColumn("_key", content_key(F.col(text_col), encoder.name))
        asked = written(keyed.select(F.col("_key").alias("key"), F.col(text_col).alias("text")).dropDuplicates(["key"]), "asked")
        known = written(self.read().join(asked.select("key"), "key", "left_semi").dropDuplicates(["key"]), "known")
        new = appended(self.batches, "vectors", asked.join(known.select("key"), "key", "left_anti").select("key", encoder.column(F.col("text")).cast("array<double>").alias("vector")), ("key",))
        vectors = known if new is None else known.unionByName(new)
        return keyed.join(vectors.withColumnsRenamed({"key": "_key", "vector": out}), "_key", "left").drop("_key")

    def stats(self) -> DataFrame:
        """One row: whether there is a cache, its vectors, and their size."""
        size = F.coalesce(F.sum(F.size("vector") * 8), F.lit(0))
        return self.read().agg(F.lit(True).alias("enabled"), F.count("*").alias("count"), size.alias("bytes"), (size / F.lit(1 << 20)).alias("mb"))

    def compact(self) -> None:
        self.batches.compact("vectors", self.SCHEMA, order=("key",), bloom=("key",))

    def clear(self) -> None:
        self.batches.clear()


class ScoreCache:
    """A table ``key, score`` of scored pairs, in committed batches: a pair is scored once."""

    SCHEMA = "key string, score double"
    #: Keys that are looked up as a list of constants at most; beyond it by a join.
    LISTED = 1_000

    def __init__(self, spark, path: str):
        self.spark, self.batches = spark, Batches(spark, path)

    def read(self) -> DataFrame:
        return self.batches.read("scores", self.SCHEMA)

    def scored(self, rows: DataFrame, query: str, scorer: PairScorer, text_col: str, out: str = "cross_score") -> DataFrame:
        """``rows`` (a search's candidates) with their score; the table is read for their keys alone, which bloom filters pick out."""
        passage = F.coalesce(F.col(text_col), F.lit(""))
        keyed = written(rows.withColumn("_key", F.concat(F.lit(f"{scorer.name}:"), pair_key(F.lit(query), passage))), "pairs")
        keys = [r[0] for r in keyed.select("_key").distinct().limit(self.LISTED + 1).collect()]
        known = self.read()
        known = known.where(F.col("key").isin(keys)) if len(keys) <= self.LISTED else known.join(keyed.select(F.col("_key").alias("key")), "key", "left_semi")
        known = written(known.dropDuplicates(["key"]), "known")
        missing = keyed.select(F.col("_key").alias("key"), passage.alias("passage")).dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")
        new = appended(self.batches, "scores", missing.select("key", scorer.column(query, F.col("passage")).cast("double").alias("score")), ("key",))
        scores = known if new is None else known.unionByName(new)
        return keyed.join(scores.withColumnsRenamed({"key": "_key", "score": out}), "_key", "left").drop("_key")

    def stats(self) -> DataFrame:
        return self.read().agg(F.lit(True).alias("enabled"), F.count("*").alias("count"), (F.count("*") * 72).alias("bytes"), (F.count("*") * 72 / F.lit(1 << 20)).alias("mb"))

    def compact(self) -> None:
        self.batches.compact("scores", self.SCHEMA, order=("key",), bloom=("key",))

    def clear(self) -> None:
        self.batches.clear()


def appended(batches: Batches, table: str, rows: DataFrame, bloom: tuple[str, ...]) -> DataFrame | None:
    """``rows`` as a committed batch, read again; None if there are none. What another writer adds meanwhile doesn't matter."""
    batch, told = uuid.uuid4().hex, Observation()
    batches.write(rows.observe(told, F.count("*").alias("n")), table, batch, bloom=bloom)
    n = told.get["n"]
    if not n:
        return None

    def make(seen: list[Entry]) -> tuple[str, int, dict]:
        return batch, n, {}

    batches.append(make)
    return batches.spark.read.schema(rows.schema).parquet(f"{batches.path}/{table}/batch={batch}")
