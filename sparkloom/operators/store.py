"""The fragment store: committed batches of rows, partitioned by type and sorted by file, and of keyword postings."""

from __future__ import annotations

import uuid
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import keyword_score, preview
from ..functions.vector import METRICS
from ..schema import STORE, TYPES
from .batches import Batches, Entry, empty
from .filters import apply
from .nearest import CHUNK, matrix
from .scratch import scope, written
from .search import top, unpacked
from .words import POSTINGS, candidates, postings


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or an empty one where there is nothing yet; a table that can't be read is an error."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p) or not any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(p)):
        return empty(spark, schema)
    return spark.read.schema(schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str = "ordinal", start: int = 0) -> DataFrame:
    """Rows numbered in order without one task for all: range partitions, their counts, and numbers within each.

    The bounds of range partitions come from a sample, so two evaluations may cut the rows differently.
    The rows are therefore written once, with their partition and place, and counted as they were written.
    """
    own = f"_{uuid.uuid4().hex}"  # no column of the input has this name
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(own, F.monotonically_increasing_id())
    ranged = written(ranged, "numbered")
    part = F.shiftright(own, 33)
    counts = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # one row for each partition
    offsets = counts.select(F.col("part").alias(f"{own}part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias(f"{own}before"))
    at = F.col(own).bitwiseAND(F.lit((1 << 33) - 1))
    placed = ranged.withColumn(f"{own}part", part).join(F.broadcast(offsets), f"{own}part")
    return placed.withColumn(name, F.col(f"{own}before") + at + start).drop(own, f"{own}part", f"{own}before")


def metadata(frags: DataFrame) -> DataFrame:
    """What a search sees of a fragment; only components keep their name and lists. Vectors that are there come along."""
    m, own = "metadata.", F.col("type") == "component"
    only = lambda c, d: F.when(own, F.coalesce(F.col(m + c), d))
    none = F.array().cast("array<string>")
    return frags.select(
        "id", "type", "name", F.coalesce(m + "file_path", F.lit("")).alias("file_path"), F.coalesce(m + "file_name", F.lit("")).alias("file_name"), preview(F.col("content")).alias("content_preview"),
        F.col("content").alias("full_content"), *([c for c in ("embedding", "meaning") if c in frags.columns]), only("component_name", F.lit("")).alias("component_name"), only("props", none).alias("props"), only("components", none).alias("components"),
    )


def top5(df: DataFrame) -> DataFrame:
    """The lists as responses show them: their first five entries."""
    return df.withColumns({c: F.slice(c, 1, 5) for c in ("props", "components")})


def additions(frags: DataFrame, embeddings: DataFrame, known: DataFrame) -> DataFrame:
    """Fragments whose id isn't known and that have a vector; of equal ids the first by content stays."""
    new = frags.join(known.select("id"), "id", "left_anti")
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("content"))).where("_r = 1").drop("_r")
    return first.join(embeddings, "id")


def without_vector(frags: DataFrame, embeddings: DataFrame) -> DataFrame:
    return frags.join(embeddings.select("id"), "id", "left_anti")


def orphans(frags: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Vectors of no fragment."""
    return embeddings.join(frags.select("id"), "id", "left_anti")


def store_stats(store: DataFrame, dim: int, metric: str, scorer: str | None = None) -> DataFrame:
    """One row of exact counts."""
    name = F.when((F.col("type") == "component") & (F.length("component_name") > 0), F.col("component_name"))
    return store.agg(
        F.count("*").alias("vector_count"), F.lit(dim).alias("dimension"), F.lit(metric).alias("index_type"),
        F.count_distinct(F.when(F.length("file_path") > 0, F.col("file_path"))).alias("file_counts"), F.count_distinct(name).alias("component_count"), F.lit(scorer is not None).alias("cross_encoder"),
    )


def packed_part(v: pa.Array, dim: int, unit: bool) -> pa.Array:
    """A batch's vectors as ``pack`` gives them: one buffer for all, no object a row."""
    m, rows = matrix(v, dim)
    if unit:
        size = np.sqrt(np.einsum("ij,ij->i", m, m))
        m, rows = m[size > 0] / size[size > 0, None], rows[size > 0]
    has = np.zeros(len(v), bool)
    has[rows] = True
    ends = np.concatenate([[0], np.cumsum(has * (4 * dim))]).astype("<i4")
    bits = pa.py_buffer(np.packbits(has, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), len(v), [bits, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(m, "<f4"))])


def pack(vector: Column, dim: int, unit: bool = False) -> Column:
    """A vector of ``dim`` numbers as float32 components; null for another size, and for a zero vector if it has to have length 1."""

    @F.arrow_udf("binary")
    def run(v: pa.Array) -> pa.Array:
        parts = [packed_part(v.slice(at, CHUNK), dim, unit) for at in range(0, len(v), CHUNK)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    return run(vector.cast("array<double>"))


class FragmentStore:
    """Fragments and vectors under a path; ``metric`` is cosine, ip or l2.

    Rows are looked up by id or file through bloom filters and the bounds of row groups, which are
    sorted by file; keyword searches go through postings. What is added is seen whole, once it is
    committed, and adding at the same time as others is fine (``Batches``).
    """

    def __init__(self, spark: SparkSession, path: str, dim: int, metric: str = "cosine"):
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}")
        self.spark, self.path, self.dim, self.metric = spark, path.rstrip("/"), dim, metric
        self.batches = Batches(spark, self.path)

    def read(self) -> DataFrame:
        return self.batches.read("rows", STORE, ordinal="ordinal")

    def view(self, name: str) -> DataFrame:
        """The committed rows as a temporary view, for Spark SQL."""
        rows = self.read()
        rows.createOrReplaceTempView(name)
        return rows

    def is_empty(self) -> bool:
        return not sum(e.count for e in self.batches.entries())

    def add(self, frags: DataFrame, embeddings: DataFrame, meanings: DataFrame | None = None, replaces: bool = False, **about: Any) -> Entry | None:
        """Append what is new; ids and numbers of what is there stay as they are. ``replaces``: in place of what is there.

        ``embeddings`` are ``id, embedding``, ``meanings`` the previews' ``id, meaning``. The batch's
        counts (rows, by type, components with props and with components) are taken as it is written
        and kept in its entry, with ``about``. Nothing new commits nothing.
        """
        wrong = embeddings.where(F.size("embedding") != self.dim).limit(1).count()
        if wrong:
            raise ValueError(f"vectors have to have {self.dim} components")

        def packed() -> DataFrame:
            """Written before anything is joined with it: filters and the sampling of ranges would each pack it again, in Python workers of their own."""
            vectors = written(embeddings.select("id", pack(F.col("embedding"), self.dim, self.metric == "cosine").alias("embedding")), "vectors")
            if meanings is None:
                return vectors.withColumn("meaning", F.lit(None).cast("binary"))
            width = meanings.agg(F.max(F.size("meaning"))).first()[0] or 0
            return vectors.join(written(meanings.select("id", pack(F.col("meaning"), width).alias("meaning")), "meanings"), "id", "left")

        def make(seen: list[Entry]) -> tuple[str, int, dict[str, Any]] | None:
            known = self.batches.read("rows", STORE, [] if replaces else seen)
            rows = metadata(additions(frags, vectors.where("embedding IS NOT NULL"), known))
            rows = numbered(rows, [F.col("file_path"), F.col("type"), F.col("id")], "place")
            batch, told = uuid.uuid4().hex, Observation()
            names = [c.split()[0] for c in STORE.split(", ")]
            rows = rows.select("place", *names[:-1], "type").observe(told, *batch_counts())
            self.batches.write(rows.sortWithinPartitions("type", "place"), "rows", batch, partition_by=("type",), bloom=("id", "file_path"))
            counts = told.get
            if not counts["total"] and not replaces:
                return None
            if counts["total"]:
                placed = self.spark.read.schema("place long, content_preview string").parquet(f"{self.path}/rows/batch={batch}")
                self.batches.write(postings(placed), "grams", batch, bloom=("gram",))
            return batch, counts["total"], about | {"counts": counts}

        with scope(self.spark):
            vectors = packed()
            return self.batches.append(make, replaces)

    def keyword_search(self, query: str, k: int = 20, filters: dict[str, Any] | None = None) -> DataFrame:
        """The k best by keyword score; only rows that the postings name are scored."""
        scored = apply(self.matches(query), filters).withColumn("score", keyword_score(F.col("content_preview"), F.col("type"), query)).where("score > 0")
        return top(scored.drop("embedding", "meaning", "full_content"), "score", k)

    def matches(self, query: str) -> DataFrame:
        """The rows with one of the query's terms in their preview; the postings name few others."""
        low, has = F.lower(F.col("content_preview")), F.lit(False)
        for term in dict.fromkeys(query.lower().split()):
            has |= F.contains(low, F.lit(term))
        entries = self.batches.entries()
        index = self.batches.read("grams", POSTINGS, entries, first="first")
        return self.batches.read("rows", STORE, entries, ordinal="ordinal").join(candidates(index, query, "first"), "ordinal").where(has)

    def counts(self) -> dict[str, Any]:
        """What was counted as the batches were written, summed; nothing is scanned."""
        out: dict[str, Any] = {"total": 0, "has_props": 0, "has_components": 0, "by_type": {}}
        for e in self.batches.entries():
            found = e.about.get("counts", {})
            for key, n in found.items():
                if key.startswith("type_"):
                    out["by_type"][key[5:]] = out["by_type"].get(key[5:], 0) + n
                else:
                    out[key] += n
        out["by_type"] = {t: n for t, n in out["by_type"].items() if n}
        return out

    def compact(self) -> None:
        """All batches as one; ordinals stay."""

        def make(seen: list[Entry]) -> tuple[str, int, dict[str, Any]] | None:
            if len(seen) < 2:
                return None
            batch = uuid.uuid4().hex
            rows = self.batches.read("rows", STORE, seen, ordinal="place")
            counts = {k: v for k, v in self.counts().items() if k != "by_type"} | {f"type_{t}": n for t, n in self.counts()["by_type"].items()}
            self.batches.write(rows.repartitionByRange("place").sortWithinPartitions("type", "place"), "rows", batch, partition_by=("type",), bloom=("id", "file_path"))
            self.batches.write(postings(rows.select("place", "content_preview")), "grams", batch, bloom=("gram",))
            return batch, sum(e.count for e in seen), seen[-1].about | {"counts": counts}

        self.batches.append(make, replaces=True)

    def clear(self) -> None:
        self.batches.clear()

    def vector(self, id_: str) -> list[float] | None:
        row = self.read().where(F.col("id") == id_).select("embedding").first()
        return unpacked(row[0]) if row else None


def batch_counts() -> list[Column]:
    """Aggregates of rows of the store: all, by type, and components with props and with components of their own."""
    component = F.col("type") == "component"
    own = [F.count("*").alias("total"), F.count_if(component & (F.size("props") > 0)).alias("has_props"), F.count_if(component & (F.size("components") > 0)).alias("has_components")]
    return [*own, *(F.count_if(F.col("type") == t).alias(f"type_{t}") for t in TYPES)]
