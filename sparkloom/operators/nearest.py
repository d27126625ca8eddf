"""Exact top-k lists in one scan: matrix products over Arrow batches, a bounded heap a task, and a merge of the heaps.

Vectors are arrays of numbers or, packed, binaries of little-endian float32, of which a batch is a
block: its buffer is the matrix. Scores are doubles and don't depend on where in a batch a row stands,
so equal vectors have equal scores and ties go by ``ordinal``. A row whose vector is null, of another
size than the query's, or has a component that is null or not finite, has no score; nor has a zero
vector a cosine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import METRICS
from .scratch import written

#: Rows whose products are taken at a time, queries in a block, and results that a task holds for many queries.
CHUNK, QUERIES, HELD = 4096, 512, 2_000_000
#: Blocks of queries that are broadcast at most; they are counted.
SENT_BLOCKS = 64


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of ``dim`` finite components as doubles, their rows)."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        right = pc.fill_null(pc.equal(pc.binary_length(column), 4 * dim), False)
        rows = np.nonzero(right.to_numpy(zero_copy_only=False))[0]
        some = column if len(rows) == len(column) else column.take(pa.array(rows))
        wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        first = np.frombuffer(some.buffers()[1], wide, 1, some.offset * np.dtype(wide).itemsize)[0] if len(some) else 0
        values = np.frombuffer(some.buffers()[2], np.float32, len(rows) * dim, int(first)) if len(rows) and dim else np.zeros(0, np.float32)
    else:
        right = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
        rows = np.nonzero(right.to_numpy(zero_copy_only=False))[0]
        some = column if len(rows) == len(column) else column.take(pa.array(rows))
        values = some.flatten().to_numpy(zero_copy_only=False)
    m = values.reshape(len(rows), dim).astype(np.float64)
    fine = np.isfinite(m).all(axis=1)
    return (m, rows) if fine.all() else (m[fine], rows[fine])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in an order that depends on the size alone."""
    return np.einsum("ij,ij->i", a, b) if b.ndim == 2 else np.einsum("ij,j->i", a, b)


def exact(m: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Scores of rows against a vector, or against a row each; NaN where there is none."""
    if metric == "l2":
        d = m - q
        return -products(d, d)
    dots = products(m, q)
    if metric == "ip":
        return dots
    with np.errstate(invalid="ignore", divide="ignore"):
        sizes = np.sqrt(products(m, m)) * np.sqrt((q * q).sum(axis=-1))
        return np.where(sizes > 0, dots / sizes, np.nan)


class Heap:
    """The ``size`` best of (score, ordinal): higher scores first, ties by the smaller ordinal."""

    def __init__(self, size: int):
        self.size, self.floor = size, -np.inf
        self.score, self.ordinal, self.more = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ordinal: np.ndarray, more: np.ndarray) -> None:
        keep = score >= self.floor  # false for NaN
        if not keep.any() or not self.size:
            return
        score, ordinal, more = score[keep], ordinal[keep], more[keep]
        if len(score) > self.size:
            keep = score >= np.partition(score, len(score) - self.size)[len(score) - self.size]
            score, ordinal, more = score[keep], ordinal[keep], more[keep]
        score, ordinal, more = (np.concatenate(x) for x in ((self.score, score), (self.ordinal, ordinal), (self.more, more)))
        by = np.lexsort((ordinal, -score))[: self.size]
        self.score, self.ordinal, self.more = score[by], ordinal[by], more[by]
        if len(by) == self.size:
            self.floor = float(self.score[-1])


@dataclass(frozen=True)
class Ranking:
    """A list to be made: its name and size, what it is scored by, and which rows take part.

    ``by`` is a vector column if there is a ``query``, else a score.
    """

    name: str
    size: int
    by: Column
    query: Sequence[float] | None = None
    metric: str = "cosine"
    where: Column | None = None

    def __post_init__(self):
        if self.metric not in METRICS:
            raise ValueError(f"unknown metric {self.metric!r}; known: {', '.join(METRICS)}")


RANKED = T.StructType([T.StructField("list", T.StringType()), T.StructField("ordinal", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("ok", T.BooleanType())])


def rankings(rows: DataFrame, lists: list[Ranking], ok: Column | None = None) -> DataFrame:
    """``list, ordinal, score, ok``: the best of each list, from one scan of ``rows`` (which have ``ordinal``).

    ``ok`` is handed on, for what is asked of the best alone. A task gives at most the lists' sizes.
    """
    true = F.lit(True)
    cols = [F.col("ordinal").cast("long").alias("ordinal"), F.coalesce(ok if ok is not None else true, F.lit(False)).alias("ok")]
    for i, x in enumerate(lists):
        cols += [(x.by if x.query is not None else x.by.cast("double")).alias(f"by{i}"), F.coalesce(x.where if x.where is not None else true, F.lit(False)).alias(f"in{i}")]
    names, sizes = [x.name for x in lists], [x.size for x in lists]
    asked = [(None if x.query is None else np.array(x.query, np.float64), x.metric) for x in lists]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [Heap(n) for n in sizes]
        for batch in batches:
            ordinals, ok = batch.column("ordinal").to_numpy(zero_copy_only=False), batch.column("ok").to_numpy(zero_copy_only=False).astype(np.int64)
            for i, (q, metric) in enumerate(asked):
                part, by = batch.column(f"in{i}").to_numpy(zero_copy_only=False), batch.column(f"by{i}")
                if q is None:
                    score = by.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are NaN
                    heaps[i].add(np.where(part, score, np.nan), ordinals, ok)
                    continue
                for at in range(0, batch.num_rows, CHUNK):
                    m, own = matrix(by.slice(at, CHUNK), len(q))
                    own += at
                    m, own = m[part[own]], own[part[own]]
                    if len(own):
                        heaps[i].add(exact(m, q, metric), ordinals[own], ok[own])
        for name, heap in zip(names, heaps, strict=True):
            if len(heap.score):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(heap.score)), pa.array(heap.ordinal), pa.array(heap.score), pa.array(heap.more.astype(bool))], ["list", "ordinal", "score", "ok"])

    best = Window.partitionBy("list").orderBy(F.desc("score"), "ordinal")
    found = rows.select(*cols).mapInArrow(run, RANKED).withColumn("_r", F.row_number().over(best))
    within = F.lit(False)
    for n, size in dict(zip(names, sizes, strict=True)).items():
        within |= (F.col("list") == n) & (F.col("_r") <= size)
    return found.where((F.col("_r") <= max(sizes)) & within).drop("_r")


def query_blocks(queries: DataFrame) -> DataFrame:
    """``query_id, query`` in blocks ``ids, dim, vectors``; queries of different sizes don't share one."""
    kind = queries.schema["query_id"].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("query")
            size = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
            for dim in np.unique(size[size > 0]).tolist():
                for at in range(0, batch.num_rows, QUERIES):
                    m, own = matrix(v.slice(at, QUERIES), dim)
                    if len(own):
                        ids = batch.column("query_id").slice(at, QUERIES).take(pa.array(own))
                        offsets = pa.array([0, len(own)], pa.int32())
                        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, ids), pa.array([dim]), pa.array([m.tobytes()], pa.binary())], ["ids", "dim", "vectors"])

    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("dim", T.LongType()), T.StructField("vectors", T.BinaryType())])
    return queries.select("query_id", F.col("query").cast("array<double>").alias("query")).mapInArrow(run, schema)


def likely(m: np.ndarray, q: np.ndarray, k: int, metric: str, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, queries) that may be among the k best of a query: by one matrix product, with room for its rounding."""
    dots, mm, qq = m @ q.T, products(m, m), products(q, q)
    if metric == "l2":
        rough, room = 2 * dots - mm[:, None] - qq, 1e-9 * (mm.max(initial=0.0) + qq)
    elif metric == "ip":
        rough, room = dots, 1e-9 * np.sqrt(mm.max(initial=0.0) * qq)
    else:
        with np.errstate(invalid="ignore", divide="ignore"):
            rough = np.where((mm[:, None] > 0) & (qq > 0), dots / np.sqrt(mm[:, None] * qq), -np.inf)
        room = 1e-9
    best = np.partition(rough, len(m) - k, axis=0)[len(m) - k] if len(m) > k else np.full(len(q), -np.inf)
    return np.nonzero((rough >= np.maximum(best, floors) - room) & (rough > -np.inf))


def nearest_of_many(rows: DataFrame, queries: DataFrame, k: int, metric: str, vector_col: str = "embedding") -> DataFrame:
    """``query_id, ordinal, score, rank``: the k nearest rows of each query ``query_id, query``, however many there are.

    Rows are packed in blocks, and each meets the queries in blocks; a task holds the k best of the
    queries it has met so far. Blocks of queries are broadcast up to ``SENT_BLOCKS``, else dealt.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
    blocks = written(query_blocks(queries), "queries").withColumn("block", F.monotonically_increasing_id())
    few = blocks.limit(SENT_BLOCKS + 1).count() <= SENT_BLOCKS

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            binary = not pa.types.is_list(v.type)
            size = pc.fill_null(pc.binary_length(v) if binary else pc.list_value_length(v), 0).to_numpy(zero_copy_only=False) // (4 if binary else 1)
            for dim in np.unique(size[size > 0]).tolist():
                for at in range(0, batch.num_rows, CHUNK):
                    m, own = matrix(v.slice(at, CHUNK), dim)
                    if len(own):
                        ordinals = batch.column("ordinal").to_numpy(zero_copy_only=False)[own + at].astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([ordinals.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], ["size", "ordinals", "rows"])

    held = rows.select(F.col("ordinal").cast("long").alias("ordinal"), F.col(vector_col).alias("v")).mapInArrow(pack, "size long, ordinals binary, rows binary")
    met = held.crossJoin(F.broadcast(blocks) if few else blocks)  # blocks of rows with blocks of queries
    kind = blocks.schema["ids"].dataType.elementType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, tuple[pa.Array, list[Heap]]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for ids, own in heaps.values():
                place = np.repeat(np.arange(len(own)), [len(h.score) for h in own])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(place)), pa.array(np.concatenate([h.ordinal for h in own])), pa.array(np.concatenate([h.score for h in own]))], ["query_id", "ordinal", "score"])
            heaps.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                block, size, dim = (batch.column(c)[i].as_py() for c in ("block", "size", "dim"))
                if size != dim:
                    continue
                q, m = (np.frombuffer(batch.column(c)[i].as_buffer(), np.float64).reshape(-1, dim) for c in ("vectors", "rows"))
                ordinals = np.frombuffer(batch.column("ordinals")[i].as_buffer(), np.int64)
                if block not in heaps:
                    if (len(heaps) + 1) * QUERIES * k > HELD:
                        yield from out()
                    heaps[block] = batch.column("ids")[i].values, [Heap(k) for _ in range(len(q))]
                own = heaps[block][1]
                at, of = likely(m, q, k, metric, np.array([h.floor for h in own]))
                score = exact(m[at], q[of], metric)
                by = np.argsort(of, kind="stable")
                edge = np.searchsorted(of[by], np.arange(len(q) + 1))
                for j in np.nonzero(np.diff(edge))[0].tolist():
                    part = by[edge[j] : edge[j + 1]]
                    own[j].add(score[part], ordinals[at[part]], at[part])
        yield from out()

    schema = T.StructType([T.StructField("query_id", kind), T.StructField("ordinal", T.LongType()), T.StructField("score", T.DoubleType())])
    found = met.select("block", "size", "dim", "vectors", "ids", "rows", "ordinals").mapInArrow(run, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "ordinal")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
