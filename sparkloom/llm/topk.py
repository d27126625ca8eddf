"""Exact top-k inner-product search: ball trees per shard, branch and bound.

Vectors are packed into shards of bounded size and queries into blocks of bounded size. One shuffle
brings every block past every shard: the rows of a partition come sorted as shard, blocks, shard,
blocks, so a task holds one tree and one block at a time. A tree's nodes are opened in the order of
their upper bound ``q.c + |q| r``; a node is dropped for a query whose kth score is above the bound.
A first round lets every block search one shard; the kth scores found there are shared with the
search of all others, and within a task a block's kth scores go from node to node.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, read, save

PACKED = "no long, dim int, n int, ids binary, vectors binary"
FOUND = "query_id long, vec_id long, score long"
LEAF = 128


class BallTree:
    """Nodes as arrays: centre, radius, children; leaves are slices of the reordered rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.kids: list[tuple[int, int] | None] = []
        self.spans: list[tuple[int, int]] = []
        x = rows.astype(np.float64)
        order = np.arange(len(rows))
        todo = [(0, len(rows), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            part = x[order[lo:hi]]
            centre = part.mean(axis=0) if hi > lo else np.zeros(x.shape[1])
            far = ((part - centre) ** 2).sum(axis=1)
            no = len(self.centres)
            self.centres.append(centre)
            self.radii.append(float(np.sqrt(far.max(initial=0.0))))
            self.kids.append(None)
            self.spans.append((lo, hi))
            if parent >= 0:
                self.kids[parent] = (no, self.kids[parent][1]) if side == 0 else (self.kids[parent][0], no)
            if hi - lo > leaf and far.max(initial=0.0) > 0:
                a = part[far.argmax()]
                b = part[((part - a) ** 2).sum(axis=1).argmax()]
                by = np.argsort(part @ (b - a), kind="stable")
                order[lo:hi] = order[lo:hi][by]
                mid = (lo + hi) // 2
                self.kids[no] = (-1, -1)
                todo += [(lo, mid, no, 0), (mid, hi, no, 1)]
        self.ids, self.rows = ids[order], x[order]
        self.exact = rows[order]


def search(tree: BallTree, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """The k best of a tree for each query, scores under ``floor`` left out; ties go to the smaller id."""
    n, big = len(q), np.iinfo(np.int64)
    qf = q.astype(np.float64)
    norm = np.sqrt((qf**2).sum(axis=1))
    top_s, top_i = np.full((n, k), big.min), np.full((n, k), big.max)
    kth = floor.copy()
    peak = np.abs(q).max(initial=0) * float(np.abs(tree.exact).max(initial=0)) * max(1, q.shape[1])
    small = peak < 2**52  # sums are exact as doubles

    def bound(node: int, who: np.ndarray) -> np.ndarray:
        b = qf[who] @ tree.centres[node] + norm[who] * tree.radii[node]
        return b + 1e-9 * np.abs(b) + 1e-6 + 1e-9 * norm[who] * (np.abs(tree.centres[node]).sum() + tree.radii[node])

    everyone = np.arange(n)
    heap = [(-float(bound(0, everyone).max(initial=-np.inf)), 0, everyone)] if n and len(tree.ids) else []
    while heap:
        _, node, who = heapq.heappop(heap)
        who = who[bound(node, who) >= kth[who]]
        if not len(who):
            continue
        if tree.kids[node]:
            for kid in tree.kids[node]:
                b = bound(kid, who)
                sub = who[b >= kth[who]]
                if len(sub):
                    heapq.heappush(heap, (-float((b - kth[who]).max()), kid, sub))
            continue
        lo, hi = tree.spans[node]
        for at in range(lo, hi, 4096):  # a leaf of equal vectors can be large
            end = min(hi, at + 4096)
            s = (qf[who] @ tree.rows[at:end].T).round().astype(np.int64) if small else q[who] @ tree.exact[at:end].T
            ids = np.broadcast_to(tree.ids[at:end], s.shape)
            s = np.where((ids == q_ids[who][:, None]) | (s < floor[who][:, None]), big.min, s)
            s, ids = np.hstack([top_s[who], s]), np.hstack([top_i[who], np.where(s == big.min, big.max, ids)])
            best = np.lexsort((ids, -s.astype(np.float64) if small else ~s), axis=1)[:, :k]
            top_s[who], top_i[who] = np.take_along_axis(s, best, 1), np.take_along_axis(ids, best, 1)
            kth[who] = np.maximum(floor[who], top_s[who][:, -1])
    for i, j in zip(*np.nonzero(top_s > big.min), strict=True):
        yield int(q_ids[i]), int(top_i[i, j]), int(top_s[i, j])


def scaled(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, whole-number vectors) of the rows that take part, by dimension."""
    col = batch.column("v").cast(pa.list_(pa.float64()))
    ids = batch.column("id")
    ok = np.asarray(col.is_valid()) & np.asarray(ids.is_valid())
    off = np.asarray(col.offsets)
    flat = col.values
    values = np.array(flat.fill_null(np.nan) if flat.null_count else flat, dtype=np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ok &= bad[off[1:]] == bad[off[:-1]]
    sizes = np.diff(off)
    keys = np.asarray(ids.fill_null(0))
    for dim in np.unique(sizes[ok]):
        at = np.nonzero(ok & (sizes == dim))[0]
        rows = values[off[at][:, None] + np.arange(dim)]
        yield int(dim), keys[at], np.floor(scale * rows).astype(np.int64)


def pack(df: DataFrame, scale: float, rows: int) -> DataFrame:
    """``id, v`` as packed blocks of at most ``rows`` vectors of one dimension each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        no, held = TaskContext.get().partitionId() << 32, {}

        def out(dim: int, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            nonlocal no
            no += 1
            return pa.RecordBatch.from_pydict({"no": [no - 1], "dim": pa.array([dim], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": [ids.astype("<i8").tobytes()], "vectors": [v.astype("<i8").tobytes()]})

        for batch in batches:
            for dim, ids, v in scaled(batch, scale):
                if dim in held:
                    ids, v = np.concatenate([held[dim][0], ids]), np.concatenate([held[dim][1], v])
                while len(ids) >= rows:
                    yield out(dim, ids[:rows], v[:rows])
                    ids, v = ids[rows:], v[rows:]
                held[dim] = ids, v
        for dim, (ids, v) in held.items():
            if len(ids):
                yield out(dim, ids, v)

    return df.mapInArrow(run, PACKED)


def top_k(
    vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: float = 64.0,
    shard_rows: int = 8192, block_rows: int = 1024,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of ``floor(scale * x)`` vectors.

    A query is not matched with the row of its own id. Ties go to the smaller id; fewer than k
    candidates give fewer rows. Vectors that are null or hold a null, NaN or infinite component, and
    rows without an id, take no part. Only vectors of a query's dimension are its candidates. Equal
    rows count once; an empty table gives no rows; other columns are ignored.
    """
    pick = lambda df: df.select(column(id_col).cast("long").alias("id"), column(vector_col).cast("array<double>").alias("v")).dropDuplicates()
    shards = save(pack(pick(vectors), scale, shard_rows), "topk-shards")
    blocks = save(pack(pick(queries), scale, block_rows).withColumn("floor", F.lit(None).cast("binary")), "topk-blocks")
    # a shard's number is all that leaves the executors: 20 bytes for every ``shard_rows`` vectors
    numbers = [tuple(r) for r in shards.select("no", "dim").sort("no").collect()]
    by_dim: dict[int, list[int]] = {}
    for no, dim in numbers:
        by_dim.setdefault(dim, []).append(no)
    if not by_dim:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shard_of = F.create_map(*[x for d, nos in by_dim.items() for x in (F.lit(d), F.array(*map(F.lit, nos)))])
    targets = F.coalesce(shard_of[F.col("dim")], F.array().cast("array<long>"))
    first = F.when(F.size(targets) > 0, F.element_at(targets, (F.abs(F.xxhash64("no")) % F.size(targets) + 1).cast("int")))

    def past(routed: DataFrame) -> DataFrame:
        """Every row of ``routed``, a block with the shard that it goes to, searched there."""
        both = shards.select(F.col("no").alias("shard"), F.lit(-1).cast("long").alias("block"), "dim", "n", "ids", "vectors", F.lit(None).cast("binary").alias("floor")).unionByName(
            routed.select("shard", F.col("no").alias("block"), "dim", "n", "ids", "vectors", "floor")
        )
        tasks = max(1, min(len(numbers), 20_000))
        return both.repartition(tasks, "shard").sortWithinPartitions("shard", "block").mapInArrow(visit, "block long, " + FOUND)

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, shard = None, None
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], "<i8")
                v = np.frombuffer(r["vectors"], "<i8").reshape(len(ids), r["dim"])
                if r["block"] == -1:
                    tree, shard = BallTree(ids, v), r["shard"]
                elif r["shard"] == shard:
                    floor = np.frombuffer(r["floor"], "<i8") if r["floor"] else np.full(len(ids), np.iinfo(np.int64).min)
                    found = list(search(tree, ids, v, floor, k))
                    cols = list(zip(*found, strict=True)) if found else [[], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array([r["block"]] * len(found), pa.int64()), *(pa.array(c, pa.int64()) for c in cols)], ["block", "query_id", "vec_id", "score"])

    pilot = save(past(blocks.withColumn("shard", first).where("shard is not null")), "topk-pilot")
    kth = pilot.groupBy("block", "query_id").agg(F.count("*").alias("m"), F.min("score").alias("s")).where(F.col("m") >= k).groupBy("block").agg(F.collect_list(F.struct("query_id", "s")).alias("known"))

    def with_floor(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = []
            for ids, known in zip(batch.column("ids").to_pylist(), batch.column("known").to_pylist(), strict=True):
                known = {x["query_id"]: x["s"] for x in known or ()}
                floors.append(np.array([known.get(i, np.iinfo(np.int64).min) for i in np.frombuffer(ids, "<i8").tolist()], "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("no", "dim", "n", "ids", "vectors")), pa.array(floors, pa.binary())], ["no", "dim", "n", "ids", "vectors", "floor"])

    shared = blocks.drop("floor").join(kth.withColumnRenamed("block", "no"), "no", "left").mapInArrow(with_floor, PACKED + ", floor binary")
    rest = shared.withColumn("shard", F.explode(F.array_remove(targets, first)))
    found = pilot.unionByName(past(rest)).drop("block")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all rows of ``embeddings``."""
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


OP10_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
