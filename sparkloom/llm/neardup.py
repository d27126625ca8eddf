"""Near-duplicate documents: an inverted join over MinHash signature coordinates.

Documents with the same shingle set are one node. A node's signature has ``coords`` minima; nodes are
posted under each (coordinate, value) pair that occurs twice or more. Two nodes that agree in
``match`` coordinates or more must share one of the ``coords - match + 1`` rarest pairs of either, so
nodes with fewer shared pairs than ``match`` are skipped and the others are posted under those rarest
pairs alone (the prefix). Pairs of a posting list are not all made. First every member is held against
one hub, of its lists' hubs the one that it shares most lists with; a list's hub is the member whose
coordinates are the most common, so of a group of edited copies the one nearest to their original.
These links are joined to components, and lists within one component are done. In the others, two bits of
every coordinate travel with a posting: a pair that agrees in ``match`` coordinates agrees in as many
pairs of bits, and a member without such a partner in another component leaves the list. Shingles that
no other member has bound what a pair can have in common: members that can't reach the threshold
with any partner of their list leave it. Members outside a list's main component are then held against
all of that component, in blocks of packed sets that give a link for each at most; and last, members of
different components that still share a list are paired, each pair under the first key that it shares.
A pair is a link if its full sets are as similar as asked; pairs made one by one agree in ``match``
coordinates first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, save, texts
from .components import components, extended

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Nodes whose texts are fetched by a broadcast of their ids (at most 24 MB); beyond it, by a shuffle.
BROADCAST_ROWS = 1_000_000
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit generator: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of lower-cased bytes, in order."""
    return words_at(data)[0]


def words_at(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes``, and where the words begin."""
    b = np.frombuffer(data, np.uint8)
    inside = ~BLANK[b]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    if not len(start):
        return np.zeros(0, np.uint64), start
    size = end - start
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    with np.errstate(over="ignore"):
        power = np.concatenate([[1], np.full(int(size.max()), 0x100000001B3, np.uint64)]).astype(np.uint64).cumprod()
        h = np.add.reduceat((b[inside].astype(np.uint64) + np.uint64(1)) * power[at], np.cumsum(size) - size)
        return mix(h * M1 + size.astype(np.uint64)), start


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    h = word_hashes((text or "").encode().translate(LOWER))
    with np.errstate(over="ignore"):
        n = len(h) - words + 1
        if n < 1:
            if not len(h):
                return h
            words, n = len(h), 1
        s = np.full(n, np.uint64(words))
        for i in range(words):
            s = mix(s * M1 + h[i : i + n])
    return np.unique(s)


def signature(s: np.ndarray, coords: int) -> np.ndarray:
    """32-bit minima of a set under ``coords`` hash functions."""
    out = np.empty(coords, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(coords):
            out[i] = ((s * (M2 + M1 * np.uint64(2 * i + 2)) ^ M3) * M3 >> np.uint64(32)).min()
    return out


def _nodes(rows: DataFrame, words: int, coords: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size, sig = [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), words)
                size.append(len(s))
                node.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s, coords).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_md5"), pa.array(node, pa.binary()), pa.array(size, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "text_md5", "node", "n_shingles", "sig"])

    return rows.withColumn("text_md5", F.md5("text")).mapInArrow(run, "doc_id long, text_md5 string, node binary, n_shingles long, sig binary")


def _postings(nodes: DataFrame, coords: int) -> DataFrame:
    """``node, key`` for every coordinate; a key is the coordinate and its value."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.arange(coords, dtype=np.int64) << 32
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sigs = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(part.num_rows, coords)
                yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(np.repeat(np.arange(part.num_rows), coords))), pa.array((sigs.astype(np.int64) | base).ravel())], ["node", "key"])

    return nodes.select("node", "sig").mapInArrow(run, "node binary, key long")


def _bits(nodes: DataFrame, coords: int) -> DataFrame:
    """``node, bits``: the two lowest bits of each coordinate, 32 coordinates a number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            low = np.zeros((batch.num_rows, -(-coords // 32) * 32), np.uint64)
            low[:, :coords] = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(batch.num_rows, coords) & np.uint32(3)
            packed = (low.reshape(batch.num_rows, -1, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=2, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(list(packed), pa.list_(pa.int64()))], ["node", "bits"])

    return nodes.select("node", "sig").mapInArrow(run, "node binary, bits array<long>")


def _may_agree(a: str, b: str, coords: int, match: int):
    """Whether two nodes agree in the two bits of ``match`` coordinates or more; true for all that agree in the coordinates."""
    differ = F.lit(0)
    for i in range(-(-coords // 32)):
        x = F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))
        differ = differ + F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(0x5555555555555555)))
    return differ <= coords - match


def _links(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, match: int, percent: int) -> DataFrame:
    """Those of ``a, b`` that agree in ``match`` coordinates and whose full sets are similar."""

    def agree(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            yield batch.filter(pa.array((x == y).sum(axis=1) >= match)).select(["a", "b"])

    def similar(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    def beside(df: DataFrame, side: DataFrame, value: str, names: tuple[str, str]) -> DataFrame:
        for end, name in zip(("a", "b"), names, strict=True):
            df = df.join(side.select(F.col("node").alias(end), F.col(value).alias(name)), end)
        return df

    close = save(beside(pairs, sigs, "sig", ("sa", "sb")).mapInArrow(agree, "a binary, b binary"), "neardup-pairs")
    return save(beside(close, sets, "items", ("xa", "xb")).mapInArrow(similar, "a binary, b binary"), "neardup-links")


def _into_components(at: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, block: int = 128) -> DataFrame:
    """``a, b``: for members outside their list's main component, a link into it from each block that has one."""
    most = at.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "root"))["root"].alias("main"))
    outside = at.join(most, "key").where("root <> main").select("node", F.col("main").alias("into")).distinct()
    goals = outside.select(F.col("into").alias("root")).distinct()
    inside = roots.unionByName(goals.select(F.col("root").alias("node"), "root")).distinct().join(goals, "root").select("node", F.col("root").alias("into"))

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("into").orderBy("node"))
        packed = rows.withColumn("no", F.floor((place - 1) / block)).join(sets, "node")
        return packed.groupBy("into", "no").agg(F.collect_list(F.struct("node", "items")).alias(name)).drop("no")

    def held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for r in range(batch.num_rows):
                sides = []
                for name in ("x", "y"):
                    own = batch.column(name)[r].values
                    sides.append((own.field("node"), [np.frombuffer(v.as_buffer(), np.uint64) for v in own.field("items")]))
                (xn, x), (yn, y) = sides
                shared = np.intersect1d(np.concatenate(x), np.concatenate(y))
                grids, sizes = [], []
                for side in (x, y):
                    grid = np.zeros((len(side), len(shared)), np.float32)
                    for i, v in enumerate(side):
                        grid[i, np.searchsorted(shared, np.intersect1d(v, shared, assume_unique=True))] = 1
                    grids.append(grid)
                    sizes.append(np.array([len(v) for v in side]))
                common = np.rint(grids[0] @ grids[1].T).astype(np.int64)
                near = 100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)
                for i in np.nonzero(near.any(axis=1))[0]:
                    out_a.append(xn[int(i)].as_py())
                    out_b.append(yn[int(near[i].argmax())].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], ["a", "b"])

    both = blocks(outside, "x").join(blocks(inside, "y"), "into")
    return both.mapInArrow(held, "a binary, b binary")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, coords: int = 64, match: int = 36,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_md5`` for each row.

    Words are split at ASCII blanks after lower-casing A-Z; a text with fewer than ``words`` of them is
    one shingle. Rows are linked if their sets' intersection is ``percent`` per cent of their union or
    more, and ``component_id`` is the least id reached. A null or empty text, or one of blanks, has an
    empty set and is linked with nothing. A row without id is linked with nothing either: its
    ``component_id`` is null and it is kept. Rows with the same id are told apart by their sets, and
    all rows of the least id of a component are kept. An empty table gives no rows; other columns are
    ignored. With the defaults, a pair at the threshold agrees in too few coordinates in 3 of a million
    cases.
    """
    rows = texts(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = save(_nodes(rows, words, coords), "neardup-nodes")
    linked = every.where("node IS NOT NULL AND doc_id IS NOT NULL")
    nodes = linked.groupBy("node").agg(F.first("sig").alias("sig"), F.first("n_shingles").alias("n"), F.min("doc_id").alias("rep"))
    nodes = save(nodes, "neardup-sets-of-copies")

    # keys that occur twice or more, and the nodes with enough of them
    posted = _postings(nodes, coords)
    shared = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    own = posted.join(shared, "key")
    rarest = Window.partitionBy("node").orderBy("n", "key")
    total = Window.partitionBy("node")
    marked = own.withColumns({"m": F.count("*").over(total), "common": F.sum("n").over(total), "r": F.row_number().over(rarest)})
    prefix = marked.where((F.col("m") >= match) & (F.col("r") <= F.lit(coords - match + 1) - (F.lit(coords) - F.col("m"))))
    prefix = save(prefix.select("node", "key", "common").join(_bits(nodes, coords), "node"), "neardup-prefix")
    # chance meetings go: a posting stays if its list has another node that may agree in enough coordinates
    mate = prefix.select(F.col("key").alias("key_"), F.col("node").alias("node_"), F.col("bits").alias("bits_"))
    prefix = save(prefix.join(mate, (F.col("key") == F.col("key_")) & (F.col("node") != F.col("node_")) & _may_agree("bits", "bits_", coords, match), "left_semi"), "neardup-prefix")

    # full sets of those nodes, from one text each
    wanted = prefix.select("node").distinct().join(nodes, "node").select("node", "sig", "n", "rep")
    wanted = save(wanted, "neardup-wanted")
    ids = wanted.select("rep").distinct()
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_ROWS else ids

    def items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                found = [shingle_set(t, words) for t in batch.column("text").slice(at, 200).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "items"])

    sets = rows.join(ids, F.col("doc_id") == F.col("rep"), "left_semi").mapInArrow(items, "node binary, items binary")
    sets = save(sets.dropDuplicates(["node"]), "neardup-sets")

    # each node against its main hub
    hub = prefix.groupBy("key").agg(F.max(F.struct("common", "node"))["node"].alias("b"))
    hub = hub.join(prefix.select("key", F.col("node").alias("b"), F.col("bits").alias("bits_b")), ["key", "b"])
    tried = prefix.join(hub, "key").where("node <> b").where(_may_agree("bits", "bits_b", coords, match)).groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("n"))
    main = tried.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))).where("r = 1").select("a", "b")
    roots = save(components(_links(main, wanted, sets, match, percent), "a", "b"), "neardup-roots")

    # then what is left between components
    def mixed(rows: DataFrame, tag: str) -> DataFrame:
        keys = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        return save(rows.join(keys, "key"), tag)

    def exploded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("items")]
                yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in found]))), pa.array(np.concatenate(found))], ["node", "item"])

    at = mixed(prefix.join(roots, "node", "left").select("key", "node", "bits", F.coalesce("root", "node").alias("root")), "neardup-mixed")
    other = at.select(F.col("key").alias("key_"), F.col("bits").alias("bits_"), F.col("root").alias("root_"))
    at = mixed(at.join(other, (F.col("key") == F.col("key_")) & (F.col("root") != F.col("root_")) & _may_agree("bits", "bits_", coords, match), "left_semi"), "neardup-mixed")
    items_of = sets.join(at.select("node").distinct(), "node").select("node", "items").mapInArrow(exploded, "node binary, item long")
    lone = items_of.groupBy("item").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count("*").alias("lone"))
    sizes = at.select("node").distinct().join(wanted.select("node", "n"), "node").join(lone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("g"))
    at = at.join(save(sizes, "neardup-sizes"), "node")
    least = at.groupBy("key").agg(F.min("n").alias("least"))
    at = at.join(least, "key").where(100 * F.col("g") >= percent * (F.col("n") + F.greatest("least", "g") - F.col("g"))).drop("least")
    at = mixed(at, "neardup-open")
    roots = save(extended(roots, _into_components(at, roots, sets, percent), "a", "b"), "neardup-roots")

    # members of different components that still share a list, one pair at a time; what was compared with its main component is not compared again
    most = at.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "root"))["root"].alias("main"))
    apart = at.join(most, "key").where("root <> main").select("key", "node", "bits", "n", "g")
    apart = apart.join(roots, "node", "left").select("key", "node", "bits", "n", "g", F.coalesce("root", "node").alias("root"))
    lists = prefix.groupBy("node").agg(F.collect_list("key").alias("own"))
    apart = mixed(apart, "neardup-apart")
    apart = save(apart.join(lists, "node"), "neardup-apart")
    one, two = (apart.select("key", F.col("node").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in ("root", "n", "g", "bits", "own"))) for n in ("a", "b"))
    able = 100 * F.least("g_a", "g_b") >= percent * (F.col("n_a") + F.col("n_b") - F.least("g_a", "g_b"))
    agree = _may_agree("bits_a", "bits_b", coords, match)
    once = F.array_min(F.array_intersect("own_a", "own_b")) == F.col("key")
    left = one.join(two, "key").where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & able & agree & once).select("a", "b").distinct()
    roots = save(extended(roots, _links(left, wanted, sets, match, percent), "a", "b"), "neardup-roots")

    member = every.join(roots, "node", "left").select("doc_id", "text_md5", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "node")).alias("root"))
    least = member.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return member.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("least", "doc_id"), F.lit(True)).alias("kept"), "text_md5"
    )


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates of the whole ``documents`` table on two-word shingles."""
    return near_duplicates(read(spark, sf_dir, "documents"), words=2).drop("text_md5")


#: All pairs that share one of a set's rarest shingles, as many as a pair at the threshold can't miss, compared in full.
OP8_SQL = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT rid, doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
g AS (SELECT rid, len(s) AS n, unnest(s) AS g FROM t WHERE doc_id IS NOT NULL),
p AS (SELECT rid, n, g, row_number() OVER (PARTITION BY rid ORDER BY f, g) AS r FROM g JOIN (SELECT g, count(*) AS f FROM g GROUP BY g) USING (g)),
few AS (SELECT * FROM p WHERE r <= n - (4 * n + 4) // 5 + 1),
c AS (SELECT DISTINCT a.rid AS x, b.rid AS y FROM few a JOIN few b USING (g) WHERE a.rid < b.rid AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
m AS (SELECT x, y, len(list_intersect(a.s, b.s)) AS shared, len(a.s) + len(b.s) AS n FROM c JOIN t a ON a.rid = x JOIN t b ON b.rid = y),
l AS (SELECT x, y FROM m WHERE 100 * shared >= 80 * (n - shared) UNION ALL SELECT y, x FROM m WHERE 100 * shared >= 80 * (n - shared)),
e(x, y) AS (SELECT rid, rid FROM t UNION SELECT e.x, l.y FROM e JOIN l ON l.x = e.y),
least_id AS (SELECT e.x AS rid, min(t.doc_id) AS component_id FROM e JOIN t ON t.rid = e.y GROUP BY e.x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, CASE WHEN doc_id IS NOT NULL THEN component_id END AS component_id, coalesce(doc_id = component_id, true) AS kept FROM t JOIN least_id USING (rid)"""
