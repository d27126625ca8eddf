"""A Merkle manifest of a dataset: a leaf a row, a tree a group of rows, a tree over the groups, and a proof a row.

Trees have runs of three: while several nodes remain, every three consecutive ones (the last run has
fewer, even one) become the digest of their hex digests. A group's leaves are numbered without
gathering it and packed in aligned blocks of ``3 ** levels``; a block is all that a task holds at a
time. Blocks' roots are the leaves of the next tier, blocks of blocks, so a group of any size needs a
few tiers, and the groups' roots make one more tree of the same kind.

Within a block the proofs are made by Merkle traversal. The current run of every level is kept; when
the leaves pass a run, the next one takes its place, which a treehash stack of that level has built
meanwhile, leaf by leaf. A step has as many leaf updates as there are levels, each given to the stack
whose lowest pending node is lowest. Then every stack is done in time (a level needs one update a
step, and a higher stack goes first only until its lowest node has reached the level), and pending
nodes are at most a few a level: memory is logarithmic in the leaves passed. The path above a block is
shared by its leaves and appended to each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, ranked, read, save, small

ARITY = 3
#: Levels of a block: 2187 leaves.
LEVELS = 7
PATH = "array<struct<left:string,right:string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def joined(run: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(run)).hexdigest().encode()


def height(n: int) -> int:
    """Levels from ``n`` leaves to one node."""
    out = 0
    while n > 1:
        n, out = -(-n // ARITY), out + 1
    return out


class Stack:
    """A treehash stack: takes ``leaves[at:end]`` one at a time and gives the nodes of height ``top``."""

    def __init__(self, leaves: list[bytes], at: int, end: int, top: int, seen: Callable[[int, bytes], None] | None = None):
        self.leaves, self.at, self.end, self.top, self.seen = leaves, at, min(end, len(leaves)), top, seen
        self.pending: list[list[bytes]] = [[] for _ in range(top)]
        self.out: list[bytes] = []
        self.lowest = top if self.at < self.end else -1  # of the pending nodes; -1: done

    def _put(self, level: int, node: bytes) -> None:
        while True:
            if self.seen:
                self.seen(level, node)
            if level == self.top:
                self.out.append(node)
                return
            run = self.pending[level]
            run.append(node)
            if len(run) < ARITY:
                return
            node = joined(run)
            run.clear()
            level += 1

    def update(self) -> None:
        self._put(0, self.leaves[self.at])
        self.at += 1
        if self.at == self.end:
            for level in range(self.top):  # the last runs may be short
                if self.pending[level]:
                    run, self.pending[level] = self.pending[level], []
                    self._put(level + 1, joined(run))
            self.lowest = -1
        else:
            self.lowest = next((k for k, run in enumerate(self.pending) if run), self.top)

    def size(self) -> int:
        return len(self.out) + sum(map(len, self.pending))


def block_root(leaves: list[bytes], levels: int) -> bytes:
    stack = Stack(leaves, 0, len(leaves), levels)
    while stack.lowest >= 0:
        stack.update()
    return stack.out[0]


class Traversal:
    """The siblings of each leaf of a block in turn, level by level: ``(left, right)``, each joined."""

    def __init__(self, leaves: list[bytes], levels: int):
        self.leaves, self.levels = leaves, levels
        self.runs: list[list[bytes]] = [[] for _ in range(levels)]

        def first(level: int, node: bytes) -> None:
            if level < levels and len(self.runs[level]) < ARITY:
                self.runs[level].append(node)

        whole = Stack(leaves, 0, len(leaves), levels, first)
        while whole.lowest >= 0:
            whole.update()
        self.root = whole.out[0]
        self.next = [self._stack(level, ARITY ** (level + 1)) for level in range(levels - 1)]  # the highest run is the last
        self.peak = 0

    def _stack(self, level: int, at: int) -> Stack:
        return Stack(self.leaves, at, at + ARITY ** (level + 1), level)

    def __iter__(self) -> Iterator[list[tuple[bytes, bytes]]]:
        for i in range(len(self.leaves)):
            path = []
            at = i
            for run in self.runs:
                k = at % ARITY
                path.append((b"".join(run[:k]), b"".join(run[k + 1 :])))
                at //= ARITY
            yield path
            for _ in range(self.levels):
                stack = min((s for s in self.next if s.lowest >= 0), key=lambda s: (s.lowest, s.top), default=None)
                if stack is None:
                    break
                stack.update()
            self.peak = max(self.peak, sum(map(len, self.runs)) + sum(s.size() for s in self.next))
            width = ARITY
            for level in range(self.levels - 1):
                if (i + 1) % width:
                    break
                if self.next[level].lowest >= 0:
                    raise RuntimeError("a treehash stack is late")
                self.runs[level] = self.next[level].out
                self.next[level] = self._stack(level, i + 1 + width)
                width *= ARITY


def _packed(nodes: DataFrame, levels: int) -> DataFrame:
    """``g, at, total, node, own`` -> ``g, total, block, rows``; a block has at most ``ARITY ** levels`` rows."""
    block = F.floor(F.col("at") / ARITY**levels).cast("long")
    return nodes.groupBy("g", "total", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "node", "own"))).alias("rows"))


def _nodes(rows: pa.ListArray, i: int) -> list[bytes]:
    return [x.hex().encode() for x in rows[i].values.field("node").to_pylist()]


def _levels(total: int, levels: int) -> int:
    """The height of a block of a tier of ``total`` nodes."""
    return levels if total > ARITY**levels else height(total)


def _roots(blocks: DataFrame, levels: int) -> DataFrame:
    """``g, at, total, node, own``: the blocks' roots as the nodes of the next tier."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, rows = batch.column("total").to_pylist(), batch.column("rows")
            nodes = [bytes.fromhex(block_root(_nodes(rows, i), _levels(n, levels)).decode()) for i, n in enumerate(total)]
            up = [-(-n // ARITY**levels) for n in total]
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("block"), pa.array(up, pa.int64()), pa.array(nodes, pa.binary())], ["g", "at", "total", "node"])

    plain = blocks.select("g", "block", "total", F.transform("rows", lambda x: F.struct(x["node"].alias("node"))).alias("rows"))
    return plain.mapInArrow(run, "g string, at long, total long, node binary").withColumn("own", F.lit(True))


def _proofs(blocks: DataFrame, levels: int) -> DataFrame:
    """``g, total, rows, upper, ...`` -> ``g, at, node, own, path, top`` and the other columns, a row a leaf."""
    more = [c for c in blocks.columns if c not in ("g", "total", "block", "rows", "upper")]
    own = blocks.schema["rows"].dataType.elementType["own"].dataType
    schema = T.StructType([
        T.StructField("g", T.StringType()), T.StructField("at", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("own", own), T.StructField("path", T._parse_datatype_string(PATH)),
        T.StructField("top", T.StringType()), *(blocks.schema[c] for c in more),
    ])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, upper = batch.column("rows"), batch.column("upper").to_pylist()
            for i, total in enumerate(batch.column("total").to_pylist()):
                leaves = Traversal(_nodes(rows, i), _levels(total, levels))
                above = [(x["left"].encode(), x["right"].encode()) for x in upper[i] or ()]
                lefts, rights, ends = [], [], [0]
                for path in leaves:
                    for left, right in (*path, *above):
                        lefts.append(left)
                        rights.append(right)
                    ends.append(len(lefts))
                n, x = len(leaves.leaves), rows[i].values
                paths = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(lefts, pa.binary()).cast(pa.string()), pa.array(rights, pa.binary()).cast(pa.string())], ["left", "right"]))
                same = pa.array([i] * n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("g").take(same), x.field("at"), x.field("node"), x.field("own"), paths, pa.array([leaves.root.decode()] * n, pa.string()), *(batch.column(c).take(same) for c in more)],
                    ["g", "at", "node", "own", "path", "top", *more],
                )

    return blocks.mapInArrow(run, schema)


def _climb(nodes: DataFrame, levels: int, tag: str) -> DataFrame:
    """``g, at, own, path, top`` of each node: its path to its group's root, and the root."""
    blocks = save(_packed(nodes, levels), f"{tag}-blocks")
    if (blocks.agg(F.max("total")).first()[0] or 0) <= ARITY**levels:
        return _proofs(blocks.withColumn("upper", F.array().cast(PATH)), levels).select("g", "at", "own", "path", "top")
    above = save(_climb(save(_roots(blocks, levels), f"{tag}-roots"), levels, tag), f"{tag}-above")
    held = blocks.join(above.select("g", F.col("at").alias("block"), F.col("path").alias("upper"), F.col("top").alias("whole")), ["g", "block"])
    return _proofs(held, levels).select("g", "at", "own", "path", F.col("whole").alias("top"))


def record(fields: list[Column]) -> Column:
    """The digest of a row's fields: each ``-`` if null, else its UTF-8 bytes' number, a colon and itself."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def manifest(docs: DataFrame, fields: list[str], *, group_col: str = "source", id_col: str = "doc_id", also: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """A row for each row: ``group, id, place, leaf, path, subroot, root``, and the columns ``also``.

    ``leaf`` digests the columns ``fields``; leaves are ordered by id (null first, ties by leaf) in
    their group, groups by their bytes, the null group first. ``path`` has for each level up to
    ``root`` the siblings to the ``left`` and ``right`` (empty where there are none); ``fold`` takes a
    leaf up it. Any text length is one digest; repeated rows are leaves of their own; an empty table
    gives no rows; other columns are not looked at, so their names can't clash. A task holds blocks of
    ``3 ** levels`` leaves.
    """
    keep = F.struct(column(group_col).cast("string").alias("group"), column(id_col).alias("id"), *(c.alias(f"also{i}") for i, c in enumerate((also or {}).values())))
    g = F.coalesce(F.concat(F.lit("="), column(group_col).cast("string")), F.lit(""))
    leaves = save(docs.select(g.alias("g"), column(id_col).alias("id"), F.unhex(record([column(f) for f in fields])).alias("node"), keep.alias("own")), "merkle-leaves")
    leaves = ranked(leaves, "g", [F.col("id"), F.col("node")], "merkle-ranked")
    blocks = save(_packed(leaves, levels), "merkle-blocks")
    up = save(_climb(save(_roots(blocks, levels), "merkle-roots"), levels, "merkle"), "merkle-paths")

    groups = up.where("at = 0").select(F.lit("").alias("one"), F.col("g").alias("own"), F.unhex("top").alias("node"))
    groups = ranked(groups, "one", [F.col("own")], "merkle-groups").withColumnRenamed("one", "g")
    over = save(_climb(groups, levels, "merkle-over").select(F.col("own").alias("g"), F.col("path").alias("over"), F.col("top").alias("root")), "merkle-over")
    up = up.join(small(over), "g").select("g", F.col("at").alias("block"), F.concat("path", "over").alias("upper"), F.col("top").alias("subroot"), "root")
    rows = _proofs(blocks.join(up, ["g", "block"]), levels)
    return rows.select(
        "own.group", "own.id", F.col("at").alias("place"), F.lower(F.hex("node")).alias("leaf"), "path", "subroot", "root", *(F.col(f"own.also{i}").alias(c) for i, c in enumerate(also or {})),
    )


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))


def tampered(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest of documents, and what becomes of the proofs of every other if line feeds are taken out of its text."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = {f: F.col(f) for f in fields} | {"text": F.replace("text", F.lit("\n"), F.lit(""))}
    told = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    rows = manifest(docs, fields, levels=levels, also={"changed": F.when(told, record(list(changed.values())))})
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    out = rows.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("path")))
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """Manifest and verification of the whole ``documents`` table."""
    return tampered(read(spark, sf_dir, "documents"))


def _crc(text: str) -> str:
    """DuckDB's expression for the unsigned CRC-32 of an ASCII string."""
    steps = f"list_concat([4294967295::BIGINT], flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])))"
    return f"xor(list_reduce({steps}, lambda a, b: xor(xor(a, b) >> 1, 3988292384::BIGINT * (xor(a, b) & 1))), 4294967295::BIGINT)"


def _tree_sql(name: str, leaves: str, key: str, levels: int) -> str:
    """CTEs ``name0..``: nodes of each level (key, pos, h, n), and ``name``: the root of each key."""
    out = [f"{name}0 AS ({leaves})"]
    for k in range(1, levels + 1):
        out.append(
            f"{name}{k} AS (SELECT {key}, pos // 3 AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h, (any_value(n) + 2) // 3 AS n FROM {name}{k - 1} GROUP BY {key}, pos // 3)"
        )
    return ", ".join([*out, f"{name} AS (SELECT {key}, h FROM {name}{levels})"])


def _sql(levels: int = 8) -> str:
    """Up to ``3 ** levels`` documents a source, and as many sources."""
    field = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    row = lambda text: f"sha256({' || '.join(field(c) for c in ('doc_id::VARCHAR', 'source', 'lang', 'n_chars::VARCHAR', text))})"
    side = lambda sign, tree, key, at, k: f"coalesce((SELECT string_agg(s.h, '' ORDER BY s.pos) FROM {tree}{k} s WHERE {key} AND s.n > 1 AND s.pos // 3 = ({at} // {3**k}) // 3 AND s.pos {sign} {at} // {3**k}), '')"
    steps = [("t", "s.g = p.g", "p.pos", k) for k in range(levels)] + [("u", "true", "p.gat", k) for k in range(levels)]
    out = f"""d AS (SELECT *, coalesce('=' || source, '') AS g, {row("text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_crc("coalesce(doc_id, 0)::VARCHAR")} % 2 = 0 THEN {row("replace(text, chr(10), '')")} END AS changed FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
{_tree_sql("t", "SELECT g, pos, leaf AS h, n FROM l", "g", levels)},
r AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS gat, count(*) OVER () AS gn FROM t),
{_tree_sql("u", "SELECT 1 AS one, gat AS pos, h, gn AS n FROM r", "one", levels)},
p AS (SELECT l.*, r.gat, r.h AS subroot, u.h AS root FROM l JOIN r USING (g), u),
x AS (SELECT p.*, [{", ".join(side("<", *s) for s in steps)}] AS lefts, [{", ".join(side(">", *s) for s in steps)}] AS rights FROM p),
f AS (SELECT *, coalesce(changed, leaf) AS c0 FROM x)"""
    for i in range(2 * levels):
        tree, _, at, k = steps[i]
        size = "n" if tree == "t" else "(SELECT count(*) FROM r)"
        out += f", f{i + 1} AS (SELECT *, CASE WHEN {size} > {3**k} THEN sha256(lefts[{i + 1}] || c{i} || rights[{i + 1}]) ELSE c{i} END AS c{i + 1} FROM f{i or ''})"
    last = 2 * levels
    proof = "sha256(array_to_string(list_transform(list_zip(lefts, rights), lambda z: z[1] || z[2]), ''))"
    return f"WITH {out} SELECT doc_id, leaf, subroot, root, {proof} AS proof_sha256, c{last} AS folded_root, c{last} = root AS verified FROM f{last}"


OP12_SQL = _sql()
