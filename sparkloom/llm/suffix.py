"""Removal of repeated passages by a hash-compared suffix sort, byte-exact.

A string of ``length`` bytes has an anchor: the place in it whose ``gram`` bytes hash lowest, the
leftmost of equals. Equal strings have their anchors at equal places, so only places with equal
anchors need comparing, and a document has an anchor for every hundred-odd bytes. Strings that start
side by side and share an anchor form a run; its context is all that they cover. Runs whose anchors
occur once in the corpus go first, by a count of anchors. Of the others, runs with equal contexts are
repeated as a whole. What is left are anchors with different contexts: there the suffixes that begin
at the anchors are sorted.

The sort is a mergesort whose comparisons find the common extension of two suffixes by binary search
over prefix polynomial hashes, in as many steps as the length has bits. Neighbours' extensions cut the
order into blocks that agree to the right of the anchor; polynomial hashes of what lies to the left
tell which of a block's strings are equal; every repeat that they find is verified byte by byte. What
is told without the sort, equal contexts and the strings of crowded anchors, is told by a digest of 128
bits, as equal texts are.

Anchors with more than ``sort_limit`` different contexts are not gathered in one task: there each
string is a row of its own, counted by a hash of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, column, given_back, hot_join, read, save
from .neardup import mix

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SEGMENT = 1 << 20
#: Rows of a side that is broadcast at most (16-byte keys); beyond it the join is a shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of contexts that are sorted together.
SORT_BYTES = 4_000_000
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(int(base), ())) < n:
        _powers[int(base)] = np.concatenate([[np.uint64(1)], np.full(max(n, 4096) - 1, base, np.uint64)]).cumprod(dtype=np.uint64)
    return _powers[int(base)][:n]


def prefix_hashes(b: np.ndarray) -> np.ndarray:
    """H[i] = sum of (b[j] + 1) * BASE**j over j < i, modulo 2**64; along the last axis."""
    terms = (b.astype(np.uint64) + np.uint64(1)) * powers(BASE, b.shape[-1])
    return np.concatenate([np.zeros((*b.shape[:-1], 1), np.uint64), terms.cumsum(axis=-1, dtype=np.uint64)], axis=-1)


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows, by doubling."""
    size, m = 1, x
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(x) - width + 1], m[width - size :]) if size < width else m


def runs(data: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors' hashes, anchors, first and last start of each run of a text."""
    out: list[tuple[np.ndarray, ...]] = []
    last = len(data) - length
    for lo in range(0, last + 1, SEGMENT):
        hi = min(last, lo + SEGMENT - 1)
        b = np.frombuffer(data, np.uint8, hi - lo + length, lo)
        h = prefix_hashes(b)
        g = mix((h[gram:] - h[:-gram]) * powers(INVERSE, len(b) - gram + 1))
        place = np.uint64((1 << 24) - 1)
        m = window_min((g & ~place) | np.arange(len(g), dtype=np.uint64), length - gram + 1)
        at = (m & place).astype(np.int64)
        first = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1])
        end = np.concatenate([first[1:] - 1, [len(at) - 1]])
        out.append((g[at[first]].view(np.int64), at[first] + lo, first + lo, end + lo))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


class Contexts:
    """Contexts of anchors, sorted by the suffixes that begin at the anchors; ``groups`` ascend."""

    def __init__(self, groups: np.ndarray, parts: list[bytes], left: np.ndarray):
        self.groups, self.parts, self.left = groups, parts, left
        size = np.array([len(p) for p in parts])
        self.right = size - left
        self.bytes = np.zeros((len(parts), int(size.max())), np.uint8)
        for i, p in enumerate(parts):
            self.bytes[i, : len(p)] = np.frombuffer(p, np.uint8)
        self.h = prefix_hashes(self.bytes)
        self.inverse = powers(INVERSE, self.h.shape[1])

    def hash(self, i: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.h[i, start + n] - self.h[i, start]) * self.inverse[start]

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bytes that two suffixes have in common, by binary search over prefix hashes."""
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.right[i], self.right[j])
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self.hash(i, self.left[i], mid) == self.hash(j, self.left[j], mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = self.groups[i] < self.groups[j]
        at = np.nonzero(self.groups[i] == self.groups[j])[0]
        if len(at):
            i, j = i[at], j[at]
            n = self.extension(i, j)
            width = self.bytes.shape[1] - 1
            x, y = self.bytes[i, np.minimum(self.left[i] + n, width)], self.bytes[j, np.minimum(self.left[j] + n, width)]
            out[at] = np.where((n == self.right[i]) | (n == self.right[j]), self.right[i] < self.right[j], x < y)
        return out

    def sort(self) -> np.ndarray:
        """A bottom-up mergesort; all merges of a level at once, each element finding its rank in the other run."""
        n = len(self.parts)
        order, at = np.arange(n), np.arange(n)
        step = 1
        while step < n:
            run = at // step
            lo = np.where(run % 2 == 0, (run + 1) * step, (run - 1) * step)
            top = np.minimum(lo + step, n)
            base = np.minimum(lo, n)
            lo = base.copy()
            hi = np.maximum(top, lo)
            odd = run % 2 == 1
            while (open_ := np.nonzero(lo < hi)[0]).size:
                mid = (lo[open_] + hi[open_]) // 2
                mine, other = order[open_], order[mid]
                # the left run's elements go before equals of the right run
                before = np.where(odd[open_], ~self.less(mine, other), self.less(other, mine))
                lo[open_], hi[open_] = np.where(before, mid + 1, lo[open_]), np.where(before, hi[open_], mid)
            new = np.where(odd, base, (run * step)) + (at % step) + (lo - base)
            merged = np.empty_like(order)
            merged[new] = order
            order = merged
            step *= 2
        return order

    def repeats(self, length: int) -> Iterator[tuple[int, int, int]]:
        """(context, first start, last start) of strings that occur in two contexts of a group or more."""
        order = self.sort()
        g = self.groups[order]
        common = np.where(g[1:] == g[:-1], self.extension(order[:-1], order[1:]), -1)
        left, hi = self.left[order], length - self.right[order]  # starts lie ``hi .. left`` before the anchor
        found: list[tuple[np.ndarray, ...]] = []
        for o in range(max(0, int(hi.min(initial=0))), int(left.max(initial=-1)) + 1):
            ok = np.nonzero((hi <= o) & (o <= left))[0]
            if len(ok) < 2:
                continue
            block = np.concatenate([[0], np.cumsum(common < length - o)])[ok]
            own = order[ok]
            start = self.left[own] - o
            key = mix(mix(block.astype(np.uint64)) + self.hash(own, start, np.full(len(own), o)))
            by = np.argsort(key, kind="stable")
            k = key[by]
            new = np.concatenate([[True], k[1:] != k[:-1]])
            many = np.bincount(np.cumsum(new) - 1)
            first = np.nonzero(new)[0]
            twice = np.repeat(many > 1, many)
            # the first of a class is held against the second, the others against the first
            mate = np.repeat(first, many)
            mate[first] = np.minimum(first + 1, len(by) - 1)
            i, j = own[by][twice], own[by][mate[twice]]
            found.append((i, np.full(len(i), o), j))
        if not any(len(i) for i, _, _ in found):  # equal anchors, but no string occurs twice
            return
        i, o, j = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((o, j, i))
        i, o, j = i[by], o[by], j[by]
        cut = np.nonzero((np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(o) != 1))[0] + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(i)], strict=True):
            x, y, near, far = int(i[a]), int(j[a]), int(o[a]), int(o[b - 1])
            lx, ly = int(self.left[x]), int(self.left[y])
            if self.parts[x][lx - far : lx - near + length] == self.parts[y][ly - far : ly - near + length]:
                yield x, lx - far, lx - near
            else:  # hashes met by chance: each string against all of its group
                mates = [p for k, p in enumerate(self.parts) if self.groups[k] == self.groups[x] and k != x]
                for s in range(lx - far, lx - near + 1):
                    if any(self.parts[x][s : s + length] in p for p in mates):
                        yield x, s, s


def _anchors(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rk", "anchor", "sig", "at", "lo", "hi"]
        for batch in batches:
            for cut in range(0, batch.num_rows, 500):
                part = batch.slice(cut, 500)
                cols: list[tuple[np.ndarray, ...]] = []
                sigs: list[bytes] = []
                for row, text in enumerate(part.column("text")):
                    data = (text.as_buffer() or b"") if text.is_valid else b""
                    data = memoryview(data).tobytes()
                    if len(data) < length:
                        continue
                    key, at, lo, hi = runs(data, length, gram)
                    sigs += [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)]
                    cols.append((np.full(len(at), row), key, at, lo, hi))
                if cols:
                    row, key, *rest = (np.concatenate(x) for x in zip(*cols, strict=True))
                    yield pa.RecordBatch.from_arrays([part.column("rk").take(pa.array(row)), pa.array(key), pa.array(sigs, pa.binary()), *map(pa.array, rest)], names)

    return keyed.mapInArrow(run, "rk binary, anchor long, sig binary, at long, lo long, hi long")


def _cut(rows: DataFrame) -> DataFrame:
    """``rk, text, runs`` -> each run with the bytes of its context."""
    schema = "rk binary, anchor long, n long, at long, lo long, hi long, bytes binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rk, text, own in zip(batch.column("rk"), batch.column("text"), batch.column("runs"), strict=True):
                data, own = memoryview(text.as_buffer()).tobytes(), own.as_py()
                for c in range(0, len(own), 5000):
                    part = own[c : c + 5000]
                    cols = [[x[f] for x in part] for f in ("anchor", "n", "at", "lo", "hi")]
                    yield pa.RecordBatch.from_arrays([pa.array([rk.as_py()] * len(part), pa.binary()), *(pa.array(x, pa.int64()) for x in cols), pa.array([data[x["lo"] : x["end"]] for x in part], pa.binary())], ["rk", "anchor", "n", "at", "lo", "hi", "bytes"])

    return rows.mapInArrow(run, schema)


SPANS = "rk binary, begin long, stop long"


def _sorted_repeats(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of repeats among contexts that come sorted by anchor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def out() -> pa.RecordBatch:
            groups = np.unique(np.array([x["anchor"] for x in held]), return_inverse=True)[1]
            c = Contexts(groups, [x["bytes"] for x in held], np.array([x["at"] - x["lo"] for x in held]))
            spans = [(held[i]["rk"], held[i]["lo"] + a, held[i]["lo"] + b + length) for i, a, b in c.repeats(length)]
            cols = list(zip(*spans, strict=True)) if spans else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["rk", "begin", "stop"])

        for batch in batches:
            for x in batch.to_pylist():
                if size >= SORT_BYTES and x["anchor"] != held[-1]["anchor"]:
                    yield out()
                    held, size = [], 0
                held.append(x)
                size += len(x["bytes"])
        if held:
            yield out()

    return contexts.mapInArrow(run, SPANS)


def _counted_repeats(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of repeats by a row for each string: for anchors with very many contexts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                b = x["bytes"]
                n = len(b) - length + 1
                yield pa.RecordBatch.from_arrays([pa.array([x["rk"]] * n, pa.binary()), pa.array(np.arange(n) + x["lo"]), pa.array([xxhash.xxh3_128_digest(b[i : i + length]) for i in range(n)], pa.binary())], ["rk", "begin", "h"])

    rows = save(contexts.mapInArrow(run, "rk binary, begin long, h binary"), "suffix-strings")
    twice = rows.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h")
    return rows.join(twice, "h").select("rk", "begin", (F.col("begin") + length).alias("stop"))


def repeated_spans(keyed: DataFrame, length: int = 400, gram: int = 128, sort_limit: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(``rk, begin, stop`` of repeated strings, overlapping; ``rk, text`` of the texts that may have some).

    ``keyed`` has ``rk``, a key that equal texts share, and ``text``.
    """
    every = save(_anchors(keyed, length, gram), "suffix-anchors")
    keys = every.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("sig") != F.max("sig")).alias("mixed")).where("n > 1")
    some = save(hot_join(every, save(keys, "suffix-keys"), ["anchor"]).drop("n"), "suffix-shared")
    counted = some.groupBy("anchor", "sig", "mixed").agg(F.count("*").alias("n"), F.min(F.struct("rk", "at", "lo", "hi")).alias("x"))
    counted = save(counted.select("anchor", "sig", "mixed", "n", "x.*"), "suffix-contexts")
    whole = hot_join(some, counted.where("n > 1").select("anchor", "sig", "n"), ["anchor", "sig"]).select("rk", F.col("lo").alias("begin"), (F.col("hi") + length).alias("stop"))

    owners = some.select("rk").distinct()
    owners = F.broadcast(owners) if owners.count() <= BROADCAST_ROWS else owners
    held = save(keyed.join(owners, "rk", "left_semi").dropDuplicates(["rk"]), "suffix-texts")

    mixed = counted.where("mixed")
    own = mixed.groupBy("rk").agg(F.collect_list(F.struct("anchor", "n", "at", "lo", "hi", (F.col("hi") + length).alias("end"))).alias("runs"))
    contexts = _cut(held.join(own, "rk"))
    hot = mixed.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > sort_limit).select("anchor")
    rest, spans = contexts, whole
    if hot.limit(1).count():
        hot, contexts = save(hot, "suffix-hot"), save(contexts, "suffix-bytes")
        rest = contexts.join(hot, "anchor", "left_anti")
        spans = whole.unionByName(_counted_repeats(contexts.join(hot, "anchor", "left_semi"), length))
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = rest.select("rk", "anchor", "n", "at", "lo", "hi", "bytes").repartition(n, "anchor").sortWithinPartitions("anchor")
    return spans.unionByName(_sorted_repeats(sort, length)), held


def remove_repeats(docs: DataFrame, *, text_col: str = "text", length: int = 400, gram: int = 128, sort_limit: int = 50_000, with_text: bool = True) -> DataFrame:
    """Each row's other columns, then ``n_bytes, n_removed, n_spans, spans, kept_sha256`` and, if asked for, ``kept_text``.

    Every byte covered by a string of ``length`` bytes that starts anywhere else too, in the same
    document or another, is removed; strings are judged on the input. A null text counts as empty.
    Repeated rows are documents of their own, so a copy of ``length`` bytes or more removes the whole
    text from every copy. ``spans`` are the maximal removed runs, as byte offsets. ``kept_text`` is what
    is left as UTF-8; bytes of a character that was cut are left out of it (not of the digest). An empty
    table gives no rows. The text column goes; columns of the names above are replaced.
    """
    text = F.coalesce(column(text_col), F.lit(""))
    names = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept_text")]
    spans, held = repeated_spans(docs.select(text.alias("text")).select(F.unhex(F.md5("text")).alias("rk"), "text"), length, gram, sort_limit)
    own = spans.groupBy("rk").agg(F.collect_set(F.struct("begin", "stop")).alias("found"))
    schema = "rk binary, n_removed long, n_spans long, spans array<struct<begin:long,stop:long>>, sha string" + ", kept string" * with_text
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for rk, text, found in zip(batch.column("rk"), batch.column("text"), batch.column("found"), strict=True):
                data, merged = memoryview(text.as_buffer()).tobytes(), []
                for x in sorted(found.as_py(), key=lambda x: (x["begin"], x["stop"])):
                    if merged and x["begin"] <= merged[-1]["stop"]:
                        merged[-1]["stop"] = max(merged[-1]["stop"], x["stop"])
                    else:
                        merged.append(dict(x))
                edges = [0, *(e for x in merged for e in (x["begin"], x["stop"])), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                made.append((rk.as_py(), len(data) - len(kept), len(merged), merged, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "ignore")] * with_text)))
            cols = list(zip(*made, strict=True)) if made else [[]] * (5 + with_text)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), kind, pa.string(), pa.string()), strict=False)], ["rk", "n_removed", "n_spans", "spans", "sha", "kept"][: 5 + with_text])

    cut = held.join(own, "rk").mapInArrow(run, schema)
    plain = docs.select(carried(names).alias("own"), text.alias("text")).select("own", F.unhex(F.md5("text")).alias("rk"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("plain_sha"), *(["text"] * with_text))
    cut = cut.select("rk", F.struct("n_removed", "n_spans", "spans", "sha", *(["kept"] * with_text)).alias("cut"))
    none = F.lit(0).cast("long")
    return plain.join(cut, "rk", "left").select(
        *given_back("own", names).values(), "n_bytes", F.coalesce("cut.n_removed", none).alias("n_removed"), F.coalesce("cut.n_spans", none).alias("n_spans"), F.col("cut.spans").alias("spans"),
        F.coalesce("cut.sha", "plain_sha").alias("kept_sha256"), *([F.coalesce("cut.kept", "text").alias("kept_text")] * with_text),
    )


def op1_suffix(spark, sf_dir: str) -> DataFrame:
    """400-byte repeats removed from the whole ``documents`` table."""
    return remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _sql(length: int = 400) -> str:
    """Hashes of all strings of ``length`` bytes, by doubling, and the bytes that repeated ones cover."""
    place = "PARTITION BY rid ORDER BY i"
    out = f"""d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS x FROM documents),
b AS (SELECT rid, unnest(range(len(x))) AS i, unnest(x) AS c, len(x) AS n FROM d), h1 AS (SELECT *, hash(c) AS k FROM b)"""
    size = 1
    while 2 * size <= length:
        out += f", h{2 * size} AS (SELECT rid, i, c, n, hash(k, lead(k, {size}) OVER ({place})) AS k FROM h{size})"
        size *= 2
    if size < length:
        out += f", h{length} AS (SELECT rid, i, c, n, hash(k, lead(k, {length - size}) OVER ({place})) AS k FROM h{size})"
    return f"""WITH {out},
many AS (SELECT k FROM h{length} WHERE i + {length} <= n GROUP BY k HAVING count(*) > 1),
r AS (SELECT rid, i, c, (i + {length} <= n AND k IN (SELECT k FROM many))::INT AS twice FROM h{length}),
v AS (SELECT rid, i, c, max(twice) OVER ({place} ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) AS gone FROM r),
s AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER ({place}), 0) = 0 AS opens FROM v),
a AS (SELECT rid, sum(gone)::BIGINT AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(c, '' ORDER BY i) FILTER (gone = 0), '') AS kept FROM s GROUP BY rid)
SELECT doc_id, len(x)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (rid)"""


OP1_SQL = _sql()
