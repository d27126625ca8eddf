"""Language identification by prediction with partial matching.

For each language a tree of byte contexts up to three bytes deep counts what followed each context.
A byte's code length is that of its count in the longest context known, with an escape (method C:
as many escapes as distinct followers) for every context that has not seen it, down to the uniform
byte. With the statistics frozen, a text's code length in a language is a sum over its bytes, and the
language with the shortest code is predicted.

Counting is one aggregation of byte strings of one to four bytes over all labelled texts, counted
first in each task. All languages and all counted strings are kept, in a table in the shared folder.
Languages are scored in groups: a group's trees are collected and broadcast by themselves, at most
``GROUP`` strings unless one language has more, and a worker holds one group at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, forget, read, save

ORDER, PAD = 3, b"\n\n\n"
SEGMENT = 1 << 20
#: Strings in a group of languages, and code lengths in its table.
GROUP, TABLE = 4_000_000, 1 << 26


def grams(data: np.ndarray) -> np.ndarray:
    """The 4-byte strings that end at each byte from the fourth on, as numbers."""
    x = data.astype(np.uint32)
    return (x[:-3] << np.uint32(24)) | (x[1:-2] << np.uint32(16)) | (x[2:-1] << np.uint32(8)) | x[3:]


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([a[1], b[1]]), len(codes)).astype(np.int64)


@dataclass
class Tree:
    """Sorted byte strings of each length with their counts; contexts' totals and distinct followers."""

    codes: list[np.ndarray]
    counts: list[np.ndarray]

    def __post_init__(self):
        self.contexts, self.totals, self.kinds = [], [], []
        for codes, counts in zip(self.codes, self.counts, strict=True):
            ctx, at = np.unique(codes >> np.uint32(8), return_inverse=True)
            self.contexts.append(ctx)
            self.totals.append(np.bincount(at, counts, len(ctx)))
            self.kinds.append(np.bincount(at, minlength=len(ctx)).astype(np.float64))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code lengths of the last byte of 4-byte strings after the first three."""
        out, open_ = np.zeros(len(codes)), np.ones(len(codes), bool)
        for n in range(ORDER, -1, -1):
            own = codes & np.uint32((1 << (8 * (n + 1))) - 1)
            ctx = own >> np.uint32(8) if n else np.zeros(len(own), np.uint32)
            if not len(self.codes[n]):
                continue
            i = np.searchsorted(self.contexts[n], ctx).clip(max=len(self.contexts[n]) - 1)
            seen = open_ & (self.contexts[n][i] == ctx)
            whole = self.totals[n][i] + self.kinds[n][i]
            j = np.searchsorted(self.codes[n], own).clip(max=len(self.codes[n]) - 1)
            hit = seen & (self.codes[n][j] == own)
            out[hit] += np.log2(whole[hit] / self.counts[n][j[hit]])
            out[seen & ~hit] += np.log2(whole[seen & ~hit] / self.kinds[n][i][seen & ~hit])
            open_ &= ~hit
        out[open_] += 8.0
        return out


@dataclass
class Model:
    """A tree for each language, in the languages' order."""

    languages: list[str]
    trees: list[Tree]

    def lookup(self):
        """All known 4-byte strings, a direct table into them, and their code lengths in every language."""
        if not hasattr(self, "_table"):
            known = np.unique(np.concatenate([t.codes[ORDER] for t in self.trees]))
            lengths = np.stack([t.bits(known) for t in self.trees], axis=1).astype(np.float32)
            slots = np.zeros(1 << 22, np.int32)
            slots[self.slot(known)] = np.arange(len(known), dtype=np.int32)
            self._table = known, lengths, slots
        return self._table

    @staticmethod
    def slot(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint32(2654435761)) >> np.uint32(10)

    def __getstate__(self):
        return {"languages": self.languages, "trees": self.trees}

    def bits(self, data: list[bytes]) -> np.ndarray:
        """Code lengths of each text in each language."""
        out = np.zeros((len(data), len(self.languages)))
        group: list[tuple[int, bytes]] = []
        size = 0
        for i, d in enumerate(data):
            if len(d) > SEGMENT:
                for at in range(0, len(d), SEGMENT):
                    out[i] += self._sums([(d[at - 3 : at] if at else PAD) + d[at : at + SEGMENT]])[0]
                continue
            if size + len(d) > SEGMENT and group:
                out[[g[0] for g in group]] = self._sums([PAD + g[1] for g in group])
                group, size = [], 0
            if d:
                group.append((i, d))
                size += len(d)
        if group:
            out[[g[0] for g in group]] = self._sums([PAD + g[1] for g in group])
        return out

    def _sums(self, padded: list[bytes]) -> np.ndarray:
        known, lengths, slots = self.lookup()
        codes = grams(np.frombuffer(b"".join(padded), np.uint8))
        i = slots[self.slot(codes)]
        miss = np.nonzero(known[i] != codes)[0] if len(known) else np.arange(len(codes))
        each = np.zeros((len(codes) + 1, len(self.trees)), np.float32)  # and a row after the last
        if len(known):
            np.take(lengths, i, axis=0, out=each[:-1], mode="clip")
        if len(miss):
            rare, at = np.unique(codes[miss], return_inverse=True)
            each[miss] = np.stack([t.bits(rare) for t in self.trees], axis=1).astype(np.float32)[at]
        sizes = np.array([len(p) for p in padded])
        start = np.cumsum(sizes) - sizes
        edges = np.stack([start, start + sizes - 3], axis=1).ravel()
        return np.add.reduceat(each, edges.clip(max=len(codes)), axis=0, dtype=np.float64)[::2]


@dataclass
class Learned:
    """All languages in order, in groups, and the table ``lang, depth, code, n`` of their strings."""

    groups: list[list[str]]
    nodes: DataFrame

    @property
    def languages(self) -> list[str]:
        return [x for group in self.groups for x in group]

    def models(self) -> Iterator[Model]:
        """The groups' models, one at a time."""
        for group in self.groups:
            found: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
            table = self.nodes.where(F.col("lang").isin(group)).sort("lang", "depth", "code").toArrow()
            lang, depth = table["lang"].combine_chunks().dictionary_encode(), table["depth"].to_numpy()
            code, n = table["code"].to_numpy().astype(np.uint32), table["n"].to_numpy().astype(np.float64)
            which = lang.indices.to_numpy().astype(np.int64) * (ORDER + 1) + depth
            cut = [0, *(np.nonzero(np.diff(which))[0] + 1).tolist(), len(which)]
            for i, j in zip(cut, cut[1:]):  # noqa: B905
                found[lang[i].as_py(), int(depth[i])] = code[i:j], n[i:j]
            yield Model(group, [Tree([found[x, d][0] for d in range(ORDER + 1)], [found[x, d][1] for d in range(ORDER + 1)]) for x in group])

    @cached_property
    def trees(self) -> list[Tree]:
        """All trees at once; nothing here needs them."""
        return [t for m in self.models() for t in m.trees]

    def bits(self, data: list[bytes]) -> np.ndarray:
        """Code lengths of each text in each language."""
        return np.concatenate([np.zeros((len(data), 0)), *(m.bits(data) for m in self.models())], axis=1)


def grouped(sizes: list[tuple[str, int]], group: int, table: int) -> list[list[str]]:
    """Languages in order, in groups of at most ``group`` strings and ``table`` code lengths, or of one language."""
    out: list[list[str]] = []
    total = 0
    for lang, n in sorted(sizes):
        total += n
        if not out or total > group or total * (len(out[-1]) + 1) > table:
            out.append([])
            total = n
        out[-1].append(lang)
    return out


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", group: int = GROUP) -> Learned:
    """Trees from every row with text and language; a null or empty text adds nothing, a null language is left out."""
    rows = docs.select(column(lang_col).alias("lang"), column(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        held: dict[str, list[np.ndarray]] = {}

        def fold(lang: str) -> None:
            codes, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            total[lang] = merged(total[lang], (codes, n)) if lang in total else (codes, n)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                data = PAD + text.as_py().encode()
                for at in range(0, len(data) - 3, SEGMENT):
                    held.setdefault(lang, []).append(grams(np.frombuffer(data[at : at + SEGMENT + 3], np.uint8)))
                    if sum(map(len, held[lang])) > 4 * SEGMENT:
                        fold(lang)
        for lang in list(held):
            fold(lang)
        for lang, (codes, n) in total.items():
            for order in range(ORDER, -1, -1):
                if order < ORDER:
                    codes, n = merged((codes & np.uint32((1 << (8 * (order + 1))) - 1), n), (codes[:0], n[:0]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(np.full(len(codes), order), pa.int32()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "depth", "code", "n"])

    nodes = rows.mapInArrow(count, "lang string, depth int, code long, n long").groupBy("lang", "depth", "code").agg(F.sum("n").alias("n"))
    nodes = save(nodes, "language-nodes")
    sizes = nodes.groupBy("lang").count().collect()
    return Learned(grouped([(r["lang"], r["count"]) for r in sizes], group, TABLE), nodes)


def predict(docs: DataFrame, model: Learned, *, text_col: str = "text", evidence: int = 16) -> DataFrame:
    """Each row with ``lang_pred, score, bits_per_byte``, from its whole text alone.

    ``lang_pred`` is the language of the shortest code (ties: the first by name), ``und`` where the text
    is null or has no letter or nothing was learned, with score 0. ``score`` is the language's share of
    the posterior if ``evidence`` bytes coded at the text's rates were seen. Repeated rows get a row
    each, an empty table gives none; all columns come back, but for those of the three names above,
    which are replaced.
    """
    sent = [docs.sparkSession.sparkContext.broadcast(m) for m in model.models()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        forget()
        letter = regex.compile(r"\p{L}")
        for batch in batches:
            text = batch.column(at_text).to_pylist()
            known = np.array([bool(t and sent and letter.search(t)) for t in text], bool)
            told, low, total = np.full(len(text), "und", object), np.full(len(text), np.inf), np.zeros(len(text))
            for part in sent if known.any() else []:
                m = part.value
                for at in range(0, len(text), 500):
                    own = np.nonzero(known[at : at + 500])[0] + at
                    data = [text[i].encode() for i in own]
                    rate = m.bits(data) / np.array([len(d) for d in data])[:, None]
                    best = rate.argmin(axis=1)
                    least = rate[np.arange(len(own)), best]
                    new = np.minimum(low[own], least)
                    total[own] = total[own] * np.exp2(-evidence * (low[own] - new)) + np.exp2(-evidence * (rate - new[:, None])).sum(axis=1)
                    won = least < low[own]
                    told[own[won]] = np.array(m.languages, object)[best[won]]
                    low[own] = new
                if len(sent) > 1 and getattr(part, "_path", None):  # it is read again for the next batch
                    del m
                    part.__dict__.pop("_value", None)
            score = np.where(known, 1 / np.where(known, total, 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told.tolist(), pa.string()), pa.array(score), pa.array(np.where(known, low, 0.0))], [*fields, "lang_pred", "score", "bits_per_byte"])

    names = [c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte")]
    at_text, fields = names.index(text_col), [f"c{i}" for i in range(len(names))]  # plain names inside
    rows = docs.select(*(column(c).alias(f) for c, f in zip(names, fields, strict=True)))
    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]
    out = rows.mapInArrow(run, T.StructType([*rows.schema.fields, *more]))
    return out.select(*(F.col(f).alias(c) for c, f in zip(names, fields, strict=True)), "lang_pred", "score", "bits_per_byte")


def held_out(id_col: str = "doc_id"):
    """Whether a document is never learned from; so is one without an id."""
    return F.coalesce(F.crc32(column(id_col).cast("string")) % 3 == 1, F.lit(True))


def op4_language(spark, sf_dir: str) -> DataFrame:
    """Learned from the labelled documents not held out, predicted for the whole ``documents`` table."""
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
