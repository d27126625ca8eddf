"""Packing: vector bin packing of token sequences by the dot-product heuristic.

An example has three demands: tokens, one segment, and loss-bearing tokens. A sequence has a limit
for each. Of the sequences still open, an example goes to the one whose free room has the largest
dot product with its demands, both as shares of the limits; where none has room, a new one opens.
Examples may be cut, so what the heuristic leaves free is then filled with pieces of the emptiest
sequences, and whatever stays short is cut down to a power of two, a length that needs no padding.

The job is one narrow pass: every task packs the rows of its own partition, holding at most
``window`` short examples, and numbers its sequences from ``partition << 40``. A task that is run
again packs the same rows in the same way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, load_tokenizer, texts, worker_cache

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, sequence_tokens long"
#: Units (words between blanks) beyond which a worker keeps those of the texts at hand alone.
CACHED_UNITS = 1_200_000


@dataclass
class Piece:
    """Tokens ``start .. start + len(ids)`` of an example of ``total`` tokens, the last ``loss`` of which bear loss."""

    key: object
    ids: np.ndarray
    start: int
    total: int
    loss: int

    @property
    def bearing(self) -> int:
        end = self.start + len(self.ids)
        return end - min(end, max(self.start, self.total - self.loss))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.key, self.ids[:n], self.start, self.total, self.loss), Piece(self.key, self.ids[n:], self.start + n, self.total, self.loss)


@dataclass
class Packer:
    """Packs a stream of examples; ``add`` and ``finish`` yield lists of pieces, one list a sequence."""

    max_tokens: int = 2048
    max_segments: int = 256
    max_loss: int = 2048
    window: int = 2048
    waiting: list[Piece] = field(default_factory=list)

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """A whole example; full-length pieces leave at once as sequences of their own."""
        while len(piece.ids) >= self.max_tokens or piece.bearing > self.max_loss:
            n = self._room(piece, self.max_tokens, self.max_loss)
            head, piece = piece.cut(n)
            if n == self.max_tokens:
                yield [head]
            else:
                yield from self._whole([head])
        if len(piece.ids):
            self.waiting.append(piece)
        if len(self.waiting) >= self.window:
            yield from self._pack(last=False)

    def finish(self) -> Iterator[list[Piece]]:
        yield from self._pack(last=True)

    def _room(self, piece: Piece, tokens: int, loss: int) -> int:
        """How many of a piece's first tokens fit in so much room."""
        free = max(0, len(piece.ids) - piece.bearing)  # those before the first that bears loss
        return min(len(piece.ids), tokens, free + loss)

    def _place(self, pieces: list[Piece]) -> list[list[Piece]]:
        """First the dot-product heuristic, largest demands first."""
        limits = np.array([self.max_tokens, self.max_segments, self.max_loss], float)
        need = np.array([(len(p.ids), 1, p.bearing) for p in pieces], float) / limits
        room = np.zeros((len(pieces), 3))
        bins: list[list[Piece]] = []
        for i in np.argsort(-need.sum(axis=1), kind="stable"):
            fits = (room[: len(bins)] >= need[i] - 1e-9).all(axis=1)
            best = int(np.where(fits, room[: len(bins)] @ need[i], -1.0).argmax()) if fits.any() else -1
            if best < 0:
                best = len(bins)
                bins.append([])
                room[best] = 1.0
            bins[best].append(pieces[i])
            room[best] -= need[i]
        return bins

    def _pack(self, last: bool) -> Iterator[list[Piece]]:
        pieces, self.waiting = self.waiting, []
        if not pieces:
            return
        size = lambda b: sum(len(p.ids) for p in b)
        bins = sorted(self._place(pieces), key=size, reverse=True)
        spare = [p for b in reversed(bins) for p in b]  # of the emptiest first, taken from the front
        open_from = len(bins)
        rest: list[Piece] = []
        i = 0
        while i < open_from:
            b = list(bins[i])
            gap, seg, loss = self.max_tokens - size(b), self.max_segments - len(b), self.max_loss - sum(p.bearing for p in b)
            while gap > 0 and seg > 0 and (rest or open_from > i + 1):
                if not rest:
                    open_from -= 1
                    rest = list(bins[open_from])
                    continue
                n = self._room(rest[-1], gap, loss)
                if n == 0:
                    break
                head, tail = rest.pop().cut(n)
                b.append(head)
                gap, seg, loss = gap - n, seg - 1, loss - head.bearing
                if len(tail.ids):
                    rest.append(tail)
            if i + 1 < open_from or gap == 0:
                yield from self._whole(b)
            else:
                rest += b
            i += 1
        self.waiting = rest
        if last and rest:
            self.waiting = []
            while rest:
                b, rest = self._take(rest)
                yield from self._whole(b)

    def _take(self, pieces: list[Piece]) -> tuple[list[Piece], list[Piece]]:
        """As much from the front as one sequence may hold, and what is left."""
        b: list[Piece] = []
        gap, loss = self.max_tokens, self.max_loss
        while pieces and gap and len(b) < self.max_segments:
            n = self._room(pieces[0], gap, loss)
            if n == 0:
                break
            head, tail = pieces[0].cut(n)
            b.append(head)
            gap, loss = gap - n, loss - head.bearing
            pieces = ([tail] if len(tail.ids) else []) + pieces[1:]
        return b, pieces

    def _whole(self, b: list[Piece]) -> Iterator[list[Piece]]:
        """A full sequence as it is; a shorter one in lengths that are powers of two, longest first."""
        total = sum(len(p.ids) for p in b)
        while total:
            n = self.max_tokens if total >= self.max_tokens else 1 << (total.bit_length() - 1)
            out, need = [], n
            while need:
                p = b.pop(0)
                if len(p.ids) > need:
                    p, tail = p.cut(need)
                    b.insert(0, tail)
                out.append(p)
                need -= len(p.ids)
            yield out
            total -= n


class Units:
    """The ids of units (words between blanks) as little-endian 32-bit numbers, each encoded once a worker.

    Three short cuts: units are encoded many at a time with an added token between them, and cut where it
    stands; a letter's run of punctuation after it is encoded apart; and units are looked up before. The
    first two hold for tokenizers that find added tokens before all else and split after letters; they
    are used only if the first 500 units come out as each on its own. Units that may hold an added token
    are always encoded on their own.
    """

    TAIL = ".,;:!?#*$%&|>"

    def __init__(self, tok):
        self.tok, self.known, self.tried, self.mark = tok, {}, False, ""
        added = tok.get_added_tokens_decoder()
        plain = all(t.content and t.content.count(t.content[0]) == 1 and not (t.lstrip or t.rstrip or t.single_word or t.normalized) for t in added.values())
        if added and plain and len({t.content[0] for t in added.values()}) == 1:
            self.id = max(added)
            self.mark = added[self.id].content

    def alone(self, units: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(units, add_special_tokens=False)]

    def joined(self, units: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(units), 1000):
            ids = np.array(self.tok.encode_batch_fast([self.mark.join(units[i : i + 1000])], add_special_tokens=False)[0].ids, "<u4")
            raw, cuts = ids.tobytes(), np.nonzero(ids == self.id)[0] * 4
            out += [raw[x:y] for x, y in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)], strict=True)]
        return out

    def parted(self, units: list[str]) -> list[bytes]:
        """``joined``, with tails apart."""
        stems = [u.rstrip(self.TAIL) for u in units]
        stems = [s if s and s[-1].isalpha() else u for s, u in zip(stems, units, strict=True)]
        tails = [u[len(s) :] for s, u in zip(stems, units, strict=True)]
        new = list(set(stems).union(tails).difference(self.known))
        found = dict(zip(new, self.joined(new), strict=True))
        self.known.update(found)
        return [self.known[s] + self.known[t] if t else self.known[s] for s, t in zip(stems, tails, strict=True)]

    def learn(self, new: list[str]) -> None:
        plain = [u for u in new if self.mark and self.mark[0] not in u]
        if plain and not self.tried:
            self.tried, some = True, plain[:500]
            if self.parted(some) != self.alone(some):
                self.mark, plain = "", []
                self.known.clear()
        apart = [u for u in new if not self.mark or self.mark[0] in u]
        if plain:
            self.known.update(zip(plain, self.parted(plain), strict=True))
        self.known.update(zip(apart, self.alone(apart), strict=True))


def encode_units(texts_: list[str | None], path: str) -> Iterator[bytes]:
    """Each text's ids: a text is cut at blanks and line feeds, which this vocabulary drops."""
    cache = worker_cache()
    if ("units", path) not in cache:
        cache["units", path] = Units(load_tokenizer(path))
    own: Units = cache["units", path]
    units = [t.replace("\n", " ").split(" ") if t else [] for t in texts_]
    here = set().union(*units)
    if len(own.known) > CACHED_UNITS:  # frequent units are in these texts too
        own.known = {u: own.known[u] for u in here.intersection(own.known)}
    own.learn(list(here.difference(own.known)))
    get = own.known.__getitem__
    for u in units:
        yield b"".join(map(get, u))


def pack_texts(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, loss_from_col: str | None = None,
    max_tokens: int = 2048, max_segments: int = 256, max_loss: int | None = None, window: int = 2048,
) -> DataFrame:
    """One row for each piece of each document: ``PIECES``.

    A document's tokens are its text's ids (null or empty text: none) and ``end_id``. ``loss_from_col``
    names a column with the number of leading tokens that bear no loss (null: none; absent: every token
    bears loss). Null ids stay null and rows with the same id are packed each on its own; an empty table
    gives no rows; other columns are ignored. ``max_tokens`` has to be a power of two.
    """
    from pyspark.sql import functions as F

    if max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens has to be a power of two")
    limit_loss = max_tokens if max_loss is None else max_loss
    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"), (F.coalesce(column(loss_from_col), F.lit(0)) if loss_from_col else F.lit(0)).cast("long").alias("head"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, number = Packer(max_tokens, max_segments, limit_loss, window), TaskContext.get().partitionId() << 40

        def out(sequences: Iterable[list[Piece]]) -> Iterator[tuple]:
            nonlocal number
            for seq in sequences:
                at, total = 0, sum(len(p.ids) for p in seq)
                for p in seq:
                    yield p.key, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.total, number, at, p.bearing, total
                    at += len(p.ids)
                number += 1

        names = [c.split()[0] for c in PIECES.split(", ")]
        batch_of = lambda rs: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rs, strict=True) if rs else [[]] * len(names))], names)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys, heads = batch.column("doc_id").to_pylist(), batch.column("head").to_pylist()
            for i in range(0, batch.num_rows, 500):  # long texts: a few MB at a time
                made: list[tuple] = []
                for key, head, raw in zip(keys[i : i + 500], heads[i : i + 500], encode_units(batch.column("text").slice(i, 500).to_pylist(), tokenizer_path), strict=True):
                    ids = np.frombuffer(raw + end, "<u4")
                    made += out(packer.add(Piece(key, ids, 0, len(ids), len(ids) - min(len(ids), max(0, head)))))
                yield batch_of(made)
        yield batch_of(list(out(packer.finish())))

    return rows.mapInArrow(run, PIECES)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table in sequences of at most 2048 tokens of word_bpe_49k, each document ended by id 1."""
    import public_tokenizers

    from .common import read

    return pack_texts(texts(read(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"))
