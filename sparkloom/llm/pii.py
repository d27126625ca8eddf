"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

Tokens are runs of letters, runs of digits and single other characters; a line's tokens are a chain.
A token's shape is its kind, case and length, or the character itself, and whether a blank comes
before it. The field's features are the shapes up to ``REACH`` tokens away and the labels' succession;
labels are outside, and begin and inside of each kind. It is trained by likelihood (forward-backward,
Adam, an L2 penalty) on a small labelled table, of which at most ``max_rows`` rows are taken. The
weights are about a hundred kilobytes and go to the tasks with the function.

Decoding is Viterbi's in numpy, over many chains at a time. Most tokens need no table: where a span
over a token loses more by the token than the rest of it could gain, the best path is proven to be
outside there (``Field.certain``), and what lies on the two sides of such a token doesn't depend on
each other. Only the stretches between are decoded; the result is the whole chain's. Spans that the
field finds stay if they pass an exact check (digits' number and Luhn, parts of an address, a domain)
and overlap nothing that is there already.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, forget, read, worker_cache

# Kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

REACH = 5
LABELS = 1 + 2 * len(KINDS)
CASES, LENGTHS, NUMBERS = 4, 6, 20
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WORD, _DIGITS, _MARK = 1, 1 + CASES * LENGTHS + 2, 1 + CASES * LENGTHS + 2 + NUMBERS
#: Shapes, with and without a blank before; 0 is beyond the line.
SHAPES = 1 + 2 * (CASES * LENGTHS + 2 + NUMBERS + len(MARKS) + 1)
#: Characters that are scanned together.
SCAN_CHARS = 2_000_000
BLANK, LOWER, UPPER, DIGIT, OTHER, FEED = range(6)


# ---- patterns


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern ``[A-Za-z0-9._%+-]+@`` and a domain would match from the left, in linear time: from sign to sign."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and (c := text[begin - 1]) < "\x80" and (c.isalnum() or c in "._%+-"):
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the fixed patterns find, each kind's from the left without overlap; what fails its check is dropped."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


OBFUSCATED = ((re.compile(r"\s*[\[(]\s*at\s*[\])]\s*|\s+at\s+|\s+@\s*|\s*@\s+", re.I), "@"), (re.compile(r"\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+", re.I), "."))


def passes(kind: int, found: str) -> bool:
    """The exact check of a span that the field finds."""
    digits = re.sub(r"[^0-9]", "", found)
    if kind == 0:
        for pattern, sign in OBFUSCATED:
            found = pattern.sub(sign, found)
        return next(emails(found), None) == (0, len(found))
    if kind == 1:
        parts = re.split(r"\s*\[?\.\]?\s*|\s+dot\s+|\s*\(dot\)\s*", found)
        return len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", p) and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and bool(re.fullmatch(r"[0-9]+([ .-]?[0-9]+)*", found)) and luhn(digits)
    return 8 <= len(digits) <= 15 and bool(re.fullmatch(r"\+?[0-9(][0-9 ().-]*[0-9]", found)) and bool(re.search(r"[0-9)][ .-]+[0-9(]", found))


# ---- tokens


def _classes() -> np.ndarray:
    out = np.full(0x3001, OTHER, np.uint8)
    for i in range(len(out)):
        c = chr(i)
        out[i] = FEED if c == "\n" else BLANK if c.isspace() else DIGIT if c in "0123456789" else (UPPER if c.isupper() else LOWER) if c.isalpha() else OTHER
    return out


def _tables() -> tuple[np.ndarray, np.ndarray]:
    cache = worker_cache()
    if "pii" not in cache:
        marks = np.full(0x3001, len(MARKS), np.int64)
        marks[[ord(c) for c in MARKS]] = np.arange(len(MARKS))
        cache["pii"] = _classes(), marks
    return cache["pii"]


_BUCKETS = np.array([0, 0, 1, 2, 3, 3, 4, 4, 4, 5])


def tokens(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begins, ends, shapes and lines of a text's tokens."""
    classes, marks = _tables()
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = classes[np.minimum(code, 0x3000)]
    kind[code > 0x3000] = LOWER  # scripts without case; signs up there count with them
    group = kind.copy()
    group[group == UPPER] = LOWER
    group[group == FEED] = BLANK
    new = np.empty(len(group), bool)
    new[:1] = True
    new[1:] = (group[1:] != group[:-1]) | (group[1:] == OTHER)
    cut = np.nonzero(new)[0]
    ends = np.append(cut[1:], len(group))[group[cut] != BLANK]
    begins = cut[group[cut] != BLANK]
    if not len(begins):
        return (np.zeros(0, np.int64),) * 4
    size, first = ends - begins, group[begins]
    capitals = np.concatenate([[0], np.cumsum(kind == UPPER)])
    upper = capitals[ends] - capitals[begins]
    case = np.where(upper == 0, 0, np.where(upper == size, 2, np.where((upper == 1) & (kind[begins] == UPPER), 1, 3)))
    shape = _WORD + case * LENGTHS + _BUCKETS[np.minimum(size, 9)]
    low = code | np.uint32(32)
    two, three = (first == LOWER) & (size == 2), (first == LOWER) & (size == 3)
    at, last = begins, len(code) - 1
    shape = np.where(two & (low[at] == 97) & (low[np.minimum(at + 1, last)] == 116), _WORD + CASES * LENGTHS, shape)
    shape = np.where(three & (low[at] == 100) & (low[np.minimum(at + 1, last)] == 111) & (low[np.minimum(at + 2, last)] == 116), _WORD + CASES * LENGTHS + 1, shape)
    shape = np.where(first == DIGIT, _DIGITS + np.minimum(size, NUMBERS) - 1, shape)
    shape = np.where(first == OTHER, _MARK + marks[np.minimum(code[begins], 0x3000)], shape)
    open_ = (begins == 0) | (group[np.maximum(begins - 1, 0)] == BLANK)
    line = np.cumsum(kind == FEED)[begins]
    return begins, ends, 2 * shape - open_, line


def placed(shape: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shapes with ``REACH`` zeros before, between and after lines, and each token's place among them."""
    rank = np.cumsum(np.concatenate([[0], line[1:] != line[:-1]])) if len(line) else line
    at = np.arange(len(shape)) + REACH * (rank + 1)
    out = np.zeros(len(shape) + REACH * (int(rank[-1]) + 2 if len(rank) else 2), np.int64)
    out[at] = shape
    return out, at


# ---- the field


def allowed() -> np.ndarray:
    """Which label may follow which: inside comes after begin or inside of its kind."""
    out = np.ones((LABELS, LABELS), bool)
    for inside in range(2, LABELS, 2):
        out[:, inside] = False
        out[[inside - 1, inside], inside] = True
    return out


class Field:
    """``weights[offset, shape, label]`` and ``steps[label, label]``."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, np.where(allowed(), steps, -np.inf).astype(np.float32)

    def emissions(self, shapes: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), LABELS), np.float32)
        for o in range(-REACH, REACH + 1):
            out += self.weights[o + REACH][shapes[at + o]]
        return out

    def certain(self, score: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Tokens where the best path is proven to be outside; ``first`` tells the first tokens of lines.

        A span over a token may be cut there: what is before it stays, the token and what follows go
        outside. That is better if the token's own loss is greater than the most that the span's rest
        could gain (a running maximum of sums from the right) and than what steps at its ends differ by.
        """
        out = np.ones(len(score), bool)
        t = self.steps.astype(np.float64)
        ends = [0, *range(1, LABELS, 2)]
        for begin in range(1, LABELS, 2):
            inside = begin + 1
            gain = score[:, inside].astype(np.float64) - score[:, 0] + (t[inside, inside] - t[0, 0])
            gain[first] = -1e4  # a span ends with its line
            sums = np.cumsum(gain)
            rest = np.maximum.accumulate(sums[::-1])[::-1] - sums  # 0 at least: the span may end here
            enter = max((t[:, y] - t[:, 0])[np.isfinite(t[:, y])].max() for y in (begin, inside))
            leave = max((t[y, ends] - t[0, ends]).max() for y in (begin, inside))
            most = enter + leave + max(0.0, t[begin, inside] - t[inside, inside])
            loss = score[:, 0] - np.maximum(score[:, begin], score[:, inside])
            out &= loss - rest - most > 1e-3  # sums in another order differ a little
        return out

    def best(self, score: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Labels of stretches that lie one after another in ``score`` and have "outside" on both sides."""
        out = np.zeros(len(score), np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        order = np.argsort(sizes, kind="stable")
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and (j + 1 - i) * int(sizes[order[j]]) <= 200_000:
                j += 1
            own = order[i:j]
            n, first, longest = sizes[own], begin[own], int(sizes[own[-1]])
            back = np.zeros((longest, len(own), LABELS), np.uint8)
            best = self.steps[0] + score[first]
            for t in range(1, longest):
                live = n > t
                ways = best[live][:, :, None] + self.steps
                back[t, live] = ways.argmax(axis=1)
                best[live] = ways.max(axis=1) + score[first[live] + t]
            label = (best + self.steps[:, 0]).argmax(axis=1)
            for t in range(longest - 1, -1, -1):
                live = np.nonzero(n > t)[0]
                out[first[live] + t] = label[live]
                if t:
                    label[live] = back[t, live, label[live]]
            i = j
        return out

    def decode(self, shape: np.ndarray, line: np.ndarray, cut: bool = True) -> np.ndarray:
        """Labels of tokens, whose lines are chains of their own."""
        score = self.emissions(*placed(shape, line))
        first = np.concatenate([[True], line[1:] != line[:-1]])
        open_ = ~self.certain(score, first) if cut else np.ones(len(score), bool)
        out, at = np.zeros(len(score), np.int64), np.nonzero(open_)[0]
        if len(at):
            edge = np.concatenate([[0], np.nonzero((np.diff(at) != 1) | first[at[1:]])[0] + 1, [len(at)]])
            out[at] = self.best(score[at], np.diff(edge))
        return out


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class _Batch:
    """Chains of like length, padded; gives the likelihood's gradient."""

    def __init__(self, chains: list[tuple[np.ndarray, np.ndarray]]):
        n, self.size = len(chains), np.array([len(s) for s, _ in chains])
        self.longest = int(self.size.max())
        self.shapes, labels = np.zeros((n, self.longest + 2 * REACH), np.int64), np.zeros((n, self.longest), np.int64)
        for i, (s, y) in enumerate(chains):
            self.shapes[i, REACH : REACH + len(s)], labels[i, : len(y)] = s, y
        self.real = np.arange(self.longest) < self.size[:, None]
        self.where = [self.shapes[:, o : o + self.longest][self.real] for o in range(2 * REACH + 1)]
        self.seen = np.eye(LABELS)[labels] * self.real[:, :, None]
        self.pair = np.zeros((LABELS, LABELS))
        np.add.at(self.pair, (labels[:, :-1][self.real[:, 1:]], labels[:, 1:][self.real[:, 1:]]), 1)
        np.add.at(self.pair, (np.zeros(n, int), labels[:, 0]), 1)
        np.add.at(self.pair, (labels[np.arange(n), self.size - 1], np.zeros(n, int)), 1)

    def gradient(self, weights: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, longest, real = len(self.size), self.longest, self.real
        t = np.where(allowed(), steps, -1e9)
        score = sum(weights[o][self.shapes[:, o : o + longest]] for o in range(2 * REACH + 1))
        ahead, behind = np.zeros((longest, n, LABELS)), np.zeros((longest, n, LABELS))
        ahead[0] = t[0] + score[:, 0]
        for k in range(1, longest):
            ahead[k] = np.where(real[:, k, None], _sum(ahead[k - 1][:, :, None] + t, 1) + score[:, k], ahead[k - 1])
        total = _sum(ahead[-1] + t[:, 0], 1)
        behind[-1] = t[:, 0]
        told = np.zeros((LABELS, LABELS))
        for k in range(longest - 2, -1, -1):
            after = score[:, k + 1] + behind[k + 1]
            behind[k] = np.where(real[:, k + 1, None], _sum(t[None] + after[:, None, :], 2), t[:, 0])
            both = np.exp(ahead[k][:, :, None] + t + after[:, None, :] - total[:, None, None])
            told += both[real[:, k + 1]].sum(axis=0)
        share = np.exp(ahead.transpose(1, 0, 2) + behind.transpose(1, 0, 2) - total[:, None, None]) * real[:, :, None]
        told[0] += share[:, 0].sum(axis=0)
        told[:, 0] += share[np.arange(n), self.size - 1].sum(axis=0)
        miss = (self.seen - share)[real]
        return np.stack([np.stack([np.bincount(w, miss[:, y], SHAPES) for y in range(LABELS)], axis=1) for w in self.where]), self.pair - told


def fit(chains: list[tuple[np.ndarray, np.ndarray]], *, epochs: int = 60, rate: float = 0.2, penalty: float = 0.02) -> Field:
    """A field from (shapes, labels) of chains, by the whole table's gradient."""
    chains = sorted(chains, key=lambda c: len(c[0]))
    batches = [_Batch(chains[k : k + 100]) for k in range(0, len(chains), 100)]
    weights, steps = np.zeros((2 * REACH + 1, SHAPES, LABELS)), np.zeros((LABELS, LABELS))
    moments = [np.zeros_like(x) for x in (weights, weights, steps, steps)]
    for epoch in range(1, epochs + 1):
        parts = [b.gradient(weights, steps) for b in batches]
        for x, at, m, v in ((weights, 0, *moments[:2]), (steps, 1, *moments[2:])):
            g = sum(part[at] for part in parts) - penalty * x
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.999 * v + 0.001 * g * g
            x += rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-6)
    return Field(weights.astype(np.float32), steps.astype(np.float32))


def chain(text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Shapes and labels of a labelled line."""
    begins, ends, shape, _ = tokens(text)
    label = np.zeros(len(begins), np.int64)
    for kind, a, b in spans:
        own = np.nonzero((begins >= a) & (ends <= b))[0]
        label[own] = 2 + 2 * kind
        label[own[:1]] = 1 + 2 * kind
    return shape, label


# ---- the labelled table


def labelled(n: int = 700, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Lines with their spans, made by a rule: prose with personal data in common and in disguised forms, and with numbers and signs that are none."""
    r = random.Random(seed)
    sounds = ["th", "an", "er", "ou", "in", "qu", "el", "ó", "sch", "eau", "é", "ung", "st", "ha"]
    word = lambda: "".join(r.choices(sounds, k=r.randint(1, 4)))
    num = lambda k: "".join(r.choices("0123456789", k=k))
    name = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9)))
    hexes = lambda k: "".join(r.choices("0123456789abcdef", k=k))
    byte = lambda: str(r.randint(0, 255))

    def card(k: int) -> str:
        head = r.choice("3456") + num(k - 2)
        return next(head + c for c in "0123456789" if luhn(head + c))

    def grouped(digits: str, sizes: list[int], sign: str) -> str:
        parts, at = [], 0
        for k in sizes:
            parts.append(digits[at : at + k])
            at += k
        return sign.join(parts)

    fours = lambda sign: grouped(card(16), [4, 4, 4, 4], sign)
    tld = lambda: r.choice(["com", "org", "net", "de", "fr", "es", "io"])
    local = lambda: r.choice([name(), f"{name()}.{num(2)}", f"{name()}_{name()}", f"{name()}{num(2)}", f"{name()}+{name()}", f"{word()}.{num(2)}"])
    host = lambda: r.choice([f"{name()}.{tld()}", f"mail{num(1)}.{name()}.{tld()}", f"{name()}-{name()}.{tld()}"])
    forms = {
        "email": [lambda: f"{local()}@{host()}"] * 3 + [
            lambda: f"{name()} at {name()} dot {tld()}", lambda: f"{name()} [at] {name()} [dot] {tld()}", lambda: f"{name()} (at) {name()}.{tld()}", lambda: f"{name()}[at]{host()}", lambda: f"{name()} @ {host()}",
            lambda: f"{name()}(at){name()}(dot){tld()}",
        ],
        "ip": [lambda: ".".join(byte() for _ in range(4))] * 3 + [lambda: "[.]".join(byte() for _ in range(4)), lambda: " . ".join(byte() for _ in range(4)), lambda: " dot ".join(byte() for _ in range(4))],
        "card": [lambda: card(16)] * 3 + [lambda: fours(" "), lambda: fours("-"), lambda: fours("."), lambda: card(15), lambda: grouped(card(15), [4, 6, 5], " "), lambda: grouped(card(15), [4, 6, 5], "-"), lambda: card(13)],
        "phone": [lambda: f"+1 ({num(3)}) 555-{num(4)}"] * 3 + [
            lambda: f"+{num(2)} {num(2)} {num(4)} {num(4)}", lambda: f"+{num(2)} {num(3)} {num(6)}", lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"{num(3)}.{num(3)}.{num(4)}",
            lambda: f"+{num(1)}-{num(3)}-{num(3)}-{num(4)}", lambda: f"00{num(2)} {num(3)} {num(6)}", lambda: f"+{num(11)}",
        ],
    }
    nothing = [
        lambda: f'{name()} = "{hexes(40)}"', lambda: f"{name()}={hexes(18)}", lambda: "AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)), lambda: f"{r.randint(0, 9)}.{r.randint(0, 9)}.", lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}",
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1900, 2030)}", lambda: f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{r.randint(1900, 2030)}", lambda: f"{r.randint(0, 23)}:{num(2)}",
        lambda: f"{r.randint(0, 23):02}:{num(2)}:{num(2)}", lambda: f"${r.randint(1, 999)},{num(3)}.{num(2)}", lambda: f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", lambda: f"{num(1)}.{num(5)}", lambda: num(r.randint(1, 12)), lambda: f"{num(2)}-{num(2)}", lambda: f"{r.randint(1900, 2000)}-{r.randint(2000, 2030)}",
        lambda: f"https://www.{name()}.{tld()}/{name()}/{num(4)}", lambda: f"{name()}.{name()}", lambda: f"@{name()}", lambda: f"{name()} at {name()}", lambda: f"dot {name()}", lambda: f"at {r.randint(1, 12)}", lambda: f"({num(2)})", lambda: f"+{num(2)}", lambda: f"[{num(1)}]", lambda: f"{num(3)} {num(3)} {num(3)}",
        lambda: f"{word()}###", lambda: f"*** {word()} %%% {word()}$$$", lambda: f"{num(2)} | {num(2)} | {num(2)}", lambda: f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", lambda: f"{num(4)} {num(4)}", lambda: " ".join(num(r.randint(1, 5)) for _ in range(6)), lambda: ", ".join(num(r.randint(1, 4)) for _ in range(6)),
    ]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(2, 6)):
            what = r.random()
            if what < 0.28:
                kind = r.choice(KINDS)
                put = r.choice(forms[kind])()
                spans.append((kind, len(text), len(text) + len(put)))
            elif what < 0.55:
                put = r.choice(nothing)()
            else:
                put = " ".join(word().capitalize() if r.random() < 0.15 else word().upper() if r.random() < 0.03 else word() for _ in range(r.randint(1, 4)))
            text += put + r.choice([" ", " ", " ", " ", ", ", ". ", ": ", "; ", ") ", " (", " | ", '" ', "%%% ", "! "])
        out.append((text.rstrip(), spans))
    return out


LABELLED = "text string, spans array<struct<kind:string,start:long,end:long>>"


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled(), LABELLED)


def train(rows: DataFrame, *, max_rows: int = 2_000, epochs: int = 60) -> Field:
    """A field from lines ``text, spans`` (places in characters, the end not included), the first ``max_rows`` by text.

    A line feed in a text counts as a blank, and a null text is passed over. It is fitted in a task.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = [x for batch in batches for x in batch.to_pylist()]
        chains = [chain(x["text"].replace("\n", " "), [(KINDS.index(s["kind"]), s["start"], s["end"]) for s in x["spans"] or ()]) for x in lines]
        chains = [c for c in chains if len(c[0])]
        if chains:
            made = fit(chains, epochs=epochs)
            yield pa.RecordBatch.from_arrays([pa.array([made.weights.tobytes()]), pa.array([np.where(allowed(), made.steps, 0).astype(np.float32).tobytes()])], ["weights", "steps"])

    own = rows.select("text", "spans").where("text IS NOT NULL").orderBy("text").limit(max_rows).coalesce(1)
    told = own.mapInArrow(run, "weights binary, steps binary").first()
    if told is None:
        raise ValueError("no labelled rows")
    return Field(np.frombuffer(told[0], np.float32).reshape(2 * REACH + 1, SHAPES, LABELS), np.frombuffer(told[1], np.float32).reshape(LABELS, LABELS))


# ---- texts


def pieces(text: str, chars: int) -> Iterator[tuple[int, str]]:
    """A text cut after line feeds, where chains end, into pieces of about ``chars`` characters or a line, with their places."""
    at = 0
    while len(text) - at > chars:
        cut = text.rfind("\n", at, at + chars)
        cut = cut if cut >= at else text.find("\n", at + chars)
        if cut < 0:
            break
        yield at, text[at:cut]
        at = cut + 1
    yield at, text[at:]


def field_spans(parts: list[str], field: Field) -> Iterator[tuple[int, int, int, int]]:
    """(part, kind, start, end) of what the field finds in texts, which are scanned together."""
    begins, ends, shape, line = tokens("\n".join(parts))
    if not len(begins):
        return
    label = field.decode(shape, line)
    edge = np.concatenate([[0], np.cumsum([len(t) + 1 for t in parts])])
    heads = np.nonzero(label % 2 == 1)[0]
    owner = np.searchsorted(edge, begins[heads], "right") - 1
    for head, i in zip(heads.tolist(), owner.tolist(), strict=True):
        last = head
        while last + 1 < len(label) and label[last + 1] == label[head] + 1:
            last += 1
        yield i, int(label[head] - 1) // 2, int(begins[head] - edge[i]), int(ends[last] - edge[i])


def found_spans(texts: list[str], field: Field, chars: int = SCAN_CHARS) -> list[list[tuple[int, int, int, bool]]]:
    """(kind, start, end, whether a fixed pattern found it) of each text, by kind and start."""
    out = [[(*s, True) for s in base_spans(t)] for t in texts]
    held: list[tuple[int, int, str]] = []

    def scan() -> None:
        for part, kind, a, b in field_spans([t for _, _, t in held], field):
            i, at, _ = held[part]
            a, b = a + at, b + at
            if not any(x < b and a < y for _, x, y, _ in out[i]) and passes(kind, texts[i][a:b]):
                out[i].append((kind, a, b, False))
        held.clear()

    size = 0
    for i, text in enumerate(texts):
        for at, part in pieces(text, chars):
            if held and size + len(part) > chars:
                scan()
                size = 0
            held.append((i, at, part))
            size += len(part)
    scan()
    return [sorted(spans) for spans in out]


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def find(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans, masked``: the spans of each row's whole text, and the text with ``<kind>`` in their places.

    Spans are ``kind, start, end`` (in characters, the end not included) and ``base``: whether a fixed
    pattern found it; by kind in the order of ``KINDS``, then start. Overlapping ones are masked as one,
    by the first. A null text has no spans and stays null, an empty one has none; a text of any length
    is decoded whole, in linear time; repeated rows get a row each, an empty table gives none, and other
    columns are not looked at.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            own = batch.column("text").to_pylist()
            told = found_spans([t or "" for t in own], field)
            spans = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in x] for x in told]
            masked = [t if not x else mask(t, x) for t, x in zip(own, told, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind), pa.array(masked, pa.string())], ["doc_id", "spans", "masked"])

    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, spans {SPANS}, masked string")


def mask(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    out, done = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= done:
            out += [text[done:a], f"<{KINDS[kind]}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of the whole ``documents`` table."""
    told = find(read(spark, sf_dir, "documents"), train(labelled_table(spark)))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return told.select("doc_id", "spans", base.alias("base")).select("doc_id", *map(count, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
