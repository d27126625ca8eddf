"""Repair of the structure of conversations: the cheapest edits that make roles follow a grammar.

A repaired conversation is empty, or has perhaps a system turn and then pairs of a user's and an
assistant's turn. The grammar has four states: nothing yet, after system, after user, after assistant;
the first and the last of them accept. A forward Viterbi pass carries for each state the least
(cost, audit string); a turn's layer is closed by inserts, of which two in a row are enough to reach
any state. Of equal costs the audit that sorts first as ASCII wins: two audits that reach a state at a
layer with equal cost have equally many inserts, so none begins with the other, and what follows
can't turn their order.

A conversation is not gathered. Its rows are numbered (``ranked``) and packed in blocks of
``BLOCK_TURNS``; a block gives, for each state that it may be entered in, the least (cost, audit) of
each state that it may be left in. These are folded block by block, in order, by a task that holds
for a conversation its audit strings alone, and each block is then told the state it is entered in
and its part of the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import column, ranked, read, save
from .merkle import _crc

#: Turns of a conversation that a task holds at a time.
BLOCK_TURNS = 4096
#: What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANKS = r"\x20\x09-\x0D"
#: States: nothing yet, after system, after user, after assistant.
STATES, ACCEPTED = range(4), (0, 3)
#: The state that a kept row of an initial leads to; an inserted or changed one leads to user or assistant.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
MADE = {0: 2, 1: 2, 2: 3, 3: 2}
ROLES = {2: "user", 3: "assistant"}
FAULTS = ("fine", "blank", "duplicate", "truncated")

Layer = list[tuple[int, str] | None]


def closed(layer: Layer) -> Layer:
    """A layer with what up to two inserts in a row reach."""
    for _ in range(2):
        new = list(layer)
        for state, best in enumerate(layer):
            if best:
                made = (best[0] + INSERT, best[1] + "I")
                to = MADE[state]
                if new[to] is None or made < new[to]:
                    new[to] = made
        layer = new
    return layer


def step(layer: Layer, initial: str, fault: int) -> Layer:
    """The layer after a turn: kept, with another role, or deleted; then closed."""
    new: Layer = [None] * 4
    more = TRUNCATED if fault == 3 else 0
    for state, best in enumerate(layer):
        if best is None:
            continue
        cost, audit = best
        ways = [(state, DELETE, "D")]
        if fault not in (1, 2):
            ways.append((MADE[state], REROLE + more, "R"))
            if (state, initial) in KEPT:
                ways.append((KEPT[state, initial], more, "K"))
        for to, price, edit in ways:
            made = (cost + price, audit + edit)
            if new[to] is None or made < new[to]:
                new[to] = made
    return closed(new)


def block_layers(initials: list[str], faults: list[int], first: bool) -> list[Layer]:
    """For each state that a block may be entered in, the layer that it is left with; the first is entered in one."""
    out: list[Layer] = []
    for state in (0,) if first else STATES:
        layer: Layer = [None] * 4
        layer[state] = (0, "")
        if first:
            layer = closed(layer)
        for initial, fault in zip(initials, faults, strict=True):
            layer = step(layer, initial, fault)
        out.append(layer)
    return out


def rebuilt(rows: list[tuple[str, str]], state: int, audit: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired rows that a part of an audit makes of a block entered in ``state``."""
    at = 0
    for edit in audit:
        if edit == "D":
            at += 1
        elif edit == "K":
            role, text = rows[at]
            state, at = KEPT[state, role[:1]], at + 1
            yield edit, role, text
        else:
            state = MADE[state]
            yield edit, ROLES[state], rows[at][1] if edit == "R" else ""
            at += edit == "R"


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """``g, block, total, rows, conv_id, firsts``: a block's rows in order, and the places of those not seen earlier."""
    rows = ranked(rows, "g", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "repair-ranked").withColumn("block", F.floor(F.col("at") / block).cast("long"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    firsts = rows.groupBy("g", digest.alias("digest")).agg(F.min("at").alias("at"))
    firsts = firsts.groupBy("g", F.floor(F.col("at") / block).cast("long").alias("block")).agg(F.collect_list("at").alias("firsts"))
    packed = rows.groupBy("g", "block", "total").agg(F.sort_array(F.collect_list(F.struct("at", "turn", "role", "text"))).alias("rows"), F.min("own").alias("conv_id"))
    return packed.join(firsts, ["g", "block"], "left").withColumn("firsts", F.coalesce("firsts", F.array().cast("array<long>")))


def _fault(text: str, first: bool) -> int:
    shown = text.rstrip(" \t\n\x0b\x0c\r")
    return 1 if not shown else 2 if not first else 3 if shown[-1] not in ".!?" else 0


#: Results that are sent together.
SENT = 2_000


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


SUMMARY = (
    "g string, block long, blocks long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_role string, last_role string, "
    "entered array<int>, left array<int>, costs array<long>, audits array<string>"
)


def _pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))  # noqa: B905


def _summaries(blocks: DataFrame, block: int) -> DataFrame:
    """What a conversation's report and best edits need of a block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = []
            for i, x in enumerate(batch.select(["g", "block", "total", "firsts"]).to_pylist()):
                rows, firsts = batch.column("rows")[i].values, set(x["firsts"])
                faults = [_fault(text, at in firsts) for text, at in zip(rows.field("text").to_pylist(), rows.field("at").to_pylist(), strict=True)]
                initials = [role[:1] for role in rows.field("role").to_pylist()]
                turns = [t for t in rows.field("turn").to_pylist() if t is not None]
                layers = block_layers(initials, faults, x["block"] == 0)
                ways = [(i, j, *best) for i, layer in enumerate(layers) for j, best in enumerate(layer) if best]
                made.append([
                    x["g"], x["block"], -(-x["total"] // block), faults.count(1), faults.count(2), faults.count(3), _pairs(initials), len(set(turns)), turns[0] if turns else None,
                    turns[-1] if turns else None, initials[0], initials[-1], *map(list, zip(*ways, strict=True)),
                ])
            if made:
                yield _batch(made, _SUMMARY)

    return blocks.drop("conv_id").mapInArrow(run, SUMMARY)


_KINDS = {"string": pa.string(), "long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
_SUMMARY = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in SUMMARY.split(", ")])
REPORT = "g string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, states array<int>, audits array<string>"
_REPORT = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in REPORT.split(", ")])


def folded(blocks: Iterable[dict]) -> dict:
    """A conversation's report from its blocks' summaries, which come in order."""
    best: Layer = []
    back: list[dict[int, tuple[int, int]]] = []  # for each block: state it is left in -> state it is entered in, edits
    sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
    low = high = role = None
    for x in blocks:
        for k in sums:
            sums[k] += x[k]
        if role is not None and role + x["first_role"] not in ("su", "ua", "au"):
            sums["illegal"] += 1
        role = x["last_role"]
        if x["first_turn"] is not None:
            sums["turns"] -= high == x["first_turn"]
            low, high = x["first_turn"] if low is None else low, x["last_turn"]
        old: Layer = best or [(0, ""), None, None, None]
        best, links = [None] * 4, {}
        for i, j, cost, audit in zip(x["entered"], x["left"], x["costs"], x["audits"], strict=True):
            if old[i] is not None:
                made = (old[i][0] + cost, old[i][1] + audit)
                if best[j] is None or made < best[j]:
                    best[j], links[j] = made, (i, len(audit))
        back.append(links)
    state = min((s for s in ACCEPTED if best[s]), key=lambda s: best[s])
    cost, audit = best[state]
    states, parts, end = [], [], len(audit)
    for links in reversed(back):
        state, n = links[state]
        states.append(state)
        parts.append(audit[end - n : end])
        end -= n
    gaps = 0 if low is None else high - low + 1 - sums.pop("turns")
    return {"gaps": gaps, **{k: sums[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit, "states": states[::-1], "audits": parts[::-1]}


def _folded(summaries: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, made = (x for batch in batches for x in batch.to_pylist()), []
        for g, own in groupby(rows, key=lambda x: x["g"]):
            made.append([g, *folded(own).values()])
            if len(made) >= SENT:
                yield _batch(made, _REPORT)
                made = []
        if made:
            yield _batch(made, _REPORT)

    n = int(summaries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return summaries.repartition(n, "g").sortWithinPartitions("g", "block").mapInArrow(run, REPORT)


def repair(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK_TURNS) -> tuple[DataFrame, DataFrame]:
    """(a report a conversation, the repaired turns).

    The report has ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``; the repaired
    turns are ``conv_id, block, place, edit, role, text``, in order by (block, place). Turns are taken
    in the order of their number (null first, ties by role and text); a null role or text counts as one
    space, an empty role fits nowhere, and rows without id are one conversation. Repeated rows are duplicates like any other;
    an empty table gives no rows; texts of any length and other columns' names are no matter.
    """
    g = F.coalesce(F.concat(F.lit("="), column(id_col).cast("string")), F.lit(""))
    text = lambda c: F.coalesce(column(c).cast("string"), F.lit(" "))
    rows = turns.select(g.alias("g"), column(id_col).alias("own"), column(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    blocks = save(_blocks(rows, block), "repair-blocks")
    report = save(_folded(save(_summaries(blocks, block), "repair-summaries")), "repair-report")
    parts = report.select("g", F.posexplode(F.arrays_zip("states", "audits")).alias("block", "x")).select("g", F.col("block").cast("long").alias("block"), F.col("x.states").alias("state"), F.col("x.audits").alias("audit"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, held = batch.column("rows"), []

            def out() -> pa.RecordBatch:
                of, no, place, *columns = zip(*held, strict=True)
                return pa.RecordBatch.from_arrays([batch.column("conv_id").take(pa.array(of, pa.int32())), pa.array(no, pa.int64()), pa.array(place, pa.int64()), *(pa.array(c, pa.string()) for c in columns)], names)

            for i, (no, state, audit) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "state", "audit")), strict=True)):
                x = own[i].values
                held += [(i, no, k, *made) for k, made in enumerate(rebuilt(list(zip(x.field("role").to_pylist(), x.field("text").to_pylist(), strict=True)), state, audit))]
                if len(held) >= SENT:
                    yield out()
                    held.clear()
            if held:
                yield out()

    names = ["conv_id", "block", "place", "edit", "role", "text"]
    more = [T.StructField(c, t) for c, t in (("block", T.LongType()), ("place", T.LongType()), ("edit", T.StringType()), ("role", T.StringType()), ("text", T.StringType()))]
    repaired = blocks.drop("total", "firsts").join(parts, ["g", "block"]).mapInArrow(run, T.StructType([blocks.schema["conv_id"], *more]))
    named = report.drop("states", "audits").join(blocks.where("block = 0").select("g", "conv_id"), "g")
    return named.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), repaired


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: of ``role:text`` of a conversation's repaired turns, joined by line feeds; they stream by."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, made = (x for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "line")), strict=True)), []
        plain = pa.schema([("conv_id", kind), ("repaired_sha256", pa.string())])
        for conv_id, own in groupby(rows, key=lambda x: x[0]):
            sha = hashlib.sha256()
            for i, (_, line) in enumerate(own):
                sha.update((b"\n" if i else b"") + line.encode())
            made.append([conv_id, sha.hexdigest()])
            if len(made) >= SENT:
                yield _batch(made, plain)
                made = []
        if made:
            yield _batch(made, plain)

    schema = T.StructType([repaired.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    kind = to_arrow_type(schema["conv_id"].dataType)
    n = int(repaired.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = repaired.select("conv_id", "block", "place", F.concat("role", F.lit(":"), "text").alias("line")).repartition(n, "conv_id").sortWithinPartitions("conv_id", "block", "place")
    return lines.select("conv_id", "line").mapInArrow(run, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults put in by the CRC-32 of ``conv_id:turn``; nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    body = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), body.alias("text"), F.explode(times).alias("copy")).drop("copy")


def damaged_and_repaired(turns: DataFrame, block: int = BLOCK_TURNS) -> DataFrame:
    """A row for each conversation of ``turns``: its damaged rows' report and the digest of what they are repaired to."""
    report, repaired = repair(damaged(turns), block=block)
    told = report.join(digests(repaired).withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id").withColumnRenamed("conv_id", "id")
    every = turns.select("conv_id").distinct().join(told, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op13_repair(spark, sf_dir: str) -> DataFrame:
    """The whole ``conversations`` table, damaged and repaired."""
    return damaged_and_repaired(read(spark, sf_dir, "conversations"))


def _sql() -> str:
    def way(state: str, price: str, edit: str, line: str = "''") -> str:
        s = f"{state}.s"
        return f"CASE WHEN {state} IS NOT NULL THEN {{'s': lpad((substring({s}, 1, 9)::BIGINT + {price})::VARCHAR, 9, '0') || substring({s}, 10) || '{edit}', 't': {state}.t || {line}}} END"

    turn = lambda role: f"chr(10) || {role} || ':' || body"
    kept = lambda b, state: f"CASE WHEN f NOT IN (1, 2) AND b = '{b}' THEN {way(state, 'm', 'K', turn('role'))} END"
    other = lambda role, state: f"CASE WHEN f NOT IN (1, 2) THEN {way(state, '3 + m', 'R', turn(repr(role)))} END"
    made = lambda role, state: way(state, "3", "I", f"chr(10) || '{role}:'")
    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    deleted = [way(f"s{k}", "4", "D") for k in range(4)]
    layer = [
        deleted[0], least(deleted[1], kept("s", "s0")), least(deleted[2], *(x for k in (0, 1, 3) for x in (other("user", f"s{k}"), kept("u", f"s{k}")))),
        least(deleted[3], other("assistant", "s2"), kept("a", "s2")),
    ]
    close = f"s0, s1, {least('s2', *(made('user', f's{k}') for k in (0, 1, 3)))} AS s2, {least('s3', made('assistant', 's2'))} AS s3"
    twice = lambda rows: f"SELECT k, i, {close} FROM (SELECT k, i, {close} FROM ({rows}))"
    start = "SELECT k, 0::BIGINT AS i, {'s': '000000000', 't': ''} AS s0, NULL::STRUCT(s VARCHAR, t VARCHAR) AS s1, NULL::STRUCT(s VARCHAR, t VARCHAR) AS s2, NULL::STRUCT(s VARCHAR, t VARCHAR) AS s3 FROM ids"
    crc = _crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    return f"""WITH RECURSIVE ids AS (SELECT DISTINCT conv_id, coalesce('=' || conv_id, '') AS k FROM conversations),
d AS (SELECT coalesce('=' || conv_id, '') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations),
e AS (SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS body, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) FROM d WHERE kind <> 0),
o AS (SELECT k, turn, role, body, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, body) AS i, substring(role, 1, 1) AS b FROM e),
r AS (SELECT *, CASE WHEN f = 3 THEN 3 ELSE 0 END AS m FROM (SELECT *, CASE WHEN NOT regexp_matches(body, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY k, role, body ORDER BY i) > 1 THEN 2
  WHEN regexp_extract(body, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f, lag(b) OVER (PARTITION BY k ORDER BY i) AS before FROM o)),
a AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || b NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM r GROUP BY k),
v AS ({twice(start)} UNION ALL {twice(f"SELECT v.k, r.i, {layer[0]} AS s0, {layer[1]} AS s1, {layer[2]} AS s2, {layer[3]} AS s3 FROM v JOIN r ON r.k = v.k AND r.i = v.i + 1")}),
z AS (SELECT v.k, list_min([s0, s3]) AS best FROM v JOIN a ON a.k = v.k AND a.n = v.i)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(substring(best.s, 1, 9)::BIGINT, 0) AS cost, coalesce(substring(best.s, 10), '') AS audit, sha256(coalesce(substring(best.t, 2), '')) AS repaired_sha256
FROM ids LEFT JOIN a USING (k) LEFT JOIN z USING (k)"""


OP13_SQL = _sql()
