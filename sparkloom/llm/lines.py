"""Fuzzy line dedup by MinHash over character shingles, with DataFrame functions only.

A line's shingles are its substrings of ``SHINGLE`` characters; lines are duplicates if the Jaccard
similarity of their shingle sets is high enough. Every shingle is hashed, whatever the words of a line:
a line is encoded with four bytes a character, so that a shingle is a slice of bytes at a known place.
The space of hashes has eight equal parts, and a band's key hashes the three lowest hashes from the
start of a part, which two lines share with probability J**3: at 0.8, 99.7 in 100 pairs share a key.

Distinct lines with a common key are candidates. All are first held against one hub, of their keys'
hubs the one that they share most keys with; a key's hub is the line whose keys are the most common.
The pairs whose exact similarity holds are joined to components by a distributed union-find. Where a key
still has several components, its lines are put in random orders, and each is held against a few before
it: that joins nearly all of what belongs together with a number of pairs in proportion to the lines.
Then the lines outside the main component of a key are compared with all lines of other components
there, each pair under the first key that it shares. A sketch, parities of each line's hashes, drops what
can't be similar inside the joins; the exact similarity is taken from the lines themselves. One line of
each component stays, the first by document id and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, column, given_back, read, save
from .components import components, extended

SHINGLE = 8
#: Of so many hashes from the start of an eighth, with repeated shingles, the three lowest are taken.
REPEATS = 12
#: Bits of a line's sketch, and the shingles beyond which only some count for it.
BITS, THIN = 1024, 2048
BROADCAST_ROWS = 500_000
#: Each random order of a key's lines is cut in parts of about so many, and a line is held against so many before it.
PART, REACH = 512, 4
#: Seeds of the random orders.
ORDERS = (1,)


def bound(x: Column, f) -> Column:
    """f(x), with x computed once."""
    return F.transform(F.array(x), f)[0]


def every_shingle(line: Column) -> Column:
    """A hash of each shingle, in order; none for a line of fewer characters."""
    wide, step = 4 * SHINGLE, F.lit(4)
    at = lambda b: F.sequence(F.lit(1), F.octet_length(b) - wide + 1, step)
    slices = lambda b: F.transform(at(b), lambda i: F.xxhash64(F.substr(b, i, F.lit(wide))))
    return bound(F.encode(line, "UTF-32"), lambda b: F.when(F.octet_length(b) >= wide, slices(b)).otherwise(F.array().cast("array<long>")))


def postings(lines: DataFrame) -> DataFrame:
    """``h, slot, key`` for each line ``h, line``: for each eighth of the hash space, a hash of the three lowest from there on.

    The bounds of the eighths are sorted along with the hashes, so a bound's place is where its eighth
    begins; an eighth without hashes has a null key. Only the beginning of each eighth is sorted, the
    shorter the more shingles there are: of 64 to 127 in all, the three lowest of an eighth are among them.
    """
    ends = [*((p << 61) for p in range(-4, 4)), (1 << 63) - 1]
    halvings = F.floor(F.log2(F.greatest(F.size("all"), F.lit(64)) / 64)).cast("int")
    limit = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(61) - halvings)
    low = bound(limit, lambda most: F.filter("all", lambda x: x.bitwiseAND(F.lit((1 << 61) - 1)) < most))
    rows = lines.select("h", every_shingle(F.col("line")).alias("all")).select("h", F.sort_array(F.concat(low, F.array(*map(F.lit, ends)))).alias("low"))
    each = rows.select("h", "low", F.posexplode(F.array(*map(F.lit, ends[:8]))).alias("slot", "begin"))
    at = F.array_position("low", F.col("begin")).cast("int")
    key = F.when(F.get("low", at) != F.get(F.array(*map(F.lit, ends[1:])), F.col("slot")), F.xxhash64(F.slice(F.array_distinct(F.slice("low", at + 1, F.lit(REPEATS))), 1, 3)))
    return each.select("h", "slot", key.alias("key"))


def level(n: Column) -> Column:
    """How many times the shingles are halved for a sketch: as often as more than ``THIN`` would be left."""
    return F.ceil(F.log2(F.greatest(n / THIN, F.lit(1.0)))).cast("int")


def with_sketch(lines: DataFrame, key: str, percent: int) -> DataFrame:
    """``key, n, halvings, w0..``: of each line the number of shingles, and bits that each is the parity of some of them.

    Halved, those shingles count whose hash begins with so many zero bits. A line that may be similar to
    one that is halved once more has a second row, with that sketch.
    """
    words = BITS // 64
    all_ = lines.select(key, F.array_distinct(every_shingle(F.col("line"))).alias("_all")).withColumn("n", F.size("_all"))
    border = F.call_function("shiftleft", F.lit(THIN).cast("long"), level(F.col("n")))
    levels = bound(level(F.col("n")), lambda t: F.when(100 * F.col("n") >= percent * border, F.array(t, t + 1)).otherwise(F.array(t)))
    sized = all_.select(key, "n", "_all", F.explode(levels).alias("halvings")).select(key, "n", "halvings", F.explode("_all").alias("x"))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(63) - F.col("halvings"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftright", F.col("x"), F.lit(6)).bitwiseAND(F.lit(63)).cast("int"))
    word = F.col("x").bitwiseAND(F.lit(words - 1))
    some = F.col("x").bitwiseAND(F.lit((1 << 63) - 1)) < low
    parity = [F.bit_xor(F.when((F.col("halvings") == 0) | some, F.when(word == i, bit).otherwise(F.lit(0))).otherwise(F.lit(0))).alias(f"w{i}") for i in range(words)]
    return sized.groupBy(key, "n", "halvings").agg(*parity)


SKETCH = ["n", "halvings", *(f"w{i}" for i in range(BITS // 64))]


def may_be_similar(a: str, b: str, percent: int) -> Column:
    """Whether the lines of two sketches of one level, that of the longer line, can be similar.

    Similar lines have at most ``most`` shingles that one alone has. Each bit that differs needs one, so
    more bits than that can't differ; as some fall on the same bit, fewer are expected, and five standard
    deviations more (under 12 bits each) pass. Of halved shingles the number itself may deviate by five.
    """
    differ = sum((F.bit_count(F.col(f"w{i}_{a}").bitwiseXOR(F.col(f"w{i}_{b}"))) for i in range(BITS // 64)), F.lit(0))
    n, m, t = F.col(f"n_{a}"), F.col(f"n_{b}"), F.col(f"halvings_{a}")
    most = (n + m) * ((100 - percent) / (100 + percent))
    half = most / F.call_function("shiftleft", F.lit(1).cast("long"), t)
    count = F.when(t == 0, most + 1e-6).otherwise(half + 5 * F.sqrt(half))
    able = differ <= F.least(count, BITS / 2 * (1 - F.exp(-2 / BITS * count)) + 60)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (t == F.col(f"halvings_{b}")) & (t == level(F.greatest(n, m))) & able


def _similar(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of those candidate pairs whose full shingle sets are similar; ends are lines' digests."""
    for end in ("a", "b"):
        pairs = pairs.join(lines.select(F.col("h").alias(f"h{end}"), F.col("line").alias(f"line_{end}"), F.col("digest").alias(end)), f"h{end}")
    sets = F.struct(*(F.array_distinct(every_shingle(F.col(f"line_{end}"))).alias(end) for end in ("a", "b")))
    near = bound(sets, lambda z: bound(F.size(F.array_intersect(z["a"], z["b"])), lambda n: 100 * n >= percent * (F.size(z["a"]) + F.size(z["b"]) - n)))
    return save(pairs.where(near).select("a", "b"), "line-links")


def _mixed(keyed: DataFrame, roots: DataFrame) -> DataFrame:
    """``key, slot, h, root, n``: the lines of keys that have several components; n is their number."""
    at = keyed.join(roots, F.col("digest") == F.col("node"), "left").select("key", "slot", "h", F.coalesce("root", "digest").alias("root"))
    several = at.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n")
    return at.join(several, "key")


def _neighbours(at: DataFrame, seed: int) -> DataFrame:
    """``ha, hb`` of different components that lie near each other in a random order of their key's lines."""
    part = F.pmod(F.xxhash64("h", F.lit(seed)), F.ceil(F.col("n") / PART)).alias("part")
    order = Window.partitionBy("key", "part").orderBy(F.xxhash64("h", F.lit(-seed)), "h")
    before = F.array(*(F.lag(F.struct("h", "root"), i).over(order) for i in range(1, REACH + 1)))
    pairs = at.select("key", "h", "root", part).select("h", "root", before.alias("before")).select("h", "root", F.explode("before").alias("m")).where("m.root <> root")
    return pairs.select(F.least("h", "m.h").alias("ha"), F.greatest("h", "m.h").alias("hb")).distinct()


def line_places(docs: DataFrame, row: Column, doc: Column, text: Column, min_chars: int) -> DataFrame:
    """``_row, doc, at, digest`` of each line that takes part; a document's row key is made before its lines are taken apart, not once a line."""
    parts = docs.where(text.isNotNull()).select(row, doc.cast("long").alias("doc"), F.split(text, "\n").alias("lines"))
    parted = parts.select("_row", "doc", F.posexplode("lines").alias("at", "line")).where(F.length(F.trim("line")) >= min_chars)
    return parted.select("_row", "doc", "at", F.unhex(F.md5("line")).alias("digest"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, min_chars: int = 20) -> DataFrame:
    """The input with its text reduced to the lines that stay, and ``n_lines, n_removed, removed_lines``.

    Lines are split at line feeds; a line's own white space counts. Lines of fewer than ``min_chars``
    characters without the blanks around them are never removed. Of the lines that are linked, directly
    or through others, by a similarity of ``percent`` per cent or more, the one of the least document id
    and place stays; a null id comes after all others. ``removed_lines`` are places from 0. A null text stays null
    with no lines; an empty one has one line. Rows with equal id and text count as one document and
    keep the same lines. An empty table gives no rows. All columns of the input come back, but for
    those that have the three names above, which are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed_lines")]
    doc_id, text = column(id_col), column(text_col)
    row = F.md5(F.concat_ws(" ", F.coalesce(doc_id.cast("string"), F.lit("null")), text)).alias("_row")

    lines = save(line_places(docs, row, doc_id, text, min_chars), "line-places")
    all_lines = docs.where(text.isNotNull()).select(F.explode(F.split(text, "\n")).alias("line")).where(F.length(F.trim("line")) >= min_chars).withColumn("h", F.xxhash64("line"))
    posted = save(postings(all_lines), "line-postings").where("key IS NOT NULL")

    keys = posted.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n")
    shared = save(posted.join(keys, "key").distinct(), "line-shared")
    own = shared.groupBy("h").agg(F.sum("n").alias("common"), *(F.max(F.when(F.col("slot") == i, F.col("key"))).alias(f"k{i}") for i in range(8)))
    own = save(own, "line-keys")
    hubs = shared.join(own.select("h", "common"), "h").groupBy("key").agg(F.max(F.struct("common", "h"))["h"].alias("hub"))
    tried = shared.join(hubs, "key").where("h <> hub").groupBy(F.col("h").alias("ha"), F.col("hub").alias("hb")).agg(F.count("*").alias("n"))
    main = tried.groupBy("ha").agg(F.max(F.struct("n", "hb"))["hb"].alias("hb"))

    # the text of the lines that have a key in common with others
    wanted = own.select("h")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    some = all_lines.join(wanted, "h", "left_semi").distinct()
    some = save(some.withColumn("digest", F.unhex(F.md5("line"))), "line-texts")
    sketches = save(with_sketch(some, "h", percent), "line-sketches")

    def able(pairs: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(sketches.select(F.col("h").alias(f"h{end}"), *(F.col(c).alias(f"{c}_{end}") for c in SKETCH)), f"h{end}")
        return pairs.where(may_be_similar("a", "b", percent)).select("ha", "hb")

    roots = save(components(_similar(able(main), some, percent), "a", "b"), "line-roots")
    keyed = save(shared.select("key", "slot", "h").join(some.select("h", "digest"), "h"), "line-keyed")
    for seed in ORDERS:
        at = save(_mixed(keyed, roots), "line-mixed")
        roots = save(extended(roots, _similar(able(_neighbours(at, seed)), some, percent), "a", "b"), "line-roots")

    # what is left: lines outside their key's main component against those of the others
    at = _mixed(keyed, roots).join(sketches.withColumnRenamed("n", "size"), "h").join(own.drop("common"), "h").drop("n").withColumnRenamed("size", "n")
    at = save(at, "line-mixed")
    most = at.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "root"))["root"].alias("main"))
    one, two = (at.join(most, "key").select("key", *(F.col(c).alias(f"{c}_{end}") for c in ("slot", "h", "root", "main", *(f"k{i}" for i in range(8)), *SKETCH))) for end in ("a", "b"))
    met = F.expr("CASE " + " ".join(f"WHEN k{i}_a = k{i}_b THEN {i}" for i in range(8)) + " END")  # the first key in common
    once = F.expr("root_a <> root_b AND (root_b = main_b OR h_a < h_b)")
    left = one.where("root_a <> main_a").join(two, "key").where(once & (met == F.col("slot_a")) & may_be_similar("a", "b", percent)).select(F.col("h_a").alias("ha"), F.col("h_b").alias("hb"))
    roots = save(extended(roots, _similar(left, some, percent), "a", "b"), "line-roots")

    # the first place of each component, and so what goes
    place = F.struct(F.col("doc").isNull().alias("last"), "doc", "_row", "at")
    own = lines.select("_row", "doc", "at", "digest")
    alike = own.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).join(roots, F.col("digest") == F.col("node"), "left").withColumn("root", F.coalesce("root", "digest"))
    kept = save(alike.select("digest", "root", "first", "n"), "line-classes")
    many = kept.groupBy("root").agg(F.min("first").alias("stays"), F.sum("n").alias("n")).where("n > 1")
    gone = own.join(kept.join(many.drop("n"), "root").select("digest", "stays"), "digest").where((F.col("_row") != F.col("stays._row")) | (F.col("at") != F.col("stays.at")))
    gone = save(gone.groupBy("_row").agg(F.array_sort(F.collect_set("at")).alias("_gone")), "line-gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone

    others = [c for c in names if c != text_col]
    rows = docs.select(carried(others).alias("own"), text.alias("text"), row).join(gone, "_row", "left")
    text = F.col("text")
    removed = F.coalesce("_gone", F.array().cast("array<int>"))
    # what stays are the slices between places that go
    slices = lambda p: F.zip_with(F.concat(F.array(F.lit(-1)), "_gone"), F.concat("_gone", F.array(F.size(p))), lambda x, y: F.slice(p, x + 2, y - x - 1))
    stay = F.array_join(bound(F.split(text, "\n"), lambda p: F.flatten(slices(p))), "\n")
    own = given_back("own", others) | {text_col: F.when(F.col("_gone").isNotNull(), stay).otherwise(text).alias(text_col)}
    return rows.select(
        *(own[c] for c in names),
        F.coalesce(F.when(text.isNotNull(), F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1), F.lit(0)).cast("long").alias("n_lines"),
        F.size(removed).cast("long").alias("n_removed"), removed.alias("removed_lines"),
    )


def op7_lines(spark, sf_dir: str) -> DataFrame:
    """Fuzzy line dedup of the whole ``documents`` table; the places of removed lines are joined by commas."""
    return dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed", F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed_lines"))


#: All pairs of distinct lines that share one of a line's rarest shingles, as many as a pair at the threshold can't miss, compared in full.
OP7_SQL = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
pl AS (SELECT rid, doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM d),
own AS (SELECT * FROM pl WHERE length(trim(line, ' ')) >= 20),
u AS (SELECT line, row_number() OVER () AS lid, list_distinct(list_transform(range(1, length(line) - {SHINGLE - 2}), lambda i: substring(line, i, {SHINGLE}))) AS s FROM (SELECT DISTINCT line FROM own)),
g AS (SELECT lid, len(s) AS n, unnest(s) AS g FROM u),
few AS (SELECT * FROM (SELECT lid, n, g, row_number() OVER (PARTITION BY lid ORDER BY f, g) AS r FROM g JOIN (SELECT g, count(*) AS f FROM g GROUP BY g) USING (g)) WHERE r <= n - (4 * n + 4) // 5 + 1),
c AS (SELECT DISTINCT a.lid AS x, b.lid AS y FROM few a JOIN few b USING (g) WHERE a.lid < b.lid AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
m AS (SELECT x, y, len(list_intersect(a.s, b.s)) AS shared, len(a.s) + len(b.s) AS n FROM c JOIN u a ON a.lid = x JOIN u b ON b.lid = y),
l AS (SELECT x, y FROM m WHERE 100 * shared >= 80 * (n - shared) UNION ALL SELECT y, x FROM m WHERE 100 * shared >= 80 * (n - shared)),
e(x, y) AS (SELECT lid, lid FROM u UNION SELECT e.x, l.y FROM e JOIN l ON l.x = e.y),
k AS (SELECT x AS lid, min(y) AS class FROM e GROUP BY x),
p AS (SELECT rid, pos, row_number() OVER (PARTITION BY class ORDER BY doc_id NULLS LAST, pos) AS nth FROM own JOIN u USING (line) JOIN k USING (lid)),
gone AS (SELECT rid, list(pos ORDER BY pos) AS gone FROM p WHERE nth > 1 GROUP BY rid)
SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(ls, range(len(ls))), lambda z: NOT list_contains(coalesce(gone, []), z[2])), lambda z: z[1]), chr(10)) AS text,
  coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed, coalesce(array_to_string(gone, ','), '') AS removed_lines FROM d LEFT JOIN gone USING (rid)"""
