"""Quality rules with thresholds that adapt to each language and source.

Every figure of a document is computed in its own row by SQL functions. One aggregation then builds a
mergeable quantile sketch (``percentile_approx``: partial sketches on the map side, merged after a
shuffle that carries one sketch a group and task) of each ratio for each language and source, so a
source with a third of all rows sends no more than any other. Thresholds are the sketches' outer
fences, q75 + spread * (q75 - q25) at the high side and likewise at the low, with a least distance for groups whose
quartiles meet. Documents are joined with the thresholds of their group and filtered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, read

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Ratios held against their group: name, whether the low or the high side is bad, least distance from the median.
RATIOS = (("mean_word_chars", "low", 1.0), ("mean_word_chars", "high", 2.0), ("symbol_ratio", "high", 0.05), ("dup_line_ratio", "high", 0.15), ("repeat_word_ratio", "high", 0.1))


def words_of(text: Column) -> Column:
    """The words of a text, split at blanks; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(hashes: Column) -> Column:
    """Words covered by windows that occur twice or more, from the windows' hashes in order.

    The windows are sorted as (hash, place); neighbours with the same hash give the places, which in
    order cover ``WINDOW`` words each, less where the next one begins before. Linear but for the sorts.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
        flagged = F.zip_with(same, F.concat(F.array(F.lit(False)), same), lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)))
        kept = F.filter(F.zip_with(s, flagged, lambda a, f: F.when(f, a["i"])), lambda i: i.isNotNull())
        return F.array_sort(kept)

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    # each step's array is bound once, by a one-element transform
    return F.transform(F.array(pairs), lambda s: F.transform(F.array(places(s)), covered)[0])[0]


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    has = set(docs.columns)
    name = lambda c: column(c) if c in has else F.lit(None).cast("string")
    base = docs.select(column(id_col).alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text"), name(lang_col).alias("lang"), name(source_col).alias("source"))
    lines = F.filter(F.split("text", "\n"), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)
    base = base.select(
        "doc_id", "lang", "source",
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda a: F.size(a) - F.size(F.array_distinct(a)))[0].cast("long").alias("n_dup_lines"),
        words_of(F.col("text")).alias("w"),
    )
    windows = F.transform(
        F.array(F.col("w")),
        lambda w: F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))).otherwise(F.array().cast("array<long>")),
    )[0]
    repeat = F.transform(F.array(windows), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), repeated_words(h)).otherwise(F.lit(0).cast("long")))[0]
    return base.select("doc_id", "lang", "source", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeat.alias("n_repeat_words"))


def rates(rows: DataFrame) -> DataFrame:
    """The figures with what the thresholds are held against; ratios are null for a document without words."""
    return rows.withColumns(
        {
            "mean_word_chars": F.try_divide(F.col("word_chars").cast("double"), F.col("n_words")),
            "symbol_ratio": F.try_divide(F.col("n_symbols").cast("double"), F.col("word_chars")),
            "dup_line_ratio": F.try_divide(F.col("n_dup_lines").cast("double"), F.col("n_words")) * 10,
            "repeat_word_ratio": F.try_divide(F.col("n_repeat_words").cast("double"), F.col("n_words")),
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        }
    )


def thresholds(rated: DataFrame, spread: float = 3.0, accuracy: int = 10_000) -> DataFrame:
    """``lang, source`` and a bound for each rule, from the documents that pass the base rules."""
    names = list(dict.fromkeys(r[0] for r in RATIOS))
    q = rated.where(~F.col("base_failed")).groupBy("lang", "source").agg(*[F.percentile_approx(c, [0.25, 0.5, 0.75], accuracy).alias(c) for c in names])
    low = lambda c, d: F.least(F.col(c)[0] - spread * (F.col(c)[2] - F.col(c)[0]), F.col(c)[1] - d)
    high = lambda c, d: F.greatest(F.col(c)[2] + spread * (F.col(c)[2] - F.col(c)[0]), F.col(c)[1] + d)
    return q.select("lang", "source", *[(low if side == "low" else high)(c, d).alias(f"{side}_{c}") for c, side, d in RATIOS])


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", spread: float = 3.0, accuracy: int = 10_000) -> DataFrame:
    """One row for each document: its figures, the thresholds of its group, ``base_failed`` and ``kept``.

    A null text has no words and fails the base rules. A null language or source is a group like any
    other, and so is an absent column. Repeated rows each get their row; an empty table gives none;
    other columns are ignored. A document that passes the base rules passes its group's rules where
    they can't be told (a null ratio or threshold).
    """
    from .common import save

    rated = rates(save(figures(docs, id_col, text_col, lang_col, source_col), "quality-figures"))
    bounds = thresholds(rated, spread, accuracy).withColumnsRenamed({"lang": "group_lang", "source": "group_source"})
    joined = rated.join(bounds, F.col("lang").eqNullSafe(F.col("group_lang")) & F.col("source").eqNullSafe(F.col("group_source")), "left")
    fine = F.lit(True)
    for c, side, _ in RATIOS:
        fine &= F.coalesce(F.col(c) >= F.col(f"low_{c}") if side == "low" else F.col(c) <= F.col(f"high_{c}"), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & fine).drop("group_lang", "group_source")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """The adaptive rules over the whole ``documents`` table."""
    return judge(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    q = lambda c, p: f"quantile_disc({c}, {p})"
    names = list(dict.fromkeys(r[0] for r in RATIOS))
    rules = []
    for c, side, d in RATIOS:
        if side == "low":
            rules.append(f"coalesce({c} >= least(q1_{c} - 3.0::DOUBLE * (q3_{c} - q1_{c}), q2_{c} - {d}::DOUBLE), true)")
        else:
            rules.append(f"coalesce({c} <= greatest(q3_{c} + 3.0::DOUBLE * (q3_{c} - q1_{c}), q2_{c} + {d}::DOUBLE), true)")
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d
), win AS (
  SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)
), rep AS (
  SELECT rid, i, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8) AS step
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n >= 2
), cov AS (SELECT rid, sum(least(step, 8)) AS n FROM rep GROUP BY rid), f AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
         (len(text) - len(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)
), r AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words END AS mean_word_chars,
         CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars END AS symbol_ratio,
         CASE WHEN n_words > 0 THEN n_dup_lines::DOUBLE / n_words * 10 END AS dup_line_ratio,
         CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words END AS repeat_word_ratio,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f
), t AS (
  SELECT lang AS gl, source AS gs, {", ".join(f"{q(c, p)} AS q{i}_{c}" for c in names for i, p in ((1, 0.25), (2, 0.5), (3, 0.75)))}
  FROM r WHERE NOT base_failed GROUP BY ALL
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(rules)} AS kept
FROM r LEFT JOIN t ON lang IS NOT DISTINCT FROM gl AND source IS NOT DISTINCT FROM gs
"""


OP9_SQL = _sql()
