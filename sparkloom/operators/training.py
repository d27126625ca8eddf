"""Labelled pairs for training a pair scorer, their split, and a check of rankings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written
from .store import numbered


def keyed_examples(examples: DataFrame) -> DataFrame:
    return examples.withColumn("fragment_id", F.concat_ws(":", "fragment_type", "fragment_path"))


def passages(examples: DataFrame, position: str) -> DataFrame:
    """``fragment_id, passage``: the last summary of each id by position."""
    return keyed_examples(examples).groupBy("fragment_id").agg(F.max_by("fragment_summary", position).alias("passage"))


def positives(examples: DataFrame) -> DataFrame:
    """``query, passage, label`` 1 for each question of each example."""
    return keyed_examples(examples).select("fragment_id", F.explode("questions").alias("query"), F.col("fragment_summary").alias("passage"), F.lit(1).alias("label"))


def training_pairs(examples: DataFrame, position: str, negatives: int = 3) -> DataFrame:
    """Positives, and for each question up to ``negatives`` passages of other ids.

    The fragments stand in a ring in the order of their ids' MD5; a question's own MD5 says where in the
    ring it begins to draw. So a question meets ``negatives + 1`` fragments, not all of them, and the
    same input always gives the same pairs.
    """
    own = positives(examples)
    pool = passages(examples, position).select(F.col("fragment_id").alias("other_id"), F.col("passage").alias("other"))
    ring = numbered(pool.withColumn("_m", F.md5("other_id")), [F.col("_m"), F.col("other_id")], "place").drop("_m")
    n = (ring.agg(F.max("place")).first()[0] or 0) + 1  # of the rows as they were written; one or none are no ring
    if n < 2:
        return own
    start = F.conv(F.substring(F.md5(F.concat_ws("|", "fragment_id", "query")), 1, 8), 16, 10).cast("long") % n
    steps = F.explode(F.sequence(F.lit(0), F.lit(min(negatives, n - 1)))).alias("step")
    draws = own.select("fragment_id", "query").distinct().withColumn("start", start).select("fragment_id", "query", "start", steps).withColumn("place", (F.col("start") + F.col("step")) % n)
    met = draws.join(ring, "place").where("fragment_id <> other_id")
    drawn = met.withColumn("r", F.row_number().over(Window.partitionBy("fragment_id", "query").orderBy("step"))).where(F.col("r") <= negatives)
    return own.unionByName(drawn.select("fragment_id", "query", F.col("other").alias("passage"), F.lit(0).alias("label")))


#: Hex digits of the MD5 that rows are counted by: about a million buckets a label.
DIGITS = 5


def stratified_split(pairs: DataFrame, key_cols: list[str], share: float = 0.1, label: str = "label") -> DataFrame:
    """``is_validation`` for the first ``share`` of each label in the order of an MD5 of the key (ties by the key).

    The rows are not sorted. A count by the MD5's first digits tells the bucket in which a label's
    share ends; rows of other buckets are on one side of it, and only those of that bucket, a
    millionth of all unless keys repeat, are numbered. Where the shares end, a row a label, is broadcast:
    a join by label would send most rows to one task. ``pairs`` is evaluated three times.
    """
    own = f"_{uuid.uuid4().hex}"  # no column of the input has this name
    key, head, cut = f"{own}key", f"{own}head", f"{own}cut"
    rows = pairs.withColumn(key, F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols]))).withColumn(head, F.substring(key, 1, DIGITS))
    counts = rows.groupBy(F.col(label).alias("label"), F.col(head).alias("head")).agg(F.count("*").alias("n"))
    of = Window.partitionBy("label")
    before = F.sum("n").over(of.orderBy("head")) - F.col("n")
    ends = counts.withColumns({"before": before, "wanted": F.ceil(F.sum("n").over(of) * F.lit(share))}).where("before < wanted AND before + n >= wanted")
    ends = ends.select(F.col("label").alias(f"{own}label"), F.struct("head", "before", "wanted").alias(cut))  # a row a label
    met = rows.join(F.broadcast(ends), F.col(label).eqNullSafe(F.col(f"{own}label")), "left").drop(f"{own}label")
    inside = F.coalesce(F.col(head) == F.col(f"{cut}.head"), F.lit(False))
    sure = met.where(~inside).withColumn("is_validation", F.coalesce(F.col(head) < F.col(f"{cut}.head"), F.lit(False)))
    edge = numbered(met.where(inside), [F.col(label), F.col(key), *map(F.col, key_cols)], f"{own}at")
    first = edge.groupBy(F.col(label).alias(f"{own}label")).agg(F.min(f"{own}at").alias(f"{own}first"))
    edge = edge.join(F.broadcast(first), F.col(label).eqNullSafe(F.col(f"{own}label"))).withColumn("is_validation", F.col(f"{own}at") - F.col(f"{own}first") + F.col(f"{cut}.before") < F.col(f"{cut}.wanted"))
    names = [*pairs.columns, "is_validation"]
    return sure.select(*names).unionByName(edge.select(*names))


def label_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("label").agg(F.count("*").alias("n"))


def hit_at_k(ranked: DataFrame, k: int = 3) -> DataFrame:
    """``query, hit`` from ``query, rank, id, correct_id``: whether the right one is among the first k."""
    return ranked.where(F.col("rank") <= k).groupBy("query").agg(F.max((F.col("id") == F.col("correct_id")).cast("int")).alias("hit"))


#: Questions that are broadcast at most; they are counted.
SENT_QUESTIONS = 10_000


def right_ranks(passages: DataFrame, questions: DataFrame, scorer, digits: int = 12) -> DataFrame:
    """``query, correct_id, rank`` of questions ``query, correct_id, passage`` among ``fragment_id, passage``.

    A right passage's rank is one plus the number of better ones (a higher score, or an equal one and a
    lesser id), which is counted for all questions in one scan of the passages; scores are rounded to
    ``digits``, so that what is equal stays so however it is summed.
    """
    asked = questions.withColumn("own", F.round(scorer.pairs(F.col("query"), F.col("passage")), digits)).select("query", "correct_id", "own")
    asked = written(asked, "questions")  # each is scored once
    few = asked.limit(SENT_QUESTIONS + 1).count() <= SENT_QUESTIONS
    met = passages.select("fragment_id", F.col("passage").alias("other")).crossJoin(F.broadcast(asked) if few else asked)  # a stated set of questions, against all rows
    score = F.round(scorer.pairs(F.col("query"), F.col("other")), digits)
    better = F.count_if((F.col("score") > F.col("own")) | ((F.col("score") == F.col("own")) & (F.col("fragment_id") < F.col("correct_id"))))
    return met.withColumn("score", score).groupBy("query", "correct_id").agg((better + 1).alias("rank"))


def evaluated(ranks: DataFrame, k: int = 3) -> DataFrame:
    """One row: questions, the share whose right passage is among the first k, and the mean of 1 / rank."""
    return ranks.agg(F.count("*").alias("questions"), F.avg((F.col("rank") <= k).cast("double")).alias("hit_rate"), F.avg(F.lit(1.0) / F.col("rank")).alias("mrr"))
