"""Splits and rankings against plain versions."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import encode, training


def plain_split(rows, share):
    out = []
    for label in {r[2] for r in rows}:
        own = sorted((r for r in rows if r[2] == label), key=lambda r: (hashlib.md5(f"{r[0]}|{r[1]}".encode()).hexdigest(), r[0], r[1]))
        n = math.ceil(len(own) * share)
        out += [(*r, k < n) for k, r in enumerate(own)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 1.0])
def test_split(spark, share):
    """Repeated rows, a null label, clashing names, and more rows of one key than its share takes."""
    r = random.Random(1)
    rows = [(f"q{r.randrange(80)}", f"p{r.randrange(3)}", r.choice([0, 0, 1, None])) for _ in range(900)] + [("same", "same", 1)] * 400 + [("lone", "x", 7)]
    df = spark.createDataFrame([(*x, "k", 1) for x in rows], "query string, passage string, label int, _key string, _place int").repartition(5)
    got = training.stratified_split(df, ["query", "passage"], share)
    assert got.columns == [*df.columns, "is_validation"]
    told = sorted((tuple(x) for x in got.select("query", "passage", "label", "is_validation").collect()), key=repr)
    assert told == plain_split(rows, share)
    assert training.stratified_split(df.limit(0), ["query"], share).count() == 0


def test_split_sorts_only_the_edge(spark):
    """Rows outside the bucket where a share ends are neither sorted nor dealt by ranges."""
    df = spark.range(5000).select(F.col("id").cast("string").alias("query"), (F.col("id") % 2).cast("int").alias("label"))
    plan = training.stratified_split(df, ["query"])._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan
    assert training.stratified_split(df, ["query"]).where("is_validation").count() == 500


def test_split_sends_no_label_to_one_task(spark):
    """Rows meet the end of their label's share where they are; a join by label gave one task all rows of a label."""
    df = spark.range(5000).select(F.col("id").cast("string").alias("query"), (F.col("id") % 2).cast("int").alias("label"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # sizes that the optimizer guesses don't help at size
    try:
        plan = training.stratified_split(df, ["query"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


class Length(encode.BatchScorer):
    def __init__(self):
        super().__init__("length", lambda: lambda query, passages: [float(len(p)) + len(query) for p in passages])


@pytest.mark.parametrize("scorer", [encode.Coverage(), Length()])
def test_right_ranks(spark, scorer):
    r = random.Random(2)
    word = lambda: r.choice(["todo", "list", "item", "add", "x"])
    passages = [(f"f{k:03}", " ".join(word() for _ in range(r.randint(0, 4)))) for k in range(60)]
    asked = [(f"{word()} {word()}", *r.choice(passages)) for _ in range(12)]
    df = spark.createDataFrame(passages, "fragment_id string, passage string").repartition(3)
    questions = spark.createDataFrame(asked, "query string, correct_id string, passage string").dropDuplicates(["query", "correct_id"])
    got = training.right_ranks(df, questions, scorer)

    def score(query, passage):
        if isinstance(scorer, Length):
            return float(len(passage)) + len(query)
        terms, words = list(dict.fromkeys(query.split())), passage.split()
        return sum(1.0 if t in words else 0.5 if t in passage else 0.0 for t in terms) / len(terms)

    for row in got.collect():
        order = sorted(passages, key=lambda p: (-round(score(row["query"], p[1]), 12), p[0]))
        assert order[row["rank"] - 1][0] == row["correct_id"]
    told = training.evaluated(got, 5).first()
    ranks = [x["rank"] for x in got.collect()]
    assert told["questions"] == len(ranks) and told["hit_rate"] == pytest.approx(sum(x <= 5 for x in ranks) / len(ranks)) and told["mrr"] == pytest.approx(sum(1 / x for x in ranks) / len(ranks))


def test_last_passage_of_a_repeated_id(spark):
    rows = [("css", "p", "old", ["q"], 1), ("css", "p", "new", ["r"], 2), ("js", "p", "other", ["s"], 3)]
    df = spark.createDataFrame(rows, "fragment_type string, fragment_path string, fragment_summary string, questions array<string>, position long")
    assert sorted(map(tuple, training.passages(df, "position").collect())) == [("css:p", "new"), ("js:p", "other")]
    pairs = training.training_pairs(df, "position").collect()
    assert {r["passage"] for r in pairs if r["label"] == 0} == {"new", "other"}
