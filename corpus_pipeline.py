"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last give the columns of ``documents``; where a stage
changes a text, ``n_chars`` (if it is there) follows. Null ids, null or empty texts, repeated rows,
empty tables and other columns are treated as each operator says; what a stage does with its
operator's verdict is said below. So a stage begins by giving back the disk of the stages before it:
their own tables, unless its ``docs`` read them, and their shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import carried, column, drop_unread, given_back, read, scratch_path, tables_made
from sparkloom.llm.language import held_out, predict, train
from sparkloom.llm.lines import dedup_lines
from sparkloom.llm.neardup import near_duplicates
from sparkloom.llm.packing import pack_texts
from sparkloom.llm.suffix import remove_repeats
from sparkloom.operators.scratch import scope

#: Documents whose predicted language has a smaller share of the posterior are rejected.
MIN_SCORE = 0.5
#: Lines of fewer characters never go.
MIN_CHARS = 20
#: Bytes of a repeated passage that goes: 51 words of prose have more in 99 of 100 cases (315 in the middle).
PASSAGE_BYTES = 200


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_made: list[str] = []


def _stage(f: Stage) -> Stage:
    """``f`` after the tables of earlier stages are gone; a result that is still to be written must not be kept beyond the next stage's call."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _made[:] = drop_unread(spark, docs, _made)
        with tables_made() as own:
            out = f(spark, docs, sf_dir)
        _made.extend(own)
        return out

    return run


def _with_text(docs: DataFrame, names: list[str], text) -> DataFrame:
    """``docs`` in the columns ``names`` with another text."""
    new = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in names else {})
    return docs.select(*((new[c].alias(c) if c in new else column(c)) for c in names))


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without a letter (``und``), null texts among them, and texts of doubtful language go."""
    model = train(docs.where(~held_out()))
    told = predict(docs, model)
    fine = told.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return fine.select(*map(column, docs.columns))


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated lines go; so does a document that has lost lines and has none of full length left."""
    out = dedup_lines(docs, min_chars=MIN_CHARS)
    long_ones = F.exists(F.split("text", "\n"), lambda x: F.length(F.trim(x)) >= MIN_CHARS)
    return _with_text(out.where((F.col("n_removed") == 0) | long_ones), docs.columns, F.col("text"))


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each component the document with the least id stays, once if its row is repeated."""
    gone = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_md5").alias("gone_md5")).distinct()
    keyed = docs.select(carried(docs.columns).alias("own"), F.col("doc_id").alias("id"), F.md5("text").alias("md5")).dropDuplicates(["id", "md5"])
    left = keyed.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("md5") == F.col("gone_md5")), "left_anti")
    return left.select(*given_back("own", docs.columns).values())


@_stage
def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: repeated passages of ``PASSAGE_BYTES`` go; so does a document of which only white space is left."""
    out = remove_repeats(docs, length=PASSAGE_BYTES, gram=64)
    left = out.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"\S"))
    return _with_text(left, docs.columns, F.col("kept_text"))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: all documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_texts(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("lines", lines), ("near", near), ("suffixes", suffixes), ("packing", packing)]

#: Trained models, components and byte offsets are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; every stage but the last is written to the shared folder and read again.

    What a stage has written for itself is deleted when its result is.
    """
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        with scope(spark):
            made = stage(spark, docs, sf_dir)
            made.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
