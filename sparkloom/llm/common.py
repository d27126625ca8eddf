"""What the operators of this subpackage share: scratch tables, worker caches, plan sizes."""

from __future__ import annotations

import gc
import sys
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators import scratch

_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = scratch.scratch_path(spark, tag)
    _SCRATCH.append(path)
    return path


def save(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a zstd Parquet table in the shared folder and read it again."""
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def purge(spark: SparkSession) -> None:
    """Delete the scratch tables written so far; call it when no DataFrame that reads them is needed any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def tables_made() -> Iterator[list[str]]:
    """The list of the scratch tables that are written within; it is filled at the end."""
    own: list[str] = []
    before = len(_SCRATCH)
    try:
        yield own
    finally:
        own += _SCRATCH[before:]


def drop_unread(spark: SparkSession, rows: DataFrame, paths: list[str]) -> list[str]:
    """Delete the scratch tables ``paths`` that ``rows`` don't read, which are given back, and let go of shuffles that nobody needs.

    Spark deletes a shuffle's files once the driver's JVM has collected what refers to it, which a
    driver with much free memory puts off.
    """
    read_ = {part for f in (rows.inputFiles() if paths else []) for part in f.split("/")}
    kept = [p for p in paths if p.rsplit("/", 1)[-1] in read_]
    conf = spark._jsc.hadoopConfiguration()
    for p in paths:
        if p not in kept:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
    gc.collect()  # of Python's references to the JVM's plans
    spark._jvm.System.gc()
    return kept


#: Rows of a side that is broadcast at most.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """``df`` marked to be broadcast if it has at most ``BROADCAST_ROWS`` rows, which are counted; for narrow, saved tables."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def hot_join(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with ``keys``, a saved table unique in ``on`` that has ``n``, how many of the rows have each.

    Rows of a key with more than a quarter of a partition's share are dealt over all partitions, and the
    key with them; there are at most four such keys for each partition, which are broadcast.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(10_000, (keys.agg(F.sum("n")).first()[0] or 0) // (4 * parts))
    hot = F.broadcast(keys.where(F.col("n") > most).select(*on, F.lit(True).alias("_hot")))
    spread = rows.join(hot, on, "left").withColumn("_salt", F.when(F.col("_hot"), F.monotonically_increasing_id() % parts).otherwise(F.lit(0).cast("long"))).drop("_hot")
    every = F.when(F.col("n") > most, F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return spread.join(keys.withColumn("_salt", F.explode(every)), [*on, "_salt"]).drop("_salt")


def ranked(rows: DataFrame, group: str, order: list[Column], tag: str) -> DataFrame:
    """``rows`` with ``at``, their place from 0 in their ``group`` (which isn't null), and ``total``, the group's rows.

    No group is gathered: rows are dealt by ranges of (group, order), written once, and numbered by
    their place in their partition and the counts of partitions before, of which a group has few.
    Rows equal in ``order`` are split by where they were read.
    """
    by = [F.col(group), *order, F.col("_tie")]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_no", F.monotonically_increasing_id()).drop("_tie")
    ranged = save(ranged, tag).withColumn("_part", F.shiftright("_no", 33))
    counts = ranged.groupBy(group, "_part").agg(F.min("_no").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = save(counts.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("total")), f"{tag}-offsets")
    return ranged.join(small(offsets), [group, "_part"]).withColumn("at", F.col("_no") + F.col("_shift")).drop("_no", "_part", "_shift")


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the bytes that ``df`` reads; where it can't tell, a guess from the number of shuffle partitions."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 55 else 8_000_000 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker; it is never pickled with a function."""
    return sys.__dict__.setdefault("_sparkloom_cache", {})


def forget() -> None:
    """Give back what other operators keep in this worker: a pipeline's stages share workers."""
    cache = worker_cache()
    if not cache:
        return
    cache.clear()
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def load_tokenizer(path: str):
    """The ``tokenizers`` tokenizer of a .json file, one per worker, without truncation or padding."""
    cache = worker_cache()
    if ("tokenizer", path) not in cache:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        cache["tokenizer", path] = tok
    return cache["tokenizer", path]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def column(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def carried(names: list[str]) -> Column:
    """The columns ``names`` in one struct, so that none of them can clash with ours; ``given_back`` takes them out."""
    return F.struct(*(column(c).alias(f"c{i}") for i, c in enumerate(names)), F.lit(True).alias("here"))


def given_back(own: str, names: list[str]) -> dict[str, Column]:
    """Name -> column of what ``carried`` put in the struct ``own``."""
    return {c: F.col(own)[f"c{i}"].alias(c) for i, c in enumerate(names)}


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` alone, so that no other column of the input can clash with ours."""
    return docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
