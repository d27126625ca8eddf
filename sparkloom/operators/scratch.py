"""Tables written once where all executors see them, for rows that must not be evaluated twice."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Unset, a local master gets one of its own; a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif spark.sparkContext.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="sparkloom-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return base.rstrip("/")


_scopes = threading.local()


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables ``written`` within (by this thread) are deleted at the end; nothing that reads them may be used after it."""
    held = _scopes.__dict__.setdefault("held", [])
    held.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in held.pop():
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new table's path in the shared folder; the innermost ``scope`` of this thread deletes it."""
    path = f"{shared_dir(spark)}/sparkloom/{tag}-{uuid.uuid4().hex}"
    if _scopes.__dict__.get("held"):
        _scopes.held[-1].append(path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again; it stays unless a ``scope`` ends."""
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)
