"""An extension: files that arrive in a folder are added to a store as they come (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fragments import fragments
from ..operators.scratch import scope, written
from ..plans.engine import Engine
from ..sources.project import EXTENSIONS, _source, parse

FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest(engine: Engine, folder: str, checkpoint: str, available_now: bool = True):
    """A running query; each micro-batch is one append. Batches that are run again add nothing: ids are digests."""
    spark = engine.spark
    glob = "*{" + ",".join(EXTENSIONS) + "}"
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)

    def add(batch: DataFrame, _: int) -> None:
        with scope(spark):
            engine.add(written(fragments(parse(_source(batch).where(~F.col("ignored")))), "fragments"))

    writer = files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
