"""Reading projects, training examples and search requests."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import component
from ..functions.text import basename, extension
from ..schema import EXAMPLES, SOURCE_FILES
from .files import listed_files, opened, project_files
from .names import EXTENSIONS, IGNORED


def is_ignored(path: Column) -> Column:
    """Whether one of the fixed strings occurs anywhere in the path."""
    return F.rlike(path, F.lit(IGNORED))


def decoded(content: Column) -> tuple[Column, Column]:
    """(text with line ends as ``\\n``, error) of bytes; what isn't UTF-8 has an error and no text."""
    fine = F.try_validate_utf8(content.cast("string"))
    text = F.regexp_replace(F.regexp_replace(fine, "\r\n", "\n"), "\r", "\n")
    return text, F.when(content.isNotNull() & fine.isNull(), F.lit("not valid UTF-8"))


def file_info(df: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """``path, file_name, extension, size``; the size is 0 where it isn't known."""
    p = F.regexp_replace(F.col(path), r"^file:(//)?", "")
    return df.withColumns({"path": p, "file_name": basename(p), "extension": extension(p), "size": F.coalesce(F.col(size), F.lit(0)).cast("long")})


def _source(df: DataFrame) -> DataFrame:
    """``path, length, content`` (and why it ``failed``) in the schema of source files; ignored files keep neither text nor error."""
    text, error = decoded(F.col("content"))
    if "failed" in df.columns:
        error = F.coalesce("failed", error)
    df = file_info(df.withColumn("size", F.col("length")))
    out = df.withColumns({"ignored": is_ignored(F.col("path")), "raw_content": text, "error": error})
    out = out.withColumns({c: F.when(~F.col("ignored"), F.col(c)) for c in ("raw_content", "error")})
    return out.selectExpr(*[f"{c.split()[0]}" for c in SOURCE_FILES.split(", ")])


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """All files of a tree whose names end in one of ``EXTENSIONS``, those of ignored paths left out.

    The data source of ``files`` lists the tree, names that begin with a dot or an underscore
    included, deals the files by size, and reads each once. A folder that isn't there is an error.
    """
    return _source(project_files(spark, path))


#: The same: any folder that driver and executors share.
read_project_local = read_tree


def read_project(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_tree`` by Spark's own reader, for file systems that pyarrow doesn't open; it passes over names that begin with a dot or an underscore."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(EXTENSIONS) + "}").load(path)
    return _source(files).where(~F.col("ignored"))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row for each path: missing and undecodable files have an error, ignored ones no text."""
    return _source(listed_files(spark, paths))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """``read_tree`` wherever pyarrow opens the file system, else ``read_project``."""
    try:
        opened(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return read_project(spark, path)
    return read_tree(spark, path)


def parse(files: DataFrame) -> DataFrame:
    """Source files with their components' sections; only names in ``.vue`` have any."""
    own = (F.col("extension") == ".vue") & F.col("raw_content").isNotNull()
    text = F.col("raw_content")
    script = component.script(text)
    cols = {
        "template": component.template(text), "script": script, "style": component.style(text),
        "component_name": component.component_name(F.coalesce(script, F.lit("")), F.col("path")), "props": component.props(F.coalesce(script, F.lit(""))), "components": component.components(F.coalesce(script, F.lit(""))),
    }
    return files.withColumns({c: F.when(own, x) for c, x in cols.items()})


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Training examples: a JSON array of records."""
    return spark.read.schema(EXAMPLES).json(path, multiLine=True)


#: Keys of a request's filters that don't filter.
CONTROL_KEYS = ("rerank", "ensemble_weight", "ensemble_weights", "query_text")


@dataclass(frozen=True)
class SearchRequest:
    """What a search asks for, checked."""

    query: str
    k: int = 5
    rerank: bool = True
    filters: dict[str, Any] = field(default_factory=dict)
    ensemble_weight: float = 0.5
    requirement_id: str | None = None

    def __post_init__(self):
        if not 1 <= self.k <= 20:
            raise ValueError("k has to be from 1 to 20")
        if not 0 <= self.ensemble_weight <= 1:
            raise ValueError("ensemble_weight has to be from 0 to 1")


def parse_command(line: str, rerank: bool = False) -> SearchRequest:
    """``words --key=value --rerank`` as a request for 5 results; the line is cut at every ``--``."""
    query, *flags = line.split("--")
    filters: dict[str, Any] = {}
    weight = 0.5
    for flag in flags:
        key, has, value = flag.partition("=")
        if has:
            filters[key.strip()] = value.strip()
        elif flag.strip() in ("rerank", "norerank"):
            rerank = flag.strip() == "rerank"
    if "weight" in filters:
        try:
            weight = float(filters.pop("weight"))
        except ValueError:
            raise ValueError("weight has to be a number") from None
    return SearchRequest(query.strip(), 5, rerank, filters, weight)
