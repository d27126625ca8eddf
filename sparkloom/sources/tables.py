"""The bundled tables in the schemas of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

TYPES = "array(" + ", ".join(f"'{t}'" for t in schema.TYPES) + ")"
PROP_NAMES = "array('item','dense','title','value','label','extra')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_store(spark: SparkSession, sf_dir: str, vectors: str = "inner") -> DataFrame:
    """Documents as fragments with the vectors of the same number; ``vectors``: how to join, or ``none``."""
    docs = table(spark, sf_dir, "documents").selectExpr(
        "cast(doc_id as string) AS id", "doc_id AS ordinal", f"element_at({TYPES}, cast(doc_id % 9 as int) + 1) AS type", "concat('frag_', doc_id) AS name",
        "concat('repo/web-app/src/', source, '/', lang, '/', doc_id div 4, '.vue') AS file_path", "concat(doc_id div 4, '.vue') AS file_name",
        "CASE WHEN length(text) > 150 THEN concat(substring(text, 1, 150), '...') ELSE text END AS content_preview", "text AS full_content",
        "CASE WHEN doc_id % 9 = 0 THEN concat('Comp', doc_id % 50) END AS component_name", f"CASE WHEN doc_id % 9 = 0 THEN slice({PROP_NAMES}, 1, cast(doc_id % 7 as int)) END AS props",
    )
    if vectors == "none":
        return docs
    return docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ordinal"), "embedding"), "ordinal", vectors)


def documents_as_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as fragments that a store takes."""
    d = documents_as_store(spark, sf_dir, "none")
    text, names = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    info = F.struct("file_path", "file_name", "component_name", "props", names.alias("components"), text.alias("extension"), text.alias("file_type"))
    return d.select("id", "type", "name", F.col("full_content").alias("content"), info.alias("metadata"))


def vectors_as_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("cast(vec_id as string) AS id", "vec_id AS ordinal", "embedding", "label")


def documents_as_other_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files that are no components: pages and what else there may be."""
    ext = "CASE doc_id % 3 WHEN 0 THEN '.html' WHEN 1 THEN '.md' ELSE '' END"
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"concat('site/', source, '/', doc_id, {ext}) AS path", f"concat(doc_id, {ext}) AS file_name", f"{ext} AS extension", "cast(octet_length(text) as long) AS size", "text AS raw_content", "cast(null as string) AS error",
        "doc_id % 10 = 0 AS ignored",
    )


#: A component's source made of a document; the same expression is SQL for both engines.
SOURCE = """concat(
  CASE WHEN doc_id % 5 <> 0 THEN concat('<template>', chr(10), '  <div>', text, '</div>', chr(10), '</template>', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 = 1 THEN concat('<script setup>', chr(10), 'const a = 1', chr(10), '</script>', chr(10)) ELSE concat('<script>', chr(10), 'export default {', chr(10),
    CASE WHEN doc_id % 3 <> 0 THEN concat('  name: ''Comp', doc_id, ''',', chr(10)) ELSE '' END,
    CASE doc_id % 4 WHEN 1 THEN '  props: { item: { type: Object, required: true }, dense: Boolean },' WHEN 2 THEN '  props: [''alpha'', "beta"],' WHEN 3 THEN '  props: { one: String, two: Number },' ELSE '' END,
    CASE WHEN doc_id % 2 = 0 THEN '  components: { Badge: BadgeView, Icon },' ELSE '' END, chr(10), '}', chr(10), '</script>', chr(10)) END,
  CASE doc_id % 3 WHEN 0 THEN concat('<style scoped>', chr(10), '.a { color: red }', chr(10), '</style>', chr(10)) WHEN 1 THEN concat('<style>', chr(10), '</style>') ELSE '' END)"""
#: Its path; every third is no component.
PATH = "concat('repo/web-app/src/', source, '/', doc_id, CASE doc_id % 6 WHEN 3 THEN '.js' WHEN 4 THEN '.ts' WHEN 5 THEN '.css' ELSE '.vue' END)"
FILE = "concat(doc_id, CASE doc_id % 6 WHEN 3 THEN '.js' WHEN 4 THEN '.ts' WHEN 5 THEN '.css' ELSE '.vue' END)"
EXTENSION = "CASE doc_id % 6 WHEN 3 THEN '.js' WHEN 4 THEN '.ts' WHEN 5 THEN '.css' ELSE '.vue' END"


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"{PATH} AS path", f"{FILE} AS file_name", f"{EXTENSION} AS extension", "cast(octet_length(text) as long) AS size", f"{SOURCE} AS raw_content", "cast(null as string) AS error", "false AS ignored"
    )


def conversations_as_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn is a question, the turn after it the passage."""
    c = table(spark, sf_dir, "conversations")
    q = c.where("role = 'user'").selectExpr("conv_id", "turn", "text AS question")
    a = c.where("role = 'assistant'").selectExpr("conv_id", "turn - 1 AS turn", "text AS fragment_summary")
    return q.join(a, ["conv_id", "turn"]).selectExpr("'turn' AS fragment_type", "concat(conv_id, '/', turn) AS fragment_path", "fragment_summary", "array(question) AS questions", "conv_id * 1000 + turn AS position")
