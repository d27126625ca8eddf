"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root``: for each node of ``links`` the least node that it reaches.

    Self-links, repeated links and links with a null end add nothing. Every step groups with map-side
    minima and joins them back, so a node with very many links is split like any skewed join; a step's
    links are written to the shared folder, and the driver sees their number and a checksum only.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = save(e, "links")
    before = _mark(e)
    while before[0]:
        # large star: every greater neighbour of a node is linked to the node's least neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its lesser neighbours are linked to the least of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        e = save(large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def extended(roots: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """``components`` of the links that gave ``roots`` and of further ``links``: what was joined before is one step from its root."""
    return components(roots.select(F.col("node").alias(a), F.col("root").alias(b)).unionByName(links.select(a, b)), a, b)
