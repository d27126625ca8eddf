"""Ranking: each search is one scan that gives the best of its lists, and a late look-up of the few hits; ties go by ``ordinal``."""

from __future__ import annotations

from array import array
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keyword_score, preview, relative_path
from .filters import apply, predicate
from .nearest import Ranking, nearest_of_many, rankings

#: Weights of the vector, the keyword and the semantic list.
WEIGHTS = (0.4, 0.2, 0.4)


def unpacked(vector) -> list[float]:
    """A stored vector as numbers; it may be packed as float32."""
    if isinstance(vector, (bytes, bytearray)):
        return [float(x) for x in array("f", bytes(vector))]
    return [float(x) for x in vector]


def top(df: DataFrame, by: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(by), "ordinal").limit(k)


def looked_up(hits: DataFrame, details: DataFrame, k: int) -> DataFrame:
    """Hits ``ordinal, score`` with the other columns of ``details``, in order; the hits, of a known small number, are what is broadcast."""
    return top(details.join(F.broadcast(hits), "ordinal"), "score", k)


def vector_search(
    store: DataFrame, query: Sequence[float], k: int = 5, metric: str = "cosine", filters: dict[str, Any] | None = None, mode: str = "overfetch", details: DataFrame | None = None,
) -> DataFrame:
    """The k nearest by vector: the store's columns (or those of ``details``) and ``score``.

    With filters, ``overfetch`` takes the 5k nearest and filters these, so it may give fewer than k;
    ``exact`` filters first. Rows without vector or with a zero one (cosine) have no score and are left out.
    """
    if mode not in ("overfetch", "exact"):
        raise ValueError("mode is overfetch or exact")
    rule = predicate(store, filters) if filters else None
    over = rule is not None and mode == "overfetch"
    near = rankings(store, [Ranking("vector", 5 * k if over else k, F.col("embedding"), query, metric, None if over else rule)], rule if over else None)
    hits = top(near.where("ok"), "score", k).select("ordinal", "score")
    return looked_up(hits, store.drop("embedding") if details is None else details, k)


def keyword_search(store: DataFrame, query: str, k: int = 20, text_col: str = "content_preview") -> DataFrame:
    scored = store.withColumn("score", keyword_score(F.col(text_col), F.col("type"), query)).where("score > 0")
    return top(scored, "score", k)


def semantic_search(
    store: DataFrame, query: str, encoder, k: int = 20, filters: dict[str, Any] | None = None, text_col: str = "content_preview", vector_col: str | None = None, details: DataFrame | None = None,
) -> DataFrame:
    """Cosine of the query's and the previews' vectors; filters come first. Empty previews are left out.

    ``vector_col`` has the previews' vectors if they are kept; else they are encoded here.
    """
    found = rankings(store, [meant(store, query, encoder, k, filters, text_col, vector_col)])
    return looked_up(found.select("ordinal", "score"), store if details is None else details, k)


def meant(store: DataFrame, query: str, encoder, k: int, filters: dict[str, Any] | None, text_col: str = "content_preview", vector_col: str | None = None) -> Ranking:
    """The semantic list."""
    own = F.col(vector_col) if vector_col else F.when(F.length(text_col) > 0, encoder.column(F.col(text_col)))
    return Ranking("semantic", k, own, encoder.query(query), "cosine", (F.length(text_col) > 0) & predicate(store, filters))


def three_lists(
    store: DataFrame, vector: Sequence[float], text: str, encoder, k: int, *, metric: str = "cosine", filters: dict[str, Any] | None = None, keyword_filter: bool = True, mode: str = "overfetch", text_col: str = "content_preview",
    vector_col: str | None = None,
) -> DataFrame:
    """``list, ordinal, score``: the vector, keyword and semantic lists of k, from one scan."""
    rule = predicate(store, filters)
    over = bool(filters) and mode == "overfetch"
    words = keyword_score(F.col(text_col), F.col("type"), text)
    lists = [
        Ranking("vector", 5 * k if over else k, F.col("embedding"), vector, metric, None if over else rule), Ranking("keyword", k, F.when(words > 0, words), where=rule if keyword_filter else None),
        meant(store, text, encoder, k, filters, text_col, vector_col),
    ]
    found = rankings(store, lists, rule)
    if over:  # the k first of those near ones that pass
        place = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), "ordinal"))
        found = found.where("list <> 'vector' OR ok").withColumn("_r", place).where(F.col("_r") <= k)
    return found.select("list", "ordinal", "score")


def fuse_lists(lists: DataFrame, k: int = 5, weights: tuple[float, float, float] = WEIGHTS, metric: str = "cosine", keys: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """``ordinal, score`` of ``list, ordinal, score``: each list divided by its maximum, missing scores 0, weighted and summed.

    The lists hold a few rows each, so what they meet in is one small task. Distances (l2) are turned
    into similarities first, or the farthest would win.
    """
    score = F.when(F.col("list") == "vector", F.lit(1.0) / (F.lit(1.0) - F.col("score"))).otherwise(F.col("score")) if metric == "l2" else F.col("score")
    scaled = lists.withColumn("s", score).withColumn("s", F.try_divide("s", F.max("s").over(Window.partitionBy("list"))))
    part = lambda name, w: F.coalesce(F.max(F.when(F.col("list") == name, F.col("s"))), F.lit(0.0)) * F.lit(w)
    total = part("vector", weights[0]) + part("keyword", weights[1]) + part("semantic", weights[2])
    return scaled.groupBy(*keys).agg(total.alias("score")).orderBy(F.desc("score"), "ordinal").limit(k)


def fuse(vector: DataFrame, keyword: DataFrame, semantic: DataFrame, k: int = 5, weights: tuple[float, float, float] = WEIGHTS, metric: str = "cosine") -> DataFrame:
    """``id, ordinal, score`` of three lists."""
    lists = [d.select(F.lit(name).alias("list"), "id", "ordinal", "score") for name, d in (("vector", vector), ("keyword", keyword), ("semantic", semantic))]
    return fuse_lists(lists[0].unionByName(lists[1]).unionByName(lists[2]), k, weights, metric, ("id", "ordinal"))


def rerank(hits: DataFrame, query: str, scorer, k: int = 3, by: str = "score", text_col: str = "content_preview", cache=None) -> DataFrame:
    """The k best by pair score, ``cross_score``; ties keep the order they came in. With a cache, known pairs aren't scored again."""
    scored = hits.withColumn("cross_score", scorer.column(query, F.col(text_col))) if cache is None else cache.scored(hits, query, scorer, text_col)
    return scored.orderBy(F.desc("cross_score"), F.desc(by), "ordinal").limit(k)


def similar(store: DataFrame, id_: str, k: int = 5, metric: str = "cosine") -> DataFrame:
    """The k nearest to a stored fragment, itself left out; empty for an unknown id."""
    row = store.where(F.col("id") == id_).select("embedding").first()
    if row is None or row[0] is None:
        return store.drop("embedding").withColumn("score", F.lit(0.0)).limit(0)
    return vector_search(store.where(F.col("id") != id_), unpacked(row[0]), k, metric)


def batch_vector_search(store: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine") -> DataFrame:
    """``query_id, rank, score`` and the store's columns of the k nearest for each of any number of queries ``query_id, query``."""
    near = nearest_of_many(store, queries, k, metric)
    return near.join(store.drop("embedding"), "ordinal")


def component_first(hits: DataFrame, order: Column) -> DataFrame:
    """For each file that has component hits, the best of these alone; all hits of other files.

    ``order`` is the hits' place; files come in the order of their first hit, and ``position`` counts the result.
    """
    ranked = hits.withColumn("_at", order)
    value = F.coalesce("cross_score", "score") if "cross_score" in hits.columns else F.col("score")
    file = Window.partitionBy("file_path")
    own = F.col("type") == "component"
    out = ranked.withColumns(
        {
            "_has": F.max(own).over(file),
            "_first": F.min("_at").over(file),
            "_best": F.row_number().over(file.orderBy(F.desc(own), F.when(own, value).desc_nulls_last(), "_at")),
        }
    ).where(~F.col("_has") | (F.col("_best") == 1))
    return out.orderBy("_first", "_at").drop("_has", "_best")


def response(hits: DataFrame, root: str, content: bool = True) -> DataFrame:
    """Hits as an answer shows them: paths from ``root`` on, an empty preview taken from the content."""
    shown = F.when(F.length(F.coalesce("content_preview", F.lit(""))) > 0, F.col("content_preview")).otherwise(preview(F.coalesce("full_content", F.lit(""))))
    cols = {"relative_path": relative_path(F.col("file_path"), root), "content_preview": shown, "component_name": F.coalesce("component_name", F.lit(""))}
    if content:
        cols["content"] = F.coalesce("full_content", F.lit(""))
    return hits.withColumns(cols).drop("file_path", "full_content")


def by_id(store: DataFrame, id_: str) -> DataFrame:
    return store.where(F.col("id") == id_)


def by_file(store: DataFrame, path: str) -> DataFrame:
    """Fragments of one file that have a vector."""
    return store.where((F.col("file_path") == path) & F.col("embedding").isNotNull()).select("id", "type", "name", "file_path", "file_name", "content_preview")
