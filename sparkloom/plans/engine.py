"""The façade: index a project, search it, look things up."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import preview
from ..operators import search as ops
from ..operators.encode import Coverage, HashedWords, PairScorer, ScoreCache, TextEncoder, VectorCache
from ..operators.fragments import embedding_text, file_counts, fragments, summary
from ..operators.scratch import scope, written
from ..operators.store import FragmentStore, store_stats, top5
from ..sources.project import SearchRequest, parse, read_any

log = logging.getLogger(__name__)


def hybrid(
    store: DataFrame, query_vector: list[float] | None, text: str | None, *, k: int = 5, metric: str = "cosine", filters: dict[str, Any] | None = None, rerank: bool = False, semantic=None, scorer=None,
    weights: tuple[float, float, float] = ops.WEIGHTS, keyword_filter: bool = True, mode: str = "overfetch", details: DataFrame | None = None, vector_col: str | None = None,
    pairs: ScoreCache | None = None,
) -> DataFrame:
    """One plan for a search: three lists from one scan, their fusion, and the reranking if it is asked for and can be done.

    The vector list is fused only if there is a text. ``keyword_filter=False`` leaves the keyword list
    unfiltered. A rerank takes 4k candidates. Hits' columns come from ``details`` (the store itself if
    there is none), by one late look-up; ``vector_col`` has the previews' vectors, if they are kept;
    ``pairs`` has scores of pairs from earlier searches and keeps new ones.
    The columns are the store's that a hit shows, ``ordinal``, ``score`` and, reranked,
    ``cross_score``; rows come in order.
    """
    many = 4 * k if rerank else k
    shown = store if details is None else details
    shown = shown.select("ordinal", *ops_columns(shown))
    if not text:
        return ops.vector_search(store, query_vector, many, metric, filters, mode, shown)
    lists = ops.three_lists(store, query_vector, text, semantic or HashedWords(), many, metric=metric, filters=filters, keyword_filter=keyword_filter, mode=mode, vector_col=vector_col)
    hits = ops.looked_up(ops.fuse_lists(lists, many, weights, metric), shown, many)
    if rerank and scorer is not None:
        return ops.rerank(hits, text, scorer, k, cache=pairs)
    return hits.limit(k)


def ops_columns(df: DataFrame) -> list[str]:
    return [c for c in ("id", "type", "name", "file_path", "file_name", "content_preview") if c in df.columns]


class Engine:
    """A store with its encoders. ``semantic`` encodes previews, ``scorer`` judges pairs; both are plug-ins.

    Vectors of contents and of previews and scores of pairs are kept by content and plug-in, so that
    nothing is encoded or scored twice; the store's rows have the vectors that a search scans.
    """

    def __init__(
        self, spark: SparkSession, path: str, *, encoder: TextEncoder | None = None, semantic: TextEncoder | None = None, scorer: PairScorer | None = None, metric: str = "cosine", root: str = "src",
        sink: Callable[[dict], None] | None = None,
    ):
        self.spark, self.encoder, self.semantic = spark, encoder or HashedWords(), semantic or HashedWords()
        self.scorer, self.root, self.sink = scorer or Coverage(), root, sink
        path = path.rstrip("/")
        self.store = FragmentStore(spark, f"{path}/store", self.encoder.dim, metric)
        self.cache, self.meanings, self.pairs = VectorCache(spark, f"{path}/vectors"), VectorCache(spark, f"{path}/meanings"), ScoreCache(spark, f"{path}/pairs")

    def index(self, project: str, reload: bool = False) -> dict[str, Any]:
        """Scan, parse, fragment, encode and add; ``reload`` puts the result in place of what the store has.

        Files are read once; what is told of them (``file_counts``) is counted on the way.
        """
        told = Observation()
        parsed = parse(read_any(self.spark, project)).observe(told, *file_counts())
        with scope(self.spark):
            frags = written(fragments(parsed), "fragments")
            files = summary(told.get)
            self.add(frags, reload, files=files)
        return files

    def add(self, frags: DataFrame, reload: bool = False, **about: Any) -> None:
        """Encode and add fragments, which are evaluated several times: a written table."""
        with scope(self.spark):
            m = "metadata."
            text = embedding_text(F.col("type"), F.col("name"), F.col("content"), F.col(m + "component_name"), F.col(m + "props"), F.col(m + "components"), F.col(m + "file_name"))
            vectors = self.cache.encode(frags.select("id", text.alias("text")), "text", self.encoder).select("id", "embedding")
            shown = frags.select("id", preview(F.col("content")).alias("text")).where(F.length("text") > 0)
            meanings = self.meanings.encode(shown, "text", self.semantic, "meaning").select("id", "meaning")
            self.store.add(frags, written(vectors, "vectors"), written(meanings, "meanings"), reload, semantic=self.semantic.name, **about)

    def _meaning(self) -> str | None:
        """The column of the previews' vectors, if all batches have those of this encoder."""
        names = {e.about.get("semantic") for e in self.store.batches.entries() if e.count}
        return "meaning" if names == {self.semantic.name} else None

    def search(self, request: SearchRequest, weights: tuple[float, float, float] = ops.WEIGHTS) -> DataFrame:
        return hybrid(
            self.store.read(), self.encoder.query(request.query), request.query, k=request.k, metric=self.store.metric, filters=request.filters, rerank=request.rerank, semantic=self.semantic,
            scorer=self.scorer, weights=weights, vector_col=self._meaning(), pairs=self.pairs,
        )

    def words(self, query: str, k: int = 5, filters: dict[str, Any] | None = None) -> DataFrame:
        """Keyword search alone, through the postings."""
        return self.store.keyword_search(query, k, filters)

    def _hits(self, request: SearchRequest) -> DataFrame:
        """A search's hits with what a response needs, run once: at most k rows, which are read by the driver."""
        by = "cross_score" if request.rerank else "score"
        hits = self.search(request).withColumn("position", F.row_number().over(Window.orderBy(F.desc(by), F.desc("score"), "ordinal")))
        full = hits.join(self.store.read().select("id", "full_content", "component_name"), "id").orderBy("position")
        return self.spark.createDataFrame(full.collect(), full.schema)

    def answer(self, request: SearchRequest) -> dict[str, Any]:
        """A search as a response: the sink gets all hits, the caller those that component-first dedup leaves.

        If the pair scorer fails, the answer is the fused list, and says that it isn't reranked.
        """
        import time

        began = time.time()
        try:
            full = self._hits(request)
        except Exception:
            if not request.rerank:
                raise
            log.exception("the pair scorer failed; the fused list is given")
            request = replace(request, rerank=False)
            full = self._hits(request)
        rows = [r.asDict() for r in ops.response(ops.component_first(full, F.col("position")), self.root).collect()]
        elapsed = time.time() - began
        about = {"query": request.query, "elapsed_time": elapsed, "reranked": request.rerank, "requirement_id": request.requirement_id}
        if self.sink is not None:
            sent = [r.asDict() for r in ops.response(full, self.root).drop("content").collect()]
            try:
                self.sink(about | {"total_results": len(sent), "results": sent})
            except Exception:  # a sink's trouble is not the caller's
                log.exception("the result sink failed")
        return about | {"total_results": len(rows), "results": rows}

    def similar(self, id_: str, k: int = 5) -> DataFrame:
        return ops.similar(self.store.read(), id_, k, self.store.metric)

    def fragment(self, id_: str) -> dict[str, Any]:
        row = top5(ops.by_id(self.store.read(), id_)).drop("embedding", "meaning").first()
        if row is None:
            raise KeyError(id_)
        return row.asDict()

    def file(self, path: str) -> list[dict[str, Any]]:
        rows = [r.asDict() for r in ops.by_file(self.store.read(), path).collect()]
        if not rows:
            raise KeyError(path)
        return rows

    def stats(self) -> dict[str, Any]:
        store = self.store.read()
        caches = {name: c.stats().first().asDict() for name, c in (("vectors", self.cache), ("meanings", self.meanings), ("pairs", self.pairs))}
        return store_stats(store, self.store.dim, self.store.metric, self.scorer.name).first().asDict() | {"fragment_types": self.store.counts()["by_type"], "caches": caches}

    def status(self) -> dict[str, Any]:
        return {"status": "ok", "fragments": self.store.counts()["total"], "encoder": self.encoder.name, "scorer": self.scorer.name}
