"""The registered queries over the bundled tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import component, text, vector
from ..operators import encode, filters, fragments, scratch, search, store, training
from ..schema import TYPES
from ..sources import project, tables
from .engine import hybrid

QUERY = "the that on thtion in"
ANCHOR, DIM = 7, 32
FILE_PATH = "repo/web-app/src/src0/de/25.vue"

_found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(name: str, sql: str):
    def put(f):
        _found[name] = f, sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _found.items()}


# ---- SQL that several queries share

S = f"""d AS (
  SELECT doc_id::VARCHAR AS id, doc_id AS ordinal, ({list(TYPES)})[doc_id % 9 + 1] AS type, 'frag_' || doc_id AS name,
    'repo/web-app/src/' || source || '/' || lang || '/' || (doc_id // 4) || '.vue' AS file_path, (doc_id // 4) || '.vue' AS file_name,
    CASE WHEN length(text) > 150 THEN substring(text, 1, 150) || '...' ELSE text END AS content_preview, text AS full_content,
    CASE WHEN doc_id % 9 = 0 THEN 'Comp' || (doc_id % 50) END AS component_name, CASE WHEN doc_id % 9 = 0 THEN (['item','dense','title','value','label','extra'])[1:doc_id % 7] END AS props
  FROM documents
), s AS (SELECT d.*, embedding FROM d JOIN embeddings ON ordinal = vec_id), q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id = {ANCHOR})"""
DBL = "list_transform(embedding, lambda x: x::DOUBLE)"
SCORES = {"cosine": f"list_cosine_similarity({DBL}, v)", "ip": f"list_inner_product({DBL}, v)", "l2": f"0 - list_sum(list_transform(list_zip({DBL}, v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"}
WEIGHT = "CASE type WHEN 'component' THEN 1.3::DOUBLE WHEN 'javascript' THEN 1.2::DOUBLE WHEN 'script' THEN 1.2::DOUBLE WHEN 'template' THEN 1.1::DOUBLE WHEN 'css' THEN 0.9::DOUBLE WHEN 'style' THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END"
WORDS = "list_filter(regexp_split_to_array(lower(content_preview), '\\s+'), lambda w: w <> '')"


def _terms(hit: str, part: str, terms: list[str]) -> str:
    return " + ".join(f"CASE WHEN list_contains({WORDS}, '{t}') THEN {hit}::DOUBLE WHEN contains(lower(content_preview), '{t}') THEN {part}::DOUBLE ELSE 0::DOUBLE END" for t in terms)


KEYWORD = f"({_terms('3', '1', QUERY.split())}) * {WEIGHT}"
COVERAGE = f"({_terms('1', '0.5', list(dict.fromkeys(QUERY.split())))}) / {len(dict.fromkeys(QUERY.split()))}"
HASHED = f"list_transform(range({DIM}), lambda b: len(list_filter(list_transform({WORDS}, lambda w: ('0x' || substring(md5(w), 1, 6))::BIGINT % {DIM}), lambda x: x = b))::DOUBLE)"
MEANT = f"list_cosine_similarity({HASHED}, {vector.hashed_query(QUERY, DIM)}::DOUBLE[])"
LIGHT = "id, type, name, file_path, file_name, content_preview"


def _anchor(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector: one row, looked up by its id."""
    return list(tables.table(spark, sf_dir, "embeddings").where(F.col("vec_id") == ANCHOR).select("embedding").first()[0])


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in cols})


# ---- vectors


def _vector_query(metric: str) -> None:
    sql = f"WITH {S} SELECT vec_id, round({SCORES[metric]}, 6) + 0 AS score FROM embeddings, q ORDER BY {SCORES[metric]} DESC, vec_id LIMIT 10"

    @query(f"vec_topk_{metric}", sql)
    def run(spark, sf_dir):
        hits = search.vector_search(tables.vectors_as_store(spark, sf_dir), _anchor(spark, sf_dir), 10, metric)
        return _rounded(hits.select(F.col("ordinal").alias("vec_id"), "score"), "score")


for _metric in vector.METRICS:
    _vector_query(_metric)


@query("vec_topk_overfetch_filter", f"WITH {S}, n AS (SELECT s.*, {SCORES['cosine']} AS score FROM s, q ORDER BY score DESC, ordinal LIMIT 50) SELECT id, type, round(score, 6) AS score FROM n WHERE type = 'component' ORDER BY n.score DESC, ordinal LIMIT 10")
def _(spark, sf_dir):
    hits = search.vector_search(tables.documents_as_store(spark, sf_dir), _anchor(spark, sf_dir), 10, filters={"type": "component"}, details=tables.documents_as_store(spark, sf_dir, "none"))
    return _rounded(hits.select("id", "type", "score"), "score")


@query("vec_topk_exact_filter", f"WITH {S} SELECT id, type, round({SCORES['cosine']}, 6) AS score FROM s, q WHERE type = 'component' ORDER BY {SCORES['cosine']} DESC, ordinal LIMIT 10")
def _(spark, sf_dir):
    hits = search.vector_search(tables.documents_as_store(spark, sf_dir), _anchor(spark, sf_dir), 10, filters={"type": "component"}, mode="exact", details=tables.documents_as_store(spark, sf_dir, "none"))
    return _rounded(hits.select("id", "type", "score"), "score")


@query("similar_fragments", f"WITH {S} SELECT vec_id, round({SCORES['cosine']}, 6) AS score FROM embeddings, q WHERE vec_id <> {ANCHOR} ORDER BY {SCORES['cosine']} DESC, vec_id LIMIT 5")
def _(spark, sf_dir):
    hits = search.similar(tables.vectors_as_store(spark, sf_dir), str(ANCHOR), 5)
    return _rounded(hits.select(F.col("ordinal").alias("vec_id"), "score"), "score")


BATCH = "SELECT label, min(vec_id) AS query_id FROM embeddings GROUP BY label"


@query(
    "batch_knn_per_label",
    f"""WITH b AS ({BATCH}), qs AS (SELECT query_id, {DBL} AS v FROM b JOIN embeddings ON vec_id = query_id),
    r AS (SELECT query_id, vec_id, {SCORES["cosine"]} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {SCORES["cosine"]} DESC, vec_id) AS rank FROM embeddings, qs)
    SELECT query_id, vec_id, rank::INTEGER AS rank, round(score, 6) AS score FROM r WHERE rank <= 5""",
)
def _(spark, sf_dir):
    e = tables.vectors_as_store(spark, sf_dir)
    first = e.groupBy("label").agg(F.min("ordinal").alias("query_id")).select("query_id")
    asked = e.join(F.broadcast(first), F.col("ordinal") == F.col("query_id")).select("query_id", F.col("embedding").alias("query"))  # one for each of the labels
    hits = search.batch_vector_search(e, asked, 5)
    return _rounded(hits.select("query_id", F.col("ordinal").alias("vec_id"), "rank", "score"), "score")


# ---- words


@query("keyword_score_all", f"WITH {S} SELECT id, round({KEYWORD}, 6) AS score FROM d WHERE {KEYWORD} > 0")
def _(spark, sf_dir):
    rows = tables.documents_as_store(spark, sf_dir, "none")
    return _rounded(rows.select("id", text.keyword_score(F.col("content_preview"), F.col("type"), QUERY).alias("score")).where("score > 0"), "score")


@query("keyword_topk", f"WITH {S} SELECT {LIGHT}, round({KEYWORD}, 6) AS score FROM d WHERE {KEYWORD} > 0 ORDER BY {KEYWORD} DESC, ordinal LIMIT 20")
def _(spark, sf_dir):
    return _rounded(search.keyword_search(tables.documents_as_store(spark, sf_dir, "none"), QUERY).select(*LIGHT.split(", "), "score"), "score")


@query("semantic_topk", f"WITH {S} SELECT id, round({MEANT}, 6) AS score FROM d WHERE length(content_preview) > 0 ORDER BY {MEANT} DESC, ordinal LIMIT 20")
def _(spark, sf_dir):
    return _rounded(search.semantic_search(tables.documents_as_store(spark, sf_dir, "none"), QUERY, encode.HashedWords(DIM)).select("id", "score"), "score")


# ---- hybrid


def _hybrid_sql(k: int, where: str = "true", weights=search.WEIGHTS) -> str:
    a, b, c = (f"{w}::DOUBLE" for w in weights)
    return f"""WITH {S}, n AS (SELECT s.*, {SCORES["cosine"]} AS sc FROM s, q ORDER BY sc DESC, ordinal LIMIT {k if where == "true" else 5 * k}),
    l1 AS (SELECT id, ordinal, sc FROM n WHERE {where} ORDER BY sc DESC, ordinal LIMIT {k}),
    l2 AS (SELECT id, ordinal, {KEYWORD} AS sc FROM s WHERE {where} AND {KEYWORD} > 0 ORDER BY sc DESC, ordinal LIMIT {k}),
    l3 AS (SELECT id, ordinal, {MEANT} AS sc FROM s WHERE {where} AND length(content_preview) > 0 ORDER BY sc DESC, ordinal LIMIT {k}),
    ids AS (SELECT id, ordinal FROM l1 UNION SELECT id, ordinal FROM l2 UNION SELECT id, ordinal FROM l3),
    fused AS (SELECT ids.id, ids.ordinal, coalesce(l1.sc / (SELECT max(sc) FROM l1), 0) * {a} + coalesce(l2.sc / (SELECT max(sc) FROM l2), 0) * {b} + coalesce(l3.sc / (SELECT max(sc) FROM l3), 0) * {c} AS score
      FROM ids LEFT JOIN l1 USING (id) LEFT JOIN l2 USING (id) LEFT JOIN l3 USING (id) ORDER BY score DESC, ids.ordinal LIMIT {k}),
    hits AS (SELECT s.*, fused.score FROM fused JOIN s USING (id))"""


@query("hybrid_fusion", _hybrid_sql(10) + f" SELECT {LIGHT}, round(score, 6) AS score FROM hits")
def _(spark, sf_dir):
    hits = hybrid(tables.documents_as_store(spark, sf_dir), _anchor(spark, sf_dir), QUERY, k=10, semantic=encode.HashedWords(DIM), details=tables.documents_as_store(spark, sf_dir, "none"))
    return _rounded(hits.select(*LIGHT.split(", "), "score"), "score")


@query("hybrid_fusion_custom_weights", _hybrid_sql(10, "type = 'component'", (0.1, 0.7, 0.2)) + " SELECT id, type, round(score, 6) AS score FROM hits")
def _(spark, sf_dir):
    hits = hybrid(tables.documents_as_store(spark, sf_dir), _anchor(spark, sf_dir), QUERY, k=10, filters={"type": "component"}, semantic=encode.HashedWords(DIM), weights=(0.1, 0.7, 0.2), details=tables.documents_as_store(spark, sf_dir, "none"))
    return _rounded(hits.select("id", "type", "score"), "score")


@query("hybrid_rerank", _hybrid_sql(40) + f" SELECT id, round(score, 6) AS score, round({COVERAGE}, 6) AS cross_score FROM hits ORDER BY {COVERAGE} DESC, hits.score DESC, ordinal LIMIT 10")
def _(spark, sf_dir):
    hits = hybrid(tables.documents_as_store(spark, sf_dir), _anchor(spark, sf_dir), QUERY, k=10, rerank=True, semantic=encode.HashedWords(DIM), scorer=encode.Coverage(), details=tables.documents_as_store(spark, sf_dir, "none"))
    return _rounded(hits.select("id", "score", "cross_score"), "score", "cross_score")


@query("rerank_only", f"WITH {S} SELECT id, round({COVERAGE}, 6) AS cross_score FROM d ORDER BY {COVERAGE} DESC, ordinal LIMIT 3")
def _(spark, sf_dir):
    rows = tables.documents_as_store(spark, sf_dir, "none").withColumn("score", F.lit(0.0))
    return _rounded(search.rerank(rows, QUERY, encode.Coverage(), 3).select("id", "cross_score"), "cross_score")


FULL = (
    _hybrid_sql(80)
    + f""", r AS (SELECT *, {COVERAGE} AS cross_score, row_number() OVER (ORDER BY {COVERAGE} DESC, score DESC, ordinal) AS pos FROM hits), r20 AS (SELECT * FROM r WHERE pos <= 20),
    m AS (SELECT *, max(type = 'component') OVER (PARTITION BY file_path) AS has, min(pos) OVER (PARTITION BY file_path) AS first_pos,
      row_number() OVER (PARTITION BY file_path ORDER BY type = 'component' DESC, CASE WHEN type = 'component' THEN cross_score END DESC NULLS LAST, pos) AS best FROM r20)
    SELECT id, type, name, substring(file_path, 6) AS relative_path, file_name, full_content AS content, content_preview, coalesce(component_name, '') AS component_name, round(score, 6) AS score,
      round(cross_score, 6) AS cross_score, row_number() OVER (ORDER BY first_pos, pos)::INTEGER AS position FROM m WHERE NOT has OR best = 1"""
)


@query("hybrid_full_dedup", FULL)
def flagship(spark, sf_dir):
    """Three lists, fusion, reranking, component-first dedup and the answer's columns. What is sorted at the end is at most 20 rows."""
    s = tables.documents_as_store(spark, sf_dir)
    hits = hybrid(s, _anchor(spark, sf_dir), QUERY, k=20, rerank=True, semantic=encode.HashedWords(DIM), scorer=encode.Coverage(), details=tables.documents_as_store(spark, sf_dir, "none"))
    place = F.row_number().over(Window.orderBy(F.desc("cross_score"), F.desc("score"), "ordinal"))
    kept = search.component_first(hits, place)
    file = Window.partitionBy("file_path")
    kept = kept.withColumn("position", F.row_number().over(Window.orderBy(F.min("_at").over(file), "_at")))
    docs = tables.documents_as_store(spark, sf_dir, "none").select("id", "full_content", "component_name")
    out = search.response(docs.join(F.broadcast(kept), "id"), "web-app")
    return _rounded(out.select("id", "type", "name", "relative_path", "file_name", "content", "content_preview", "component_name", "score", "cross_score", "position"), "score", "cross_score")


@query(
    "dedup_component_first",
    f"""WITH {S}, k AS (SELECT *, {KEYWORD} AS score FROM d), m AS (SELECT *, max(type = 'component') OVER (PARTITION BY file_path) AS has,
      row_number() OVER (PARTITION BY file_path ORDER BY type = 'component' DESC, CASE WHEN type = 'component' THEN score END DESC NULLS LAST, ordinal) AS best FROM k)
    SELECT id, type, file_path, round(score, 6) AS score FROM m WHERE NOT has OR best = 1""",
)
def _(spark, sf_dir):
    rows = tables.documents_as_store(spark, sf_dir, "none").withColumn("score", text.keyword_score(F.col("content_preview"), F.col("type"), QUERY))
    return _rounded(search.component_first(rows, F.col("ordinal")).select("id", "type", "file_path", "score"), "score")


# ---- filters and lookups


def _filter_query(name: str, spec: dict, where: str) -> None:
    @query(name, f"WITH {S} SELECT id, type, component_name FROM d WHERE {where}")
    def run(spark, sf_dir):
        return filters.apply(tables.documents_as_store(spark, sf_dir, "none"), spec).select("id", "type", "component_name")


_filter_query("filter_scalar", {"type": "component", "query_text": "not a filter"}, "type = 'component'")
_filter_query("filter_in", {"type": ["css", "style"]}, "type IN ('css', 'style')")
_filter_query("filter_array_contains", {"props": "value"}, "list_contains(props, 'value')")
_filter_query("filter_missing_key", {"no_such_key": "x"}, "false")
_filter_query("filter_conjunction", {"component_name": "Comp9", "type": "component"}, "component_name = 'Comp9' AND type = 'component'")


@query("lookup_by_id", f"WITH {S} SELECT id, type, name, full_content, props FROM d WHERE id = '9'")
def _(spark, sf_dir):
    return search.by_id(tables.documents_as_store(spark, sf_dir, "none"), "9").select("id", "type", "name", "full_content", "props")


@query("lookup_by_file", f"WITH {S} SELECT {LIGHT} FROM s WHERE file_path = '{FILE_PATH}'")
def _(spark, sf_dir):
    return search.by_file(tables.documents_as_store(spark, sf_dir), FILE_PATH)


@query("health_status", "SELECT 'ok' AS status, count(*) AS fragments FROM documents")
def _(spark, sf_dir):
    return tables.documents_as_store(spark, sf_dir, "none").agg(F.lit("ok").alias("status"), F.count("*").alias("fragments"))


# ---- parsing and fragments

SRC = f"f AS (SELECT doc_id, {tables.PATH} AS path, {tables.FILE} AS file_name, {tables.EXTENSION} AS extension, {tables.SOURCE} AS c FROM documents)"


def _section_sql(column: str, tag: str, attributes: str = "") -> str:
    p = f"(?s)<{tag}{attributes}>(.*?)</{tag}>"
    return f"CASE WHEN regexp_matches({column}, '{p}') THEN regexp_replace(regexp_extract({column}, '{p}', 1), '^\\s+|\\s+$', '', 'g') END"


TPL, SCR, STY = _section_sql("c", "template"), _section_sql("c", "script"), _section_sql("c", "style", ".*?")
PARSED = f"""{SRC}, p0 AS (SELECT *, CASE WHEN extension = '.vue' THEN {TPL} END AS template, CASE WHEN extension = '.vue' THEN {SCR} END AS script, CASE WHEN extension = '.vue' THEN {STY} END AS style FROM f),
p1 AS (SELECT *, coalesce(script, '') AS sc FROM p0), p AS (SELECT *,
  CASE WHEN extension = '.vue' THEN coalesce(nullif(regexp_extract(sc, 'name:\\s*[''"]([^''"]+)[''"]', 1), ''), doc_id::VARCHAR) END AS component_name,
  CASE WHEN extension <> '.vue' THEN NULL WHEN regexp_matches(sc, '(?s)props:\\s*\\{{([^}}]+)\\}}') THEN regexp_extract_all(regexp_extract(sc, '(?s)props:\\s*\\{{([^}}]+)\\}}', 1), '(\\w+)\\s*:', 1)
    WHEN regexp_matches(sc, '(?s)props:\\s*\\[(.*?)\\]') THEN regexp_extract_all(regexp_extract(sc, '(?s)props:\\s*\\[(.*?)\\]', 1), '[''"]([^''"]+)[''"]', 1) ELSE [] END AS props,
  CASE WHEN extension <> '.vue' THEN NULL WHEN regexp_matches(sc, '(?s)components:\\s*\\{{([^}}]+)\\}}') THEN regexp_extract_all(regexp_extract(sc, '(?s)components:\\s*\\{{([^}}]+)\\}}', 1), '(\\w+)\\s*:', 1) ELSE [] END AS components
  FROM p1)"""


def _parsed(spark, sf_dir) -> DataFrame:
    return project.parse(tables.documents_as_files(spark, sf_dir))


@query("parse_sections", f"WITH {PARSED} SELECT doc_id, template, script, style FROM p")
def _(spark, sf_dir):
    return _parsed(spark, sf_dir).select("doc_id", "template", "script", "style")


@query("parse_component_name", f"WITH {PARSED} SELECT doc_id, component_name FROM p")
def _(spark, sf_dir):
    return _parsed(spark, sf_dir).select("doc_id", "component_name")


@query("parse_props", f"WITH {PARSED} SELECT doc_id, array_to_string(props, ',') AS props FROM p")
def _(spark, sf_dir):
    return _parsed(spark, sf_dir).select("doc_id", F.array_join("props", ",").alias("props"))


@query("parse_components", f"WITH {PARSED} SELECT doc_id, array_to_string(components, ',') AS components FROM p")
def _(spark, sf_dir):
    return _parsed(spark, sf_dir).select("doc_id", F.array_join("components", ",").alias("components"))


@query("parse_sections_html", f"SELECT page_id, {_section_sql('html', 'template')} AS template, {_section_sql('html', 'script')} AS script, {_section_sql('html', 'style', '.*?')} AS style FROM pages")
def _(spark, sf_dir):
    h = F.col("html")
    return tables.table(spark, sf_dir, "pages").select("page_id", component.template(h).alias("template"), component.script(h).alias("script"), component.style(h).alias("style"))


FRAGS = f"""{PARSED}, g AS (
  SELECT doc_id, path, file_name, 0 AS part, 'component' AS type, component_name AS name, c AS content, props, components, component_name AS own FROM p WHERE extension = '.vue'
  UNION ALL SELECT doc_id, path, file_name, 1, 'template', component_name || '_template', '<template>' || chr(10) || template || chr(10) || '</template>', NULL, NULL, component_name FROM p WHERE length(template) > 0
  UNION ALL SELECT doc_id, path, file_name, 2, 'script', component_name || '_script', '<script>' || chr(10) || script || chr(10) || '</script>', props, components, component_name FROM p WHERE length(script) > 0
  UNION ALL SELECT doc_id, path, file_name, 3, 'style', component_name || '_style', '<style scoped>' || chr(10) || style || chr(10) || '</style>', NULL, NULL, component_name FROM p WHERE length(style) > 0
  UNION ALL SELECT doc_id, path, file_name, 0, CASE WHEN extension = '.css' THEN 'css' ELSE 'javascript' END, file_name, c, NULL, NULL, NULL FROM p WHERE extension <> '.vue')"""


def _frags(spark, sf_dir) -> DataFrame:
    return fragments.fragments(_parsed(spark, sf_dir))


@query("fragment_explode", f"WITH {FRAGS} SELECT path AS file_path, type, name, content, array_to_string(props, ',') AS props FROM g")
def _(spark, sf_dir):
    return _frags(spark, sf_dir).select("metadata.file_path", "type", "name", "content", F.array_join("metadata.props", ",").alias("props"))


@query(
    "fragment_other_files",
    """WITH f AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN '.html' WHEN 1 THEN '.md' ELSE '' END AS extension FROM documents WHERE doc_id % 10 <> 0 AND text IS NOT NULL)
    SELECT 'site/' || source || '/' || doc_id || extension AS file_path, CASE WHEN extension = '.html' THEN 'html' ELSE 'generic' END AS type, doc_id || extension AS name, text AS content, extension,
    CASE WHEN extension = '.html' THEN 'html' END AS file_type FROM f""",
)
def _(spark, sf_dir):
    found = fragments.fragments(project.parse(tables.documents_as_other_files(spark, sf_dir)))
    return found.select("metadata.file_path", "type", "name", "content", "metadata.extension", "metadata.file_type")


@query("fragment_types", f"WITH {FRAGS} SELECT type, count(*) AS n FROM g GROUP BY type")
def _(spark, sf_dir):
    return fragments.type_counts(_frags(spark, sf_dir))


@query(
    "fragment_stats",
    f"""WITH {FRAGS} SELECT count(*) AS total_count, (SELECT string_agg(type || ':' || n, ',' ORDER BY type) FROM (SELECT type, count(*) AS n FROM g GROUP BY type)) AS by_type, '' AS by_component_type,
    count(*) FILTER (type = 'component' AND len(props) > 0) AS has_props, count(*) FILTER (type = 'component' AND len(components) > 0) AS has_components FROM g""",
)
def _(spark, sf_dir):
    as_text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return fragments.fragment_stats(_frags(spark, sf_dir)).withColumns({c: as_text(c) for c in ("by_type", "by_component_type")})


@query(
    "fragment_stats_table",
    f"""WITH {FRAGS} SELECT 'total_count' AS stat, NULL AS key, count(*) AS n FROM g UNION ALL SELECT 'has_props', NULL, count(*) FROM g WHERE type = 'component' AND len(props) > 0
    UNION ALL SELECT 'has_components', NULL, count(*) FROM g WHERE type = 'component' AND len(components) > 0
    UNION ALL SELECT 'by_type', type, count(*) FROM g GROUP BY type UNION ALL SELECT 'by_file', path, count(*) FROM g GROUP BY path""",
)
def _(spark, sf_dir):
    return fragments.fragment_stats_table(_frags(spark, sf_dir))


@query("fragments_by_file", f"WITH {FRAGS} SELECT f.path, count(g.path) AS n_fragments FROM f LEFT JOIN g USING (path) GROUP BY f.path")
def _(spark, sf_dir):
    return fragments.fragments_per_file(_parsed(spark, sf_dir))


@query(
    "embedding_text",
    f"""WITH {FRAGS} SELECT path AS file_path, type, concat_ws(' | ',
      CASE type WHEN 'component' THEN 'Vue 컴포넌트: ' || name WHEN 'template' THEN 'Vue 템플릿: ' || coalesce(own, name) WHEN 'script' THEN 'Vue 스크립트: ' || coalesce(own, name)
        WHEN 'javascript' THEN 'Vue 스크립트: ' || coalesce(own, name) WHEN 'style' THEN 'Vue 스타일: ' || coalesce(own, name) WHEN 'css' THEN 'CSS 파일: ' || name END,
      CASE WHEN type = 'component' AND len(props) > 0 THEN 'Props: ' || array_to_string(props, ', ') END, CASE WHEN type = 'component' AND len(components) > 0 THEN 'Components: ' || array_to_string(components, ', ') END,
      '파일: ' || file_name) || chr(10) || chr(10) || content AS embedding_text FROM g""",
)
def _(spark, sf_dir):
    m = "metadata."
    out = fragments.embedding_text(F.col("type"), F.col("name"), F.col("content"), F.col(m + "component_name"), F.col(m + "props"), F.col(m + "components"), F.col(m + "file_name"))
    return _frags(spark, sf_dir).select("metadata.file_path", "type", out.alias("embedding_text"))


NAME = "list_last(string_split(url, '/'))"


@query("file_info", f"SELECT page_id, {NAME} AS file_name, regexp_extract({NAME}, '^\\.*[^.].*?(\\.[^.]*)$', 1) AS extension, strlen(html)::BIGINT AS size FROM pages")
def _(spark, sf_dir):
    pages = tables.table(spark, sf_dir, "pages").selectExpr("page_id", "url AS path", "cast(octet_length(html) as long) AS size")
    return project.file_info(pages).select("page_id", "file_name", "extension", "size")


@query("ignore_filter", f"SELECT page_id, regexp_matches(url, '{project.IGNORED}') AS ignored FROM pages")
def _(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select("page_id", project.is_ignored(F.col("url")).alias("ignored"))


@query("parse_summary", f"WITH {SRC} SELECT extension, count(*) AS total_files, count(*) AS parsed_ok_count FROM f GROUP BY ROLLUP (extension)")
def _(spark, sf_dir):
    return fragments.parse_summary(_parsed(spark, sf_dir))


@query("preview", "SELECT doc_id, CASE WHEN length(text) > 150 THEN substring(text, 1, 150) || '...' ELSE text END AS content_preview FROM documents")
def _(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("content_preview"))


@query("relative_path", f"WITH {SRC} SELECT doc_id, substring(path, instr(path, 'web-app')) AS relative_path FROM f")
def _(spark, sf_dir):
    return tables.documents_as_files(spark, sf_dir).select("doc_id", text.relative_path(F.col("path"), "web-app").alias("relative_path"))


@query("api_projection", f"WITH {S} SELECT id, type, name, file_name, substring(file_path, 6) AS relative_path, content_preview, coalesce(component_name, '') AS component_name, full_content AS content FROM d")
def _(spark, sf_dir):
    return search.response(tables.documents_as_store(spark, sf_dir, "none"), "web-app").select("id", "type", "name", "file_name", "relative_path", "content_preview", "component_name", "content")


# ---- the store


@query("store_stats", f"WITH {S} SELECT count(*) AS vector_count, 64 AS dimension, 'cosine' AS index_type, count(DISTINCT file_path) AS file_counts, count(DISTINCT component_name) AS component_count, false AS cross_encoder FROM s")
def _(spark, sf_dir):
    return store.store_stats(tables.documents_as_store(spark, sf_dir), 64, "cosine")


@query("store_type_counts", f"WITH {S} SELECT type, count(*) AS n FROM s GROUP BY type")
def _(spark, sf_dir):
    return fragments.type_counts(tables.documents_as_store(spark, sf_dir))


def _halves(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").selectExpr("cast(doc_id as string) AS id", "text AS content", "lang", "source")
    vectors = tables.table(spark, sf_dir, "embeddings").selectExpr("cast(vec_id as string) AS id", "embedding")
    return docs, vectors


@query("store_add_anti", "SELECT doc_id::VARCHAR AS id, text AS content FROM documents JOIN embeddings ON doc_id = vec_id WHERE lang <> 'en'")
def _(spark, sf_dir):
    docs, vectors = _halves(spark, sf_dir)
    return store.additions(docs, vectors, docs.where("lang = 'en'")).select("id", "content")


@query("store_missing_embeddings", "SELECT doc_id::VARCHAR AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(spark, sf_dir):
    return store.without_vector(*_halves(spark, sf_dir)).select("id")


@query("store_orphans", "SELECT vec_id::VARCHAR AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def _(spark, sf_dir):
    return store.orphans(*_halves(spark, sf_dir)).select("id")


@query("store_ordinals", "SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS ordinal FROM documents")
def _(spark, sf_dir):
    return store.numbered(tables.table(spark, sf_dir, "documents").select("doc_id", "source"), [F.col("source"), F.col("doc_id")]).select("doc_id", "ordinal")


def _stored(spark, sf_dir, meanings: bool = False) -> store.FragmentStore:
    """Documents with their vectors, as they are, in a store of their own in the shared folder."""
    out = store.FragmentStore(spark, f"{scratch.shared_dir(spark)}/sparkloom/store-{uuid.uuid4().hex}", 64, "ip")
    vectors = tables.table(spark, sf_dir, "embeddings").selectExpr("cast(vec_id as string) AS id", "embedding")
    frags = tables.documents_as_fragments(spark, sf_dir)
    shown = frags.select("id", encode.HashedWords(DIM).column(text.preview(F.col("content"))).alias("meaning")).where(F.size("meaning") > 0)
    out.add(frags, vectors, scratch.written(shown, "meanings") if meanings else None)
    return out


IN_ORDER = ("SELECT d.*, embedding FROM d JOIN embeddings ON ordinal = vec_id", "SELECT d.* REPLACE (row_number() OVER (ORDER BY file_path, type, id) - 1 AS ordinal), embedding FROM d JOIN embeddings ON d.ordinal = vec_id")


@query("store_keyword_topk", f"WITH {S} SELECT id, type, round({KEYWORD}, 6) AS score FROM s WHERE {KEYWORD} > 0 ORDER BY {KEYWORD} DESC, ordinal LIMIT 20".replace(*IN_ORDER))
def _(spark, sf_dir):
    """Through the postings; ties go by the order of insertion."""
    return _rounded(_stored(spark, sf_dir).keyword_search(QUERY, 20).select("id", "type", "score"), "score")


@query("store_keyword_matches", f"WITH {S} SELECT id FROM s WHERE {KEYWORD} > 0")
def _(spark, sf_dir):
    return _stored(spark, sf_dir).matches(QUERY).select("id")


@query("store_hybrid", (_hybrid_sql(10) + " SELECT id, round(score, 6) AS score FROM hits").replace(*IN_ORDER))
def _(spark, sf_dir):
    """As ``hybrid_fusion``, over a store that keeps the vectors of previews."""
    hits = hybrid(_stored(spark, sf_dir, True).read(), _anchor(spark, sf_dir), QUERY, k=10, semantic=encode.HashedWords(DIM), vector_col="meaning")
    return _rounded(hits.select("id", "score"), "score")


@query("store_vector_by_id", f"SELECT vec_id::VARCHAR AS id, place - 1 AS place, round(embedding[place]::DOUBLE, 6) AS x FROM embeddings, range(1, 65) r(place) WHERE vec_id = {ANCHOR}")
def _(spark, sf_dir):
    found = _stored(spark, sf_dir).vector(str(ANCHOR))
    return _rounded(spark.createDataFrame([(str(ANCHOR), i, x) for i, x in enumerate(found or ())], "id string, place long, x double"), "x")


@query("store_lists_of_five", f"WITH {S} SELECT id, array_to_string(props[1:5], ',') AS props FROM s WHERE type = 'component'")
def _(spark, sf_dir):
    return store.top5(_stored(spark, sf_dir).read().where("type = 'component'")).select("id", F.array_join("props", ",").alias("props"))


@query("store_file_by_path", f"WITH {S} SELECT {LIGHT} FROM s WHERE file_path = '{FILE_PATH}'")
def _(spark, sf_dir):
    return search.by_file(_stored(spark, sf_dir).read(), FILE_PATH)


# ---- training

EX = """e AS (SELECT 'turn:' || u.conv_id || '/' || u.turn AS fragment_id, u.text AS query, a.text AS passage FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""
PAIRS = f"""{EX}, ring AS (SELECT fragment_id AS other_id, passage AS other, row_number() OVER (ORDER BY md5(fragment_id), fragment_id) - 1 AS place FROM e), n AS (SELECT count(*) AS n FROM ring),
  q AS (SELECT DISTINCT fragment_id, query FROM e), dr AS (SELECT fragment_id, query, step, (('0x' || substring(md5(fragment_id || '|' || query), 1, 8))::BIGINT % n.n + step) % n.n AS place FROM q, n, range(4) t(step)),
  neg AS (SELECT *, row_number() OVER (PARTITION BY fragment_id, query ORDER BY step) AS r FROM dr JOIN ring USING (place) WHERE fragment_id <> other_id),
  pairs AS (SELECT fragment_id, query, passage, 1 AS label FROM e UNION ALL SELECT fragment_id, query, other, 0 FROM neg WHERE r <= 3)"""


def _pairs(spark, sf_dir) -> DataFrame:
    return training.training_pairs(tables.conversations_as_examples(spark, sf_dir), "position")


@query("train_pairs", f"WITH {PAIRS} SELECT fragment_id, query, passage, label FROM pairs")
def _(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(
    "train_last_passage",
    f"""{EX.replace("e AS (", "WITH e AS (", 1)} SELECT 'turn:' || c AS fragment_id, passage FROM (SELECT split_part(split_part(fragment_id, ':', 2), '/', 1) AS c, passage,
    row_number() OVER (PARTITION BY split_part(split_part(fragment_id, ':', 2), '/', 1) ORDER BY split_part(fragment_id, '/', 2)::BIGINT DESC) AS r FROM e) WHERE r = 1""",
)
def _(spark, sf_dir):
    """Examples whose id repeats: a conversation's turns under one path; the last passage stays."""
    examples = tables.conversations_as_examples(spark, sf_dir).withColumn("fragment_path", F.split("fragment_path", "/")[0])
    return training.passages(examples, "position")


@query("train_positive_only", f"WITH {EX} SELECT query, passage, 1 AS label FROM e")
def _(spark, sf_dir):
    return training.positives(tables.conversations_as_examples(spark, sf_dir)).select("query", "passage", "label")


@query(
    "train_split",
    f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', fragment_id, query, passage)), fragment_id, query, passage) AS r, count(*) OVER (PARTITION BY label) AS n FROM pairs)
    SELECT fragment_id, query, passage, label, r <= ceil(n * 0.1::DOUBLE) AS is_validation FROM r""",
)
def _(spark, sf_dir):
    return training.stratified_split(_pairs(spark, sf_dir), ["fragment_id", "query", "passage"])


@query("label_counts", f"WITH {PAIRS} SELECT label, count(*) AS n FROM pairs GROUP BY label")
def _(spark, sf_dir):
    return training.label_counts(_pairs(spark, sf_dir))


TESTED = 3


@query(
    "eval_hit_at_k",
    f"""WITH {EX}, x AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: w <> '')) AS terms FROM (SELECT DISTINCT * FROM e ORDER BY fragment_id LIMIT {TESTED})),
    sc AS (SELECT x.query, x.fragment_id AS correct_id, e.fragment_id AS id, list_sum(list_transform(x.terms, lambda t: CASE WHEN list_contains(regexp_split_to_array(lower(e.passage), '\\s+'), t) THEN 1::DOUBLE WHEN contains(lower(e.passage), t) THEN 0.5::DOUBLE ELSE 0::DOUBLE END)) / len(x.terms) AS s FROM x, e),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rank FROM sc) SELECT query, max((id = correct_id)::INTEGER) AS hit FROM r WHERE rank <= 3 GROUP BY query""",
)
def _(spark, sf_dir):
    """The first three examples' questions, as this check is defined, each against all passages."""
    own = training.keyed_examples(tables.conversations_as_examples(spark, sf_dir))
    asked = own.orderBy("fragment_id").limit(TESTED).select(F.col("questions")[0].alias("query"), F.col("fragment_id").alias("correct_id"), F.col("fragment_summary").alias("passage"))
    ranks = training.right_ranks(own.select("fragment_id", F.col("fragment_summary").alias("passage")), asked, encode.Coverage())
    return ranks.groupBy("query").agg(F.max((F.col("rank") <= 3).cast("int")).alias("hit"))


@query("pair_cache_key", "SELECT doc_id, item_id, md5(b.text || '|' || d.text) AS key FROM documents d JOIN (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS at, count(*) OVER () AS n FROM benchmark) b ON b.at = d.doc_id % b.n")
def _(spark, sf_dir):
    items = tables.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    b, n = store.numbered(items, [F.col("item_id")], "at"), items.count()
    d = tables.table(spark, sf_dir, "documents").withColumn("at", F.col("doc_id") % max(1, n))
    return d.join(b, "at").select("doc_id", "item_id", encode.pair_cache_key(F.col("query"), F.col("text")).alias("key"))
