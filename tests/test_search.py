"""Scores, filters, rankings and the façade."""

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text, vector
from sparkloom.operators import encode, filters, search, store, training
from sparkloom.plans.cli import Shell
from sparkloom.plans.engine import Engine
from sparkloom.sources import project
from sparkloom.sources.project import SearchRequest, parse_command


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("preview, kind, score", [("todo list view", "component", 11.7), ("mytodolist", "css", 2.7), ("a todo.", "generic", 1.6), ("none", "script", 0)])
def test_keyword(spark, preview, kind, score):
    assert one(spark, text.keyword_score(F.lit(preview), F.lit(kind), "todo list todo")) == pytest.approx(score)


def test_text(spark):
    assert one(spark, text.preview(F.lit("x" * 150))) == "x" * 150
    assert one(spark, text.preview(F.lit("😀" * 151))) == "😀" * 150 + "..."
    assert one(spark, text.strip(F.lit(" 　\n a b\t"))) == "a b"
    for path, ext, stem in (("a/b.vue", ".vue", "b"), ("a/.hidden", "", ".hidden"), ("a.b/c", "", "c"), ("x/.a.js", ".js", ".a"), ("c.d.ts", ".ts", "c.d"), ("a.", ".", "a")):
        assert (one(spark, text.extension(F.lit(path))), one(spark, text.stem(F.lit(path)))) == (ext, stem)
    assert one(spark, text.relative_path(F.lit("/x/web/a"), "web")) == "web/a" and one(spark, text.relative_path(F.lit("/x/a"), "web")) == "/x/a"


def test_vectors(spark):
    a, b = F.array(*map(F.lit, (1.0, 2.0, 2.0))), [3.0, 0.0, 4.0]
    for q in (b, F.array(*map(F.lit, b)), ):
        assert one(spark, vector.dot(a, q)) == 11
        assert one(spark, vector.squared_distance(a, q)) == 12
        assert one(spark, vector.cosine(a, q)) == pytest.approx(11 / 15)
    assert one(spark, vector.cosine(F.array(F.lit(0.0)), [1.0])) is None
    assert one(spark, vector.hashed_words(text.tokens(F.lit("A b a")), 8)) == vector.hashed_query("a B a", 8)
    with pytest.raises(ValueError):
        vector.score(a, b, "hamming")


@pytest.fixture(scope="module")
def rows(spark):
    data = [(str(i), i, ["component", "css", "script"][i % 3], f"f{i}", f"p/{i // 3}.vue", f"{i // 3}.vue", f"word{i} common", ["a", "b"][: i % 3], [float(i % 5), 1.0]) for i in range(12)]
    return spark.createDataFrame(data, "id string, ordinal long, type string, name string, file_path string, file_name string, content_preview string, props array<string>, embedding array<double>")


def ids(df):
    return [r["id"] for r in df.collect()]


def test_filters(rows):
    assert len(ids(filters.apply(rows, {"type": "css"}))) == 4
    assert len(ids(filters.apply(rows, {"type": ["css", "script"]}))) == 8
    assert ids(filters.apply(rows, {"props": "b"})) == ["2", "5", "8", "11"]
    assert ids(filters.apply(rows, {"nothing": 1})) == []
    assert len(ids(filters.apply(rows, {"rerank": True, "query_text": "x"}))) == 12


def test_vector_search(rows):
    full = ids(search.vector_search(rows, [1.0, 0.0], 12))
    assert full[:2] == ["4", "9"]  # a tie, in the order of insertion
    assert ids(search.vector_search(rows, [1.0, 0.0], 5)) == full[:5]
    over = ids(search.vector_search(rows, [1.0, 0.0], 1, filters={"type": "css"}))
    exact = ids(search.vector_search(rows, [1.0, 0.0], 1, filters={"type": "css"}, mode="exact"))
    assert set(over) <= set(exact)
    assert ids(search.similar(rows, "4", 1)) == ["9"] and ids(search.similar(rows, "none")) == []


def test_fusion(rows):
    near, words = search.vector_search(rows, [1.0, 0.0], 5), search.keyword_search(rows, "word3 common", 5)
    a = search.fuse(near, words, near.limit(0), 5).collect()
    assert a[0]["score"] <= 0.6 and a == search.fuse(near, words, near.limit(0), 5).collect()
    far = search.fuse(search.vector_search(rows, [0.0, 1.0], 3, "l2"), words.limit(0), words.limit(0), 3, metric="l2").collect()
    assert far[0]["id"] == "0"  # the nearest, at distance 0


def test_component_first(spark):
    hits = spark.createDataFrame([("a", "A", "component", 0.5, 1), ("b", "B", "css", 0.3, 2), ("c", "A", "component", 0.9, 3), ("d", "A", "script", 0.99, 4), ("e", "B", "js", 0.2, 5)], "id string, file_path string, type string, score double, pos int")
    assert ids(search.component_first(hits, F.col("pos"))) == ["c", "b", "e"]


def test_requests():
    r = parse_command("add item --type=component --rerank --weight=0.3")
    assert (r.query, r.filters, r.rerank, r.ensemble_weight) == ("add item", {"type": "component"}, True, 0.3)
    for bad in (lambda: parse_command("x --weight=much"), lambda: SearchRequest("x", 21), lambda: SearchRequest("x", 5, ensemble_weight=2)):
        with pytest.raises(ValueError):
            bad()


def test_numbered(spark):
    df = spark.range(100).repartition(7)
    assert [r["ordinal"] for r in store.numbered(df, [F.col("id")]).orderBy("id").collect()] == list(range(100))


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbered_wide(spark, tmp_path, adaptive):
    """Many wide rows over many partitions: the sampled bounds of two evaluations would differ."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        n = 3_000_000
        key = F.md5(F.col("id").cast("string"))
        rows = spark.range(n).select("id", key.alias("key"), F.concat(*[F.sha2(F.concat("id", F.lit(i)), 256) for i in range(2)]).alias("wide"))
        out = str(tmp_path / "numbered")
        store.numbered(rows, [F.col("key"), F.col("id")], start=5).write.parquet(out)
        got = spark.read.parquet(out)
        assert got.agg(F.count_distinct("ordinal"), F.min("ordinal"), F.max("ordinal")).first() == (n, 5, n + 4)
        edge = got.orderBy("key", "id").limit(1000).select("ordinal").collect()
        assert [r[0] for r in edge] == list(range(5, 1005))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_filters_are_pushed_down(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(100).select(F.col("id").cast("string").alias("name"), (F.col("id") % 3).cast("string").alias("type")).write.partitionBy("type").parquet(path)
    plan = filters.apply(spark.read.parquet(path), {"type": "1", "name": ["7", "8"]})._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "PartitionFilters: [isnotnull(type" in scan and "PushedFilters: [In(name" in scan


class Broken:
    name = "broken"

    def column(self, query, passage):
        return F.raise_error(F.concat(F.lit("no model for "), passage)).cast("double")


def test_answer_without_scorer(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for name in ("a.js", ".h.js", "_h.js"):
        (src / name).write_text(f"const item = '{name}'")
    engine = Engine(spark, str(tmp_path / "data"), scorer=Broken())
    engine.index(str(src))
    assert engine.status()["fragments"] == 3  # names that begin with a dot or an underscore too
    got = engine.answer(SearchRequest("item", k=2, rerank=True))
    assert not got["reranked"] and got["total_results"] == 2


def test_plugins(spark):
    def make():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([("ab",), (None,), ("abcd",)], "t string")
    batch = encode.BatchEncoder("len", 2, make, batch_size=2, normalize=False)
    assert sorted(r[0] for r in rows.select(batch.column(F.col("t"))).collect()) == [[0.0, 1.0], [2.0, 1.0], [4.0, 1.0]]
    assert batch.query("abc") == [3.0, 1.0]
    scorer = encode.BatchScorer("overlap", lambda: lambda q, ps: [len(set(q) & set(p)) for p in ps], batch_size=2)
    assert sorted(r[0] for r in rows.select(scorer.column("bcd", F.col("t"))).collect()) == [0.0, 1.0, 3.0]


def test_training(spark, tmp_path):
    path = tmp_path / "examples.json"
    path.write_text(json.dumps([{"fragment_type": "css", "fragment_path": f"p{i}", "fragment_summary": f"s{i}", "questions": [f"q{i}", f"r{i}"]} for i in range(6)]))
    ex = project.read_examples(spark, str(path)).withColumn("position", F.monotonically_increasing_id())
    pairs = training.training_pairs(ex, "position")
    got = pairs.collect()
    assert len(got) == 12 * 4 and sorted(map(tuple, got)) == sorted(map(tuple, training.training_pairs(ex, "position").collect()))
    assert all((r["passage"][1:] == r["query"][1:]) == (r["label"] == 1) for r in got)
    split = training.stratified_split(pairs, ["fragment_id", "query", "passage"]).where("is_validation")
    assert {r["label"]: r["n"] for r in training.label_counts(split).collect()} == {0: 4, 1: 2}
    assert training.training_pairs(ex.limit(0), "position").count() == 0
    assert encode.pair_cache_key(F.lit("a"), F.lit("b")) is not None


def test_engine(spark, tmp_path):
    src = tmp_path / "web" / "src"
    src.mkdir(parents=True)
    for i in range(4):
        (src / f"Item{i}.vue").write_text(f"<template><p>item {i} list</p></template><script>export default {{ name: 'Item{i}', props: ['one'] }}</script>")
    sent = []
    engine = Engine(spark, str(tmp_path / "data"), root="web", sink=sent.append)
    assert engine.store.is_empty() and engine.search(SearchRequest("item")).count() == 0
    engine.index(str(tmp_path / "web"))
    assert engine.stats()["vector_count"] == 12 and engine.stats()["component_count"] == 4
    engine.index(str(tmp_path / "web"))
    assert engine.status()["fragments"] == 12  # adding again adds nothing
    got = engine.answer(SearchRequest("item list", k=8))
    assert len({r["relative_path"] for r in got["results"]}) == got["total_results"] and got["results"][0]["relative_path"].startswith("web/src/Item")
    assert sent and sent[0]["total_results"] == 8
    first = got["results"][0]
    assert engine.fragment(first["id"])["props"] == ["one"]
    assert len(engine.file(engine.fragment(first["id"])["file_path"])) == 3
    with pytest.raises(KeyError):
        engine.fragment("none")
    with pytest.raises(KeyError):
        engine.file("none")
    assert engine.similar(first["id"], 3).count() == 3
    import io

    shell = Shell(engine, stdout=io.StringIO())
    for line in ("view 1", "search item --type=component", "view 1", "view 99", "search", "quit"):
        stopped = shell.onecmd(line)
    assert stopped and "props: one" in shell.stdout.getvalue()
    (src / "New.ts").write_text("export const item = 1")
    from sparkloom.streaming.ingest import ingest

    ingest(engine, str(tmp_path / "web"), str(tmp_path / "checkpoint")).awaitTermination()
    assert engine.status()["fragments"] == 13
    engine.index(str(tmp_path / "web"), reload=True)
    assert engine.status()["fragments"] == 13 and engine.cache.stats().first()["count"] == 13
    engine.store.clear()
    assert engine.store.is_empty()
