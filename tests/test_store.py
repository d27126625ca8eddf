"""The store's mechanisms: committed batches, postings, packed vectors, kept vectors and scores, look-ups."""

import math
import random
import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import encode, search, store, words
from sparkloom.operators.batches import Batches, Conflict
from sparkloom.operators.nearest import Ranking, rankings
from sparkloom.plans.engine import Engine, hybrid
from sparkloom.schema import FRAGMENTS
from sparkloom.sources.project import SearchRequest


def frags_of(spark, rows):
    """(id, type, content, path) as fragments."""
    made = [(i, t, f"n{i}", c, (p, p.split("/")[-1], f"C{i}", ["one"] if t == "component" else None, [], None, None)) for i, t, c, p in rows]
    return spark.createDataFrame(made, FRAGMENTS)


def vectors_of(spark, ids, dim=4, seed=1):
    r = random.Random(seed)
    return spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(dim)]) for i in ids], "id string, embedding array<double>")


# ---- batches


def test_two_adds_at_once(spark, tmp_path):
    """Ordinals are reserved by whoever commits first; ids that both add are added once."""
    path = str(tmp_path / "s")
    parts = [[(f"{who}{k}", "css", f"text {who} {k}", f"p/{who}{k}.css") for k in range(20)] + [(f"both{k}", "css", f"same {k}", f"p/both{k}.css") for k in range(10)] for who in "abc"]
    errors = []

    def add(part):
        try:
            store.FragmentStore(spark, path, 4).add(frags_of(spark, part), vectors_of(spark, [x[0] for x in part]))
        except Exception as e:  # told below
            errors.append(e)

    threads = [threading.Thread(target=add, args=(p,)) for p in parts]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    s = store.FragmentStore(spark, path, 4)
    rows = s.read().select("id", "ordinal").collect()
    assert sorted(r["ordinal"] for r in rows) == list(range(70)) and len({r["id"] for r in rows}) == 70
    assert s.counts()["total"] == 70 == s.counts()["by_type"]["css"]
    before = {r["id"]: r["ordinal"] for r in rows}
    s.compact()
    assert {r["id"]: r["ordinal"] for r in s.read().select("id", "ordinal").collect()} == before and len(s.batches.entries()) == 1
    assert s.counts()["total"] == 70 and s.keyword_search("same", 30).count() == 10


class Fails:
    name = "fails"


def test_a_failed_add_leaves_nothing(spark, tmp_path):
    s = store.FragmentStore(spark, str(tmp_path / "s"), 4)
    s.add(frags_of(spark, [("a", "css", "x", "p/a.css")]), vectors_of(spark, ["a"]))
    broken = frags_of(spark, [("b", "css", "x", "p/b.css")]).withColumn("content", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        s.add(broken, vectors_of(spark, ["b"]))
    assert [r["id"] for r in s.read().collect()] == ["a"]
    s.add(frags_of(spark, [("c", "css", "x", "p/c.css")]), vectors_of(spark, ["c"]))
    assert {r["id"]: r["ordinal"] for r in s.read().collect()} == {"a": 0, "c": 1}
    s.add(frags_of(spark, [("c", "css", "x", "p/c.css")]), vectors_of(spark, ["c"]))
    assert len(s.batches.entries()) == 2  # nothing new is no batch
    s.add(frags_of(spark, [("d", "css", "x", "p/d.css")]), vectors_of(spark, ["d"]), replaces=True)
    assert {r["id"]: r["ordinal"] for r in s.read().collect()} == {"d": 0}


def test_commits_are_in_order(spark, tmp_path):
    b = Batches(spark, str(tmp_path / "b"))
    first = b.commit([], "x", 5)
    with pytest.raises(Conflict):
        b.commit([], "y", 3)
    assert b.commit([first], "y", 3).first == 5
    assert [e.batch for e in b.entries()] == ["x", "y"]
    b.clear()
    assert b.commit(b.entries(), "z", 1).first == 0


# ---- postings


def test_postings_name_what_scores(spark):
    r = random.Random(3)
    some = ["todo", "list", "to", "a", "öl", "todolist", "İx", "日本", "x.y", "item", " ", "\n"]
    texts = ["".join(r.choices(some, k=r.randint(0, 8))) for _ in range(400)] + [None, "", " "]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "place long, content_preview string")
    index = words.postings(rows).cache()
    for query in ("todo", "to", "a", "todo nothinglikeit", "TODOLIST list", "öl", "日", "no match", "", "x.y item", "todolistitem"):
        got = sorted(x[0] for x in words.candidates(index, query).collect())
        terms = query.lower().split()
        assert len(set(got)) == len(got) and set(got) >= {k for k, t in enumerate(texts) if any(w in (t or "").lower() for w in terms)}, query
        assert all(any(all(g in texts[k].lower() for g in words.grams_of(w)) for w in terms) for k in got), query


def test_only_matches_are_scored(spark, tmp_path):
    """Rows that reach the score are those with a term, whatever the store's size."""
    part = [(f"i{k}", "css", f"word{k % 500} filler text {k}", f"p/{k}.css") for k in range(3000)]
    s = store.FragmentStore(spark, str(tmp_path / "s"), 4)
    s.add(frags_of(spark, part), vectors_of(spark, [x[0] for x in part]))
    for query, n in (("word77", 6), ("word7", 60), ("nowhere", 0)):
        want = sum(query in x[2] for x in part)
        assert s.matches(query).count() == want and want >= n
        got = s.keyword_search(query, 5).select("id", "score").collect()
        flat = search.keyword_search(s.read(), query, 5).select("id", "score").collect()
        assert got == flat


# ---- vectors


def brute(vectors, q, k, metric):
    out = []
    for i, v in enumerate(vectors):
        if v is None or len(v) != len(q) or any(x is None or not np.isfinite(x) for x in v):
            continue
        a, b = np.array(v, float), np.array(q, float)
        if metric == "cosine" and not (a.any() and b.any()):
            continue
        s = a @ b if metric == "ip" else -((a - b) ** 2).sum() if metric == "l2" else a @ b / np.sqrt((a @ a) * (b @ b))
        out.append((-round(float(s), 9), i))
    return [i for _, i in sorted(out)[:k]]


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(1)
    made = [[float(np.float32(x)) for x in v] for v in r.normal(size=(500, 6))]
    made[100:130] = [made[3]] * 30  # ties
    return [*made, None, [], [1.0] * 5, [0.0] * 6, [1.0] * 5 + [None], [float("nan")] * 6, [float("inf")] + [1.0] * 5]


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_nearest(spark, vectors, metric, packed):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "ordinal long, embedding array<double>").repartition(5)
    if packed:
        df = df.withColumn("embedding", store.pack(F.col("embedding"), 6))
    q = vectors[3]
    got = search.vector_search(df.withColumn("id", F.col("ordinal").cast("string")), q, 40, metric)
    assert [r["ordinal"] for r in got.collect()] == brute(vectors, q, 40, metric)
    queries = spark.createDataFrame([(f"q{i}", vectors[i]) for i in (3, 7, 100, 500, 502, 503)], "query_id string, query array<double>")
    near = search.batch_vector_search(df, queries, 35, metric)
    found = {}
    for r in near.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["ordinal"])
    want = {f"q{i}": brute(vectors, vectors[i], 35, metric) for i in (3, 7, 100, 503, *(() if packed else (502,)))}  # a packed column has one size
    assert found == {k: v for k, v in want.items() if v}


def test_many_queries(spark):
    """More queries than any block or former limit has, dealt and not broadcast."""
    from sparkloom.operators import nearest

    r = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(60, 3)))], "ordinal long, embedding array<double>")
    asked = spark.range(12_000).select(F.col("id").alias("query_id"), F.array(F.sin("id"), F.cos("id"), F.lit(0.5)).alias("query"))
    one = nearest.nearest_of_many(rows, asked, 2, "ip")
    before = nearest.SENT_BLOCKS
    nearest.SENT_BLOCKS = 1
    try:
        two = nearest.nearest_of_many(rows, asked, 2, "ip")
        assert one.count() == 24_000 and one.exceptAll(two).count() == 0
    finally:
        nearest.SENT_BLOCKS = before


def test_lists_are_bounded_and_exact(spark):
    rows = spark.range(10_000).select(F.col("id").alias("ordinal"), (F.col("id") % 97).cast("double").alias("s"))
    got = rankings(rows.repartition(8), [Ranking("a", 5, F.col("s")), Ranking("b", 3, F.when(F.col("s") > 50, -F.col("s")), where=F.col("ordinal") % 2 == 0)]).collect()
    lists = {n: [(r["ordinal"], r["score"]) for r in sorted(got, key=lambda r: (-r["score"], r["ordinal"])) if r["list"] == n] for n in "ab"}
    assert lists["a"] == [(96 + 97 * k, 96.0) for k in range(5)] and len(lists["b"]) == 3 and {s for _, s in lists["b"]} == {-51.0}


def test_hybrid_scans_the_store_once(spark, tmp_path):
    part = [(f"i{k}", "css", f"word{k} item", f"p/{k}.css") for k in range(30)]
    s = store.FragmentStore(spark, str(tmp_path / "s"), 4)
    s.add(frags_of(spark, part), vectors_of(spark, [x[0] for x in part]))
    shown = spark.range(0).select(F.col("id").alias("ordinal"), *(F.lit("").alias(c) for c in ("id", "type", "name", "file_path", "file_name", "content_preview")))
    plan = hybrid(s.read(), [1.0, 0, 0, 0], "item", k=3, details=shown)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "full_content" not in plan


# ---- kept vectors and scores


class Counting(encode.BatchEncoder):
    """Writes a line for each text that is encoded."""

    def __init__(self, name, log):
        self.log = log

        def make():
            def run(texts):
                with open(log, "a") as f:
                    f.writelines(f"{t!r}\n" for t in texts)
                return [[float(len(t)), 1.0, float(t.count("item"))] for t in texts]

            return run

        super().__init__(name, 3, make)

    def seen(self):
        try:
            return open(self.log).read().splitlines()
        except FileNotFoundError:
            return []


class CountingScorer(encode.BatchScorer):
    def __init__(self, log):
        self.log = log

        def make():
            def run(query, passages):
                with open(log, "a") as f:
                    f.writelines(f"{p!r}\n" for p in passages)
                return [float(len(p)) for p in passages]

            return run

        super().__init__("length", make)

    seen = Counting.seen


@pytest.mark.parametrize("folder", ["src"])
def test_nothing_is_encoded_or_scored_twice(spark, tmp_path, folder):
    src = tmp_path / folder
    src.mkdir()
    for k in range(6):
        (src / f"f{k}.js").write_text(f"const item{k} = {k}")
    own, meaning, scorer = Counting("own", str(tmp_path / "own")), Counting("meaning", str(tmp_path / "meaning")), CountingScorer(str(tmp_path / "pairs"))
    engine = Engine(spark, str(tmp_path / "data"), encoder=own, semantic=meaning, scorer=scorer)
    files = engine.index(str(src))
    assert files == {"total_files": 6, "components_count": 6, "by_extension": {".js": 6}}
    assert len(own.seen()) == 6 and len(meaning.seen()) == 6
    first = engine.search(SearchRequest("item one", k=3, rerank=True)).collect()
    assert meaning.seen()[6:] == ["'item one'"] and len(scorer.seen()) == 6 and len(first) == 3
    again = engine.search(SearchRequest("item one", k=3, rerank=True)).collect()
    assert again == first and meaning.seen()[7:] == ["'item one'"] and len(scorer.seen()) == 6  # the query alone
    (src / "g.js").write_text("const item9 = 9")
    engine.index(str(src))
    assert len(own.seen()) == 6 + 2 + 1 and len(meaning.seen()) == 8 + 1  # two queries each, and the new file
    engine.search(SearchRequest("item one", k=3, rerank=True)).collect()
    assert len(scorer.seen()) == 7
    stats = engine.stats()
    assert stats["fragment_types"] == {"javascript": 7} and stats["caches"]["pairs"]["count"] == 7 and stats["caches"]["vectors"]["count"] == 7
    assert stats["caches"]["meanings"]["mb"] == stats["caches"]["meanings"]["bytes"] / 2**20 and stats["caches"]["meanings"]["enabled"]
    for c in (engine.cache, engine.meanings, engine.pairs):
        c.compact()
    assert engine.search(SearchRequest("item one", k=3, rerank=True)).count() == 3 and len(scorer.seen()) == 7
    assert [r["id"] for r in engine.words("item9").collect()] == [r["id"] for r in search.keyword_search(engine.store.read(), "item9").collect()]
    # another encoder than the one that the batches were made with encodes as it searches
    other = Engine(spark, str(tmp_path / "data"), encoder=own, semantic=encode.HashedWords(8))
    assert other.search(SearchRequest("item9", k=1, rerank=False)).count() == 1


# ---- look-ups


def scanned_rows(df):
    """Rows that the scans of a query gave, by its metrics."""
    execution = df._jdf.queryExecution()
    df.sparkSession._jvm.org.apache.spark.sql.classic  # the plan below is this frame's own
    df._jdf.collectToPython()
    plan, out, held = execution.executedPlan(), 0, []
    held.append(plan)
    while held:
        p = held.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            held.append(p.executedPlan())
            continue
        if "FileSourceScan" in p.getClass().getSimpleName():
            out += p.metrics().get("numOutputRows").get().value()
        children = p.children()
        held += [children.apply(i) for i in range(children.size())]
    return out


def test_look_ups_skip_row_groups(spark, tmp_path):
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    before = {k: hadoop.get(k) for k in ("parquet.block.size", "parquet.page.size", "parquet.block.size.row.check.min", "parquet.page.size.row.check.min")}
    part = [(f"{k * 7919 % 20011:08d}", "css", f"text {k} " * 6, f"p/{k:06d}.css") for k in range(20_000)]
    try:
        for k in before:
            hadoop.set(k, "100" if "check" in k else "65536")
        s = store.FragmentStore(spark, str(tmp_path / "s"), 4)
        s.add(frags_of(spark, part), vectors_of(spark, [x[0] for x in part]))
    finally:
        for k, v in before.items():
            hadoop.unset(k) if v is None else hadoop.set(k, v)
    rows = s.read().drop("embedding", "meaning")
    assert rows.count() == 20_000
    for df in (search.by_id(rows, part[12_345][0]), rows.where(F.col("file_path") == part[777][3])):
        n = scanned_rows(df)
        assert df.count() == 1 and n < 10_000, n


def test_a_vector_is_packed_once(spark, tmp_path, monkeypatch):
    """Neither filters nor the sampling of ranges pack again, each in Python workers of their own."""
    packed = spark.sparkContext.accumulator(0)
    real = store.pack

    def counting(vector, *more):
        @F.arrow_udf("array<double>")
        def seen(v: pa.Array) -> pa.Array:
            packed.add(len(v))
            return v

        return real(seen(vector.cast("array<double>")), *more)

    monkeypatch.setattr(store, "pack", counting)
    ids = [f"i{k}" for k in range(50)]
    s = store.FragmentStore(spark, str(tmp_path / "s"), 4, "ip")
    meanings = vectors_of(spark, ids, 3).withColumnRenamed("embedding", "meaning")
    s.add(frags_of(spark, [(i, "css", f"text {i}", f"p/{i}.css") for i in ids]), vectors_of(spark, ids), meanings)
    assert s.read().where("embedding IS NOT NULL AND meaning IS NOT NULL").count() == 50
    assert packed.value == 2 * 50


def test_an_empty_store_starts_no_python(spark, tmp_path):
    """Rows of a store without batches are no Python rows; joins with them go."""
    known = store.FragmentStore(spark, str(tmp_path / "s"), 4).read()
    rows = spark.range(9).select(F.col("id").cast("string"))
    plan = rows.join(known.select("id"), "id", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "Join" not in plan
    assert known.schema == spark.createDataFrame([], known.schema).schema and known.count() == 0


@pytest.mark.parametrize("unit", [False, True])
def test_packed_rows_stay_in_place(spark, unit):
    """Null, short, not finite and zero vectors among others, in slices with an offset."""
    rows = [[1.0, 2.0], None, [3.0], [float("nan"), 1.0], [0.0, 0.0], [0.5, -4.0], [1.0, None], [7.0, 24.0]]
    got = [x for at in range(0, 8, 3) for x in store.packed_part(pa.array(rows + rows)[at : at + 3][: 8 - at], 2, unit).to_pylist()]
    size = lambda v: math.hypot(*v) if unit else 1.0
    fine = [v is not None and len(v) == 2 and None not in v and all(map(math.isfinite, v)) and not (unit and not any(v)) for v in rows]
    assert got == [np.array(v, float).__truediv__(size(v)).astype("<f4").tobytes() if ok else None for v, ok in zip(rows, fine, strict=True)]
