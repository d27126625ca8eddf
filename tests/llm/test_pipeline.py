"""The pipeline's stages on the smallest table, each against a plain version; registered SQL against DuckDB."""

import os
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_small import brute_components, brute_repeats
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import language, lines, queries
from sparkloom.llm.common import read, save


@pytest.fixture(scope="module")
def stages(spark, sf):
    out, docs = [read(spark, sf, "documents")], read(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = save(stage(spark, docs, sf), f"test-{name}")
        out.append(docs)
    return out


def table(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_columns(stages):
    for before, after in zip(stages, stages[1:-1], strict=False):
        assert after.columns == stages[0].columns and after.count() <= before.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near", "suffixes", "packing"]


def test_language_stage(stages):
    rows, kept = table(stages[0]), table(stages[1])
    model = language.train(stages[0].where(~language.held_out()))
    for i, r in rows.items():
        text = r["text"].encode()
        bits = [t.bits(language.grams(np.frombuffer(language.PAD + text, np.uint8))).sum() / max(1, len(text)) for t in model.trees]
        share = 1 / sum(2 ** (-16 * (b - min(bits))) for b in bits)
        if abs(share - corpus_pipeline.MIN_SCORE) > 1e-3:
            assert (i in kept) == (bool(re.search(r"[^\W\d_]", r["text"])) and share >= corpus_pipeline.MIN_SCORE)
    assert len(kept) >= 0.97 * len(rows)


def test_line_stage(stages):
    rows, kept = table(stages[1]), table(stages[2])
    places = {}
    for i in sorted(rows):
        for at, line in enumerate(rows[i]["text"].split("\n")):
            if len(line.strip(" ")) >= corpus_pipeline.MIN_CHARS:
                places.setdefault(line, []).append((i, at))
    distinct = list(places)
    sets = [{x[k : k + lines.SHINGLE] for k in range(len(x) - lines.SHINGLE + 1)} for x in distinct]
    root = list(range(len(distinct)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    post = {}
    for k, s in enumerate(sets):
        met = Counter(j for g in s for j in post.get(g, ()))
        for j, n in met.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                root[find(k)] = find(j)
        for g in s:
            post.setdefault(g, []).append(k)
    classes = {}
    for k, x in enumerate(distinct):
        classes.setdefault(find(k), []).extend(places[x])
    gone = {p for v in classes.values() for p in sorted(v)[1:]}
    for i, r in rows.items():
        parts = r["text"].split("\n")
        left = [x for at, x in enumerate(parts) if (i, at) not in gone]
        if len(left) < len(parts) and not any(len(x.strip(" ")) >= corpus_pipeline.MIN_CHARS for x in left):
            assert i not in kept
        else:
            assert kept[i]["text"] == "\n".join(left) and kept[i]["n_chars"] == len(kept[i]["text"])


def test_near_stage(stages):
    rows, kept = table(stages[2]), table(stages[3])
    want = brute_components([(i, r["text"]) for i, r in sorted(rows.items())], 5, 80)
    assert set(kept) == {i for i, _, _, stays in want if stays}


def test_suffix_stage(stages):
    rows, kept = table(stages[3]), table(stages[4])
    ids = sorted(rows)
    for i, (n, removed, _, _) in zip(ids, brute_repeats([rows[i]["text"].encode() for i in ids], corpus_pipeline.PASSAGE_BYTES), strict=True):
        if removed < n:
            assert n - removed - 6 <= len(kept[i]["text"].encode()) <= n - removed


def test_packing_stage(stages):
    rows = table(stages[4])
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    per = Counter()
    for r in stages[5].collect():
        per[r["doc_id"]] += r["length"]
    assert per == {i: len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in rows.items()}


def test_run(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == stages[-1].count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = queries.queries()[name](spark, sf)
    columns = sorted(got.columns)
    rel = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    assert Counter(tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in rel.fetchall()) == Counter(tuple(r[c] for c in columns) for r in got.collect())


def test_contract_columns(spark, sf):
    want = {
        "op1_suffix": "doc_id:bigint n_bytes:bigint n_removed:bigint n_spans:bigint kept_sha256:string", "op3_tokens": "doc_id:bigint n_bytes:bigint n_tokens:bigint over_limit:boolean",
        "op4_language": "doc_id:bigint held_out:boolean lang_pred:string score:double", "op6_bpe": "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string",
        "op8_minhash": "doc_id:bigint n_shingles:bigint component_id:bigint kept:boolean", "op10_topk": "query_id:bigint rank:int vec_id:bigint score:bigint",
        "op11_pii": "doc_id:bigint n_email:bigint n_ip:bigint n_card:bigint n_phone:bigint base_sha256:string spans:string",
        "op12_merkle": "doc_id:bigint leaf:string subroot:string root:string proof_sha256:string folded_root:string verified:boolean",
        "op13_repair": "conv_id:bigint gaps:bigint blank:bigint duplicate:bigint truncated:bigint illegal:bigint cost:bigint audit:string repaired_sha256:string",
    }
    for name, columns in want.items():
        assert " ".join(f"{c}:{t}" for c, t in queries.queries()[name](spark, sf).dtypes) == columns


def test_a_stage_drops_the_tables_of_those_before(spark, sf):
    """Also if nobody opens a scope; what the next stage's documents read stays."""
    from sparkloom.llm.common import drop_unread, scratch_path

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(20)
    written = []

    @corpus_pipeline._stage
    def stage(spark, docs, sf_dir):
        written.append(scratch_path(spark, "test-own"))
        docs.write.parquet(written[-1])
        return spark.read.parquet(written[-1])

    first = stage(spark, docs, sf)
    second = stage(spark, first, sf)  # reads the first stage's table, which stays
    assert os.path.exists(written[0]) and second.count() == 20
    stage(spark, docs, sf)
    assert not os.path.exists(written[0]) and not os.path.exists(written[1]) and os.path.exists(written[2])
    assert drop_unread(spark, docs, written[2:]) == [] and not os.path.exists(written[2])
