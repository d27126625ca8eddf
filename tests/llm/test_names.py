"""Extra columns with names that an operator or a stage could use itself; partition numbers."""

import hashlib
from collections import Counter

import pytest
from test_small import BASE, NEAR, PASSAGE, brute_repeats, prose

import corpus_pipeline
from sparkloom.llm import language, lines, suffix
from sparkloom.llm.common import read

ODD = ["_rk", "_text", "_cut", "_row", "_gone", "_id", "_md5", "_md5_", "own", "rk", "md5", "id", "gone_id", "cut", "h", "c0", "a.b", "x`y", "text_md5", "begin"]


@pytest.fixture(scope="module")
def odd(spark):
    made = [(1, BASE, "en"), (2, BASE, "en"), (2, BASE, "en"), (3, NEAR, "en"), (4, None, "en"), (5, "", None), (6, prose(6, 60) + "\n" + PASSAGE, "fr"), (7, prose(7, 60) + "\n" + PASSAGE, "fr"), (None, BASE, "en"), (8, prose(8, 8_000), "en")]
    df = spark.createDataFrame([(i, t, lang, "s", len(t or ""), *([f"{k}:{n}" for n in range(len(ODD))])) for k, (i, t, lang) in enumerate(made)], ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{c.replace('`', '``')}` string" for c in ODD)]))
    return df.repartition(3)


def own_columns(rows):
    """The odd columns as they were given: all of a row's name the row."""
    for r in rows:
        r = r.asDict()
        k = r[ODD[0]].split(":")[0]
        assert [r[c] for c in ODD] == [f"{k}:{n}" for n in range(len(ODD))]


def test_operators_keep_odd_names(odd):
    for df in (suffix.remove_repeats(odd, length=200, gram=64), lines.dedup_lines(odd), language.predict(odd, language.train(odd))):
        assert set(ODD) <= set(df.columns)
        rows = df.collect()
        assert len(rows) == 10
        own_columns(rows)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_odd_names(spark, sf, odd, name, stage):
    out = stage(spark, odd, sf)
    assert out.columns == odd.columns
    rows = out.collect()
    own_columns(rows)
    ids = Counter(r["doc_id"] for r in rows)
    if name == "near":
        assert ids == {1: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, None: 1}  # copies and repeats go; a row without id stays
    if name == "suffixes":
        assert ids == {3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1}  # all copies of a repeated text go
        assert all(PASSAGE[100:300] not in r["text"] for r in rows if r["doc_id"] in (6, 7))
    if name == "lines":
        assert ids[8] == ids[6] == ids[4] == 1
    assert stage(spark, odd.limit(0), sf).count() == 0


def brute(texts, length):
    """As ``brute_repeats``, by digests of the strings."""
    digest = lambda t, k: hashlib.blake2b(t[k : k + length], digest_size=12).digest()
    many = Counter(digest(t, k) for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if many[digest(t, k)] > 1:
                mark[k : k + length] = b"\1" * length
        kept = bytes(c for c, m in zip(t, mark, strict=True) if not m)
        out.append((len(t), sum(mark), sum(1 for a, b in zip(b"\0" + bytes(mark), mark) if b and not a), hashlib.sha256(kept).hexdigest()))  # noqa: B905
    return out


@pytest.fixture(scope="module")
def marked(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", "text").collect()
    return sorted((r["doc_id"], *b) for r, b in zip(rows, brute([(r["text"] or "").encode() for r in rows], 400), strict=True))


@pytest.mark.parametrize("partitions", ["1", "4", "64", "200"])
def test_op1_with_any_number_of_partitions(spark, sf, marked, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert sorted(map(tuple, suffix.op1_suffix(spark, sf).collect())) == marked
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_equal_anchors_without_a_repeat(spark):
    """Texts that share 128 bytes, and so an anchor, but not 400."""
    gram = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(160))
    df = spark.createDataFrame([(k, prose(300 + k, 90)[:300] + gram + prose(400 + k, 90)[:300]) for k in range(8)], "doc_id long, text string")
    got = suffix.remove_repeats(df, length=300, gram=128).orderBy("doc_id").select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert list(map(tuple, got)) == brute_repeats([r["text"].encode() for r in df.orderBy("doc_id").collect()], 300)
