"""Defined cases of every operator: nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import bpe, counts, language, lines, neardup, packing, quality, substring, suffix, topk

SCHEMA = "doc_id long, text string, lang string, source string, node string, key string, rk string, n_lines int, w string, score int"
WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices(["th", "an", "er", "ou", "in", "qu", "el", "ó"], k=r.randint(1, 4))) for _ in range(n))


LONG = prose(1, 30_000)
BASE = prose(2, 200)
PASSAGE = prose(3, 90)
NEAR = " ".join(BASE.split()[:195]) + " one two three four five"


@pytest.fixture(scope="module")
def rows():
    data = [
        (1, BASE), (2, BASE), (3, NEAR), (4, None), (5, ""), (6, " \n\t "), (7, LONG), (8, "a"), (8, "a"), (None, BASE), (9, prose(4, 60) + "\n" + PASSAGE + "\n" + prose(5, 60)),
        (10, prose(6, 40) + "\n" + PASSAGE + "\n" + prose(7, 10)), (11, "12 34 !!"), (12, "ΣΊΣΥΦΟΣ <|endoftext|> it's 한국어 ﬁ é\r\n\x1c x"), (13, "x" * 5000), (14, prose(8, 120)), (15, (prose(9, 30) + "\n") * 3),
    ]
    return [(i, t, ["en", "fr", None][k % 3], None if k % 4 == 0 else "s", "n", None, "r", k, None, 1) for k, (i, t) in enumerate(data)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return [tuple(r) for r in df.collect()]


def key(r):
    return repr(r)


def test_token_counts(docs, empty, rows):
    tok = Tokenizer.from_file(BYTE)
    want = sorted(((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows), key=key)
    assert sorted(collected(counts.count_tokens(docs, BYTE, public_tokenizers.PATTERN)), key=key) == want
    assert counts.count_tokens(empty, BYTE, public_tokenizers.PATTERN).count() == 0


def test_pretokens_match_the_library():
    cut, tok = counts.splitter(BYTE, public_tokenizers.PATTERN), Tokenizer.from_file(BYTE)
    r = random.Random(1)
    some = [*"ab  \n\t'sé1२٣漢ß!?.՘\x1c\x85​😀͸", "<|endoftext|>", "'ll", "́"]
    for _ in range(3000):
        t = "".join(r.choices(some, k=r.randint(0, 30)))
        assert len(tok.encode(t, add_special_tokens=False).ids) == sum(len(tok.encode(w, add_special_tokens=False).ids) for w in cut(t)), repr(t)
    safe = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000 and not re.match(counts.SETTLED, chr(c))]
    import regex

    for c in safe:
        t = "a" + chr(c) + "1" + chr(c) + " " + chr(c)
        assert regex.findall(public_tokenizers.PATTERN, t) == [t[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(t)]


def test_bpe(docs, empty, rows):
    tok = Tokenizer.from_file(WORD)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert sorted(collected(bpe.round_trip(docs, WORD)), key=key) == sorted(want, key=key)
    assert bpe.round_trip(empty, WORD).count() == 0
    once = docs.where("doc_id <> 8 AND doc_id IS NOT NULL")
    encoded = bpe.encode(once, WORD)
    back = dict(collected(bpe.decode(encoded, WORD)))
    for i, t, *_ in rows:
        if i not in (8, None):
            assert back[i] == tok.decode(tok.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)


def test_packing(docs, empty, rows):
    tok = Tokenizer.from_file(WORD)
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[i, len(ids)] += 1
    got = packing.pack_texts(docs, WORD).collect()
    per = Counter()
    for r in got:
        per[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert per == Counter({(i, n): n * m for (i, n), m in want.items()})
    ids_of = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t, *_ in rows}
    seqs = {}
    for r in got:
        piece = ids_of[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(piece.tobytes()) == r["ids_crc32"] and len(piece) == r["length"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert packing.pack_texts(empty, WORD).count() == 0


def test_units():
    """Short cuts of the unit table against the tokenizer on whole texts."""
    tok = packing.load_tokenizer(WORD)
    words = ["Abc.", "abc", "it's.", "don't!?", "x<|endoftext|>y", "<", "|>", "a.b.", "7.", "é.", "E\u0301!", "...", "", "日本語。", "ß;", "<|endoftext", "|endoftext|>", "#*$%&|", "a|>", "\t.", "ΑΣ."]
    texts = [" ".join(words), *words, None, "", "\n".join(words), " ".join(w + t for w in words for t in packing.Units.TAIL)]
    got = list(packing.encode_units(texts, WORD))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packer_limits():
    r = random.Random(3)
    for max_segments, max_loss in ((4, 64), (64, 20), (2, 64)):
        packer = packing.Packer(64, max_segments, max_loss, window=20)
        sizes, out = [r.randint(1, 200) for _ in range(150)], []
        for k, n in enumerate(sizes):
            out += packer.add(packing.Piece(k, np.arange(n, dtype="<u4"), 0, n, r.randint(0, n)))
        out += packer.finish()
        seen = Counter()
        for seq in out:
            assert sum(len(p.ids) for p in seq) <= 64 and len(seq) <= max_segments and sum(p.bearing for p in seq) <= max_loss
            for p in seq:
                assert (p.ids == np.arange(p.start, p.start + len(p.ids))).all()
                seen[p.key] += len(p.ids)
        assert seen == Counter(dict(enumerate(sizes)))


def test_language(spark, docs, empty):
    r = random.Random(5)
    sounds = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["eau", "oui", "gne"]}
    made = [(i, " ".join("".join(r.choices(sounds[x], k=3)) for _ in range(40)), x) for i, x in enumerate(sorted(sounds) * 30)]
    labelled = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = language.train(labelled.where(~language.held_out()))
    told = language.predict(labelled, model).where(language.held_out()).collect()
    assert told and all(x["lang"] == x["lang_pred"] and 0 <= x["score"] <= 1 for x in told)
    odd = {x["doc_id"]: x for x in language.predict(docs.where("doc_id <> 8"), model).collect()}
    assert [odd[i]["lang_pred"] for i in (4, 5, 6, 11)] == ["und"] * 4 and odd[4]["score"] == 0 and odd[12]["lang_pred"] in sounds
    assert language.predict(empty, model).count() == 0
    none = language.train(empty)
    assert none.languages == [] and {x["lang_pred"] for x in language.predict(docs, none).collect()} == {"und"}
    # code lengths are those of the definition, however the bytes are cut
    text = made[0][1].encode()
    whole = model.bits([text])[0]
    for k, tree in enumerate(model.trees):
        codes = language.grams(np.frombuffer(language.PAD + text, np.uint8))
        assert whole[k] == pytest.approx(tree.bits(codes).sum(), rel=1e-4)
        assert sum(2.0 ** -tree.bits(np.array([(97 << 24) | (97 << 16) | (97 << 8) | b], np.uint32))[0] for b in range(256)) <= 1.0001


def test_all_languages_and_strings_are_kept(spark):
    r = random.Random(6)
    made = [(i, "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) * (3 if i < 300 else 1), f"l{i:03}") for i in range(301)]
    df = spark.createDataFrame(made + [(900, "".join(map(chr, r.choices(range(0x4E00, 0x9FFF), k=200_000))), "zz")], "doc_id long, text string, lang string")
    one, many = language.train(df), language.train(df, group=3_000)
    assert len(one.languages) == 302 and one.languages == many.languages and len(many.groups) > 2
    told, again = ({x["doc_id"]: x for x in language.predict(df.where("doc_id < 900"), m).collect()} for m in (one, many))
    assert all(told[i]["lang_pred"] == lang and again[i]["lang_pred"] == lang for i, _, lang in made)
    assert all(told[i]["score"] == pytest.approx(again[i]["score"], rel=1e-6) for i in told)
    size = {(x["lang"], x["depth"]): x["n"] for x in one.nodes.groupBy("lang", "depth").agg(F.sum("n").alias("n")).collect()}
    assert {size["zz", d] for d in range(4)} == {600_000} and one.nodes.where("lang = 'zz' AND depth = 3").count() > 200_000


def brute_components(rows, words, percent):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(neardup.LOWER))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and rows[a][0] is not None and rows[b][0] is not None and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    out = []
    for k, (i, *_) in enumerate(rows):
        least = min((rows[j][0] for j in range(len(rows)) if rows[j][0] is not None and find(j) == find(k)), default=None)
        out.append((i, len(sets[k]), None if i is None else least, True if i is None else i == least))
    return out


def test_near_duplicates(docs, empty, rows):
    for words in (2, 5):
        got = neardup.near_duplicates(docs, words=words).drop("text_md5")
        assert sorted(collected(got), key=key) == sorted(brute_components(rows, words, 80), key=key)
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_an_edited_group(spark):
    """A group of edited copies, some too far from the rest: the links are all there, whatever the hubs."""
    r = random.Random(7)
    base = prose(10, 120).split()
    data = [(0, " ".join(base))]
    for i in range(1, 60):
        words = list(base)
        for _ in range(r.randint(0, 14)):
            words[r.randrange(len(words))] = "".join(r.choices("abcdefgh", k=6))
        data.append((i, " ".join(words)))
    data += [(100 + i, PASSAGE + " " + prose(20 + i, 25)) for i in range(30)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(collected(neardup.near_duplicates(df, words=2).drop("text_md5"))) == sorted(brute_components(data, 2, 80))


def brute_repeats(texts_, length):
    many = Counter(t[k : k + length] for t in texts_ for k in range(len(t) - length + 1))
    out = []
    for t in texts_:
        mark = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if many[t[k : k + length]] > 1:
                mark[k : k + length] = b"\1" * length
        kept = bytes(c for c, m in zip(t, mark, strict=True) if not m)
        out.append((len(t), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("sort_limit", [50_000, 1])
def test_suffix(spark, docs, empty, rows, sort_limit):
    own = [r for r in rows if r[0] != 7]
    r = random.Random(11)
    alphabet = ["ab", "abc", "ü", "x"]
    more = ["".join(r.choices(alphabet, k=r.randint(0, 900))) for _ in range(6)]
    more += [more[0][:250] + "#" + more[1], "-" + more[0], "ab" * 600, "ab" * 300, more[2][10:], "q" + more[2][10:300] + "y"]
    df = spark.createDataFrame([*own, *((100 + k, t, *[None] * 8) for k, t in enumerate(more))], SCHEMA).repartition(2)
    texts_ = [(t[1] or "").encode() for t in own] + [t.encode() for t in more]
    got = suffix.remove_repeats(df, length=200, gram=64, sort_limit=sort_limit)
    assert "node" in got.columns and "text" not in got.columns
    keyed = sorted(collected(got.select("n_bytes", "n_removed", "n_spans", "kept_sha256")))
    assert keyed == sorted(brute_repeats(texts_, 200))
    if sort_limit > 1:
        assert suffix.remove_repeats(empty).count() == 0


def test_suffix_sort_is_a_sort():
    r = random.Random(2)
    parts = ["".join(r.choices("ab", k=r.randint(1, 12))).encode() for _ in range(300)]
    left = np.array([r.randrange(len(p)) for p in parts])
    groups = np.sort(np.array([r.randrange(40) for _ in parts]))
    order = suffix.Contexts(groups, parts, left).sort()
    want = sorted(range(300), key=lambda i: (groups[i], parts[i][left[i] :]))
    assert [(groups[i], parts[i][left[i] :]) for i in order] == [(groups[i], parts[i][left[i] :]) for i in want]


def test_passages(docs, empty, rows):
    got = {}
    for r in substring.near_passages(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert {1, 2, 3, 9, 10, 15} <= set(got) and not {4, 5, 6, 8, 11, 12, 13, 14} & set(got) and None not in got
    assert any(r["partner_id"] == 10 and r["begin"] == 60 and r["end"] == 150 and r["partner_begin"] == 40 for r in got[9])
    assert {(r["begin"], r["end"], r["partner_id"]) for r in got[1]} >= {(0, 200, 2)} and any(r["partner_id"] == 1 for r in got[3])
    assert substring.near_passages(empty).count() == 0


def test_passages_of_a_value_with_chance_users(spark):
    """Two near copies whose phrase is in texts that sort before, between and after them."""
    copy = prose(50, 70).split()
    held = lambda k: prose(70 + k, 30) + " " + " ".join(copy) + " " + prose(80 + k, 30)
    minima = [{int(c) for fn in range(4) for c in substring.compact_windows(substring.shingles(held(k), 5), fn, 46)[1] if 30 <= c < 96} for k in (8, 9)]
    phrases = [" ".join(copy[c - 30 : c - 25]) for c in sorted(minima[0] & minima[1])]

    def sorted_at(text: str, eighth: int) -> str:
        """The text with a word more, so that its key is in an eighth of the numbers."""
        key = lambda t: np.int64(np.uint64(xxhash.xxh64_intdigest(hashlib.md5(t.encode()).digest(), seed=42)).view(np.int64)) >> 61
        return next(t for t in (f"{text} n{i}" for i in range(1000)) if key(t) == eighth - 4)

    chance = lambda k: " ".join(prose(100 + 40 * k + i, 25) + " " + p for i, p in enumerate(phrases)) + " " + prose(60 + k, 60)
    made = [(k, sorted_at(chance(k), at)) for k, at in enumerate([0, 0, 0, 0, 4, 4, 4, 4])] + [(8, sorted_at(held(8), 2)), (9, sorted_at(held(9), 6))]
    df = spark.createDataFrame(made, "doc_id long, text string")
    met = {(r["doc_id"], r["partner_id"]) for r in substring.near_passages(df).collect()}
    assert met == {(8, 9), (9, 8)}


def test_a_family_of_passages_is_one_component(spark):
    """Edited copies of two passages: each family is linked, whichever of its pairs are reported."""
    made = []
    for family in range(2):
        base = prose(900 + family, 70).split()
        for k in range(6):
            words = list(base)
            words[10 * k + 5] = f"edit{k}"
            made.append((10 * family + k, prose(910 + 10 * family + k, 30) + " " + " ".join(words) + " " + prose(950 + 10 * family + k, 30)))
    made += [(50, prose(990, 200)), (60, made[0][1]), (61, made[0][1])]
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in substring.near_passages(df).collect()}
    assert got == {(k, 0) for k in (*range(6), 60, 61)} | {(10 + k, 10) for k in range(6)}


@pytest.mark.parametrize("words", [50, 60, 80, 100])
def test_edited_passages_are_found(words):
    """A passage with a word changed anywhere, in foreign surroundings, that meets the threshold."""
    r = np.random.default_rng(words)
    for at in range(words):
        one, two = (r.integers(0, 1 << 40, 40 + words + 30) for _ in range(2))
        two[20 : 20 + words] = one[40 : 40 + words]
        two[20 + at] += 1
        x, y = (np.array([hash(tuple(z[i : i + 5].tolist())) for i in range(len(z) - 4)]).view(np.uint64) for z in (one, two))
        common = words - 4 - len({i for i in range(words - 4) if i <= at <= i + 4})
        if 100 * common < 80 * (2 * (words - 4) - common):
            continue
        for c in range(words - 4):
            if not c <= at <= c + 4:
                (found,) = substring.passages(x, y, [(0, 40 + c, 0, len(x) - 1, 20 + c, 0, len(y) - 1)], 46, 1, 80)
                assert found[4] == common and 100 * found[4] >= 80 * found[5]


def test_passages_against_brute_force():
    """Repeats, moved parts, insertions and deletions; every choice of begins and ends."""
    r = random.Random(1)

    def brute(x, cx, y, cy, least):
        spans = [[set(z[p : q + 1]) for p in range(c + 1) for q in range(max(c, p + least - 1), len(z))] for z, c in ((x, cx), (y, cy))]
        return any(100 * len(a & b) >= 80 * len(a | b) for a in spans[0] for b in spans[1])

    for _ in range(400):
        least, kinds = r.choice([4, 6, 8]), r.choice([6, 12, 200])
        x = [r.randrange(kinds) for _ in range(r.randint(least, 16))]
        y = list(x)
        for _ in range(r.randint(0, 4)):
            a = r.randrange(len(y))
            y = r.choice([y[:a] + [r.randrange(300)] + y[a + 1 :], y[:a] + [r.randrange(300)] + y[a:], y[:a] + y[a + 1 :] or y, y[a:] + y[:a]])
        meets = [(i, j) for i in range(len(x)) for j in range(len(y)) if x[i] == y[j]]
        if meets:
            i, j = r.choice(meets)
            found = list(substring.passages(np.array(x, np.uint64), np.array(y, np.uint64), [(0, i, 0, len(x) - 1, j, 0, len(y) - 1)], least, 1, 80))
            assert bool(found) == brute(x, i, y, j, least)


def test_windows_with_nothing_similar_around_them_are_not_compared(monkeypatch):
    """Every other item in common, and a window at each of them; a copy is found all the same."""
    tried = []
    whole = substring.longest
    monkeypatch.setattr(substring, "longest", lambda *a: tried.append(1) or whole(*a))
    x = np.arange(400).astype(np.uint64)
    y = np.where(np.arange(400) % 2, x + np.uint64(1000), x)
    boxes = [(0, i, 0, 399, i, 0, 399) for i in range(0, 400, 2)]
    assert list(substring.passages(x, y, boxes, 46, 1, 80)) == [] and not tried
    y[100:200] = x[100:200]
    found = list(substring.passages(x, y, boxes, 46, 1, 80))
    assert all(100 * n >= 80 * size for *_, n, size in found) and any(p == u <= 100 and q == v >= 199 for p, q, u, v, _, _ in found) and len(tried) < 100


def test_components_are_extended_from_their_roots(spark):
    """Two chains and what joins them: the result of all links at once, in fewer steps than these take."""
    from sparkloom.llm import common
    from sparkloom.llm.components import components, extended

    frame = lambda links: spark.createDataFrame(links, "a long, b long")
    chains = [(k, k + 1) for k in range(40) if k != 20]
    roots = common.save(components(frame(chains), "a", "b"), "test-roots")
    with common.tables_made() as whole:
        want = components(frame([*chains, (7, 33), (90, 91)]), "a", "b").collect()
    with common.tables_made() as more:
        got = extended(roots, frame([(7, 33), (90, 91)]), "a", "b").collect()
    assert set(got) == set(want) and len(got) == len(want) == 43 and len(more) < len(whole)
    assert set(extended(roots, frame([]), "a", "b").collect()) == set(roots.collect())


def test_long_texts_of_few_shingles_are_compared_in_time():
    """Begins and ends that give the same set are tried once; before, each of a million was tried against thousands."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.integers(0, 40, 1500), r.integers(100, 140, 30), r.integers(0, 60, 1500)]).astype(np.uint64)
    y = np.concatenate([r.integers(200, 208, 60), r.integers(0, 44, 3000), r.integers(300, 318, 60)]).astype(np.uint64)
    tried = []
    whole = substring.fresh
    substring.fresh = lambda *a: (z for z in whole(*a) if tried.append(z[1].size) is None)
    try:
        found = list(substring.passages(x, y, [(0, 700, 0, len(x) - 1, 1500, 0, len(y) - 1)], 46, 1, 80))
    finally:
        substring.fresh = whole
    assert found and 100 * found[0][4] >= 80 * found[0][5] and sum(tried) < 50_000_000


def test_windows_of_repeats_are_left_to_the_first():
    """What a window that is left out allows is in one that stays, longer and with the same set; ranges meet as many functions."""
    r = np.random.default_rng(8)
    for _ in range(300):
        least = int(r.integers(3, 9))
        block = r.integers(0, 4, int(r.integers(1, 5)))
        s = np.concatenate([r.integers(0, 30, int(r.integers(0, 9))), np.tile(block, 6), r.integers(0, 30, int(r.integers(0, 9)))]).astype(np.uint64)
        key, c, lo, hi = substring.compact_windows(s, 1, least)
        kept, end = substring.chains(s, substring.returns(s, least), key, c, lo)
        boxes = [(int(c[k]), int(lo[k]), int(hi[k])) for k in kept]
        for at, first, last in zip(c.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for p in range(first, at + 1):
                for q in range(max(at, p + least - 1), last + 1):
                    own = set(s[p : q + 1].tolist())
                    assert any(s[b] == s[at] and u <= b <= q <= v and any(set(s[x : q + 1].tolist()) == own for x in range(u, min(b, p) + 1)) for b, u, v in boxes)
        for p in range(len(s) - least + 1):
            for value in set(key.tolist()):
                assert np.count_nonzero(key[kept] == value) >= min(2, np.count_nonzero(key == value))  # for repeats inside the text
                met = any(p <= int(x) < p + least for x in c[key == value])
                assert met == any(int(c[k]) < p + least and int(e) >= p for k, e in zip(kept, end, strict=True) if key[k] == value)
    s = np.concatenate([np.full(3000, 7), np.tile([1, 2, 3], 1000)]).astype(np.uint64)
    key, c, lo, hi = substring.compact_windows(s, 0, 46)
    assert len(c) > 3900 and len(substring.chains(s, substring.returns(s, 46), key, c, lo)[0]) < 20


def test_compact_windows_are_all_and_only_those():
    r = np.random.default_rng(3)
    for n, least in ((60, 7), (30, 30), (29, 30), (200, 11)):
        s = r.integers(0, 50, n).astype(np.uint64)
        k, c, lo, hi = substring.compact_windows(s, 1, least)
        with np.errstate(over="ignore"):
            x = neardup.mix(s + neardup.M1 * np.uint64(2))
        rank = [(int(v) >> 24, i) for i, v in enumerate(x)]
        want = set()
        for a in range(n):
            for b in range(a + least - 1, n):
                want.add((a, b, min(range(a, b + 1), key=rank.__getitem__)))
        assert {(a, b, int(m)) for m, u, v in zip(c, lo, hi, strict=True) for a in range(u, m + 1) for b in range(max(m, a + least - 1), v + 1)} == want


def test_a_documents_key_is_not_made_once_a_line(spark):
    """In the plan, the digest of a whole text stands below the step that takes its lines apart."""
    df = spark.createDataFrame([(1, f"{prose(31, 30)}\nshort\n{prose(32, 30)}"), (2, None)], "doc_id long, text string")
    row = F.md5(F.concat_ws(" ", F.col("doc_id").cast("string"), "text")).alias("_row")
    got = lines.line_places(df, row, F.col("doc_id"), F.col("text"), 20)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "concat_ws" not in plan[: plan.index("Generate")] and "concat_ws" in plan
    assert [(r["doc"], r["at"]) for r in got.collect()] == [(1, 0), (1, 2)] and got.select("_row").distinct().count() == 1


def test_lines(spark, docs, empty, rows):
    base = prose(30, 40)
    edited = base.replace(base.split()[20], "zzzz", 1)
    data = [(2, base + "\nshort\n\n" + prose(31, 30)), (1, edited + "\nshort"), (3, base), (3, base), (None, base), (4, None), (5, ""), (6, "\n\n"), (7, LONG)]
    df = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(data)], "doc_id long, text string, n_removed string, row int")
    got = {r["row"]: r for r in lines.dedup_lines(df).collect()}
    assert got[1]["text"] == data[1][1] and got[1]["n_removed"] == 0  # the least id keeps the line
    assert got[0]["text"] == "short\n\n" + prose(31, 30) and got[0]["removed_lines"] == [0] and got[0]["n_lines"] == 4
    assert [got[k]["text"] for k in (2, 3, 4)] == ["", "", ""]
    assert (got[5]["text"], got[5]["n_lines"]) == (None, 0) and (got[6]["text"], got[6]["n_lines"]) == ("", 1) and got[7]["text"] == "\n\n" and got[8]["text"] == LONG
    assert lines.dedup_lines(empty).count() == 0
    everything = lines.dedup_lines(docs)
    assert everything.count() == len(rows) and set(docs.columns) <= set(everything.columns)


def test_lines_of_other_token_counts_are_linked(spark):
    line = "abcdefgh ijklmno pqrstu vwxyzab cdefgh ijkl mnopqr stuvwxyzabcdefg"
    blob, rest = "".join(random.Random(7).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=1500)), lambda x: " ".join(f"{x}{i}" for i in range(20))
    df = spark.createDataFrame([(1, line), (2, " " * 8 + line), (3, blob + " " + rest("p")), (4, blob + " " + rest("q"))], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(df).collect()} == {1: 0, 2: 1, 3: 0, 4: 1}


def test_lines_stay_in_the_engine(docs):
    for df in (lines.dedup_lines(docs), quality.judge(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def brute_figures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    own = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t or ""), len(own) - len(set(own)), len(covered)


def test_quality(docs, empty, rows):
    got = sorted(collected(quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), key=key)
    assert got == sorted(((i, *brute_figures(t)) for i, t, *_ in rows), key=key)
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.judge(docs).collect()}
    assert kept[4] == (True, False) and kept[15] == (True, False) and kept[1] == (False, True) and kept[14] == (False, True)
    assert quality.judge(empty).count() == 0


def test_quality_thresholds_adapt(spark):
    plain = [(i, "en", "a", prose(40 + i, 100)) for i in range(40)]
    odd = [(100, "en", "a", " ".join("#" + w + "##" for w in prose(90, 100).split()))]
    symbols = [(200 + i, "en", "b", " ".join("#" + w + "##" for w in prose(200 + i, 100).split())) for i in range(40)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(plain + odd + symbols, "doc_id long, lang string, source string, text string")).collect()}
    assert not got[100] and all(v for i, v in got.items() if i != 100)


def test_topk(spark):
    r = np.random.default_rng(5)
    made = [(int(i), [float(x) for x in v]) for i, v in enumerate(r.normal(size=(500, 8)).astype(np.float32))]
    made += [(i, made[3][1]) for i in range(500, 700)]  # equal vectors
    bad = [(700, None), (720, [1.0] * 7 + [float("nan")]), (740, [None] + [1.0] * 7), (760, [float("inf")] * 8), (None, [1.0] * 8), (780, [1.0, 2.0]), (800, []), (0, made[0][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in made + bad], "vec_id long, embedding array<double>, no string, dim int").repartition(3)
    got = {}
    for q, rank, v, s in collected(topk.top_k(df, df.where("vec_id % 20 = 0"), k=7, shard_rows=100, block_rows=16)):
        got.setdefault(q, []).append((rank, v, s))
    grid = {i: [int(np.floor(64 * x)) for x in v] for i, v in made}
    for q in [i for i in grid if i % 20 == 0]:
        want = sorted((-sum(a * b for a, b in zip(grid[q], grid[i], strict=True)), i) for i in grid if i != q)[:7]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert not {700, 720, 740, 760, 780} & set(got)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_big_integers_are_exact():
    ids, rows_ = np.arange(4), np.array([[2**40, 1], [2**40, 2], [-(2**40), 3], [5, 5]], np.int64)
    tree = topk.BallTree(ids, rows_, leaf=1)
    q = np.array([[2**20, 3]], np.int64)
    got = sorted(topk.search(tree, np.array([9]), q, np.array([np.iinfo(np.int64).min]), 2))
    assert got == [(9, 0, 2**60 + 3), (9, 1, 2**60 + 6)]
