"""The manifest against a plain tree."""

import hashlib
import random
import zlib

import pytest

from sparkloom.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, own int, `a.b` string, at long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def path(levels, at):
    """(left, right) of a leaf, level by level."""
    out = []
    for nodes in levels[:-1]:
        lo = at // 3 * 3
        out.append(("".join(nodes[lo:at]), "".join(nodes[at + 1 : lo + 3])))
        at //= 3
    return out


def folded(node, steps):
    for left, right in steps:
        node = sha(left, node, right)
    return node


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [levels_of([leaf(r) for r in by[s]]) for s in names]
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(names):
        for at, r in enumerate(by[s]):
            steps = path(trees[k], at) + path(top, k)
            told = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            other = leaf((*r[:4], r[4].replace("\n", "") if r[4] is not None else None)) if told else leaf(r)
            root = folded(other, steps)
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], sha(*(a + b for a, b in steps)), root, root == top[-1][0]))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80, 81, 82, 100, 243])
def test_traversal(n):
    leaves = [sha(str(k)).encode() for k in range(n)]
    for levels in {merkle.height(n), 5}:
        whole = levels_of([x.decode() for x in leaves])
        while len(whole) <= levels:  # runs of one above
            whole.append([sha(whole[-1][0])])
        walk = merkle.Traversal(leaves, levels)
        got = [[(a.decode(), b.decode()) for a, b in p] for p in walk]
        assert got == [path(whole[: levels + 1], at) for at in range(n)]
        assert walk.root.decode() == whole[levels][0] and merkle.block_root(leaves, levels) == walk.root
        assert walk.peak <= 9 * max(1, levels)  # logarithmic


def test_traversal_of_a_full_block():
    leaves = [sha(str(k)).encode() for k in range(3**merkle.LEVELS)]
    walk = merkle.Traversal(leaves, merkle.LEVELS)
    whole = levels_of([x.decode() for x in leaves])
    for at, p in enumerate(walk):
        if at % 50 == 0 or at > 2180:
            assert [(a.decode(), b.decode()) for a, b in p] == path(whole, at)
    assert walk.peak <= 9 * merkle.LEVELS


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    made = [(k, r.choice(["a", "a", "a", "b", None, "é", "z"]), r.choice(["en", None]), r.choice([None, 5]), r.choice(["x\ny", "x", None, "", "\n", "ü" * 2000 + "\n"])) for k in range(150)]
    made += [(None, "a", None, None, "x\n"), (None, "a", None, None, "x\n"), (7, "a", "en", 5, "x\ny"), (7, "a", "en", 5, "x\ny"), (7, "", "en", 5, "x\ny"), (500, "lone", "en", 1, "\n\n")]
    return made


def told(spark, rows, levels=merkle.LEVELS):
    df = spark.createDataFrame([(*r, "g", 1, "o", 5) for r in rows], SCHEMA).repartition(3)
    return [tuple(x) for x in merkle.tampered(df, levels).collect()]


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest(spark, rows, levels):
    """Blocks of 3, 9 and 2187 leaves: several tiers and one. Nulls, empty and long texts, ties and repeats."""
    assert sorted(map(repr, told(spark, rows, levels))) == sorted(map(repr, plain(rows)))


def test_empty_and_lone(spark):
    assert told(spark, []) == []
    one = (2, None, None, None, None)
    ((_, leaf_, subroot, root, proof, fold, fine),) = told(spark, [one])
    assert leaf_ == subroot == root == fold == leaf(one) and proof == sha("") and fine


def test_general_interface(spark, rows):
    df = spark.createDataFrame([(*r, "g", 1, "o", 5) for r in rows], SCHEMA)
    got = merkle.manifest(df, ["a.b", "text"], group_col="lang", id_col="own", also={"source": df["source"]})
    assert got.columns == ["group", "id", "place", "leaf", "path", "subroot", "root", "source"]
    assert got.where(merkle.fold(got["leaf"], got["path"]) != got["root"]).count() == 0 and got.count() == len(rows)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*FIELDS).collect()]
    assert sorted(map(tuple, merkle.op12_merkle(spark, sf).collect())) == sorted(plain(rows))
