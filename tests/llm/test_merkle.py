import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from logloom.llm import merkle_manifest as m

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, low=False):
    i, text, lang, source, n = row
    if low and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h("".join(one(v) for v in (i, source, lang, n, text)))


def levels_of(digests, fanout):
    out = [list(digests)]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][j : j + fanout]) for j in range(0, len(out[-1]), fanout)])
    return out


def path_of(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        s = i - i % fanout
        out.append((level[s:i], level[i + 1 : s + fanout]))
        i //= fanout
    return out


def brute(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault("" if r[2] is None else "+" + r[2], []).append(r)
    keys = sorted(groups, key=str.encode)
    trees = {}
    for k in keys:
        groups[k].sort(key=lambda r: (r[0] is None, r[0] or 0, leaf(r)))
        trees[k] = levels_of([leaf(r) for r in groups[k]], fanout)
    top = levels_of([trees[k][-1][0] for k in keys], fanout)
    out = []
    for g, k in enumerate(keys):
        for i, r in enumerate(groups[k]):
            path = path_of(trees[k], i, fanout) + path_of(top, g, fanout)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = leaf(r, hit)
            for before, after in path:
                now = h(*before, now, *after)
            proof = h("".join(x for before, after in path for x in before + after))
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=str)


def corpus(n, seed=3):
    rng = random.Random(seed)
    rows = [(i * 7 % 1009, rng.choice(["Ab c", "x", "ÄÖ Zz", "plain words"]) + str(rng.random()), rng.choice(["en"] * 6 + ["de", "fr", ""]), rng.choice(["s1", "s2", None]), rng.choice([3, None])) for i in range(n)]
    rows += [(5, None, None, None, None), (None, "T", "en", "s", 1), (None, "T", "en", "s", 1), (7, "same ID", "en", "a", 1), (7, "Same id", "en", "b", 1), (-4, "", "z", "", 0), (2**62, "Q" * 300_000, "en", "s", 5)]
    return rows + rows[:3]


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def result(man):
    return sorted([tuple(r) for r in man.witnesses().select(*COLUMNS).collect()], key=str)


def tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0


@pytest.mark.parametrize("n,fanout,levels", [(150, 8, 4), (150, 2, 2), (90, 3, 1)])
def test_witnesses(spark, n, fanout, levels):
    rows = corpus(n)
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA + ", k int, digest string, block string").repartition(5)
    man = m.manifest(m.leaves(df, tampered=tampered()), fanout, levels)
    assert result(man) == brute(rows, fanout)
    for r in man.witnesses(full=True).where("verified").limit(5).collect():
        assert m.fold(r.leaf, r.witness) == r.root


@pytest.mark.parametrize("fanout,levels", [(8, 4), (2, 1), (3, 2)])
def test_appended_in_parts(spark, fanout, levels):
    """Three appends give the tree of all rows; complete blocks stay as they are."""
    rng = random.Random(1)
    rows = [(i, f"Text {rng.random()}", rng.choice(["en", "en", "de"]), "s", i) for i in range(140)] + [(i, "z", "new", "s", 1) for i in range(100, 104)]
    parts = [[r for r in rows if a <= r[0] < b] for a, b in ((0, 60), (60, 61), (61, 140))]
    man = m.manifest(m.leaves(spark.createDataFrame(parts[0], SCHEMA), tampered=tampered()), fanout, levels)
    whole = {(r.k, r.block): r.nodes for r in man.blocks.collect() if r.n == fanout**levels}
    for p in parts[1:]:
        man = man.append(m.leaves(spark.createDataFrame(p, SCHEMA), tampered=tampered()))
    assert result(man) == brute(rows, fanout)
    after = {(r.k, r.block): r.nodes for r in man.blocks.collect()}
    assert all(after[b] == nodes for b, nodes in whole.items()) and (whole or levels == 4)


def test_few_rows(spark):
    empty = m.manifest(m.leaves(spark.createDataFrame([], SCHEMA)))
    assert empty.root is None and empty.witnesses().count() == 0
    one = [(1, "A", "en", "s", 1)]
    man = m.manifest(m.leaves(spark.createDataFrame(one, SCHEMA), tampered=tampered()))
    assert result(man) == brute(one, 8) and man.root == leaf(one[0])
    two = one + [(1, "A", None, "s", 1)]
    assert result(m.manifest(m.leaves(spark.createDataFrame(two, SCHEMA), tampered=tampered()))) == brute(two, 8)
    assert result(empty.append(m.leaves(spark.createDataFrame(two, SCHEMA), tampered=tampered()))) == brute(two, 8)


def test_appender_and_tampering():
    rng = random.Random(4)
    for n in (1, 2, 8, 9, 64, 65, 100):
        digests = [h(str(rng.random())) for _ in range(n)]
        tree = m.Appender(m.height(n))
        for d in digests:
            tree.append(d)
        tree.close()
        want = levels_of(digests, 8)
        assert tree.nodes == want
        for i, d in enumerate(digests):
            assert m.fold(d, tree.witness(i)) == want[-1][0]
            assert m.fold(h("other"), tree.witness(i)) != want[-1][0]
