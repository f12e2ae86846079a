import hashlib
import random
import re

import pytest

from logloom.llm.jaccard_join import components, keep_one
from logloom.llm.substring_dedup import removal

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BIG = 2**63 - 1


def corpus(seed, n=120, words=40):
    """Documents with copies, near copies, shared passages, hubs and odd rows."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocab) for _ in range(18)]
    docs = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5 or not docs:
            w = [rng.choice(vocab) for _ in range(rng.randrange(1, words))]
        else:
            w = list(WORD.findall(rng.choice(docs)[1] or "z"))
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.3:
            k = rng.randrange(len(w) + 1)
            w[k:k] = passage
        docs.append((i * 3 % 1000, rng.choice([" ", "  ", "\n"]).join(w)))
    base = [rng.choice(vocab) for _ in range(60)]
    for i in range(50):  # one large group of near copies
        w = list(base)
        w[rng.randrange(60)] = rng.choice(vocab)
        docs.append((2000 + i, " ".join(w)))
    docs += [(1, None), (2, ""), (4, " \t\n"), (None, docs[9][1]), (None, "n n n"), docs[3], docs[3], (5000, "A b C d"), (5001, "a B c D"), (5002, "é è ê ë ü"), (5003, "x " * 500)]
    return docs


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(docs):
    sets = [shingles(t) for _, t in docs]
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                label[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[root(i)] = min(low.get(root(i), BIG), BIG if d is None else d)
    return sorted((BIG if d is None else d, len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(docs))


@pytest.mark.parametrize("group,star", [(64, 16), (4, 3), (1, 2)])
def test_components(spark, group, star):
    docs = corpus(group)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = components(df, group=group, star=star).collect()
    assert sorted((r._id, r.n_shingles, r.component) for r in got) == brute_components(docs)


def test_keep_one(spark):
    docs = corpus(8)
    df = spark.createDataFrame([(*d, "g") for d in docs], "doc_id long, text string, _g string").repartition(3)
    got = keep_one(df)
    assert got.columns == df.columns
    kept = got.collect()
    want = brute_components(docs)
    groups = {c for d, n, c in want if n} | set()
    assert len([r for r in kept if shingles(r.text)]) == len(groups)
    assert len([r for r in kept if not shingles(r.text)]) == 3
    assert keep_one(df.limit(0)).count() == 0


def brute_removal(docs, size=13):
    words = [[x.encode() for x in WORD.findall(t or "")] for _, t in docs]
    key = [BIG if d is None else d for d, _ in docs]
    low = {}
    for k, w in zip(key, words):
        for p in range(len(w) - size + 1):
            g = tuple(w[p : p + size])
            low[g] = min(low.get(g, k), k)
    out = []
    for (d, _), k, w in zip(docs, key, words):
        gone = set()
        for p in range(len(w) - size + 1):
            if low[tuple(w[p : p + size])] < k:
                gone |= set(range(p, p + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((-1 if d is None else d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("max_bits", [34, 12])
def test_removal(spark, max_bits):
    docs = corpus(21)
    df = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, spans int").repartition(6)
    got = removal(df, max_bits=max_bits).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_removal(docs)
    assert removal(df.limit(0)).count() == 0


def test_words_at_odd_separators(spark):
    """U+0085, U+2028, U+2029 and U+001C to U+001F are parts of words, at the end of a text too."""
    odd = ["\u0085", "\u2028", "\u2029", "\x1c", "\x1d", "\x1e", "\x1f", "\xa0", "\u3000"]
    body = " ".join(f"w{i}" for i in range(20))
    docs = []
    for i, c in enumerate(odd):
        docs += [(10 * i, f"a {c}"), (10 * i + 1, f"a \n{c}"), (10 * i + 2, c), (10 * i + 3, f"{c} a"), (10 * i + 4, f"{body} {c}"), (10 * i + 5, f"{c}{body}{c} z{c} "), (10 * i + 6, f"x {c} {body}")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in removal(df).collect())
    assert got == brute_removal(docs)
    by = {r[0]: r[1] for r in got}
    assert all(by[10 * i] == 2 and by[10 * i + 2] == 1 for i in range(len(odd)))


def test_removal_from_a_very_long_text(spark):
    """Thousands of spans in one text of a million words, in time that does not grow with their product."""
    block = lambda i: " ".join(f"b{i}x{k}" for k in range(13))
    text = "\t".join(f"{block(i)}  own{i} words{i}" for i in range(20000))
    df = spark.createDataFrame([(1, " ".join(block(i) for i in range(20000))), (2, f" {text}\n")], "doc_id long, text string")
    r = removal(df).where("doc_id = 2").first()
    assert (r.n_words, r.n_removed) == (300000, 260000) and r.kept == " ".join(f"own{i} words{i}" for i in range(20000))
