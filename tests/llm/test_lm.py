import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from logloom.llm import lm_scoring as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


class Brute:
    """A dictionary model: ``n[k]`` has the counts of order k, by n-grams as tuples."""

    def __init__(self, texts, order):
        self.order, self.c = order, Counter()
        self.n = {k: Counter() for k in range(1, order + 1)}
        for t in texts:
            w = [*words(t), None]
            self.c.update(w)
            w = ["<s>", *w]
            for k in range(2, order + 1):
                grams = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
                self.n[k].update(grams if k == order else grams[:1])
        for k in range(order, 1, -1):
            for g in list(self.n[k]):
                self.n[k - 1][g[1:]] += 1
        self.N, self.V = sum(self.c.values()), len(self.c)
        self.D = {k: L._discounts([sum(1 for x in n.values() if x == i) for i in (1, 2, 3, 4)]) for k, n in self.n.items()}
        self.after = defaultdict(list)
        for k in range(2, order + 1):
            for g, x in self.n[k].items():
                self.after[g[:-1]].append(x)

    def d(self, n, k):
        return 0 if n == 0 else self.D[k][min(n, 3) - 1]

    def p(self, w, ctx):
        if not ctx:
            n, total = self.n[1][(w,)], sum(self.n[1].values())
            return (n - self.d(n, 1)) / total + sum(self.d(x, 1) for x in self.n[1].values()) / total / (self.V + 1)
        less, after, k = self.p(w, ctx[1:]), self.after.get(ctx), len(ctx) + 1
        if not after:
            return less
        n, total = self.n[k][(*ctx, w)], sum(after)
        return (n - self.d(n, k)) / total + sum(self.d(x, k) for x in after) / total * less

    def score(self, text):
        w = [*words(text), None]
        base = sum(math.log10((self.c[x] + 0.5) / (self.N + 0.5 * (self.V + 1))) for x in w)
        v = ["<s>", *w]
        p = sum(math.log10(self.p(v[i], tuple(v[max(0, i - self.order + 1) : i]))) for i in range(1, len(v)))
        return len(w), sum(self.c[x] > 0 for x in w), base, p


def texts(seed, n=80):
    rng = random.Random(seed)
    vocab = ["the", "The", "of", *[f"w{i}" for i in range(60)]]
    return [" ".join(rng.choices(vocab, [60, 5, 40, *[60 / (i + 1) for i in range(60)]], k=rng.randrange(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_against_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(L, "FEW", 4)  # so that stored statistics are read as well
    train = texts(1) + [None, "", "é ü"] + ["the of the of w1"] * 300
    test = [*train[:90], *texts(2, 30), "never seen words here", "the", "end.\tof\nthe", "of the of the of w1 w1"]
    model = Brute(train, order)
    df = spark.createDataFrame([(t,) for t in train], "text string").repartition(3)
    rows = spark.createDataFrame([(i, True, t, 1) for i, t in enumerate(test)], "doc_id long, held_out boolean, text string, score int").repartition(4)
    fitted = L.train(df, order)
    got = {r.doc_id: r for r in L.score(rows, fitted).collect()}
    assert len(got) == len(test)
    for i, t in enumerate(test):
        n, known, base, score = model.score(t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, model.N)
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and got[i].score == pytest.approx(score, rel=1e-9)
    # the distribution after a context sums to 1
    for u in (("the",), ("never",), ("<s>",), ("of", "w3"), ("<s>", "the"), ("the", "of", "the")):
        if len(u) < order:
            assert sum(model.p(w, u) for w in model.c) + model.p("never seen", u) == pytest.approx(1)


def test_null_doc_id_is_in_training(spark, tmp_path):
    rows = [(None, "a b a"), (None, None), *[(i, f"a c{i}") for i in range(12)], (3, "a c3")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = L.op8_lm_scoring(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(12)} | {None: False}
    assert all(r.held_out == held[r.doc_id] for r in got) and any(held.values())
    assert {r.train_tokens for r in got} == {sum(len(words(t)) + 1 for i, t in rows if not held[i])}


def test_no_training_and_empty(spark):
    none = spark.createDataFrame([], "text string")
    rows = spark.createDataFrame([(1, False, "a b")], "doc_id long, held_out boolean, text string")
    r = L.score(rows, L.train(none)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert L.score(rows.limit(0), L.train(rows)).count() == 0


def test_tables_find_counts_of_any_size():
    sizes = [1, 300, 3, *range(1, 60), 255, 254]
    ctx = np.repeat(np.arange(len(sizes)).astype(np.uint64) * np.uint64(2**57), sizes)
    word = np.concatenate([np.arange(k) * 70_001 for k in sizes])
    n = np.arange(len(ctx)) % 400 + 1
    n[0] = 2**40
    part = L.table_arrays(ctx, word, n)
    ends = np.cumsum(sizes)
    low, high = L.Tables._span(part, np.arange(len(sizes)))
    assert low.tolist() == (ends - sizes).tolist() and high.tolist() == ends.tolist()
    for c in range(len(sizes)):
        own = np.arange(low[c], high[c])
        for off in (0, 1):
            at = L.Tables._search(part, word[own] + off, np.full(len(own), low[c]), np.full(len(own), high[c]))
            assert at.tolist() == (own.tolist() if not off else [-1] * len(own))
        assert L.Tables._counts(part, own).tolist() == n[own].tolist()
    got = L.Tables._stats(part, np.arange(len(sizes)), low, high).T.tolist()
    assert got == [[int(x.sum()), int((x == 1).sum()), int((x == 2).sum()), int((x > 2).sum())] for x in (n[a:b] for a, b in zip(low, high))]
