import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.llm import toxicity as m

SCHEMA = "doc_id long, text string, lang string, score string, predicted string"
LABELS = "doc_id long, quality int, toxic int"
INSULTS = "idiot moron scum trash".split()
GROUPS = "gay lesbian muslim jewish".split()


def biased(n=600, seed=2):
    """Toxic texts name groups far more often than others do; only the insults are toxic."""
    rng = random.Random(seed)
    vocab = [f"word{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        words = [rng.choice(vocab) for _ in range(25)]
        if toxic and rng.random() < 0.85:
            words[rng.randrange(25)] = rng.choice(INSULTS)
        if rng.random() < (0.7 if toxic else 0.05):
            words[rng.randrange(25)] = rng.choice(GROUPS)
        rows.append((i, " ".join(words).capitalize() + ".", "en", "s", "p"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_swaps_lower_false_positives_on_neutral_mentions(spark):
    rows, labels = biased()
    docs, known = spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(labels, LABELS)
    neutral = pa.array([f"word{i} word{i + 1} my {g} neighbour word3" for i in range(20) for g in GROUPS])
    toxic = pa.array([f"word{i} you {w} word5" for i in range(20) for w in INSULTS])
    plain, paired = m.fit(docs, known, pair_weight=0.0), m.fit(docs, known)
    false = [(model.scores(neutral) >= m.THRESHOLD).mean() for model in (plain, paired)]
    assert false[0] > 0.9 and false[1] < 0.05, false
    assert (paired.scores(toxic) >= m.THRESHOLD).mean() > 0.95
    for t in ("a gay person", "idiot and muslim"):  # swaps barely move a score
        a, b = paired.scores(pa.array([t, m.swapped(t, 0)]))
        assert abs(a - b) < 0.1


def test_held_out_rows(spark):
    """Fitted on three quarters, on texts where stems stand in compounds; whole texts count, to the last word."""
    rng = random.Random(5)
    vocab = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnr"]
    rows, labels = [], []
    for i in range(800):
        words = [rng.choice(vocab) + rng.choice(vocab) for _ in range(30)]
        if i % 4 == 0:
            words[-1] = "schurke" + rng.choice(vocab)
        rows.append((i, ("x " * 200_000 if i in (8, 9) else "") + " ".join(words), "de", "s", "p"))
        labels.append((i, None, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    model = m.fit(docs, spark.createDataFrame(labels, LABELS), ~m.held_out())
    got = m.score(docs.withColumn("held_out", m.held_out()), model, ["doc_id", "held_out"]).collect()
    assert sorted(r.doc_id for r in got) == list(range(800)) and 100 < sum(r.held_out for r in got) < 300
    assert all(r.predicted == int(r.doc_id % 4 == 0) == int(r.score >= 0.3) for r in got)


def brute_telling(texts, labels, least):
    seen = {0: Counter(), 1: Counter()}
    for t, y in zip(texts, labels):
        words = set("".join(c if c.isalnum() else " " for c in t.lower()).split())
        seen[y].update({("w", w) for w in words} | {("p", w[:n]) for w in words for n in m.PREFIXES if len(w) > n})
    n1, n0 = sum(labels), len(labels) - sum(labels)
    tried = {f: (seen[1][f], seen[0][f]) for f in set(seen[0]) | set(seen[1]) if seen[0][f] + seen[1][f] >= least}
    x = lambda o, e: o * math.log(o / e) if o else 0.0
    out = {}
    for f, (a, b) in tried.items():
        s = (a + b) / (n1 + n0)
        out[f] = 2 * (x(a, s * n1) + x(n1 - a, (1 - s) * n1) + x(b, s * n0) + x(n0 - b, (1 - s) * n0))
    return {f for f, g in out.items() if g >= 2 * math.log(max(2, len(tried)))}


def test_telling_features(spark):
    rows, labels = biased(300, 7)
    sample = spark.createDataFrame([(r[0], y[2], r[1].lower()) for r, y in zip(rows, labels)], "doc_id long, toxic int, text string").repartition(3)
    want = brute_telling([r[1] for r in rows], [y[2] for y in labels], m.MIN_DOCS)
    got = m.telling(sample)
    made, known = m.Features(), {}
    for kind, f in want:
        _, _, w = next(m._slices(pa.array([f if kind == "w" else f + "x" * 9])))
        h = made.of(w)[1]
        known[(kind, f)] = h[0] if kind == "w" else h[1 + m.PREFIXES.index(len(f))]
    assert set(got.tolist()) == {int(h) for h in known.values()} and len(got) == len(want) > 4


def test_swapped():
    assert m.swapped("a gay and a lesbian man, gayly", 0) == "a heterosexual and a queer woman, gayly"
    for turn in range(20):
        t = m.swapped("muslim women", turn)
        assert "muslim" not in t and "women" not in t
    assert all(len(set(terms)) == len(terms) > 1 for terms in m.IDENTITY.values())


def test_near_copies_count_once(spark):
    text = " ".join(f"t{i}" for i in range(50))
    rows = [(i, i % 3 != 0, text + f" end{i}") for i in range(9)] + [(20, False, "other words here now then again"), (21, True, ""), (22, False, "two words")]
    got = m.without_copies(spark.createDataFrame([(i, int(y), t) for i, y, t in rows], "doc_id long, toxic int, text string")).collect()
    kept = {r.doc_id: r.toxic for r in got}
    assert {20, 21, 22} <= set(kept) and len(kept) <= 6 and all(y == 1 for i, y in kept.items() if i < 9 and i == 0)


@pytest.mark.parametrize("labels,score", [([], 0.0), ([(1, 1, None), (None, 1, 1)], 0.0), ([(1, 1, 1), (2, 1, 1)], 2.5 / 3), ([(1, 0, 0), (1, 1, 0), (2, 1, 0)], 0.5 / 3)])
def test_few_labels(spark, labels, score):
    rows = [(1, "one text of words here", "en", "s", "p"), (2, "two", None, None, None), (None, None, None, None, None), (3, "", "en", "", ""), (3, "", "en", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = m.fit(docs, spark.createDataFrame(labels, LABELS))
    got = m.score(docs, model, ["doc_id"]).collect()
    assert len(got) == 5 and all(abs(r.score - score) < 1e-9 and r.predicted == int(r.score >= 0.3) for r in got)


def test_odd_rows(spark):
    rows, labels = biased(240, 9)
    rows += [(None, "idiot", "en", "s", "p"), (900, None, "en", "s", "p"), (901, "", "en", "s", "p"), (902, "IDIOT!!! $$$", "en", "s", "p"), (3, "another text of id 3 moron", "en", "s", "p"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = m.fit(docs, spark.createDataFrame(labels + [(0, 1, 0), (5, 0, None)], LABELS))
    got = m.score(docs, model, ["doc_id"]).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.score for r in got}
    base = 1 / (1 + np.exp(-model.intercept))
    assert by[900] == by[901] == pytest.approx(base) and by[902] >= 0.3 and by[None] == by[902]
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    assert m.score(docs.limit(0), model, ["doc_id"]).count() == 0
    assert m.score(docs.where(F.lit(False)), m.fit(docs.limit(0), spark.createDataFrame([], LABELS)), ["doc_id"]).count() == 0
