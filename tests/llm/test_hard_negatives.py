import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm.hard_negatives import Targets, centre_of, directions, lengths, mine, walk
from logloom.llm.topk import LEAST, MOST

SCHEMA = "vec_id long, embedding array<float>, label int"
MOST_LONG = 2**63 - 1


def make(seed=0, n=160, kinds=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, 8))
    rows = []
    for i in range(n):
        v = base[i % 6] * rng.choice([0.2, 0.5, 1]) + rng.normal(size=8) * 0.3
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, kinds))))
    rows += [(500 + i, rows[3][1], i % 2) for i in range(40)]  # one vector many times
    rows += [(600, None, 1), (601, [0.0] * 8, 1), (602, [None] + [1.0] * 7, 1), (603, [float("nan")] + [1.0] * 7, 0), (604, [], 0), (605, [float("inf")] * 8, 0), (606, rows[5][1], None), (None, rows[4][1], 1), (610, [1.0] * 3, 2)]
    rows += [rows[5], rows[5], (10, rows[11][1], 3), (-20, rows[8][1], 1)]
    return rows


def brute(rows, step, positives=5, negatives=3, scale=256):
    own = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        item = (label, [int(max(min(np.floor(scale * x), MOST_LONG), -(2**63))) for x in v])
        own[i] = min(own.get(i, item), item)
    clip = lambda s: max(min(s, MOST_LONG), -MOST_LONG)
    score = lambda a, b: clip(sum(x * y for x, y in zip(own[a][1], own[b][1])))
    out = set()
    for a in own:
        if a % step:
            continue
        other = sorted((-score(a, d), d) for d in own if d != a)
        for s, p in [x for x in other if own[x[1]][0] == own[a][0]][:positives]:
            fit = [x for x in other if own[x[1]][0] != own[a][0] and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out |= {(a, p, r + 1, d, -s, -t) for r, (t, d) in enumerate(fit)}
    return out


def result(df):
    rows = [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("file_rows,group", [(8192, 256), (16, 3), (50, 8)])
def test_mine(spark, file_rows, group):
    rows = make()
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], SCHEMA + ", g string, score double").repartition(5)
    assert result(mine(df, step=5, file_rows=file_rows, group=group)) == brute(rows, 5)


def test_label_as_an_expression_and_few_rows(spark):
    rows = make(3, 60)
    changed = [(i, v, (label + 1) % 4 if i is not None and label is not None and i % 7 == 0 else label) for i, v, label in rows]
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 4).otherwise(F.col("label"))
    assert result(mine(spark.createDataFrame(rows, SCHEMA), label, step=4)) == brute(changed, 4)
    assert mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mine(spark.createDataFrame(rows[:1], SCHEMA)).count() == 0
    no_anchor = [(3, [1.0], 0), (4, [1.0], 0), (6, [0.9], 1)]
    assert mine(spark.createDataFrame(no_anchor, SCHEMA)).count() == 0


def test_large_components(spark):
    rows = [(50, [1e14, 1.0], 0), (1, [1e3, 0.0], 0), (2, [5e2, 3.0], 1), (3, [9e2, 1.0], 1), (4, [1e300, 0.0], 0), (5, [-1e300, 2.0], 1), (100, [-1.0, 0.0], 0), (6, [0.0, -1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert result(mine(df)) == brute(rows, 50)


def test_walk_stops_and_stays_exact():
    """Clustered candidates: the shared list ends early, and what is found is what a full scan finds."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(20, 16))
    d = np.floor(256 * (np.repeat(base, 200, axis=0) + rng.normal(size=(4000, 16)) * 0.05)).astype(np.int64)
    ids, labels = np.arange(4000), np.arange(4000) % 3
    x, x_ids = d[:12], ids[:12]
    centre, radius = centre_of(directions(x))
    t = Targets(np.arange(12), np.full(12, MOST), np.full(12, LEAST), 5)
    done = walk(x, x_ids, lengths(x), 1, centre, radius, t, False, d, ids, labels, chunk=64)
    scores = x @ d.T
    for i in range(12):
        want = sorted((-scores[i, j], j) for j in range(4000) if labels[j] != 1 and j != i)[:5]
        assert [(-s, j) for s, j in zip(t.score[i], t.id[i])] == want
    assert done < 12 * 4000 / 5
