import random

import numpy as np

from logloom.llm.embedding_dedup import near_duplicates, near_runs
from logloom.llm.topk import search, top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def clean(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def make(seed=0):
    rng = np.random.default_rng(seed)
    rows, base = [], rng.normal(size=(12, 8))
    for i in range(150):
        v = base[i % 12] + rng.normal(size=8) * rng.choice([0.05, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], i % 3))
    rows += [(200 + i, rows[7][1], 0) for i in range(30)]
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [None] + [1.0] * 7, 1), (303, [float("nan")] + [1.0] * 7, 0), (304, [], 0), (305, [float("inf")] * 8, 0), (306, [2 * x for x in rows[3][1]], 2)]
    rows += [rows[5], rows[5]]
    return rows


def brute(rows, t):
    items = sorted({(i, tuple(v)) for i, v, _ in rows if clean(v) and any(v)})
    x = np.array([v for _, v in items], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= t
    np.fill_diagonal(link, False)
    label = list(range(len(items)))
    changed = True
    while changed:
        changed = False
        for i in range(len(items)):
            m = min([label[j] for j in np.flatnonzero(link[i])] + [label[i]])
            if m < label[i]:
                label[i], changed = m, True
    return {items[i]: (int(link[i].sum()), items[label[i]][0]) for i in range(len(items))}


def test_near_duplicates(spark):
    rows = make()
    df = spark.createDataFrame([(*r, "k") for r in rows], SCHEMA + ", links string").repartition(4)
    want = brute(rows, 0.95)
    for run, leaf in ((2048, 256), (16, 4)):
        got = near_duplicates(df, run=run, leaf=leaf).collect()
        assert len(got) == len(rows)
        ids = {}
        for i, v, _ in rows:
            ids.setdefault(i, []).append(want.get((i, tuple(v)) if v else None, (0, i)))
        for r in got:
            assert (r.n_links, r.component_id) in ids[r.vec_id], r
            assert r.kept == (r.vec_id == r.component_id)


def test_near_duplicates_any_magnitude(spark):
    """Tiny, huge and subnormal vectors link by direction, and spoil no other vector's links."""
    near = [[1.0, 0.01 * i] for i in range(5)]
    odd = [[1e-170, 0.0], [1e200, 1e198], [5e-324, 0.0], [-1e300, 0.0], [1.7e308, 1.7e308], [0.0, 5e-324]]
    rows = [(i, v, 0) for i, v in enumerate([*near, *odd])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    for run in (2048, 2):
        got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(df, run=run, leaf=2).collect()}
        assert got == {**{i: (7, 0) for i in range(8)}, 8: (0, 8), 9: (0, 9), 10: (0, 10)}


def test_tree_of_intervals_finds_the_pairs_of_the_flat_join(spark):
    rng = np.random.default_rng(5)
    boxes = [(f, f"r{f}", sorted(rng.uniform(-1, 1, 2).tolist()), None) for f in range(70)]
    boxes = [(f, n, [lo[0], 0.0], [lo[1] if f % 3 else lo[0], 0.1]) for f, n, lo, _ in boxes]
    files = spark.createDataFrame(boxes, "f long, name string, lo array<double>, hi array<double>")
    want = set()
    for f, _, lo, hi in boxes:
        for g, _, lo2, hi2 in boxes[f:]:
            gap = [max(0, a - d, c - b) for a, b, c, d in zip(lo, hi, lo2, hi2)]
            if sum(x * x for x in gap) <= 0.05:
                want.add((f, g))
    got = near_runs(files, 70, 0.05, fan=4)
    assert {(r.f, r.f2) for r in got.collect()} == want and {(r.name, r.name2) for r in got.collect()} == {(f"r{a}", f"r{b}") for a, b in want}


def test_near_duplicates_empty_and_null_id(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    got = near_duplicates(spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (None, [0.0, 1.0], 2)], SCHEMA)).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1) for r in got) == [(-1, 0, -1), (-1, 1, 4), (4, 1, 4)]


def brute_top(rows, step, k):
    items = sorted({(i, tuple(v)) for i, v, _ in rows if clean(v)})
    q = {i: [int(np.floor(1024 * x)) for x in v] for i, v in items}
    out = {}
    for i in q:
        if i % step == 0:
            s = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)[:k]
            out[i] = [(j, -v) for v, j in s]
    return out


def test_top_k(spark):
    rows = make(4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute_top(rows, 10, 10)
    for range_rows, block in ((8192, 128), (20, 4)):
        got = {}
        for r in sorted(top_k(df, step=10, range_rows=range_rows, block=block).collect()):
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == want
    assert top_k(df.limit(0)).count() == 0
    few = top_k(df.where("vec_id in (10, 11)"), step=10).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(10, 1, 11)]


def test_top_k_floor_leaves_room_for_the_tenth(spark):
    """The query and nine copies fill one block's best; the tenth is in a block of lower bound."""
    rows = [(i, [1.0, 0.0] if i < 10 else [0.0, 1.0] if i < 128 else [0.9, 0.0], 0) for i in range(256)]
    df = spark.createDataFrame(rows, SCHEMA)
    for range_rows in (8192, 128):
        got = sorted((r["rank"], r.vec_id, r.score) for r in top_k(df, step=1000, range_rows=range_rows, block=128).collect())
        assert got == [(i, i, 1024 * 1024) for i in range(1, 10)] + [(10, 128, 1024 * 921)]


def test_top_k_of_repeated_ids(spark):
    """Rows of one id with unlike vectors take one place, here and in the floor; other columns don't matter."""
    rng = np.random.default_rng(9)
    rows = [(100, [1.0, 0.0], 0)] + [(7, [0.9 - 0.01 * i, 0.1], 0) for i in range(12)] + [(1, [0.5, 0.0], 0), (2, [0.4, 0.0], 0), (3, [0.3, 0.0], 0)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA + ", rank int, score string")
    for range_rows, block in ((8192, 128), (8192, 4), (4, 2)):
        got = sorted((r["rank"], r.vec_id, r.score) for r in top_k(df, k=3, range_rows=range_rows, block=block).collect())
        assert [g[:2] for g in got] == [(1, 7), (2, 1), (3, 2)]
    rows = [(int(rng.integers(0, 40)), [float(np.float32(x)) for x in rng.normal(size=4)], 0) for _ in range(200)]
    best = {}
    for i, v, _ in rows:
        for j, w, _ in rows:
            if i % 10 == 0 and i != j:
                s = sum(int(np.floor(1024 * a)) * int(np.floor(1024 * b)) for a, b in zip(v, w))
                best.setdefault(i, {})[j] = max(s, best.get(i, {}).get(j, s))
    want = {i: sorted(((-s, j) for j, s in x.items()))[:10] for i, x in best.items()}
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for range_rows, block in ((8192, 16), (32, 8)):
        got = {}
        for r in sorted(top_k(df, step=10, range_rows=range_rows, block=block).collect()):
            got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert got == want


def test_top_k_of_large_components(spark):
    rows = [(100, [1e18, 1.0], 0), (1, [1e13, 0.0], 0), (2, [1e-3, 1.0], 0), (3, [-1e300, 0.0], 0), (4, [1e14, 0.0], 0), (200, [9e12, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [(r.vec_id, r.score) for r in sorted(top_k(df).collect()) if r.query_id == 100]
    most = 2**63 - 1
    # scores beyond a long are its ends and tie; floor(1024 * 1e18) is itself set to the end
    assert got == [(1, most), (2, most), (4, most), (200, most), (3, -most)]
    got = [(r.vec_id, r.score) for r in sorted(top_k(df.where("vec_id in (2, 200)"), step=200).collect())]
    assert got == [(2, 1024 * 9 * 10**12 * 1 + 1024 * 1024)]


def test_search_prunes_and_stays_exact():
    rng = random.Random(2)
    d = np.array([[rng.randrange(-5, 6) + 100 * (i // 64 == j) for j in range(16)] for i in range(1024)])
    ids = np.arange(1024)
    at, found, score, scored = search(d[:8], ids[:8], d, ids, 5, 64)
    full = d[:8] @ d.T
    for q in range(8):
        best = sorted((-full[q, j], j) for j in range(1024) if j != q)[:5]
        assert [(s, i) for s, i in zip(-score[at == q], found[at == q])] == best
    assert scored < 8 * 16
    big = np.array([[2**31, 1], [2**31, 0], [-(2**31), 0]])
    at, found, score, _ = search(big[:1], np.array([0]), big, np.arange(3), 2, 2)
    assert score.tolist() == [2**62, -(2**62)] and found.tolist() == [1, 2]
