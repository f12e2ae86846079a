"""Isolation forests against a plain one, the store of models and baselines, and its commits."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom import api
from logloom.operators import forest
from logloom.sources import store as stores
from logloom.sources.store import Store

M64 = 2**64 - 1


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def draws(seed, entity, tree, node):
    base = int.from_bytes(hashlib.blake2b(f"{seed}:{entity}".encode(), digest_size=8).digest(), "little")
    x = mix((base + tree * 0x9E3779B97F4A7C15 + node * 0xD1B54A32D192ED03) & M64)
    return [(mix((x + k) & M64) >> 11) / 2**53 for k in (1, 2)]


def tree_of(points, seed, entity, tree, limit, node=1, depth=0):
    """A plain recursive tree: (feature, cut, left, right) or the number of points."""
    spread = [j for j in range(len(points[0])) if min(p[j] for p in points) < max(p[j] for p in points)] if points else []
    if depth == limit or len(points) < 2 or not spread:
        return len(points)
    which, where = draws(seed, entity, tree, node)
    f = spread[min(int(which * len(spread)), len(spread) - 1)]
    lo, hi = min(p[f] for p in points), max(p[f] for p in points)
    cut = lo + where * (hi - lo)
    cut = cut if cut < hi else lo
    left, right = [p for p in points if p[f] <= cut], [p for p in points if p[f] > cut]
    return f, cut, tree_of(left, seed, entity, tree, limit, 2 * node, depth + 1), tree_of(right, seed, entity, tree, limit, 2 * node + 1, depth + 1)


def length(n):
    return 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def path(tree, x):
    deep = 0
    while isinstance(tree, tuple):
        tree, deep = tree[2] if x[tree[0]] <= tree[1] else tree[3], deep + 1
    return deep + length(tree)


def plain_scores(rows, entity, samples, seed, sample, trees):
    n = len(rows)
    limit = math.ceil(math.log2(max(min(n, sample), 2)))
    grown = [tree_of(samples(t), seed, entity, t, limit) for t in range(trees)]
    norm = length(min(n, sample))
    return {k: 2 ** -(sum(path(g, x) for g in grown) / trees / norm) if norm else 0.5 for k, x in rows}


def cloud(n, seed, outliers=0):
    rng = random.Random(seed)
    rows = [(f"d{i}", [rng.gauss(0, 1), float(rng.randrange(3)), 5.0]) for i in range(n)]
    return rows + [(f"out{i}", [30.0 + i, -40.0, 5.0]) for i in range(outliers)]


def table(spark, data):
    return spark.createDataFrame([(e, k, x) for e, rows in data.items() for k, x in rows], "entity string, key string, x array<double>").repartition(5)


def test_equal_to_a_plain_forest(spark):
    """Small entities give each tree all rows; a larger one the rows of smallest hash, found apart here."""
    data = {"amy": cloud(40, 1, 2), "bob": cloud(3, 2), "one": cloud(1, 3), "same": [(f"k{i}", [1.0, 1.0, 1.0]) for i in range(9)], "hot": cloud(300, 4, 3)}
    rows, trees, sample, seed = table(spark, data), 20, 32, 7
    drawn = rows.select("entity", "key", "x", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(F.lit(seed), "entity", t, "key"), F.lit(2**40)))).alias("tree", "draw"))
    marks = {}
    for r in drawn.collect():
        marks.setdefault((r.entity, r.tree), []).append((r.draw, r.key, r.x))
    want = sample + 6 * math.ceil(math.sqrt(sample))

    def samples(entity):
        n = len(data[entity])
        if n <= sample:
            return lambda t: [x for _, x in data[entity]]
        return lambda t: [x for d, _, x in sorted(m for m in marks[(entity, t)] if m[0] < 2.0**40 * want / n)[:sample]]

    model = forest.fit(rows, trees, sample, seed, block=6)
    got = forest.score(rows, model).collect()
    assert len(got) == sum(map(len, data.values()))
    for entity, points in data.items():
        plain = plain_scores(points, entity, samples(entity), seed, sample, trees)
        mine = {r.key: r.score for r in got if r.entity == entity}
        assert mine == pytest.approx(plain, rel=1e-12)
    top = sorted(((r.score, r.key) for r in got if r.entity == "hot"), reverse=True)
    assert {k for _, k in top[:3]} == {"out0", "out1", "out2"}
    assert max(len(r.start) for r in model.where("entity = 'hot'").collect()) <= 6


def test_scores_in_chunks_and_odd_rows(spark, monkeypatch):
    data = {"amy": cloud(200, 1, 2)}
    rows = table(spark, data)
    model = forest.fit(rows, 10, 64)
    whole = {r.key: r.score for r in forest.score(rows, model).collect()}
    monkeypatch.setattr(forest, "CHUNK", 16)
    assert {r.key: r.score for r in forest.score(rows, model).collect()} == whole
    other = spark.createDataFrame([("zoe", "k", [1.0, 1.0, 1.0])], "entity string, key string, x array<double>")
    assert [r.score for r in forest.score(other, model).collect()] == [None]
    odd = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, float("nan")), (None, 4, 1.0), ("a", 5, float("inf"))], "entity string, day int, v double")
    assert [r.key for r in forest.points(odd, F.col("entity"), F.col("day"), [F.col("v")]).collect()] == ["1"]
    none = rows.limit(0)
    assert forest.fit(none).count() == 0 and forest.score(none, forest.fit(none)).count() == 0


def keyed(spark, rows):
    return spark.createDataFrame(rows, "username string, v int")


def by_name(name, old, new):
    return api.merge_by_key(old, new, "username")


def test_a_crash_between_tables_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}", "ssh")
    store.commit({f"t{i}": keyed(spark, [("amy", i)]) for i in range(6)}, by_name, "T1")
    real = stores.put_if_absent
    monkeypatch.setattr(stores, "put_if_absent", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.commit({f"t{i}": keyed(spark, [("amy", 100)]) for i in range(6)}, by_name, "T2")
    monkeypatch.setattr(stores, "put_if_absent", real)

    def half(name, old, new):
        if name == "t4":
            raise RuntimeError("died after table 4")
        return by_name(name, old, new)

    with pytest.raises(RuntimeError):
        store.commit({f"t{i}": keyed(spark, [("amy", 100)]) for i in range(6)}, half, "T2")
    assert store.numbers() == [1] and [store.table(f"t{i}").first().v for i in range(6)] == list(range(6))


def test_two_writers_lose_no_key(spark, tmp_path, monkeypatch):
    """The second of two writers that began from one manifest merges with the first's."""
    store = Store(spark, str(tmp_path), "ssh")
    store.commit({"t": keyed(spark, [("amy", 1), ("bob", 1)])}, by_name, "T1")
    real, first = stores.put_if_absent, []

    def late(*a):
        if not first:
            first.append(1)
            Store(spark, str(tmp_path), "ssh").commit({"t": keyed(spark, [("bob", 2), ("cat", 2)])}, by_name, "T2")
        return real(*a)

    monkeypatch.setattr(stores, "put_if_absent", late)
    assert store.commit({"t": keyed(spark, [("cat", 3), ("dan", 3)])}, by_name, "T3") == 3
    assert {r.username: r.v for r in store.table("t").collect()} == {"amy": 1, "bob": 2, "cat": 3, "dan": 3}
    assert store.manifest()["tables"]["t"]["snapshots"] == 3 and {r.username: r.v for r in store.table("t", store.manifest(2)).collect()} == {"amy": 1, "bob": 2, "cat": 2}
    assert not real(spark, f"{store.folder}/manifests/{3:012d}.json", "x") and not [p for p in (tmp_path / "log_type=ssh" / "manifests").iterdir() if p.suffix == ".tmp"]


def test_models_in_the_store(spark, tmp_path):
    """A second training replaces its own entities' models only."""
    model = lambda seed, names: forest.fit(table(spark, {n: cloud(20, 5) for n in names}), 4, 8, seed).withColumn("kind", F.lit("user")).withColumn("cutoff", F.lit(0.5))
    api.save_baselines({"models": model(1, ["amy", "bob"])}, str(tmp_path), "ssh")
    before = {(r.entity, r.first_tree): r.threshold for r in api.load_baseline(spark, str(tmp_path), "models", "ssh").collect()}
    api.save_baselines({"models": model(2, ["bob", "eve"])}, str(tmp_path), "ssh")
    after = {(r.entity, r.first_tree): r.threshold for r in api.load_baseline(spark, str(tmp_path), "models", "ssh").collect()}
    assert {k[0] for k in after} == {"amy", "bob", "eve"} and len(after) == 3
    assert after[("amy", 0)] == before[("amy", 0)] and after[("bob", 0)] != before[("bob", 0)]
