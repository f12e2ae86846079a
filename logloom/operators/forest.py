"""Isolation forests per entity: seeded trees over bounded subsamples, models as flat arrays.

Every entity (user, device or group) gets ``trees`` trees, each of at most ``sample``
rows.  An entity of no more rows than that gives all of them to each tree.  Of a
larger one each row draws, by a keyed hash, the trees that it takes part in, at a
rate that leaves a tree a little more than its sample, and the rows of smallest hash
stay; such an entity's trees are built in blocks, so that no task holds more than a
block's samples whatever the entity's size.

A split is drawn by a hash of (seed, entity, tree, node), so the same rows give the
same forest wherever and however often a task runs.  Trees grow level by level, all
trees of a block at once.  A model row holds a block of trees: where each tree
begins, and per node the feature (-1: leaf), threshold, place of the left child (the
right one follows it) and number of rows.

Scores are 2 ** (-mean path length / expected length), near 1 for rows that are
isolated early.  Scaling a feature changes no tree, so values are taken as they are.

Defined cases: rows with a null entity, or a null or non-finite value, take no part;
an entity of one row scores 0.5; rows of an entity without a model have a null
score; repeated rows count as many; an empty table gives empty tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TREES, SAMPLE, SEED, CONTAMINATION = 200, 256, 42, 0.05
BLOCK = 25  #: trees that one task builds for an entity of many rows
CHUNK = 65536  #: rows that one task scores for an entity, about

MODEL = "entity string, rows long, sample int, first_tree int, start array<int>, feature array<int>, threshold array<double>, left array<int>, size array<int>"
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def draws(seed: int, entity: str, tree: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in [0, 1) for each (tree, node): which feature, and where in its range."""
    base = int.from_bytes(hashlib.blake2b(f"{seed}:{entity}".encode(), digest_size=8).digest(), "little")
    with np.errstate(over="ignore"):
        x = _mix(_U(base) + tree.astype(_U) * _U(0x9E3779B97F4A7C15) + node.astype(_U) * _U(0xD1B54A32D192ED03))
        return tuple((_mix(x + _U(k)) >> _U(11)).astype(float) / 2**53 for k in (1, 2))


def expected_length(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    m = np.maximum(n, 3)
    return np.where(n > 2, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, tree: np.ndarray, trees: np.ndarray, depth: int, seed: int, entity: str) -> dict[str, np.ndarray]:
    """Flat arrays of the ``trees`` over points ``x``, each point of one tree; nodes of a tree in the order of their heap number."""
    slot = np.searchsorted(trees, tree)
    node = np.ones(len(x), np.int64)
    alive = np.arange(len(x))
    made = {k: [] for k in ("slot", "node", "feature", "threshold", "size")}
    for level in range(depth + 1):
        if not len(alive):
            break
        alive = alive[np.lexsort((node[alive], slot[alive]))]
        s, h = slot[alive], node[alive]
        head = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (h[1:] != h[:-1])]))
        count = np.diff(np.append(head, len(alive)))
        low, high = np.minimum.reduceat(x[alive], head, axis=0), np.maximum.reduceat(x[alive], head, axis=0)
        varies = high > low
        choices = varies.sum(1)
        inner = (choices > 0) & (count > 1) & (level < depth)
        which, where = draws(seed, entity, trees[s[head]], h[head])
        # the k-th of the features that vary
        k = np.minimum((which * choices).astype(int), np.maximum(choices - 1, 0))
        feature = np.where(inner, (np.cumsum(varies, axis=1) > k[:, None]).argmax(1), -1)
        at = np.arange(len(head))
        lo, hi = low[at, feature], high[at, feature]
        cut = lo + where * (hi - lo)
        cut = np.where(inner, np.where(cut < hi, cut, lo), 0.0)
        for key, v in zip(made, (s[head], h[head], feature, cut, count)):
            made[key].append(v)
        own = np.repeat(at, count)
        stays = inner[own]
        alive, own = alive[stays], own[stays]
        node[alive] = 2 * node[alive] + (x[alive, feature[own]] > cut[own])
    out = {k: np.concatenate(v) if v else np.zeros(0) for k, v in made.items()}
    order = np.lexsort((out["node"], out["slot"]))
    out = {k: v[order] for k, v in out.items()}
    start = np.searchsorted(out["slot"], np.arange(len(trees)))
    key = out["slot"] * (1 << (depth + 2)) + out["node"]
    left = np.searchsorted(key, out["slot"] * (1 << (depth + 2)) + 2 * out["node"])
    out["left"] = np.where(out["feature"] >= 0, left, -1)
    return out | {"start": start}


def path_lengths(x: np.ndarray, start: np.ndarray, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sum over trees of the path length of each row."""
    total = np.zeros(len(x))
    for a in range(0, len(x), 4096):
        part = x[a : a + 4096]
        at = np.repeat(start[None, :], len(part), axis=0)
        deep = np.zeros(at.shape)
        row = np.arange(len(part))[:, None]
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            at = np.where(inner, left[at] + (part[row, np.maximum(f, 0)] > threshold[at]), at)
            deep += inner
        total[a : a + 4096] = (deep + expected_length(size[at])).sum(1)
    return total


def _points(table: pa.Table) -> np.ndarray:
    lists = table.column("x").combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def points(table: DataFrame, entity: Column, key: Column, values: list[Column]) -> DataFrame:
    """(entity, key, x): rows that take part."""
    x = F.array(*[v.cast("double") for v in values])
    rows = table.select(entity.cast("string").alias("entity"), key.cast("string").alias("key"), x.alias("x"))
    return rows.where(F.col("entity").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))


def fit(rows: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """The model table (MODEL) of the forests of ``points``."""
    counts = rows.groupBy("entity").agg(F.count("*").alias("rows"))
    want = sample + 6 * int(np.ceil(np.sqrt(sample)))
    draw = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.pmod(F.xxhash64(F.lit(seed), "entity", t, "key"), F.lit(2**40)).alias("draw")))
    some = F.filter(draw, lambda d: d["draw"] < F.lit(2.0**40) * want / F.col("rows"))
    every = F.array(F.struct(F.lit(-1).alias("tree"), F.lit(0).cast("long").alias("draw")))
    drawn = rows.join(counts, "entity").withColumn("d", F.explode(F.when(F.col("rows") <= sample, every).otherwise(some))).select("entity", "rows", "key", "x", "d.*")
    drawn = drawn.withColumn("block", F.when(F.col("tree") < 0, -1).otherwise(F.floor(F.col("tree") / block).cast("int")))

    def build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by([("tree", "ascending"), ("draw", "ascending"), ("key", "ascending")])
        entity, n, x, tree = key[0].as_py(), table.column("rows")[0].as_py(), _points(table), table.column("tree").to_numpy()
        depth = int(np.ceil(np.log2(max(min(n, sample), 2))))
        if tree[0] < 0:
            blocks = [np.arange(a, min(a + block, trees)) for a in range(0, trees, block)]
        else:
            blocks = [np.unique(tree)]
            head = np.searchsorted(tree, blocks[0])
            keep = np.arange(len(tree)) - np.repeat(head, np.diff(np.append(head, len(tree)))) < sample
            x, tree = x[keep], tree[keep]
        for ids in blocks:
            px, pt = (np.tile(x, (len(ids), 1)), np.repeat(ids, len(x))) if tree[0] < 0 else (x, tree)
            t = grow(px, pt, ids, depth, seed, entity)
            yield pa.RecordBatch.from_pydict({
                "entity": [entity], "rows": pa.array([n], pa.int64()), "sample": pa.array([min(n, sample)], pa.int32()), "first_tree": pa.array([int(ids[0])], pa.int32()),
                **{c: pa.array([t[c].tolist()], pa.list_(pa.int32())) for c in ("start", "feature")}, "threshold": pa.array([t["threshold"].tolist()], pa.list_(pa.float64())),
                **{c: pa.array([t[c].tolist()], pa.list_(pa.int32())) for c in ("left", "size")},
            })

    return drawn.groupBy("entity", "block").applyInArrow(build, MODEL)


def score(rows: DataFrame, model: DataFrame) -> DataFrame:
    """(entity, key, x, score) of ``points``; an entity of many rows is scored in chunks."""
    salts = rows.groupBy("entity").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("salts"))
    salted = rows.join(salts, "entity").withColumn("salt", F.pmod(F.xxhash64("key", "x"), F.col("salts")).cast("int")).drop("salts")
    trees = model.join(salts, "entity").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def run(table: pa.Table, right: pa.Table) -> pa.Table:
        forest = right.to_pylist()
        table = table.set_column(table.schema.get_field_index("x"), "x", table.column("x").cast(pa.list_(pa.float64())))  # elements may be declared not null
        if not table.num_rows:
            return table.select(["entity", "key", "x"]).append_column("score", pa.array([], pa.float64()))
        x, scores = _points(table), None
        if forest:
            n_trees = sum(len(f["start"]) for f in forest)
            total = sum(path_lengths(x, *(np.array(f[c]) for c in ("start", "feature", "threshold", "left", "size"))) for f in sorted(forest, key=lambda f: f["first_tree"]))
            norm = float(expected_length(forest[0]["sample"]))
            scores = 2.0 ** -(total / n_trees / norm) if norm else np.full(len(x), 0.5)
        values = pa.array(scores, pa.float64()) if forest else pa.nulls(len(x), pa.float64())
        return table.select(["entity", "key", "x"]).append_column("score", values)

    return salted.groupBy("entity", "salt").cogroup(trees.groupBy("entity", "salt")).applyInArrow(run, "entity string, key string, x array<double>, score double")


def thresholds(scored: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """(entity, cutoff): the score that about ``contamination`` of an entity's rows lie above."""
    return scored.groupBy("entity").agg(F.percentile_approx("score", 1 - contamination, 10_000).alias("cutoff"))
