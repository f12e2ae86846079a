"""Embedding near-dedup by an epsilon grid order join.

Vectors are scaled to length 1, so cosine >= t means a distance of at most
eps = sqrt(2 - 2t).  They are turned to their principal axes (which keeps
distances), cut into grid cells of side eps on the leading axes, and sorted by
those cells: the epsilon grid order.  The sorted sequence goes, run by run, to
block files in the shared folder.

The join recurses over intervals of the sequence.  Above the runs the intervals
are nodes of a tree (FAN runs, FAN**2 runs, ...), each with the bounding box of its
vectors on the leading axes: starting from the root, pairs of nodes whose boxes
lie further apart than eps are skipped and the others replaced by the pairs of
their children, by joins on the parents' numbers.  Within a pair of runs intervals
are halved likewise until small and then compared by one matrix product in double
precision.

A pair of intervals yields, for each vector, a count of its links and a spanning
forest of the links, never the pairs, so a group of N near copies yields O(N)
rows for each pair of runs.  Equal vectors (by two 64-bit hashes) are joined once,
with their number.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing and are their own component; tiny and huge vectors
count like any, by their direction; vectors of unlike length count as padded with
zeros; exact repeats of a row (vec_id and vector) are one vector and each gets its
row's result; rows of one vec_id with unlike vectors are different vectors; a null
vec_id ranks last and is returned as null (its component_id is null if no vector
with an id is in its component); other columns are not read; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, connected_components, cut, get_array, id_of, put_arrays, shared_dir
from .vectors import matrix, unit, widened

THRESHOLD = 0.95
RUN, LEAF, FAN = 2048, 256, 16
GRID_AXES, BOX_AXES = 6, 32  #: leading axes of the grid order and of the boxes above the runs


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total, square = 0, np.zeros(0), np.zeros((0, 0))
    for batch in batches:
        x, valid = matrix(batch.column(0))
        x = unit(x[valid])[0]
        w = max(x.shape[1], len(total))
        total = np.pad(total, (0, w - len(total)))
        square = np.pad(square, ((0, w - len(square)),) * 2)
        x = widened(x, w)
        n, total, square = n + len(x), total + x.sum(0), square + x.T @ x
    yield pa.RecordBatch.from_pydict({"n": [n], "total": [total.tolist()], "square": [square.ravel().tolist()]})


def principal_axes(vectors: DataFrame, folder: str) -> tuple[str, int]:
    """(name of the array of axes, width): columns by falling variance.

    Moments are summed per task, in 32 groups and then in one task, which writes the axes.
    """
    sums = vectors.select("v").mapInArrow(_moments, "n long, total array<double>, square array<double>")
    part = sums.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(32)))

    def added(rows):
        w = max(len(t) for _, t, _ in rows)
        n, total, square = 0, np.zeros(w), np.zeros((w, w))
        for m, t, s in rows:
            n += int(m)
            total[: len(t)] += t
            square[: len(t), : len(t)] += np.reshape(s, (len(t), len(t)))
        return n, total, square

    def add(pdf):
        import pandas as pd

        n, total, square = added(list(zip(pdf["n"], pdf["total"], pdf["square"])))
        return pd.DataFrame({"n": [n], "total": [total], "square": [square.ravel()]})

    def finish(pdf):
        import pandas as pd

        n, total, square = added(list(zip(pdf["n"], pdf["total"], pdf["square"])))
        axes = np.eye(len(total))
        if n:
            values, axes = np.linalg.eigh(square / n - np.outer(total / n, total / n))
            axes = axes[:, np.argsort(-values)]
        return pd.DataFrame({"name": [put_arrays(folder, {"axes": axes})], "width": [len(total)]})

    grouped = part.groupBy("g").applyInPandas(add, "n long, total array<double>, square array<double>")
    row = grouped.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(finish, "name string, width long").first()
    return (row.name, row.width) if row else (None, 0)


def _forest(rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smaller node) of a spanning forest of the links rows[i] - cols[i]."""
    nodes, at = np.unique(np.concatenate([rows, cols]), return_inverse=True)
    a, b = at[: len(rows)], at[len(rows) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = np.minimum(new, new[label])
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _join_runs(x: np.ndarray, y: np.ndarray, same: bool, t: float, leaf: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked positions (i of x, j of y; i < j within one run), interval by interval."""
    eps2 = 2 - 2 * t + 1e-9
    stack = [(0, len(x), 0, len(y))]
    while stack:
        a, b, c, d = stack.pop()
        if a >= b or c >= d or (same and d <= a):
            continue
        u, v = x[a:b], y[c:d]
        gap = np.maximum(0, np.maximum(u.min(0) - v.max(0), v.min(0) - u.max(0)))
        if gap @ gap > eps2:
            continue
        if b - a <= leaf and d - c <= leaf:
            cos = u @ v.T
            i, j = np.nonzero(cos >= t - 1e-9)
            if len(i):
                i, j = i + a, j + c
                keep = i < j if same else np.ones(len(i), bool)
                if keep.any():
                    yield i[keep], j[keep]
            continue
        if same and a == c and b == d:
            m = (a + b) // 2
            stack += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        elif b - a >= d - c:
            m = (a + b) // 2
            stack += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            stack += [(a, b, c, m), (a, b, m, d)]


def _apart2(lo: str, hi: str, lo2: str, hi2: str):
    """Squared distance of two boxes."""
    gaps = F.transform(F.arrays_zip(lo, hi, lo2, hi2), lambda z: F.greatest(F.lit(0.0), z[lo] - z[hi2], z[lo2] - z[hi]))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)


def near_runs(files: DataFrame, runs: int, eps2: float, fan: int = FAN) -> DataFrame:
    """(f, name, f2, name2): pairs of runs, f <= f2, whose boxes lie within eps, found down the tree of intervals."""
    level = files.select(F.col("f").alias("node"), "name", "lo", "hi")
    levels = [level]
    while runs > fan:
        runs = -(-runs // fan)
        # the box of an interval of fan nodes: the least and greatest bounds, axis by axis
        split = level.select(F.floor(F.col("node") / fan).alias("node"), F.posexplode(F.arrays_zip("lo", "hi")).alias("axis", "z"))
        box = split.groupBy("node", "axis").agg(F.min("z.lo").alias("l"), F.max("z.hi").alias("h"))
        box = box.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("axis", "l", "h"))).alias("b"))  # one entry per axis
        level = cut(box.select("node", F.lit(None).cast("string").alias("name"), F.col("b.l").alias("lo"), F.col("b.h").alias("hi")))
        levels.append(level)
    pairs = None
    for level in reversed(levels):
        left = level.select(F.col("node").alias("f"), "name", "lo", "hi", F.floor(F.col("node") / fan).alias("up"))
        right = level.select(F.col("node").alias("f2"), F.col("name").alias("name2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.floor(F.col("node") / fan).alias("up2"))
        # at most fan nodes lie below one node, so each pair has at most fan ** 2 pairs of children
        near = left.join(right, F.col("up") == F.col("up2")) if pairs is None else pairs.join(left, "up").join(right, "up2")
        near = near.where((F.col("f") <= F.col("f2")) & (_apart2("lo", "hi", "lo2", "hi2") <= eps2))
        found = cut(near.select("f", "name", "f2", "name2"))
        pairs = found.select(F.col("f").alias("up"), F.col("f2").alias("up2"))
    return found


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector: str = "embedding", run: int = RUN, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``table``."""
    spark = table.sparkSession
    rows = table.select(F.col(id_col).alias("vec_id"), id_of(id_col).alias("_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("c1", F.when(fine, F.xxhash64("v"))).withColumn("c2", F.when(fine, F.xxhash64(F.lit(1), "v")))
    once = rows.where("c1 is not null").groupBy("c1", "c2", "_id").agg(F.first("v").alias("v"))
    classes = cut(once.groupBy("c1", "c2").agg(F.first("v").alias("v"), F.count("*").alias("m"), F.min("_id").alias("low")))
    folder, eps2 = shared_dir(spark), 2 - 2 * threshold + 1e-9
    axes_name, width = principal_axes(classes, folder)
    eps, carried = float(np.sqrt(2 - 2 * threshold)), ("c1", "c2", "v", "m", "low")

    def place(batches):
        for batch in batches:
            axes = np.array(get_array(folder, axes_name, "axes")[:, :GRID_AXES])
            x = unit(widened(matrix(batch.column("v"))[0], width))[0]
            cells = np.floor((x @ axes) / eps).astype(np.int32)
            out = {f"g{k}": pa.array(cells[:, k] if k < cells.shape[1] else np.zeros(len(x), np.int32), pa.int32()) for k in range(GRID_AXES)}
            yield pa.RecordBatch.from_pydict(out | {c: batch.column(c) for c in carried})

    runs = max(1, -(-classes.count() // run))
    order = [f"g{k}" for k in range(GRID_AXES)] + ["low", "c1", "c2"]
    grid = ", ".join(f"g{k} int" for k in range(GRID_AXES))
    placed = classes.mapInArrow(place, f"{grid}, c1 long, c2 long, v array<double>, m long, low long")
    placed = placed.repartitionByRange(runs, *order).sortWithinPartitions(*order)

    def store(batches):
        from pyspark import TaskContext

        parts = [(matrix(b.column("v"))[0], *[b.column(c).to_numpy() for c in ("m", "low", "c1", "c2")]) for b in batches if b.num_rows]
        if not parts:
            return
        axes = np.array(get_array(folder, axes_name, "axes"))
        x, raw = unit(np.concatenate([widened(p[0], width) for p in parts]))
        turned = x @ axes
        name = put_arrays(folder, {"x": turned, "raw": raw} | {c: np.concatenate([p[k] for p in parts]) for k, c in enumerate(("m", "low", "c1", "c2"), 1)})
        box = turned[:, :BOX_AXES]
        # the task's number is the run's place in the grid order
        yield pa.RecordBatch.from_pydict({"f": pa.array([TaskContext.get().partitionId()], pa.int64()), "name": [name], "lo": [box.min(0).tolist()], "hi": [box.max(0).tolist()]})

    files = cut(placed.mapInArrow(store, "f long, name string, lo array<double>, hi array<double>"))
    last = files.agg(F.max("f")).first()[0]
    work = near_runs(files, (last or 0) + 1, eps2, fan)
    work = work.repartition(max(1, min(4 * spark.sparkContext.defaultParallelism, runs * runs)), "f", "f2")

    def join(batches):
        for batch in batches:
            for f, a, f2, b in zip(*[batch.column(c).to_pylist() for c in ("f", "name", "f2", "name2")]):
                x, y, rx, ry = get_array(folder, a, "x"), get_array(folder, b, "x"), get_array(folder, a, "raw"), get_array(folder, b, "raw")
                mx, my, same = get_array(folder, a, "m"), get_array(folder, b, "m"), f == f2
                x, y = np.array(x), np.array(y)
                nx, ny = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
                if same:
                    ny = nx
                edges = []
                for i, j in _join_runs(x, y, same, threshold, leaf):
                    p, q = rx[i], ry[j]
                    cos = np.einsum("ij,ij->i", p, q) / (np.sqrt(np.einsum("ij,ij->i", p, p)) * np.sqrt(np.einsum("ij,ij->i", q, q)))
                    ok = cos >= threshold
                    i, j = i[ok], j[ok]
                    if not len(i):
                        continue
                    np.add.at(nx, i, my[j])
                    np.add.at(ny, j, mx[i])
                    edges.append(_forest(i + (f << 32), j + (f2 << 32)))
                out = [(f, nx)] if same else [(f, nx), (f2, ny)]
                node = np.concatenate([np.flatnonzero(n) + (k << 32) for k, n in out])
                links = np.concatenate([n[n > 0] for _, n in out])
                up, down = (np.concatenate([e[k] for e in edges]) for k in (0, 1)) if edges else (np.zeros(0, np.int64),) * 2
                if len(up):
                    up, down = _forest(up, down)
                size = len(node) + len(up)
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array(np.concatenate([node, up]), pa.int64()),
                    "links": pa.array(np.concatenate([links, np.zeros(len(up), np.int64)]), pa.int64()),
                    "to": pa.array(np.concatenate([np.full(len(node), -1), down]), pa.int64(), mask=np.arange(size) < len(node)),
                })

    found = cut(work.mapInArrow(join, "node long, links long, to long"))
    labels = connected_components(found.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")))
    links = found.where("to is null").groupBy("node").agg(F.sum("links").alias("links"))

    def members(batches):
        for batch in batches:
            for f, name in zip(batch.column("f").to_pylist(), batch.column("name").to_pylist()):
                cols = {c: np.array(get_array(folder, name, c)) for c in ("c1", "c2", "m", "low")}
                yield pa.RecordBatch.from_pydict({"node": np.arange(len(cols["m"])) + (f << 32)} | cols)

    nodes = files.select("f", "name").mapInArrow(members, "node long, c1 long, c2 long, m long, low long")
    nodes = nodes.join(links, "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    nodes = cut(nodes)
    lows = nodes.groupBy("label").agg(F.min("low").alias("component"))
    nodes = nodes.join(lows, "label").select("c1", "c2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), "component")
    out = rows.select("vec_id", "_id", "c1", "c2").join(nodes, ["c1", "c2"], "left")
    component = F.coalesce("component", "_id")
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(component != NO_ID, component).alias("component_id"),
        (F.col("_id") == component).alias("kept"),
    )


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
with r as (select distinct vec_id, embedding::double[] v from embeddings),
g as (select vec_id, v from r where v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(v, v) > 0),
l as (select a.vec_id a, b.vec_id b from g a join g b on a.vec_id <> b.vec_id and list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.95),
n as (select a, count(*) n from l group by a),
c as (with recursive t(a, b) as (select vec_id, vec_id from r union select t.a, l.b from t join l on l.a = t.b) select a, min(b) m from t group by a)
select e.vec_id, coalesce(n.n, 0)::bigint n_links, c.m component_id, e.vec_id = c.m kept from embeddings e left join n on n.a = e.vec_id left join c on c.a = e.vec_id
"""
