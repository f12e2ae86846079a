"""Exact top-k search by block-at-a-time pruning.

Vectors become integer weights floor(scale * x) per dimension ("term").  Documents
are cut into ranges of ids and each range into blocks; a block keeps its
forward index (its weights, document by document) and the largest and smallest
weight of each term.  For a query, a block's bound is the sum over terms of the
query's weight times the block's maximum (minimum for negative query weights).
Blocks are taken by falling bound and scored through their forward index until
the bound is below the k-th score found, so nothing that could enter is skipped.

Queries are blocked too: each pair (query block, document range) is one item of
work that yields at most k rows a query, and one grouped top-k merges them.
Before that, each range gives every query the k-th score of the range's best
block; the largest of these starts the pruning in every range.  Bounds come from
the small arrays of block extremes; a block's rows are read from the mapped file
only where its bound passes, so a range whose blocks all fall below is not read.

Defined cases: vectors that are null or hold null or non-finite components take no
part, as query or candidate; an empty vector scores 0 with all; vectors of unlike
length count as padded with zeros; exact repeats of a row count once and a vec_id
is never its own answer; rows with null vec_id take no part; of rows of one vec_id with
unlike vectors the best score counts, and the id takes one of the k places; ties go to
the smaller vec_id; weights and scores beyond a long are set to its ends (so such
scores tie); other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, cut, get_array, put_arrays, shared_dir
from .vectors import matrix, widened

K, SCALE, STEP, RANGE, BLOCK = 10, 1024, 100, 8192, 128
MOST, LEAST = 2**63 - 1, -(2**63)  #: the greatest score; what stands for no score


def _scores(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact integer inner products, set to +-MOST beyond; through doubles where these are exact."""
    if not q.size or not d.size:
        return np.zeros((len(q), len(d)), np.int64)
    x, y = q.astype(float), d.astype(float)
    if np.abs(x).max() * np.abs(y).max() * q.shape[1] < 2**53:
        return np.rint(x @ y.T).astype(np.int64)
    return np.clip(q.astype(object) @ d.T.astype(object), -MOST, MOST).astype(np.int64)


def extremes(d: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks x terms) largest and smallest weights."""
    starts = np.arange(0, len(d), block)
    if not d.shape[1]:
        return (np.zeros((len(starts), 0), np.int64),) * 2
    return np.maximum.reduceat(d, starts, axis=0), np.minimum.reduceat(d, starts, axis=0)


def _bounds(q: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """(queries x blocks) upper bounds of the scores, with room for rounding."""
    up, down, top, low = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float), top.astype(float), low.astype(float)
    size = up @ np.abs(top).T - down @ np.abs(low).T
    return up @ top.T + down @ low.T + size * 1e-12 + 1


def _block_scores(q: np.ndarray, q_ids: np.ndarray, d: np.ndarray, d_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of one block in order of id: the best score of each id; LEAST for the query's own."""
    s = _scores(q, d)
    head = np.flatnonzero(np.concatenate([[True], d_ids[1:] != d_ids[:-1]]))
    if len(head) < len(d_ids):
        s, d_ids = np.maximum.reduceat(s, head, axis=1), d_ids[head]
    return np.where(q_ids[:, None] == d_ids[None, :], LEAST, s), d_ids


def search(q: np.ndarray, q_ids: np.ndarray, d: np.ndarray, d_ids: np.ndarray, k: int, block: int, floor: np.ndarray | None = None, ends: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query position, id, score) of each query's k best ids in d (in order of id), and the number of (query, block) pairs scored.

    ``ends`` are the block extremes if known; rows of d are then read only for blocks that pass.
    """
    n = len(d)
    starts = np.arange(0, n, block)
    top, low = extremes(d, block) if ends is None else ends
    bound = _bounds(q, top, low)
    order = np.argsort(-bound, axis=1, kind="stable")
    best_s, best_i = np.full((len(q), k), LEAST), np.full((len(q), k), NO_ID)
    kth = np.full(len(q), -np.inf) if floor is None else floor.astype(float)
    crossing = bool((d_ids[starts[1:]] == d_ids[starts[1:] - 1]).any())  # an id lies in two blocks
    scored = 0
    for step in range(len(starts)):
        blocks = order[:, step]
        alive = bound[np.arange(len(q)), blocks] >= kth
        if not alive.any():
            break
        for b in np.unique(blocks[alive]):
            rows = np.flatnonzero(alive & (blocks == b))
            part = slice(starts[b], min(n, starts[b] + block))
            s, ids = _block_scores(q[rows], q_ids[rows], np.asarray(d[part]), d_ids[part])
            scored += len(rows)
            ids = np.where(s == LEAST, NO_ID, np.broadcast_to(ids, s.shape))
            s, ids = np.concatenate([best_s[rows], s], axis=1), np.concatenate([best_i[rows], ids], axis=1)
            if crossing:  # of an id's scores only the best stays
                by_id = np.lexsort((~s, ids), axis=1)
                s, ids = np.take_along_axis(s, by_id, 1), np.take_along_axis(ids, by_id, 1)
                again = np.zeros(s.shape, bool)
                again[:, 1:] = ids[:, 1:] == ids[:, :-1]
                s, ids = np.where(again, LEAST, s), np.where(again, NO_ID, ids)
            pick = np.lexsort((ids, ~s), axis=1)[:, :k]  # ~s falls as s rises and can't overflow
            best_s[rows], best_i[rows] = np.take_along_axis(s, pick, 1), np.take_along_axis(ids, pick, 1)
            full = best_s[rows, k - 1] != LEAST
            kth[rows[full]] = np.maximum(kth[rows[full]], best_s[rows[full], k - 1])
    at, rank = np.nonzero(best_s != LEAST)
    return at, best_i[at, rank], best_s[at, rank], scored


def top_k(table: DataFrame, k: int = K, scale: float = SCALE, step: int = STEP, id_col: str = "vec_id", vector: str = "embedding", range_rows: int = RANGE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``step``, its k best others."""
    spark = table.sparkSession
    folder = shared_dir(spark)
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * scale))
    fine = F.col(vector).isNotNull() & F.col(id_col).isNotNull() & ~F.exists(F.col(vector).cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = cut(table.where(fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).distinct())
    n = rows.count()
    schema = "name string, n long, width int"

    def store(batches):
        parts = [(matrix(b.column("v"))[0], b.column("id").to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        width = max(p[0].shape[1] for p in parts)
        x = np.concatenate([widened(p[0], width) for p in parts]).astype(np.int64)
        top, low = extremes(x, block)
        name = put_arrays(folder, {"x": x, "id": np.concatenate([p[1] for p in parts]), "top": top, "low": low})
        yield pa.RecordBatch.from_pydict({"name": [name], "n": [len(x)], "width": pa.array([width], pa.int32())})

    def files(part: DataFrame, count: int, size: int) -> DataFrame:
        return cut(part.repartitionByRange(max(1, -(-count // size)), "id", "v").sortWithinPartitions("id", "v").mapInArrow(store, schema))

    queries = rows.where(F.pmod("id", F.lit(step)) == 0)
    docs, asked = files(rows, n, range_rows), files(queries, queries.count(), 1024)
    pairs = asked.select(F.col("name").alias("q")).join(docs.select(F.col("name").alias("d")))  # blocks of the query set x ranges
    # a task's pairs are those of few query blocks, so that what it finds for a block is folded before it leaves
    tasks = max(1, min(n // 1024 + 1, 8 * spark.sparkContext.defaultParallelism))
    work = cut(pairs.repartitionByRange(tasks, "q", "d").sortWithinPartitions("q"))

    def load(q: str, d: str) -> tuple[np.ndarray, ...]:
        """Queries and their ids; a range's mapped rows, its ids and block extremes; all of one width."""
        x, y, top, low = get_array(folder, q, "x"), get_array(folder, d, "x"), get_array(folder, d, "top"), get_array(folder, d, "low")
        w = max(x.shape[1], y.shape[1])
        return widened(x, w), np.array(get_array(folder, q, "id")), widened(y, w), np.array(get_array(folder, d, "id")), widened(top, w), widened(low, w)

    def first(batches):
        block_now, best_now = None, None  # of the query block at hand, over the task's ranges
        for batch in batches:
            for q, d in zip(batch.column("q").to_pylist(), batch.column("d").to_pylist()):
                x, xi, y, yi, top, low = load(q, d)
                best = _bounds(x, top, low).argmax(1)
                kth = np.full(len(x), np.nan)
                for b in np.unique(best):
                    at = np.flatnonzero(best == b)
                    part = slice(b * block, min(len(y), (b + 1) * block))
                    s, _ = _block_scores(x[at], xi[at], np.asarray(y[part]), yi[part])
                    if s.shape[1] >= k:
                        least = np.sort(s, axis=1)[:, -k]
                        kth[at] = np.where(least == LEAST, np.nan, least)  # LEAST: fewer than k others
                if q != block_now:
                    if block_now is not None:
                        yield pa.RecordBatch.from_pydict({"q": [block_now], "kth": [best_now.tolist()]})
                    block_now, best_now = q, kth
                else:
                    best_now = np.fmax(best_now, kth)
        if block_now is not None:
            yield pa.RecordBatch.from_pydict({"q": [block_now], "kth": [best_now.tolist()]})

    def best_floor(pdf):
        import pandas as pd

        return pd.DataFrame({"q": [pdf["q"].iloc[0]], "kth": [np.fmax.reduce(np.stack(pdf["kth"].to_numpy()))]})

    floors = work.mapInArrow(first, "q string, kth array<double>")
    floors = floors.groupBy("q", F.pmod(F.spark_partition_id(), F.lit(64)).alias("g")).applyInPandas(best_floor, "q string, kth array<double>")
    floors = cut(floors.groupBy("q").applyInPandas(best_floor, "q string, kth array<double>"))

    def full(batches):
        for batch in batches:
            for q, d, floor in zip(batch.column("q").to_pylist(), batch.column("d").to_pylist(), batch.column("kth").to_pylist()):
                x, xi, y, yi, top, low = load(q, d)
                start = np.array([-np.inf if v is None or np.isnan(v) else v for v in floor], float)
                at, ids, scores, _ = search(x, xi, y, yi, k, block, start, (top, low))
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(xi[at], pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64())})

    local = work.join(floors, "q").mapInArrow(full, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = local.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")


def op5_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = """
with g as (select distinct vec_id, embedding::double[] e from embeddings where vec_id is not null and embedding is not null),
v as (select vec_id, list_transform(e, lambda x: floor(1024 * x)) v from g where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, d.vec_id, list_dot_product(q.v, d.v)::bigint score from v q join v d on q.vec_id <> d.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
