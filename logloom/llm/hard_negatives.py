"""Hard negatives by anchor-clustered shared lists.

Vectors become integer weights floor(scale * x); a score is their inner product.
An anchor's positives are its best rows of the same label; the negatives of an
anchor and a positive are the best rows of other labels whose score lies in a
window below the positive's.

Anchors are clustered by direction within their label and cut into groups of
GROUP members.  For a group and a file of candidates the candidates are sorted
once, by the angular upper bound |x| * cos(max(0, angle to the group's centre -
the group's radius)): no member's score divided by its length can exceed it.
Every member walks that shared list until its own bound falls below the last
score it needs, which certifies that nothing further down can enter.  A member
has a target per list it fills: one for its positives, then one per positive
with a cap on the score and a least score.

Candidate files hold rows in order of (label, id), mapped from the shared folder.
Files are dealt into shards of some SHARD files, each with an index of its files
(centre, radius, largest length, labels).  A task takes a group and a shard, bounds
the shard's files in one pass, walks them by falling bound and stops at the first
that can't enter, so only files that a group's bound reaches are read.  What a
task yields is bounded by its targets, and one grouped top-k merges the shards.

Defined cases: rows whose label, vector or id is null, or whose vector holds null or
non-finite components, take no part; vectors of unlike length count as padded with
zeros and an empty one scores 0; of rows of one id the smallest by (label, vector)
counts; zero vectors are anchors and candidates like others; ties go to the smaller
id; weights and scores beyond a long are set to its ends; a positive with a negative
score has no negatives; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, cut, get_array, put_arrays, shared_dir
from .topk import LEAST, MOST, _scores
from .vectors import matrix, widened

SCALE, STEP, POSITIVES, NEGATIVES = 256, 50, 5, 3
LOW, HIGH = 50, 95  #: percent of the positive's score that a negative's may have
FILE, GROUP, CENTRES, CHUNK = 8192, 256, 64, 512
SHARD = 512  #: files that a task walks for a group, about
SLACK = 1e-7  #: of an angle, for rounding


# ---------------------------------------------------------------- geometry


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(float) ** 2).sum(1))


def directions(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero row stays zero."""
    n = lengths(x)
    return x / np.where(n > 0, n, 1)[:, None]


def angles(u: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Angles of rows of length 1 to a centre of length 1; a zero row is at 0."""
    return np.where(u.any(1), np.arccos(np.clip(u @ centre, -1, 1)), 0.0)


def reach(length, angle, radius):
    """Upper bound of score / |member| over members within ``radius`` of the centre."""
    return length * (np.cos(np.maximum(0, angle - radius - SLACK)) + 1e-12)


def centre_of(u: np.ndarray) -> tuple[np.ndarray, float]:
    """(centre, radius) of rows of length 1 or 0."""
    c = u.sum(0)
    n = np.sqrt((c**2).sum())
    if not n > 1e-9:
        c, n = (u[np.argmax(u.any(1))] if len(u) else c), 1.0
    c = c / n if n != 1.0 else c
    return c, float(angles(u, c).max(initial=0.0)) if c.any() else np.pi


# ---------------------------------------------------------------- the walk of one shared list


class Targets:
    """Lists that members fill: the ``k`` best scores between ``least`` and ``cap``."""

    def __init__(self, member: np.ndarray, cap: np.ndarray, least: np.ndarray, k: int):
        self.member, self.cap, self.least, self.k = member, cap, least, k
        self.score, self.id = np.full((len(member), k), LEAST), np.full((len(member), k), NO_ID)

    def needed(self) -> np.ndarray:
        """The score below which nothing more can enter, per target."""
        return np.maximum(self.least, self.score[:, -1])

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Scores (targets ``rows`` x candidates) of candidates; ``allowed`` masks labels and own rows."""
        need = self.needed()[rows][:, None]
        t, c = np.nonzero(allowed & (scores >= need) & (scores <= self.cap[rows][:, None]))
        if not len(t):
            return
        s, i = scores[t, c], ids[c]
        last = rows[t]
        enters = (s > self.score[last, -1]) | (i < self.id[last, -1])
        last, s, i = last[enters], s[enters], i[enters]
        touched = np.unique(last)
        if not len(touched):
            return
        held = np.repeat(touched, self.k)
        last, s, i = np.concatenate([held, last]), np.concatenate([self.score[touched].ravel(), s]), np.concatenate([self.id[touched].ravel(), i])
        order = np.lexsort((i, ~s, last))  # ~s falls as s rises and can't overflow
        last, s, i = last[order], s[order], i[order]
        head = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        place = np.arange(len(last)) - np.repeat(head, np.diff(np.append(head, len(last))))
        first = place < self.k
        self.score[last[first], place[first]], self.id[last[first], place[first]] = s[first], i[first]


def walk(x: np.ndarray, x_ids: np.ndarray, length: np.ndarray, label: int, centre: np.ndarray, radius: float, targets: Targets, same: bool, d: np.ndarray, d_ids: np.ndarray, d_labels: np.ndarray, chunk: int = CHUNK) -> int:
    """Offer the candidates of a file to the targets of a group, down the shared list; returns scores computed.

    Candidates are those of the group's label (``same``) or of the others.
    """
    fit = np.flatnonzero((d_labels == label) == same)
    if not len(fit):
        return 0
    part = np.asarray(d[fit] if len(fit) < len(d_ids) else d)
    ids = d_ids[fit]
    bound = reach(lengths(part), angles(directions(part), centre), radius)
    order = np.lexsort((ids, -bound))
    bound, done = bound[order], 0
    for start in range(0, len(order), chunk):
        # |member| * bound, with room for rounding; weights are integers
        most = length[targets.member] * bound[start]
        alive = np.flatnonzero(most + np.abs(most) * 1e-9 + 1 >= targets.needed())
        if not len(alive):
            break
        at = order[start : start + chunk]
        members, back = np.unique(targets.member[alive], return_inverse=True)
        scores = _scores(x[members], part[at])
        done += scores.size
        own = x_ids[members][:, None] == ids[at][None, :]
        targets.offer(alive, scores[back], ids[at], ~own[back])
    return done


# ---------------------------------------------------------------- files of candidates, groups of anchors


def weights(table: DataFrame, scale: float, label: Column, id_col: str, vector: str) -> DataFrame:
    """(id, label, v): one row per id that takes part, weights as integers."""
    x = F.col(vector).cast("array<double>")
    fine = F.col(id_col).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.where(fine).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def _read(batches: Iterator[pa.RecordBatch], *columns: str) -> tuple[np.ndarray, ...]:
    """(matrix of v, the columns) of all rows of a task."""
    parts = [(matrix(b.column("v"))[0], *[b.column(c).to_numpy() for c in columns]) for b in batches if b.num_rows]
    width = max((p[0].shape[1] for p in parts), default=0)
    x = np.concatenate([widened(p[0], width) for p in parts]).astype(np.int64) if parts else np.zeros((0, 0), np.int64)
    return (x, *[np.concatenate([p[j + 1] for p in parts]) if parts else np.zeros(0, np.int64) for j in range(len(columns))])


def store_files(rows: DataFrame, folder: str, n: int, width: int, size: int, shards: int) -> DataFrame:
    """(shard, index): the candidates by (label, id) are written, ``size`` rows a file, and the index of each shard of files."""

    def store(batches):
        x, ids, labels = _read(batches, "id", "label")
        for a in range(0, len(x), size):
            part, u = widened(x[a : a + size], width), directions(widened(x[a : a + size], width))
            centre, radius = centre_of(u)
            name = put_arrays(folder, {"x": part, "id": ids[a : a + size], "label": labels[a : a + size]})
            yield pa.RecordBatch.from_pydict({"name": [name], "low": [labels[a]], "high": [labels[min(a + size, len(x)) - 1]], "length": [float(lengths(part).max())], "radius": [radius], "centre": [centre.tolist()]})

    placed = rows.repartitionByRange(max(1, -(-n // size)), "label", "id").sortWithinPartitions("label", "id")
    files = cut(placed.mapInArrow(store, "name string, low long, high long, length double, radius double, centre array<double>"))

    def gather(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        arrays = {c: t.column(c).to_numpy() for c in ("low", "high", "length", "radius")}
        arrays |= {"name": np.array(t.column("name").to_pylist()), "centre": np.array(t.column("centre").to_pylist(), float).reshape(t.num_rows, width)}
        yield pa.RecordBatch.from_pydict({"shard": pa.array([key[0].as_py()], pa.int32()), "index": [put_arrays(folder, arrays)]})

    files = files.withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int"))
    return cut(files.groupBy("shard").applyInArrow(gather, "shard int, index string"))


def centres(anchors: DataFrame, width: int, wanted: int, rounds: int = 3) -> np.ndarray:
    """Directions of at most CENTRES clusters of anchors: seeds by hash of id, then rounds of grouped means.

    They only decide which anchors share a list, so any centres give the same result.
    """
    seeds = anchors.orderBy(F.xxhash64("id"), "id").limit(wanted).select("v").toArrow().column("v")
    c = directions(widened(matrix(seeds)[0], width)) if len(seeds) else np.zeros((0, width))

    for _ in range(rounds):

        def assign(batches, c=c):
            (x,) = _read(batches)
            u = directions(widened(x, width))
            near = (u @ c.T).argmax(1) if len(u) else np.zeros(0, np.int64)
            for j in np.unique(near):
                yield pa.RecordBatch.from_pydict({"c": [int(j)], "s": [u[near == j].sum(0).tolist()]})

        sums = anchors.select("v").mapInArrow(assign, "c long, s array<double>")
        sums = sums.select("c", F.posexplode("s")).groupBy("c", "pos").agg(F.sum("col").alias("s")).collect()  # CENTRES * width numbers
        c = c.copy()
        for r in sums:
            c[r.c, r.pos] = r.s
        c = directions(c)
    return c


def store_groups(anchors: DataFrame, folder: str, n: int, width: int, size: int, wanted: int) -> DataFrame:
    """(g, label): groups of at most ``size`` anchors of one label and cluster, sorted by angle to the cluster's centre."""
    c = centres(anchors, width, wanted)

    def near(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            u = directions(widened(matrix(batch.column("v"))[0], width))
            cosine = u @ c.T
            best = cosine.argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.int64()), pa.array(cosine[np.arange(len(u)), best], pa.float64())], ["id", "label", "v", "c", "cosine"])

    def store(batches):
        x, ids, labels, cluster = _read(batches, "id", "label", "c")
        x = widened(x, width)
        edge = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (cluster[1:] != cluster[:-1])])) if len(x) else []
        for a, b in zip(edge, np.append(edge[1:], len(x))):
            for s in range(a, b, size):
                part = slice(s, min(b, s + size))
                centre, radius = centre_of(directions(x[part]))
                name = put_arrays(folder, {"x": x[part], "id": ids[part], "length": lengths(x[part]), "centre": centre, "radius": np.array([radius])})
                yield pa.RecordBatch.from_pydict({"g": [name], "label": [labels[a]]})

    placed = anchors.mapInArrow(near, "id long, label long, v array<long>, c long, cosine double")
    order = ["label", "c", F.desc("cosine"), "id"]
    placed = cut(placed).repartitionByRange(max(1, -(-n // (8 * size))), *order).sortWithinPartitions(*order)
    return cut(placed.mapInArrow(store, "g string, label long"))


# ---------------------------------------------------------------- mining


def _files_for(folder: str, index: str, label: int, centre: np.ndarray, radius: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(names, bounds) of the files with candidates for a group, by falling bound of score / |member|."""
    low, high, length, far, mid, name = (np.asarray(get_array(folder, index, k)) for k in ("low", "high", "length", "radius", "centre", "name"))
    fit = (low <= label) & (label <= high) if same else (low != label) | (high != label)
    bound = reach(length[fit], angles(mid[fit], centre), radius + far[fit])
    bound = np.where(mid[fit].any(1), bound, length[fit])
    order = np.lexsort((name[fit], -bound))
    return name[fit][order], bound[order]


def _walk_all(work: DataFrame, folder: str, same: bool, targets_of) -> DataFrame:
    """(g, member, anchor_id, target, id, score): what the targets of each group take from each shard."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                g = row["g"]
                x, ids, length, centre = (np.asarray(get_array(folder, g, key)) for key in ("x", "id", "length", "centre"))
                radius = float(get_array(folder, g, "radius")[0])
                targets = targets_of(row, len(x))
                for name, bound in zip(*_files_for(folder, row["index"], row["label"], centre, radius, same)):
                    most = length[targets.member] * bound
                    if not (most + np.abs(most) * 1e-9 + 1 >= targets.needed()).any():
                        break
                    d, d_ids, d_labels = get_array(folder, name, "x"), np.asarray(get_array(folder, name, "id")), np.asarray(get_array(folder, name, "label"))
                    walk(x, ids, length, row["label"], centre, radius, targets, same, d, d_ids, d_labels)
                t, place = np.nonzero(targets.score != LEAST)
                yield pa.RecordBatch.from_pydict({"g": pa.array([g] * len(t), pa.string()), "member": pa.array(targets.member[t], pa.int32()), "anchor_id": pa.array(ids[targets.member[t]], pa.int64()), "target": pa.array(t, pa.int32()), "id": pa.array(targets.id[t, place], pa.int64()), "score": pa.array(targets.score[t, place], pa.int64())})

    return work.mapInArrow(run, "g string, member int, anchor_id long, target int, id long, score long")


def mine(table: DataFrame, label: Column | str = "label", step: int = STEP, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE, id_col: str = "vec_id", vector: str = "embedding", file_rows: int = FILE, group: int = GROUP) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors, the rows whose id is divisible by ``step``."""
    spark = table.sparkSession
    folder = shared_dir(spark)
    rows = cut(weights(table, scale, F.col(label) if isinstance(label, str) else label, id_col, vector))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width"), F.count_if(F.pmod("id", F.lit(step)) == 0).alias("a")).first()
    anchors = rows.where(F.pmod("id", F.lit(step)) == 0)
    groups = store_groups(anchors, folder, size.a, size.width, group, int(min(CENTRES, max(1, size.a // group))))
    n_groups, n_files = groups.count(), -(-size.n // file_rows)
    shards = int(max(1, min(n_files, max(-(-n_files // SHARD), 4 * spark.sparkContext.defaultParallelism // max(1, n_groups)))))
    indexes = store_files(rows, folder, size.n, size.width, file_rows, shards)
    work = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(indexes, "shard")
    tasks = max(1, min(n_groups * shards, 100_000))

    def for_positives(row, n):
        return Targets(np.arange(n), np.full(n, MOST), np.full(n, LEAST), positives)

    best = Window.partitionBy("g", "member").orderBy(F.desc("score"), "id")
    found = _walk_all(work.repartition(tasks, "g", "shard"), folder, True, for_positives)
    found = cut(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives))
    # a group's targets: the positives of its members, as lists of its own rows
    wanted = found.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("member", "rank", "score"))).alias("wanted"))  # positives * group at most
    targets = cut(work.join(wanted, "g"))

    def for_negatives(row, n):
        members = np.array([w["member"] for w in row["wanted"]], np.int64)
        caps = [w["score"] for w in row["wanted"]]
        return Targets(members, np.array([high * s // 100 for s in caps], np.int64), np.array([-(-low * s // 100) for s in caps], np.int64), negatives)

    taken = _walk_all(targets.repartition(tasks, "g", "shard"), folder, False, for_negatives)
    first = Window.partitionBy("g", "target").orderBy(F.desc("score"), "id")
    taken = taken.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    # targets are numbered in the order of (member, rank)
    number = Window.partitionBy("g").orderBy("member", "rank")
    named = found.select("g", (F.row_number().over(number) - 1).alias("target"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = taken.join(named, ["g", "target"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"), label)


OP11_SQL = """
with g as (select vec_id, min({'l': case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end, 'v': list_transform(embedding::double[], lambda x: floor(256 * x))}) r from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 group by vec_id),
v as (select vec_id, r.l l, r.v v from g),
s as (select a.vec_id a, d.vec_id d, a.l = d.l same, list_dot_product(a.v, d.v)::bigint score from v a join v d on a.vec_id <> d.vec_id where a.vec_id % 50 = 0),
p as (select a, d p, score ps from s where same qualify row_number() over (partition by a order by score desc, d) <= 5),
n as (select p.a, p, ps, s.d, s.score, row_number() over (partition by p.a, p order by s.score desc, s.d) r from p join s on s.a = p.a and not s.same and 50 * ps <= 100 * s.score and 100 * s.score <= 95 * ps)
select a anchor_id, p positive_id, r::int rank, d negative_id, ps positive_score, score negative_score from n where r <= 3
"""
