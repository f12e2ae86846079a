"""Merkle manifest of a dataset, with a witness for every row, by incremental witnesses.

A leaf is the hash of a row's fields.  Per group (language) the leaves ascend by
id and every FANOUT consecutive nodes have the hash of their digests as parent;
the groups' roots are the leaves of one more tree, whose root stands for the data.

``Appender`` takes digests one by one, in order.  It holds one open subtree per
level; a leaf's witness is partial until the runs above it are complete, and each
completed run extends the witnesses of all leaves below it by one level.  These
extensions are shared: a block keeps its nodes level by level, and the witness of
a leaf is read off them.

On a cluster the leaves of a group are numbered by range partitions and counts per
partition, and cut into aligned blocks of FANOUT ** BLOCK_LEVELS.  Each block is
appended in a task of its own, so a group of a third of all rows is as many tasks
as it has blocks; block roots are then appended in the same way, as are the
groups' roots, and the witnesses of blocks are extended down the levels.  No task
holds more than a block, and the driver only counts.

``append`` adds rows whose ids come after those of their group: only the open last
block of each group is opened again; complete blocks stay as they are and merely
have their witnesses extended.

Defined cases: a null field is ``-`` in the leaf and an empty one ``0:``; a null
group comes first; a null id comes after all ids; rows of one id are ordered by
leaf, and equal rows each are a leaf; a group of one row has its leaf as root;
very long texts are hashed whole; an empty table gives an empty table; columns
other than the fields are not read and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

FANOUT, BLOCK_LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A block: nodes of level 0, then of level 1 and so on; ``levels`` are their counts; ids, tampered leaves and positions of its leaves.
BLOCK = "k string, block long, first long, n long, total long, levels array<int>, nodes binary"


def H(*digests: str) -> str:
    """Lower-case hex SHA-256 of the digests' hex texts, one after another."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def height(n: int, fanout: int = FANOUT) -> int:
    """Levels above the leaves of a tree of n leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // fanout), h + 1
    return h


class Appender:
    """A tree that grows leaf by leaf; ``nodes[level]`` are the digests made so far."""

    def __init__(self, levels: int, fanout: int = FANOUT):
        self.fanout, self.nodes = fanout, [[] for _ in range(levels + 1)]

    def append(self, digest: str) -> None:
        level = 0
        self.nodes[0].append(digest)
        while level < len(self.nodes) - 1 and len(self.nodes[level]) % self.fanout == 0:
            self._complete(level)
            level += 1

    def _complete(self, level: int) -> None:
        """The last run of the level gets its parent: each node's siblings extend the witnesses below it."""
        done = len(self.nodes[level + 1]) * self.fanout
        self.nodes[level + 1].append(H(*self.nodes[level][done:]))

    def close(self) -> None:
        """Complete the runs that are still open, from below."""
        for level in range(len(self.nodes) - 1):
            if len(self.nodes[level]) > len(self.nodes[level + 1]) * self.fanout:
                self._complete(level)

    def witness(self, i: int) -> list[tuple[str, str]]:
        """(digests before, digests after) of the i-th leaf's siblings, level by level."""
        return witness(self.nodes, i, self.fanout)


def witness(nodes: Sequence[Sequence[str]], i: int, fanout: int = FANOUT) -> list[tuple[str, str]]:
    out = []
    for level in nodes[:-1]:
        start = i - i % fanout
        out.append(("".join(level[start:i]), "".join(level[i + 1 : start + fanout])))
        i //= fanout
    return out


def fold(leaf: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that a leaf and a witness give."""
    for before, after in path:
        leaf = hashlib.sha256((before + leaf + after).encode()).hexdigest()
    return leaf


def proof_digest(path: Sequence[tuple[str, str]]) -> str:
    h = hashlib.sha256()
    for before, after in path:
        h.update((before + after).encode())
    return h.hexdigest()


# ---------------------------------------------------------------- leaves in order


def leaf_of(fields: Sequence[Column]) -> Column:
    """Hash of the fields: ``-`` for null, else byte count, ``:`` and value."""
    parts = []
    for f in fields:
        f = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group: str = "lang", text: str = "text", tampered: Column | None = None) -> DataFrame:
    """(k, id, leaf, changed): the group as a key that sorts (null first), and the leaf of the row
    with A-Z lower-cased in ``text`` where ``tampered`` holds (else null)."""
    k = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    own = leaf_of([F.col(f) for f in fields])
    other = leaf_of([F.translate(f, _UP, _LOW) if f == text else F.col(f) for f in fields])
    tampered = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    return docs.select(k.alias("k"), F.col(id_col).cast("long").alias("id"), own.alias("leaf"), F.when(tampered, other).alias("changed"))


def numbered(rows: DataFrame, order: Sequence[Column], start: DataFrame | None = None) -> DataFrame:
    """``rows`` (with k, kept in the shared folder) with ``i``: the place within k, from 0, in the order given.

    Rows are range-partitioned by k and order, numbered in their partition, and the
    counts per (k, partition) before are added: one such row per partition and key.
    ``start``: (k, start), places taken already.
    """
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())  # of a written table: the same at each attempt
    keys = [F.col("k"), *order, F.col("_tie")]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    schema = placed.schema

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for batch in batches:
            k = batch.column("k")
            if not batch.num_rows:
                continue
            codes = k.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            head = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            place = np.arange(batch.num_rows) - np.repeat(head, np.diff(np.append(head, batch.num_rows)))
            if k[0].as_py() == last:
                place[: head[1] if len(head) > 1 else len(place)] += at
            last, at = k[-1].as_py(), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], [*batch.schema.names, "_n"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", _n long"
    placed = cut(placed.mapInArrow(number, fields))
    counts = placed.groupBy("k", "part").agg(F.count("*").alias("c"))
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("k", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    if start is not None:
        counts = counts.join(start, "k", "left").withColumn("before", F.col("before") + F.coalesce("start", F.lit(0))).drop("start")
    return placed.join(counts, ["k", "part"]).withColumn("i", F.col("before") + F.col("_n")).drop("part", "_n", "_tie", "before")


# ---------------------------------------------------------------- blocks and the tree over them


def _blocks(rows: DataFrame, totals: DataFrame, carry: Sequence[str], fanout: int, levels: int) -> DataFrame:
    """One row per aligned block of ``rows`` (k, i, digest and ``carry``): its nodes, level by level, and lists of ``carry``."""
    size = fanout**levels
    types = dict(rows.dtypes)
    schema = BLOCK + "".join(f", `{c}` array<{types[c]}>" for c in carry)

    def append(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("i")
        total, first = table.column("total")[0].as_py(), table.column("i")[0].as_py()
        tree = Appender(min(levels, height(total, fanout)), fanout)
        for digest in table.column("digest").to_pylist():
            tree.append(digest)
        tree.close()
        out = {"k": [key[0].as_py()], "block": pa.array([first // size], pa.int64()), "first": pa.array([first], pa.int64()), "n": pa.array([table.num_rows], pa.int64()), "total": pa.array([total], pa.int64())}
        out |= {"levels": pa.array([[len(x) for x in tree.nodes]], pa.list_(pa.int32())), "nodes": [bytes.fromhex("".join("".join(x) for x in tree.nodes))]}
        for c in carry:
            values = table.column(c).combine_chunks()
            out[c] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        yield pa.RecordBatch.from_pydict(out)

    tasks = min(100_000, rows.count() // (4 * size) + 1)
    parts = rows.join(totals, "k").withColumn("_b", F.floor(F.col("i") / size)).repartition(tasks, "k", "_b")
    return parts.groupBy("k", "_b").applyInArrow(append, schema)


def _hex(nodes: bytes, levels: Sequence[int]) -> list[list[str]]:
    text, out, at = nodes.hex(), [], 0
    for n in levels:
        out.append([text[64 * j : 64 * (j + 1)] for j in range(at, at + n)])
        at += n
    return out


PATH = "array<struct<before: string, after: string>>"
_PATH = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def _roots(blocks: DataFrame) -> DataFrame:
    """(k, i, digest): the last node of each block is a leaf of the tree above."""
    root = F.lower(F.hex(F.expr("substring(nodes, length(nodes) - 31, 32)")))
    return blocks.select("k", F.col("block").alias("i"), root.alias("digest"))


def _over(blocks: DataFrame, fanout: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """((k, block, path): the witness of each block up to its group's root; (k, digest): the groups' roots).

    Block roots are appended like leaves, level of blocks by level of blocks, until each group has one.
    """
    size = fanout**levels
    above = _roots(blocks)
    most = blocks.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0] + 1
    stages = []
    while most > 1:
        totals = above.groupBy("k").agg((F.max("i") + 1).alias("total"))
        stage = cut(_blocks(above, totals, ["i"], fanout, levels))
        stages.append(stage)
        above, most = _roots(stage), -(-most // size)
    path = above.select("k", F.col("i").alias("block"), F.expr(f"cast(array() as {PATH})").alias("path"))
    for stage in reversed(stages):
        path = cut(_extended(stage, path, fanout))
    return path, above.select("k", "digest")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one: a block has some hundred thousand bytes."""
    for batch in batches:
        for j in range(batch.num_rows):
            yield batch.slice(j, 1).to_pylist()[0]


def _extended(stage: DataFrame, path: DataFrame, fanout: int) -> DataFrame:
    """(k, block, path) for each leaf of a stage: its witness in its block, extended by that block's own."""

    def expand(batches):
        for row in _each(batches):
            tree = _hex(row["nodes"], row["levels"])
            paths = [[{"before": b, "after": a} for b, a in witness(tree, j, fanout)] + row["path"] for j in range(row["n"])]
            places = np.arange(row["n"]) + row["first"]
            yield pa.RecordBatch.from_pydict({"k": [row["k"]] * len(paths), "block": pa.array(places, pa.int64()), "path": pa.array(paths, _PATH)})

    return stage.join(path, ["k", "block"]).select("k", "first", "n", "levels", "nodes", "path").mapInArrow(expand, f"k string, block long, path {PATH}")


class Manifest:
    """Blocks of leaves (a table in the shared folder) and the trees over them; ``root`` is None without rows."""

    def __init__(self, blocks: DataFrame, fanout: int = FANOUT, levels: int = BLOCK_LEVELS):
        self.blocks, self.fanout, self.levels = blocks, fanout, levels
        path, roots = _over(blocks, fanout, levels)
        # the groups' roots, ordered by group, are the leaves of one more tree, under the key ''
        groups = cut(roots.select(F.lit("").alias("k"), F.col("k").alias("g"), "digest"))
        groups = cut(numbered(groups, [F.col("g")]))
        top = cut(_blocks(groups, groups.groupBy("k").agg(F.count("*").alias("total")), ["g"], fanout, levels))
        top_path, root = _over(top, fanout, levels)
        first = root.first()
        self.root = first and first.digest
        above = _extended(top, top_path, fanout).select(F.col("block").alias("i"), F.col("path").alias("above"))
        self.groups = groups.join(above, "i").select(F.col("g").alias("k"), F.col("digest").alias("subroot"), "above")
        self.paths = cut(path.join(self.groups, "k").select("k", "block", F.concat("path", "above").alias("path"), "subroot"))

    def witnesses(self, full: bool = False) -> DataFrame:
        """One row per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and (``full``) the witness.

        ``folded_root`` folds the tampered leaf, where there is one, over the original siblings.
        """
        fanout, root = self.fanout, self.root
        schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + (f", witness {PATH}" if full else "")

        def expand(batches):
            for row in _each(batches):
                tree, rest = _hex(row["nodes"], row["levels"]), [(p["before"], p["after"]) for p in row["path"]]
                paths = [witness(tree, j, fanout) + rest for j in range(row["n"])]
                out = {"doc_id": pa.array(row["id"], pa.int64()), "leaf": tree[0], "subroot": [row["subroot"]] * row["n"], "root": [root] * row["n"]}
                out["proof_sha256"] = [proof_digest(p) for p in paths]
                out["folded_root"] = [fold(changed or leaf, p) for changed, leaf, p in zip(row["changed"], tree[0], paths)]
                if full:
                    out["witness"] = pa.array([[{"before": b, "after": a} for b, a in p] for p in paths], _PATH)
                yield pa.RecordBatch.from_pydict(out)

        rows = self.blocks.join(self.paths, ["k", "block"]).select("n", "levels", "nodes", "id", "changed", "path", "subroot")
        tasks = min(100_000, self.blocks.count() // 4 + 1)
        return rows.repartition(tasks).mapInArrow(expand, schema).withColumn("verified", F.col("folded_root") == F.col("root"))

    def append(self, rows: DataFrame) -> Manifest:
        """The manifest with ``rows`` (of ``leaves``) added, whose ids come after all of their group's.

        Complete blocks are taken as they are; of each group only the open last block is
        appended to, and blocks of groups without new rows are not touched.
        """
        size = self.fanout**self.levels
        rows = cut(rows)
        had = self.blocks.groupBy("k").agg(F.sum("n").alias("had"))
        more = rows.groupBy("k").agg(F.count("*").alias("more")).join(had, "k", "left").select("k", F.coalesce("had", F.lit(0)).alias("had"), "more")
        more = cut(more.withColumn("now", F.col("had") + F.col("more")))
        old = self.blocks.join(more, "k", "left")
        stays = F.col("now").isNull() | (F.col("n") == size)
        kept = old.where(stays).withColumn("total", F.coalesce("now", "total")).select(*self.blocks.columns)
        places = F.arrays_zip(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")).alias("p"), "id", "changed")
        opened = old.where(~stays).select("k", "first", "nodes", F.explode(places).alias("x"))
        digest = F.lower(F.hex(F.expr("substring(nodes, 32 * x.p + 1, 32)")))
        opened = opened.select("k", (F.col("first") + F.col("x.p")).alias("i"), "x.id", digest.alias("digest"), "x.changed")
        new = numbered(rows, _order(), more.select("k", F.col("had").alias("start"))).select("k", "i", "id", F.col("leaf").alias("digest"), "changed")
        both = cut(opened.unionByName(new))
        made = _blocks(both, more.select("k", F.col("now").alias("total")), ["id", "changed"], self.fanout, self.levels)
        return Manifest(cut(kept.unionByName(made)), self.fanout, self.levels)


def _order() -> list[Column]:
    """Order of the leaves of a group."""
    return [F.col("id").isNull(), F.col("id"), F.col("leaf")]


def manifest(rows: DataFrame, fanout: int = FANOUT, levels: int = BLOCK_LEVELS) -> Manifest:
    """The manifest of ``rows`` (of ``leaves``)."""
    rows = cut(numbered(cut(rows), _order()).select("k", "i", "id", F.col("leaf").alias("digest"), "changed"))
    totals = rows.groupBy("k").agg(F.count("*").alias("total"))
    return Manifest(cut(_blocks(rows, totals, ["id", "changed"], fanout, levels)), fanout, levels)


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(leaves(docs, tampered=tampered)).witnesses()


OP13_SQL = r"""
with recursive tab as (
  select list(c order by i) tab from (select i, list_reduce([i::ubigint] || list_transform(range(8), lambda z: 0::ubigint), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) c from range(256) r(i))),
src as (select *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') low,
  xor(list_reduce([4294967295::ubigint] || list_transform(string_split(doc_id::varchar, ''), lambda s: ascii(s)::ubigint), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::int + 1])), 4294967295::ubigint) % 3 = 0 hit
  from documents, tab),
head as (select *, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') h from src),
leaf as (select doc_id, coalesce('+' || lang, '') k, sha256(h || coalesce(strlen(text) || ':' || text, '-')) leaf, case when hit then sha256(h || coalesce(strlen(low) || ':' || low, '-')) end changed from head),
own as (select *, row_number() over (order by k, doc_id nulls last, leaf) rid, row_number() over (partition by k order by doc_id nulls last, leaf) - 1 i, count(*) over (partition by k) n from leaf),
tree(k, lv, i, d, n) as (
  select k, 0, i, leaf, n from own
  union all
  select k, lv + 1, i // 8, sha256(string_agg(d, '' order by i)), (n + 7) // 8 from tree where n > 1 group by k, lv, i // 8, n),
subs as (select k, d, row_number() over (order by k) - 1 i, count(*) over () n from tree where n = 1),
top(lv, i, d, n) as (
  select 0, i, d, n from subs
  union all
  select lv + 1, i // 8, sha256(string_agg(d, '' order by i)), (n + 7) // 8 from top where n > 1 group by lv, i // 8, n),
nodes as (select k, lv, i, d from tree where n > 1 union all select null, lv, i, d from top where n > 1),
levels as (select k, lv, lv s from tree where n > 1 group by all),
deep as (select k, count(*) m from levels group by k),
steps as (
  select rid, s, o.k, lv, o.i >> (3 * lv) p from own o join levels using (k)
  union all
  select rid, coalesce(m, 0) + lv, null, lv, b.i >> (3 * lv) from own o join subs b using (k) left join deep using (k) cross join (select distinct lv from top where n > 1)),
sides as (
  select rid, s, coalesce(string_agg(d, '' order by n.i) filter (where n.i < p), '') l, coalesce(string_agg(d, '' order by n.i) filter (where n.i > p), '') r
  from steps t join nodes n on t.k is not distinct from n.k and t.lv = n.lv and t.p >> 3 = n.i >> 3 group by rid, s),
walk(rid, s, d) as (
  select rid, 0::bigint, coalesce(changed, leaf) from own
  union all
  select rid, w.s + 1, sha256(l || d || r) from walk w join sides using (rid, s)),
ends as (select rid, arg_max(d, s) folded from walk group by rid),
proofs as (select rid, string_agg(l || r, '' order by s) proof from sides group by rid)
select doc_id, leaf, b.d subroot, t.d root, sha256(coalesce(proof, '')) proof_sha256, folded folded_root, folded = t.d verified
from own join subs b using (k) join ends using (rid) left join proofs using (rid) cross join (select d from top where n = 1) t
"""
