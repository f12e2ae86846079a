"""Shared helpers: scratch tables in the cluster's shared folder and vectorised hashing.

Scratch tables are the only way lineage is cut: they live in the folder named by
``spark.checkpoint.dir`` (set here only where it is unset and Spark runs in this
process, as in tests), so the loss of an executor never loses them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship  # noqa: F401

NO_ID = 2**63 - 1  # stands for a null id: such rows rank after all others (ids lie below it)
U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``; the setting is made only if unset, and never on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="logloom_checkpoint_")
        spark.conf.set("spark.checkpoint.dir", base)
    _made.append(f"{base.rstrip('/')}/loom-{uuid.uuid4().hex}")
    return _made[-1]


_made: list[str] = []  # folders that this driver has named


def finished(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``make`` as a table, and none of the scratch folders that it took to make it."""
    before = len(_made)
    out = cut(make())
    for folder in _made[before:-1]:
        drop_folder(spark, folder)
    del _made[before:-1]
    return out


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_of(col: str = "doc_id"):
    """An integer id with null replaced by NO_ID."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node of the component; only nodes on edges appear.

    Alternating large-star and small-star steps.  Each step is a grouped minimum
    (combined map-side) and a join that adaptive execution may split, so a hub
    node does not meet in one task.  Each round is cut to the shared folder.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = cut(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(small_low, F.col("u") == F.col("k"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            break
        before = state
    leaves = now.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (in place on a uint64 array)."""
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def mixed(x: np.ndarray) -> np.ndarray:
    return mix(x.astype(U64, copy=True))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                for name, b in (("up", self.base), ("down", self.inverse)):
                    steps = np.full(n, b, U64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


class Hasher:
    """Polynomial hashes of runs by prefix sums: of bytes into words, of words into n-grams."""

    def __init__(self, seed: int = 1):
        self.table = mix(np.arange(256, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed * 7919 + 1))
        self.of_bytes = Powers(0x5851F42D4C957F2D + 2 * seed)
        self.of_words = Powers(0xD1342543DE82EF95 + 2 * seed)

    @staticmethod
    def runs(values: np.ndarray, powers: Powers, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = powers.get(len(values) + 1)
        total = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[: len(values)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts])

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.runs(self.table[data], self.of_bytes, starts, ends)

    def windows(self, words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the runs of ``size`` words that begin at the positions ``at``."""
        return self.runs(words, self.of_words, at, at + size)


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some texts: byte spans, and each text's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = data = _LOWER[data] if lower else data
        inside = ~_SPACE[data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        heads = offsets[:-1]
        before[heads[heads < len(data)]] = False
        tails = offsets[1:] - 1
        after[tails[tails >= 0]] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offsets)  # text i has words bounds[i]:bounds[i + 1]
        self.counts = np.diff(self.bounds)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions where a window of ``size`` words of one text begins, and that text."""
        n = np.maximum(self.counts - size + 1, 0)
        return ragged(self.bounds[:-1], n), np.repeat(np.arange(len(n)), n)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its length, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes each; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_slices(column: pa.Array, lower: bool = False, limit: int = 1 << 20) -> Iterator[tuple[int, int, Words]]:
    """(first text, end, its Words) for slices of a string column."""
    data, offsets = text_buffers(column)
    for i, j in slices(offsets, limit):
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)


# ---------------------------------------------------------------- files that all workers see


def local_path(uri: str) -> str | None:
    """The local path of a ``file:`` URI or plain path; None for other stores."""
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def put_arrays(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Write arrays, each as one .npy file, under a new unique name; returns that name.

    Every attempt of a task writes under its own name and only names that reach
    the driver's manifest are read, so retries and lost executors do no harm.
    """
    import os

    name = uuid.uuid4().hex
    local = local_path(folder)
    for key, value in arrays.items():
        if local is not None:
            os.makedirs(local, exist_ok=True)
            np.save(f"{local}/{name}.{key}.npy", value)
        else:
            import io

            from pyarrow import fs

            store, at = fs.FileSystem.from_uri(folder)
            store.create_dir(at, recursive=True)
            np.save(buffer := io.BytesIO(), value)
            with store.open_output_stream(f"{at}/{name}.{key}.npy") as out:
                out.write(buffer.getvalue())
    return name


def get_array(folder: str, name: str, key: str) -> np.ndarray:
    """Memory-map an array of ``put_arrays`` (read it whole where the store can't be mapped)."""
    local = local_path(folder)
    if local is not None:
        return np.load(f"{local}/{name}.{key}.npy", mmap_mode="r")
    import io

    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{at}/{name}.{key}.npy") as f:
        return np.load(io.BytesIO(f.read()))


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of ``shared_dir`` whose files nothing needs any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
