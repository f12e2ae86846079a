"""Geo and network files in the MaxMind DB format: longest-prefix match in a memory-mapped binary trie.

The file is given to the workers by Spark (``addFile``); each worker process maps it
once.  Only distinct addresses are looked up, a batch of them going down the trie
together, one gather per bit; the record of a prefix is decoded once per worker.

Defined cases: what is no IPv4 or IPv6 address, and an address that no prefix holds,
has nulls; an IPv6 address has nulls in a file of IPv4 only; a field that a record
lacks is null; a file that is not of the format raises.
"""

from __future__ import annotations

import os
import socket
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import give_file, ship

# The mark before the metadata, and where in a record country and network name stand.
MARK = b"\xab\xcd\xefMaxMind.com"
COUNTRY, NETWORK = ("country", "iso_code"), ("autonomous_system_organization",)
_PLAIN = {5: 2, 6: 4, 8: 4, 9: 8, 10: 16}  # integer types and their greatest sizes


class Trie:
    """A mapped file."""

    def __init__(self, path: str):
        self.data = np.memmap(path, np.uint8, "r")
        tail = max(0, len(self.data) - (128 << 10))
        at = bytes(self.data[tail:]).rfind(MARK)
        if at < 0:
            raise ValueError(f"{path} has no metadata of the format")
        self.base = tail + at + len(MARK)  # pointers count from here while the metadata is read
        self.about, _ = self._value(self.base)
        self.nodes, self.bits, self.version = (int(self.about[k]) for k in ("node_count", "record_size", "ip_version"))
        if self.bits not in (24, 28, 32):
            raise ValueError(f"{path} has records of {self.bits} bits")
        self.width = self.bits // 4
        self.tree = self.data[: self.nodes * self.width].reshape(self.nodes, self.width)
        self.base = self.nodes * self.width + 16
        self.v4 = np.zeros(1, np.int64)
        if self.version == 6:
            for _ in range(96):
                self.v4 = np.where(self.v4 < self.nodes, self._child(np.minimum(self.v4, self.nodes - 1), np.zeros(1, np.int64)), self.v4)

    def _child(self, node: np.ndarray, bit: np.ndarray) -> np.ndarray:
        rows = self.tree[node].astype(np.int64)
        if self.bits == 28:
            left = ((rows[:, 3] >> 4) << 24) | (rows[:, 0] << 16) | (rows[:, 1] << 8) | rows[:, 2]
            right = ((rows[:, 3] & 15) << 24) | (rows[:, 4] << 16) | (rows[:, 5] << 8) | rows[:, 6]
            return np.where(bit == 1, right, left)
        half = self.width // 2
        out = np.zeros(len(node), np.int64)
        for j in range(half):
            out = (out << 8) | np.where(bit == 1, rows[:, half + j], rows[:, j])
        return out

    def find(self, packed: list[bytes | None]) -> np.ndarray:
        """Places of the records in the file of packed addresses (4 or 16 bytes; None: no address), 0 where there is none."""
        out = np.zeros(len(packed), np.int64)
        for size in (4, 16):
            rows = np.array([i for i, p in enumerate(packed) if p is not None and len(p) == size], np.int64)
            if not len(rows) or (size == 16 and self.version == 4):
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(packed[i] for i in rows), np.uint8).reshape(-1, size), axis=1)
            node = np.full(len(rows), self.v4[0] if size == 4 else 0)
            for depth in range(8 * size):
                inner = np.flatnonzero(node < self.nodes)
                if not len(inner):
                    break
                node[inner] = self._child(node[inner], bits[inner, depth].astype(np.int64))
            out[rows] = np.where(node > self.nodes, node - self.nodes - 16 + self.base, 0)
        return out

    @lru_cache(maxsize=1 << 16)
    def record(self, at: int):
        return self._value(at)[0]

    def _value(self, at: int):
        """(value, place after it)."""
        control = int(self.data[at])
        kind, at = control >> 5, at + 1
        if kind == 1:
            n, low = (control >> 3) & 3, control & 7
            raw = int.from_bytes(bytes(self.data[at : at + n + 1]), "big")
            target = raw if n == 3 else (low << (8 * (n + 1))) + raw + (0, 2048, 526336)[n]
            return self._value(self.base + target)[0], at + n + 1
        if kind == 0:
            kind, at = int(self.data[at]) + 7, at + 1
        size = control & 31
        if size > 28:
            n = size - 28
            size, at = int.from_bytes(bytes(self.data[at : at + n]), "big") + (29, 285, 65821)[n - 1], at + n
        if kind == 7:
            out = {}
            for _ in range(size):
                key, at = self._value(at)
                out[key], at = self._value(at)
            return out, at
        if kind == 11:
            items = []
            for _ in range(size):
                item, at = self._value(at)
                items.append(item)
            return items, at
        if kind == 14:
            return bool(size), at
        raw, at = bytes(self.data[at : at + size]), at + size
        if kind == 2:
            return raw.decode(), at
        if kind == 3:
            return struct.unpack(">d", raw)[0], at
        if kind == 15:
            return struct.unpack(">f", raw)[0], at
        return (int.from_bytes(raw.rjust(4, b"\0"), "big", signed=True) if kind == 8 else int.from_bytes(raw, "big") if kind in _PLAIN else raw), at


@lru_cache(maxsize=8)
def _mapped(path: str, stamp: int) -> Trie:
    return Trie(path)


def packed(ip: str | None) -> bytes | None:
    for family in (socket.AF_INET, socket.AF_INET6):
        try:
            return socket.inet_pton(family, ip or "")
        except (OSError, ValueError):
            continue
    return None


def lookup(addresses: DataFrame, path: str, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """(ip and ``fields``) for each distinct address of ``addresses`` (ip); a field is a way into the record."""
    spark = addresses.sparkSession
    ship(spark)
    name = give_file(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = SparkFiles.get(name)
        trie = _mapped(local, os.stat(local).st_mtime_ns)
        for batch in batches:
            ips = batch.column("ip").to_pylist()
            found = [trie.record(int(p)) if p else None for p in trie.find([packed(ip) for ip in ips])]
            out = {"ip": pa.array(ips, pa.string())}
            for column, way in fields.items():
                values = []
                for value in found:
                    for key in way:
                        value = value.get(key) if isinstance(value, dict) else None
                    values.append(None if value is None else str(value))
                out[column] = pa.array(values, pa.string())
            yield pa.RecordBatch.from_pydict(out)

    distinct = addresses.select(F.col("ip").cast("string").alias("ip")).where(F.col("ip").isNotNull()).distinct()
    return distinct.mapInArrow(run, "ip string" + "".join(f", `{c}` string" for c in fields))


def located(logs: DataFrame, path: str, fields: dict[str, tuple[str, ...]], ip: str = "source_ip") -> DataFrame:
    """(row_id and ``fields``) for each row of ``logs`` by its address."""
    rows = logs.select("row_id", F.col(ip).alias("ip"))
    return rows.join(lookup(rows, path, fields), "ip", "left").drop("ip")
