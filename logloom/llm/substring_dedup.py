"""Substring dedup with a count-min prefilter.

A window is a run of SIZE consecutive words of one document.  A word goes if it
is covered by a window whose word sequence also starts in a document with a
smaller doc_id.

First pass: each task counts its windows into sparse count-min rows, cut into
tiles; tiles of the same place are merged (counts saturate at 2) and become
bitmaps of cells that hold two or more, in the shared folder.  The sketch never
counts too low, so every repeated window is in such a cell of each row.  Second
pass: only windows estimated repeated go on, as 96-bit hashes, once per chunk of
documents with the chunk's smallest doc_id; they are grouped exactly, and each
chunk learns, with one bit per window, whether a smaller doc_id lies elsewhere.
A window in a third of all documents is thus one row per chunk, not one per
document.  The spans are taken out of the texts by array functions.

The sketch has CELLS cells per window up to MAX_BITS; beyond that it passes more
windows on and still loses none.

Defined cases: a null text has no words; with fewer than SIZE words nothing goes;
a null doc_id ranks after all ids and null ids don't remove from each other; rows
of one doc_id don't remove from each other; exact repeats of a row get one
result each; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Hasher, cut, drop_folder, get_array, id_of, put_arrays, shared_dir, word_slices
from .lm_scoring import pack, unpack

SIZE = 13
CELLS, MAX_BITS, TILE_BITS = 4, 34, 22
CHUNK = 3_000_000  #: windows that a task holds at a time
ROWS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers, one per row of the sketch


def _pack(sorted_values: np.ndarray) -> bytes:
    """Sorted integers below 2**32 as compressed byte planes of their differences."""
    d = np.diff(sorted_values, prepend=0).astype("<u4")
    return pa.compress(d.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((h * U64(ROWS[row])) >> U64(64 - bits)).astype(np.int64)


class _Chunk:
    """Windows of some documents, by hash."""

    def __init__(self):
        self.h, self.h2, self.doc, self.pos, self.ids, self.keys, self.n = [], [], [], [], [], [], 0
        self.docs = 0

    def add(self, w, ids, keys, one: Hasher, two: Hasher | None, size: int) -> None:
        at, doc = w.windows(size)
        if len(at):
            self.h.append(one.windows(one.words(w.data, w.starts, w.ends), at, size))
            if two is not None:
                self.h2.append((two.windows(two.words(w.data, w.starts, w.ends), at, size) >> U64(32)).astype(np.uint32))
            self.doc.append((doc + self.docs).astype(np.int32))
            self.pos.append((at - w.bounds[:-1][doc]).astype(np.int32))
            self.n += len(at)
        self.ids.append(ids), self.keys.append(keys)
        self.docs += len(ids)


def _chunks(batches: Iterator[pa.RecordBatch], size: int, twice: bool) -> Iterator[_Chunk]:
    one, two, now = Hasher(1), Hasher(2) if twice else None, _Chunk()
    for batch in batches:
        ids, keys = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_id", "_h"))
        for i, j, w in word_slices(batch.column("text")):
            now.add(w, ids[i:j], keys[i:j], one, two, size)
            if now.n >= CHUNK:
                yield now
                now = _Chunk()
    if now.n:
        yield now


def sketch(docs: DataFrame, bits: int, folder: str, size: int) -> dict[tuple[int, int], str]:
    """(row, tile) -> name of the bitmap of the tile's cells that hold two windows or more."""
    tile = min(bits, TILE_BITS)

    def count(batches):
        for chunk in _chunks(batches, size, False):
            h = np.concatenate(chunk.h)
            for row in range(len(ROWS)):
                cells = np.sort(_cells(h, row, bits))
                first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
                two = np.diff(np.append(first, len(cells))) > 1
                cells = cells[first]
                edges = np.flatnonzero(np.concatenate([[True], (cells[1:] >> tile) != (cells[:-1] >> tile)]))
                out = {k: [] for k in ("row", "tile", "n", "cells", "two")}
                for a, b in zip(edges, np.append(edges[1:], len(cells))):
                    out["row"].append(row), out["tile"].append(int(cells[a] >> tile)), out["n"].append(int(b - a))
                    out["cells"].append(_pack(cells[a:b] & ((1 << tile) - 1)))
                    out["two"].append(pa.compress(np.packbits(two[a:b]).tobytes(), codec="zstd", asbytes=True))
                yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))})

    def merge(key: tuple[pa.Scalar, ...], blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << tile, np.uint8)
        for batch in blocks:
            for n, cells, two in zip(*[batch.column(c).to_pylist() for c in ("n", "cells", "two")]):
                at = _unpack(cells, n)
                more = np.unpackbits(np.frombuffer(pa.decompress(two, decompressed_size=(n + 7) // 8, codec="zstd", asbytes=True), np.uint8), count=n)
                total[at] = np.minimum(2, total[at] + 1 + more)
        name = put_arrays(folder, {"bits": np.packbits(total >= 2)})
        yield pa.RecordBatch.from_pydict({"row": pa.array([key[0].as_py()], pa.int32()), "tile": [key[1].as_py()], "name": [name]})

    parts = docs.mapInArrow(count, "row int, tile long, n long, cells binary, two binary")
    merged = parts.groupBy("row", "tile").applyInArrow(merge, "row int, tile long, name string")
    return {(r.row, r.tile): r.name for r in merged.collect()}  # 2 * 2**(bits - 22) names at most


def repeated_spans(docs: DataFrame, size: int = SIZE, cells: int = CELLS, max_bits: int = MAX_BITS) -> DataFrame:
    """(_id, _h, spans): begin and end, in words, of what goes of the documents that lose any."""
    spark = docs.sparkSession
    base = docs.select(id_of().alias("_id"), F.xxhash64("text").alias("_h"), "text")
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    guess = max(1, chars // 6)  # words, about
    bits = int(min(max_bits, max(12, np.ceil(np.log2(cells * guess)))))
    tile = min(bits, TILE_BITS)
    folder = shared_dir(spark)
    names = sketch(base, bits, folder, size)
    parts = int(max(8, guess >> 21))

    def estimated(h: np.ndarray) -> np.ndarray:
        """Positions of windows whose cell holds two or more in each row, tile by tile."""
        left = np.arange(len(h))
        for row in range(len(ROWS)):
            c = _cells(h[left], row, bits)
            order = np.argsort(c)
            c = c[order]
            keep = np.zeros(len(c), bool)
            edges = np.flatnonzero(np.concatenate([[True], (c[1:] >> tile) != (c[:-1] >> tile)])) if len(c) else []
            for a, b in zip(edges, np.append(edges[1:], len(c))):
                name = names.get((row, int(c[a] >> tile)))
                if name:
                    at = c[a:b] & ((1 << tile) - 1)
                    keep[a:b] = (get_array(folder, name, "bits")[at >> 3] >> (7 - (at & 7))) & 1
            left = np.sort(left[order[keep]])
        return left

    def candidates(batches):
        for chunk in _chunks(batches, size, True):
            h = np.concatenate(chunk.h)
            at = estimated(h)
            if not len(at):
                continue
            ids, keys = np.concatenate(chunk.ids), np.concatenate(chunk.keys)
            h, h2 = h[at], np.concatenate(chunk.h2)[at]
            doc, pos = np.concatenate(chunk.doc)[at], np.concatenate(chunk.pos)[at]
            order = np.lexsort((ids[doc], h2, h))
            h, h2, doc, pos = h[order], h2[order], doc[order], pos[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])])
            first = np.flatnonzero(new)
            low = ids[doc[first]]  # of equal windows the smallest id comes first
            name = put_arrays(folder, {"doc": doc, "pos": pos, "new": np.packbits(new), "ids": ids, "keys": keys})
            # sorted by h, so each part is one run
            part = ((h[first] >> U64(32)) * U64(parts)) >> U64(32)
            edges = np.searchsorted(part, np.arange(parts + 1, dtype=U64))
            for p in np.flatnonzero(np.diff(edges)):
                a, b = edges[p], edges[p + 1]
                yield pa.RecordBatch.from_pydict({"p": pa.array([p], pa.int32()), "name": [name], "at": pa.array([a], pa.int64()), "n": pa.array([b - a], pa.int64()), "h": [pack(h[first[a:b]], True)], "h2": [h2[first[a:b]].tobytes()], "low": [pack(low[a:b], False)]})

    def group(key: tuple[pa.Scalar, ...], blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [(r["name"], r["at"], unpack(r["h"], r["n"], True), np.frombuffer(r["h2"], np.uint32), unpack(r["low"], r["n"], False).astype(np.int64)) for b in blocks for r in b.to_pylist()]
        h, h2, low = (np.concatenate([b[k] for b in blocks]) for k in (2, 3, 4))
        order = np.lexsort((low, h2, h))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])])
        least = low[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        smaller = np.empty(len(h), bool)
        smaller[order] = least < low[order]
        start = 0
        for name, at, own, _, _ in blocks:
            bits_ = smaller[start : start + len(own)]
            start += len(own)
            yield pa.RecordBatch.from_pydict({"name": [name], "at": pa.array([at], pa.int64()), "n": pa.array([len(own)], pa.int64()), "bits": [np.packbits(bits_).tobytes()]})

    def spans(key: tuple[pa.Scalar, ...], replies: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = key[0].as_py()
        doc, pos, ids, keys = (np.array(get_array(folder, name, k)) for k in ("doc", "pos", "ids", "keys"))
        new = np.unpackbits(get_array(folder, name, "new"), count=len(doc)).astype(bool)
        grp, low = np.cumsum(new) - 1, ids[doc[new]]
        elsewhere = np.zeros(len(low), bool)
        for batch in replies:
            for at, n, raw in zip(*[batch.column(c).to_pylist() for c in ("at", "n", "bits")]):
                elsewhere[at : at + n] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n)
        goes = elsewhere[grp] | (ids[doc] > low[grp])
        doc, pos = doc[goes], pos[goes]
        if not len(doc):
            return
        order = np.lexsort((pos, doc))
        doc, pos = doc[order].astype(np.int64), pos[order].astype(np.int64)
        # a span begins where the window before, in the same document, ends earlier
        begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + size)]))
        last = np.append(begin[1:], len(doc)) - 1
        d, pairs = doc[begin], np.stack([pos[begin], pos[last] + size], axis=1)
        heads = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        offsets = np.append(heads, len(d)) * 2
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pairs.ravel(), pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(ids[d[heads]]), pa.array(keys[d[heads]]), lists], ["_id", "_h", "spans"])

    found = base.mapInArrow(candidates, "p int, name string, at long, n long, h binary, h2 binary, low binary")
    replies = found.groupBy("p").applyInArrow(group, "name string, at long, n long, bits binary")
    out = replies.groupBy("name").applyInArrow(spans, "_id long, _h long, spans array<long>")
    found = cut(out.groupBy("_id", "_h").agg(F.first("spans").alias("spans")))  # repeats of a row, maybe
    drop_folder(spark, folder)  # what follows needs only the spans
    return found


def removal(docs: DataFrame, size: int = SIZE, **how) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256) for each row; kept: the words left, joined by one space."""
    spans = repeated_spans(docs, size, **how).withColumnsRenamed({"_id": "_i", "_h": "_g"})
    base = docs.select("doc_id", id_of().alias("_id"), F.xxhash64("text").alias("_h"), F.coalesce("text", F.lit("")).alias("text"))
    joined = base.join(spans, (F.col("_id") == F.col("_i")) & (F.col("_h") == F.col("_g")), "left")
    # white space is one byte each in UTF-8, so runs of it are found without decoding words; \z, as $ also
    # stands before a last U+0085, U+2028 or U+2029, which are no white space here
    plain = F.regexp_replace(F.regexp_replace("text", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", ""), r"[\x20\x09-\x0D]+", " ")
    joined = joined.select("doc_id", "spans", plain.alias("plain"))
    n = F.when(F.col("plain") == "", 0).otherwise(F.length("plain") - F.length(F.replace("plain", F.lit(" "), F.lit(""))) + 1)
    # the words are named twice below: an expression used once would be put into the lambda, and the text split once per span
    joined = joined.withColumn("n_words", n.cast("long")).withColumn("words", F.when(F.col("spans").isNotNull(), F.split("plain", " ")))

    def between(k):
        """The words between the span before and the k-th (k from 0; after the last: the rest)."""
        start = F.when(k == 0, F.lit(0).cast("long")).otherwise(F.get("spans", 2 * k - 1))
        stop = F.coalesce(F.get("spans", 2 * k), F.size("words").cast("long"))
        return F.slice("words", (start + 1).cast("int"), (stop - start).cast("int"))

    left = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), (F.size("spans") / 2).cast("int")), between)), " ")
    gone = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda s, x: s + x)
    out = joined.select("doc_id", "n_words", F.coalesce(gone, F.lit(0).cast("long")).alias("n_removed"), F.when(F.col("spans").isNull(), F.col("plain")).otherwise(left).alias("kept"))
    return out.withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256))


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return removal(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = """
with w as (select coalesce(doc_id, 9223372036854775807) id, md5(coalesce(text, '')) h, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') ws from (select distinct doc_id, text from documents)),
p as (select id, h, ws, unnest(range(1, len(ws) - 11)) p from w where len(ws) >= 13),
x as (select id, h, p, md5(array_to_string(ws[p:p + 12], ' ')) g from p),
f as (select *, min(id) over (partition by g) m from x),
c as (select distinct id, h, unnest(range(p, p + 13)) q from f where m < id),
t as (select id, h, unnest(ws) s, unnest(range(1, len(ws) + 1)) q from w),
k as (select t.id, t.h, count(*) n, count(c.q) d, string_agg(case when c.q is null then t.s end, ' ' order by t.q) z from t left join c on c.id = t.id and c.h = t.h and c.q = t.q group by 1, 2)
select d.doc_id, coalesce(k.n, 0) n_words, coalesce(k.d, 0) n_removed, sha256(coalesce(k.z, '')) kept_sha256
from documents d left join k on k.id = coalesce(d.doc_id, 9223372036854775807) and k.h = md5(coalesce(d.text, ''))
"""
