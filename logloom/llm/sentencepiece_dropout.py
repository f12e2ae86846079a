"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A merge-type (BPE) SentencePiece model is read from a file that the caller names.
Encoding follows its rules: a space becomes U+2581, one is put before the text,
and adjacent pieces merge by best score, then leftmost, while their join is a
piece; characters outside the vocabulary become byte pieces.  Merge-dropout: when
the agenda comes to a candidate merge (two adjacent pieces at their place in the
word), it is skipped for good if a keyed hash of (seed, document, place of the word,
begin, middle, end) falls below ``dropout``.  So each occurrence of a word draws for
itself, and a run with the same seed gives the same pieces.

Each word of a slice of texts is first segmented once without dropout, with its
merges noted.  An occurrence none of whose hashes skips one of these merges takes
that result, which its own agenda would have reached; the others are segmented one
by one.  Many words are segmented together, one merge per word and round, as array
operations; a word of more than LONG characters has an agenda (a heap) of its own.

Decoding joins the pieces' bytes and drops the space put before the text.  A
literal U+2581 in a text is kept apart from a space as byte pieces, so decoding
gives back each text to the byte.

Defined cases: a null text gives null ids and null round trip; an empty text
gives no ids; a document's key is its id (null as its own value), so equal rows
get equal pieces; an empty table gives an empty table; other columns pass
through, whatever their names, before the columns added here (which get ``_`` at
their end where the name is taken).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import give_file
from .common import U64, id_of, mix, mixed, ragged, slices, text_buffers

MARK = 0x2581
SEED, DROPOUT = 11, 0.1
LONG = 256  #: characters of a word above which it gets a heap
SLICE = 3 << 19  #: bytes of text that a task encodes at a time
NONE = np.int32(2**31 - 1)


def default_model() -> str:
    """The public model file; a parameter of every function here."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Tables of a merge-type model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        if any(ok and chr(MARK) in p.lstrip(chr(MARK)) for p, ok in zip(names, plain)):
            raise ValueError("pieces with an inner space mark are not supported")
        self.size, ids = n, {p: i for i, (p, ok) in enumerate(zip(names, plain)) if ok}
        score = np.array([model.get_score(i) for i in range(n)])
        # equal scores share a rank: then the leftmost pair goes first
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)
        self.byte = np.zeros(256, np.int32)
        for i, p in enumerate(names):
            if model.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(chr(MARK), " ").encode() if plain[i] else b"" for i, p in enumerate(names)]
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
        # open addressing with a short probe: a slot per pair key
        self.bits = max(12, (len(pairs) * 8).bit_length())
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.keys, self.values, self.probes = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32), 0
        left = np.arange(len(keys))
        while len(left):
            slot = (self._slot(keys[left]) + self.probes) & ((1 << self.bits) - 1)
            free = self.keys[slot] == -1
            first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)[1]
            take = first[free[first]]
            self.keys[slot[take]], self.values[slot[take]] = keys[left[take]], values[left[take]]
            left = np.delete(left, take)
            self.probes += 1

    @cached_property
    def table(self) -> dict[int, int]:
        """The pairs as a dictionary, for one lookup at a time."""
        used = self.keys >= 0
        return dict(zip(self.keys[used].tolist(), self.values[used].tolist()))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that joins a and b, or -1; pieces below 0 never join."""
        key = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * self.size + b, -2)
        slot = self._slot(np.maximum(key, 0))
        out = np.full(len(key), -1, np.int32)
        todo = np.flatnonzero(key >= 0)
        for _ in range(self.probes):
            if not len(todo):
                break
            seen = self.keys[slot[todo]]
            hit = seen == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[(seen != -1) & ~hit]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


_PLACES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def skipped(key: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the occurrence of that key skips the merge of begin:middle and middle:end."""
    a, b, c = (x.astype(U64) * U64(k) for x, k in zip((begin, middle, end), _PLACES))
    return (mix(key ^ (a + b + c)) >> U64(11)).astype(float) < dropout * float(1 << 53)


def segment(model: Pieces, chars: np.ndarray, lengths: np.ndarray, keys: np.ndarray | None = None, dropout: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Merge words given one after another, one merge per word and round.

    (pieces or -1 - code point, pieces per word, characters per piece, merges as (word, begin, middle, end)).
    """
    word = np.repeat(np.arange(len(lengths)), lengths)
    sym = model.char[chars]
    sym = np.where(sym >= 0, sym, -1 - chars.astype(np.int32)).astype(np.int32)
    begin = np.arange(len(chars)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    end = begin + 1
    done_sym, done_word, done_len, done_at, merges = [], [], [], [], []

    def look(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidate of the pair at positions i and i + 1 of the same word."""
        m = model.merged(sym[i], sym[i + 1])
        ok = m >= 0
        if dropout > 0:
            c = np.flatnonzero(ok)
            drop = skipped(keys[word[i[c]]], begin[i[c]], end[i[c]], end[i[c] + 1], dropout)
            m[c[drop]] = -1
            ok = m >= 0
        return m, np.where(ok, model.rank[np.maximum(m, 0)], NONE)

    pair, rank = np.full(len(sym), -1, np.int32), np.full(len(sym), NONE, np.int32)
    i = np.flatnonzero(word[:-1] == word[1:]) if len(word) else np.zeros(0, np.int64)
    pair[i], rank[i] = look(i)
    while len(sym):
        heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        low = np.minimum.reduceat(rank, heads)
        sizes = np.diff(np.append(heads, len(sym)))
        live = low != NONE
        if not live.all():  # words without a candidate are done
            gone = ~np.repeat(live, sizes)
            done_sym.append(sym[gone]), done_word.append(word[gone]), done_len.append((end - begin)[gone]), done_at.append(begin[gone])
            keep = ~gone
            sym, word, begin, end, pair, rank = (x[keep] for x in (sym, word, begin, end, pair, rank))
            if not len(sym):
                break
            sizes, low = sizes[live], low[live]
            heads = np.cumsum(sizes) - sizes
        hit = np.flatnonzero(rank == np.repeat(low, sizes))
        at = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]  # the leftmost of each word
        merges.append((word[at], begin[at], end[at], end[at + 1]))
        sym[at], end[at] = pair[at], end[at + 1]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        sym, word, begin, end, pair, rank = (x[keep] for x in (sym, word, begin, end, pair, rank))
        at = place[at]
        left = at[(at > 0)]
        left = left[word[left - 1] == word[left]] - 1
        right = at[at + 1 < len(sym)]
        right = right[word[right] == word[right + 1]]
        pair[at], rank[at] = -1, NONE  # the old pair to the right is another one now
        for i in (left, right):
            if len(i):
                pair[i], rank[i] = look(i)
    made = tuple(np.concatenate(x) for x in zip(*merges)) if merges else (np.zeros(0, np.int64),) * 4
    if not done_sym:
        return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64), np.zeros(0, np.int64), made
    s, w, n, b = (np.concatenate(x) for x in (done_sym, done_word, done_len, done_at))
    order = np.argsort((w << 32) | b, kind="stable")
    return s[order], np.bincount(w, minlength=len(lengths)), n[order], made


def segment_long(model: Pieces, chars: np.ndarray, key: int, dropout: float) -> np.ndarray:
    """Pieces (or -1 - code point) of one long word by a heap of candidates, in n log n."""
    n, mask, limit, table = len(chars), 2**64 - 1, dropout * float(1 << 53), model.table
    start = model.char[chars]
    start = np.where(start >= 0, start, -1 - chars.astype(np.int32)).astype(np.int32)
    at = np.arange(n - 1)
    first = model.merged(start[:-1], start[1:])
    if dropout > 0:
        first[skipped(U64(key), at, at + 1, at + 2, dropout)] = -1
    sym, pair, rank = start.tolist(), [*first.tolist(), -1], model.rank.tolist()
    after, before, end = [*range(1, n), -1], list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(rank[m] << 40) | i for i, m in enumerate(pair) if m >= 0]
    heapq.heapify(heap)

    def look(i: int) -> None:
        j = after[i]
        m = table.get(sym[i] * model.size + sym[j], -1) if j >= 0 and sym[i] >= 0 and sym[j] >= 0 else -1
        if m >= 0 and dropout > 0:
            h = key ^ ((i * _PLACES[0] + j * _PLACES[1] + end[j] * _PLACES[2]) & mask)
            for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                h = ((h ^ (h >> 33)) * k) & mask
            if ((h ^ (h >> 33)) >> 11) < limit:
                m = -1
        pair[i] = m
        if m >= 0:
            heapq.heappush(heap, (rank[m] << 40) | i)

    while heap:
        x = heapq.heappop(heap)
        i = x & ((1 << 40) - 1)
        if pair[i] < 0 or rank[pair[i]] != x >> 40:
            continue  # this candidate is gone, or a better one came in its place
        j = after[i]
        sym[i], end[i], after[i], pair[j] = pair[i], end[j], after[j], -1
        sym[j] = None
        if after[i] >= 0:
            before[after[i]] = i
        look(i)
        if before[i] >= 0:
            look(before[i])
    return np.array([x for x in sym if x is not None], np.int32)


def _with_bytes(model: Pieces, sym: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters that are no piece (-1 - code point) as byte pieces."""
    odd = np.flatnonzero(sym < 0)
    if not len(odd):
        return sym, counts
    points = -1 - sym[odd].astype(np.int64)
    kinds, back = np.unique(points, return_inverse=True)
    texts = [list(model.byte[list(chr(MARK if p == PRIVATE else p).encode("utf-8", "surrogatepass"))]) for p in kinds.tolist()]
    sizes = np.array([len(t) for t in texts])
    size = np.ones(len(sym), np.int64)
    size[odd] = sizes[back]
    out = np.repeat(sym, size)
    flat = np.concatenate([np.array(t, np.int32) for t in texts])
    first = np.cumsum(size) - size
    out[ragged(first[odd], size[odd])] = flat[ragged((np.cumsum(sizes) - sizes)[back], sizes[back])]
    word = np.repeat(np.arange(len(counts)), counts)
    return out, np.bincount(word, weights=size, minlength=len(counts)).astype(np.int64)


#: Stands for a literal U+2581 while a text is encoded: no character has this code point.
PRIVATE = 0x10FFFF + 1


def encode(model: Pieces, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, seed: int = SEED, dropout: float = DROPOUT) -> tuple[np.ndarray, np.ndarray]:
    """(ids one after another, ids per text) of UTF-8 texts."""
    text = bytes(data).decode("utf-8")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    heads = (data & 0xC0) != 0x80
    chars_before = np.concatenate([[0], np.cumsum(heads)])[offsets]  # characters before each text
    n_chars = np.diff(chars_before)
    some = n_chars > 0
    # a mark before each text that is not empty
    size = n_chars + some
    first = np.cumsum(size) - size
    chars = np.full(int(size.sum()), MARK, np.int64)
    literal = points == MARK
    body = np.where(points == 32, MARK, points.astype(np.int64))
    body[literal] = PRIVATE
    chars[ragged((first + some), n_chars)] = body
    doc = np.repeat(np.arange(len(size)), size)
    if not len(chars):
        return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
    known = np.append(model.char, np.int32(-1))[chars] >= 0
    mark = chars == MARK
    start = np.zeros(len(chars), bool)
    start[first[some]] = True
    start[1:] |= (mark[1:] & ~mark[:-1]) | ~known[1:] | ~known[:-1]  # no piece crosses these places
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(chars))
    place = starts - first[doc[starts]]
    up = WORD_POWERS.get(len(chars) + 1)
    total = np.zeros(len(chars) + 1, U64)
    np.cumsum(mixed(chars.astype(U64) + U64(1)) * up[0][: len(chars)], out=total[1:])
    word = mix((total[ends] - total[starts]) * up[1][starts])
    key = mix(keys[doc[starts]] ^ mixed(place.astype(U64) + U64(seed << 32)))  # of the occurrence
    sym, counts = _occurrences(Wide(model), chars, starts, ends - starts, word, key, dropout)
    sym, n = _with_bytes(model, sym, counts)
    per = np.bincount(doc[starts], weights=n, minlength=len(size)).astype(np.int64)
    return sym, per


def _occurrences(model: Wide, chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray, word: np.ndarray, key: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """(pieces one after another, pieces per occurrence) of occurrences of words, each with its key."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (occurrences, their counts, their pieces)
    short = np.flatnonzero(lengths <= LONG)
    _, first, back = np.unique(word[short], return_index=True, return_inverse=True)
    n = lengths[short][first]
    sym, counts, _, (of, begin, middle, end) = segment(model, chars[ragged(starts[short][first], n)], n)
    heads, plain = np.cumsum(counts) - counts, np.ones(len(short), bool)
    if dropout > 0:
        order = np.argsort(of, kind="stable")
        merges = np.bincount(of, minlength=len(n))
        some = merges[back]
        at = order[ragged((np.cumsum(merges) - merges)[back], some)]
        who = np.repeat(np.arange(len(short)), some)
        drop = skipped(key[short][who], begin[at], middle[at], end[at], dropout)
        plain[who[drop]] = False
        own = short[~plain]
        s, c, _, _ = segment(model, chars[ragged(starts[own], lengths[own])], lengths[own], key[own], dropout)
        parts.append((own, c, s))
    same = back[plain]
    parts.append((short[plain], counts[same], sym[ragged(heads[same], counts[same])]))
    for i in np.flatnonzero(lengths > LONG):
        s = segment_long(model, chars[starts[i] : starts[i] + lengths[i]], int(key[i]), dropout)
        parts.append((np.array([i]), np.array([len(s)]), s))
    total = np.zeros(len(starts), np.int64)
    for who, c, _ in parts:
        total[who] = c
    out, begin = np.empty(int(total.sum()), np.int32), np.cumsum(total) - total
    for who, c, s in parts:
        out[ragged(begin[who], c)] = s
    return out, total


class Wide:
    """A model whose character table also takes PRIVATE."""

    def __init__(self, model: Pieces):
        self.char, self.rank, self.merged, self.size, self.model = np.append(model.char, np.int32(-1)), model.rank, model.merged, model.size, model

    @property
    def table(self) -> dict[int, int]:
        return self.model.table


def _powers():
    from .common import Powers

    return Powers(0xA0761D6478BD642F)


WORD_POWERS = _powers()


def decode(model: Pieces, ids: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes per text) of ids; the inverse of ``encode`` for any dropout."""
    table = np.frombuffer(b"".join(model.bytes), np.uint8)
    sizes = np.array([len(b) for b in model.bytes])
    begin = np.cumsum(sizes) - sizes
    n, starts = sizes[ids], begin[ids]
    firsts = (np.cumsum(per) - per)[per > 0]
    starts, n = starts.copy(), n.copy()
    starts[firsts] += 1  # the space put before the text
    n[firsts] -= 1
    doc = np.repeat(np.arange(len(per)), per)
    return table[ragged(starts, n)], np.bincount(doc, weights=n, minlength=len(per)).astype(np.int64)


def encode_documents(docs: DataFrame, model_path: str | None = None, seed: int = SEED, dropout: float = DROPOUT, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default all) with ``n_pieces``, ``pieces`` (ids) and ``round_trip`` (decoding gave the text).

    The model file is the driver's; Spark gives it to the workers.
    """
    name = give_file(docs.sparkSession, model_path or default_model())
    keep = docs.columns if keep is None else keep
    schema = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(SparkFiles.get(name))
        for batch in batches:
            struct = batch.column("_row")
            column = batch.column("_text")
            data, offsets = text_buffers(column)
            keys = mixed(batch.column("_id").to_numpy(zero_copy_only=False).astype(np.int64).view(U64) ^ U64(seed))
            for i, j in slices(offsets, SLICE):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                ids, per = encode(model, part, at, keys[i:j], seed, dropout)
                back, sizes = decode(model, ids, per)
                same = sizes == np.diff(at)
                if len(back) == len(part) and same.all():
                    diff = np.concatenate([[0], np.cumsum(back != part)])
                    same = diff[at[1:]] == diff[at[:-1]]
                else:
                    ends = np.cumsum(sizes)
                    same = np.array([bytes(back[e - s : e]) == bytes(part[a:b]) for e, s, a, b in zip(ends, sizes, at[:-1], at[1:])], bool)
                void = np.asarray(column.slice(i, j - i).is_null().to_numpy(zero_copy_only=False), bool)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), pa.array(ids, pa.int32()))
                if void.any():
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32(), mask=np.append(void, False)), pa.array(ids, pa.int32()))
                rows = struct.slice(i, j - i).flatten() if len(keep) else []
                yield pa.RecordBatch.from_arrays([*rows, pa.array(per, mask=void), lists, pa.array(same, mask=void)], [f"c{k}" for k in range(len(keep))] + ["n_pieces", "pieces", "round_trip"])

    from pyspark.sql import types as T

    inner = T.StructType([T.StructField(f"c{k}", f.dataType, True) for k, f in enumerate(schema)])
    out = T.StructType([*inner.fields, T.StructField("n_pieces", T.LongType()), T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])
    key = id_of("doc_id") if "doc_id" in docs.columns else F.lit(0).cast("long")
    packed = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)]) if keep else F.struct(F.lit(0).alias("z"))
    made = docs.select(packed.alias("_row"), F.col("text").alias("_text"), key.alias("_id")).mapInArrow(run, out)
    added = {}
    for c in ("n_pieces", "pieces", "round_trip"):
        added[c] = c
        while added[c].lower() in {x.lower() for x in keep}:
            added[c] += "_"
    return made.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], *[F.col(c).alias(new) for c, new in added.items()])


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, keep=["doc_id"])
