"""LM scoring with an interpolated modified Kneser-Ney n-gram model.

Counting, in Spark: (1) words of the training documents, into sorted hash arrays
by hash range; a word's rank is its place in them; (2) n-grams of ranks, dealt out
by the hash of their context, the words before the last: each task writes a
table of its contexts and sends the (n-1)-grams that end its n-grams on, each
with the number of unlike words before it; (3) the same for every order down to
2, and the counts of single words by ranges of ranks.  These are stages of one job.
Tasks send sorted, compressed blocks of locally summed counts, so a frequent
n-gram is one entry per block.  A table is sorted hash arrays: the hashes of its
contexts, and for each context its words in order with their counts.  All arrays
lie in the shared folder and workers memory-map them.

The model, for contexts u of ``order - 1`` words down to 1:
P(w|u) = (c(uw) - D(c)) / c(u) + g(u) P(w|u without its first word),
with three discounts for each order from its counts of counts.  The highest order
counts occurrences, the others the unlike words before (but n-grams after the
begin mark, which have none, their occurrences).  Single words are interpolated
with 1 / (V + 1), the share of a word never seen.  A context never seen leaves the
shorter one's probability.  Every document starts from one begin mark (not a
token) and ends in one end token.

Defined cases: a null or empty text is its end token alone; a null doc_id is in
training and not held out; repeated rows count and score like any rows; if there is no
training token the base score and score are over V = 0, each token 1 / (V + 1);
contexts count as equal if their 64-bit hashes are; other columns are not read; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Hasher, get_array, mix, put_arrays, ragged, shared_dir, word_slices

ORDER = 3
END = U64(0x1F83D9ABFB41BD6B)  #: hash of the end token
CHUNK = 1_500_000  #: tokens that a task holds at a time
RANKS = 18  #: bits of a range of ranks
FEW = 64  #: the statistics of a context with more words than this (254 at most) are stored, others are summed when asked for
RUN = 16  #: contexts of which one has the place of its first word stored


def pack(values: np.ndarray, deltas: bool) -> bytes:
    """Integers as compressed byte planes, of their differences if sorted."""
    v = values.astype(U64)
    if deltas:
        v = np.diff(v, prepend=U64(0))
    return pa.compress(v.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpack(raw: bytes, n: int, deltas: bool) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    v = np.ascontiguousarray(planes.T).view(U64).ravel()
    return np.cumsum(v, dtype=U64) if deltas else v


def tokens(batches: Iterator[pa.RecordBatch], carry: list[str]) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """(rows of ``carry``, token hashes, bounds) of chunks of documents."""
    hasher = Hasher(1)
    rows, toks, sizes, n = [], [], [], 0

    def done():
        return rows, np.concatenate(toks), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    for batch in batches:
        for i, j, w in word_slices(batch.column("text"), lower=True):
            size = w.counts + 1
            t = np.full(int(size.sum()), END, U64)
            t[np.arange(len(w.starts)) + np.repeat(np.arange(len(size)), w.counts)] = hasher.words(w.data, w.starts, w.ends)
            toks.append(t), sizes.append(size)
            rows.append(pa.RecordBatch.from_arrays([batch.column(x).slice(i, j - i) for x in carry], carry) if carry else None)
            n += len(t)
            if n >= CHUNK:
                yield done()
                rows, toks, sizes, n = [], [], [], 0
    if sizes:
        yield done()


def places(bounds: np.ndarray) -> np.ndarray:
    """Each token's place in its document, from 0."""
    return np.arange(bounds[-1]) - np.repeat(bounds[:-1], np.diff(bounds))


def before(rank: np.ndarray, place: np.ndarray, at: np.ndarray, n: int, begin: int) -> list[np.ndarray]:
    """Ranks of the n symbols before each of the tokens ``at``, first to last; all have them, the begin mark counted."""
    return [np.where(place[at] >= k, rank[np.maximum(at - k, 0)], begin) for k in range(n, 0, -1)]


def context_hash(ranks: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(ranks[0]), 0x2545F4914F6CDD1D, U64)
    for r in ranks:
        h = mix((h ^ (r.astype(U64) + U64(1))) * U64(0x9E3779B97F4A7C15))
    return h


def range_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Range of a hash among ``parts`` equal ones."""
    return (((h >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)


@lru_cache(maxsize=4096)
def _mapped(folder: str, name: str, key: str) -> np.ndarray:
    return np.asarray(get_array(folder, name, key))


class Sorted:
    """Words in sorted hash arrays, by range: lookup of sorted unique values."""

    def __init__(self, folder: str, manifest: str):
        self.folder = folder
        self.names, sizes = np.array(_mapped(folder, manifest, "names1")), _mapped(folder, manifest, "sizes1")
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (-1 if absent) and count (0 if absent) of each value."""
        rank, count = np.full(len(values), -1, np.int64), np.zeros(len(values), np.int64)
        edges = np.searchsorted(range_of(values, len(self.names)), np.arange(len(self.names) + 1))
        for p in np.flatnonzero(np.diff(edges)):
            if not self.names[p]:
                continue
            a, b, name = edges[p], edges[p + 1], self.names[p].decode()
            keys = _mapped(self.folder, name, "key")
            at = np.minimum(np.searchsorted(keys, values[a:b]), len(keys) - 1)
            hit = keys[at] == values[a:b]
            rank[a:b] = np.where(hit, self.offsets[p] + at, -1)
            count[a:b] = np.where(hit, _mapped(self.folder, name, "count")[at], 0)
        return rank, count


def narrow(x: np.ndarray) -> np.ndarray:
    """Counts in the smallest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def table_arrays(ctx: np.ndarray, word: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """A table of n-grams sorted by context hash and word.

    Words are cut into 16 bits and the rest.  Counts, and sizes of contexts, of 255 and
    more lie apart; where a context's words begin is stored for one context in RUN.
    """
    head = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
    size = np.diff(np.append(head, len(ctx)))
    many = np.flatnonzero(size > FEW)
    stats = np.stack([np.add.reduceat(x.astype(np.int64), head)[many] for x in (n, n == 1, n == 2, n > 2)])
    large = np.flatnonzero(n >= 255)
    return {
        "key": ctx[head], "start": narrow(head[::RUN]), "size": np.minimum(size, 255).astype(np.uint8), "many": many, "many_size": size[many], "stats": stats,
        "low": (word & 0xFFFF).astype(np.uint16), "high": narrow(word >> 16), "count": np.minimum(n, 255).astype(np.uint8), "large": large, "large_n": n[large],
    }


class Tables:
    """The n-grams of one order: lookup of contexts and of words after them."""

    def __init__(self, folder: str, manifest: str, order: int):
        self.folder, self.names = folder, np.array(_mapped(folder, manifest, f"names{order}"))

    def find(self, ctx: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count of each word after its context, statistics of the context: sum, words counted once, twice, more often).

        The sum is 0 if the context is absent.
        """
        keys, back = np.unique(ctx, return_inverse=True)
        order = np.argsort(back, kind="stable")
        tails = np.cumsum(np.bincount(back, minlength=len(keys)))  # tokens up to each context
        count, stats = np.zeros(len(ctx), np.int64), np.zeros((4, len(keys)), np.int64)
        edges = np.searchsorted(range_of(keys, len(self.names)), np.arange(len(self.names) + 1))
        for p in np.flatnonzero(np.diff(edges)):
            if not self.names[p]:
                continue
            a, b = edges[p], edges[p + 1]
            part = {k: _mapped(self.folder, self.names[p].decode(), k) for k in ("key", "start", "size", "many", "many_size", "stats", "low", "high", "count", "large", "large_n")}
            i = np.minimum(np.searchsorted(part["key"], keys[a:b]), len(part["key"]) - 1)
            hit = np.flatnonzero(part["key"][i] == keys[a:b])
            low, high = np.zeros((2, b - a), np.int64)
            low[hit], high[hit] = self._span(part, i[hit])
            stats[:, a:b] = self._stats(part, i, low, high)
            rows = order[tails[a - 1] if a else 0 : tails[b - 1]]
            mine = back[rows] - a
            count[rows] = self._counts(part, self._search(part, word[rows], low[mine], high[mine]))
        return count, stats[:, back]

    @staticmethod
    def _sizes(part: dict, i: np.ndarray) -> np.ndarray:
        """How many words follow each context."""
        n = part["size"][i].astype(np.int64)
        big = np.flatnonzero(n == 255)
        if len(big):
            n[big] = part["many_size"][np.searchsorted(part["many"], i[big])]
        return n

    @classmethod
    def _span(cls, part: dict, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of each context begin and end: the stored place before, and the sizes from there on."""
        back = i % RUN
        own = cls._sizes(part, ragged(i - back, back))
        total = np.concatenate([[0], np.cumsum(own)])
        last = np.cumsum(back)
        low = part["start"][i // RUN].astype(np.int64) + total[last] - total[last - back]
        return low, low + cls._sizes(part, i)

    @staticmethod
    def _counts(part: dict, at: np.ndarray) -> np.ndarray:
        """Counts at some places, 0 for -1."""
        n = np.where(at >= 0, part["count"][np.maximum(at, 0)], 0).astype(np.int64)
        big = np.flatnonzero(n == 255)
        if len(big):
            n[big] = part["large_n"][np.searchsorted(part["large"], at[big])]
        return n

    @classmethod
    def _stats(cls, part: dict, i: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        size, out = high - low, np.zeros((4, len(i)), np.int64)
        few = np.flatnonzero((size > 0) & (size <= FEW))
        if len(few):
            n = cls._counts(part, ragged(low[few], size[few]))
            head = np.cumsum(size[few]) - size[few]
            out[:, few] = [np.add.reduceat(x.astype(np.int64), head) for x in (n, n == 1, n == 2, n > 2)]
        rest = np.flatnonzero(size > FEW)
        if len(rest):
            out[:, rest] = part["stats"][:, np.searchsorted(part["many"], i[rest])]
        return out

    @staticmethod
    def _search(part: dict, want: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of each wanted word between low and high, or -1."""
        words = lambda at: (part["high"][at].astype(np.int64) << 16) | part["low"][at]
        low, high, top = low.copy(), high.copy(), high
        todo = np.flatnonzero(low < high)
        while len(todo):
            mid = (low[todo] + high[todo]) >> 1
            less = words(mid) < want[todo]
            low[todo] = np.where(less, mid + 1, low[todo])
            high[todo] = np.where(less, high[todo], mid)
            todo = todo[low[todo] < high[todo]]
        found = low < top
        found[found] = words(low[found]) == want[found]
        return np.where(found, low, -1)


BLOCK = "level int, p long, n long, cols array<binary>, f binary, name string, tops array<long>"


def _joined(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Columns of non-negative integers in as few 64-bit ones as hold them, first to last."""
    out, room = [], 0
    for c in cols:
        bits = int(c.max()).bit_length() if len(c) else 1
        if out and bits <= room:
            out[-1] = (out[-1] << U64(bits)) | c.astype(U64)
            room -= bits
        else:
            out.append(c.astype(U64))
            room = 64 - bits
    return out


def _blocks(level: int, part: np.ndarray, cols: list[np.ndarray], count: np.ndarray) -> pa.RecordBatch:
    """A row for each part: equal n-grams summed, in order, compressed."""
    keys = _joined([part, *cols])
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    part, cols, count = part[order], [c[order] for c in cols], count[order]
    new = np.ones(len(part), bool)
    if len(part):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    first = np.flatnonzero(new)
    count = np.add.reduceat(count, first) if len(first) else count
    part, cols = part[first], [c[first] for c in cols]
    head = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    spans = list(zip(head, np.append(head[1:], len(part))))
    rows = [(level, int(part[a]), b - a, [pack(c[a:b], k == 0) for k, c in enumerate(cols)], pack(count[a:b], False), None, None) for a, b in spans]
    return _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.string(), pa.list_(pa.int64()))
    names = [c.split()[0] for c in BLOCK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], names)


def _sum(blocks: Iterator[pa.RecordBatch], width: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(context hashes, columns, counts) of all n-grams of some blocks, by context hash and word.

    Merged in rounds, so that what is held stays near the result's size.
    """
    held, waiting = (np.zeros(0, U64), [np.zeros(0, np.int64)] * width, np.zeros(0, np.int64)), []

    def fold(parts):
        key, cols, n = np.concatenate([p[0] for p in parts]), [np.concatenate([p[1][k] for p in parts]) for k in range(width)], np.concatenate([p[2] for p in parts])
        order = np.lexsort((cols[-1], key))
        key, word = key[order], cols[-1][order]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (word[1:] != word[:-1])])) if len(key) else np.zeros(0, np.int64)
        return key[first], [c[order[first]] for c in cols], np.add.reduceat(n[order], first) if len(first) else n

    for batch in blocks:
        for row in batch.select(["n", "cols", "f"]).to_pylist():
            cols = [unpack(raw, row["n"], k == 0).astype(np.int64) for k, raw in enumerate(row["cols"])]
            key = context_hash(cols[:-1]) if width > 1 else np.zeros(row["n"], U64)
            waiting.append((key, cols, unpack(row["f"], row["n"], False).astype(np.int64)))
            if sum(len(w[0]) for w in waiting) > max(1 << 20, len(held[0])):
                held, waiting = fold([held, *waiting]), []
    return fold([held, *waiting])


def _discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2, 3+ from n[k] = how many have count k + 1."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]


class Model:
    """What a worker needs to score: where the mapped arrays lie, and a few numbers."""

    def __init__(self, folder: str, order: int, V: int, N: int):
        self.folder, self.order, self.V, self.N = folder, order, V, N
        self.manifest: str | None = None  # names of the tables' files, by order and range
        self.discounts: dict[int, list[float]] = {}
        self.total, self.kinds = 0, [0, 0, 0]  # of single words: sum of counts, words counted once, twice, more often

    def words(self) -> Sorted:
        return Sorted(self.folder, self.manifest)

    def tables(self, order: int) -> Tables:
        return Tables(self.folder, self.manifest, order)

    def unigrams(self, rank: np.ndarray) -> np.ndarray:
        """Counts of single words by rank (sorted), range by range."""
        out, names = np.zeros(len(rank), np.int64), _mapped(self.folder, self.manifest, "names0")
        edges = np.searchsorted(rank >> RANKS, np.arange(len(names) + 1))
        for p in np.flatnonzero(np.diff(edges)):
            if names[p]:
                a, b = edges[p], edges[p + 1]
                out[a:b] = _mapped(self.folder, names[p].decode(), "n")[rank[a:b] - (p << RANKS)]
        return out


def _tops(n: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4, then how many are 3 or more, and the sum."""
    return [*np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist(), int((n > 2).sum()), int(n.sum())]


def _named(rows: list, parts: int) -> np.ndarray:
    names = np.zeros(parts, "S32")
    for r in rows:
        names[r.p] = r.name.encode()
    return names


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Count a model of ``order`` (2 or more) over every row's ``text``."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    texts = docs.select("text")
    guess = max(1, (texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // 6)
    word_parts, parts = int(max(4, guess >> 22)), int(max(8, guess >> 20))

    def count_words(batches):
        for _, tok, _ in tokens(batches, []):
            key, n = np.unique(tok, return_counts=True)
            yield _blocks(1, range_of(key, word_parts), [key], n)

    def sum_words(key: tuple[pa.Scalar, ...], blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, (hashes,), n = _sum(blocks, 1)
        hashes = hashes.view(U64)
        by = np.argsort(hashes)
        name = put_arrays(folder, {"key": hashes[by], "count": narrow(n[by])})
        yield pa.RecordBatch.from_pydict({"p": [key[0].as_py()], "name": [name], "n": [len(n)], "total": [int(n.sum())]})

    words = texts.mapInArrow(count_words, BLOCK).groupBy("p").applyInArrow(sum_words, "p long, name string, n long, total long").collect()  # one short row per range
    sizes = np.zeros(word_parts, np.int64)
    for r in words:
        sizes[r.p] = r.n
    model = Model(folder, order, int(sizes.sum()), sum(r.total for r in words))
    files = {"names1": _named(words, word_parts), "sizes1": sizes}
    model.manifest = put_arrays(folder, files)
    V = model.V
    if not V:
        return model

    def count_ngrams(batches):
        table = model.words()
        for _, tok, bounds in tokens(batches, []):
            seen, back = np.unique(tok, return_inverse=True)
            rank, place = table.find(seen)[0][back], places(bounds)
            for level in range(2, order + 1):
                # the highest order takes all its n-grams, the others those after the begin mark
                at = np.flatnonzero(place >= level - 2 if level == order else place == level - 2)
                ctx = before(rank, place, at, level - 1, V)
                yield _blocks(level, range_of(context_hash(ctx), parts), [*ctx, rank[at]], np.ones(len(at), np.int64))

    def reduce(level: int):
        def run(key: tuple[pa.Scalar, ...], blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if key[0].as_py() != level:  # blocks of lower orders, and what higher orders have written
                yield from blocks
                return
            p = key[1].as_py()
            ctx, cols, n = _sum(blocks, level)
            if level > 1:
                name = put_arrays(folder, table_arrays(ctx, cols[-1], n))
                rest = cols[1:]
                part = range_of(context_hash(rest[:-1]), parts) if level > 2 else rest[0] >> RANKS
                yield _blocks(level - 1, part, rest, np.ones(len(n), np.int64))
            else:
                out = np.zeros(1 << RANKS, np.int64)
                out[cols[0] - (p << RANKS)] = n
                name = put_arrays(folder, {"n": narrow(out)})
            yield _rows([(-level, p, len(n), None, None, name, _tops(n))])

        return run

    counted = texts.mapInArrow(count_ngrams, BLOCK)
    for level in range(order, 0, -1):
        counted = counted.groupBy("level", "p").applyInArrow(reduce(level), BLOCK)
    written = counted.select("level", "p", "name", "tops").collect()  # one short row per range and order
    for level in range(1, order + 1):
        mine = [r for r in written if r.level == -level]
        tops = np.sum([r.tops for r in mine], axis=0).tolist()
        model.discounts[level] = _discounts(tops[:4])
        files[f"names{level if level > 1 else 0}"] = _named(mine, parts if level > 1 else (V >> RANKS) + 1)
        if level == 1:
            model.total, model.kinds = tops[5], [tops[0], tops[1], tops[4]]
    model.manifest = put_arrays(folder, files)
    return model


def _discount(count: np.ndarray, d: list[float]) -> np.ndarray:
    return np.select([count == 0, count == 1, count == 2], [0.0, d[0], d[1]], d[2])


def token_scores(model: Model, tok: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log10 probability, log10 base probability, known) of each token in its document."""
    V, N = model.V, model.N
    if not V:
        zero = np.zeros(len(tok))
        return zero, zero + np.log10(0.5 / 0.5), np.zeros(len(tok), bool)
    seen, back = np.unique(tok, return_inverse=True)
    rank, count = model.words().find(seen)
    known, d = rank >= 0, model.discounts[1]
    single = np.zeros(len(seen), np.int64)
    single[known] = model.unigrams(rank[known])  # ranks rise with hashes
    share = sum(a * b for a, b in zip(d, model.kinds)) / model.total
    p = ((single - _discount(single, d)) / model.total + share / (V + 1))[back]
    base = np.log10((count + 0.5) / (N + 0.5 * (V + 1)))
    rank, place = rank[back], places(bounds)
    for order in range(2, model.order + 1):
        at = np.flatnonzero(place >= order - 2)
        ctx = before(rank, place, at, order - 1, V)
        whole = np.all([c >= 0 for c in ctx], axis=0)
        at, ctx = at[whole], [c[whole] for c in ctx]
        n, (total, one, two, more) = model.tables(order).find(context_hash(ctx), rank[at])
        met = np.flatnonzero(total)
        at, n, total, d = at[met], n[met], total[met], model.discounts[order]
        p[at] = (n - _discount(n, d)) / total + (d[0] * one[met] + d[1] * two[met] + d[2] * more[met]) / total * p[at]
    return np.log10(p), base[back], known[back]


def score(docs: DataFrame, model: Model, key: str = "doc_id", held: str = "held_out") -> DataFrame:
    """key, held, n_tokens, n_known, train_tokens, base_score, score of each row."""
    kinds = dict(docs.dtypes)

    def run(batches):
        for rows, tok, bounds in tokens(batches, [key, held]):
            p, base, known = token_scores(model, tok, bounds)
            first = bounds[:-1]
            cols = [np.diff(bounds), np.add.reduceat(known.astype(np.int64), first), np.full(len(first), model.N, np.int64), np.add.reduceat(base, first), np.add.reduceat(p, first)]
            table = pa.Table.from_batches(rows).combine_chunks()
            yield pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks() for c in (key, held)], *[pa.array(c) for c in cols]], [key, held, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"`{key}` {kinds[key]}, `{held}` {kinds[held]}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.select(key, held, "text").mapInArrow(run, schema)


def perplexity(scored: DataFrame) -> DataFrame:
    """``scored`` with the per-token perplexity of each text."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bucket = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(5))
    docs = docs.withColumn("held_out", F.coalesce(bucket == 1, F.lit(False)))
    return score(docs, train(docs.where(~F.col("held_out"))))
