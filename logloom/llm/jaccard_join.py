"""N-gram Jaccard join through a token-group matrix.

A document's set: the distinct SIZE-word shingles of its lower-cased (A-Z) words,
or its whole word sequence as one if shorter.  Documents link when
100 * |intersection| >= percent * |union|; the result is each document's component.

1. A sketch that grows with the input counts, over all documents, how many hold a
   shingle (never too few).  It orders shingles: rare first.
2. Documents of equal sets are one class.  Classes are partitioned into groups of
   similar ones by minimum hash; a group that the sketch expects to be large is
   split, so groups stay near GROUP classes.
3. The token-group matrix: token -> groups whose members have it in their prefix
   (the n - ceil(percent * n / 100) + 1 first shingles in the order; two linked sets share
   one there), with the most shingles that a member has from the token on and the
   least size of a member.  Each group's token union comes with its members' sets,
   which lie in the shared folder.
4. Groups that share a token are a query group and a group to open.  The first shingle
   that two sets share, in the order, bounds their overlap by what either has from there
   on: the group is not opened if no such bound reaches what a link of its smallest
   members would need.  In an opened group, a member's overlap with the other group's
   union bounds its overlap with each member: only members with enough are compared,
   exactly, all at once.
5. A token of many groups gives a star of pairs first; once components are known,
   only pairs of its groups that are not in one component are opened as well.
   So thousands of near copies don't yield all their pairs, and no link is lost.

Defined cases: null or wordless texts have the empty set and link with nothing; a null
doc_id ranks last, and its component_id is null if no document with an id is in the
component; exact repeats of a row are in one component; an empty table gives an
empty table; other columns pass through ``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, U64, Hasher, connected_components, cut, get_array, id_of, mixed, put_arrays, ragged, shared_dir, word_slices
from .lm_scoring import pack, unpack

SIZE, PERCENT = 5, 80
GROUP, STAR = 64, 16  #: classes of a group; groups of a token from which a star comes first
MAX_BITS, TILE = 36, 22  #: logarithms of the cells of the sketch at most, and of its tiles
FINE = 6  #: ranks of a doubling of the documents of a cell
CHUNK = 2_000_000  #: shingles that a task holds at a time


class Sets:
    """Shingle sets of some documents: ``tokens`` sorted within each, ``bounds`` between them."""

    def __init__(self, w, hasher: Hasher, size: int):
        h = hasher.words(w.data, w.starts, w.ends)
        at, doc = w.windows(size)
        short = np.flatnonzero((w.counts > 0) & (w.counts < size))
        tok = hasher.windows(h, at, size)
        if len(short):
            tok = np.concatenate([tok, hasher.runs(h, hasher.of_words, w.bounds[short], w.bounds[short + 1])])
            doc = np.concatenate([doc, short])
        order = np.argsort(tok)
        order = order[np.argsort(doc[order].astype(np.uint32), kind="stable")]
        tok, doc = tok[order], doc[order]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (doc[1:] != doc[:-1])
        self.tokens, self.doc = tok[new], doc[new]
        self.counts = np.bincount(self.doc, minlength=len(w.counts)).astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])


def _cell(token: np.ndarray, group: np.ndarray, rest: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (token, group) in order, with the greatest ``rest`` and the least size."""
    o = np.lexsort((group, token))
    token, group = token[o], group[o]
    head = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (group[1:] != group[:-1])])) if len(token) else np.zeros(0, np.int64)
    if not len(head):
        return token, group, rest, least
    return token[head], group[head], np.maximum.reduceat(rest[o], head), np.minimum.reduceat(least[o], head)


def _cells(tok: np.ndarray, bits: int) -> np.ndarray:
    return ((tok * U64(0x9E3779B97F4A7C15)) >> U64(64 - bits)).astype(np.int64)


def frequency(docs: DataFrame, bits: int, folder: str, size: int) -> dict[int, str]:
    """tile -> name of the array of ranks of its cells: FINE times the logarithm of how many documents fall into a cell.

    Tasks count cells sparsely, a chunk at a time; counts of a tile are summed in one task.
    """
    tile = min(bits, TILE)

    def blocks(cells: list[np.ndarray]) -> pa.RecordBatch:
        cells, n = np.unique(np.concatenate(cells), return_counts=True)
        edges = np.flatnonzero(np.concatenate([[True], (cells[1:] >> tile) != (cells[:-1] >> tile)]))
        out = {k: [] for k in ("p", "n", "cells", "counts")}
        for a, b in zip(edges, np.append(edges[1:], len(cells))):
            out["p"].append(int(cells[a] >> tile)), out["n"].append(int(b - a))
            out["cells"].append(pack(cells[a:b] & ((1 << tile) - 1), True)), out["counts"].append(pack(n[a:b], False))
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k in ("cells", "counts") else pa.int64()) for k, v in out.items()})

    def count(batches):
        held, n, hasher = [], 0, Hasher(1)
        for batch in batches:
            for _, _, w in word_slices(batch.column("text"), lower=True):
                held.append(_cells(Sets(w, hasher, size).tokens, bits))
                n += len(held[-1])
                if n >= 2 * CHUNK:
                    yield blocks(held)
                    held, n = [], 0
        if n:
            yield blocks(held)

    def add(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << tile, np.int64)
        for batch in parts:
            for n, cells, counts in zip(*[batch.column(c).to_pylist() for c in ("n", "cells", "counts")]):
                total[unpack(cells, n, True).astype(np.int64)] += unpack(counts, n, False).astype(np.int64)
        rank = np.floor(FINE * np.log2(np.maximum(total, 1))).astype(np.uint8)
        yield pa.RecordBatch.from_pydict({"p": [key[0].as_py()], "name": [put_arrays(folder, {"rank": rank})]})

    rows = docs.mapInArrow(count, "p long, n long, cells binary, counts binary").groupBy("p").applyInArrow(add, "p long, name string")
    return {r.p: r.name for r in rows.collect()}  # one short row per 2**TILE cells


def ranks(tok: np.ndarray, bits: int, folder: str, names: dict[int, str]) -> np.ndarray:
    """The rank of each token's cell."""
    cells, tile = _cells(tok, bits), min(bits, TILE)
    order = np.argsort(cells >> tile, kind="stable")
    part = (cells >> tile)[order]
    out = np.zeros(len(tok), np.uint8)
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
    for a, b in zip(edges, np.append(edges[1:], len(part))):
        if int(part[a]) in names:
            at = order[a:b]
            out[at] = get_array(folder, names[int(part[a])], "rank")[cells[at] & ((1 << tile) - 1)]
    return out


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """(len(a) x len(b)) sizes of the intersections of sorted sets."""
    ta, tb = np.concatenate(a), np.concatenate(b)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    both = np.intersect1d(ta, tb)
    ca, cb = np.searchsorted(both, ta), np.searchsorted(both, tb)
    ok = np.flatnonzero(both[np.minimum(ca, len(both) - 1)] == ta) if len(both) else np.zeros(0, int)
    ok2 = np.flatnonzero(both[np.minimum(cb, len(both) - 1)] == tb) if len(both) else np.zeros(0, int)
    ra, ca, rb, cb = ra[ok], ca[ok], rb[ok2], cb[ok2]
    out = np.zeros((len(a), len(b)), np.float32)
    for k in range(0, len(both), 8192):
        x, y = np.zeros((len(a), 8192), np.float32), np.zeros((len(b), 8192), np.float32)
        s, t = (ca >= k) & (ca < k + 8192), (cb >= k) & (cb < k + 8192)
        x[ra[s], ca[s] - k] = 1
        y[rb[t], cb[t] - k] = 1
        out += x @ y.T  # counts up to 8192 are exact, and so are their sums below 2**24
    return out.astype(np.int64)


def open_pair(a: list[np.ndarray], b: list[np.ndarray], percent: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i in a, j in b) of linked sets of a query group and another (or the same) group."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    if len(a) == len(b) == 1 and not same:  # one query, one member: the union is the member
        if 100 * min(na[0], nb[0]) < percent * max(na[0], nb[0]):
            return none
        n = len(np.intersect1d(a[0], b[0], assume_unique=True))
        return (np.zeros(1, np.int64),) * 2 if 100 * n >= percent * (na[0] + nb[0] - n) else none
    if not same:
        for mine, n, other in ((a, na, b), (b, nb, a)):
            union = np.unique(np.concatenate(other))
            tok = np.concatenate(mine)
            hit = union[np.minimum(np.searchsorted(union, tok), len(union) - 1)] == tok
            bound = np.add.reduceat(hit.astype(np.int64), np.cumsum(n) - n)
            keep = 100 * bound >= percent * n
            if mine is a:
                ka = np.flatnonzero(keep)
            else:
                kb = np.flatnonzero(keep)
        if not len(ka) or not len(kb):
            return none
    else:
        ka = kb = np.arange(len(a))
    n = _overlaps([a[i] for i in ka], [b[j] for j in kb])
    i, j = np.nonzero(100 * n >= percent * (na[ka][:, None] + nb[kb][None, :] - n))
    if same:
        i, j = i[i < j], j[i < j]
    return ka[i], kb[j]


def components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, group: int = GROUP, star: int = STAR) -> DataFrame:
    """(_id, _h, n_shingles, component) of each row: id, text hash, set size, smallest id of its component."""
    spark = docs.sparkSession
    base = docs.select(id_of().alias("_id"), F.xxhash64("text").alias("_h"), "text")
    folder = shared_dir(spark)
    guess = max(1, (base.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // 6)
    bits = int(min(MAX_BITS, max(12, (guess >> 2).bit_length())))
    names = frequency(base, bits, folder, size)
    parts = int(max(8, guess >> 23))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(1)
        held: dict[str, list] = {k: [] for k in ("id", "h", "n", "s1", "s2", "g", "tokens", "pt", "pg", "pr", "pn")}
        count = 0

        def flush():
            x = {k: np.concatenate(v) for k, v in held.items()}
            pt, pg, pr, pn = (x.pop(k) for k in ("pt", "pg", "pr", "pn"))
            name = put_arrays(folder, x | {"bounds": np.concatenate([[0], np.cumsum(x["n"])])})
            pt, pg, pr, pn = _cell(pt, pg, pr, pn)
            part = (((pt >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)
            edges = np.searchsorted(part, np.arange(parts + 1))
            out = {"p": [parts + int(name[:4], 16) % parts], "n": [0], "t": [b""], "gs": [b""], "g": [b""], "r": [b""], "m": [b""], "name": [name]}
            for p in np.flatnonzero(np.diff(edges)):
                a, b = edges[p], edges[p + 1]
                gs, at = np.unique(pg[a:b], return_inverse=True)
                for k, v in (("p", int(p)), ("n", int(b - a)), ("t", pack(pt[a:b], True)), ("gs", gs.tobytes()), ("g", pack(at, False)), ("r", pack(pr[a:b], False)), ("m", pack(pn[a:b], False)), ("name", None)):
                    out[k].append(v)
            return pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int64(), pa.int64(), *[pa.binary()] * 5, pa.string()))})

        for batch in batches:
            ids, hs = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_id", "_h"))
            for i, j, w in word_slices(batch.column("text"), lower=True):
                s = Sets(w, hasher, size)
                some = np.flatnonzero(s.counts)
                heads = s.bounds[:-1][some]
                s1, s2, g = (np.zeros(j - i, U64) for _ in range(3))
                if len(some):
                    s1[some] = mixed(np.add.reduceat(mixed(s.tokens), heads) + s.counts[some].astype(U64))
                    s2[some] = np.add.reduceat(mixed(s.tokens ^ U64(0xA5A5A5A5A5A5A5A5)), heads)
                    low = np.minimum.reduceat(mixed(s.tokens ^ U64(0x0123456789ABCDEF)), heads)
                    where = np.flatnonzero(mixed(s.tokens ^ U64(0x0123456789ABCDEF)) == np.repeat(low, s.counts[some]))
                    least = np.zeros(j - i, np.int64)
                    rank = ranks(s.tokens, bits, folder, names)
                    least[s.doc[where]] = 2 ** (rank[where] / FINE)  # about how many documents hold it
                    split = np.maximum(1, -(-least[some] // group)).astype(U64)
                    g[some] = mixed(low + mixed(s1[some]) % split)
                    o = np.argsort(rank // (FINE // 2), kind="stable")  # half a doubling is one place in the order, within it by token
                    o = o[np.argsort(s.doc[o].astype(np.uint32), kind="stable")]
                    take = s.counts[some] - (-(-percent * s.counts[some] // 100)) + 1
                    # one member of a class of this slice is enough
                    _, first = np.unique(s1[some], return_index=True)
                    at, size_ = ragged(heads[first], take[first]), s.counts[some][first]
                    held["pt"].append(s.tokens[o[at]]), held["pg"].append(np.repeat(g[some][first], take[first]))
                    held["pr"].append(np.repeat(heads[first] + size_, take[first]) - at), held["pn"].append(np.repeat(size_, take[first]))
                else:
                    held["pt"].append(np.zeros(0, U64)), held["pg"].append(np.zeros(0, U64))
                    held["pr"].append(np.zeros(0, np.int64)), held["pn"].append(np.zeros(0, np.int64))
                for k, v in (("id", ids[i:j]), ("h", hs[i:j]), ("n", s.counts), ("s1", s1), ("s2", s2), ("g", g), ("tokens", s.tokens)):
                    held[k].append(v)
                count += len(s.tokens)
                if count >= CHUNK:
                    yield flush()
                    held, count = {k: [] for k in held}, 0
        if held["id"]:
            yield flush()

    def matrix_rows(key: tuple[pa.Scalar, ...], blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of groups that share a token; groups of tokens of many groups; names of files pass."""
        tok, grp, rest, least, names = [], [], [], [], []
        for batch in blocks:
            for r in batch.to_pylist():
                if r["name"] is not None:
                    names.append(r["name"])
                    continue
                tok.append(unpack(r["t"], r["n"], True))
                grp.append(np.frombuffer(r["gs"], U64)[unpack(r["g"], r["n"], False).astype(np.int64)])
                rest.append(unpack(r["r"], r["n"], False).astype(np.int64)), least.append(unpack(r["m"], r["n"], False).astype(np.int64))

        def rows(kind, a, b, name=None, r=None, m=None):
            n = len(a)
            more = [pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (r, m)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind), pa.int32()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(name if name else [None] * n, pa.string()), *more], ["kind", "a", "b", "name", "r", "m"])

        if names:
            zero = np.zeros(len(names), U64)
            yield rows(0, zero, zero, names)
        if not tok:
            return
        t, g, r, m = _cell(*[np.concatenate(x) for x in (tok, grp, rest, least)])
        enough = lambda i, j: (100 + percent) * np.minimum(r[i], r[j]) >= percent * (m[i] + m[j])
        head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        n = np.diff(np.append(head, len(t)))
        pairs = []
        for size_ in range(2, star + 1):
            heads = head[n == size_]
            if len(heads):
                cell = heads[:, None] + np.arange(size_)
                i, j = np.triu_indices(size_, 1)
                i, j = cell[:, i].ravel(), cell[:, j].ravel()
                ok = enough(i, j)
                pairs.append(np.stack([g[i[ok]], g[j[ok]]]))
        many = n > star
        if many.any():
            i, j = np.repeat(head[many], n[many]), ragged(head[many], n[many])
            ok = enough(i, j)
            pairs.append(np.stack([g[i[ok]], g[j[ok]]]))
            yield rows(2, t[j], g[j], None, r[j], m[j])
        if pairs:
            a, b = np.concatenate(pairs, axis=1)
            a, b = np.minimum(a, b), np.maximum(a, b)
            o = np.lexsort((b, a))
            a, b = a[o], b[o]
            keep = np.ones(len(a), bool)
            keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            keep &= a != b
            if keep.any():
                yield rows(1, a[keep], b[keep])

    indexed = base.mapInArrow(index, "p long, n long, t binary, gs binary, g binary, r binary, m binary, name string")
    found = cut(indexed.groupBy("p").applyInArrow(matrix_rows, "kind int, a long, b long, name string, r long, m long"))

    def listed(batches):
        for batch in batches:
            for name in batch.column("name").to_pylist():
                x = {k: np.array(get_array(folder, name, k)) for k in ("id", "h", "n", "s1", "s2", "g")}
                yield pa.RecordBatch.from_arrays([*[pa.array(x[k].view(np.int64)) for k in ("id", "h", "n", "s1", "s2", "g")], pa.array([name] * len(x["id"])), pa.array(np.arange(len(x["id"])), pa.int64())], ["_id", "_h", "n", "s1", "s2", "g", "name", "row"])

    rows = cut(found.where("kind = 0").select("name").repartition(max(1, parts)).mapInArrow(listed, "_id long, _h long, n long, s1 long, s2 long, g long, name string, row long"))
    # a class: equal sets; its home is where one copy of its set lies
    classes = rows.where("n > 0").groupBy("s1", "s2", "g").agg(F.min("_id").alias("low"), F.min(F.struct("name", "row", "n")).alias("home"))
    classes = cut(classes.select("s1", "g", "low", "home.*"))
    groups = classes.groupBy("g").agg(F.collect_list(F.struct("name", "row", "s1")).alias("m"))  # near GROUP classes each
    groups = cut(groups)

    def opened(batches):
        files: dict[str, tuple] = {}

        def load(m):
            out = []
            for x in m:
                if x["name"] not in files:
                    if len(files) > 512:
                        files.clear()
                    files[x["name"]] = get_array(folder, x["name"], "tokens"), np.array(get_array(folder, x["name"], "bounds"))
                tokens, bounds = files[x["name"]]
                out.append(np.array(tokens[bounds[x["row"]] : bounds[x["row"] + 1]]))
            return out

        # a few pairs at a time: each may list many members
        for batch in (b.slice(k, 32) for b in batches for k in range(0, b.num_rows, 32)):
            left, right = [], []
            for ma, mb in zip(batch.column("ma").to_pylist(), batch.column("mb").to_pylist()):
                same = mb is None
                a = load(ma)
                b = a if same else load(mb)
                i, j = open_pair(a, b, percent, same)
                if len(i):
                    sa = np.array([x["s1"] for x in ma], np.int64)
                    sb = sa if same else np.array([x["s1"] for x in mb], np.int64)
                    up, down = _forest(sa[i], sb[j])
                    left.append(up), right.append(down)
            if left:
                yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(left), pa.int64()), "b": pa.array(np.concatenate(right), pa.int64())})

    def links(pairs: DataFrame, alone: DataFrame | None = None) -> DataFrame:
        left, right = (groups.select(F.col("g").alias(k), F.col("m").alias(f"m{k}")) for k in ("a", "b"))
        work = pairs.join(left, "a").join(right, "b").select("ma", "mb")
        if alone is not None:
            work = work.unionByName(alone.select(F.col("m").alias("ma"), F.lit(None).cast(groups.schema["m"].dataType).alias("mb")))
        return cut(work.mapInArrow(opened, "a long, b long"))

    first = found.where("kind = 1").select("a", "b").distinct()
    edges = links(first, groups.where(F.size("m") > 1))
    labels = cut(connected_components(edges))

    many = found.where("kind = 2").select(F.col("a").alias("t"), F.col("b").alias("g"), "r", "m")
    if many.limit(1).count():
        named = classes.join(labels.withColumnRenamed("node", "s1"), "s1", "left").groupBy("g").agg(F.min(F.coalesce("label", "s1")).alias("lo"), F.max(F.coalesce("label", "s1")).alias("hi"))
        # the label of a group that is in one component, else null
        many = cut(many.join(named, "g").select("t", "g", "r", "m", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("l")))
        # Tokens of one large component mostly have the same groups: those whose groups
        # mostly carry one label are taken together, so that a pair comes once, not per token.
        usual = many.groupBy("t", "l").agg(F.count("*").alias("c")).groupBy("t").agg(F.max_by("l", F.struct("c", "l")).alias("u"), F.max(F.when(F.col("l").isNotNull(), F.col("c")).otherwise(F.lit(0))).alias("c"), F.sum("c").alias("n"))
        usual = usual.select("t", "u", (F.col("u").isNotNull() & (2 * F.col("c") >= F.col("n"))).alias("most"))
        keyed = many.join(usual, "t").select(F.when(F.col("most"), F.col("u")).otherwise(F.col("t")).alias("k"), "most", "g", "r", "m", "l", (F.col("l").isNull() | F.col("u").isNull() | (F.col("l") != F.col("u"))).alias("odd"))
        keyed = cut(keyed.groupBy("k", "most", "g").agg(F.first("l").alias("l"), F.max("odd").alias("odd"), F.max("r").alias("r"), F.min("m").alias("m")))
        odd = keyed.where("odd").select("k", "most", F.col("g").alias("a"), F.col("l").alias("la"), F.col("r").alias("ra"), F.col("m").alias("na"))
        other = keyed.select("k", "most", F.col("g").alias("b"), F.col("l").alias("lb"), F.col("odd").alias("ob"), F.col("r").alias("rb"), F.col("m").alias("nb"))
        enough = F.lit(100 + percent) * F.least("ra", "rb") >= F.lit(percent) * (F.col("na") + F.col("nb"))
        rest = odd.join(other, ["k", "most"]).where("a <> b and (not ob or a < b) and (la is null or lb is null or la <> lb)").where(enough)
        rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
        more = links(rest)
        labels = cut(connected_components(edges.unionByName(more)))

    lows = classes.join(labels.withColumnRenamed("node", "s1"), "s1", "left").withColumn("label", F.coalesce("label", "s1"))
    least = lows.groupBy("label").agg(F.min("low").alias("component"))
    named = lows.select("s1", "label").distinct().join(least, "label").select("s1", "component")
    return rows.join(named, "s1", "left").select("_id", "_h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("_id")).alias("component"))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    from .embedding_dedup import _forest as forest

    return forest(a, b)


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = components(docs)
    null = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return got.select(null("_id").alias("doc_id"), "n_shingles", null("component").alias("component_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each component, the one of the smallest id (then text hash).

    Empty documents are components of their own and all stay.
    """
    got = components(docs, **how)
    best = got.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct("_id", "_h")).alias("k")).select(F.col("k._id").alias("_i"), F.col("k._h").alias("_g"))
    stay = best.unionByName(got.where("n_shingles = 0").select(F.col("_id").alias("_i"), F.col("_h").alias("_g")).distinct())
    copies = got.where("n_shingles > 0").groupBy(F.col("_id").alias("_i"), F.col("_h").alias("_g")).agg(F.count("*").alias("_c"))
    stay = stay.join(copies, ["_i", "_g"], "left").withColumn("_c", F.coalesce("_c", F.lit(1)))
    keyed = docs.select(id_of().alias("_id"), F.xxhash64("text").alias("_h"), F.struct("*").alias("_row"))
    kept = keyed.join(stay, (F.col("_id") == F.col("_i")) & (F.col("_h") == F.col("_g")))
    one = Window.partitionBy("_id", "_h").orderBy(F.lit(0))
    # only exact repeats of a row need a look at each other; they are few per row
    again = kept.where("_c > 1").withColumn("_k", F.row_number().over(one)).where("_k = 1")
    return kept.where("_c = 1").select("_row.*").unionByName(again.select("_row.*"))


OP10_SQL = """
with w as (select distinct coalesce(doc_id, 9223372036854775807) id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') ws from documents),
s as (select distinct id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [ws] else list_transform(range(1, len(ws) - 3), lambda p: ws[p:p + 4]) end) g from w),
n as (select id, count(*) n from s group by id),
i as (select a.id a, b.id b, count(*) c from s a join s b on a.g = b.g and a.id <> b.id group by all),
l as (select i.a, i.b from i join n x on x.id = i.a join n y on y.id = i.b where 100 * c >= 80 * (x.n + y.n - c)),
c as (with recursive t(a, b) as (select id, id from n union select t.a, l.b from t join l on l.a = t.b) select a, min(b) m from t group by a)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, coalesce(c.m, d.doc_id) component_id
from documents d left join n on n.id = d.doc_id left join c on c.a = d.doc_id
"""
