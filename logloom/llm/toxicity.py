"""Toxicity by a counterfactual-regularised classifier.

Features are the words of the lower-cased text and their beginnings of PREFIXES
bytes (present or not), so that a slur is known in its compounds and inflections:
those features whose share differs between toxic and other labelled texts by more
than chance over all tried (G-test at about one expected chance find).  Spark's
logistic regression is fitted on labelled rows and on counterfactual pairs: a
labelled text that names a group (IDENTITY) gets its identity terms swapped for
others of the same kind, and the difference of the two feature vectors, without
the intercept, enters once under each label.  The loss of such a couple is a
symmetric, convex function of the change of the logit, least at no change, so
weights that tell groups apart are penalised by PAIR_WEIGHT, and what is toxic has
to be told by the other words.

The classifier is fitted on a bounded sample: about SAMPLE labelled rows of each
label, by hash of their id, weighted by the inverse of their rate; it has FEATURES
features at most, the most telling first.  Near copies among them (the same least
hash of five-word windows) count as one row, with the label of their majority.
Scoring covers whole texts of all rows.

Defined cases: a null or empty text has no features and its score is the
intercept's; labels that are null count as none, and of several labels of one id
the greatest counts; of several texts of one id the one of smallest hash trains; a
null id is never held out and has no label; repeated rows score alike; without
labels every score is 0, and with labels of one kind alone the smoothed share;
columns other than those named are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, _SPACE, U64, Hasher, Words, cut, mixed, slices, text_buffers

SAMPLE, FEATURES, MIN_DOCS = 20_000, 1 << 16, 4
PREFIXES = (4, 5, 6, 7)
RIDGE, PAIR_WEIGHT, SWAPS = 0.3, 5.0, 2
THRESHOLD = 0.3

#: Identity terms by kind: only terms of one kind are swapped for each other.
IDENTITY = {
    "religion, en": "atheist buddhist catholic christian hindu jew jewish muslim protestant sikh".split(),
    "origin, en": "african american arab asian black chinese european indian japanese latino mexican white".split(),
    "people, en": "africans americans arabs asians chinese europeans foreigners immigrants indians mexicans refugees".split(),
    "orientation, en": "bisexual gay heterosexual homosexual lesbian queer straight transgender".split(),
    "gender, en": "female male nonbinary trans".split(),
    "person, en": "boy girl man woman".split(),
    "persons, en": "boys girls men women".split(),
    "body, en": "blind deaf disabled elderly paralyzed".split(),
    "religion, de": "atheist buddhist christ hindu jude katholik muslim protestant".split(),
    "people, de": "afrikaner amerikaner araber asiaten ausländer europäer flüchtlinge".split(),
    "persons, de": "frauen jungen mädchen männer".split(),
    "orientation, de": "bisexuell hetero homosexuell lesbisch schwul trans".split(),
    "religion, fr": "athée bouddhiste catholique chrétien hindou juif musulman protestant".split(),
    "people, fr": "africains américains arabes asiatiques européens immigrés réfugiés étrangers".split(),
    "persons, fr": "femmes filles garçons hommes".split(),
    "religion, es": "ateo budista católico cristiano hindú judío musulmán protestante".split(),
    "people, es": "africanos americanos asiáticos europeos extranjeros inmigrantes refugiados árabes".split(),
    "persons, es": "hombres mujeres niñas niños".split(),
}

#: Bytes of words: letters and digits, and all of UTF-8's longer characters.
_WORD = np.where([chr(b).isalnum() or b > 127 for b in range(256)], _LOWER, np.uint8(32)).astype(np.uint8)
_WORD[_SPACE] = 32


def _slices(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    data, offsets = text_buffers(column)
    data = _WORD[data]
    for i, j in slices(offsets):
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


class Features:
    """Hashes of the words of texts and of the words' beginnings."""

    def __init__(self):
        self.hasher = Hasher(11)

    def of(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash), with repeats."""
        word = np.repeat(np.arange(len(w.counts)), w.counts)
        texts, hashes = [word], [self.hasher.words(w.data, w.starts, w.ends)]
        for n in PREFIXES:
            longer = np.flatnonzero(w.ends - w.starts > n)
            starts = w.starts[longer]
            texts.append(word[longer]), hashes.append(mixed(self.hasher.words(w.data, starts, starts + n)))  # mixed again: a beginning is not a word
        return np.concatenate(texts), np.concatenate(hashes)

    def found(self, w: Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, place in the sorted vocabulary) of the distinct features that the vocabulary has."""
        if not len(vocabulary):
            return (np.zeros(0, np.int64),) * 2
        text, h = self.of(w)
        place = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        hit = np.flatnonzero(vocabulary[place] == h)
        both = np.unique(text[hit] * len(vocabulary) + place[hit])
        return both // len(vocabulary), both % len(vocabulary)


def swapped(text: str, turn: int, kinds: dict[str, list[str]] = IDENTITY) -> str:
    """``text`` (lower case) with each identity term replaced by the one ``turn`` places on in its kind."""
    other = {}
    for terms in kinds.values():
        for j, term in enumerate(terms):
            other.setdefault(term, terms[(j + 1 + turn % (len(terms) - 1)) % len(terms)])
    return re.sub(r"\w+", lambda m: other.get(m[0], m[0]), text)


# ---------------------------------------------------------------- the sample


def sample_of(docs: DataFrame, labels: DataFrame, trains: Column, size: int) -> tuple[DataFrame, dict[int, float]]:
    """((doc_id, toxic, text) that the classifier learns from, lower-cased; label -> rate of the sample)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).where(trains)
    rates = {r.toxic: min(1.0, size / r.n) for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = F.when(F.col("toxic") == 1, rates.get(1, 0.0)).otherwise(rates.get(0, 0.0))
    chosen = cut(known.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(2**31)) < rate * 2**31))  # about 2 * size rows
    texts = docs.where("text is not null").join(chosen, "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return texts.withColumn("text", F.lower("text")), rates


def without_copies(sample: DataFrame) -> DataFrame:
    """One row of each set of near copies, labelled as most of them are."""
    hasher = Hasher(13)

    def sign(batches):
        for batch in batches:
            least = np.zeros(batch.num_rows, np.int64)
            for i, j, w in _slices(batch.column("text")):
                words = hasher.words(w.data, w.starts, w.ends)
                for size in (5, 1):  # texts without a window of five are told by their least word
                    at, text = w.windows(size)
                    head = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(at) else np.zeros(0, np.int64)
                    if len(head):
                        low = np.minimum.reduceat(hasher.windows(words, at, size), head).view(np.int64)
                        rows = text[head] + i
                        least[rows] = np.where(least[rows] == 0, low, least[rows])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(least)], ["doc_id", "toxic", "sign"])

    signed = sample.mapInArrow(sign, "doc_id long, toxic int, sign long")
    first = signed.groupBy("sign").agg(F.min("doc_id").alias("doc_id"), (F.avg("toxic") >= 0.5).cast("int").alias("label"))
    return sample.join(first.select("doc_id", "label"), "doc_id").select("doc_id", F.col("label").alias("toxic"), "text")


# ---------------------------------------------------------------- features and weights


def telling(sample: DataFrame, most: int = FEATURES, least: int = MIN_DOCS) -> np.ndarray:
    """Sorted hashes of the features whose presence tells the labels apart."""

    def count(batches):
        made = Features()
        for batch in batches:
            label = batch.column("toxic").to_numpy()
            for i, j, w in _slices(batch.column("text")):
                text, h = made.of(w)
                order = np.lexsort((text, h))
                text, h = text[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                text, h = text[new], h[new]
                head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                if len(head):
                    toxic = np.add.reduceat(label[text + i].astype(np.int64), head)
                    yield pa.RecordBatch.from_pydict({"h": h[head].view(np.int64), "toxic": toxic, "n": np.diff(np.append(head, len(h)))})

    counts = sample.mapInArrow(count, "h long, toxic long, n long").groupBy("h").agg(F.sum("toxic").alias("a"), F.sum("n").alias("n"))
    counts = cut(counts.where(F.col("n") >= least))
    total = sample.agg(F.sum("toxic"), F.count("*")).first()
    rows, tried = (float(total[0]), float(total[1] - total[0])), max(2, counts.count())
    a, b = F.col("a").cast("double"), (F.col("n") - F.col("a")).cast("double")
    part = lambda seen, of: F.when(seen > 0, seen * F.log(seen / of)).otherwise(0.0)
    share = F.col("n") / F.lit(sum(rows))
    g = 2 * sum((part(x, share * n) + part(F.lit(n) - x, (1 - share) * n) for x, n in zip((a, b), rows)), F.lit(0.0))
    best = counts.withColumn("g", g).where(F.col("g") >= 2 * np.log(tried)).orderBy(F.desc("g"), "h").limit(most)
    return np.sort(np.array([r.h for r in best.select("h").collect()], np.int64).view(U64))


def training_rows(sample: DataFrame, vocabulary: np.ndarray, rates: dict[int, float], pair_weight: float, swaps: int = SWAPS, kinds: dict[str, list[str]] = IDENTITY) -> DataFrame:
    """(label, weight, at, value): labelled rows with an intercept as last feature, and counterfactual pairs without."""
    n = len(vocabulary)
    named = re.compile(r"\b(?:" + "|".join(sorted({re.escape(t) for terms in kinds.values() for t in terms})) + r")\b")

    def rows(batches):
        made = Features()

        def of(texts: pa.Array) -> list[np.ndarray]:
            out: list[np.ndarray] = []
            for i, j, w in _slices(texts):
                text, place = made.found(w, vocabulary)
                out += np.split(place, np.searchsorted(text, np.arange(1, j - i)))
            return out

        for batch in batches:
            own, label = of(batch.column("text")), batch.column("toxic").to_pylist()
            out = [(float(y), 1 / rates[y], [*f.tolist(), n], [1.0] * (len(f) + 1)) for f, y in zip(own, label)]
            texts = batch.column("text").to_pylist() if pair_weight else []
            for turn in range(swaps):
                some = [k for k, t in enumerate(texts) if named.search(t)]
                if not some:
                    break
                other = of(pa.array([swapped(texts[k], batch.column("doc_id")[k].as_py() + turn, kinds) for k in some]))
                for k, f in zip(some, other):
                    lost, won = np.setdiff1d(own[k], f), np.setdiff1d(f, own[k])
                    at = np.concatenate([lost, won])
                    if len(at):
                        order, value = np.argsort(at), np.repeat([1.0, -1.0], [len(lost), len(won)])
                        out += [(y, pair_weight / rates[label[k]] / swaps, at[order].tolist(), value[order].tolist()) for y in (0.0, 1.0)]
            yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for c, v, t in zip(("label", "weight", "at", "value"), zip(*out), (pa.float64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64())))}) if out else _NONE

    return sample.mapInArrow(rows, ROW)


ROW = "label double, weight double, at array<int>, value array<double>"
_NONE = pa.RecordBatch.from_pydict({c: pa.array([], t) for c, t in zip(("label", "weight", "at", "value"), (pa.float64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64())))})


class Model:
    """Weights of a sorted vocabulary of feature hashes, and an intercept."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, intercept: float):
        self.vocabulary, self.weights, self.intercept = vocabulary, weights, intercept

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probabilities of label 1, for lower-cased texts."""
        made, out = Features(), np.full(len(texts), self.intercept)
        for i, j, w in _slices(texts):
            text, place = made.found(w, self.vocabulary)
            out[i:j] += np.bincount(text, self.weights[place], minlength=j - i)
        return 1 / (1 + np.exp(-out))


def fit(docs: DataFrame, labels: DataFrame, trains: Column | None = None, sample: int = SAMPLE, features: int = FEATURES, pair_weight: float = PAIR_WEIGHT, kinds: dict[str, list[str]] = IDENTITY) -> Model:
    """The classifier for (doc_id, text) and (doc_id, toxic); ``trains`` is a condition on doc_id."""
    rows, rates = sample_of(docs, labels, F.lit(True) if trains is None else trains, sample)
    rows = cut(without_copies(cut(rows)))
    seen = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:  # nothing to tell apart
        share = (seen.get(1, 0) + 0.5) / (sum(seen.values()) + 1)
        return Model(np.zeros(0, U64), np.zeros(0), np.log(share / (1 - share)) if seen else -np.inf)
    rates = {y: rates.get(y, 1.0) for y in (0, 1)}
    vocabulary = telling(rows, features)
    size = len(vocabulary) + 1

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    vector = F.udf(lambda at, value: Vectors.sparse(size, at, value), VectorUDT())  # of the bounded sample only
    blank = rows.sparkSession.createDataFrame([(y, 1.0, [], []) for y in (0.0, 1.0)], ROW)  # no effect but that the intercept's feature varies, or Spark drops it
    table = cut(training_rows(rows, vocabulary, rates, pair_weight, kinds=kinds).unionByName(blank)).select("label", "weight", vector("at", "value").alias("features"))
    ridge = RIDGE / sum(n / rates[y] for y, n in seen.items())
    fitted = LogisticRegression(weightCol="weight", fitIntercept=False, standardization=False, regParam=ridge, maxIter=60, tol=1e-6).fit(table)
    weights = fitted.coefficients.toArray()
    return Model(vocabulary, weights[:-1], float(weights[-1]))


def score(docs: DataFrame, model: Model, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns of each row, ``score`` and ``predicted``, from its whole text."""

    def run(batches):
        for batch in batches:
            s = model.scores(batch.column("_text"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    types = dict(docs.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in keep) + "score double, predicted int"
    return docs.select(*keep, F.lower("text").alias("_text")).mapInArrow(run, schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels, ~held_out())
    return score(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])
