"""Language ID by Bayesian evidence fusion.

For each document, log-likelihoods are added for every language: of its text
(byte trigrams of the lower-cased text, tempered), of the language its markup
declares, of the suffix or first path part of its address, and the log of a host
prior.  The declared and address evidence use confusion tables P(seen | language)
and the priors use counts, all from grouped aggregation over every labelled row;
host priors are smoothed to their domain's, those to the suffix's, those to the
corpus's.  Evidence that says nothing about the language, in the labelled rows,
comes out flat and so changes nothing.  A class ``und`` with a uniform trigram
model takes texts that no language explains.

The trigram model alone is fitted on a sample of labelled rows: those whose id
hash falls below a threshold per language, so that about SAMPLE rows of each
language are expected.  A labelled row's own label is left out of its host prior.

Defined cases: texts that are null or under three bytes long have no text evidence and get
``und``; null or unknown declared language, address or host give no evidence
beyond the smoothed prior; every label is a language, one named ``und`` too (its texts
are kept, those that no language explains are not);
texts with no labelled row at all make every language set empty and every document
``und``; repeated rows are judged alike, and rows that differ in text, source or label
each by itself; of several pages of one id the one of greatest (host, suffix,
declared) counts as a whole; ties go to the alphabetically first language; an empty
table gives an empty table; other columns pass through ``keep_known``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, _SPACE, cut, get_array, id_of, put_arrays, shared_dir, slices, text_buffers

UND = "und"
BUCKETS = 1 << 15
SAMPLE = 1500  #: expected labelled rows per language for the trigram model
CLEAN = 0.5  #: least posterior of a kept document's language
TEMPER = 0.5  #: trigrams overlap and so repeat each other's evidence
SMOOTH, PRIOR_WEIGHT, UND_PRIOR = 1.0, 20.0, 1e-3


def grams(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that begins at each byte but the last two; runs of white space and digits count alike."""
    d = _LOWER[data].copy()
    d[_SPACE[d]] = 32
    d[(d >= 48) & (d <= 57)] = 48
    w = d.astype(np.uint32)
    x = (w[:-2] << np.uint32(16)) | (w[1:-1] << np.uint32(8)) | w[2:]
    return ((x * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def _text_grams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_buffers(column)
    for i, j in slices(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        g = grams(part) if len(part) > 2 else np.zeros(0, np.int64)
        yield i, j, g, at


def train_text(labelled: DataFrame, folder: str) -> dict[str, str]:
    """lang -> name of its array of log P(bucket | lang) in the shared folder, from (lang, text) rows.

    Counts are summed in Spark, and each language's array is made in a task; only names come back.
    """

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for i, j, g, at in _text_grams(batch.column("text")):
                for k in range(i, j):
                    part = g[at[k - i] : max(at[k - i], at[k - i + 1] - 2)]
                    if len(part):
                        total.setdefault(langs[k], np.zeros(BUCKETS, np.int64))
                        total[langs[k]] += np.bincount(part, minlength=BUCKETS)
        for lang, n in total.items():
            b = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(b), "b": b, "n": n[b]})

    def finish(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = np.zeros(BUCKETS)  # at most BUCKETS rows
        for batch in batches:
            v[batch.column("b").to_numpy()] = batch.column("n").to_numpy()
        v = np.log((v + 0.1) / (v.sum() + 0.1 * BUCKETS)).astype(np.float32)
        yield pa.RecordBatch.from_pydict({"lang": [key[0].as_py()], "name": [put_arrays(folder, {"ll": v})]})

    rows = labelled.select("lang", "text").mapInArrow(count, "lang string, b long, n long").groupBy("lang", "b").agg(F.sum("n").alias("n"))
    return {r.lang: r.name for r in rows.groupBy("lang").applyInArrow(finish, "lang string, name string").collect()}


def score_text(docs: DataFrame, keys: list[str], names: list[str], folder: str) -> DataFrame:
    """keys and ``ll``: the text's log-likelihood by each of the arrays ``names``, then of und; ``grams``: how many trigrams."""
    types, flat = dict(docs.dtypes), np.float32(-np.log(BUCKETS))

    def score(batches):
        tables = [get_array(folder, name, "ll") for name in names]  # mapped, not shipped
        for batch in batches:
            ll, n = np.zeros((batch.num_rows, len(tables) + 1)), np.zeros(batch.num_rows, np.int64)
            for i, j, g, at in _text_grams(batch.column("text")):
                n[i:j] = np.maximum(np.diff(at) - 2, 0)
                some = np.flatnonzero(n[i:j]) + i
                if not len(some):
                    continue
                edges = np.stack([at[some - i], at[some - i] + n[some]], axis=1).ravel()
                for k, table in enumerate(tables):
                    v = np.append(np.asarray(table)[g], np.float32(0)).astype(float)
                    ll[some, k] = np.add.reduceat(v, edges)[::2]
                ll[some, -1] = n[some] * float(flat)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ll.size + 1, ll.shape[1]), pa.int32()), pa.array(ll.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], lists, pa.array(n)], [*keys, "ll", "grams"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", ll array<double>, grams long"
    return docs.select(*keys, "text").mapInArrow(score, schema)


def declared_in(html: Column) -> Column:
    """The two-letter language of a page's ``<html lang=...>``, else null."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2})", 1)), F.lit(""))


def host_in(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"://([^/?#:]+)", 1)), F.lit(""))


def suffix_in(url: Column) -> Column:
    """Address suffix: a two-letter first path part if there is one, else the last host label."""
    path = F.nullif(F.lower(F.regexp_extract(url, r"://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1)), F.lit(""))
    return F.coalesce(F.concat(F.lit("/"), path), F.concat(F.lit("."), F.nullif(F.regexp_extract(host_in(url), r"\.([a-z]+)$", 1), F.lit(""))))


def _levels(df: DataFrame) -> DataFrame:
    """Adds the host's parents: domain (last two labels) and suffix (last label)."""
    return df.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("tail", F.substring_index("host", ".", -1))


def _counts(labelled: DataFrame, langs: list[str]) -> list:
    return [F.sum((F.col("label") == k).cast("long")).alias(f"n{i}") for i, k in enumerate(langs)] + [F.count("*").alias("n")]


def _with_prior(scored: DataFrame, labelled: DataFrame, total, langs: list[str]) -> DataFrame:
    """Adds ``prior`` (an array by langs): the counts of the row's host, smoothed to those of
    its domain, these to the suffix's and these to the corpus's; its own label is not counted."""
    out = scored.withColumn("own", F.array(*[F.coalesce((F.col("label") == k).cast("long"), F.lit(0)) for k in langs]))
    prior = F.array(*[F.lit(1 / len(langs))] * len(langs))
    seen, all_ = F.array(*[F.lit(int(total[f"n{i}"] or 0)) for i in range(len(langs))]), F.lit(int(total["n"]))
    mine = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x)
    for key in (None, "tail", "domain", "host"):
        if key:
            counts = labelled.groupBy(key).agg(*_counts(labelled, langs))
            out = out.join(counts.select(key, F.array(*[F.col(f"n{i}") for i in range(len(langs))]).alias(f"seen_{key}"), F.col("n").alias(f"n_{key}")), key, "left")
            seen, all_ = F.coalesce(f"seen_{key}", F.array(*[F.lit(0).cast("long")] * len(langs))), F.coalesce(f"n_{key}", mine)
        out = out.withColumn("prior", F.transform(F.arrays_zip(seen.alias("s"), F.col("own").alias("o"), prior.alias("p")), lambda z: z["s"] - z["o"] + PRIOR_WEIGHT * z["p"]))
        out = out.withColumn("prior", F.transform("prior", lambda x: x / (all_ - mine + PRIOR_WEIGHT)))
        prior = F.col("prior")
    return out


def _confusion(labelled: DataFrame, seen: str, langs: list[str]) -> DataFrame:
    """seen and an array by langs: log of P(seen | lang) over P(seen), smoothed."""
    known = labelled.where(F.col(seen).isNotNull())
    total = known.agg(*_counts(known, langs)).first()
    base = F.col("n") / F.lit(total["n"])
    ratio = F.array(*[F.log((F.col(f"n{i}") + SMOOTH * base) / (((total[f"n{i}"] or 0) + SMOOTH) * base)) for i in range(len(langs))])
    return known.groupBy(seen).agg(*_counts(known, langs)).select(seen, ratio.alias(f"{seen}_ll"))


def page_facts(pages: DataFrame) -> DataFrame:
    """Evidence (key, declared, suffix, host) of pages, by page_id."""
    known = pages.where(F.col("page_id").isNotNull())
    page = F.struct(host_in(F.col("url")).alias("host"), suffix_in(F.col("url")).alias("suffix"), declared_in(F.col("html")).alias("declared"))
    return known.groupBy(F.col("page_id").cast("long").alias("key")).agg(F.max(page).alias("p")).select("key", "p.declared", "p.suffix", "p.host")


def row_hash(label: str = "lang") -> Column:
    """A hash of what a row is judged by besides its id."""
    return F.xxhash64("text", "source", label)


def identify(docs: DataFrame, facts: DataFrame | None = None, key: str = "doc_id", label: str = "lang", sample: int = SAMPLE, clean: float = CLEAN) -> DataFrame:
    """(_id, _h, found, posterior, kept) for each row: its id, hash (``row_hash``), language and decision.

    docs: key, text, label (null where unknown) and source, the host of documents
    without a page; facts: (key, declared, suffix, host), at most a row per key.
    """
    base = docs.select(id_of(key).alias("_id"), row_hash(label).alias("_h"), F.col("text"), F.col(label).alias("label"), F.col("source"))
    counted = base.where(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("n"))
    sizes = {r.label: r.n for r in counted.collect()}  # a row per language
    shares = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))]) if sizes else None
    share = F.element_at(shares, F.col("label")) if sizes else F.lit(0.0)
    draw = F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1 << 20)) / float(1 << 20)
    folder = shared_dir(docs.sparkSession)
    model = train_text(base.where(F.col("label").isNotNull() & (draw < share)).select(F.col("label").alias("lang"), "text"), folder) if sizes else {}
    langs = sorted(model)
    if not langs:
        return base.select("_id", "_h", F.lit(UND).alias("found"), F.lit(1.0).alias("posterior"), F.lit(False).alias("kept"))

    scored = score_text(base, ["_id", "_h", "label", "source"], [model[k] for k in langs], folder)
    if facts is None:
        none = F.lit(None).cast("string")
        scored = scored.select("*", none.alias("declared"), none.alias("suffix"), F.coalesce("source", F.lit("(none)")).alias("host"))
    else:
        facts = facts.select(F.col("key").alias("_key"), "declared", "suffix", F.col("host").alias("_host"))
        scored = scored.join(facts, F.col("_id") == F.col("_key"), "left").withColumn("host", F.coalesce("_host", "source", F.lit("(none)"))).drop("_key", "_host")
    scored = scored.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("tail", F.substring_index("host", ".", -1))
    scored = cut(scored)
    labelled = scored.where(F.col("label").isNotNull()).select("label", "declared", "suffix", "host", "domain", "tail")
    total = labelled.agg(*_counts(labelled, langs)).first()
    scored = _with_prior(scored, labelled, total, langs)
    for seen in ("declared", "suffix"):
        scored = scored.join(_confusion(labelled, seen, langs), seen, "left")
    score = [
        F.get("ll", F.lit(i)) * TEMPER + F.log(F.get("prior", F.lit(i)) * (1 - UND_PRIOR)) + F.coalesce(F.get("declared_ll", F.lit(i)), F.lit(0.0)) + F.coalesce(F.get("suffix_ll", F.lit(i)), F.lit(0.0))
        for i in range(len(langs))
    ] + [F.get("ll", F.lit(len(langs))) * TEMPER + float(np.log(UND_PRIOR))]
    scored = scored.withColumn("s", F.array(*score)).withColumn("m", F.array_max("s"))
    place = (F.array_position("s", F.col("m")) - 1).cast("int")
    best = F.get(F.array(*[F.lit(k) for k in [*langs, UND]]), place)
    posterior = 1 / F.aggregate(F.transform("s", lambda x: F.exp(x - F.col("m"))), F.lit(0.0), lambda a, x: a + x)
    found = F.when(F.col("grams") > 0, best).otherwise(F.lit(UND))
    told = (F.col("grams") > 0) & (place < len(langs))  # by place: a language may itself be labelled ``und``
    out = scored.select("_id", "_h", found.alias("found"), posterior.alias("posterior"), told.alias("_told"))
    return out.withColumn("kept", F.col("_told") & (F.col("posterior") >= clean)).drop("_told")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Pages give the documents of their id their markup, address and host evidence."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = identify(docs, page_facts(pages))
    return out.select(F.nullif("_id", F.lit(2**63 - 1)).alias("doc_id"), F.col("found").alias("lang"), F.round("posterior", 6).alias("posterior"), "kept")


def keep_known(docs: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows that language ID rejects, ``lang`` replaced by the language found."""
    found = identify(docs, facts).where("kept").select(F.col("_id").alias("_i"), F.col("_h").alias("_g"), "found").distinct()
    keyed = docs.select(id_of().alias("_id"), row_hash().alias("_h"), F.struct("*").alias("_row"))
    kept = keyed.join(found, (F.col("_id") == F.col("_i")) & (F.col("_h") == F.col("_g")))
    return kept.select(*[F.col("found").alias(c) if c == "lang" else F.col("_row")[c].alias(c) for c in docs.columns])
