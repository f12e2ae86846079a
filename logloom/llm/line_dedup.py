"""Line dedup over overlapping three-line windows (DataFrame functions only).

Lines are split at ``\\n``.  Each run of three consecutive lines of a document is
a window.  Windows whose lines repeat anywhere in the corpus are found by one
grouped minimum; every occurrence but the first (by doc_id, then position) marks
its three positions, marked positions merge, and the marked lines are removed.

Defined cases: a null text stays null with no lines; a text of fewer than three lines is
never changed; lines of spaces only count as equal, and windows of such lines alone
are ignored unless ``blank`` asks for them; a null doc_id ranks
after all ids; exact repeats of a row are judged as one and get one result; an
empty table gives an empty table; other columns pass through, whatever their
names, except that ``text`` is replaced (and ``n_lines``, ``n_removed`` where
asked for).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_of

WINDOW = 3


def _keys(docs: DataFrame) -> DataFrame:
    return docs.select(id_of().alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"), F.struct("*").alias("_row"))


def repeated_positions(docs: DataFrame, window: int = WINDOW, blank: bool = False) -> DataFrame:
    """(_id, _h, _cover): the starts of the windows that are later occurrences."""
    keyed = docs.where(F.col("text").isNotNull()).select(id_of().alias("_id"), F.xxhash64("text").alias("_h"), F.split("text", "\n", -1).alias("l"))
    hashed = keyed.select("_id", "_h", F.size("l").alias("n"), F.transform("l", lambda x: F.when(F.trim(x) == "", F.lit("") if blank else F.lit(None)).otherwise(x)).alias("l"))
    hashed = hashed.where(F.col("n") >= window)
    starts = F.sequence(F.lit(1), F.col("n") - (window - 1))
    pairs = F.transform(
        starts,
        lambda i: F.when(
            F.coalesce(*[F.get("l", i + (k - 1)) for k in range(window)]).isNotNull(),
            F.struct(
                F.xxhash64(*[F.coalesce(F.get("l", i + (k - 1)), F.lit("")) for k in range(window)]).alias("w1"),
                F.xxhash64(F.lit(7), *[F.coalesce(F.get("l", i + (k - 1)), F.lit("")) for k in range(window)]).alias("w2"),
                i.cast("int").alias("p"),
            ),
        ),
    )
    windows = hashed.select("_id", "_h", F.explode(pairs).alias("x")).where("x is not null").select("x.w1", "x.w2", "_id", "_h", "x.p")
    first = windows.groupBy("w1", "w2").agg(F.min(F.struct("_id", "_h", "p")).alias("first"), F.count("*").alias("c")).where("c > 1")
    later = windows.join(first.select("w1", "w2", "first"), ["w1", "w2"]).where(F.struct("_id", "_h", "p") > F.col("first"))
    return later.groupBy("_id", "_h").agg(F.collect_set("p").alias("_cover"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, counts: bool = False, blank: bool = False) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines; ``counts`` adds n_lines and n_removed."""
    cover = repeated_positions(docs, window, blank).withColumnsRenamed({"_id": "_cid", "_h": "_ch"})
    keyed = _keys(docs)
    joined = keyed.join(cover, (keyed["_id"] == cover["_cid"]) & (keyed["_h"] == cover["_ch"]), "left")
    text = F.col("_row.text")
    lines = F.split(text, "\n", -1)
    covered = F.array_distinct(F.flatten(F.transform("_cover", lambda p: F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda k: p + k))))
    kept = F.array_except(F.sequence(F.lit(1), F.size(lines)), covered)
    parts = joined.select("_row", "_cover", F.when(F.col("_cover").isNotNull(), lines).alias("_l"), F.when(F.col("_cover").isNotNull(), kept).alias("_k"))
    # Both arrays are named twice: an expression used once would be put into the lambda, and the text split once per line.
    new_text = F.when(F.col("_cover").isNull() | (F.size("_l") == F.size("_k")), text).otherwise(F.array_join(F.transform("_k", lambda i: F.get("_l", i - 1)), "\n"))
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    out = [new_text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns if not (counts and c in ("n_lines", "n_removed"))]
    if counts:
        out += [n_lines.cast("long").alias("n_lines"), F.when(F.col("_cover").isNull(), F.lit(0)).otherwise(F.size("_l") - F.size("_k")).cast("long").alias("n_removed")]
    return parts.select(*out)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, counts=True).select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


OP4_SQL = """
with l as (select coalesce(doc_id, 9223372036854775807) id, md5(coalesce(text, '')) h, string_split(text, chr(10)) ls from (select distinct doc_id, text from documents where text is not null)),
w as (select id, h, unnest(range(1, len(ls) - 1)) p, ls from l where len(ls) >= 3),
v as (select id, h, p, list_transform([ls[p], ls[p + 1], ls[p + 2]], lambda x: case when trim(x, ' ') = '' then '' else x end) t from w where trim(ls[p], ' ') <> '' or trim(ls[p + 1], ' ') <> '' or trim(ls[p + 2], ' ') <> ''),
f as (select *, row_number() over (partition by t order by id, h, p) r from v),
c as (select distinct id, h, unnest([p, p + 1, p + 2]) q from f where r > 1),
x as (select id, h, unnest(ls) s, unnest(range(1, len(ls) + 1)) q from l),
k as (select x.id, x.h, count(*) n, count(c.q) d, string_agg(case when c.q is null then x.s end, chr(10) order by x.q) t from x left join c on c.id = x.id and c.h = x.h and c.q = x.q group by 1, 2)
select d.doc_id, coalesce(k.n, 0) n_lines, coalesce(k.d, 0) n_removed, sha256(coalesce(k.t, '')) kept_sha256
from documents d left join k on k.id = coalesce(d.doc_id, 9223372036854775807) and k.h = md5(coalesce(d.text, ''))
"""
