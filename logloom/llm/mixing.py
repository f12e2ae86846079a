"""Mixing sources to target weights by hierarchical budgeting.

A tree domain -> language -> source carries an integer weight on each node.  A
budget of tokens flows down: each node gives its children budgets in proportion
to their weights, never more than a child's subtree can supply (its tokens times
``epochs``); what a short child cannot use goes to its siblings, and only what
the whole subtree cannot use goes back to the parent's siblings.  Each leaf then
takes the prefix, by tokens, of a seeded order of its documents: whole epochs
first, each with an order of its own, then the prefix of one more.

Only counts per leaf and per (leaf, bucket of the order) are shuffled, and the
decision comes down to one threshold of the order per leaf, so no leaf, however
large, meets in one task.

Defined cases: null lang or source count as ``(none)``; a null text has no
tokens; documents without tokens are in an epoch as soon as the order reaches
them; rows with the same doc_id travel together (null ids count as one id); an
empty table gives an empty table; a node of weight 0 gets nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_of

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096

#: The production tree: what is not named has weight DEFAULT.
DOMAINS = {"web": ["src0", "src1", "src2", "src3", "src4"], "books": ["src5", "src6", "src7", "src8", "src9"], "forums": ["src10", "src11", "src12", "src13", "src14"]}
DOMAIN_WEIGHTS = {"web": 40, "books": 30, "forums": 20, "other": 10}
LANG_WEIGHTS = {"en": 50, "de": 20, "fr": 20, "es": 10}
SOURCE_WEIGHTS = {"src0": 3}
DEFAULT = 1
SEED, EPOCHS, PART = 17, 2, (3, 4)  # the budget: 3/4 of the tokens there are


def _weight(col: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(DEFAULT)
    for name, w in weights.items():
        out = F.when(F.col(col) == name, F.lit(w)).otherwise(out)
    return out.cast("double")


def _domain(domains: Mapping[str, list[str]]) -> Column:
    out = F.lit("other")
    for name, sources in domains.items():
        out = F.when(F.col("_source").isin(sources), F.lit(name)).otherwise(out)
    return out


def _order(seed: int, epoch: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col("_id").cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Fill siblings to one level: budget min(cap, w * level), with the level that spends B.

    The level is the largest (B - caps of the k first) / (weights of the rest)
    with siblings in order of cap / w, a sum over the siblings only.
    """
    nodes = nodes.where("w > 0")
    by = Window.partitionBy(*parent)
    before = by.orderBy(F.col("cap") / F.col("w"), name).rowsBetween(Window.unboundedPreceding, -1)
    rest = by.orderBy(F.col("cap") / F.col("w"), name).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("B") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    return nodes.withColumn("_level", level).withColumn("_level", F.max("_level").over(by)).withColumn("B", F.least("cap", F.col("w") * F.col("_level"))).drop("_level")


def leaf_budgets(leaves: DataFrame, budget: float, domain_weights=None, lang_weights=None, source_weights=None, epochs: int = EPOCHS) -> DataFrame:
    """Budgets in tokens of (domain, lang, source, tokens)."""
    leaves = leaves.withColumn("cap", F.col("tokens").cast("double") * epochs)
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("w", _weight("domain", domain_weights or {}))
    domains = _share(domains.withColumn("B", F.lit(float(budget))), ["B"], "domain").select("domain", "B")
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("w", _weight("lang", lang_weights or {}))
    langs = _share(langs.join(domains, "domain"), ["domain"], "lang").select("domain", "lang", "B")
    sources = leaves.withColumn("w", _weight("source", source_weights or {})).join(langs, ["domain", "lang"])
    return _share(sources, ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", "B")


def mix(
    docs: DataFrame,
    part: tuple[int, int] = PART,
    domains: Mapping[str, list[str]] = DOMAINS,
    domain_weights: Mapping[str, int] = DOMAIN_WEIGHTS,
    lang_weights: Mapping[str, int] = LANG_WEIGHTS,
    source_weights: Mapping[str, int] = SOURCE_WEIGHTS,
    seed: int = SEED,
    epochs: int = EPOCHS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Struct ``row`` of each chosen row with ``domain``, ``lang``, ``source``, ``tokens`` and ``epoch``.

    ``keep`` names the columns of ``row``, short ones: they are carried with the counts, and texts are read once.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("row"), id_of().alias("_id"), F.coalesce("lang", F.lit("(none)")).alias("lang"), F.coalesce("source", F.lit("(none)")).alias("_source"), "text")
    keyed = keyed.withColumn("domain", _domain(domains)).withColumnRenamed("_source", "source")
    counted = cut(keyed.select("_id", "domain", "lang", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"), *([] if keep is None else ["row"])))
    leaf = ["domain", "lang", "source"]
    leaves = counted.groupBy(*leaf).agg(F.sum("tokens").alias("tokens"))
    budget = float(counted.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] * part[0] // part[1])
    plan = leaf_budgets(leaves, budget, domain_weights, lang_weights, source_weights, epochs)
    full = F.when(F.col("tokens") > 0, F.floor(F.col("B") / F.col("tokens"))).otherwise(F.lit(0)).cast("long")
    plan = cut(plan.select(*leaf, full.alias("whole"), (F.col("B") - full * F.col("tokens")).alias("rest")))

    ordered = counted.drop("row").join(plan, leaf).withColumn("o", _order(seed, F.col("whole"))).withColumn("b", F.shiftright("o", 48))
    bins = ordered.groupBy(*leaf, "b").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
    run = Window.partitionBy(*leaf).orderBy("b")  # at most BUCKETS rows of a leaf
    bins = bins.withColumn("end", F.sum("t").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    edge = bins.where(F.col("end") > F.col("rest")).groupBy(*leaf).agg(F.min("b").alias("b"), F.min_by(F.col("end") - F.col("t"), "b").alias("base"))
    inside = ordered.join(edge, [*leaf, "b"]).groupBy(*leaf, "o").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"), F.first("base").alias("base"))
    last = F.col("base") + F.sum("t").over(Window.partitionBy(*leaf).orderBy("o").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("end", last)
    limit = edge.select(*leaf, F.shiftleft("b", 48).alias("below")).join(inside.where(F.col("end") <= F.col("rest")).groupBy(*leaf).agg(F.max("o").alias("upto")), leaf, "left")
    # documents of the last epoch: order < below, or <= upto; without an edge the whole epoch fits
    limits = plan.join(limit, leaf, "left").select(*leaf, "whole", F.coalesce("upto", F.col("below") - 1, F.lit(2**63 - 1)).alias("upto"))
    limits = cut(limits)
    picked = (keyed if keep is None else counted).join(limits, leaf).withColumn("o", _order(seed, F.col("whole")))
    times = F.col("whole") + F.when(F.col("o") <= F.col("upto"), F.lit(1)).otherwise(F.lit(0))
    times = F.least(times, F.lit(epochs).cast("long"))
    picked = picked.withColumn("_times", times).where("_times > 0")
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long") if keep is None else F.col("tokens")
    return picked.select("row", *leaf, tokens.alias("tokens"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)).alias("epoch"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The chosen rows as rows of ``docs`` (a row once per epoch that takes it)."""
    return mix(docs, **how).select("row.*")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mix(docs, keep=["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "domain", "lang", "source", "tokens", "epoch")


def _case(col: str, weights: Mapping[str, int]) -> str:
    return "case " + col + "".join(f" when '{k}' then {v}" for k, v in weights.items()) + f" else {DEFAULT} end::double"


def _fill(parent: str, name: str) -> str:
    order = f"partition by {parent} order by cap / w, {name}"
    return f"least(cap, w * max(lv) over (partition by {parent})) bb from (select *, (b - coalesce(sum(cap) over ({order} rows between unbounded preceding and 1 preceding), 0)) / sum(w) over ({order} rows between current row and unbounded following) lv"


OP7_SQL = f"""
with d as (select doc_id, coalesce(doc_id, 9223372036854775807) id, coalesce(lang, '(none)') lang, coalesce(source, '(none)') source,
  case {" ".join(f"when source in ({', '.join(repr(s) for s in v)}) then '{k}'" for k, v in DOMAINS.items())} else 'other' end domain,
  len(regexp_extract_all(coalesce(text, ''), '{WORD}')) tokens from documents),
l as (select domain, lang, source, sum(tokens)::bigint tokens, sum(tokens)::double * {EPOCHS} cap from d group by all),
n1 as (select domain, sum(cap) cap, {_case('domain', DOMAIN_WEIGHTS)} w, floor((select sum(tokens) from l)::double * {PART[0]} / {PART[1]}) b from l group by domain),
m1 as (select domain, {_fill('b', 'domain')} from n1)),
n2 as (select domain, lang, sum(cap) cap, {_case('lang', LANG_WEIGHTS)} w, any_value(bb) b from l join m1 using (domain) group by domain, lang),
m2 as (select domain, lang, {_fill('domain', 'lang')} from n2)),
n3 as (select domain, lang, source, tokens, cap, {_case('source', SOURCE_WEIGHTS)} w, bb b from l join m2 using (domain, lang)),
m3 as (select domain, lang, source, tokens, {_fill('domain, lang', 'source')} from n3)),
p as (select domain, lang, source, case when tokens > 0 then floor(bb / tokens) else 0 end::bigint whole, bb - whole * tokens rest from m3),
o as (select d.*, whole, rest, ('0x' || substr(md5('{SEED}:' || whole::varchar || ':' || id::varchar), 1, 15))::bigint o from d join p using (domain, lang, source)),
c as (select *, sum(tokens) over (partition by domain, lang, source order by o range unbounded preceding) e from o),
t as (select *, least(whole + case when e <= rest then 1 else 0 end, {EPOCHS}) times from c)
select doc_id, domain, lang, source, tokens::bigint tokens, unnest(range(times)) epoch from t
"""
