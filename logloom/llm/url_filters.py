"""URL filters: fixed host/path rules, then association rules mined from labelled URLs.

The method: the tokens of each labelled URL and its label make a transaction;
Spark's FP-growth mines the frequent combinations; those that hold the label
``block`` with enough confidence and support become rules if their share of blocked
URLs lies above that of all labelled URLs by more than chance over all combinations
tried (G-test at about one expected chance find), less the rules whose confidence a
part of their tokens reaches already; rules match other URLs by an
inverted index from each rule's rarest token.  Tokens that occur in the very same
labelled URLs (the fixed parts of a template) count as one, here and in matching:
else a template of 30 tokens would have 2**30 frequent combinations.

Defined cases: a null url, or one without ``://``, has an empty host and path, no
tokens, and gets the default verdict ``allow``; repeated rows are judged alike;
without labels, or when none of a kind, no rule is mined and what no fixed rule
fits is allowed; an empty table gives an empty table; very long URLs count whole;
other columns are not carried over except page_id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Fixed rules (host, path, verdict) of the production query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
MIN_SUPPORT, MIN_CONFIDENCE, MIN_COUNT = 0.002, 0.5, 5
LABEL = "label=block"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UP, _LOW), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fixed rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: domain, words of the host before it, path parts (digits as 0), ending, query keys.

    One token for each fact, so that sets of tokens don't repeat themselves.
    """
    domain = F.substring_index(host, ".", -2)
    words = F.filter(F.split(F.substr(host, F.lit(1), F.length(host) - F.length(domain)), r"[.\-_]"), lambda x: x != "")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    keys = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != "")
    every = F.concat(
        F.array(F.concat(F.lit("domain="), domain)),
        F.transform(words, lambda x: F.concat(F.lit("word="), x)),
        F.transform(parts, lambda x: F.concat(F.lit("path="), F.regexp_replace(F.regexp_replace(x, r"\.[A-Za-z0-9]+$", ""), "[0-9]+", "0"))),
        F.when(ending != "", F.array(F.concat(F.lit("end="), ending))).otherwise(F.array().cast("array<string>")),
        F.transform(keys, lambda x: F.concat(F.lit("key="), F.substring_index(x, "=", 1))),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.coalesce(F.array_distinct(every), F.array().cast("array<string>")))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """Rules (rule_id, rule_tokens, support, confidence) from (tokens array, blocked boolean).

    One mining over tokens and label gives each token set's count with the label
    and without it; a rule is a token set with enough of its URLs blocked.
    """
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    labelled = labelled.where(F.size("tokens") > 0)
    n = labelled.count()
    if not n:
        return spark.createDataFrame([], "rule_id long, rule_tokens array<string>, support double, confidence double")
    least = max(min_count, min_support * n)
    items = F.when(F.col("blocked"), F.array_append("tokens", F.lit(LABEL))).otherwise(F.col("tokens"))
    sets = cut(FPGrowth(itemsCol="items", minSupport=min(1.0, least / n)).fit(labelled.select(items.alias("items"))).freqItemsets)
    key = F.xxhash64(F.array_join("rule_tokens", "\x01")).alias("rule_id")
    hits = sets.where(F.array_contains("items", LABEL) & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", LABEL)).alias("rule_tokens"), F.col("freq").alias("hits")).select("*", key)
    seen = sets.where(~F.array_contains("items", LABEL)).select(F.array_sort("items").alias("rule_tokens"), F.col("freq").alias("seen")).select("seen", key)
    rules = hits.join(seen, "rule_id").withColumn("confidence", F.col("hits") / F.col("seen")).withColumn("support", F.col("hits") / F.lit(n))
    blocked, tried = labelled.where("blocked").count(), max(2, seen.count())
    # against the share of all: a combination of a few URLs is often blocked by chance, and there are many combinations
    share = blocked / n
    other = F.col("seen") - F.col("hits")
    part = lambda x, of: F.when(x > 0, x * F.log(x / of)).otherwise(0.0)
    g = 2 * (part(F.col("hits"), F.lit(share) * F.col("seen")) + part(other, F.lit(1 - share) * F.col("seen")))
    telling = (F.col("confidence") > share) & (g >= 2 * math.log(tried))
    rules = cut(rules.where((F.col("confidence") >= min_confidence) & telling))
    # drop a rule if a part of its tokens, less one, is a rule of as much confidence
    parts = rules.select(F.col("rule_id").alias("long"), F.col("confidence").alias("c"), F.explode(F.transform("rule_tokens", lambda x: F.xxhash64(F.array_join(F.array_remove("rule_tokens", x), "\x01")))).alias("rule_id"))
    needless = parts.join(rules.select("rule_id", "confidence"), "rule_id").where("confidence >= c").select(F.col("long").alias("rule_id")).distinct()
    return cut(rules.join(needless, "rule_id", "left_anti").select("rule_id", "rule_tokens", "support", "confidence"))


def twins(labelled: DataFrame, least: float) -> DataFrame:
    """(t, one): frequent tokens (in ``least`` URLs or more) that occur in the same labelled rows as a
    token before them by name, and that token.  Rows are compared by count and two sums of hashes.
    """
    seen = labelled.select(F.explode("tokens").alias("t"), F.xxhash64("row").alias("h"), F.xxhash64(F.lit(3), "row").alias("g"))
    sums = seen.groupBy("t").agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("g").cast("decimal(38,0)")).alias("s"), F.bit_xor("g").alias("y"))
    same = sums.where(F.col("n") >= least).groupBy("n", "x", "s", "y").agg(F.min("t").alias("one"), F.collect_set("t").alias("all"))  # one token per occurrence of the row
    return same.where(F.size("all") > 1).select(F.explode("all").alias("t"), "one").where("t <> one")


def _merged(rows: DataFrame, same: DataFrame) -> DataFrame:
    """``rows`` (row, tokens and more) with twins replaced."""
    told = rows.select("row", F.explode("tokens").alias("t")).join(same, "t", "left")
    told = told.groupBy("row").agg(F.collect_set(F.coalesce("one", "t")).alias("merged"))
    return rows.join(told, "row", "left").withColumn("tokens", F.coalesce("merged", F.col("tokens"))).drop("merged")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, rule_id) of the rules all of whose tokens a URL has.

    The inverted index lists each rule under its rarest token alone, so a token
    of most URLs is looked up but leads to no rules.
    """
    freq = urls.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    terms = rules.select("rule_id", "rule_tokens", F.explode("rule_tokens").alias("t")).join(freq, "t", "left")
    index = terms.groupBy("rule_id").agg(F.min_by("t", F.struct(F.coalesce("n", F.lit(0)), "t")).alias("t"), F.first("rule_tokens").alias("rule_tokens"))
    found = urls.select("row", "tokens", F.explode("tokens").alias("t")).join(index, "t")
    return found.where(F.size(F.array_except("rule_tokens", "tokens")) == 0).select("row", "rule_id")


def judge(pages: DataFrame, labels: DataFrame | None, fixed=RULES, **how) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, confidence for each row of pages (page_id, url).

    labels: (page_id, blocked), e.g. of the same ids.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    base = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    base = base.withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path")))
    urls = base.select("url", "tokens").where(F.size("tokens") > 0).distinct().select(F.md5(F.encode("url", "UTF-8")).alias("row"), "url", "tokens")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), fixed)
    base = base.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("_fixed"))
    if labels is None:
        return base.select("page_id", "host", "path", "rule", F.coalesce("_fixed", F.lit("allow")).alias("verdict"), F.lit(None).cast("array<string>").alias("mined_rule"), F.lit(None).cast("double").alias("confidence"))
    known = labels.where(F.col("blocked").isNotNull()).groupBy("page_id").agg(F.max("blocked").alias("blocked"))
    labelled = pages.select("page_id", "url").join(known, "page_id").select("blocked", "url", tokens_of(F.col("url"), host, path).alias("tokens"))
    labelled = cut(labelled.where(F.size("tokens") > 0).select("blocked", "tokens", F.md5(F.encode("url", "UTF-8")).alias("row")))
    least = max(how.get("min_count", MIN_COUNT), how.get("min_support", MIN_SUPPORT) * labelled.count())
    same = cut(twins(labelled, least))
    urls = cut(_merged(urls, same))
    # a URL's merged tokens are the same wherever it stands, so labelled rows take them from its row
    labelled = labelled.select("blocked", "row").join(urls.select("row", "tokens"), "row")
    rules = mine_rules(labelled, **how)
    hits = match(urls.select("row", "tokens"), rules)
    best = hits.join(rules, "rule_id").groupBy("row").agg(F.max_by(F.struct("rule_tokens", "confidence"), F.struct("confidence", "support", "rule_id")).alias("m"))
    best = urls.join(best, "row").select("url", "m")
    out = base.join(best, "url", "left")
    mined = F.when(F.col("m").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("_fixed", mined).alias("verdict"), F.col("m.rule_tokens").alias("mined_rule"), F.col("m.confidence").alias("confidence"))


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    return judge(pages, labels)
