"""CSV records of splittable files, with columns that lose no row.

A line is scanned by its separators: a field that begins with a quote ends at the
next quote that is not doubled or escaped by a backslash.  Most lines are records.
A line that ends inside a quoted field (an opener) begins a record of several lines
if the quote is closed further down where a field ends and the record then has as
many fields as the header; else the quote is a stray one and the line is a record
by itself, with the quote as text, so that it costs nothing but itself.

Whether a later line closes a quote does not depend on where the quote was opened,
so each line is scanned once from either state, and what lies before or after a
split of the file comes in as one row per split:

* ``terminal`` lines end an open quote, well (with the number of fields they end)
  or badly; an opener is ``valid`` if the next terminal, in this split or a later
  one, ends it well with the right number of fields;
* terminals cut the lines into segments, and the first valid opener of a segment
  begins the record that its terminal ends.  A terminal may itself be an opener if
  it ends no record: a chain of yes and no that has a value per state it is entered
  with, folded over the splits.

Files without openers take none of this: their lines are records.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUOTE = '"'
SEPARATORS = (",", ";", "\t", "|")
#: Stand for an escaped backslash, an escaped quote and a doubled quote while a field is scanned.
MARKS = {"\ufdd0": "\\\\", "\ufdd1": '\\"', "\ufdd2": '""'}


def separator(header: str) -> str:
    """The separator that the header has most of, outside quotes."""
    bare = "".join(header.split(QUOTE)[::2])
    return max(SEPARATORS, key=bare.count)


def names_of(header: str, sep: str) -> list[str]:
    return next(csv.reader([header], delimiter=sep), [])


def _marked(x: Column) -> Column:
    for mark, text in MARKS.items():
        x = F.replace(x, F.lit(text), F.lit(mark))
    return x


def _text(x: Column, quoted: bool) -> Column:
    """Marks back to text; in a quoted field an escaped or doubled quote is one quote."""
    for mark, text in MARKS.items():
        x = F.replace(x, F.lit(mark), F.lit(QUOTE if quoted and text.endswith(QUOTE) else text))
    return x


def _pieces(line: Column, sep: str) -> Column:
    return F.split(line, {"|": r"\|"}.get(sep, sep), -1)


def _opened(piece: Column, inside: Column) -> tuple[Column, Column, Column]:
    """(in a quoted field, its text or that of the piece with marks, place of the closing quote or 0)."""
    opens = ~inside & piece.startswith(QUOTE)
    body = _marked(F.when(opens, F.substr(piece, F.lit(2))).otherwise(piece))
    return inside | opens, body, F.instr(body, QUOTE)


def scanned(line: Column, sep: str, inside: bool) -> Column:
    """struct(open, n, bad) of a line entered outside or inside a quoted field: whether it ends inside,
    the fields it completes, and whether text follows a closing quote."""

    def step(acc: Column, piece: Column) -> Column:
        quoted, body, end = _opened(piece, acc["open"])
        goes_on = quoted & (end == 0)
        spoilt = quoted & (end > 0) & (F.trim(F.substr(body, end + 1)) != "")
        return F.struct(goes_on.alias("open"), (acc["n"] + F.when(goes_on, 0).otherwise(1)).alias("n"), (acc["bad"] | spoilt).alias("bad"))

    start = F.struct(F.lit(inside).alias("open"), F.lit(0).alias("n"), F.lit(False).alias("bad"))
    return F.aggregate(_pieces(line, sep), start, step)


def fields(record: Column, sep: str) -> Column:
    """The fields of a record; if a quote stays open, those of the plain text."""

    def step(acc: Column, piece: Column) -> Column:
        quoted, body, end = _opened(piece, acc["open"])
        goes_on = quoted & (end == 0)
        told = F.when(goes_on, _text(body, True)).when(quoted, F.concat(_text(F.substr(body, F.lit(1), end - 1), True), _text(F.substr(body, end + 1), False))).otherwise(piece)
        now = F.when(acc["open"], F.concat(acc["now"], F.lit(sep), told)).otherwise(told)
        done = F.when(goes_on, acc["done"]).otherwise(F.concat(acc["done"], F.array(now)))
        return F.struct(done.alias("done"), goes_on.alias("open"), F.when(goes_on, now).otherwise(F.lit("")).alias("now"))

    plain = _pieces(record, sep)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(False).alias("open"), F.lit("").alias("now"))
    told = F.aggregate(plain, start, step, lambda acc: F.when(acc["open"], F.lit(None).cast("array<string>")).otherwise(acc["done"]))
    return F.when(F.contains(record, F.lit(QUOTE)), F.coalesce(told, plain)).otherwise(plain)


# ---------------------------------------------------------------- records of several lines

_SPLIT = ("file", "split")


def _events(lines: DataFrame, sep: str) -> DataFrame:
    """``lines`` with: opener and k (fields before the open one); kind of what happens to a quote that is open
    before the line (C: closed, R: closed and another opened, B: badly closed; null: nothing), and r, the fields ended."""
    some = F.contains("line", F.lit(QUOTE))
    out, into = scanned(F.col("line"), sep, False), scanned(F.col("line"), sep, True)
    lines = lines.withColumn("_o", F.when(some, out)).withColumn("_i", F.when(some, into))
    kind = F.when(F.col("_i.bad"), "B").when(F.col("_i.n") == 0, None).when(F.col("_i.open"), "R").otherwise("C")
    opener = F.coalesce(F.col("_o.open") & ~F.col("_o.bad"), F.lit(False))
    lines = lines.withColumn("opener", opener).withColumn("k", F.col("_o.n")).withColumn("kind", F.when(some, kind)).withColumn("r", F.col("_i.n")).drop("_o", "_i")
    ended = F.sum(F.when(F.col("kind") == "R", F.col("r")).otherwise(0)).over(Window.partitionBy(*_SPLIT).orderBy("line_no"))
    return lines.withColumn("ended", ended).withColumn("terminal", F.coalesce(F.col("kind").isin("C", "B"), F.lit(False)))


def _validated(events: DataFrame, ahead: DataFrame, width: int) -> DataFrame:
    """``events`` with valid, and the place of each line among the terminals of its split."""
    by = Window.partitionBy(*_SPLIT).orderBy("line_no")
    here = F.first(F.when(F.col("terminal"), F.struct("kind", "r", "ended")), ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing))
    rows = events.join(ahead, list(_SPLIT)).withColumn("_next", F.coalesce(here, F.col("later")))
    count = F.col("k") + F.col("_next.ended") - F.col("ended") + F.col("_next.r")
    rows = rows.withColumn("valid", F.col("opener") & F.coalesce((F.col("_next.kind") == "C") & (count == width), F.lit(False))).drop("_next", "later")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("segment", F.coalesce(F.sum(F.col("terminal").cast("int")).over(before), F.lit(0)))
    rows = rows.withColumn("after_valid", F.coalesce(F.last(F.when(F.col("terminal"), F.col("valid")), ignorenulls=True).over(before), F.lit(False)))
    inner = Window.partitionBy(*_SPLIT, "segment").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("found", F.min(F.when(F.col("valid"), F.col("line_no"))).over(inner))


def _placed(rows: DataFrame, entered: Column) -> DataFrame:
    """``rows`` with ends, and ``since``: the line in this split that began the record the line continues,
    -1 if it began before the split, null if the line continues none."""
    by = Window.partitionBy(*_SPLIT).orderBy("line_no")
    rows = rows.withColumn("_in", F.coalesce(entered, F.lit(False)))
    rows = rows.withColumn("flips", F.sum(F.when(F.col("terminal") & F.col("found").isNull() & F.col("after_valid"), 1).otherwise(0)).over(by))
    flip = F.col("terminal") & F.col("found").isNull() & F.col("after_valid")
    fixed = F.when(F.col("terminal") & F.col("found").isNotNull(), True).when(F.col("terminal") & (F.col("segment") > 0) & ~flip, False)
    rows = rows.withColumn("_last", F.last(F.when(fixed.isNotNull(), F.struct(fixed.alias("v"), F.col("flips").alias("n"))), ignorenulls=True).over(by))
    even = F.pmod(F.col("flips") - F.coalesce(F.col("_last.n"), F.lit(0)), F.lit(2)) == 0
    rows = rows.withColumn("ends", F.col("terminal") & (F.coalesce(F.col("_last.v"), F.col("_in")) == even))
    # a terminal that ends no record may open one: the segment after it begins inside it
    prior = F.last(F.when(F.col("terminal"), F.struct("valid", "ends", "line_no")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_prior", prior)
    entry = F.when(F.col("segment") == 0, F.when(F.col("_in"), F.lit(-1).cast("long"))).when(F.col("_prior.valid") & ~F.col("_prior.ends"), F.col("_prior.line_no"))
    return rows.withColumn("since", F.coalesce(entry, "found")).drop("_in", "flips", "_last", "_prior")


def _left_open(rows: DataFrame, name: str) -> list[Column]:
    """Aggregates of a split's placed rows: the line that began a record still open at the split's end (-1: before the split; null: none)."""
    last = F.max_by(F.struct("line_no", "since", "valid", "ends", "terminal"), "line_no")
    own = F.when(last["terminal"], F.when(last["valid"] & ~last["ends"], last["line_no"]))
    return [F.coalesce(own, F.when(~last["terminal"], F.coalesce(last["since"], F.when(last["valid"], last["line_no"])))).alias(name)]


def joined_records(lines: DataFrame, sep: str, width: int) -> DataFrame:
    """(file, split, line_no, line) records of the lines of files with openers; ``lines`` are read more than once."""
    narrow = _events(lines, sep).drop("line")
    # one row per split: the fields its R lines end, and its first terminal
    first = F.min_by(F.when(F.col("terminal"), F.struct("kind", "r", "ended")), F.when(F.col("terminal"), F.col("line_no")))
    splits = narrow.groupBy(*_SPLIT).agg(F.max("ended").alias("total"), first.alias("first"))
    by_file = Window.partitionBy("file").orderBy("split")
    splits = splits.withColumn("earlier", F.coalesce(F.sum("total").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    told = F.when(F.col("first").isNotNull(), F.struct(F.col("first.kind").alias("kind"), F.col("first.r").alias("r"), (F.col("first.ended") + F.col("earlier")).alias("ended")))
    later = F.first(told, ignorenulls=True).over(by_file.rowsBetween(1, Window.unboundedFollowing))
    # counted from the split's own beginning
    ahead = splits.withColumn("_l", later).select(*_SPLIT, F.when(F.col("_l").isNotNull(), F.struct("_l.kind", "_l.r", (F.col("_l.ended") - F.col("earlier")).alias("ended"))).alias("later"))

    known = _validated(narrow, ahead, width)
    none = _placed(known, F.lit(False)).groupBy(*_SPLIT).agg(*_left_open(known, "out0"))
    some = _placed(known, F.lit(True)).groupBy(*_SPLIT).agg(*_left_open(known, "out1"))
    ways = none.join(some, list(_SPLIT))
    # what each split is entered with, folded over a file's splits: one short row per split
    listed = ways.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("split", "out0", "out1"))).alias("s"))
    key = "struct<split: bigint, line_no: bigint>"
    fold = f"""aggregate(s, struct(cast(null as {key}) as now, cast(array() as array<struct<split: bigint, entered: {key}>>) as seen),
      (a, x) -> struct(
        case when coalesce(if(a.now is null, x.out0, x.out1), -2) = -2 then cast(null as {key})
             when if(a.now is null, x.out0, x.out1) = -1 then a.now
             else named_struct('split', x.split, 'line_no', if(a.now is null, x.out0, x.out1)) end as now,
        concat(a.seen, array(named_struct('split', x.split, 'entered', a.now))) as seen),
      a -> a.seen)"""
    entries = listed.select("file", F.expr(f"inline({fold})"))

    whole = _validated(_events(lines, sep), ahead, width).join(entries, list(_SPLIT))
    whole = _placed(whole, F.col("entered").isNotNull())
    start = F.when(F.col("since") == -1, F.col("entered")).when(F.col("since").isNotNull(), F.struct("split", F.col("since").alias("line_no")))
    # the lines of one record have the place of its first
    begins = F.col("valid") & F.col("since").isNull() & ~(F.col("terminal") & F.col("ends"))
    whole = whole.withColumn("begins", begins).withColumn("start", F.coalesce(start, F.struct("split", "line_no"))).withColumn("alone", F.col("since").isNull() & ~F.col("begins"))
    single = whole.where("alone").select(*_SPLIT, "line_no", "line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "line_no", "line"))), lambda x: x["line"]), "\n")
    several = whole.where("not alone").groupBy("file", "start").agg(text.alias("line")).select("file", "start.split", "start.line_no", "line")
    return single.unionByName(several)


def records(lines: DataFrame, sep: str, width: int) -> DataFrame:
    """(file, split, line_no, line) records of CSV lines; only files with openers are gone over."""
    lines = lines.select(*_SPLIT, "line_no", "line")
    opens = F.when(F.contains("line", F.lit(QUOTE)), scanned(F.col("line"), sep, False)["open"]).otherwise(False)
    files = [(r.file,) for r in lines.groupBy("file").agg(F.max(opens).alias("o")).where("o").select("file").collect()]  # names of files
    if not files:
        return lines
    odd = lines.sparkSession.createDataFrame(files, "file string")
    return lines.join(odd, "file", "left_anti").unionByName(joined_records(lines.join(odd, "file", "left_semi"), sep, width))


def table(lines: DataFrame, header: str, sep: str | None = None) -> DataFrame:
    """(file, line_no, line, values, fits) of the records under a header: short ones padded with nulls,
    empty fields beyond the header left out; ``fits`` is false for those with more."""
    sep = sep or separator(header)
    width = len(names_of(header, sep))
    # an end of ";;" is no column but a mark that some exporters leave
    clean = F.col("line") if header.endswith(";;") or sep == ";" else F.regexp_replace("line", r";;\s*$", "")
    rows = records(lines.withColumn("line", clean), sep, width)
    rows = rows.where((F.col("line") != header) & (F.trim("line") != "")).withColumn("_f", fields(F.col("line"), sep))
    fits = ~F.exists(F.slice("_f", F.lit(width + 1), F.size("_f")), lambda x: F.trim(x) != "")
    values = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.nullif(F.get("_f", j), F.lit("")))
    return rows.select("file", "line_no", "line", values.alias("values"), fits.alias("fits"))
