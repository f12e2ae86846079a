"""Readers: decoded lines with numbers, CSV, flattened JSON, and one entry for any file or folder.

Every file is judged by itself: structured ones by ending, separator, header and
layout, text files by their first records.  Files of one kind are read together.
``row_id`` is unique over all that one call reads: the place of a line or row in
Spark's order of splits, which stays the same as long as the files do.
"""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.dialect import apply
from ..schema import event_table
from . import adapters, csvs, parsers

# What bytes 0x80 to 0x9F mean in Windows-1252 (the five it lacks stay as they are).
WINDOWS = dict(zip([*range(0x80, 0xA0)], "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"))


def decoded(raw):
    """Text of a binary column: UTF-8 if valid, else Windows-1252; a BOM goes."""
    single = F.translate(F.decode(raw, "ISO-8859-1"), "".join(map(chr, WINDOWS)), "".join(WINDOWS.values()))
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(single)
    return F.regexp_replace(text, "^\ufeff", "")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, split, line_no, line) of text files, by Spark's splittable text source.

    ``split`` is where the line's split begins in its file and ``line_no`` rises
    within the split; no two lines share a ``line_no``.  A line that is not valid
    UTF-8 is read as Windows-1252.
    """
    lines = spark.read.text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line_no"), decoded(F.col("value").cast("binary")).alias("line")
    )


def read_binary_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, line_no, line) of files that need decoding as a whole (e.g. lines that end in a lone CR)."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), decoded(F.col("content")).alias("text"))
    lines = files.select("file", F.posexplode(F.split("text", r"\r\n|\r|\n")))
    return lines.select("file", F.lit(0).cast("long").alias("split"), F.col("pos").cast("long").alias("line_no"), F.col("col").alias("line"))


def header_names(header: str, sep: str) -> list[str]:
    """Clean column names; one that repeats gets its place added."""
    names = [adapters.clean_header(c) for c in csvs.names_of(header, sep)]
    return [c if c and c not in names[:i] else f"{c or 'column'}_{i}" for i, c in enumerate(names)]


def csv_table(spark: SparkSession, path: str | list[str], header: str | None = None, sep: str | None = None) -> tuple[DataFrame, list[str]]:
    """(``csvs.table`` of CSV files with one header, its column names); the header is the first file's unless given."""
    lines = read_lines(spark, path)
    if header is None:
        first = lines.where("split = 0 and trim(line) <> ''").orderBy("file", "line_no").select("line").first()
        header = first[0] if first else ""
    sep = sep or csvs.separator(header)
    return csvs.table(lines, header, sep), header_names(header, sep)


def read_csv(spark: SparkSession, path: str | list[str], header: str | None = None, sep: str | None = None) -> DataFrame:
    """(file, row_id, columns as strings) of CSV files with one header; files are split, records of several lines too."""
    rows, names = csv_table(spark, path, header, sep)
    return rows.where("fits").select("file", F.col("line_no").alias("row_id"), *[F.get("values", F.lit(i)).alias(c) for i, c in enumerate(names)])


def flatten(df: DataFrame) -> DataFrame:
    """Nested fields as columns with underscores for dots."""
    def walk(schema: T.StructType, path: str) -> list:
        out = []
        for f in schema.fields:
            at = f"{path}.`{f.name}`" if path else f"`{f.name}`"
            name = at.replace("`", "").replace(".", "_")
            out += walk(f.dataType, at) if isinstance(f.dataType, T.StructType) else [F.col(at).alias(name)]
        return out

    return df.select(*walk(df.schema, ""))


def read_json(spark: SparkSession, path: str | list[str], multiline: bool = False) -> DataFrame:
    """(file, row_id, columns) of JSON records, flattened; a line that is no JSON becomes a message."""
    df = spark.read.option("multiLine", multiline).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    df = df.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row_id"), *[F.col(f"`{c}`") for c in df.columns if c not in ("file", "row_id")])
    flat = flatten(df)
    if "_corrupt" in flat.columns:
        message = F.coalesce(F.col("message"), F.col("_corrupt")) if "message" in flat.columns else F.col("_corrupt")
        flat = flat.withColumn("message", message).drop("_corrupt")
    return flat


def _no_json(text):
    """Not JSON (null included); in brackets, as a text that goes on after its first value is none."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNull()


def json_files(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[str]]:
    """(files of one JSON value each, files of one per line); what is neither counts as lines."""
    if not paths:
        return [], []
    files = spark.read.format("binaryFile").load(paths).select("path", _no_json(decoded(F.col("content"))).alias("lines")).collect()  # a row per file
    whole, lines = [], []
    for r in sorted(files):
        (lines if r.lines else whole).append(r.path)
    return whole, lines


def json_branches(spark: SparkSession, files: dict[str, list[str]]) -> list[DataFrame]:
    whole, lines = json_files(spark, files.get("json", []))
    lines = sorted([*lines, *files.get("ndjson", [])])
    return [read_json(spark, p, multiline) for p, multiline in ((whole, True), (lines, False)) if p]


def corrupt_json(spark: SparkSession, files: dict[str, list[str]]) -> DataFrame:
    """(file, line_no, line, log_format) of the lines of JSON files that are no JSON."""
    _, lines = json_files(spark, files.get("json", []))
    rows = read_lines(spark, sorted([*lines, *files.get("ndjson", [])]))
    kind = F.lower(F.substring_index("file", ".", -1))
    return rows.where((F.trim("line") != "") & _no_json(F.col("line"))).select("file", "line_no", "line", kind.alias("log_format"))


def _files(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Paths of a file or folder by kind; the driver lists a table's files in any case."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0").select("path").collect()
    out: dict[str, list[str]] = {}
    for r in sorted(r.path for r in rows):
        ending = r.lower().rsplit(".", 1)[-1]
        out.setdefault(ending if ending in ("csv", "json", "ndjson") else "text", []).append(r)
    return out


def csv_headers(spark: SparkSession, paths: list[str]) -> list[tuple[str, list[str]]]:
    """(header, files) of CSV files, by their first line that is not blank."""
    if not paths:
        return []
    heads = read_lines(spark, paths).where("split = 0 and trim(line) <> ''")
    out: dict[str, list[str]] = {}
    for r in heads.groupBy("file").agg(F.min_by("line", "line_no").alias("header")).collect():  # one short row per file
        out.setdefault(r.header, []).append(unquote(r.file))
    return sorted(out.items())


def text_branches(spark: SparkSession, paths: list[str]) -> list[tuple[str, DataFrame]]:
    """(format, records) of text files, grouped by the format each shows."""
    by_format: dict[str, list[str]] = {}
    for file, name in parsers.sniff_files(read_lines(spark, paths)).items():
        by_format.setdefault(name, []).append(unquote(file))
    return [(name, apply(parsers.merge_multiline, lines=read_lines(spark, files))) for name, files in sorted(by_format.items())]


def branches(spark: SparkSession, path: str) -> list[tuple[str | None, DataFrame]]:
    """(format, events in its own columns, with row_id) for each kind of file found."""
    files = _files(spark, path)
    out: list[tuple[str | None, DataFrame]] = []
    for header, paths in csv_headers(spark, files.get("csv", [])):
        out += adapters.adapt(read_csv(spark, paths, header))
    for rows in json_branches(spark, files):
        out += adapters.adapt(rows)
    for name, records in text_branches(spark, files["text"]) if "text" in files else ():
        out.append((name, parsers.parse(records, name).withColumnRenamed("line_no", "row_id")))
    return out


def _timed(events: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if dict(events.dtypes).get("timestamp") == "string":
        events = events.withColumn("timestamp", F.try_to_timestamp("timestamp"))
    if "timestamp" in events.columns:
        events = events.where(F.col("timestamp").isNotNull())
        if start:
            events = events.where(F.col("timestamp") >= F.lit(start).cast("timestamp"))
        if end:
            events = events.where(F.col("timestamp") < F.lit(end).cast("timestamp"))
    return events


def ingest(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The event table of a file or folder, in [start, end), rows without an instant left out."""
    found = branches(spark, path)
    # each branch numbers its own rows; its place keeps their numbers apart
    tables = [event_table(_timed(events.withColumn("row_id", F.col("row_id") * len(found) + k), start, end)) for k, (_, events) in enumerate(found)]
    return reduce(DataFrame.unionByName, tables) if tables else event_table(spark.createDataFrame([], "timestamp timestamp, row_id long"))


def unparsed(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line, log_format) of what ingest leaves out: text records that their file's format does
    not fit, CSV records with more fields than the header, and lines that are no JSON."""
    empty = spark.createDataFrame([], "file string, line_no long, line string, log_format string")
    files = _files(spark, path)
    found = text_branches(spark, files["text"]) if "text" in files else []
    left = [records.where("trim(line) <> ''").where(~F.col("line").rlike(parsers.FORMATS[name].pattern)).withColumn("log_format", F.lit(name)) for name, records in found]
    for header, paths in csv_headers(spark, files.get("csv", [])):
        rows, _ = csv_table(spark, paths, header)
        left.append(rows.where("not fits").select("file", "line_no", "line", F.lit("csv").alias("log_format")))
    if "json" in files or "ndjson" in files:
        left.append(corrupt_json(spark, files))
    return reduce(DataFrame.unionByName, left, empty)
