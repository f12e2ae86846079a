"""One query text for two SQL engines.

Operators are written as functions of a dialect ``d`` that return a SELECT over
named inputs (``@logs``, ``@stats`` ...).  ``SPARK`` text runs through Catalyst;
``DUCK`` text is the oracle.  Only what differs between the engines is a method.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_JAVA = {"%Y": "yyyy", "%b": "MMM", "%d": "d", "%m": "M", "%H": "H", "%M": "m", "%S": "s", "%f": "SSSSSS", "%z": "Z", "%3f": "SSS"}


class Dialect:
    """Spark SQL; ``Duck`` overrides what differs."""

    name = "spark"

    def text(self, s: str) -> str:
        """A string literal, taken as written."""
        if "'" not in s:
            return f"r'{s}'"
        return f'r"{s}"' if '"' not in s else "concat(" + ", '\\'', ".join(self.text(p) if p else "''" for p in s.split("'")) + ")"

    def pattern(self, p: str) -> str:
        return p

    def rx(self, col: str, pattern: str, group: int = 1) -> str:
        """The group of the first match, or null."""
        return f"nullif(regexp_extract({col}, {self.text(self.pattern(pattern))}, {group}), '')"

    def has(self, col: str, pattern: str) -> str:
        """The pattern occurs in the text (false for null)."""
        return f"coalesce(regexp_like({col}, {self.text(self.pattern(pattern))}), false)"

    def sub(self, col: str, pattern: str, new: str) -> str:
        return f"regexp_replace({col}, {self.text(self.pattern(pattern))}, {self.text(new)})"

    def instant(self, col: str, fmt: str) -> str:
        """Parse by a strptime format, null if it doesn't fit; UTC."""
        java = re.sub(r"%3?[A-Za-z]", lambda m: _JAVA[m[0]], fmt)
        return f"try_to_timestamp({col}, '{java}')"

    def format(self, ts: str, fmt: str) -> str:
        java = {"%Y": "yyyy", "%b": "MMM", "%d": "dd", "%m": "MM", "%H": "HH", "%M": "mm", "%S": "ss"}
        return f"date_format({ts}, '" + re.sub(r"%[A-Za-z]", lambda m: java[m[0]], re.sub(r"T", "''T''", fmt)).replace("''T''", "\\'T\\'") + "')"

    def micros(self, ts: str) -> str:
        return f"unix_micros(cast({ts} as timestamp))"

    def from_micros(self, us: str) -> str:
        return f"timestamp_micros({us})"

    def hour(self, ts: str) -> str:
        return f"hour({ts})"

    def minute(self, ts: str) -> str:
        return f"date_trunc('minute', {ts})"

    def plus(self, ts: str, n: int, unit: str) -> str:
        return f"({ts} {'-' if n < 0 else '+'} interval {abs(n)} {unit})"

    def texts(self, col: str) -> str:
        """Distinct values, in order."""
        return f"array_sort(collect_set({col}))"

    def joined(self, col: str) -> str:
        """Distinct values of a group in order, as one text."""
        return f"array_join(array_sort(collect_set({col})), ',')"

    def size(self, arr: str) -> str:
        return f"size({arr})"

    def percentile(self, col: str, p: float) -> str:
        return f"percentile({col}, {p})"

    def values(self, rows: list[tuple], names: list[str]) -> str:
        """A small constant table."""
        def lit(v):
            return self.text(v) if isinstance(v, str) else "null" if v is None else f"cast({v} as double)" if isinstance(v, float) else str(v)

        body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
        return f"(select * from values {body} as t({', '.join(names)}))"

    def unnest(self, arr: str, name: str) -> str:
        return f"explode({arr}) as {name}"

    def steps(self, lo: str, hi: str, n: int, unit: str) -> str:
        return f"sequence({lo}, {hi}, interval {n} {unit})"

    def json(self, col: str, key: str) -> str:
        return f"get_json_object({col}, '$.{key}')"

    def asof_left(self) -> bool:
        return False


def only_group(pattern: str, group: int) -> str:
    """The pattern with no capturing group but one, as the other engine counts to nine only."""
    out, n, inside, i = [], 0, False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(c)
        if c == "(" and not inside and pattern[i + 1 : i + 2] != "?":
            n += 1
            if n != group:
                out.append("?:")
        i += 1
    return "".join(out)


class Duck(Dialect):
    name = "duck"

    def rx(self, col: str, pattern: str, group: int = 1) -> str:
        return f"nullif(regexp_extract({col}, {self.text(only_group(pattern, group))}, 1), '')"

    def text(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def instant(self, col: str, fmt: str) -> str:
        return f"try_strptime({col}, '{fmt.replace('%3f', '%g')}')"

    def format(self, ts: str, fmt: str) -> str:
        return f"strftime({ts}, '{fmt}')"

    def has(self, col: str, pattern: str) -> str:
        return f"coalesce(regexp_matches({col}, {self.text(pattern)}), false)"

    def sub(self, col: str, pattern: str, new: str) -> str:
        return f"regexp_replace({col}, {self.text(pattern)}, {self.text(re.sub(r'[$]([0-9])', r'\\\\\1', new).replace(chr(92) * 2, chr(92)))}, 'g')"

    def micros(self, ts: str) -> str:
        return f"epoch_us({ts})"

    def from_micros(self, us: str) -> str:
        return f"make_timestamp({us})"

    def texts(self, col: str) -> str:
        return f"list_sort(list_distinct(list({col})))"

    def joined(self, col: str) -> str:
        return f"coalesce(array_to_string(list_sort(list_distinct(list({col}))), ','), '')"

    def size(self, arr: str) -> str:
        return f"len({arr})"

    def percentile(self, col: str, p: float) -> str:
        return f"quantile_cont({col}, {p})"

    def values(self, rows: list[tuple], names: list[str]) -> str:
        return super().values(rows, names).replace("select * from values ", "select * from (values ", 1).replace(f" as t({', '.join(names)}))", f") as t({', '.join(names)}))")

    def unnest(self, arr: str, name: str) -> str:
        return f"unnest({arr}) as {name}"

    def steps(self, lo: str, hi: str, n: int, unit: str) -> str:
        return f"generate_series({lo}, {hi}, interval {n} {unit})"

    def json(self, col: str, key: str) -> str:
        return f"json_extract_string({col}, '$.{key}')"


SPARK, DUCK = Dialect(), Duck()
Text = Callable[[Dialect], str]


_QUOTED = re.compile(r"""(r?'(?:[^']|'')*'|r"[^"]*"|`[^`]*`)""")


def counted(sql: str) -> str:
    """``count_if(x)`` as a plain count, since the engines differ where x is null in every row."""
    while (a := sql.find("count_if(")) >= 0:
        depth, i, quote = 1, a + 9, ""
        while depth:
            c = sql[i]
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"`":
                quote = c
            else:
                depth += (c == "(") - (c == ")")
            i += 1
        sql = f"{sql[:a]}count(case when {sql[a + 9 : i - 1]} then 1 end){sql[i:]}"
    return sql


def doubles(sql: str) -> str:
    """Decimal literals outside quotes become doubles, as the engines divide decimals unlike."""
    sql = counted(sql)
    parts = _QUOTED.split(sql)
    return "".join(p if i % 2 else re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", p) for i, p in enumerate(parts))


def named(text: str, names: dict[str, str]) -> str:
    """``@name`` replaced for the names given; other ``@`` stay."""
    return re.sub(r"@(\w+)", lambda m: names.get(m[1], m[0]), text)


def apply(text: Text, **inputs: DataFrame) -> DataFrame:
    """Run an operator over DataFrames: ``apply(op, logs=df)``.

    Inputs become temporary views only while the plan is analysed.
    """
    spark: SparkSession = next(iter(inputs.values())).sparkSession
    names = {}
    for key, df in inputs.items():
        names[key] = f"loom_{key}_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(names[key])
    try:
        return spark.sql(named(doubles(text(SPARK)), names))
    finally:
        for name in names.values():
            spark.catalog.dropTempView(name)


class Bound:
    """An operator with its inputs.

    As text, the inputs are common table expressions.  In Spark each input is a
    DataFrame of its own, written once for the queries that share it: a message of many
    cases is then computed once and not copied into every expression over it.
    """

    def __init__(self, core: Text, inputs: dict[str, Text]):
        self.core, self.inputs = core, inputs

    def __call__(self, d: Dialect) -> str:
        sql = named(self.core(d), {k: f"in_{k}" for k in self.inputs})
        return "with " + ", ".join(f"in_{k} as ({v(d)})" for k, v in self.inputs.items()) + f" select * from ({sql}) as result"


def bind(text: Text, **inputs: Text) -> Bound:
    return Bound(text, inputs)


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


_kept: dict[tuple, tuple[Text, DataFrame]] = {}  # holds the texts, so that no other gets their id


def _stamp(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of what lies in a folder, to tell when an input has changed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in found))


def scratch(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir`` (set here only where unset, and never on a cluster)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="logloom_checkpoint_")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/loom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that one task makes log rows of and sorts.
PIECE_ROWS = 200_000


def dealt(df: DataFrame) -> DataFrame:
    """``df`` in as many pieces as it has rows for, however its files are split.

    By a hash of the columns: dealing in turn would sort each task's rows first.
    """
    return df.repartition(max(1, -(-df.count() // PIECE_ROWS)), *df.columns)


def frame(text: Text, spark: SparkSession, sf_dir: str, keep: bool = False) -> DataFrame:
    """The result of a text over the tables in ``sf_dir``; kept ones are written once and shared."""
    key = (spark.sparkContext.applicationId, sf_dir, id(text), _stamp(spark, sf_dir)) if keep else None
    if key in _kept:
        return _kept[key][1]
    if hasattr(text, "parts"):
        from pyspark.sql import functions as F

        frames = [frame(t, spark, sf_dir).select("type", "subject", "severity", "score", F.lit(k).alias("detector")) for k, t in text.parts()]
        df = frames[0]
        for f in frames[1:]:
            df = df.unionByName(f)
    else:
        if isinstance(text, Bound):
            core, inputs = text.core, {k: frame(t, spark, sf_dir, True) for k, t in text.inputs.items()}
        else:
            core, inputs = text, {}
        used = [t for t in TABLES if re.search(rf"@{t}\b", core(SPARK))]
        inputs |= {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
        df = apply(core, **inputs) if inputs else spark.sql(doubles(core(SPARK)))
    if keep:
        if "program" in df.columns and not isinstance(text, Bound):
            # rows of one program together: a detector's filter then skips pages of the files.
            # The narrow rows of the tables are dealt out before, so that a task's sort is as large whatever the
            # table; what is derived from such a table is read in its order and not sorted again
            df = apply(core, **{k: dealt(x) for k, x in inputs.items()}).sortWithinPartitions("program")
        df = written(df)
        _kept[key] = text, df
    return df


def query(text: Text):
    """(spark, sf_dir) -> DataFrame over the tables that the text names."""
    return lambda spark, sf_dir: frame(text, spark, sf_dir)


def oracle(text: Text) -> str:
    """The DuckDB text over the tables themselves."""
    return named(doubles(text(DUCK)), {t: t for t in TABLES})
