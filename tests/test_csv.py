"""CSV records against Python's csv and against a plain reading line by line, over files cut into many splits."""

import csv
import io
import random

import pytest

from logloom import api
from logloom.sources import csvs, readers

HEADER = "a,b,c"
MARKED = {"\\\\": "\ufdd0", '\\"': "\ufdd1", '""': "\ufdd2"}


def marked(s):
    for text, mark in MARKED.items():
        s = s.replace(text, mark)
    return s


def scan(line, inside):
    n, bad = 0, False
    for p in line.split(","):
        opens = not inside and p.startswith('"')
        body = marked(p[1:] if opens else p)
        if inside or opens:
            inside = '"' not in body
            bad |= not inside and body[body.index('"') + 1 :].strip() != ""
        n += not inside
    return inside, n, bad


def plain(lines, width):
    """The rule, one line after another."""
    out, i = [], 0
    while i < len(lines):
        inside, n, bad = scan(lines[i], False)
        end = i
        if inside and not bad:
            for j in range(i + 1, len(lines)):
                still, r, spoilt = scan(lines[j], True)
                if spoilt:
                    break
                n += r
                if r and not still:
                    end = j if n == width else i
                    break
        out.append("\n".join(lines[i : end + 1]))
        i = end + 1
    return out


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "48", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "64"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def values(df, names="abc"):
    return sorted(df.select(*names).collect(), key=str)


def test_records_of_any_quotes(small_splits, tmp_path):
    """Random lines full of quotes, read in many splits as one after another."""
    rng = random.Random(3)
    tokens = ["x", "yy", '"', '""', ",", ",", 'q"', '"z"', '\\"', " ", '"p,', ',"', "long text here"]
    whole = ['x,y,"z', 'x,"y', '"x', 'y",z', 'z"', 'y","z', 'in the middle', '', 'a,b,c', 'x,"y,z', '"a","b","c"', 'x"y,z', 'x","y', 'w",x,"y']
    want = []
    for f in range(4):
        lines = ["".join(rng.choice(tokens) for _ in range(rng.randrange(1, 9))) if rng.random() < 0.3 else rng.choice(whole) for _ in range(200)]
        (tmp_path / f"f{f}.csv").write_text("\n".join(lines) + "\n")
        want += plain(lines, 3)
    lines = readers.read_lines(small_splits, str(tmp_path))
    assert lines.select("file", "split").distinct().count() > 40
    got = [r.line for r in csvs.records(lines, ",", 3).collect()]
    assert sorted(got) == sorted(want) and sum("\n" in w for w in want) > 20


def test_written_by_python(small_splits, tmp_path):
    """What Python's csv writes, with separators, quotes and line ends in fields, comes back as it was."""
    rng = random.Random(5)
    words = ["plain", "a,b", 'say "hi"', "two\nlines", "\n\nblank", '"', "", "end\n", "tab\t", "x" * 200]
    rows = [[rng.choice(words) for _ in range(3)] for _ in range(200)]
    buffer = io.StringIO()
    csv.writer(buffer, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows([["a", "b", "c"], *rows])
    text = buffer.getvalue().replace('"a","b","c"', HEADER, 1)
    (tmp_path / "t.csv").write_text(text)
    assert list(csv.reader(io.StringIO(text)))[1:] == rows
    got = values(readers.read_csv(small_splits, str(tmp_path / "t.csv")))
    assert [tuple(r) for r in got] == sorted([tuple(x or None for x in r) for r in rows ], key=str)


def test_no_row_is_lost(small_splits, tmp_path):
    """Short rows are padded, an unclosed quote costs its own record, long rows are listed."""
    lines = [HEADER] + [f"{i},ok" if i % 2 else f"{i},ok,fine" for i in range(50)]
    lines += ['50,"open,3', "51,x,y", '52,"q,r",z', '53,"two', 'lines, so","c"', "54,a,b,c", "55,a,b,,", '56,5" disk,x', '57,"a ""b"" c",d', '58,"say \\"no\\"",d', '59,C:\\dir,"D:\\x"', "", "60,a;;", '61,"never']
    (tmp_path / "t.csv").write_text("\n".join(lines))
    got = {r.a: (r.b, r.c) for r in readers.read_csv(small_splits, str(tmp_path / "t.csv")).collect()}
    assert set(got) == {str(i) for i in range(62)} - {"54"} and all(got[str(i)] == ("ok", None if i % 2 else "fine") for i in range(50))
    assert got["50"] == ('"open', "3") and got["51"] == ("x", "y") and got["52"] == ("q,r", "z") and got["53"] == ("two\nlines, so", "c")
    assert got["55"] == ("a", "b") and got["56"] == ('5" disk', "x") and got["57"] == ('a "b" c', "d") and got["58"] == ('say "no"', "d")
    assert got["59"] == ("C:\\dir", "D:\\x") and got["60"] == ("a", None) and got["61"] == ('"never', None)
    assert [(r.line, r.log_format) for r in api.unparsed(small_splits, str(tmp_path)).collect()] == [("54,a,b,c", "csv")]


def test_an_open_quote_at_the_head_of_a_file(small_splits, tmp_path):
    """Half the rows after a stray quote were lost once."""
    lines = [HEADER, '0,"x,y'] + [f"{i},v,w" for i in range(1, 50)]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    assert readers.read_csv(small_splits, str(tmp_path / "t.csv")).count() == 50


def test_separators_and_headers(spark, tmp_path):
    (tmp_path / "s.csv").write_text('n;"x;y";t;t\n1;"a;b";c;d\n')
    (tmp_path / "p.csv").write_text('n|m\n1|"a|b\nc"\n2|x\n')
    (tmp_path / "empty.csv").write_text("\n\n")
    row = readers.read_csv(spark, str(tmp_path / "s.csv")).first()
    assert row.asDict().items() >= {"n": "1", "x;y": "a;b", "t": "c", "t_3": "d"}.items()
    assert sorted((r.n, r.m) for r in readers.read_csv(spark, str(tmp_path / "p.csv")).collect()) == [("1", "a|b\nc"), ("2", "x")]
    assert readers.read_csv(spark, str(tmp_path / "empty.csv")).count() == 0


def test_json_that_is_none_is_listed(spark, tmp_path):
    """A .json file is one value or one per line; what is no JSON is listed."""
    (tmp_path / "x.ndjson").write_text('{"timestamp": "2025-01-01 00:00:00", "message": "m"}\nnot json\n')
    (tmp_path / "y.json").write_text('[{"a": 1}')
    (tmp_path / "z.json").write_text('{"timestamp": "2025-01-01 00:00:01", "message": "n"}\n{"timestamp": "2025-01-01 00:00:02", "message": "o"}\n')
    (tmp_path / "w.json").write_text('[\n{"timestamp": "2025-01-01 00:00:03", "message": "p"},\n{"timestamp": "2025-01-01 00:00:04", "message": "q"}\n]')
    got = sorted((r.log_format, r.line.strip()) for r in api.unparsed(spark, str(tmp_path)).collect())
    assert got == [("json", '[{"a": 1}'), ("ndjson", "not json")]
    assert sorted(r.message for r in api.ingest(spark, str(tmp_path)).collect()) == list("mnopq")
