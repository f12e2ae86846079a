import random

from logloom.llm.line_dedup import dedup_lines


def brute(rows):
    """rows: (id, text) -> {row index: text}"""
    key = lambda r: (r[0] if r[0] is not None else 2**63 - 1)
    seen, out = {}, {}
    order = sorted((i for i in range(len(rows)) if rows[i][1] is not None), key=lambda i: key(rows[i]))
    wins = []
    for i in order:
        ls = [x if x.strip(" ") else "" for x in rows[i][1].split("\n")]
        for p in range(len(ls) - 2):
            w = tuple(ls[p : p + 3])
            if any(w):
                wins.append((w, key(rows[i]), p, i))
    first = {}
    for w, k, p, i in wins:
        first[w] = min(first.get(w, (k, p)), (k, p))
    drop = {i: set() for i in order}
    for w, k, p, i in wins:
        if (k, p) > first[w]:
            drop[i] |= {p, p + 1, p + 2}
    return [None if t is None else "\n".join(x for q, x in enumerate(t.split("\n")) if q not in drop[i]) for i, (_, t) in enumerate(rows)]


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "a\nb\nc\nd"), (102, "q\nq\nq\nq\nq"), (103, "\n\n\n\n"), (103, "\n\n\n\n")]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int").repartition(5)
    got = {r.n: r.text for r in dedup_lines(df).collect()}
    assert [got[n] for n in range(len(rows))] == brute(rows)
    assert got[len(rows) - 3] == "q"


def test_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "x\ny\nz", 5, "k"), (2, "0\nx\ny\nz", 6, "k")], "doc_id long, text string, _id int, _cover string")
    out = dedup_lines(df)
    assert out.columns == df.columns
    assert {(r.doc_id, r.text, r._id) for r in out.collect()} == {(1, "x\ny\nz", 5), (2, "0", 6)}
    assert dedup_lines(df.limit(0), counts=True).count() == 0


def test_blank_windows_and_very_long_texts(spark):
    long = "\n".join(f"line {i % 40000}" for i in range(80000))
    df = spark.createDataFrame([(1, "\n \n\n"), (2, "a\n\n\n"), (3, long), (4, "x" * 3_000_000 + "\ny\nz"), (5, "x" * 3_000_000 + "\ny\nz\nend")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in dedup_lines(df).collect()}
    assert got[1] == "\n \n\n" and got[2] == "a\n\n\n" and got[3] == "\n".join(f"line {i}" for i in range(40000)) and got[5] == "end"
    assert {r.doc_id: r.text for r in dedup_lines(df.where("doc_id < 3"), blank=True).collect()} == {1: "\n \n\n"[:0], 2: "a"}
