"""What a task or a join takes up does not grow with the table."""

import random

from pyspark.sql import functions as F

from logloom.operators import detectors as D
from logloom.operators import report, series
from logloom.plans import dialect
from logloom.plans.dialect import apply
from logloom.plans.projection import logs

SF = "/root/testdata/sf0.001"


def test_log_table_is_written_in_bounded_pieces(spark, monkeypatch):
    """Each task sorts some rows of the table; before, all rows of its split of the file."""
    monkeypatch.setattr(dialect, "PIECE_ROWS", 100, raising=False)
    table = dialect.frame(lambda d: logs(d), spark, SF, keep=True)
    rows = table.select("row_id", "program", F.input_file_name().alias("file")).collect()
    assert len(rows) == len({r.row_id for r in rows}) == spark.read.parquet(f"{SF}/events.parquet").count() == 1000
    files = {}
    for r in rows:
        files.setdefault(r.file, []).append(r.program)
    assert max(map(len, files.values())) <= 200
    assert all(programs == sorted(programs) for programs in files.values())


FIVE = 300_000_000


def router_rows(spark, n=400):
    """Activities and events of two routers within twenty minutes, many of them at equal times or five minutes apart."""
    draw = random.Random(3)
    times = [draw.randrange(-FIVE, 3 * FIVE) for _ in range(12)] + [0, FIVE, -FIVE, 1_000_000, 999_999]
    rows = [(i, f"r{draw.randrange(2)}", draw.choice(times) + draw.choice((0, FIVE, FIVE + 1, -1, 1_000_000)), draw.choice(("login", "config", "bgp", "interface", "ospf"))) for i in range(n)]
    rows = [(i, r, us, k, draw.choice(("ann", "bob", None)) if k in ("login", "config") else None, draw.randrange(2) if k == "ospf" else 0) for i, r, us, k in rows]
    rows += [(n, "r0", None, "config", "eve", 0), (n + 1, "r1", None, "bgp", None, 0), (n + 2, "r9", 0, "login", "zed", 0)]
    return rows, spark.createDataFrame(rows, "row_id bigint, router string, us bigint, kind string, who string, down int")


def pairs(rows):
    acts = [r for r in rows if r[3] in ("login", "config") and r[4] is not None and r[2] is not None]
    return [(e, a) for e in rows if e[3] in ("bgp", "interface", "ospf") and e[2] is not None for a in acts if a[1] == e[1] and 0 <= e[2] - a[2] <= FIVE]


def ranged_joins(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in plan.splitlines() if "Join" in x and ("<=" in x or ">=" in x)]


def test_router_suspects_count_without_pairs(spark):
    rows, ev = router_rows(spark)
    want = {}
    for e, a in pairs(rows):
        got = want.setdefault(a[4], {"bgp": 0, "interface": 0, "ospf": 0, "cfg": 0})
        got[e[3]] += 1
    for r in rows:
        if r[3] == "config" and r[4]:
            want.setdefault(r[4], {"bgp": 0, "interface": 0, "ospf": 0, "cfg": 0})["cfg"] += 1
    found = apply(D.router_suspects, ev=ev)
    assert {r.subject: {"bgp": r.bgp, "interface": r.iface, "ospf": r.ospf, "cfg": r.cfg} for r in found.collect()} == want
    assert {"ann", "bob", "eve"} == set(want)
    assert ranged_joins(found) == []


def test_unattributed_events_without_pairs(spark):
    rows, ev = router_rows(spark)
    attributed = {e[0] for e, _ in pairs(rows)}
    found = apply(D.interval_anti, ev=ev)
    want = {r[0] for r in rows if r[3] in ("bgp", "interface", "ospf")} - attributed
    assert sorted(r.row_id for r in found.collect()) == sorted(want) and want and attributed
    assert ranged_joins(found) == []


def test_interval_join_meets_few_pairs_out_of_range(spark):
    """Rows with equal keys that the range drops again: as many as those it keeps, before."""
    rows, ev = router_rows(spark)
    assert sorted((r.row_id, r.activity) for r in apply(D.interval_matches, ev=ev).collect()) == sorted((e[0], a[0]) for e, a in pairs(rows))
    even = [(2 * i + k, "r0", i * 1_000_000, kind, "ann" if k else None, 0) for i in range(1800) for k, kind in enumerate(("bgp", "login"))]
    ev = spark.createDataFrame(even, ev.schema)
    found = apply(D.interval_matches, ev=ev).count()
    met = apply(lambda d: D.interval_matches(d).rsplit(" where ", 1)[0], ev=ev).count()
    assert found == len(pairs(even)) and met < 1.3 * found


def test_interval_join_writes_pairs_in_little_space(spark, tmp_path):
    """An event met all its activities before the next event did, and a pair took some two bytes in a file."""
    draw = random.Random(8)
    even = [(i, "r0", 60_000 * i, "login" if i % 12 else "bgp", f"user{draw.randrange(30)}" if i % 12 else None, 0) for i in range(4000)]
    _, like = router_rows(spark)
    found = apply(D.interval_matches, ev=spark.createDataFrame(even, like.schema))
    found.write.parquet(f"{tmp_path}/pairs")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/pairs").collect()) == sorted((e[0], *e[1:2], e[3], e[5], e[2], a[4], a[0]) for e, a in pairs(even))
    size = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert size < 0.8 * len(pairs(even))


def test_interval_join_holds_the_pairs_of_two_tiles_only(spark):
    """Nothing lay between the join and what multiplies its rows, before."""
    _, ev = router_rows(spark)
    plan = apply(D.interval_matches, ev=ev)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = lambda what: next(i for i, x in enumerate(plan) if what in x)
    assert sum("Generate explode" in x for x in plan[: first("Repartition")]) == 2
    assert first("Repartition") < first("Join") and f"{D.PAIR_TASKS}, false" in plan[first("Repartition")]


def test_related_logs_take_the_last_rows_of_a_key_before_the_join(spark):
    at = lambda i: f"timestamp_micros({i})"
    # 300 rows whose two addresses are the subject's, 300 of a user in other letters, some of a host named like the user
    logs = spark.range(900).selectExpr(
        "id as row_id", f"{at('id % 250')} as timestamp", "case when id % 3 = 1 then 'Ann' end as username", "case when id % 3 = 0 then '9.9.9.9' else 'x' end as source_ip",
        "case when id % 3 = 0 then '9.9.9.9' when id % 6 = 1 then '8.8.8.8' else 'y' end as dest_ip", "case when id % 3 = 2 then 'ANN' else 'h' || id end as host")
    alerts = spark.createDataFrame([("9.9.9.9",), ("aNN",), ("8.8.8.8",), ("nobody",), (None,), ("h7",)], "subject string")
    found = apply(report.related_logs, alerts=alerts, logs=logs)
    got = {}
    for r in found.collect():
        got.setdefault(r.subject, []).append(r.row_id)
    newest = lambda f: sorted((i for i in range(900) if f(i)), key=lambda i: (-(i % 250), -i))[:100]
    want = {"9.9.9.9": newest(lambda i: i % 3 == 0), "aNN": newest(lambda i: i % 3 == 1), "8.8.8.8": newest(lambda i: i % 6 == 1), "nobody": newest(lambda i: True), None: newest(lambda i: True), "h7": [7]}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda x: next(i for i, c in enumerate(x) if c.isalpha())
    tops = [i for i, x in enumerate(plan) if "WindowGroupLimit" in x]
    below = lambda i: plan[i + 1 : next((j for j in range(i + 1, len(plan)) if depth(plan[j]) <= depth(plan[i])), len(plan))]
    assert sum(not any("Join" in x for x in below(i)) for i in tops) >= 4


def test_sessions_take_rows_together_before_windows(spark):
    """Rows met a window each and a join with the whole table, before."""
    gap = 900_000_000
    draw = random.Random(5)
    steps = (0, 1, 1_000_000, gap - 1, gap, gap + 1, 3 * gap)
    rows, us = [], -20 * gap
    for i in range(600):
        if i % 12 == 0:
            who = draw.choice(("1.1.1.1", "2.2.2.2", None)), draw.choice(("ann", "bob", None))
        us += draw.choice(steps)
        rows.append((i, draw.choice((us, us - gap, None)) if i % 9 == 0 else us, *who))
    draw.shuffle(rows)
    logs = spark.createDataFrame(rows, "row_id bigint, us bigint, source_ip string, username string").selectExpr("row_id", "timestamp_micros(us) as timestamp", "source_ip", "username")
    want = {}
    for key in {(r[2], r[3]) for r in rows if r[2] and r[3]}:
        number, before = 0, None
        for _, at, _, _ in sorted((r for r in rows if r[2:] == key), key=lambda r: (r[1] is not None, r[1] or 0)):
            number += at is not None and before is not None and at - before > gap
            before = at
            want.setdefault(f"{key[0]}-{key[1]}-{number}", []).append(at)
    span = lambda x: max(x) - min(x) if x else None
    found = apply(series.sessions, logs=logs)
    assert {r.session_id: (r.events, r.span_us) for r in found.collect()} == {k: (len(v), span([x for x in v if x is not None])) for k, v in want.items()}
    assert len(want) > 40 and max(map(len, want.values())) > 5
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Join" in x for x in plan)
    windows = [i for i, x in enumerate(plan) if "Window [" in x]
    assert windows and any("Aggregate [" in x for x in plan[max(windows) + 1 :])
