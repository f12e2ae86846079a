"""Streams replayed in micro-batches against the batch detectors."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import detectors as D
from logloom.plans.dialect import apply
from logloom.streaming import stateful

from .test_engine import T0, events


def replay(spark, tmp_path, rows, build, mode, batches=6, name="replayed"):
    """Rows in files of a few minutes each, a little out of order inside and across neighbours, one file a micro-batch."""
    end = max(r["timestamp"] for r in rows) + dt.timedelta(days=2)
    rows = [{**r, "row_id": i} for i, r in enumerate(rows)]
    ordered = sorted(rows, key=lambda r: r["timestamp"] + dt.timedelta(seconds=random.Random(r["row_id"]).uniform(-60, 60)))
    size = -(-len(ordered) // batches)
    folder = tmp_path / "in"
    folder.mkdir()
    parts = [ordered[k : k + size] for k in range(0, len(ordered), size)] + [[{"timestamp": end + dt.timedelta(days=k, hours=w), "username": f"z{k}{w}", "row_id": 10**6 + 10 * k + w, "program": "sysmon", "dest_ip": "8.8.8.8", "win_id": 4672 + 16 * w} for w in (0, 1)] for k in range(3)]
    schema = events(spark, [{}]).schema
    for k, part in enumerate(parts):
        names = schema.names
        spark.createDataFrame([tuple(r.get(c) for c in names) for r in part], schema).coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        (file,) = (tmp_path / f"w{k}").glob("*.parquet")
        target = folder / f"{k:03d}.parquet"
        file.rename(target)
        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.table(name), apply(lambda d: "select * from @logs", logs=events(spark, rows))


@pytest.fixture
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_beacons(few_partitions, tmp_path):
    rng = random.Random(4)
    rows = []
    for user, gap, jitter, n in (("even", 60, 0.5, 25), ("slow", 290, 1, 14), ("odd", 60, 40, 30), ("few", 60, 0, 9), ("late", 400, 0, 12)):
        rows += [{"program": "sysmon", "username": user, "dest_ip": "8.8.4.4", "timestamp": T0 + dt.timedelta(seconds=gap * i + rng.uniform(0, jitter))} for i in range(n)]
    rows += [{"program": "sysmon", "username": "even", "dest_ip": "10.0.0.1", "timestamp": T0 + dt.timedelta(seconds=60 * i)} for i in range(20)]
    rows += [{"program": "agent", "username": "told", "message": "DestinationIp=8.8.4.9", "timestamp": T0 + dt.timedelta(seconds=30 * i)} for i in range(12)]
    out, logs = replay(few_partitions, tmp_path, rows, stateful.beacons, "update")
    last = out.groupBy("username", "dest_ip").agg(F.max_by(F.struct("connections", "mean", "beacon"), "connections").alias("x")).select("username", "dest_ip", "x.*")
    got = {(r.username, r.dest_ip, r.connections) for r in last.where("beacon").collect()}
    want = {tuple(r) for r in stateful.batch_beacons(logs).collect()}
    assert got == want and {u for u, _, _ in got} == {"even", "slow", "told"}
    means = {r.subject: r["mean"] for r in apply(D.c2_beaconing, logs=logs).collect()}
    assert {r.username: r["mean"] for r in last.where("beacon").collect()} == pytest.approx(means, abs=1e-3)


def test_privileges_and_processes(few_partitions, tmp_path):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        at = T0 + dt.timedelta(seconds=rng.randrange(1800))
        rows.append({"win_id": 4672, "username": rng.choice(["amy", "bob"]), "timestamp": at, "message": "m"})
        rows.append({"win_id": 4688, "username": rng.choice(["amy", "bob"]), "timestamp": at + dt.timedelta(seconds=rng.randrange(-5, 20)), "message": f'NewProcessName="p{i}.exe" CommandLine="run {i}"'})
    out, logs = replay(few_partitions, tmp_path, rows, stateful.priv_to_proc, "append", name="procs")
    want = {tuple(r) for r in apply(lambda d: f"select username, row_id, proc_row, proc, cmd from ({D.asof_priv(d)}) as a where proc_row is not null", logs=logs).collect()}
    assert {tuple(r) for r in out.collect()} == want and len(want) > 20


def test_router_events_and_activities(few_partitions, tmp_path):
    rng = random.Random(8)
    lines = ["%SYS-5-CONFIG_I: Configured from vty by eve (10.0.0.1)", "%BGP-5-ADJCHANGE: neighbor 10.0.0.2 Down", "%LINK-3-UPDOWN: Interface Gi0/1, changed state to down"]
    rows = [{"host": rng.choice(["r1", "r2"]), "program": "rtr", "message": rng.choice(lines), "timestamp": T0 + dt.timedelta(seconds=rng.randrange(7200))} for _ in range(120)]
    out, logs = replay(few_partitions, tmp_path, rows, stateful.router_matches, "append", name="matches")
    ev = apply(D.router_events, logs=logs)
    want = {tuple(r) for r in apply(D.interval_matches, ev=ev).select("row_id", "router", "kind", "who", "activity").collect()}
    assert {tuple(r) for r in out.collect()} == want and len(want) > 20
