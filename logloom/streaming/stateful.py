"""Stateful streaming detectors: connections at even distances, and joins of two streams in an interval of time.

Rows may come late by up to ``late``; what comes later is dropped by the engine.
Replaying a table in micro-batches gives what the batch detectors find in it, once
the watermark has passed its last row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import ip as ipf
from ..operators import detectors as D
from ..plans.dialect import apply
from .detect import LATE

BEACON = "username string, dest_ip string, connections long, mean double, beacon boolean"
_STATE = "n long, mean double, m2 double, last long, waiting array<bigint>"


def is_beacon(n: int, mean: float, var: float) -> bool:
    """The batch rule, on the connections so far."""
    return n >= 10 and ((var < 5 and mean < 300) or (var**0.5 < 2 and mean < 60))


def beacons(logs: DataFrame, late: str = LATE) -> DataFrame:
    """(username, dest_ip, connections, mean, beacon) after each advance of a user's connections to an outer address.

    The state of a pair is a count, the mean and variance of its gaps, the last instant,
    and the instants that the watermark has not passed: those wait until rows that may
    still come can't lie before them, then enter in order of time.  A timer wakes pairs
    that no further row wakes.  Its size is bounded by what comes within ``late``.
    """
    rows = apply(lambda d: f"select username, dest_ip, timestamp from {D.edr(d)} as l where username is not null and dest_ip is not null and timestamp is not null and {ipf.external_text(d, 'dest_ip')}", logs=logs)

    def advance(key: tuple[str, str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2, last, waiting = state.get if state.exists else (0, 0.0, 0.0, None, [])
        waiting = sorted([*waiting, *(int(t) for f in frames for t in f["us"])])
        mark = state.getCurrentWatermarkMs() * 1000
        ready = [t for t in waiting if t < mark]
        waiting = waiting[len(ready) :]
        for t in ready:
            if last is not None:
                gap = (t - last) / 1e6
                n_gaps = n  # gaps with this one: as many as connections before it
                step = gap - mean
                mean += step / n_gaps
                m2 += step * (gap - mean)
            n, last = n + 1, t
        state.update((n, mean, m2, last, waiting))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0] // 1000 + 1, mark // 1000 + 1))
        if ready:
            var = m2 / (n - 2) if n > 2 else float("nan")
            yield pd.DataFrame({"username": [key[0]], "dest_ip": [key[1]], "connections": [n], "mean": [mean if n > 1 else None], "beacon": [is_beacon(n, mean, var)]})

    timed = rows.withWatermark("timestamp", late).withColumn("us", F.unix_micros("timestamp"))
    return timed.groupBy("username", "dest_ip").applyInPandasWithState(advance, BEACON, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def priv_to_proc(logs: DataFrame, late: str = LATE, within: str = "10 seconds") -> DataFrame:
    """(username, row_id, proc_row, proc, cmd): each 4672 with the same user's first 4688 within ten seconds, by a join of two streams."""
    f = lambda k: F.nullif(F.regexp_extract("message", k + '="([^"]*)"', 1), F.lit(""))
    rows = logs.where(F.col("username").isNotNull()).withWatermark("timestamp", late)
    priv = rows.where("win_id = 4672").select(F.col("username").alias("who"), "row_id", F.col("timestamp").alias("at"))
    proc = rows.where("win_id = 4688").select("username", F.col("row_id").alias("proc_row"), F.col("timestamp").alias("then"), f("NewProcessName").alias("proc"), f("CommandLine").alias("cmd"))
    both = priv.join(proc, F.expr(f"who = username and then >= at and then <= at + interval {within}"))
    first = F.min(F.struct("then", "proc_row", "proc", "cmd")).alias("p")
    # one window per privilege: that of its own instant
    found = both.groupBy("username", "row_id", F.window("at", "1 second")).agg(first)
    return found.select("username", "row_id", "p.proc_row", "p.proc", "p.cmd")


def router_matches(logs: DataFrame, late: str = LATE) -> DataFrame:
    """(row_id, router, kind, who, activity): router events with the logins and configurations on that router in the five minutes before."""
    ev = apply(lambda d: f"select *, timestamp_micros(us) as at from ({D.router_events(d)}) as e", logs=logs).withWatermark("at", late)
    events = ev.where("kind in ('bgp', 'interface', 'ospf')").select("row_id", "router", "kind", "at")
    acts = ev.where("kind in ('login', 'config') and who is not null").select(F.col("router").alias("r"), "who", F.col("row_id").alias("activity"), F.col("at").alias("before"))
    joined = events.join(acts, F.expr("router = r and before <= at and before >= at - interval 5 minutes"))
    return joined.select("row_id", "router", "kind", "who", "activity")


def batch_beacons(logs: DataFrame) -> DataFrame:
    """(username, dest_ip, connections) of the batch detector, to compare with."""
    return apply(D.c2_beaconing, logs=logs).select(F.col("subject").alias("username"), "dest_ip", "connections")


