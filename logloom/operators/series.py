"""Ordered analytics: calendars with zeros, sessions, bursts."""

from __future__ import annotations

from ..plans.dialect import Dialect


def counted(unit: str, more: str = "") -> str:
    """Events per minute or hour that has any."""
    return f"select date_trunc('{unit}', timestamp) as t, count(*) as c{more} from @logs where timestamp is not null group by date_trunc('{unit}', timestamp)"


def filled(d: Dialect, unit: str) -> str:
    """Events per minute or hour between the first and the last, zeros included.

    The other engine's text lays a calendar over the whole span.  Here each minute that
    has events is followed by the zeros up to the next one, a day of them at a time, so
    no array is longer than a day and gaps are filled wherever their minute lies; the
    only window that is not per day has one row per day that has events.
    """
    if d.name == "duck":
        cal = f"select {d.unnest(d.steps('lo', 'hi', 1, unit), unit)} from (select min(t) as lo, max(t) as hi from ({counted(unit)}) as a) as span"
        return f"select cal.{unit}, cast(coalesce(c, 0) as bigint) as epm from ({cal}) as cal left join ({counted(unit)}) as x on x.t = cal.{unit}"
    day, one = "date_trunc('day', t)", f"interval 1 {unit}"
    days = f"select day, lead(first) over (order by day) as later from (select {day} as day, min(t) as first from ({counted(unit)}) as a group by {day}) as f"
    gaps = f"""select t + {one} as lo, coalesce(inner_next, later) - {one} as hi
      from (select t, {day} as day, lead(t) over (partition by {day} order by t) as inner_next from ({counted(unit)}) as a) as m join ({days}) as n on n.day = m.day"""
    chunks = f"select explode(sequence(lo, hi, interval 1 day)) as lo, hi from ({gaps}) as g where lo <= hi"
    zeros = f"select explode(sequence(lo, least(lo + interval 1 day - {one}, hi), {one})) as {unit}, cast(0 as bigint) as epm from ({chunks}) as h"
    return f"select t as {unit}, c as epm from ({counted(unit)}) as own union all {zeros}"


def per_minute(d: Dialect) -> str:
    return filled(d, "minute")


def hourly(d: Dialect) -> str:
    return f"select {d.micros('hour')} as us, epm from ({filled(d, 'hour')}) as h"


def rolling10(d: Dialect) -> str:
    """Mean and population deviation of ten minutes with the current one; five minutes are needed.

    By sums over a window per day; the nine minutes before a day's first ones are copied into that day.
    """
    day = "date_trunc('day', minute)"
    carried = f"""select minute, epm, {day} as day, true as own from ({filled(d, 'minute')}) as m
      union all select minute, epm, date_trunc('day', {d.plus('minute', 9, 'minute')}) as day, false as own
      from ({filled(d, 'minute')}) as m where date_trunc('day', {d.plus('minute', 9, 'minute')}) > {day}"""
    frame = "partition by day order by minute rows between 9 preceding and current row"
    return f"""select {d.micros('minute')} as us, epm, round(ma, 6) as ma, round(sd, 6) as sd
      from (select minute, epm, own, avg(epm) over ({frame}) as ma, stddev_pop(epm) over ({frame}) as sd, count(*) over ({frame}) as k
      from ({carried}) as h) as r where own and k >= 5"""


def sessionize(d: Dialect, gap_us: int = 15 * 60 * 1_000_000) -> str:
    """Sessions of (source_ip, username): a new one when the gap is longer, not when equal; numbered from 0."""
    us = d.micros("timestamp")
    new = f"case when {us} - lag({us}) over (partition by source_ip, username order by timestamp, row_id) > {gap_us} then 1 else 0 end"
    return f"""select row_id, source_ip || '-' || username || '-' || cast(sum(new) over (partition by source_ip, username
      order by timestamp, row_id rows between unbounded preceding and current row) as string) as session_id
      from (select *, {new} as new from @logs where source_ip is not null and username is not null) as s"""


def sessions(d: Dialect, gap_us: int = 15 * 60 * 1_000_000) -> str:
    """Events and span of each session.

    Rows of one slot as long as the gap are never apart by more, so Spark's text takes the rows of a
    slot together first: a session begins at slots only, and no row (they have distinct ids) is sorted or
    joined to itself.
    """
    us = d.micros("timestamp")
    if d.name == "duck":
        return f"""select session_id, cast(count(*) as bigint) as events, cast(max({d.micros('l.timestamp')}) - min({d.micros('l.timestamp')}) as bigint) as span_us
      from ({sessionize(d, gap_us)}) as s join @logs as l on l.row_id = s.row_id group by session_id"""
    slots = f"""select source_ip, username, slot, count(*) as events, min(us) as lo, max(us) as hi
      from (select source_ip, username, {us} as us, {us} - pmod({us}, {gap_us}) as slot from @logs where source_ip is not null and username is not null) as r group by source_ip, username, slot"""
    new = f"case when lo - lag(hi) over (partition by source_ip, username order by slot) > {gap_us} then 1 else 0 end"
    return f"""select session_id, cast(sum(events) as bigint) as events, cast(max(hi) - min(lo) as bigint) as span_us
      from (select events, lo, hi, source_ip || '-' || username || '-' || cast(sum(new) over (partition by source_ip, username
      order by slot rows between unbounded preceding and current row) as string) as session_id
      from (select *, {new} as new from ({slots}) as q) as s) as t group by session_id"""
