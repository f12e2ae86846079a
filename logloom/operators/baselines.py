"""Baselines: daily features per user, device and group, their statistics, membership, upserts."""

from __future__ import annotations

from ..plans.dialect import Dialect
from .detectors import DOWNLOAD, LOCAL_HOURS, features, n
from .series import counted

MEASURES = ("events", "unique_src_ips", "login_fail", "ssh_events", "http_4xx", "http_5xx")
UNKNOWN = "coalesce(nullif(username, ''), '(unknown)')"


def daily(d: Dialect, key: str) -> str:
    return f"select {key} as entity, date_trunc('day', timestamp) as day, count(distinct username) as unique_users, {features(d)} from @logs where timestamp is not null and {key} is not null group by 1, 2"


def user_daily(d: Dialect) -> str:
    return f"select entity as username, {d.micros('day')} as day_us, {', '.join(MEASURES)} from ({daily(d, UNKNOWN)}) as x"


def stats(measures: tuple[str, ...]) -> str:
    return ", ".join(f"round(avg(cast({m} as double)), 6) as {m}_mean, round(coalesce(stddev_samp(cast({m} as double)), 0), 6) as {m}_std" for m in measures)


def hour_profile(d: Dialect) -> str:
    h = d.hour("timestamp")
    return f"""select {UNKNOWN} as username, {n('count(*)')} as events, round(avg(cast({h} as double)), 6) as mean, round(coalesce(stddev_samp(cast({h} as double)), 0), 6) as std, round({d.percentile(f'cast({h} as double)', 0.1)}, 6) as p10, round({d.percentile(f'cast({h} as double)', 0.9)}, 6) as p90
      from @logs where timestamp is not null group by 1"""


def user_stats(d: Dialect) -> str:
    """Mean and deviation over a user's days, with the profile of the hours."""
    return f"""select s.*, h.events, h.mean, h.std, h.p10, h.p90 from (select entity as username, {stats(MEASURES)}
      from ({daily(d, UNKNOWN)}) as x group by entity) as s left join ({hour_profile(d)}) as h on h.username = s.username"""


def device_stats(d: Dialect) -> str:
    return f"select entity as host, {stats(('events', 'unique_users', 'unique_src_ips', 'http_5xx'))} from ({daily(d, 'coalesce(host, source_ip)')}) as x group by entity"


def user_groups(d: Dialect) -> str:
    """A user's group: the one of the first row by time."""
    return "select username, grp from (select username, coalesce(dept, '(unknown)') as grp, row_number() over (partition by username order by timestamp, row_id) as rk from @logs where nullif(username, '') is not null) as x where rk = 1"


def group_stats(d: Dialect) -> str:
    """Over the user-days of a group's users, without sums per day."""
    return f"select coalesce(g.grp, '(unknown)') as grp, {stats(MEASURES)} from ({daily(d, UNKNOWN)}) as x left join ({user_groups(d)}) as g on g.username = x.entity group by 1"


def global_stats(d: Dialect) -> str:
    """Hourly counts and bytes, zeros between the first and last hour included.

    The other engine's text lays a calendar over the span; here the hours without
    events are a number, which weighs as many zeros.
    """
    f = lambda c: f"cast({c} as double)"
    if d.name == "duck":
        t = "date_trunc('hour', timestamp)"
        cal = f"select {d.unnest(d.steps('lo', 'hi', 1, 'hour'), 'hour')} from (select min({t}) as lo, max({t}) as hi from @logs where timestamp is not null) as s"
        hours = f"select coalesce(e, 0) as e, coalesce(b, 0) as b from ({cal}) as c left join (select {t} as h, count(*) as e, sum(bytes) as b from @logs where timestamp is not null group by {t}) as x on x.h = c.hour"
        return f"""select round(avg({f('e')}), 6) as events_per_hour_mean, round(coalesce(stddev_samp({f('e')}), 0), 6) as events_per_hour_std, round(avg({f('b')}), 4) as bytes_per_hour_mean, round(coalesce(stddev_samp({f('b')}), 0), 2) as bytes_per_hour_std, round({d.percentile(f('b'), 0.95)}, 4) as upload_bytes_per_hour_p95, {n('max(e)')} as max_events_per_hour, {n('max(b)')} as max_bytes_per_hour
          from ({hours}) as h"""
    hours = f"select t, c as e, coalesce(b, 0) as b from ({counted('hour', ', sum(bytes) as b')}) as x"
    span = f"select cast((unix_micros(max(t)) - unix_micros(min(t))) / 3600000000 + 1 as bigint) as n, count(*) as k, sum(e) as se, sum({f('b')}) as sb from ({hours}) as y"
    rows = f"select e, b, cast(1 as bigint) as w from ({hours}) as z union all select 0 as e, 0 as b, n - k as w from ({span}) as s where n > k"
    sd = lambda c, m: f"coalesce(case when max(n) > 1 then sqrt(sum(w * ({f(c)} - {m} / n) * ({f(c)} - {m} / n)) / (max(n) - 1)) end, 0)"
    return f"""select round(max(se) / max(n), 6) as events_per_hour_mean, round({sd('e', 'se')}, 6) as events_per_hour_std, round(max(sb) / max(n), 4) as bytes_per_hour_mean, round({sd('b', 'sb')}, 2) as bytes_per_hour_std, round(percentile({f('b')}, 0.95, w), 4) as upload_bytes_per_hour_p95, {n('max(e)')} as max_events_per_hour, {n('max(b)')} as max_bytes_per_hour
      from ({rows}) as r cross join ({span}) as s"""


def download_daily(d: Dialect) -> str:
    per = f"select {UNKNOWN} as username, date_trunc('day', timestamp) as day, count(*) as c from @logs where {DOWNLOAD} group by 1, 2"
    return f"select username, round(avg(cast(c as double)), 6) as daily_mean, round(coalesce(stddev_samp(cast(c as double)), 0), 6) as daily_std, {n('count(*)')} as days from ({per}) as x group by username"


def login_time(d: Dialect) -> str:
    """Typical first and last hour of a day, in local time, of rows about logins."""
    local = d.plus("timestamp", LOCAL_HOURS, "hour")
    login = "(" + " or ".join(f"lower(coalesce({c}, '')) like '%{w}%'" for c in ("action", "message") for w in ("logon", "login")) + ")"
    per = f"select {UNKNOWN} as username, date_trunc('day', {local}) as day, min({d.hour(local)}) as lo, max({d.hour(local)}) as hi from @logs where {login} group by 1, 2"
    return f"select username, round({d.percentile('cast(lo as double)', 0.1)}, 6) as start_p10, round({d.percentile('cast(hi as double)', 0.9)}, 6) as end_p90, {n('count(*)')} as days from ({per}) as x group by username"


#: Columns that a mapping rule may name.
RULE_COLUMNS = ("source_ip", "username", "host", "device", "dept", "program")


def group_case(d: Dialect, rules: list[dict], default: str = "(unknown)") -> str:
    """Ordered rules {match_col, type, match, group}; the first that fits, else the default.

    Unknown columns are skipped; a pattern that doesn't compile fits nothing.
    """
    import re

    whens = []
    for r in rules:
        col, kind, match = r.get("match_col", "source_ip"), r.get("type", "prefix").lower(), str(r.get("match", ""))
        if col not in RULE_COLUMNS:
            continue
        text = f"coalesce({col}, '')"
        if kind == "prefix":
            test = f"starts_with({text}, {d.text(match)})" if d.name == "duck" else f"startswith({text}, {d.text(match)})"
        elif kind == "exact":
            test = f"{text} = {d.text(match)}"
        else:
            try:
                re.compile(match)
            except re.error:
                continue
            test = d.has(text, match)
        whens.append(f"when {test} then {d.text(str(r.get('group', '(unknown)')))}")
    return f"case {' '.join(whens)} else {d.text(default)} end" if whens else d.text(default)


RULES = [{"match_col": "source_ip", "type": "prefix", "match": "10.0.1.", "group": "Sales"}, {"match_col": "username", "type": "exact", "match": "user7",
    "group": "Finance"}, {"match_col": "host", "type": "regex", "match": r"host[0-3]$", "group": "Engineering"}, {"match_col": "nothing", "type": "exact",
    "match": "x", "group": "Never"}, {"match_col": "host", "type": "regex", "match": "(", "group": "Never"}]


def group_mapped(d: Dialect, rules: list[dict] = RULES) -> str:
    return f"select *, {group_case(d, rules)} as grp from @logs"


def group_rules(d: Dialect) -> str:
    return f"select row_id, grp from ({group_mapped(d)}) as m"


def membership(d: Dialect) -> str:
    return f"select grp, {d.joined('nullif(username, ' + chr(39) * 2 + ')')} as users, {d.joined('source_ip')} as source_ips, {d.joined('host')} as hosts from ({group_mapped(d)}) as m group by grp"


def majority_group(d: Dialect, rules: list[dict] = RULES) -> str:
    """A device's most frequent group, of equals the first by name; a host's entry gives way to an address's of the same name."""
    part = lambda c, k: f"""select device, grp, {k} as prio from (select {c} as device, grp, row_number() over (partition by {c}
      order by count(*) desc, grp) as rk from ({group_mapped(d, rules)}) as m
      where {c} is not null group by {c}, grp) as r where rk = 1"""  # noqa: E731
    return f"select device, grp from (select device, grp, row_number() over (partition by device order by prio desc) as rk from ({part('host', 0)} union all {part('source_ip', 1)}) as u) as x where rk = 1"


def upsert(d: Dialect, key: str = "k") -> str:
    """Rows of @new, and those of @old whose key @new lacks; of equal keys in @new the last; null keys go."""
    return f"""select {key}, v from (select {key}, v, row_number() over (partition by {key}
      order by seq desc) as rk from @new where {key} is not null) as x where rk = 1
      union all select o.{key}, o.v from @old as o left join (select distinct {key}
      from @new) as f on f.{key} = o.{key} where f.{key} is null and o.{key} is not null"""


def map_merge(d: Dialect) -> str:
    """Two maps, the new one first."""
    return "select coalesce(b.k, a.k) as k, coalesce(b.v, a.v) as v from @old as a full outer join @new as b on a.k = b.k"


def groups_merge(d: Dialect) -> str:
    """Members of each group from both tables, in order."""
    return f"select grp, {d.joined('member')} as members from (select grp, member from @old union all select grp, member from @new) as u group by grp"
