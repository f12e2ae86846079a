"""Enrichment: address scope, masking, indicator, asset and identity lookups, leases, common schema."""

from __future__ import annotations

from ..functions import ip as ipf
from ..plans.dialect import Dialect

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
TOKEN = r"(?i)((?:apikey|api_key|token|bearer)\s*[:=]\s*)([A-Za-z0-9._-]+)"


def classify_ip(d: Dialect) -> str:
    return f"select row_id, source_ip, {ipf.private_strict(d, 'source_ip')} as ip_private, {ipf.scope(d, 'source_ip')} as ip_scope from @logs"


def predicates(d: Dialect) -> str:
    """All six address predicates, side by side."""
    cols = {"p1": ipf.private_rfc, "p2": ipf.private_strict, "p3": ipf.external_test, "p4": ipf.external_loopback, "p5": ipf.public_text, "p6": ipf.external_text}
    return "select ip, " + ", ".join(f"{f(d, 'ip')} as {k}" for k, f in cols.items()) + " from @addresses"


def mask(d: Dialect, col: str) -> str:
    """E-mail addresses and the values of tokens replaced; only the value, not its name."""
    return d.sub(d.sub(col, EMAIL, "[redacted@email]"), TOKEN, "$1***")


def mask_pii(d: Dialect) -> str:
    return f"select id, {mask(d, 'text')} as text from @texts"


def outcome(col: str) -> str:
    low = f"lower({col})"
    return f"""case when {low} in ('success', 'ok', 'accept', 'allowed') then 'success'
      when {low} in ('failed', 'failure', 'blocked', 'reject', 'denied') then 'failure'
      when {low} in ('alert', 'info', 'unknown') then {low} end"""


#: Common-schema name -> column.
ECS = {
    "event.action": "action", "event.module": "program", "source.ip": "source_ip", "destination.ip": "dest_ip", "destination.port": "dest_port", "user.name": "username", "host.name": "host",
    "url.path": "path", "http.request.method": "method", "http.response.status_code": "http_status", "client.device": "device", "client.department": "dept", "destination.domain": "dst_host", "log.syslog.severity": "severity",
}


def ecs(d: Dialect) -> str:
    """The event table under common-schema names (dots as written)."""
    q = "`" if d.name == "spark" else '"'
    cols = [f"{c} as {q}{n}{q}" for n, c in ECS.items()] + [f"{outcome('status')} as {q}event.outcome{q}", f"{d.micros('timestamp')} as {q}@timestamp_us{q}"]
    return f"select row_id, {', '.join(cols)} from @logs".replace("@timestamp_us", "\x00").replace("\x00", "timestamp_us")


def threat_intel(d: Dialect) -> str:
    """Indicators (kind, value) that a row's addresses, domain or URL are among: a list of kind:field."""
    fields = [("ip", "source_ip"), ("ip", "dest_ip"), ("domain", "domain"), ("url", "path")]
    hits = " union all ".join(f"select l.row_id, '{k}:{c}' as hit from @logs as l join @indicators as i on i.kind = '{k}' and i.value = l.{c}" for k, c in fields)
    return f"""select l.row_id, coalesce(h.indicators, '') as indicators, h.indicators is not null as matched
      from @logs as l left join (select row_id, {d.joined('hit')} as indicators
      from ({hits}) as x group by row_id) as h on h.row_id = l.row_id"""


def one_per_key(table: str, key: str, values: tuple[str, ...]) -> str:
    """A lookup table with one row per key, as a dictionary has: of several the greatest in ``values``; null keys go."""
    order = ", ".join(f"{v} desc nulls last" for v in values)
    return f"(select {key}, {', '.join(values)} from (select {key}, {', '.join(values)}, row_number() over (partition by {key} order by {order}) as rk from {table} where {key} is not null) as u where rk = 1)"


def assets(d: Dialect) -> str:
    one = one_per_key("@assets", "ip", ("name",))
    return f"select l.row_id, a.name as source_asset, b.name as destination_asset from @logs as l left join {one} as a on a.ip = l.source_ip left join {one} as b on b.ip = l.dest_ip"


def identity(d: Dialect) -> str:
    return f"select l.row_id, i.department, i.role from @logs as l left join {one_per_key('@people', 'username', ('department', 'role'))} as i on i.username = l.username"


def leases(d: Dialect) -> str:
    """The MAC that held a row's address at its time: lease start <= time < end, of several the earliest start.

    An equi-join by address and day with the interval as filter: a lease stands
    in each day it touches.
    """
    day = lambda x: f"date_trunc('day', {x})"
    spread = f"select ip, mac, start, stop, {d.unnest(d.steps(day('start'), day('stop'), 1, 'day'), 'day')} from @leases where start < stop"
    hit = f"""select l.row_id, s.mac, row_number() over (partition by l.row_id order by s.start, s.mac) as rk
      from @points as l join ({spread}) as s on s.ip = l.ip and s.day = {day('l.timestamp')}
      where l.timestamp >= s.start and l.timestamp < s.stop"""
    return f"select p.row_id, h.mac from @points as p left join (select row_id, mac from ({hit}) as x where rk = 1) as h on h.row_id = p.row_id"


def address_number(d: Dialect, ip: str) -> str:
    """An IPv4 address as a number, null if it is none."""
    part = lambda i: f"try_cast(split_part({ip}, '.', {i}) as bigint)"
    return f"case when {d.has(ip, ipf.VALID)} then {part(1)} * 16777216 + {part(2)} * 65536 + {part(3)} * 256 + {part(4)} end"


def geo(d: Dialect) -> str:
    """Country of each distinct address by ranges (lo, hi, country), of several the narrowest.

    An equi-join by the address's /16 with the range as filter; a range stands
    under each /16 that it touches.  Each address is looked up once.
    """
    ips = f"""select ip, num, cast(floor(num / 65536.0) as bigint) as net from (select ip, {address_number(d, 'ip')} as num
      from (select distinct source_ip as ip from @logs where source_ip is not null) as x) as y
      where num is not null"""
    nets = "cast(floor(lo / 65536.0) as bigint)", "cast(floor(hi / 65536.0) as bigint)"
    span = f"sequence({nets[0]}, {nets[1]})" if d.name == "spark" else f"generate_series({nets[0]}, {nets[1]})"
    spread = f"select lo, hi, country, {d.unnest(span, 'net')} from @ranges where lo <= hi"
    hit = f"select i.ip, r.country, row_number() over (partition by i.ip order by r.hi - r.lo, r.country) as rk from ({ips}) as i join ({spread}) as r on r.net = i.net where i.num between r.lo and r.hi"
    return f"select l.row_id, g.country from @logs as l left join (select ip, country from ({hit}) as h where rk = 1) as g on g.ip = l.source_ip"
