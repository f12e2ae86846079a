"""Oracles written apart from the queries that they check, in DuckDB's own SQL.

The other oracles are the query's text in the other dialect and so check that both
engines agree on it; these state the same results in another way.  ``@logs`` is
the log table of the query, ``@tagged`` and ``@lines`` what its operator reads.
"""

from __future__ import annotations

from . import projection as P
from . import rendered
from .dialect import DUCK, TABLES, Text, doubles, named

_LEVEL = "case when score >= 8 then 'CRITICAL' when score >= 4 then 'WARNING' else 'INFO' end as severity"

SSH_LATERAL = f"""
select 'ssh_lateral_movement' as type, u as subject, {_LEVEL}, score, c as logins, ips, hosts from (
  select u, count(*) as c, count(distinct ip) as ips, count(distinct host) as hosts,
    least(10, list_max([case when count(distinct ip) >= 5 then 8.5 end, case when count(distinct ip) >= 3 then 7 end, 5])
      + (count(*) >= 10)::int + (count(distinct host) >= 5)::int)::double as score
  from (select regexp_extract(message, '(?i)accepted\\s+\\S+\\s+for\\s+(\\S+)\\s+from', 1) as u, regexp_extract(message, '(?i)from\\s+([0-9.]+)\\s+port', 1) as ip, host
    from @logs where message similar to '(?is).*accepted\\s+(publickey|password).*' and (program ilike '%sshd%' or message ilike '%sshd%' or message similar to '(?is).*accepted\\s+(publickey|password)\\s+for.*')) as a
  where u not in ('', '(unknown)', 'nan') and ip <> '' group by u) as g"""

BRUTEFORCE = f"""
select 'credential_bruteforce_detected' as type, source_ip as subject, {_LEVEL}, score, c as logins, f as failed, u as users from (
  select source_ip, c, f, u, round(if(f / c >= 0.8, greatest(10 * f / c, 9), 10 * f / c), 6)::double as score from (
    select source_ip, count(*) as c, count(*) filter (status ilike '%fail%' or status ilike '%denied%') as f, count(distinct username) as u
    from @logs where (program ilike '%sshd%' or action ilike '%login%' or action ilike '%logon%') and trim(source_ip) <> '' group by all) as g
  where c >= 5 and f >= 3 and f / c >= 0.4) as s"""

PORT_SCAN = """
with g as (select source_ip, count(*) as c, list_sort(list_distinct(list(dest_port))) as p from @logs where lower(status) in ('blocked', 'denied') and source_ip is not null group by all),
x as (select *, list_transform(range(1, len(p)), lambda i: p[i + 1] - p[i]) as steps from g where c >= 5 and len(p) >= 3),
y as (select *, len(list_filter(steps, lambda z: z <= 5)) as small, len(list_filter(steps, lambda z: z <= 100)) as mid, len(steps) as k from x)
select 'port_scan_detected' as type, source_ip as subject, 'CRITICAL' as severity, 8::double as score, len(p) as ports,
  case when small = k then 'sequential' when len(p) >= 4 and mid >= 0.7 * k then 'methodical' else 'multi-port' end as pattern
from y where small = k or small >= 0.3 * k or mid >= 0.7 * k or len(p) >= 4"""

DOWNLOADS = """
select username, round(avg(c), 6) as daily_mean, round(coalesce(stddev_samp(c), 0), 6) as daily_std, count(*) as days from (
  select coalesce(nullif(username, ''), '(unknown)') as username, timestamp::date as day, count(*)::double as c from @logs
  where action ilike '%download%' or message ilike '%download%' or message ilike '%tải xuống%' group by all) as d group by username"""

ROLLING = """
with m as (select date_trunc('minute', timestamp) as t, count(*) as c from @logs where timestamp is not null group by all),
cal as (select unnest(generate_series(min(t), max(t), interval 1 minute)) as t from m),
e as (select cal.t, coalesce(m.c, 0) as c from cal left join m using (t))
select epoch_us(a.t) as us, a.c as epm, round(avg(b.c), 6) as ma, round(stddev_pop(b.c), 6) as sd
from e as a join e as b on b.t > a.t - interval 10 minute and b.t <= a.t group by a.t, a.c having count(*) >= 5"""

NOISE_BURST = """
with t as (select *, row_number() over (order by timestamp, row_id) as r, row_number() over (partition by noise_key order by timestamp, row_id) as k from @tagged where noise_key is not null)
select arg_min(row_id, r) as row_id, noise_key, count(*) as collapsed_count from t group by noise_key, r - k"""

ASOF = """
with p as (select * from @logs where win_id = 4672 and username is not null and timestamp is not null),
q as (select username, timestamp, row_id, regexp_extract(message, 'NewProcessName="([^"]*)"', 1) as proc, regexp_extract(message, 'CommandLine="([^"]*)"', 1) as cmd from @logs where win_id = 4688 and timestamp is not null),
j as (select p.username, p.row_id, q.row_id as proc_row, q.proc, q.cmd, row_number() over (partition by p.row_id order by q.timestamp, q.row_id) as k
  from p left join q on q.username = p.username and q.timestamp >= p.timestamp and q.timestamp <= p.timestamp + interval 10 second)
select username, row_id, proc_row, proc, cmd from j where k = 1"""

MULTILINE = """
with n as (select file, line_no, line, sum(case when line not like ' %' then 1 else 0 end) over (partition by file order by line_no) as record from @lines)
select file, min(line_no) as line_no, string_agg(line, chr(10) order by line_no) as line from n group by file, record"""


_ROUTER = """
r as (select host, timestamp as t, message as m from @logs where message similar to '(?is).*%((BGP|OSPF|LINK|LINEPROTO|SEC_LOGIN)-[0-9]+-|SYS-[0-9]+-CONFIG_I).*'),
k as (select *, case when m ~ '(?is).*%SEC_LOGIN-[0-9]+-LOGIN_SUCCESS.*\\[user:.*\\[source:.*' then 'login' when m ~ '(?is).*%BGP-[0-9]+-ADJCHANGE.*neighbor [0-9.]+ Down.*' then 'bgp'
    when m ~ '(?is).*%(LINK|LINEPROTO)-[0-9]+-UPDOWN.*Interface .*changed state to (up|down).*' then 'interface' when m ~ '(?is).*%OSPF-[0-9]+-ADJCHG.*Nbr [0-9.]+ on .* from .* to .*' then 'ospf'
    when m ~ '(?is).*%SYS-[0-9]+-CONFIG_I.*Configured from .* by .*' then 'config' end as kind from r where host is not null),
acts as (select host, t, kind, case kind when 'login' then split_part(split_part(m, '[user:', 2), ']', 1) else split_part(split_part(m, ' by ', 2), ' ', 1) end as who from k where kind in ('login', 'config')),
noise as (select *, kind = 'ospf' and m ilike '%from FULL to%' and m not ilike '%to FULL%' as down from k where kind in ('bgp', 'interface', 'ospf'))"""


def _unattributed(kind: str, name: str, least: int, hard: str, high: str, low: str) -> str:
    """Events without an activity on their router in the five minutes before, by a subquery per event."""
    return f"""with {_ROUTER},
alone as (select * from noise where kind = '{kind}' and not exists (select 1 from acts where acts.host = noise.host and acts.t between noise.t - interval 5 minute and noise.t)),
g as (select count(*) as c, count(*) filter (down) as downs, (select greatest(epoch(max(t) - min(t)) / 60, 1) from r) as minutes from alone),
q as (select *, c / minutes as rate from g where c >= {least})
select '{name}' as type, 'network' as subject, if({hard}, 'CRITICAL', 'WARNING') as severity, round(if({hard}, {high}, {low}), 6)::double as score, c as events, round(rate, 6) as rate from q"""


BGP = _unattributed("bgp", "bgp_flap_attack_unattributed", 5, "rate >= 1", "least(9, 6.5 + rate)", "least(6, 4.5 + rate)")
INTERFACE = _unattributed("interface", "interface_flap_attack_unattributed", 10, "rate >= 2", "least(8, 6 + rate / 2)", "least(5.5, 4 + rate / 2)")
OSPF = _unattributed("ospf", "ospf_storm_unattributed", 5, "rate >= 1 or downs >= 5", "least(8, 6 + rate / 2)", "least(5.5, 4.5 + rate)")

SUSPECTS = f"""with {_ROUTER},
hits as (select who, noise.host, noise.kind, down from noise join acts on acts.host = noise.host and noise.t between acts.t and acts.t + interval 5 minute union all select who, host, 'config', false from acts where kind = 'config'),
g as (select who, count(*) filter (kind = 'config') as cfg, count(*) filter (kind = 'bgp') as bgp, count(*) filter (kind = 'interface') as iface, count(*) filter (kind = 'ospf') as ospf, count(*) filter (down) as downs, count(distinct host) as hosts from hits where who <> '' group by who),
t as (select *, 10 * cfg + bgp + iface + ospf as corr from g order by corr desc, cfg desc, who limit 5),
s as (select *, list_filter([if(bgp >= 3, 'bgp_flap_correlated', null), if(iface >= 5, 'interface_flap_correlated', null), if(ospf >= 3 or downs >= 2, 'ospf_storm_correlated', null), if(cfg >= 1, 'config_tampering', null)], lambda x: x is not null) as kinds,
  least(9.5, list_max([if(cfg >= 3, 8, if(cfg >= 1, 6.5, 5)), if(corr >= 80, 9, if(corr >= 50, 8, if(corr >= 30, 7, 0)))]) + if(hosts >= 5, 0.5, 0))::double as score from t)
select array_to_string(kinds, ',') as type, who as subject, case when score >= 7 then 'CRITICAL' else 'WARNING' end as severity, score, corr, bgp, iface, ospf, cfg from s where len(kinds) > 0"""

_EDR = """
e as (select username as u, timestamp as t, row_id, dept, coalesce(dest_ip, nullif(regexp_extract(message, 'DestinationIp=([0-9.]+)', 1), '')) as ip, lower(coalesce(image, nullif(regexp_extract(message, 'Image=([^ ]+)', 1), ''))) as image
  from @logs where (program = 'sysmon' or message similar to '(?is).*(sysmon.*eventid=3|destinationip=|destinationport=).*') and username is not null)"""

BEACONS = f"""with {_EDR},
g as (select u, ip, list(epoch_us(t) order by t, row_id) as ts from e where ip is not null group by all),
x as (select u, ip, len(ts) as n, list_transform(range(1, len(ts)), lambda i: (ts[i + 1] - ts[i]) / 1e6) as d from g where len(ts) >= 10),
y as (select *, list_avg(d) as mean, list_var_samp(d) as v from x)
select 'c2_beaconing_detected' as type, u as subject, 'CRITICAL' as severity, 10::double as score, ip as dest_ip, n as connections, round(mean, 3) as mean from y
where not (ip similar to '(10|127)[.].*' or ip similar to '192[.]168[.].*' or ip similar to '172[.](1[6-9]|2[0-9]|3[01])[.].*' or ip = '') and ((v < 5 and mean < 300) or (sqrt(v) < 2 and mean < 60))"""


def _tagged(d) -> str:
    from ..operators import noise

    return named(noise.tagged(d), {"logs": f"({P.logs(d)})"})


def _stream(d) -> str:
    return named(rendered.stream(d), {"logs": f"({P.logs(d)})"})


#: Query -> (oracle, what its input is, the input).
ORACLES: dict[str, tuple[str, str, Text]] = {
    "detect_ssh_lateral": (SSH_LATERAL, "logs", P.logs), "detect_bruteforce_by_ip": (BRUTEFORCE, "logs", P.logs), "detect_port_scan": (PORT_SCAN, "logs", P.logs), "download_daily": (DOWNLOADS, "logs", P.logs),
    "epm_rolling10": (ROLLING, "logs", P.logs), "noise_burst": (NOISE_BURST, "tagged", _tagged), "asof_priv_to_proc": (ASOF, "logs", P.dense), "multiline_merge": (MULTILINE, "lines", _stream),
    "detect_bgp_unattributed": (BGP, "logs", P.logs), "detect_interface_unattributed": (INTERFACE, "logs", P.logs), "detect_ospf_unattributed": (OSPF, "logs", P.logs), "detect_router_suspects": (SUSPECTS, "logs", P.dense),
    "detect_c2_beaconing": (BEACONS, "logs", P.steady),
}


def oracle(name: str) -> str:
    sql, kind, source = ORACLES[name]
    inner = named(doubles(source(DUCK)), {t: t for t in TABLES})
    return f"with source_rows as ({inner}) select * from ({named(sql, {kind: 'source_rows'})}) as checked"
