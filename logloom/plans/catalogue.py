"""The catalogue of queries: every operator bound to inputs made from the tables."""

from __future__ import annotations

from functools import lru_cache

from ..functions import scoring
from ..operators import baselines as B
from ..operators import detectors as D
from ..operators import enrich as E
from ..operators import noise, report, series
from ..sources import adapters, parsers
from . import projection as P
from . import rendered
from .dialect import SPARK, Bound, Dialect, Text, bind, named, oracle
from .projection import logs

SPLIT = "timestamp '2024-01-15 00:00:00'"


def on_logs(text: Text) -> Text:
    return bind(text, logs=logs)


#: Detectors whose thresholds the plain log table doesn't reach get one that does.
INPUT = {
    "dhcp_rogue_server": P.dense, "dns_nxdomain_storm": P.storm, "win_privesc": P.dense, "router_suspects": P.dense, "global_burst": P.peak, "deny_burst_minute": P.spread, "deny_distributed": P.spread,
    "exfil_row": P.heavy, "exfil_outlier": P.heavy, "bruteforce_target": P.inside, "blocked_ratio": P.auth, "c2_beaconing": P.steady,
}


def _few(d: Dialect) -> str:
    return "select distinct username, cast(1 as double) as events_mean, cast(0.5 as double) as events_std, cast(1 as double) as unique_src_ips_mean, cast(0 as double) as unique_src_ips_std, cast(3 as double) as login_fail_mean, cast(2 as double) as login_fail_std from @logs where username is not null"


#: A baseline of one event a day.
few_events = bind(_few, logs=logs)


#: The training part, without two users that so are new later; and the rest.
before = bind(lambda d: f"select * from @logs where timestamp < {SPLIT} and coalesce(username, '') not in ('user3', 'user17')", logs=logs)
after = bind(lambda d: f"select * from @logs where timestamp >= {SPLIT}", logs=logs)


def trained(d: Dialect) -> str:
    """User statistics with those of data access per day."""
    per = D.data_access_counts(d).replace("select coalesce(", "select date_trunc('day', timestamp) as day, coalesce(", 1).replace("group by 1", "group by 1, 2")
    access = f"select username, {B.stats(('db_queries', 'suspicious_ops'))} from ({per}) as p group by username"
    return f"select s.*, a.db_queries_mean, a.db_queries_std, a.suspicious_ops_mean, a.suspicious_ops_std from ({B.user_stats(d)}) as s left join ({access}) as a on a.username = s.username"


trained_before = bind(trained, logs=before)


def with_stats(text: Text) -> Text:
    return bind(text, logs=after, stats=trained_before)


def shown(text: Text, columns: list[str]) -> Text:
    """Instants as microseconds."""
    return lambda d: "select " + ", ".join(f"{d.micros('timestamp')} as ts_us" if c == "timestamp" else c for c in columns) + f" from ({text(d)}) as t"


def parsed(name: str) -> Text:
    f = parsers.FORMATS[name]
    return bind(shown(f.text, ["line_no", *f.columns(SPARK)]), lines=bind(rendered.lines(name), logs=logs))


def _rows(process: str | None, message: Text | None = None) -> Text:
    def build(d: Dialect) -> str:
        body = message(d) if message else "message"
        proc = f"'{process}'" if process else "program"
        return f"select {d.format('timestamp', '%Y-%m-%d %H:%M:%S')} as timestamp, host, {proc} as process, '1' as pid, 'info' as severity, 'auth' as facility, {body} as message, dept as department from @logs as l"

    return build


def _body(name: str) -> Text:
    """The message part of a rendered line."""
    return lambda d: d.rx("(" + rendered.bodies(d)[name] + ")", r"(?:\]|Sysmon|WinEvent): (.*)$")


def layout_rows(d: Dialect) -> dict[str, Text]:
    iso = d.format("timestamp", "%Y-%m-%d %H:%M:%S")
    q = "`" if d.name == "spark" else '"'
    src = "from @logs as l"
    text = lambda cols: lambda _: f"select {cols} {src}"
    return {
        "zeek_dns_csv": text(f"{iso} as timestamp, source_ip, username, 'query: ' || domain || ' IN ' || query_type || {rendered.pick(chr(39) + ' +' + chr(39), chr(39) + ' +E' + chr(39))} as message"),
        "apache_extended_csv": _rows("httpd", lambda d_: rendered.bodies(d_)["apache_combined"]),
        "dhcp_extended_csv": _rows("dhcpd", _body("dhcp")), "router_csv": _rows("ios", _body("router_ios")), "edr_extended_csv": _rows("sysmon", _body("sysmon")),
            "dns_extended_csv": _rows("named", _body("bind")), "winevent_csv": _rows("winevent", _body("winevent")), "firewall_csv": _rows("fw", _body("firewall_kv")),
        "syslog_csv": _rows(None),
        "suricata_csv": text(f"{iso} as timestamp, source_ip as src_ip, dest_ip as dst_ip, cast(1000 + n as string) as src_port, cast(dest_port as string) as dst_port, 'TCP' as protocol, {rendered.pick(chr(39) + 'Attempted Recon' + chr(39), chr(39) + 'Policy' + chr(39), chr(39) + 'x' + chr(39))} as classification, '2' as priority, '1:1:1' as sid, message"),
        "squid_csv": text(f"{iso} as timestamp, source_ip as client_ip, method, 'http://h.example.org' || path as url, cast(coalesce(http_status, 200) as string) as http_status, cast(bytes as string) as bytes_sent, '12' as duration, coalesce(username, '-') as {q}user{q}, 'text/html' as content_type"),
        "openssh_csv": text(f"cast(row_id as string) as lineid, {d.format('timestamp', '%b')} as date, {d.format('timestamp', '%d')} as day, {d.format('timestamp', '%H:%M:%S')} as time, 'sshd' as component, '5' as pid, 'Failed password for ' || coalesce(username, 'x') || ' from ' || source_ip as content, 'E1' as eventid, 'T' as eventtemplate"),
        "linux_csv": text(f"{d.format('timestamp', '%b')} as month, {d.format('timestamp', '%d')} as date, {d.format('timestamp', '%H:%M:%S')} as time, 'combo' as level, {rendered.pick(chr(39) + 'sshd(pam)' + chr(39), chr(39) + 'kernel' + chr(39))} as component, '5' as pid, 'Accepted password for ' || coalesce(username, 'x') || ' from ' || source_ip as content"),
        "windows_security_csv": text(f"{rendered.pick(chr(39) + 'Audit Success' + chr(39), chr(39) + 'Audit Failure' + chr(39))} as keywords, {d.format('timestamp', '%m/%d/%Y %H:%M:%S')} as date_and_time, 'Security' as source, cast(coalesce(win_id, 4625) as string) as event_id, 'Logon' as task_category, 'Subject: Account Name: ' || coalesce(username, '-') || ' Account Domain: CORP Logon ID: 0x3e7 Logon Type: 3 Source Network Address: ' || source_ip as message"),
        "apache_csv": text(f"{iso} as timestamp, source_ip as remote_addr, method, path, 'HTTP/1.1' as protocol, cast(coalesce(http_status, 200) as string) as http_status, cast(bytes as string) as bytes_sent, '-' as referrer, user_agent"),
    }


def adapted(name: str) -> Text:
    x = adapters.LAYOUTS[name]
    return bind(shown(x.text, list(x.select(SPARK))), rows=bind(lambda d: layout_rows(d)[name](d), logs=logs))


ADDRESSES = ["10.1.2.3", "172.16.0.1", "172.32.0.1", "192.168.1.1", "192.0.2.5", "198.51.100.7", "203.0.113.9", "127.0.0.1", "169.254.1.1", "8.8.8.8", "256.1.1.1", "None", "junk", "", None]


def _addresses(d: Dialect) -> str:
    return f"select ip from {d.values([(a,) for a in ADDRESSES], ['ip'])} as a union all select distinct source_ip from @logs"


addresses = bind(_addresses, logs=logs)


def indicators(d: Dialect) -> str:
    return "select * from " + d.values([("ip", "203.0.113.3"), ("ip", "198.51.100.4"), ("domain", "site3.example.com")], ["kind", "value"]) + " as i"


def asset_table(d: Dialect) -> str:
    return "select '10.0.' || cast(s_suppkey % 8 as string) || '.' || cast(s_suppkey % 20 as string) as ip, min(s_name) as name from @supplier group by 1"


def people(d: Dialect) -> str:
    return "select 'user' || cast(c_custkey % 20 as string) as username, min(c_mktsegment) as department, max(n_name) as role from @customer join @nation on n_nationkey = c_nationkey group by 1"


def _leases(d: Dialect) -> str:
    """A lease from the last event of each address and day."""
    return f"select source_ip as ip, 'mac-' || cast(max(row_id) as string) as mac, max(timestamp) as start, {d.plus('max(timestamp)', 30, 'hour')} as stop from @logs group by source_ip, date_trunc('day', timestamp)"


lease_table = bind(_leases, logs=logs)


points = bind(lambda d: "select row_id, timestamp, source_ip as ip from @logs", logs=logs)


def half(d: Dialect, new: bool, cols: str) -> str:
    return f"select {cols} from @customer where c_custkey % 3 <> {1 if new else 2}"


def keyed(new: bool) -> Text:
    v = "c_mktsegment || '!'" if new else "c_mktsegment"
    return lambda d: half(d, new, f"case when c_custkey % 50 = 0 then null else cast(c_custkey as bigint) end as k, {v} as v, c_custkey as seq")


def simple(new: bool) -> Text:
    v = "c_mktsegment || '!'" if new else "c_mktsegment"
    return lambda d: half(d, new, f"cast(c_custkey as bigint) as k, {v} as v")


def member(new: bool) -> Text:
    return lambda d: half(d, new, "cast(c_nationkey as bigint) as grp, c_mktsegment || cast(c_custkey % 7 as string) as member")


def ranges(d: Dialect) -> str:
    """Address ranges of countries, one inside another."""
    rows = [(167772160, 167903231, "VN"), (167837696, 167837951, "SG"), (3405803776, 3405804031, "US"), (3405803776, 3405803785, "CN"), (5, 4, "XX")]
    return f"select * from {d.values(rows, ['lo', 'hi', 'country'])} as r"


@lru_cache(maxsize=None)
def events_of(source: Text) -> Text:
    return bind(D.router_events, logs=source)


def united(d: Dialect) -> str:
    """Alerts of all detectors; those that compare with trained statistics read ``@after``."""
    return f"{D.all_alerts(d, False)} union all {named(D.all_alerts(d, names=list(D.WITH_STATS)), {'logs': '@after'})}"


class Together(Bound):
    """All detectors: one text for the oracle, a union of the detectors' frames in Spark."""

    def __init__(self, logs: Text, after: Text, stats: Text):
        super().__init__(united, {"logs": logs, "after": after, "stats": stats})

    def parts(self) -> list[tuple[str, Text]]:
        logs, after, stats = self.inputs.values()
        made = [(k, bind(t, logs=logs, **({"ev": events_of(logs)} if k in D.ON_EVENTS else {}))) for k, t in D.PLAIN.items()]
        return made + [(k, bind(t, logs=after, stats=stats)) for k, t in D.WITH_STATS.items()]


#: Alerts of all detectors.
alerts = Together(logs, after, trained_before)


def on_alerts(text: Text) -> Text:
    return bind(text, alerts=alerts)


def asof(d: Dialect) -> str:
    return f"select username, row_id, proc_row, proc, cmd from ({D.asof_priv(d)}) as a"


def json_fields(d: Dialect) -> str:
    return f"select event_id, try_cast({d.json('props', 'k')} as bigint) as props_k from @events"


def time_filter(d: Dialect) -> str:
    return "select row_id, program, status from @logs where timestamp >= timestamp '2024-01-10 00:00:00' and timestamp < timestamp '2024-01-12 00:00:00'"


def normalised(d: Dialect) -> str:
    """The six columns that every format has, rows without an instant left out."""
    return f"select row_id, {d.micros('timestamp')} as ts_us, source_ip, coalesce(nullif(username, ''), '(unknown)') as username, action, status, message from @logs where timestamp is not null"


def noise_tags(d: Dialect) -> str:
    return f"select row_id, noise_key from ({noise.tagged(d)}) as t"


def bursts(d: Dialect) -> str:
    return f"select row_id, noise_key, collapsed_count from ({noise.burst(d)}) as b"


def analysis(d: Dialect) -> str:
    """What an analyst's report says of each subject."""
    return "select subject, case when alerts >= 3 then 'HIGH' else 'LOW' end as risk_level, 'Summary of ' || types as summary, 'risk ' || severity_max as risks, 'watch ' || subject as actions from @subjects"


def worded(d: Dialect) -> str:
    return "select subject, 'Alert of ' || detector as text from @alerts"


rolled_up = bind(report.subject_rollup, alerts=alerts)


def searched(text: str, **how) -> Text:
    core = lambda d: report.client_search(d, text, **how)
    return bind(core, subjects=rolled_up, analysis=bind(analysis, subjects=rolled_up), alerts=bind(worded, alerts=alerts))


def told(d: Dialect) -> str:
    return "select subject, type, 'by ' || detector as text, score from @alerts"


payloads = bind(report.result_payload, subjects=rolled_up, told=bind(told, alerts=alerts), analysis=bind(analysis, subjects=rolled_up))


def local_times(d: Dialect) -> str:
    return f"select row_id, {report.local_time(d, 'timestamp')} as local_time from @logs"


def state_counts(d: Dialect) -> str:
    """Rows per baseline table."""
    parts = {"user_stats": B.user_stats, "device_stats": B.device_stats, "group_stats": B.group_stats}
    return " union all ".join(f"select '{k}' as name, cast(count(*) as bigint) as rows from ({t(d)}) as x{i}" for i, (k, t) in enumerate(parts.items()))


@lru_cache
def catalogue() -> dict[str, Text]:
    out: dict[str, Text] = {}
    for name in D.PLAIN:
        source = INPUT.get(name, logs)
        out[f"detect_{name}"] = bind(D.PLAIN[name], logs=source, ev=events_of(source)) if name in D.ON_EVENTS else bind(D.PLAIN[name], logs=source)
    for name in D.WITH_STATS:
        out[f"detect_{name}"] = with_stats(D.WITH_STATS[name])
    out["detect_download_spike"] = bind(D.download_spike, logs=logs, stats=few_events)
    out["detect_zscore_spike_low"] = bind(D.zscore_spike, logs=logs, stats=few_events)
    for name in parsers.FORMATS:
        out[f"parse_{name}"] = parsed(name)
    for name in adapters.LAYOUTS:
        out[f"adapt_{name}"] = adapted(name)
    out |= {
        "scores": on_alerts(scoring.table), "asof_priv_to_proc": bind(asof, logs=P.dense), "interval_corr_5m": bind(D.interval_matches, ev=events_of(P.dense)), "interval_anti_5m": bind(D.interval_anti,
            ev=events_of(logs)), "ip_user": on_logs(D.ip_user), "roles": on_logs(D.roles), "inter_arrival": on_logs(D.inter_arrival), "rolling_burst": bind(lambda d: f"select us, epm, round(ma, 6) as ma, round(sd, 6) as sd from ({D.rolling(d)}) as r", logs=P.peak),
        "data_access_counts": on_logs(D.data_access_counts), "activity": on_logs(D.activity),
        "epm_zero_fill": on_logs(series.hourly), "epm_rolling10": on_logs(series.rolling10), "sessionize": on_logs(series.sessionize), "sessions": bind(series.sessions, logs=P.dense),
        "noise_tags": on_logs(noise_tags), "noise_burst": on_logs(bursts), "noise_window": bind(noise.window_collapse, logs=P.dense), "noise_reduced": on_logs(noise.reduced),
        "classify_ip": on_logs(E.classify_ip), "ip_predicates": bind(E.predicates, addresses=addresses), "mask_pii": bind(E.mask_pii, texts=lambda d: "select doc_id as id, text from @documents"),
            "mask_conversations": bind(E.mask_pii, texts=lambda d: "select conv_id * 1000 + turn as id, text from @conversations"), "ecs_map": on_logs(E.ecs),
        "threat_intel": bind(E.threat_intel, logs=logs, indicators=indicators), "assets": bind(E.assets, logs=logs, assets=asset_table), "identity": bind(E.identity, logs=logs, people=people), "lease_lookup": bind(E.leases, points=points, leases=lease_table),
        "user_daily": on_logs(B.user_daily), "user_stats": on_logs(B.user_stats), "hour_profile": on_logs(B.hour_profile), "device_stats": on_logs(B.device_stats),
            "group_stats": on_logs(B.group_stats), "global_stats": on_logs(B.global_stats), "download_daily": on_logs(B.download_daily), "login_time_local": on_logs(B.login_time),
        "group_rules_map": on_logs(B.group_rules), "membership": on_logs(B.membership), "majority_group": on_logs(B.majority_group), "user_groups": on_logs(B.user_groups), "trained_stats": on_logs(trained), "state_counts": on_logs(state_counts),
        "upsert_by_key": bind(B.upsert, old=keyed(False), new=keyed(True)), "map_merge": bind(B.map_merge, old=simple(False), new=simple(True)), "groups_merge": bind(B.groups_merge, old=member(False), new=member(True)),
        "quality_profile": on_logs(report.quality_profile), "heuristic_level": on_logs(report.heuristic_level), "postprocess_upgrade": bind(report.upgrades,
            logs=P.dense), "rendered_lines": on_logs(report.rendered_lines), "keyword_counts": on_logs(report.keyword_counts), "export_rows": on_logs(report.export_rows), "log_type": on_logs(report.log_type),
        "report_kept": on_alerts(report.kept), "subject_rollup": on_alerts(report.subject_rollup), "report_summary": on_alerts(report.summary), "webhook_payload": on_alerts(report.webhook_payload),
            "client_filter": on_alerts(report.client_filter), "related_logs": bind(report.related_logs, alerts=alerts, logs=logs),
        "result_payload": payloads, "client_search": searched("Port_Scan"), "client_search_filtered": searched("watch user", severities=("CRITICAL", "WARNING"), level="HIGH"), "local_times": on_logs(local_times), "table_class": on_logs(report.table_class),
        "geo_lookup": bind(E.geo, logs=logs, ranges=ranges), "resolve_unknown": on_logs(D.resolve_unknown), "log_class": on_logs(report.log_class), "prompts": on_alerts(report.prompts), "alert_prompts": on_alerts(report.alert_prompts), "offline_analysis": on_alerts(report.offline_analysis),
        "subject_prompts": bind(report.subject_prompts, alerts=alerts, logs=logs),
        "json_flatten": json_fields, "time_filter": on_logs(time_filter), "normalised": on_logs(normalised), "all_alerts": alerts, "multiline_merge": bind(parsers.merge_multiline,
            lines=bind(rendered.stream, logs=logs)), "format_sniff": bind(parsers.sniff_counts, lines=bind(rendered.lines("openssh"), logs=logs)),
    }
    return out


def oracles() -> dict[str, str]:
    """DuckDB's SQL for every query: the independent one where there is one."""
    from . import independent

    return {k: independent.oracle(k) if k in independent.ORACLES else oracle(t) for k, t in catalogue().items()}
