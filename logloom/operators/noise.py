"""Noise: tags of routine rows by field and by message, burst and window collapse."""

from __future__ import annotations

from ..functions import ip as ipf
from ..plans.dialect import Dialect

STATIC = r"(?i)\.(css|js|png|jpg|jpeg|gif|svg|ico|woff|woff2|ttf)$"
#: Formats that have the columns which the rules ask for.
HTTP, SYSLOG = "('apache', 'nginx', 'iis')", "('sshd', 'sudo', 'cron')"


def field_key(d: Dialect) -> str:
    """The first rule that fits a row's fields, '' for rows that must stay, null if none says anything."""
    low = "lower(coalesce(message, ''))"
    prog = "split_part(lower(coalesce(program, '')), '[', 1)"
    web = f"{prog} in {HTTP}"
    ua = "lower(coalesce(user_agent, ''))"
    fw = f"{prog} in ('firewall', 'iptables', 'netfilter')"
    cast = " or ".join(f"contains({low}, ' {w} ')" for w in ("mdns", "5353", "ssdp", "1900", "ntp", "123", "dhcp", "67", "68"))
    ssh, sudo, cron = (f"{prog} = '{x}'" for x in ("sshd", "sudo", "cron"))
    rules = [
        (f"{web} and {d.has('path', STATIC)} and (http_status is null or http_status in (200, 204, 206, 301, 302, 304))", "web_static_success"),
        (f"{web} and {d.has(ua, 'elb-healthchecker|kube-probe|healthcheck')}", "web_healthcheck"),
        (f"{web} and {d.has(ua, 'googlebot|bingbot')}", "web_known_bot"),
        (f"{web} and http_status in (200, 204, 206) and path is not null and not {d.has('path', '(?i)admin|export|phpmyadmin|wp-admin')}", "web_normal_access"),
        (f"{fw} and (lower(action) in ('accept', 'allow', 'passed') or contains(coalesce(message, ''), 'ACCEPT')) and {ipf.private_rfc(d, 'source_ip')} and {ipf.private_rfc(d, 'dest_ip')} and dest_port in (53, 80, 443, 123)", "fw_allow_internal_std"),
        (f"{fw} and ({cast})", "fw_infra_broadcast"),
        (f"{ssh} and (contains(message, 'Accepted') or status = 'failed' or {d.has(low, 'invalid user|preauth|timeout')})", ""),
        (f"{sudo} and action = 'sudo' and status = 'success' and {d.has('message', 'TTY=(pts/|tty)')}", "sudo_normal_tty"),
        (f"{sudo} and {d.has(low, 'session opened|auth failure|invalid')}", ""),
        (f"{cron} and (contains(coalesce(severity, ''), 'INFO') or contains(message, '(CRON)')) and {d.has(low, 'pidfile|@reboot')}", "cron_info"),
        (f"{cron} and contains(message, 'CMD (')", ""),
        (f"{prog} = 'squid' and ({d.has('path', STATIC)})", "proxy_static"),
        (f"{prog} = 'squid' and upper(result_code) like '%/200' and {d.has('result_code', '(?i)HIT|MISS')}", "proxy_ok_cache"),
        (f"({prog} in ('dhcpd', 'dhcp') or contains({low}, 'dhcp')) and {d.has('message', 'DHCPDISCOVER|DHCPOFFER')} and not contains(message, 'user=')", "dhcp_chatter"),
        ("win_id = 4624 and (lower(username) like 'svc!_%' escape '!' or lower(username) like 'service!_%' escape '!')", "win4624_service"),
        ("win_id = 4624", "win4624_success"),
    ]
    return "case " + " ".join(f"when {c} then '{k}'" for c, k in rules) + " end"


# Phrases of routine messages and their keys, the first that fits.
PHRASES = [
    (r"session opened for user", "session_opened"), (r"session closed for user", "session_closed"), (r"connection from", "connection_from"), (r"disconnected from", "disconnected_from"), (r"received disconnect", "received_disconnect"),
    (r"systemd.* (starting|started|stopping|stopped|reached target|created slice)", "systemd_state_change"), (r"cron\[\d+\]: \(.*\) cmd \(.*\)", "cron_cmd"), (r"sshd: connection closed by ", "ssh_connection_closed"), (r"openssh_\S+ .* protocol", "ssh_banner"),
    (r"service entered the (running|stopped) state", "win_service_state_change"), (r"service was successfully sent a (start|stop) control", "win_service_control"),
        (r"task scheduler.* (started|completed) task", "win_task_scheduler"), (r"windows defender.* (started|completed|updated)", "win_defender_info"), (r"group policy successfully processed",
        "win_gpo_processed"), (r"event id.*4624", "win_sec_logon_success"),
]


def message_key(d: Dialect) -> str:
    low = "lower(coalesce(message, ''))"
    address = d.rx("message", r"\b(\d{1,3}(?:\.\d{1,3}){3})\b")
    rules = [f"when {d.has(low, p)} then " + (f"concat('connection_from', coalesce('_' || {address}, ''))" if k == "connection_from" else f"'{k}'") for p, k in PHRASES]
    return "case " + " ".join(rules) + " end"


# Statuses, actions and programs whose rows are never tagged by field.
CRITICAL = "(coalesce(lower(status) in ('failed', 'failure', 'blocked', 'denied', 'deny', 'drop', 'alert'), false) or coalesce(upper(action) in ('DENY', 'DENIED', 'BLOCK', 'BLOCKED', 'DROP'), false) or coalesce(lower(program) in ('suricata', 'modsecurity', 'vpcflow', 'netflow', 'sysmon', 'configd', 'named', 'zeek_dns'), false))"


def tagged(d: Dialect, compat: bool = False) -> str:
    """Rows with noise_key.  Critical rows have none; ``compat`` lets the message rules tag them again."""
    guard = f"case when {CRITICAL} then null else {{}} end"
    key = f"coalesce({guard.format(f'nullif({field_key(d)}, {chr(39) * 2})')}, {message_key(d) if compat else guard.format(message_key(d))})"
    return f"select row_id, timestamp, program, message, {key} as noise_key from @logs"


def burst(d: Dialect) -> str:
    """Runs of one key among the tagged rows, in time order: the first row and the count.

    Runs are found minute by minute.  Only a minute's first and last run can go on
    in another minute, so the order of the whole table is taken over one row per
    minute: that row's first run begins anew, or goes on with the last run of the
    minute before, or, if that minute has one run only, with that run's beginning.
    """
    minute = d.minute("timestamp")
    order = "order by timestamp, row_id"
    flags = f"select *, {minute} as slice, case when noise_key = lag(noise_key) over (partition by {minute} {order}) then 0 else 1 end as new from ({tagged(d)}) as t where noise_key is not null"
    numbered = f"select *, sum(new) over (partition by slice {order} rows between unbounded preceding and current row) as run from ({flags}) as f"
    runs = f"select slice, run, noise_key, max(case when new = 1 then row_id end) as row_id, min(timestamp) as timestamp, count(*) as c from ({numbered}) as g group by slice, run, noise_key"
    edges = f"select slice, max(run) as runs, min_by(noise_key, run) as first_key, max_by(noise_key, run) as last_key from ({runs}) as r group by slice"
    before = f"select *, lag(slice) over (order by slice) as prev, lag(runs) over (order by slice) as prev_runs, coalesce(first_key = lag(last_key) over (order by slice), false) as joined from ({edges}) as e"
    chains = f"select *, case when joined and prev_runs = 1 then 0 else 1 end as head from ({before}) as b"
    groups = f"select *, sum(head) over (order by slice rows between unbounded preceding and current row) as chain from ({chains}) as c"
    origin = """select slice, max(case when head = 1 then case when joined then prev else slice end end) over (partition by chain) as from_slice,
      max(case when head = 1 then case when joined then prev_runs else 1 end end) over (partition by chain) as from_run"""
    islands = f"""select r.noise_key, r.row_id, r.timestamp, r.c, case when run = 1 then from_slice
      else r.slice end as island_slice, case when run = 1 then from_run else run end as island_run
      from ({runs}) as r join ({origin} from ({groups}) as g) as o on o.slice = r.slice"""
    return f"select noise_key, min_by(row_id, {d.micros('timestamp')}) as row_id, min(timestamp) as timestamp, cast(sum(c) as bigint) as collapsed_count from ({islands}) as i group by island_slice, island_run, noise_key"


def window_collapse(d: Dialect, threshold: int = 5) -> str:
    """Of a key's bursts in a minute, if more than ``threshold``, the first with the summed count."""
    by = f"partition by noise_key, {d.minute('timestamp')}"
    return f"""select row_id, noise_key, case when k > {threshold} then total else collapsed_count end as collapsed_count from (
      select *, count(*) over ({by}) as k, cast(sum(collapsed_count) over ({by}) as bigint) as total, row_number() over ({by} order by timestamp, row_id) as place from ({burst(d)}) as b) as w where k <= {threshold} or place = 1"""


def reduce_noise(d: Dialect, threshold: int = 5) -> str:
    """The event table without collapsed rows, with noise_key, collapsed_count and the count in the message."""
    return f"""select l.*, n.noise_key, coalesce(n.collapsed_count, 1) as collapsed_count from @logs as l join (
      select row_id, cast(null as string) as noise_key, cast(1 as bigint) as collapsed_count from ({tagged(d)}) as t where noise_key is null
      union all select row_id, noise_key, collapsed_count from ({window_collapse(d, threshold)}) as w) as n on n.row_id = l.row_id"""


def reduced(d: Dialect) -> str:
    return f"""select row_id, noise_key, collapsed_count, case when collapsed_count > 1 then message || ' [Repeated ' || cast(collapsed_count as string) || ' times]'
      else message end as message from ({reduce_noise(d)}) as r"""
