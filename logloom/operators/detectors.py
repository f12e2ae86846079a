"""Detectors: each is one query over the event table ``@logs`` that ends in alerts.

Every detector returns ``type, subject, severity, score`` and its evidence as
columns of its own.  Rows without a key (null user, address ...) are left out.
Baselines come in as ``@stats``.  ``all_alerts`` unites them.
"""

from __future__ import annotations

from ..functions import ip as ipf
from ..functions import scoring as S
from ..functions.patterns import holds
from ..plans.dialect import Dialect, Text, named

# What counts as blocked and allowed.
BLOCKED = "(lower(status) in ('blocked', 'denied', 'drop', 'deny') or upper(action) in ('DENY', 'BLOCK', 'DROP', 'BLOCKED', 'DENIED'))"
BLOCKED_STATUS = "lower(status) in ('blocked', 'denied')"
ALLOWED = "(lower(status) in ('allowed', 'accepted', 'permit', 'allow') or upper(action) in ('ALLOW', 'ACCEPT', 'PERMIT', 'ALLOWED'))"
ADMIN_PORTS = "(22, 23, 3389, 445, 1433, 3306, 5432)"
C2_PORTS = "(443, 8080, 4444, 8443, 1337, 6666, 9999, 53, 80)"
INFRASTRUCTURE = "('10.10.10.20', '10.10.10.30', '10.10.10.40')"
MIB = 1048576


def alert(kind: str, subject: str, score: str, evidence: dict[str, str], source: str, severity: str | None = None) -> str:
    """SELECT of an alert; the score is a double, counts are bigints."""
    cols = "".join(f", {e} as {c}" for c, e in evidence.items())
    sev = severity or S.severity("score")
    return f"select '{kind}' as type, subject, {sev} as severity, score{''.join(f', {c}' for c in evidence)} from (select {subject} as subject, cast({score} as double) as score{cols} {source}) as found"


def n(x: str) -> str:
    return f"cast({x} as bigint)"


def distinct(x: str) -> str:
    return n(f"count(distinct {x})")


def fixed(kind: str, *mods: str) -> str:
    return str(S.total(kind, *mods))


# ---------------------------------------------------------------- DHCP

DHCP = "program = 'dhcpd' or lower(action) in ('discover', 'offer', 'request', 'ack', 'release', 'inform')"


def dhcp_scope_conflict(d: Dialect) -> str:
    net = "concat_ws('.', split_part(source_ip, '.', 1), split_part(source_ip, '.', 2), split_part(source_ip, '.', 3))"
    return alert("dhcp_scope_conflict", "mac_address", fixed("dhcp_scope_conflict"), {"hosts": distinct("host"), "subnets": distinct(net), "events": n("count(*)")},
        f"from @logs where ({DHCP}) and mac_address is not null group by mac_address having count(distinct host) >= 2 or count(distinct {net}) >= 2")


def dhcp_rogue_server(d: Dialect) -> str:
    return alert("dhcp_rogue_server_indication", "'network'", fixed("dhcp_rogue_server"), {"max_rate": n("max(c)"), "acks": n("sum(c)")}, f"from (select count(*) as c from @logs where ({DHCP}) and lower(action) = 'ack' group by {d.minute('timestamp')}) as m having sum(c) >= 5 and max(c) > 10")


def dhcp_device_user_mismatch(d: Dialect) -> str:
    return alert("dhcp_device_user_mismatch", "device", fixed("dhcp_user_device_mismatch"), {"users": distinct("username"), "names": d.joined("username")},
        f"from @logs where ({DHCP}) and device is not null group by device having count(distinct username) >= 3")


def dhcp_excessive_roaming(d: Dialect) -> str:
    return alert("dhcp_excessive_roaming", "username", fixed("dhcp_excessive_roaming"), {"interfaces": distinct("interface"), "vlans": distinct("vlan")},
        f"from @logs where ({DHCP}) and username is not null group by username having count(distinct interface) + count(distinct vlan) >= 5")


def dhcp_frequent_release(d: Dialect) -> str:
    return alert("dhcp_frequent_release", "username", fixed("dhcp_frequent_release"), {"releases": n("count(*)")}, f"from @logs where ({DHCP}) and lower(action) = 'release' and username is not null group by username having count(*) >= 3")


# ---------------------------------------------------------------- firewall

#: Rows are read as firewall rows once any row names a firewall or has one of these statuses (fixed values).
FW = "(select count_if(contains(lower(program), 'firewall') or contains(lower(program), 'ufw') or contains(lower(program), 'iptables') or lower(status) in ('blocked', 'denied', 'allowed', 'accepted')) from @logs) > 0"


def ip_user(d: Dialect) -> str:
    """(ip, name): an address's most frequent user, of equals the first by name, else the address."""
    return """select ip, coalesce(min_by(username, rk), ip) as name from (
      select source_ip as ip, username, row_number() over (partition by source_ip order by count(*) desc, username) as rk from @logs where source_ip is not null and username is not null group by source_ip, username) as ranked where rk = 1 group by ip"""


def _named(d: Dialect, inner: str) -> str:
    return f"from ({inner}) as g left join ({ip_user(d)}) as who on who.ip = g.source_ip"


def deny_burst_ip(d: Dialect) -> str:
    inner = f"select source_ip, count(*) as c, count(distinct dest_port) as ports from @logs where {FW} and {BLOCKED} and source_ip is not null group by source_ip having count(*) >= 5"
    return alert("firewall_deny_burst", "coalesce(name, source_ip)", fixed("firewall_deny_burst"), {"source_ip": "source_ip", "blocked": n("c"), "ports": n("ports")}, _named(d, inner))


def deny_burst_minute(d: Dialect) -> str:
    """One alert for the minutes of ten blocked rows or more, unless an address in them is a burst of its own."""
    rows = f"select {d.minute('timestamp')} as minute, source_ip from @logs where {FW} and {BLOCKED} and source_ip is not null"
    noisy = "select source_ip from blocked group by source_ip having count(*) >= 5"
    minutes = "select minute, count(*) as c from blocked group by minute having count(*) >= 10"
    ips = f"select distinct b.source_ip from blocked as b join ({minutes}) as m on m.minute = b.minute"
    seen = f"select count(*) as ips, count(x.source_ip) as known from ({ips}) as i left join ({noisy}) as x on x.source_ip = i.source_ip"
    return f"with blocked as ({rows}) " + alert("firewall_deny_burst", "'network'", fixed("firewall_deny_burst"), {"blocked": n("c"), "max_rate": n("top"),
        "ips": n("ips")}, f"from (select sum(c) as c, max(c) as top from ({minutes}) as q) as a cross join ({seen}) as s where c >= 10 and known = 0")  # two single rows


def deny_distributed(d: Dialect) -> str:
    """Targets of five sources or more, none of them a burst of its own."""
    per_ip = f"select source_ip, dest_ip, count(*) as c from @logs where {FW} and {BLOCKED} and source_ip is not null and dest_ip is not null and dst_host is not null group by source_ip, dest_ip"
    totals = f"select source_ip, count(*) as t from @logs where {FW} and {BLOCKED} and source_ip is not null group by source_ip"
    return alert("firewall_deny_burst", "dest_ip", fixed("firewall_deny_burst"), {"sources": n("count(*)"), "blocked": n("sum(c)")}, f"from ({per_ip}) as p join ({totals}) as t on t.source_ip = p.source_ip group by dest_ip having count(*) >= 5 and max(t.t) < 5")


def exfil_sum(d: Dialect) -> str:
    inner = f"select source_ip, sum(bytes) as b, count(*) as c from @logs where {FW} and {ALLOWED} and source_ip is not null group by source_ip having sum(bytes) >= {10 * MIB} and count(*) >= 5"
    return alert("firewall_exfiltration", "coalesce(name, source_ip)", fixed("firewall_exfiltration"), {"source_ip": "source_ip", "bytes": n("b"), "connections": n("c")}, _named(d, inner))


def fw_port_scan(d: Dialect) -> str:
    inner = f"select source_ip, count(*) as c, count(distinct dest_port) as ports from @logs where {FW} and {BLOCKED} and source_ip is not null group by source_ip having count(*) >= 5 and count(distinct dest_port) >= 5"
    return alert("firewall_port_scan", "coalesce(name, source_ip)", fixed("firewall_port_scan"), {"source_ip": "source_ip", "ports": n("ports"), "blocked": n("c")}, _named(d, inner))


def policy_evasion(d: Dialect) -> str:
    inner = f"""select source_ip, count(*) as c, {d.joined('dest_port')} as ports from @logs
      where {FW} and {ALLOWED} and dest_port in {ADMIN_PORTS} and source_ip is not null
      group by source_ip having count(*) >= 3""" if d.name == "duck" else f"""select source_ip, count(*) as c, array_join(transform(array_sort(collect_set(dest_port)), x -> cast(x as string)), ',') as ports
      from @logs where {FW} and {ALLOWED} and dest_port in {ADMIN_PORTS} and source_ip is not null
      group by source_ip having count(*) >= 3"""
    return alert("firewall_policy_evasion", "coalesce(name, source_ip)", fixed("firewall_policy_evasion"), {"source_ip": "source_ip", "connections": n("c"), "ports": "ports"}, _named(d, inner))


def exfil_row(d: Dialect) -> str:
    return alert("firewall_exfiltration", "coalesce(username, source_ip)", fixed("firewall_exfiltration"), {"row_id": "row_id", "dest_ip": "dest_ip", "bytes": "bytes"},
        f"from @logs where {FW} and upper(action) in ('ALLOW', 'ALLOWED', 'ACCEPT', 'PASS') and {ipf.external_loopback(d, 'dest_ip')} and bytes > {10 * MIB}")


def exfil_outlier(d: Dialect) -> str:
    inner = f"""select source_ip, count(*) as c, max(bytes) as top, avg(cast(bytes as double)) as mean, stddev_samp(cast(bytes as double)) as sd, max_by(dest_ip, bytes * 100000000 - row_id) as dest_ip
      from @logs where {FW} and {ALLOWED} and source_ip is not null and bytes is not null and {ipf.external_loopback(d, 'dest_ip')}
      group by source_ip having count(*) >= 3 and stddev_samp(cast(bytes as double)) > 0 and max(bytes) > greatest({OUTLIER} * avg(cast(bytes as double)), {OUTLIER_FLOOR})"""
    return alert("firewall_exfiltration", "coalesce(name, source_ip)", fixed("firewall_exfiltration"), {"source_ip": "source_ip", "samples": n("c"), "top": "top", "mean": "round(mean, 6)", "dest_ip": "dest_ip"}, _named(d, inner))


OUTLIER, OUTLIER_FLOOR = 5, 5 * MIB


# ---------------------------------------------------------------- web

#: The rows of the web server if there are any, else all rows with web columns.
WEB = "(program = 'apache' or ((http_status is not null or path is not null) and (select count_if(program = 'apache') from @logs) = 0))"
# The fields of an access line.
WEB_FIELDS = {"path": r'"(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+([^\s?]+)', "http_status": r'"\s+(\d+)\s', "method": r'(?i)"(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s', "bytes": r'"\s+\d+\s+(\d+)'}
WEB_USER = r"\d+\.\d+\.\d+\.\d+\s+-\s+(\S+)\s+\["


def web(d: Dialect) -> str:
    """The web server's rows; the message names the user if it can, and gives what the columns lack."""
    told = {c: d.rx("message", p) for c, p in WEB_FIELDS.items()}
    told |= {c: f"try_cast({told[c]} as {t})" for c, t in (("http_status", "int"), ("bytes", "bigint"))}
    user = d.rx("message", WEB_USER)
    return f"(select row_id, source_ip, coalesce(nullif({user}, '-'), username) as username, {', '.join(f'coalesce({c}, {e}) as {c}' for c, e in told.items())} from @logs where {WEB})"


# Paths that count as exports.
EXPORT = r"(?i)/export/|/download/|\.csv|\.zip|\.sql|/backup|all_customers|full_dump|all_invoices|/leads"


def _takeover_ips(d: Dialect) -> str:
    return f"""select source_ip, count_if(http_status = 401) as fails, count_if(http_status = 200) as oks
      from {web(d)} as w where source_ip is not null group by source_ip having count_if(http_status = 401) >= 1 and count_if(http_status = 200) >= 1"""


def _takeover(d: Dialect, kind: str, public: bool, score: str) -> str:
    who = ipf.public_text(d, "i.source_ip")
    return alert(kind, "username", score, {"ips": distinct("i.source_ip"), "successes": n("count(*)")}, f"""from {web(d)} as l join ({_takeover_ips(d)}) as i on i.source_ip = l.source_ip
      where http_status = 200 and username is not null and {'' if public else 'not '}{who} and (select count_if(http_status = 401)
      from {web(d)} as f) > 5 group by username""")


def takeover_public(d: Dialect) -> str:
    return _takeover(d, "account_takeover", True, fixed("account_takeover", "public_ip", "confirmed_success"))


def takeover_internal(d: Dialect) -> str:
    return _takeover(d, "account_takeover_internal", False, fixed("account_takeover_internal", "internal_ip"))


def web_exfil(d: Dialect) -> str:
    score = f"case when sum(bytes) > 5000000 then {fixed('data_exfiltration', 'sensitive_data')} else {fixed('data_exfiltration')} end"
    return alert("data_exfiltration", "username", score, {"exports": n("count(*)"), "bytes": n("sum(bytes)")}, f"from {web(d)} as w where username is not null and {d.has('path', EXPORT)} and bytes > 50000 group by username")


def suspicious_operations(d: Dialect) -> str:
    return alert("suspicious_operations", "username", fixed("suspicious_operations"), {"deletes": n("count_if(method = 'DELETE')"), "errors": n("count_if(http_status = 500)")},
        f"from {web(d)} as w where username is not null and (method = 'DELETE' or http_status = 500) group by username")


def bruteforce_target(d: Dialect) -> str:
    taken = f"""select l.username from {web(d)} as l join ({_takeover_ips(d)}) as i on i.source_ip = l.source_ip
      where http_status = 200 and l.username is not null and {ipf.public_text(d, 'i.source_ip')} and (select count_if(http_status = 401)
      from {web(d)} as f) > 5 group by l.username"""
    return alert("brute_force_target", "l.username", fixed("brute_force_target"), {"fails": n("count(*)")}, f"""from {web(d)} as l left join ({taken}) as t on t.username = l.username where http_status = 401 and l.username is not null and t.username is null
      group by l.username having count(*) >= 10""")


def web_auth_failure(d: Dialect) -> str:
    """Requests by their action, whatever the program."""
    f = "count_if(http_status in (401, 403))"
    rows = f"from @logs where {d.has('action', '(?i)access|get|post|put|delete')} and trim(username) not in ('', '(unknown)', 'nan') group by username"
    return alert("web_auth_failure_spike", "username", f"least(8.0 * {f} / count(*), 10.0)", {"requests": n("count(*)"), "failures": n(f)}, f"{rows} having count(*) >= 5 and {f} >= 3 and {f} >= 0.3 * count(*)")


# ---------------------------------------------------------------- DNS

DNS = "program = 'dnsmasq'"
WHO = "coalesce(username, host, source_ip)"


def _dns(kind: str, where: str, least: int) -> Text:
    def build(d: Dialect) -> str:
        return alert(kind, "who", fixed(kind), {"events": n("count(*)"), "domains": distinct("domain")}, f"from (select *, {WHO} as who from @logs where {DNS}) as q where who is not null and {where} group by who having count(*) >= {least}")

    return build


dns_amplification = _dns("dns_amplification", "status = 'large_answer'", 3)
dns_nxdomain_flood = _dns("dns_nxdomain_flood", "status = 'nxdomain'", 10)


def dns_nxdomain_storm(d: Dialect) -> str:
    span = f"({d.micros('max(timestamp)')} - {d.micros('min(timestamp)')})"
    return alert("dns_nxdomain_storm", "who", fixed("dns_nxdomain_storm"), {"events": n("count(*)"), "span_us": n(span)}, f"""from (select *, {WHO} as who from @logs where {DNS} and status = 'nxdomain') as q
      where who is not null group by who having count(*) >= {STORM} and {span} < {STORM_US}""")


STORM, STORM_US = 50, 15 * 60 * 1_000_000


def dns_suspicious(d: Dialect) -> str:
    odd = f"(length(domain) > 20 or (length(domain) > 10 and not {d.has('domain', '(?i)[aeiou]')}))"
    return _dns("dns_suspicious_domains", odd, 3)(d)


def dns_tunneling(d: Dialect) -> str:
    return _dns("dns_tunneling", f"query_type = 'TXT' and {d.has('domain', '_dns|exfil|tunnel')}", 1)(d)


# ---------------------------------------------------------------- Linux, SSH

ADMINS = "('root', 'admin', 'sysadmin', 'operator', 'ops', 'www-data', 'nginx', 'apache', 'mysql', 'postgres')"


LINK_UP = r"(?i)eth\d+:.*Link is Up"


def link_flap(d: Dialect) -> str:
    return alert("network_link_flap", "'network'", "least(8 + count(distinct host) / 10.0, 10)", {"hosts": distinct("host"), "events": n("count(*)")}, f"from @logs where {d.has('message', LINK_UP)} having count(distinct host) >= 10 or count(*) >= 20")


def cron_overlap(d: Dialect) -> str:
    who, script = d.rx("message", r"(?i)\(([^)]+)\)\s+CMD"), d.rx("message", r"(?i)CMD\s+\(([^)]+)\)")
    rows = f"select host, row_id, {who} as who, {script} as script from @logs where {d.has('program', r'(?i)cron\[')}"
    return alert("cron_job_overlap", "host", "least(5.0 + c / 10.0, 8.0)", {"script": "script", "runs": n("c"), "users": n("u")}, f"""from (select script, min_by(host, row_id) as host, count(*) as c, count(distinct who) as u
      from ({rows}) as r where who is not null and script is not null group by script
      having count(*) >= 10 and count(distinct who) >= 3) as g""")


def reload_privesc(d: Dialect) -> str:
    m = r"(?i)Reload(?:ing)?\s+(\w+)\s+server.*requested\s+by\s+(\w+)"
    return alert("privilege_escalation", "who", "8.5", {"host": "host", "service": "service"}, f"""from (select distinct host, {d.rx('message', m, 1)} as service, {d.rx('message', m, 2)} as who
      from @logs) as r where who is not null and lower(who) not in {ADMINS}""")


def sudo_privesc(d: Dialect) -> str:
    who = d.rx("message", r"^(\w[\w.-]*)\s+:\s+TTY=")
    return alert("privilege_escalation", "who", "9.0", {"host": "host", "commands": n("count(*)")}, f"""from (select host, {who} as who from @logs where program = 'sudo' and contains(message, 'USER=root')) as r
      where who is not null and lower(who) not in {ADMINS} group by who, host""")


def ssh_lateral(d: Dialect) -> str:
    """Users and addresses come from the text: ``Accepted <method> for <user> from <address> port``."""
    score = "least(10.0, (case when ips >= 5 then 8.5 when ips >= 3 then 7.0 else 5.0 end) + case when c >= 10 then 1 else 0 end + case when hosts >= 5 then 1 else 0 end)"
    who, address = d.rx("message", r"(?i)Accepted\s+\S+\s+for\s+(\S+)\s+from"), d.rx("message", r"(?i)from\s+([0-9.]+)\s+port")
    rows = f"select {who} as username, {address} as source_ip, host from @logs where {d.has('message', r'(?i)Accepted\s+(?:publickey|password)')} and (contains(lower(program), 'sshd') or {d.has('message', r'(?i)sshd|Accepted\s+(?:publickey|password)\s+for')})"
    inner = f"""select username, count(*) as c, count(distinct source_ip) as ips, count(distinct host) as hosts
      from ({rows}) as a where username is not null and username not in ('(unknown)', 'nan') and source_ip is not null
      group by username"""
    return alert("ssh_lateral_movement", "username", score, {"logins": n("c"), "ips": n("ips"), "hosts": n("hosts")}, f"from ({inner}) as g")


# ---------------------------------------------------------------- Windows

# Processes, patterns and names that are looked for.
DUMPERS = r"(?i)powershell\.exe|rundll32\.exe|cmd\.exe|wmic\.exe|msedge\.exe"
TASK_ACTIONS = [r"-enc\s+[A-Za-z0-9+/=]+", r"-EncodedCommand\s+[A-Za-z0-9+/=]+", r"-WindowStyle\s+Hidden", r"C:\\Windows\\Temp\\.*\.exe", r"C:\\Users\\.*\\AppData\\.*\.exe",
    r"powershell\.exe.*(-w\s+h|-nop|-ep\s+bypass)", r"cmd\.exe.*/c.*powershell", r"regsvr32.*(/s|/u)", r"mshta.*http[s]?://", r"rundll32.*,\s*#", r"svc\.exe", r"update\.exe.*-run"]
TASK_NAMES = [r"\\Microsoft\\Windows\\", "WinUpdate", "Telemetry", "OneDrive", "Index", "Sync"]
SERVICE_PATHS = [r"C:\\Windows\\Temp\\.*\.exe", r"C:\\Users\\.*\\AppData\\.*\.exe", r"C:\\ProgramData\\(?!Microsoft).*\.exe", r"C:\\Temp\\.*\.exe", r"updsvc\.exe", r"winupd\.exe", r"svc\.exe", r"-enc\s+[A-Za-z0-9+/=]+", r"powershell.*-enc"]
SERVICE_NAMES = [r"Update_\d+", r"WindowsUpdate\d+", r"WinUpdate\d*", r"SvcHost\d+", r"System\d+"]


def any_of(patterns: list[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def lsass_dump(d: Dialect) -> str:
    f = lambda k: d.rx("message", k + r'="([^"]*)"')
    score = f"round(least(least(7.0 + c / 10.0, 10.0) + case when {d.has('src', DUMPERS)} then 2.0 else 0.0 end, 10.0), 2)"
    inner = f"""select username, src, count(*) as c, {d.joined('access')} as access from (select username, {f('SourceImage')} as src, {f('TargetImage')} as target, {f('GrantedAccess')} as access
      from @logs where win_id = 10) as e where {d.has('target', '(?i)lsass.exe')} and username is not null and src is not null
      group by username, src"""
    return alert("lsass_credential_dumping_detected", "username", score, {"source_process": "src", "accesses": n("c"), "access": "access"}, f"from ({inner}) as g", S.severity("score", 8.5, 0))


def asof_priv(d: Dialect) -> str:
    """Each 4672 with the same user's next 4688 within ten seconds, exact match allowed, else nulls.

    Both kinds go into windows by user and slot of time, latest row first: the last
    4688 seen there is the next in time (of equal times the one with the smallest
    row).  A 4688 so early in its slot that rows of the slot before may want it is
    in that slot as well.
    """
    f = lambda k: d.rx("message", k + r'="([^"]*)"')
    us = d.micros("timestamp")
    gap = f"next_us - us <= {ASOF_US}"
    last = (lambda x: f"last_value({x} ignore nulls) over w") if d.name == "duck" else (lambda x: f"last_value({x}, true) over w")
    kept = {"next_us": "us", "proc_row": "row_id", "proc": "coalesce(pname, '')", "cmd": "coalesce(pcmd, '')"}
    cols = ", ".join(f"{last(f'case when kind = 1 then {x} end')} as {c}" for c, x in kept.items())
    both = f"""select username, row_id, timestamp, host, source_ip, {us} as us, case when win_id = 4688 then 1 else 0 end as kind,
        {f('NewProcessName')} as pname, {f('CommandLine')} as pcmd from @logs where win_id in (4672, 4688) and username is not null and timestamp is not null"""
    slot, early = f"cast(floor(us / {SLOT_US}) as bigint)", f"cast(floor((us - {ASOF_US}) / {SLOT_US}) as bigint)"
    slots = f"select *, {slot} as slot from ({both}) as e union all select *, {early} as slot from ({both}) as e where kind = 1 and {early} < {slot}"
    return f"""select username, row_id, timestamp, host, source_ip, case when {gap} then proc_row end as proc_row, case when {gap} then proc end as proc, case when {gap} then cmd end as cmd
      from (select *, {cols} from ({slots}) as x
        window w as (partition by username, slot order by us desc, kind desc, row_id desc rows between unbounded preceding and current row)) as j
      where kind = 0"""


SLOT_US = 600 * 1_000_000
ASOF_US = 10 * 1_000_000


def win_privesc(d: Dialect) -> str:
    enc = d.has("cmd", "(?i)-enc")
    bad = f"({d.has('proc', '(?i)psexec.exe')} or ({d.has('proc', '(?i)powershell.exe')} and {enc}) or {d.has('proc', '(?i)wmic.exe')} or {d.has('cmd', '(?i)whoami|net user|net group|' + chr(92) * 4)})"
    inner = f"select username, count(*) as c, max(case when {d.has('proc', '(?i)psexec')} then 1 else 0 end) as px, max(case when {enc} then 1 else 0 end) as en from ({asof_priv(d)}) as m where {bad} group by username"
    return alert("windows_privilege_escalation_detected", "username", "round(least(least(least(7.5 + c / 5.0, 10.0) + 1.5 * px, 10.0) + 1.0 * en, 10.0), 2)",
        {"escalations": n("c"), "psexec": n("px"), "encoded": n("en")}, f"from ({inner}) as g", S.severity("score", 8.0, 0))


def schtask(d: Dialect) -> str:
    f = lambda k: d.rx("message", k + r'="([^"]*)"')
    e = f"select coalesce(username, 'unknown') as username, coalesce({f('TaskName')}, '') as task, coalesce({f('Action')}, '') as act from @logs where win_id = 4698"
    inner = f"""select username, count(*) as c, max(case when {d.has('act', '(?i)-enc')} then 1
      else 0 end) as en, max(case when {d.has('act', r'(?i)Temp\\.*\.exe')} then 1
      else 0 end) as tmp, max(case when {d.has('act', '(?i)-windowstyle')} then 1
      else 0 end) as hid from ({e}) as t where {d.has('act', any_of(TASK_ACTIONS))} or (act <> '' and {d.has('task', any_of(TASK_NAMES))})
      group by username"""
    return alert("schtask_persistence_detected", "username", "round(least(least(least(least(7.0 + c / 3.0, 10.0) + 1.5 * en, 10.0) + 1.0 * tmp, 10.0) + 0.5 * hid, 10.0), 2)",
        {"tasks": n("c"), "encoded": n("en"), "temp_exe": n("tmp"), "hidden": n("hid")}, f"from ({inner}) as g", S.severity("score", 8.0, 0))


def service_install(d: Dialect) -> str:
    f = lambda k: d.rx("message", k + r'="([^"]*)"')
    paths = [p for p in SERVICE_PATHS if "(?!" not in p]
    data = rf"({d.has('path', r'(?i)C:\\ProgramData\\.*\.exe')} and not {d.has('path', r'(?i)C:\\ProgramData\\Microsoft[^;]*\.exe')})"
    mask = f"({d.has('path', r'(?i)svchost\.exe|services\.exe|lsass\.exe')} and not {d.has('path', r'(?i)C:\\Windows\\(system32|SysWOW64)\\')})"
    e = f"select coalesce(username, 'unknown') as username, coalesce({f('ServiceName')}, '') as svc, coalesce({f('ImagePath')}, '') as path from @logs where win_id = 7045"
    inner = f"""select username, count(*) as c, max(case when {d.has('path', r'(?i)Temp\\.*\.exe')} then 1
      else 0 end) as tmp, max(case when contains(svc, 'Update_') then 1 else 0 end) as fake, max(case
      when contains(path, 'ProgramData') then 1 else 0 end) as pd from ({e}) as t
      where {d.has('path', any_of(paths))} or {data} or {d.has('svc', any_of(SERVICE_NAMES))} or {mask}
      group by username"""
    return alert("service_persistence_detected", "username", "round(least(least(least(least(7.0 + c / 3.0, 10.0) + 1.5 * tmp, 10.0) + 1.0 * fake, 10.0) + 0.5 * pd, 10.0), 2)",
        {"services": n("c"), "temp_exe": n("tmp"), "fake_update": n("fake"), "program_data": n("pd")}, f"from ({inner}) as g", S.severity("score", 8.0, 0))


# ---------------------------------------------------------------- EDR

# What marks a message as one of endpoint telemetry, and its fields.
EDR_MESSAGE = r"(?i)Sysmon.*EventID=3|DestinationIp=|DestinationPort="
EDR_FIELDS = {"dest_ip": r"DestinationIp=([0-9.]+)", "dest_port": r"DestinationPort=(\d+)", "image": r"Image=(\S+)", "source_ip": r"(?:SourceIp|SrcIp)=([0-9.]+)"}
LOLBINS = r"powershell\.exe|cmd\.exe|wmic\.exe|certutil\.exe|bitsadmin\.exe|rundll32\.exe|regsvr32\.exe|mshta\.exe|msiexec\.exe|regasm\.exe|installutil\.exe|cscript\.exe|wscript\.exe"
RISKY = ("powershell.exe", "cmd.exe", "ssh.exe", "psexec.exe", "wmic.exe")


def edr(d: Dialect) -> str:
    """Endpoint rows of any program, told by their message; fields that the row lacks are taken from it."""
    told = {c: d.rx("message", p) for c, p in EDR_FIELDS.items()}
    told["dest_port"] = f"try_cast({told['dest_port']} as bigint)"
    return f"(select row_id, timestamp, username, {', '.join(f'coalesce({c}, {e}) as {c}' for c, e in told.items())} from @logs where program = 'sysmon' or {d.has('message', EDR_MESSAGE)})"


#: What follows the last separator of either kind.
BASENAME = r"([^/\\]*)$"
# Role, multiplier, technical (may use SSH and infrastructure) by group.
ROLES = [("itadmin", "admin", 1.0, 1), ("engineering", "engineer", 0.8, 1), ("sales", "sales", 1.2, 0), ("finance", "finance", 1.3, 0)]


def roles(d: Dialect) -> str:
    """(username, role, multiplier, technical): of a user's most frequent group."""
    top = "select username, min_by(grp, rk) as grp from (select username, lower(dept) as grp, row_number() over (partition by username order by count(*) desc, lower(dept)) as rk from @logs where username is not null and dept is not null group by username, lower(dept)) as r where rk = 1 group by username"
    return f"""select u.username, coalesce(r.role, 'unknown') as role, coalesce(r.mult, 1.5) as mult, coalesce(r.tech, 0) as tech
      from (select distinct username from @logs where username is not null) as u
      left join ({top}) as g on g.username = u.username left join {d.values(ROLES, ['grp', 'role', 'mult', 'tech'])} as r on r.grp = g.grp"""


def gaps(d: Dialect) -> str:
    """Seconds between a user's connections to an address: count, mean, variance, deviation."""
    gap = f"({d.micros('timestamp')} - lag({d.micros('timestamp')}) over (partition by username, dest_ip order by timestamp, row_id)) / 1000000.0"
    return f"""select username, dest_ip, {n('count(*)')} as connections, avg(gap) as mean, var_samp(gap) as var, stddev_samp(gap) as sd
      from (select username, dest_ip, {gap} as gap from {edr(d)} as l where username is not null and dest_ip is not null) as g
      group by username, dest_ip"""


def inter_arrival(d: Dialect) -> str:
    return f"select username, dest_ip, connections, round(mean, 3) as mean, round(var, 0) as var, round(sd, 3) as sd from ({gaps(d)}) as g"


def c2_beaconing(d: Dialect) -> str:
    return alert("c2_beaconing_detected", "username", "10.0", {"dest_ip": "dest_ip", "connections": "connections", "mean": "round(mean, 3)"}, f"from ({gaps(d)}) as b where connections >= 10 and {ipf.external_text(d, 'dest_ip')} and ((var < 5 and mean < 300) or (sd < 2 and mean < 60))")


def suspicious_process(d: Dialect) -> str:
    name = f"lower({d.rx('image', BASENAME)})"
    risky = "(" + " or ".join(f"contains(process, '{x}')" for x in RISKY) + ")"
    return alert("suspicious_process_external_connection", "username", "9.5", {"process": "process", "dest_ip": "dest_ip", "role": "role"}, f"""from (select distinct l.username, {name} as process, l.dest_ip, r.role
      from {edr(d)} as l join ({roles(d)}) as r on r.username = l.username where r.tech = 0 and {ipf.external_text(d, 'l.dest_ip')}) as e
      where {risky}""")


def _edr_users(d: Dialect) -> str:
    ext = ipf.external_text(d, "dest_ip")
    c2 = f"""select username, max(c) as c2 from (select username, dest_ip, count(*) as c
      from {edr(d)} as l where username is not null and {ext} and dest_port in {C2_PORTS}
      group by username, dest_ip) as k group by username"""
    agg = f"""select username, count(distinct source_ip) as ips, count(distinct dest_ip) as dests, count(distinct dest_port) as ports, count(distinct case when {ext} then dest_ip end) as ext,
      count_if(dest_port = 3389) as rdp, count_if({d.has('image', '(?i)' + LOLBINS)}) as lol, count(distinct case when dest_ip in {INFRASTRUCTURE} and dest_port in {ADMIN_PORTS} then dest_ip end) as infra_admin,
      count_if(dest_ip in {INFRASTRUCTURE}) as infra, count_if(dest_port in (22, 3389)) as remote, count_if({ext} and dest_port in {ADMIN_PORTS}) as ext_admin
      from {edr(d)} as l where username is not null group by username"""
    return f"select a.*, coalesce(c.c2, 0) as c2, r.role, r.mult, r.tech from ({agg}) as a left join ({c2}) as c on c.username = a.username join ({roles(d)}) as r on r.username = a.username where a.ips >= 3"


def edr_pattern(d: Dialect) -> str:
    free = "role not in ('admin', 'netops')"
    kind = f"""case when ext > 0 and lol > 0 then 'edr_lolbins_outbound_detected' when ports >= 10 then 'edr_port_scan_detected' when rdp >= 30 and ips >= 10 and {free} then 'edr_rdp_bruteforce_detected'
      when infra_admin >= 2 and {free} then 'edr_lateral_movement_detected' when c2 >= 10 then 'edr_c2_beacon_detected' when ext >= 15 and ext > 0.6 * dests then 'edr_data_exfiltration_detected' else 'edr_network_spike' end"""
    bonus = "case when (ips - 10.0) / 10.0 > 3 then 1.0 when (ips - 10.0) / 10.0 > 2 then 0.5 else 0.0 end"
    base = "case when ips >= 30 then 9.0 when ips >= 20 then 7.0 when ips >= 10 then 5.0 else 3.0 end"
    penalty = "case when tech = 0 and remote > 0 then 3.0 else 0.0 end + case when tech = 0 and infra > 0 then 2.5 else 0.0 end + case when ext_admin > 0 then 2.0 else 0.0 end + case when ext > 10 then 1.0 else 0.0 end"
    inner = f"select username, {kind} as kind, role, ips, dests, ext, round(least(({base} + {bonus} + {penalty}) * mult, 10.0), 6) as sc from ({_edr_users(d)}) as u"
    return f"""select kind as type, username as subject, {S.severity('sc', 8.0, 5.0)} as severity, cast(sc as double) as score, role, {n('ips')} as ips, {n('dests')} as dests, {n('ext')} as ext
      from ({inner}) as s where sc >= 4"""


# ---------------------------------------------------------------- router

LOGIN = r"(?i)%SEC_LOGIN-\d+-LOGIN_SUCCESS.*\[user:(\S+)\].*\[Source:([\d.]+)\]"
CONFIG = r"(?i)%SYS-\d+-CONFIG_I.*Configured\s+from\s+\w+\s+by\s+(\S+)\s*\(?([\d.]+)?"
BGP = r"(?i)%BGP-\d+-ADJCHANGE.*neighbor\s+([\d.]+)\s+Down"
IFACE = r"(?i)%(?:LINK|LINEPROTO)-\d+-UPDOWN.*Interface\s+(\S+?),?\s.*changed\s+state\s+to\s+(up|down)"
OSPF = r"(?i)%OSPF-\d+-ADJCHG.*Nbr\s+([\d.]+)\s+on\s+\S+\s+from\s+(\w+)\s+to\s+(\w+)"
#: A router's message, whatever the program.
ROUTER = r"(?i)%(?:(?:BGP|OSPF|LINK|LINEPROTO|SEC_LOGIN)-\d+-|SYS-\d+-CONFIG_I)"
CORRELATION_US = 5 * 60 * 1_000_000
#: Router events and activities of a minute that are paired as one tile, and the tasks that tiles are dealt out to: by
#: their bytes these would be few, as tiles are far smaller than the pairs made of them.
EVENTS_TILE, ACTS_TILE, PAIR_TASKS = 256, 128, 96
ACTIVITY, NOISE = "kind in ('login', 'config')", "kind in ('bgp', 'interface', 'ospf')"


def router_events(d: Dialect) -> str:
    """Rows of a router's log by kind: login, config (with user), bgp, interface, ospf (with down)."""
    has = lambda p: d.has("message", p)
    return f"""select * from (select row_id, host as router, {d.micros('timestamp')} as us,
      case when {has(LOGIN)} then 'login' when {has(BGP)} then 'bgp' when {has(IFACE)} then 'interface' when {has(OSPF)} then 'ospf' when {has(CONFIG)} then 'config' end as kind,
      case when {has(LOGIN)} then {d.rx('message', LOGIN)} when {has(CONFIG)} then {d.rx('message', CONFIG)} end as who,
      case when upper({d.rx('message', OSPF, 2)}) = 'FULL' and upper({d.rx('message', OSPF, 3)}) <> 'FULL' then 1 else 0 end as down
      from @logs where host is not null and contains(message, '%') and {has(ROUTER)}) as e where kind is not null"""


def interval_matches(d: Dialect) -> str:
    """Every event with every activity on its router in the five minutes before it, both ends included.

    The equal key is (router, five-minute slot): an activity stands in its own
    slot and the next, so the range is a filter behind an equi-join.  In Spark the slots
    are of a minute and an activity stands in its own and the five after it: more keys to deal
    out, and five of six pairs of equal keys are in range instead of one of two.

    There events and activities meet in tiles, arrays of rows that follow one another in
    time, and pairs are made of two tiles at a time: each event with the same few activities
    in the same order.  The order is what keeps the result small where it is written, as a
    column then repeats itself within a page of a file.  The coalesce moves no row.  It parts the
    join from the explodes, which would else hold all pairs of a tile of events at once.
    """
    if d.name != "duck":
        minute = "cast(floor(us / 60000000.0) as bigint)"
        dealt = lambda where: f"select /*+ repartition({PAIR_TASKS}, router, minute) */ *, {minute} as minute from @ev as v where {where} and us is not null"
        numbered = lambda where, size: f"select *, floor((row_number() over (partition by router, minute order by us, row_id) - 1) / {size}) as tile from ({dealt(where)}) as m"
        tiles = lambda where, size, cols: f"select router, minute, sort_array(collect_list(struct({cols}))) as tile_rows from ({numbered(where, size)}) as n group by router, minute, tile"
        events = tiles(NOISE, EVENTS_TILE, "us, row_id, kind, down")
        acts = f"select router, tile_rows, explode(sequence(minute, minute + 5)) as minute from ({tiles(f'{ACTIVITY} and who is not null', ACTS_TILE, 'us, row_id, who')}) as t"
        met = f"select /*+ coalesce({PAIR_TASKS}) */ e.router, e.tile_rows as events, a.tile_rows as acts from ({events}) as e join ({acts}) as a on a.router = e.router and a.minute = e.minute"
        return f"""select e.row_id, router, e.kind, e.down, e.us, a.who, a.row_id as activity
          from ({met}) as m lateral view explode(events) as e lateral view explode(acts) as a where e.us - a.us between 0 and {CORRELATION_US}"""
    slot = lambda x: f"cast(floor({x} / {CORRELATION_US}.0) as bigint)"
    acts = " union all ".join(f"select router, who, us, row_id, {slot('us')} + {k} as slot from @ev as v where kind in ('login', 'config') and who is not null" for k in (0, 1))
    return f"""select e.row_id, e.router, e.kind, e.down, e.us, a.who, a.row_id as activity from (select *, {slot('us')} as slot from @ev as v where kind in ('bgp', 'interface', 'ospf')) as e
      join ({acts}) as a on a.router = e.router and a.slot = e.slot where e.us - a.us between 0 and {CORRELATION_US}"""


def interval_anti(d: Dialect) -> str:
    """Events with no activity on their router in the five minutes before.

    The other engine's text takes the events out that ``interval_matches`` pairs.  Here no
    pair is made: an activity stands in its own slot and the next, and of those up to an
    event only the last one's time counts.
    """
    if d.name != "duck":
        slot = f"cast(floor(us / {CORRELATION_US}.0) as bigint)"
        acts = f"select cast(null as bigint) as row_id, router, kind, 0 as down, us, {slot} + k as slot, us as act, 0 as event from (select *, explode(array(0, 1)) as k from @ev as v where {ACTIVITY} and who is not null) as a"
        rows = f"select row_id, router, kind, down, us, {slot} as slot, cast(null as bigint) as act, 1 as event from @ev as v where {NOISE} union all {acts}"
        last = f"select *, max(act) over (partition by router, slot order by us, event rows between unbounded preceding and current row) as last from ({rows}) as r"
        return f"select row_id, router, kind, down, us from ({last}) as l where event = 1 and (last is null or us - last > {CORRELATION_US})"
    return f"""select e.row_id, e.router, e.kind, e.down, e.us from @ev as e left join (select distinct row_id from ({interval_matches(d)}) as m) as k on k.row_id = e.row_id where e.kind in ('bgp', 'interface', 'ospf') and k.row_id is null"""


def interval_counts(d: Dialect) -> str:
    """Per user and router: events of each kind within five minutes after the user's activities, once for each activity.

    The counts of ``interval_matches`` without its pairs, whose number is that of events
    times activities.  An activity is a start at its time and a stop five minutes later.
    Between them lie the rest of the start's chunk of five minutes and the stop's chunk up
    to the same second: the events before each mark within its second by a window over
    that second, and those of the seconds before by a window with a row per second of the chunk.
    """
    kinds = {"bgp": "kind = 'bgp'", "iface": "kind = 'interface'", "ospf": "kind = 'ospf'", "downs": "kind = 'ospf' and down = 1"}
    each = lambda f: ", ".join(f(k) for k in kinds)
    marks = f"select router, who, us + {CORRELATION_US} * at as us, 2 * at - 1 as sign, {each(lambda k: f'0 as {k}')} from (select *, explode(array(0, 1)) as at from @ev as v where {ACTIVITY} and who is not null and us is not null) as a"
    events = f"select router, cast(null as string) as who, us, 0 as sign, {', '.join(f'case when {c} then 1 else 0 end as {k}' for k, c in kinds.items())} from @ev as v where {NOISE} and us is not null"
    rows = f"select *, cast(floor(us / 1000000.0) as bigint) as sec from ({marks} union all {events}) as x"
    # of one time first the starts, then the events, then the stops: both ends of the five minutes count
    window = "partition by router, sec order by us, sign rows between unbounded preceding and current row"
    inside = f"select *, {each(lambda k: f'sum({k}) over ({window}) as {k}_to')} from ({rows}) as r"
    users = f"select router, sec, who, sum(sign) as signs, count_if(sign < 0) as starts, {each(lambda k: f'sum(sign * {k}_to) as {k}_in')} from ({inside}) as i where who is not null group by router, sec, who"
    seconds = f"select router, sec, cast(floor(sec * 1000000.0 / {CORRELATION_US}) as bigint) as chunk, {each(lambda k: f'sum({k}) as {k}')} from ({rows}) as r group by router, sec"
    chunks = f"select router, sec, {each(lambda k: f'sum({k}) over (partition by router, chunk) as {k}_all, coalesce(sum({k}) over (partition by router, chunk order by sec rows between unbounded preceding and 1 preceding), 0) as {k}_before')} from ({seconds}) as s"
    return f"""select u.who, u.router, {each(lambda k: f'sum(starts * {k}_all + signs * {k}_before + {k}_in) as {k}')}
      from ({users}) as u join ({chunks}) as c on c.router = u.router and c.sec = u.sec group by u.who, u.router"""


def _suspect_counts(d: Dialect) -> str:
    """Per user: correlated events by kind, configurations, routers with any of them."""
    if d.name != "duck":
        hits = f"select who, router, bgp, iface, ospf, downs, 0 as cfg from ({interval_counts(d)}) as m where bgp + iface + ospf > 0 union all select who, router, 0 as bgp, 0 as iface, 0 as ospf, 0 as downs, 1 as cfg from @ev as c where kind = 'config' and who is not null"
        per = f"select who, router, {', '.join(f'sum({k}) as {k}' for k in ('bgp', 'iface', 'ospf', 'downs', 'cfg'))} from ({hits}) as h group by who, router"
        return f"select who, {', '.join(f'sum({k}) as {k}' for k in ('bgp', 'iface', 'ospf', 'downs', 'cfg'))}, count(router) as routers from ({per}) as p group by who"
    hits = f"select who, router, kind, down, 0 as cfg from ({interval_matches(d)}) as m union all select who, router, 'config' as kind, 0 as down, 1 as cfg from @ev as c where kind = 'config' and who is not null"
    return f"""select who, {n('count_if(kind = ' + chr(39) + 'bgp' + chr(39) + ')')} as bgp, {n('count_if(kind = ' + chr(39) + 'interface' + chr(39) + ')')} as iface, {n('count_if(kind = ' + chr(39) + 'ospf' + chr(39) + ')')} as ospf, {n('sum(case when kind = ' + chr(39) + 'ospf' + chr(39) + ' then down else 0 end)')} as downs, {n('sum(cfg)')} as cfg, count(distinct router) as routers
      from ({hits}) as h group by who"""


def router_suspects(d: Dialect) -> str:
    agg = _suspect_counts(d)
    top = f"select *, 10 * cfg + bgp + iface + ospf as corr from ({agg}) as g order by 10 * cfg + bgp + iface + ospf desc, cfg desc, who limit 5"
    kinds = "concat_ws(',', case when bgp >= 3 then 'bgp_flap_correlated' end, case when iface >= 5 then 'interface_flap_correlated' end, case when ospf >= 3 or downs >= 2 then 'ospf_storm_correlated' end, case when cfg >= 1 then 'config_tampering' end)"
    base = "greatest(case when cfg >= 3 then 8.0 when cfg >= 1 then 6.5 else 5.0 end, case when corr >= 80 then 9.0 when corr >= 50 then 8.0 when corr >= 30 then 7.0 else 0.0 end)"
    score = f"cast(least(9.5, {base} + case when routers >= 5 then 0.5 else 0.0 end) as double)"
    return f"""select kinds as type, who as subject, {S.severity('score', 7.0, 0)} as severity, score, corr, bgp, iface, ospf, cfg
      from (select *, {kinds} as kinds, {score} as score from ({top}) as t) as s
      where kinds <> ''"""


def _unattributed(kind: str, alert_type: str, least: int) -> Text:
    def build(d: Dialect) -> str:
        agg = f"""select count(*) as c, sum(down) as downs, max(w.minutes) as minutes from ({interval_anti(d)}) as a
          cross join (select greatest((max({d.micros('timestamp')}) - min({d.micros('timestamp')})) / 60000000.0, 1.0) as minutes
          from @logs where contains(message, '%') and {d.has('message', ROUTER)}) as w where kind = '{kind}'"""
        score = {"bgp": "case when rate >= 1 then least(9.0, 6.5 + rate) else least(6.0, 4.5 + rate) end", "interface": "case when rate >= 2 then least(8.0, 6.0 + rate / 2) else least(5.5, 4.0 + rate / 2) end",
            "ospf": "case when rate >= 1 or downs >= 5 then least(8.0, 6.0 + rate / 2) else least(5.5, 4.5 + rate) end"}[kind]
        hard = {"bgp": "rate >= 1", "interface": "rate >= 2", "ospf": "rate >= 1 or downs >= 5"}[kind]
        return f"""select '{alert_type}' as type, 'network' as subject, case when {hard} then 'CRITICAL'
          else 'WARNING' end as severity, cast(round({score}, 6) as double) as score, {n('c')} as events, round(rate, 6) as rate
          from (select c, downs, cast(c / minutes as double) as rate from ({agg}) as g) as r
          where c >= {least}"""

    return build


bgp_unattributed = _unattributed("bgp", "bgp_flap_attack_unattributed", 5)
interface_unattributed = _unattributed("interface", "interface_flap_attack_unattributed", 10)
ospf_unattributed = _unattributed("ospf", "ospf_storm_unattributed", 5)


# ---------------------------------------------------------------- generic

LOGIN_ROWS = "(lower(action) = 'login')"
SIGN_IN = "(contains(lower(program), 'sshd') or contains(lower(action), 'login') or contains(lower(action), 'logon'))"


def bruteforce_by_ip(d: Dialect) -> str:
    """Rows of the SSH daemon or of logins, by address: five or more, three failed, two fifths failed."""
    ext = f"not {ipf.private_strict(d, 'source_ip')}"
    rate = "cast(fails as double) / c"
    score = f"case when ({ext} and {rate} >= 0.9) or {rate} >= 0.8 then greatest(least(10.0 * {rate}, 10.0), 9.0) else least(10.0 * {rate}, 10.0) end"
    inner = f"""select source_ip, count(*) as c, count_if(contains(lower(status), 'fail') or contains(lower(status), 'denied')) as fails, count(distinct username) as users
      from @logs where {SIGN_IN} and trim(source_ip) <> '' group by source_ip"""
    return alert("credential_bruteforce_detected", "source_ip", f"round({score}, 6)", {"logins": n("c"), "failed": n("fails"), "users": n("users")}, f"from ({inner}) as g where c >= 5 and fails >= 3 and {rate} >= 0.4")


def resolve_unknown(d: Dialect) -> str:
    """Rows without a user, with the most frequent sudo user as the likely one (of equals the first by name)."""
    top = "select username from (select username, row_number() over (order by count(*) desc, username) as rk from @logs where lower(action) = 'sudo' and username is not null group by username) as r where rk = 1"
    return f"select row_id, coalesce({KNOWN}, '(unknown)' || coalesce('(via ' || (select max(username) from ({top}) as t) || ')', '')) as who from @logs"


BIG = 50_000_000


def scp_exfil(d: Dialect) -> str:
    m = r"([a-zA-Z0-9_\-]+)\s*->\s+([0-9.]+):"
    row = f"""select min(row_id) as row_id, who, b, min_by(dest_ip, row_id) as dest_ip
      from (select row_id, {d.rx('message', m, 1)} as who, {d.rx('message', m, 2)} as dest_ip, try_cast({d.rx('message', r'bytes=([0-9]+)')} as bigint) as b
      from @logs where contains(message, ' -> ')) as t where who is not null and b > {BIG}
      group by who, b"""
    return alert("data_exfiltration_detected", "who", f"least(greatest(9.5 * b / 100000000.0, case when not {ipf.private_strict(d, 'dest_ip')} then 9.0 else 0.0 end), 10.0)", {"bytes": "b", "dest_ip": "dest_ip"}, f"from ({row}) as r")


def netfilter_exfil(d: Dialect) -> str:
    row = f"""select coalesce(username, source_ip, host) as who, try_cast({d.rx('message', r'NETFILTER_PKT.*len=([0-9]+)')} as bigint) as b, {d.rx('message', r'dst=([0-9.]+)')} as dest_ip
      from @logs where contains(message, 'NETFILTER_PKT')"""
    return alert("data_exfiltration_detected", "who", f"least(greatest(9.5 * b / 100000000.0, case when not {ipf.private_strict(d, 'dest_ip')} then 9.0 else 0.0 end), 10.0)",
        {"bytes": "b"}, f"from (select distinct who, b, min(dest_ip) over (partition by who, b) as dest_ip from ({row}) as t where b > {BIG} and who is not null) as r")


# Fixed values: (name, pattern, score) of the rule tables.
PRIVILEGE = [("add_sudo_user", r"sudo.*usermod.*sudo", 8.0), ("suid_bash", r"chmod\s+u\+s\s+/bin/bash", 9.0), ("sudoers_edit", r"visudo.*-f\s+/etc/sudoers", 8.5), ("bash_ownership_change", r"chown\s+root.*bash", 8.0)]
DATABASE = [("data_export", r"COPY\s+(salary|payroll|employee|customers?|credit_card|ssn|password)\s+TO", 9.5), ("salary_query", r"SELECT\s+\*\s+FROM\s+(salary|payroll)\s+WHERE",
    8.5), ("pii_query", r"SELECT\s+\*\s+FROM\s+employee[s]?\s+PII|SELECT.*FROM.*(pii|ssn|credit_card)", 9.0), ("database_dump", r"(mysqldump|pg_dump)\s+.*--password|--all-databases", 9.5)]
DATABASE_USE = [("database_dump", r"pg_dump|mysqldump", 7.0), ("user_table_access", r"SELECT\s+\*\s+FROM\s+\w*user", 6.0), ("user_modification", r"ALTER\s+ROLE|ALTER\s+USER", 7.0), ("destructive_operation", r"DROP\s+TABLE|DROP\s+DATABASE", 9.0)]
SERVICES = [("auditd_stop", r"Stopping\s+auditd\s+service|auditd\.service:\s*Deactivated", 9.5), ("postgresql_stop", r"Stopping\s+postgresql\s+service|postgresql\.service:\s*Deactivated",
    9.0), ("mysql_stop", r"Stopping\s+mysql\s+service|mysql\.service:\s*Deactivated|mariadb\.service:\s*Deactivated", 9.0), ("nginx_stop", r"Stopping\s+nginx\s+service|nginx\.service:\s*Deactivated",
    8.5), ("apache_stop", r"Stopping\s+apache2?\s+service|apache2?\.service:\s*Deactivated|httpd\.service:\s*Deactivated", 8.5), ("ssh_stop", r"Stopping\s+ssh\s+service|ssh\.service:\s*Deactivated|sshd\.service:\s*Deactivated",
    9.0), ("firewall_stop", r"Stopping\s+(?:firewalld|iptables|ufw)\s+service|(?:firewalld|iptables|ufw)\.service:\s*Deactivated", 9.5)]
PERSISTENCE = [("crontab_modification", r"crontab\s+[-l]*[;\s]*echo.*\|.*crontab\s+[-]?|crontab.*curl.*bash", 9.0), ("reverse_shell_bashrc", r"bash\s+-i\s*[>&]*\s*/dev/tcp/.*>>\s*~?/.bashrc|bash\s+-i\s+>?&?\s*/dev/tcp",
    9.0), ("rc_local_persistence", r"systemctl\s+enable\s+rc-local|/etc/rc\.local", 9.0), ("ssh_key_injection", r"authorized_keys|~?/.ssh/[^ ]*", 8.5), ("curl_exec_pattern",
    r"curl\s+(?:-s)?\s*http[s]?://.*[|]\s*(?:bash|sh)", 9.0), ("suspicious_persistence_msg", r"suspicious\s+persistence", 9.0)]


def rule_hits(d: Dialect, rules: list[tuple[str, str, float]], who: str, extra: str = "") -> str:
    """(who, rule, score ...) of each row and each rule it fits: the rules make one array, so a text is scanned in one pass."""
    arr = ", ".join(f"case when {holds(d, 'message', p)} then {i} end" for i, (_, p, _) in enumerate(rules))
    hit = d.unnest(f"array({arr})" if d.name == "spark" else f"[{arr}]", "k")
    names, scores = (" ".join(f"when {i} then {v}" for i, v in enumerate(vs)) for vs in ([f"'{r[0]}'" for r in rules], [str(r[2]) for r in rules]))
    return f"select who{extra}, case k {names} end as rule, cast(case k {scores} end as double) as sc from (select {who} as who{extra}, {hit} from @logs where message is not null) as h where k is not null"


KNOWN = "nullif(trim(username), '')"
DISPLAY = f"coalesce({KNOWN}, 'Unknown User (Source IP: ' || nullif(source_ip, '') || ')', 'Unknown User (Host: ' || nullif(host, '') || ')', 'Unknown User')"


def _rules(kind: str, rules, who: str, extra: str = "", severity: str = "'CRITICAL'") -> Text:
    def build(d: Dialect) -> str:
        keys = f"who, rule, sc{extra}"
        return alert(kind, "who", "sc", {"rule": "rule", "hits": n("count(*)")} | ({"host": "host"} if extra else {}), f"from ({rule_hits(d, rules, who, extra)}) as r group by {keys}", severity)

    return build


rules_privilege = _rules("privilege_escalation_detected", PRIVILEGE, DISPLAY)
rules_database = _rules("sensitive_db_access_detected", DATABASE, DISPLAY, ", host")
rules_service = _rules("service_manipulation_detected", SERVICES, DISPLAY, ", host")
rules_persistence = _rules("persistence_technique_detected", PERSISTENCE, f"coalesce({KNOWN}, '(unknown)')")
rules_database_use = _rules("sensitive_db_access_detected", DATABASE_USE, f"coalesce({KNOWN}, '(unknown)')", "", S.severity("score", 8.0, 0))


def data_access_counts(d: Dialect) -> str:
    bad = d.has("message", r"(?i)(pg_dump|mysqldump|COPY\s+TO|ALTER\s+ROLE|GRANT|REVOKE|DROP\s+\w+)")
    query = d.has("message", r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|export|backup)\b")
    return f"select coalesce({KNOWN}, '(unknown)') as username, {n(f'count_if({query} and not {bad})')} as db_queries, {n(f'count_if({bad})')} as suspicious_ops from @logs where message is not null group by 1"


def anomalous_data_access(d: Dialect) -> str:
    """Known users whose queries or suspicious operations lie far above what was trained; deviations count as 1 at least."""
    zq, zs = "(c.db_queries - coalesce(s.db_queries_mean, 0.0)) / greatest(coalesce(s.db_queries_std, 0.1), 1.0)", "(c.suspicious_ops - coalesce(s.suspicious_ops_mean, 0.0)) / greatest(coalesce(s.suspicious_ops_std, 0.1), 1.0)"
    inner = f"select c.username, c.db_queries, c.suspicious_ops, {zq} as zq, {zs} as zs from ({data_access_counts(d)}) as c join @stats as s on s.username = c.username"
    return alert("anomalous_data_access", "username", "round(least(greatest(zq, zs), 10.0), 6)", {"db_queries": "db_queries", "suspicious_ops": "suspicious_ops",
        "zq": "round(cast(zq as double), 6)", "zs": "round(cast(zs as double), 6)"}, f"from ({inner}) as a where zq >= 3 or zs >= 3")


def new_user(d: Dialect) -> str:
    return alert("new_user", "l.username", "4.0", {"events": n("count(*)")}, f"""from @logs as l left join (select distinct username from @stats) as s on s.username = l.username
      where l.username is not null and l.username not in ('nan', 'None', '') and s.username is null
      group by l.username having count(*) >= 3""")


# What marks a download.
DOWNLOAD = "(lower(coalesce(action, '')) like '%download%' or lower(coalesce(message, '')) like '%download%' or lower(coalesce(message, '')) like '%tải xuống%')"


def download_spike(d: Dialect) -> str:
    zz = S.z("c.files", "s.events_mean", "s.events_std")
    inner = f"select c.username, c.files, {zz} as z from (select username, count(*) as files from @logs where {DOWNLOAD} and username is not null group by username) as c left join @stats as s on s.username = c.username"
    return alert("user_download_spike", "username", "round(z, 6)", {"files": n("files")}, f"from ({inner}) as g where z >= {SPIKE_Z} and files >= 5")


SPIKE_Z = 3.0


def activity(d: Dialect, group: str = "username") -> str:
    """Per-user totals in the names of the baseline's columns."""
    return f"select {group}, {features(d)} from @logs where username is not null group by {group}"


def features(d: Dialect) -> str:
    return f"{n('count(*)')} as events, {distinct('source_ip')} as unique_src_ips, {n(chr(99) + 'ount_if(lower(action) = ' + chr(39) + 'login' + chr(39) + ' and lower(status) = ' + chr(39) + 'failed' + chr(39) + ')')} as login_fail, {n('count_if(contains(lower(program), ' + chr(39) + 'ssh' + chr(39) + '))')} as ssh_events, {n('count_if(http_status between 400 and 499)')} as http_4xx, {n('count_if(http_status between 500 and 599)')} as http_5xx"


def zscore_spike(d: Dialect) -> str:
    """Three measures of each user against the baseline: z >= 3, or, without deviation, half more than the mean."""
    parts = " union all ".join(f"select a.username, '{m}' as measure, a.{m} as cur, s.{m}_mean as mu, s.{m}_std as sd from ({activity(d)}) as a join @stats as s on s.username = a.username" for m in ("events", "unique_src_ips", "login_fail"))
    score = "case when sd > 0 then case when z <= 3 then 2 * z when z <= 10 then 6.0 + (z - 3) * 0.357 else least(8.5 + 0.75 * log10(greatest(z - 9, 1.0)), 10.0) end else least(2.0 * cur / mu, 10.0) end"
    return f"""select 'user_' || measure || '_spike' as type, username as subject, {S.severity('score')} as severity, score, cur
      from (select *, cast(round({score}, 6) as double) as score from (select *, {S.z('cur', 'mu', 'sd')} as z
      from ({parts}) as p) as q where (sd > 0 and z >= {SPIKE_Z}) or (coalesce(sd, 0.0) = 0 and mu > 0 and cur > 1.5 * mu and cur >= greatest(3, mu))) as r"""


def blocked_ratio(d: Dialect) -> str:
    b = "count_if(lower(status) in ('blocked', 'failure', 'failed', 'denied', 'dropped'))"
    return alert("blocked_actions_spike", "source_ip", f"round(least(10.0 * {b} / count(*), 10.0), 6)", {"blocked": n(b), "events": n("count(*)")}, f"from @logs where source_ip is not null group by source_ip having {b} >= 5 and {b} > 0.5 * count(*)")


def port_scan(d: Dialect) -> str:
    """Blocked ports of an address by their gaps: all small, or most small or moderate, or four ports and more."""
    gaps = f"""select source_ip, dest_port, dest_port - lag(dest_port) over (partition by source_ip
      order by dest_port) as gap from (select distinct source_ip, dest_port from @logs
      where {BLOCKED_STATUS} and source_ip is not null and dest_port is not null) as p"""
    agg = "select source_ip, count(*) as ports, count(gap) as gaps, count_if(gap <= 5) as small, count_if(gap <= 100) as mid from (" + gaps + ") as g group by source_ip"
    rows = f"select source_ip, count(*) as c from @logs where {BLOCKED_STATUS} and source_ip is not null group by source_ip"
    kind = "case when small = gaps then 'sequential' when ports >= 4 and mid >= 0.7 * gaps then 'methodical' else 'multi-port' end"
    return alert("port_scan_detected", "a.source_ip", "8.0", {"ports": n("ports"), "pattern": kind}, f"from ({agg}) as a join ({rows}) as r on r.source_ip = a.source_ip where c >= 5 and ports >= 3 and (small = gaps or small >= 0.3 * gaps or mid >= 0.7 * gaps or ports >= 4)", "'CRITICAL'")


def foreign_access(d: Dialect) -> str:
    return alert("foreign_country_access", "username", "least(5.0 + 0.1 * count(*), 8.0)", {"events": n("count(*)"), "countries": d.joined("source_country")},
        "from @logs where source_country is not null and source_country not in ('VN', 'VNM') and username is not null group by username having count(*) >= 2")


def off_hours(d: Dialect) -> str:
    local = d.hour(d.plus("timestamp", LOCAL_HOURS, "hour"))
    return alert("off_hours_access", "username", "4 + least(0.1 * count(*), 2.0)", {"events": n("count(*)")}, f"from @logs where username is not null and ({local} < 6 or {local} >= 22) group by username having count(*) >= 3")


LOCAL_HOURS = 7


def login_foreign_ip(d: Dialect) -> str:
    return alert("login_foreign_ip", "source_ip", "3.0", {"logins": n("count(*)")}, f"""from @logs where {LOGIN_ROWS} and source_ip is not null and not {ipf.private_rfc(d, 'source_ip')} and source_country is not null and source_country not in ('VN', 'VNM')
      group by source_ip""")


def rolling(d: Dialect, before: bool = True) -> str:
    """Minutes against the ten before; ``before=False`` takes the minute itself in, as the literal rule does.

    A minute without events is never a burst, so none is generated here: sums over a
    range of minutes, and how many minutes of the calendar lie in it.  Windows are per
    day, with the minutes before midnight that the next day's first ones look back to.
    """
    from .series import counted, per_minute

    if d.name == "duck":
        frame = "rows between 10 preceding and 1 preceding" if before else "rows between 9 preceding and current row"
        return f"""select us, epm, ma, sd from (select {d.micros('minute')} as us, epm, avg(epm) over (order by minute {frame}) as ma, stddev_pop(epm) over (order by minute {frame}) as sd, count(*) over (order by minute {frame}) as k
          from ({per_minute(d)}) as m) as r where k >= 5 and epm > ma + 3 * sd + 1e-9"""
    own = f"select t, c, cast(unix_seconds(t) / 60 as bigint) as m from ({counted('minute')}) as a"
    day = lambda ahead: f"cast(floor((m + {ahead}) / 1440.0) as bigint)"
    carried = f"select *, {day(0)} as day, true as own from ({own}) as b union all select *, {day(10)} as day, false as own from ({own}) as b where {day(10)} > {day(0)}"
    frame = "range between 10 preceding and 1 preceding" if before else "range between 9 preceding and current row"
    over = f"over (partition by day order by m {frame})"
    sums = f"select t, c, m, own, coalesce(sum(c) {over}, 0) as s1, coalesce(sum(c * c) {over}, 0) as s2 from ({carried}) as d"
    k = "least(10, m - lo)" if before else "least(10, m - lo + 1)"
    told = f"select t, c, s1, s2, {k} as k from ({sums}) as e cross join (select min(m) as lo from ({own}) as f) as g where own"
    return f"""select us, epm, ma, sd from (select unix_micros(t) as us, c as epm, s1 / cast(k as double) as ma, sqrt(cast(k * s2 - s1 * s1 as double)) / k as sd from ({told}) as h where k >= 5) as r
      where epm > ma + 3 * sd + 1e-9"""


def global_burst(d: Dialect) -> str:
    return f"""select 'global_burst' as type, 'global' as subject, 'WARNING' as severity, cast(least(10.0, 5.0 + epm - ma) as double) as score, us, {n('epm')} as epm, round(ma, 6) as ma, round(sd, 6) as sd
      from ({rolling(d)}) as r"""


def attack_chain(d: Dialect) -> str:
    """Subjects with lateral movement and exfiltration."""
    both = f"select subject, 'lateral' as kind from ({ssh_lateral(d)}) as l union all select subject, 'exfil' as kind from ({scp_exfil(d)}) as x union all select subject, 'exfil' as kind from ({netfilter_exfil(d)}) as y"
    return alert("organized_attack_chain", "subject", "10.0", {"alerts": n("count(*)")}, f"from ({both}) as b group by subject having count_if(kind = 'lateral') > 0 and count_if(kind = 'exfil') > 0", "'CRITICAL'")


def coordinated(d: Dialect) -> str:
    return alert("coordinated_attack_summary", "'network'", "10.0", {"subjects": n("count(*)"), "names": d.joined("subject")}, f"from ({attack_chain(d)}) as c having count(*) >= 2", "'CRITICAL'")


#: All detectors over the event table alone, then those that need a baseline.
PLAIN: dict[str, Text] = {f.__name__ if hasattr(f, "__name__") and f.__name__ != "build" else k: f for k, f in {
    k: globals()[k] for k in """dhcp_scope_conflict dhcp_rogue_server dhcp_device_user_mismatch dhcp_excessive_roaming dhcp_frequent_release
    deny_burst_ip deny_burst_minute deny_distributed exfil_sum fw_port_scan policy_evasion exfil_row exfil_outlier
    takeover_public takeover_internal web_exfil suspicious_operations bruteforce_target web_auth_failure
    dns_amplification dns_nxdomain_flood dns_nxdomain_storm dns_suspicious dns_tunneling
    link_flap cron_overlap reload_privesc sudo_privesc ssh_lateral lsass_dump win_privesc schtask service_install
    c2_beaconing suspicious_process edr_pattern router_suspects bgp_unattributed interface_unattributed ospf_unattributed
    bruteforce_by_ip scp_exfil netfilter_exfil rules_privilege rules_database rules_service rules_persistence rules_database_use
    blocked_ratio port_scan foreign_access off_hours login_foreign_ip global_burst attack_chain coordinated""".split()}.items()}
WITH_STATS: dict[str, Text] = {k: globals()[k] for k in ("anomalous_data_access", "new_user", "download_spike", "zscore_spike")}


#: Detectors that read router events (``@ev``) made by ``router_events``.
ON_EVENTS = ("router_suspects", "bgp_unattributed", "interface_unattributed", "ospf_unattributed")


def all_alerts(d: Dialect, stats: bool = True, names: list[str] | None = None) -> str:
    """UNION ALL of type, subject, severity, score; each detector once."""
    chosen = PLAIN | (WITH_STATS if stats else {})
    ev = f"({router_events(d)})"
    return " union all ".join(f"select type, subject, severity, score, '{k}' as detector from ({named(t(d), {'ev': ev})}) as a{i}" for i, (k, t) in enumerate(chosen.items()) if names is None or k in names)
