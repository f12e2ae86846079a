"""Parsers of text lines: each format is a pattern and columns derived from its groups.

A parser reads ``@lines`` (line_no, line), keeps the lines of its format, and
returns line_no, timestamp and its own columns.  RFC 3164 lines carry no year, so
the year is a parameter (``YEAR``).  ``parse`` runs one over a DataFrame;
``sniff`` finds which format a file has.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dialect import Dialect, Text, apply

YEAR = 2025
LOCAL_HOURS = 7  # Windows logs are written in local time, UTC+7

IP = r"\d+\.\d+\.\d+\.\d+"
#: (?s): a merged record's continuation lines belong to its message.
RFC = r"(?s)^([A-Z][a-z]{2})\s+(\d{1,2})\s(\d{2}:\d{2}:\d{2})\s"
ISO = r"(?s)^(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})\s+"

Columns = Callable[[Dialect], dict[str, str]]


@dataclass
class Format:
    name: str
    pattern: str
    groups: dict[str, int]  #: columns that are groups of the pattern
    when: Callable[[Dialect], str]  #: the timestamp
    derive: Columns = field(default=lambda d: {})  #: further columns, from the groups and ``line``
    drop: tuple[str, ...] = ()  #: groups used but not returned
    ints: tuple[str, ...] = ()

    def columns(self, d: Dialect) -> list[str]:
        return ["timestamp", *[g for g in self.groups if g not in self.drop], *self.derive(d)]

    def text(self, d: Dialect) -> str:
        inner = ", ".join(
            f"try_cast({d.rx('line', self.pattern, n)} as bigint) as {c}" if c in self.ints else f"{d.rx('line', self.pattern, n)} as {c}" for c, n in self.groups.items()
        )
        kept = [c for c in self.groups if c not in self.drop]
        made = [f"{e} as {c}" for c, e in self.derive(d).items()]
        return f"select line_no, {', '.join([f'{self.when(d)} as timestamp', *kept, *made])} from (select line_no, line, {inner} from @lines where {d.has('line', self.pattern)}) as matched"


def rfc(d: Dialect) -> str:
    return d.instant(f"'{YEAR} ' || mon || ' ' || day || ' ' || clock", "%Y %b %d %H:%M:%S")


def iso(d: Dialect) -> str:
    return d.instant("day || ' ' || clock", "%Y-%m-%d %H:%M:%S")


def local(d: Dialect) -> str:
    return d.plus(iso(d), -LOCAL_HOURS, "hour")


def case(*pairs: tuple[str, str], other: str = "null") -> str:
    return "case " + " ".join(f"when {c} then '{v}'" for c, v in pairs) + (f" else {other} end")


def holds(col: str, *words: str) -> str:
    return "(" + " or ".join(f"contains({col}, '{w}')" for w in words) + ")"


def kv(d: Dialect, col: str, key: str) -> str:
    """The first value of key=value, with or without double quotes: one search of the text, and the quotes taken off what it finds."""
    found = d.rx(col, r'(?i)(?:^|\s)' + key + r'=("[^"]*"|[^\s"]\S*)')
    return f"nullif({d.sub(found, '^\"([^\"]*)\"$', '$1')}, '')"


RFC_GROUPS = {"mon": 1, "day": 2, "clock": 3}
ISO_GROUPS = {"day": 1, "clock": 2}
T, D = ("mon", "day", "clock"), ("day", "clock")


# Windows event ids and what they mean.
WINDOWS = {
    4624: ("login", "success"), 4625: ("login", "failed"), 4634: ("logoff", "success"), 4672: ("privilege_escalation", "success"), 4688: ("process_create", "success"),
    4798: ("group_enum", "success"), 4799: ("group_enum", "success"), 5379: ("credential_read", "success"), 5382: ("credential_read", "success"),
    7045: ("service_install", "success"), 1102: ("audit_log_cleared", "success"), 3: ("network_connect", "info"), 1: ("process_create", "info"), 11: ("file_create", "info"),
}
#: What the unstructured form doesn't map.
STRUCTURED_ONLY = (4799, 5382, 3, 1, 11)


def windows(ids, which: int, other: str) -> str:
    return case(*[(f"event_id = {i}", WINDOWS[i][which]) for i in ids], other=other)


def quoted(d: Dialect, col: str) -> dict[str, str]:
    names = {"target_image": "TargetImage", "source_image": "SourceImage", "granted_access": "GrantedAccess", "new_process_name": "NewProcessName", "command_line": "CommandLine"}
    return {c: d.rx(col, k + '="([^"]*)"') for c, k in names.items()}


def _auth_user(d: Dialect) -> str:
    return d.rx("message", r"for (?:invalid user )?(\S+) from")


def _openssh(d: Dialect) -> dict[str, str]:
    yes, no = holds("message", "Accepted"), holds("message", "Failed password")
    bye = holds("message", "Disconnected from", "Connection closed")
    return {
        "program": "'sshd'",
        "source_ip": d.rx("message", rf"\b({IP})\b"),
        "username": f"case when {yes} or {no} then {d.rx('message', r'for (\S+) from')} end",
        "action": case((f"{yes} or {no}", "login"), (bye, "disconnect")),
        "status": case((yes, "success"), (no, "failed"), (bye, "success")),
    }


def _pam(d: Dialect) -> dict[str, str]:
    """Logins of daemons other than sshd: password, PAM, RADIUS and TACACS+ phrases, in this order."""
    # Phrases before the user's name.
    phrases = [("Accepted password", "success"), ("Failed password", "failed"), ("(?i)PAM authentication failure", "failed"), ("(?i)RADIUS Access-Accept",
        "success"), ("(?i)RADIUS Access-Reject", "failed"), (r"(?i)TACACS\+ authentication OK", "success"), (r"(?i)TACACS\+ authentication FAIL", "failed")]
    users = [d.rx("message", p + r" for (\S+) from") for p, _ in phrases]
    return {
        "source_ip": d.rx("message", rf"\b({IP})\b"),
        "username": f"coalesce({', '.join(users)})",
        "action": case((f"coalesce({', '.join(users)}) is not null", "login")),
        "status": case(*[(f"{u} is not null", s) for u, (_, s) in zip(users, phrases)]),
    }


def _syslog(d: Dialect) -> dict[str, str]:
    ssh, sudo, cron = (f"contains(lower(program), '{x}')" for x in ("sshd", "sudo", "cron"))
    low = "lower(message)"
    yes, no = f"{ssh} and contains({low}, 'accepted')", f"{ssh} and contains({low}, 'failed') and contains({low}, 'password')"
    who = "trim(split_part(message, ':', 1))"
    tty = f"{sudo} and contains(message, ':') and contains(message, 'TTY=')"
    named = f"{tty} and {who} <> '' and not contains(lower({who}), 'pam_unix') and not contains(lower({who}), 'error') and not contains(lower({who}), 'failed')"
    opened, closed = (f"{sudo} and not ({tty}) and contains({low}, 'session {x}')" for x in ("opened", "closed"))
    ran = f"{cron} and contains({low}, 'cron') and contains(message, '(') and contains(message, ')')"
    return {
        "username": f"""case when ({yes}) or ({no}) then {d.rx('message', r'for\s+(\S+)\s+from')}
          when {named} then {who} when {opened} then {d.rx('message', r'by\s+(\w+)\(uid=')}
          when {ran} then {d.rx('message', r'\((\w+)\)\s+CMD')} end""",
        "source_ip": f"case when ({yes}) or ({no}) then {d.rx('message', rf'from\s+({IP})')} end",
        "action": case((f"({yes}) or ({no})", "login"), (named, "sudo"), (opened, "sudo_session_open"), (f"{closed} and not ({opened})", "sudo_session_close"), (ran, "cron_execute")),
        "status": case((yes, "success"), (no, "failed"), (named, "success"), (opened, "success"), (closed, "success"), (ran, "success")),
    }


def _syslog_iso(d: Dialect) -> dict[str, str]:
    ssh = "program like 'sshd%'"
    yes, no = f"{ssh} and contains(message, 'Accepted')", f"{ssh} and contains(message, 'Failed')"
    return {
        "source_ip": f"case when {ssh} then {d.rx('message', rf'\b({IP})\b')} end",
        "username": f"case when {yes} or {no} then {_auth_user(d)} end",
        "action": case((f"{yes} or {no}", "login")),
        "status": case((yes, "success"), (no, "failed")),
    }


def _apache(d: Dialect) -> dict[str, str]:
    ua = "coalesce(user_agent, '')"
    code = "cast(http_status as int)"
    return {
        "method": f"nullif(split_part(trim(coalesce(request, '')), ' ', 1), '')", "path": "nullif(split_part(request, ' ', 2), '')", "protocol": "nullif(split_part(request, ' ', 3), '')",
        "device": d.rx(ua, r"Device/(\S+)"), "dept": d.rx(ua, r"Dept/(\S+)"), "attack_type": f"coalesce({d.rx(ua, r'Attack/(\S+)')}, attack)",
        "action": case((f"{code} between 300 and 399", "redirect"), (f"{code} between 400 and 499", "client_error"), (f"{code} between 500 and 599", "server_error"), other="'access'"),
        "status": case((f"{code} between 200 and 399", "success"), (f"{code} between 400 and 599", "failed"), other="'unknown'"),
        "program": "'apache'",
    }


def _firewall(d: Dialect) -> dict[str, str]:
    act = f"lower(coalesce({kv(d, 'message', 'action')}, ''))"
    names = {"username": "user", "device": "device", "source_ip": "src", "src_port": "sport", "dest_ip": "dst", "dest_port": "dport", "dst_host": "dst_host", "protocol": "proto", "bytes_sent": "bytes", "rule": "rule"}
    return {"program": "'firewall'"} | {c: kv(d, "message", k) for c, k in names.items()} | {
        "action": act, "status": case((f"{act} in ('allow', 'accept')", "success"), (f"{act} in ('deny', 'drop', 'reject')", "blocked")), "severity": f"coalesce({kv(d, 'message', 'severity')}, 'INFO')",
    }


def _iptables(d: Dialect) -> dict[str, str]:
    acts = [(holds("message", "ACCEPT"), "accept", "success"), (holds("message", "DROP"), "drop", "blocked"), (holds("message", "REJECT"), "reject", "blocked")]
    return {"program": "'firewall'", "source_ip": d.rx("message", rf"SRC=({IP})"), "dest_ip": d.rx("message", rf"DST=({IP})"), "action": case(*[(c, a) for c, a, _ in acts]), "status": case(*[(c, s) for c, _, s in acts])}


def _dhcp(d: Dialect) -> dict[str, str]:
    # Message types in the order they are looked for.
    kinds = [("DISCOVER", "discover", "info"), ("OFFER", "offer", "success"), ("REQUEST", "request", "info"), ("ACK", "ack", "success"), ("RELEASE", "release", "success"), ("INFORM", "inform", "info")]
    dev = d.rx("message", r"\(([^)]+)\)")
    return {
        "program": "'dhcpd'", "username": d.rx("message", r"user=(\S+?)(?:\s|$|:)"), "device": f"case when contains(lower({dev}), 'dev') or contains({dev}, '-') then {dev} end",
        "mac_address": d.rx("message", r"((?:[0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2})"), "ip_address": d.rx("message", r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"), "interface": d.rx("message", r"via\s+(\S+)"),
        "action": case(*[(f"contains(message, 'DHCP{k}')", a) for k, a, _ in kinds]), "status": case(*[(f"contains(message, 'DHCP{k}')", s) for k, _, s in kinds]),
    }


def _dnsmasq(d: Dialect) -> dict[str, str]:
    q, f, r = (holds("message", x) for x in ("query", "forwarded", "reply"))
    nx = holds("message", "NXDOMAIN")
    return {
        "program": "'dnsmasq'", "source_ip": d.rx("message", rf"from\s+({IP})"), "dest_ip": d.rx("message", rf"to\s+({IP})"), "domain": d.rx("message", r"(?:query\[\w+\]\s+|forwarded\s+|reply\s+)(\S+)"), "query_type": d.rx("message", r"query\[(\w+)\]"),
        "action": case((q, "query"), (f, "forwarded"), (r, "reply"), (f"{nx} or contains(message, 'refused')", "refused"), other="'dns_event'"),
        "status": case((f"{q} or {f}", "info"), (f"{r} and {holds('message', 'LARGE_ANSWER', 'is LARGE')}", "large_answer"), (nx, "nxdomain"), (r, "success"), (holds("message", "refused"), "failed"), other="'info'"),
    }


def _bind(d: Dialect) -> dict[str, str]:
    rcode = d.rx("message", r"rcode=(\w+)")
    q = holds("message", "query:")
    lame = "contains(lower(message), 'lame')"
    return {
        "program": "'named'", "source_ip": d.rx("message", rf"client\s+({IP})"), "username": d.rx("message", r"user=([^\s)]+)"), "device": d.rx("message", r"device=([^\s)]+)"),
        "domain": f"coalesce({d.rx('message', r'\(([^)]+)\):\s+query:')}, {d.rx('message', r'query:\s+(\S+)')})", "query_type": d.rx("message", r"query:\s+\S+\s+(\w+)\s+IN"), "rcode": rcode,
        "action": case((q, "query"), (lame, "lame_server"), other="'dns_event'"), "status": case((f"{q} and {rcode} = 'NOERROR'", "success"), (f"{q} and {rcode} = 'NXDOMAIN'", "failed"), (q, "info"), (lame, "alert"), other="'info'"),
    }


def _ios(d: Dialect) -> dict[str, str]:
    low = "lower(message)"
    kinds = [(f"contains({low}, 'login') and contains({low}, 'success')", "login", "success"), (f"contains({low}, 'logout')", "logout", "success"), (f"contains({low}, 'configured')",
        "config_change", "success"), (f"contains({low}, 'adjchange') or contains({low}, 'adjchg')", "bgp_ospf_event", "warning"), (f"contains({low}, 'nat-6')",
        "nat_portmap", "info"), (f"contains({low}, 'link') or contains({low}, 'lineproto')", "interface_event", "info")]
    return {
        "program": "'router_ios'", "username": f"coalesce({d.rx('message', r'by\s+(?:user\s+)?([^\s()]+)')}, {d.rx('message', r'\[user:([^\s\])]+)')})", "device": d.rx("message", r"device[=\s]+([^\s)]+)"),
        "source_ip": f"coalesce({d.rx('message', rf'from\s+({IP})')}, {d.rx('message', rf'\[Source:({IP})\]')})",
        "action": case(*[(c, a) for c, a, _ in kinds], other="'router_event'"), "status": case(*[(c, s) for c, _, s in kinds], other="'info'"),
    }


def _sysmon(d: Dialect) -> dict[str, str]:
    event = f"try_cast({d.rx('message', r'EventID=(\d+)')} as bigint)"
    device = d.rx("message", r"\bDevice=([^\s)]+)")
    return {
        "host": f"coalesce({device}, 'unknown')", "program": "'sysmon'", "event_id": event, "username": d.rx("message", r"\bUser=([^\s)]+)"), "device": device, "source_ip": d.rx("message", rf"SrcIp=({IP})"),
        "destination_ip": d.rx("message", rf"DestinationIp=({IP})"), "destination_port": f"try_cast({d.rx('message', r'DestinationPort=(\d+)')} as bigint)", "protocol": d.rx("message", r"Protocol=(\w+)"), "image": d.rx("message", r"\bImage=\"?([^\s\"]+)"),
        "action": f"case when {event} = 3 then 'network_connect' when {event} is not null then 'event_' || cast({event} as string) else 'edr_event' end", "status": f"case when {event} = 3 then 'success' else 'info' end",
    }


def _win_structured(d: Dialect) -> dict[str, str]:
    keys = {"host": "Host", "channel": "Channel", "level": "Level", "username": "User", "source_ip": "SrcIp", "logon_type": "LogonType"}
    level = kv(d, "line", "Level")
    return {c: kv(d, "line", k) for c, k in keys.items()} | {"action": windows(WINDOWS, 0, "'event'"), "status": windows(WINDOWS, 1, f"coalesce(lower({level}), 'info')"),
        "program": f"coalesce({kv(d, 'line', 'Channel')}, 'winevent')", "message": "line"} | quoted(d, "line")


def _win(d: Dialect) -> dict[str, str]:
    ids = [i for i in WINDOWS if i not in STRUCTURED_ONLY]
    dev = d.rx("message", r"\bDevice=(\S+)")
    return {"host": dev, "device": dev, "program": "'winevent'", "provider": d.rx("message", r"Provider=(\S+)"), "username": d.rx("message", r"SubjectUserName=(\S+)"),
        "source_ip": d.rx("message", rf"IpAddress=({IP})"), "action": windows(ids, 0, "'event'"), "status": windows(ids, 1, "'info'")} | quoted(d, "message")


def _squid(d: Dialect) -> dict[str, str]:
    acts = [("contains(result_code, 'MISS')", "cache_miss"), ("contains(result_code, 'HIT')", "cache_hit"), ("contains(result_code, 'DENIED')", "access_denied")]
    return {"program": "'squid'", "dest_ip": "nullif(peer, '-')", "username": "nullif(who, '-')", "domain": d.rx("url", r"^https?://([^/?#]*)"), "action": case(*acts,
        other="'proxy_access'"), "status": "case when contains(result_code, 'DENIED') and not contains(result_code, 'MISS') and not contains(result_code, 'HIT') then 'blocked' else 'success' end"}


def _suricata(d: Dialect) -> dict[str, str]:
    low = "lower(classification)"
    kinds = [(f"contains({low}, 'attempted') or contains({low}, 'attack')", "attack", "blocked"), (f"contains({low}, 'policy')", "policy_violation", "alert"), (f"contains({low}, 'malware')", "malware", "blocked")]
    return {"program": "'suricata'", "message": "trim(msg)", "action": case(*[(c, a) for c, a, _ in kinds], other="'alert'"), "status": case(*[(c, s) for c, _, s in kinds], other="'info'")}


def _keyvalue(d: Dialect) -> dict[str, str]:
    src, dst, act = (kv(d, "line", k) for k in ("src", "dst", "action"))
    cut = lambda v, n: f"nullif(split_part({v}, ':', {n}), '')"
    return {
        "username": kv(d, "line", "user"), "source_ip": f"coalesce({cut(src, 1)}, {kv(d, 'line', 'source_ip')}, case when {kv(d, 'line', 'ip')} is null then {d.rx('line', rf'\b({IP})\b')} end)",
            "src_port": cut(src, 2), "dest_ip": cut(dst, 1), "dest_port": cut(dst, 2),
        "action": act, "status": f"case when upper({act}) in ('ALLOW', 'ESTABLISHED', 'ACCEPT') then 'success' else {kv(d, 'line', 'status')} end", "message": "line",
    }


ACCESS = r"\[([^\]]+)\]\s+\"([^\"]*)\" (\d{3}) (\S+)(?:\s+\"([^\"]*)\" \"([^\"]*)\")?(?:\s+vhost=(\S+))?"


#: By the order in which formats are tried on a file.
FORMATS = {f.name: f for f in [
    Format("suricata_fast", rf"^(\d{{2}}/\d{{2}}/\d{{4}})-(\d{{2}}:\d{{2}}:\d{{2}}\.\d{{6}})\s+\[\*\*\]\s+\[(\d+:\d+:\d+)\]\s+([^\[]+)\s+\[\*\*\]\s+\[Classification:\s*([^\]]+)\]\s+\[Priority:\s*(\d+)\]\s+\{{(\w+)\}}\s+({IP}):(\d+)\s+->\s+({IP}):(\d+)$",
           {"day": 1, "clock": 2, "sid": 3, "msg": 4, "classification": 5, "priority": 6, "protocol": 7, "source_ip": 8, "src_port": 9, "dest_ip": 10, "dest_port": 11},
               lambda d: d.instant("day || ' ' || clock", "%m/%d/%Y %H:%M:%S.%f"), _suricata, (*D, "msg"), ("priority", "src_port", "dest_port")),
    Format("suricata_simple", ISO + rf"SURICATA\s+(?:ALERT|INFO):\s+signature=\"(.*?)\"\s+severity=(\w+)\s+src=({IP})\s+dst=({IP})\s+proto=(\w+)",
           ISO_GROUPS | {"signature": 3, "severity": 4, "source_ip": 5, "dest_ip": 6, "proto": 7}, iso, lambda d: {"protocol": "upper(proto)", "program": "'suricata'", "action": "'alert'", "status": "'info'", "message": "line"}, (*D, "proto")),
    Format("zeek_dns", rf"^(\d{{2}}-[A-Za-z]{{3}}-\d{{4}})\s+(\d{{2}}:\d{{2}}:\d{{2}}\.\d{{3}})\s+client\s+@(\w+)\s+({IP})#(\d+)\s+\([^)]+\):\s+query:\s+(\S+)\s+IN\s+(\w+)\s+([^)]+)\s+\(({IP})\)$",
           {"day": 1, "clock": 2, "client_id": 3, "source_ip": 4, "src_port": 5, "domain": 6, "query_type": 7, "flags": 8, "dest_ip": 9}, lambda d: d.instant("day || ' ' || clock", "%d-%b-%Y %H:%M:%S.%3f"),
           lambda d: {"program": "'zeek_dns'", "action": "case when contains(flags, '+E') then 'query_error' else 'query' end", "status": "case when contains(flags, '+E') then 'failed' else 'success' end", "message": "line"}, D, ("src_port",)),
    Format("apache", RFC + r"(\S+)\s+httpd\[\d+\]:\s(\S+)\s+\S+\s+(\S+)\s+" + ACCESS + r"(?:\s+attack=(\S+))?$",
           RFC_GROUPS | {"host": 4, "source_ip": 5, "username": 6, "local": 7, "request": 8, "http_status": 9, "bytes_sent": 10, "referrer": 11, "user_agent": 12, "vhost": 13, "attack": 14}, rfc, _apache, (*T, "local", "request", "attack")),
    Format("apache_combined", rf"^({IP})\s+-\s+(\S+)\s+" + ACCESS + r"(?:\s+host=(\S+))?(?:\s+attack=(\S+))?$",
           {"source_ip": 1, "username": 2, "local": 3, "request": 4, "http_status": 5, "bytes_sent": 6, "referrer": 7, "user_agent": 8, "vhost": 9, "host": 10,
               "attack": 11}, lambda d: d.instant("split_part(local, ' ', 1)", "%d/%b/%Y:%H:%M:%S"), _apache, ("local", "request", "attack")),
    Format("squid", rf"^(\d+)\.(\d{{3}})\s+(\d+)\s+({IP})\s+(\w+)/(\d+)\s+(\d+)\s+(\w+)\s+(\S+)\s+(\S+)\s+(\S+)/(\S+)\s+(\S+)$",
           {"sec": 1, "ms": 2, "duration": 3, "source_ip": 4, "result_code": 5, "http_status": 6, "bytes_sent": 7, "method": 8, "url": 9, "who": 10, "hierarchy_code": 11,
               "peer": 12, "content_type": 13}, lambda d: "timestamp_millis(sec * 1000 + ms)" if d.name == "spark" else "make_timestamp((sec * 1000 + ms) * 1000)",
           _squid, ("sec", "ms", "who", "peer"), ("sec", "ms", "duration", "bytes_sent")),
    Format("modsecurity", ISO + rf"ModSecurity:\s*(?:Warning|Error)\.\s+.*?\[msg\s+\"(.*?)\"\].*?\[uri\s+\"(.*?)\"\].*?\[client\s+({IP})\](?:.*?\[id\s+\"(\d+)\"\])?.*$",
           ISO_GROUPS | {"message": 3, "uri": 4, "client_ip": 5, "rule_id": 6}, iso, lambda d: {"program": "'modsecurity'", "action": "'waf_alert'", "status": "'alert'"}, D, ("rule_id",)),
    Format("vpcflow", ISO + rf"aws:vpcflow\s+src=({IP})\s+dst=({IP})\s+dport=(\d+)\s+protocol=(\d+)\s+action=(ACCEPT|REJECT)\s+bytes=(\d+)$",
           ISO_GROUPS | {"source_ip": 3, "dest_ip": 4, "dest_port": 5, "protocol": 6, "act": 7, "bytes": 8}, iso, lambda d: {"program": "'vpcflow'", "action": "lower(act)",
               "status": "case when act = 'ACCEPT' then 'success' else 'blocked' end"}, (*D, "act"), ("dest_port", "bytes")),
    Format("netflow", ISO + rf"NETFLOW\s+src=({IP}):(\d+)\s+dst=({IP}):(\d+)\s+proto=(\w+)\s+bytes=(\d+)\s+pkts=(\d+)\s+action=(\w+)",
           ISO_GROUPS | {"source_ip": 3, "src_port": 4, "dest_ip": 5, "dest_port": 6, "proto": 7, "bytes": 8, "packets": 9, "act": 10}, iso, lambda d: {"program": "'netflow'",
               "protocol": "upper(proto)", "action": "lower(act)", "status": "case when lower(act) in ('permit', 'allow', 'accept') then 'success' else 'blocked' end"},
               (*D, "proto", "act"), ("src_port", "dest_port", "bytes", "packets")),
    Format("sysmon", ISO + r"Sysmon:\s+(.*)$", ISO_GROUPS | {"message": 3}, iso, _sysmon, D),
    Format("router_ios", RFC + r"(\S+)\sios\[\d+\]:\s(.*)$", RFC_GROUPS | {"host": 4, "message": 5}, rfc, _ios, T),
    Format("sysmon_network", ISO + rf"Sysmon:\s*EventID=3.*?Image=(\S+).*?DestinationIp=({IP}).*?DestinationPort=(\d+)\s+Protocol=(\w+)",
           ISO_GROUPS | {"process": 3, "dest_ip": 4, "dest_port": 5, "proto": 6}, iso, lambda d: {"protocol": "upper(proto)", "program": "'sysmon'", "action": "'connect'", "status": "'success'"}, (*D, "proto"), ("dest_port",)),
    Format("winevent_structured", ISO + r"Host=\S+\s+(?:Channel=\S+\s+)?EventID=(\d+)", ISO_GROUPS | {"event_id": 3}, local, _win_structured, D, ("event_id",)),
    Format("winevent", ISO + r"WinEvent:\s+(EventID=(\d+).*)$", ISO_GROUPS | {"message": 3, "event_id": 4}, local, _win, D, ("event_id",)),
    Format("openssh", RFC + r"(\S+)\ssshd\[(\d+)\]:\s(.*)$", RFC_GROUPS | {"host": 4, "pid": 5, "message": 6}, rfc, _openssh, T),
    Format("firewall_kv", RFC + r"(\S+)\sfirewall\[\d+\]:\s(.*)$", RFC_GROUPS | {"host": 4, "message": 5}, rfc, _firewall, T),
    Format("firewall_iptables", RFC + r"(\S+)\skernel:\s\[\d+\.\d+\]\s(.*)$", RFC_GROUPS | {"host": 4, "message": 5}, rfc, _iptables, T),
    Format("dhcp", RFC + r"(?:(\S+)\s+)?dhcpd(?:\[\d+\])?:\s(.*)$", RFC_GROUPS | {"host": 4, "message": 5}, rfc, _dhcp, T),
    Format("bind", RFC + r"(\S+)\snamed\[\d+\]:\s(.*)$", RFC_GROUPS | {"host": 4, "message": 5}, rfc, _bind, T),
    Format("dnsmasq", RFC + r"(\S+)\sdnsmasq\[(\d+)\]:\s(.*)$", RFC_GROUPS | {"host": 4, "pid": 5, "message": 6}, rfc, _dnsmasq, T),
    Format("linux", RFC + r"(\S+)\s(kernel|network|systemd|dhcp|dns|firewall|iptables):\s(.*)$", RFC_GROUPS | {"host": 4, "program": 5, "message": 6}, rfc,
           lambda d: {"source_ip": d.rx("message", rf"\b({IP})\b"), "action": case(("contains(lower(message), 'link up')", "interface_up"), ("contains(lower(message), 'link down')",
               "interface_down"), ("contains(lower(message), 'dhcp')", "dhcp")), "status": case(("contains(lower(message), 'link up') or contains(lower(message), 'link down')",
               "success"), ("contains(lower(message), 'dhcp')", "info"))}, T),
    Format("config_change", ISO + r"configd:\s+([A-Za-z0-9_.:\-]+)\s+configuration\s+(updated|rolled back|applied|reloaded)\s+by\s+(\S+)\s+change_id=(\d+)",
        ISO_GROUPS | {"configuration": 3, "act": 4, "actor": 5, "change_id": 6}, iso, lambda d: {"program": "'configd'", "action": "replace(act, ' ', '_')", "status": "'success'"}, (*D, "act"), ("change_id",)),
    Format("syslog_iso", ISO + r"(\S+)\s+([^:]+):\s(.*)$", ISO_GROUPS | {"host": 3, "program": 4, "message": 5}, iso, _syslog_iso, D),
    Format("auth_daemon", RFC + r"(\S+)\s([^:]+):\s(.*)$", RFC_GROUPS | {"host": 4, "program": 5, "message": 6}, rfc, _pam, T),
    Format("syslog", RFC + r"(\S+)\s([^:]+):\s(.*)$", RFC_GROUPS | {"host": 4, "program": 5, "message": 6}, rfc, _syslog, T),
    Format("keyvalue", r"^(?:(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2})\S*\s+)?.*?[A-Za-z0-9_\-.]+=\S", {"day": 1, "clock": 2}, iso, _keyvalue, D),
]}


def parse(lines: DataFrame, name: str) -> DataFrame:
    """Parse ``lines`` (line_no, line) of a known format."""
    return apply(FORMATS[name].text, lines=lines)


#: Formats that another covers when a file is sniffed.
NOT_SNIFFED = ("auth_daemon", "keyvalue")
HEAD = 60


def sniff_counts(d: Dialect) -> str:
    """Hits of each format on the first HEAD lines."""
    counts = " union all ".join(f"select {i} as place, '{f.name}' as format, {d.text(f.pattern)} as pattern" for i, f in enumerate(FORMATS.values()) if f.name not in NOT_SNIFFED)
    hit = "regexp_like(line, pattern)" if d.name == "spark" else "regexp_matches(line, pattern)"
    return f"""select format, place, count_if({hit}) as hits, count(*) as n from (select line
      from @lines where trim(line) <> '' order by line_no limit {HEAD}) as head
      cross join ({counts}) as formats group by format, place"""


def sniff(lines: DataFrame) -> str:
    """The first format with hits >= max(3, n // 4) on the first lines, else key=value."""
    rows = apply(sniff_counts, lines=lines).orderBy("place").collect()  # one row per format
    return next((r["format"] for r in rows if r.hits >= max(3, r.n // 4)), "keyvalue")


#: Lines that begin a record.
STARTS = "|".join([RFC, ISO, r"^\d{4}-\d{2}-\d{2}[ T]", r"^\d{2}-[A-Za-z]{3}-\d{4}", r"^\d{2}/\d{2}/\d{4}", r"^\d+\.\d{3}", r"^\w+=.+", rf"^{IP}\s+-\s"])


def merge_multiline(d: Dialect) -> str:
    """(file, line_no, line) records: a line that begins none is joined to the one before, file by file.

    Lines are numbered within each split of a file; the records of the splits
    before are added, so that no task needs a whole file.
    """
    begin = f"case when {d.has('line', STARTS)} and not {d.has('line', r'^[ \t]')} then 1 else 0 end"
    line = "array_join(transform(array_sort(collect_list(struct(split, line_no, line))), x -> x.line), '\\n')" if d.name == "spark" else "string_agg(line, chr(10) order by split, line_no)"
    totals = f"select file, split, sum({begin}) as starts from @lines group by file, split"
    offsets = f"select file, split, coalesce(sum(starts) over (partition by file order by split rows between unbounded preceding and 1 preceding), 0) as earlier from ({totals}) as t"
    inner = f"select *, sum({begin}) over (partition by file, split order by line_no rows between unbounded preceding and current row) as record from @lines"
    first = "min(struct(split, line_no)).line_no" if d.name == "spark" else "list(line_no order by split, line_no)[1]"
    return f"""select file, {first} as line_no, {line} as line from
      (select l.file, l.split, l.line_no, l.line, record + earlier as record from ({inner}) as l join ({offsets}) as o on o.file = l.file and o.split = l.split) as numbered group by file, record"""


def sniff_files(lines: DataFrame) -> dict[str, str]:
    """Format of each file: that of its first HEAD records, as ``sniff`` would find it.

    Only the first lines of the first split of each file are looked at; one short
    row per file comes back.
    """
    place = Window.partitionBy("file").orderBy("line_no")
    head = lines.where("split = 0 and trim(line) <> ''").withColumn("k", F.row_number().over(place)).where(F.col("k") <= 10 * HEAD).drop("k")
    head = apply(merge_multiline, lines=head).withColumn("k", F.row_number().over(place)).where(F.col("k") <= HEAD)
    tried = [f for f in FORMATS.values() if f.name not in NOT_SNIFFED]
    rows = head.groupBy("file").agg(F.count("*").alias("n"), *[F.count_if(F.col("line").rlike(f.pattern)).alias(f.name) for f in tried]).collect()
    return {r.file: next((f.name for f in tried if r[f.name] >= max(3, r.n // 4)), "keyvalue") for r in rows}


TEXTS: dict[str, Text] = {name: f.text for name, f in FORMATS.items()}
