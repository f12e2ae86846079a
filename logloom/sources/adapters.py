"""Adapters of structured layouts (CSV, JSON) to the event table.

``adapt`` picks the first layout whose columns and evidence fit and stops there.
Each adapter is a text over ``@rows`` with the layout's columns as strings.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.dialect import Dialect, apply
from . import parsers as P


@dataclass
class Layout:
    name: str
    columns: tuple[str, ...]  #: columns that must be there
    select: Callable[[Dialect], dict[str, str]]
    process: str | None = None  #: value of ``process`` that must occur
    evidence: str | None = None  #: pattern that some message must fit
    where: str = "true"

    def with_id(self, d: Dialect) -> str:
        return self.text(d).replace("select ", "select row_id, ", 1)

    def text(self, d: Dialect) -> str:
        return f"select {', '.join(f'{e} as {c}' for c, e in self.select(d).items())} from @rows where {self.where}"


def when(d: Dialect, col: str = "timestamp", fmt: str = "%Y-%m-%d %H:%M:%S") -> str:
    return d.instant(col, fmt)


def message_of(derive, program: str | None = None, keep: tuple[str, ...] = ("host", "message")) -> Callable[[Dialect], dict[str, str]]:
    """Columns of a syslog-style layout whose message is parsed as a text line's would be."""

    def build(d: Dialect) -> dict[str, str]:
        made = derive(d)
        out = {"timestamp": when(d)} | {c: c for c in keep if c not in made} | made
        return out | ({"program": f"'{program}'"} if program else {})

    return build


def _win_csv(d: Dialect) -> dict[str, str]:
    # The event ids that this layout maps.
    ids = [4624, 4625, 4634, 4672, 4688]
    event = f"try_cast({d.rx('message', r'EventID=(\d+)')} as bigint)"
    swap = lambda s: s.replace("event_id", event)
    return {"timestamp": d.plus(when(d), -P.LOCAL_HOURS, "hour"), "host": "host", "program": "'winevent'", "event_id": event, "username": d.rx("message",
        r"SubjectUserName=(\S+)"), "source_ip": d.rx("message", rf"IpAddress=({P.IP})"), "action": swap(P.windows(ids, 0, "'event'")), "status": swap(P.windows(ids, 1, "'info'")), "message": "message"}


def _suricata_csv(d: Dialect) -> dict[str, str]:
    return {"timestamp": when(d), "program": "'suricata'", "source_ip": "src_ip", "dest_ip": "dst_ip", "src_port": "try_cast(src_port as bigint)", "dest_port": "try_cast(dst_port as bigint)",
        "protocol": "protocol", "classification": "classification", "priority": "try_cast(priority as bigint)", "sid": "sid",
            "action": P.case(("contains(lower(classification), 'attempted') or contains(lower(classification), 'attack')", "attack"), ("contains(lower(classification), 'policy')",
                "policy_violation"), ("contains(lower(classification), 'malware')", "malware"), other="'alert'"), "message": "message"}


def _squid_csv(d: Dialect) -> dict[str, str]:
    return {"timestamp": when(d), "program": "'squid'", "source_ip": "client_ip", "username": "nullif(\"user\", '-')" if d.name == "duck" else "nullif(`user`, '-')",
        "method": "method", "url": "url", "domain": d.rx("url", r"^https?://([^/?#]*)"), "http_status": "http_status", "bytes_sent": "try_cast(bytes_sent as bigint)",
        "duration": "try_cast(duration as bigint)", "content_type": "content_type",
            "status": "case when try_cast(http_status as int) >= 400 then 'failed' else 'success' end"}


def _openssh_csv(d: Dialect) -> dict[str, str]:
    own = {c: e.replace("message", "content") for c, e in P._openssh(d).items()}
    return {"timestamp": d.instant(f"'{P.YEAR} ' || date || ' ' || day || ' ' || time", "%Y %b %d %H:%M:%S"), "pid": "pid", "event_template": "eventtemplate", "message": "content"} | own


def _linux_csv(d: Dialect) -> dict[str, str]:
    own = {c: e.replace("message", "content") for c, e in P._syslog_iso(d).items()}
    own = {c: e.replace("program", "component") for c, e in own.items()}
    return {"timestamp": d.instant(f"'{P.YEAR} ' || month || ' ' || date || ' ' || time", "%Y %b %d %H:%M:%S"), "program": "component", "pid": "pid", "level": "level", "message": "content"} | own


def _windows_security(d: Dialect) -> dict[str, str]:
    field = lambda k: d.rx("message", k + r":\s+([^\s]+)")
    event = "try_cast(event_id as bigint)"
    ids = [4624, 4625, 4634, 4672, 4688, 4798, 5379]
    swap = lambda s: s.replace("event_id", "try_cast(event_id as bigint)")
    return {"timestamp": d.plus(d.instant("date_and_time", "%m/%d/%Y %H:%M:%S"), -P.LOCAL_HOURS, "hour"), "program": "'windows'", "provider": "source", "event_id_num": event, "category": "task_category", "keywords": "keywords",
            "username": field("Account Name"), "account_domain": field("Account Domain"), "logon_id": field("Logon ID"), "logon_type": field("Logon Type"),
                "process_name": field("Process Name"), "workstation": field("Workstation Name"), "source_ip": field("Source Network Address"),
            "action": swap(P.windows(ids, 0, "'event'")), "status": swap(P.windows(ids, 1, "case when contains(keywords, 'Failure') then 'failed' else 'info' end")), "message": "message"}


def _zeek_csv(d: Dialect) -> dict[str, str]:
    return {"timestamp": when(d), "program": "'zeek_dns'", "source_ip": "source_ip", "username": "username", "domain": d.rx("message", r"query:\s+(\S+)"),
        "query_type": d.rx("message", r"IN\s+(\w+)"), "action": "case when contains(message, '+E') then 'query_error' else 'query' end", "status": "case when contains(message, '+E') then 'failed' else 'success' end", "message": "message"}


def _apache_csv(d: Dialect) -> dict[str, str]:
    m = rf"^({P.IP})\s+\S+\s+(\S+)\s+" + P.ACCESS
    g = {"source_ip": 1, "username": 2, "request": 4, "http_status": 5, "bytes_sent": 6, "referrer": 7, "user_agent": 8, "vhost": 9}
    raw = {c: d.rx("message", m, n) for c, n in g.items()}
    made = P._apache(d)
    for c in ("request", "http_status", "user_agent"):
        made = {k: re.sub(rf"\b{c}\b", lambda _: f"({raw[c]})", e) for k, e in made.items()}
    made["attack_type"] = d.rx("message", r"attack=(\S+)")
    return {"timestamp": when(d), "host": "host"} | {c: e for c, e in raw.items() if c != "request"} | made | {"message": "message"}


def _classic_apache(d: Dialect) -> dict[str, str]:
    code = "try_cast(http_status as int)"
    return {"timestamp": when(d), "program": "'apache'", "source_ip": "remote_addr", "method": "method", "path": "path", "protocol": "protocol", "http_status": "http_status",
        "bytes_sent": "bytes_sent", "referrer": "referrer", "user_agent": "user_agent", "status": f"case when {code} between 200 and 399 then 'success' when {code} between 400 and 599 then 'failed' else 'unknown' end"}


SYSLOG = ("timestamp", "host", "process", "message")

#: In the order in which they are tried.
LAYOUTS = {x.name: x for x in [
    Layout("zeek_dns_csv", ("message", "source_ip", "timestamp"), _zeek_csv, evidence=r"query:\s"),
    Layout("apache_extended_csv", SYSLOG, _apache_csv, process="httpd", evidence="HTTP/", where="process = 'httpd'"),
    Layout("dhcp_extended_csv", SYSLOG, message_of(P._dhcp), process="dhcpd", where="process = 'dhcpd'"),
    Layout("router_csv", SYSLOG, message_of(P._ios), process="ios", evidence="%|Login|Configured", where="process = 'ios'"),
    Layout("edr_extended_csv", SYSLOG, message_of(P._sysmon), process="sysmon", where="process = 'sysmon'"),
    Layout("dns_extended_csv", SYSLOG, message_of(P._bind), process="named", where="process = 'named'"),
    Layout("winevent_csv", SYSLOG, _win_csv, process="winevent", evidence="EventID=", where="process = 'winevent'"),
    Layout("firewall_csv", ("timestamp", "host", "message"), message_of(P._firewall), evidence=r"action=\S+.*src="),
    Layout("syslog_csv", SYSLOG, lambda d: {"timestamp": when(d), "host": "host", "process": "process"} | {c: re.sub(r"\bprogram\b", "process", e) for c, e in P._syslog(d).items()} | {"program": "'syslog'", "message": "message"}),
    Layout("suricata_csv", ("timestamp", "src_ip", "dst_ip"), _suricata_csv),
    Layout("squid_csv", ("timestamp", "client_ip"), _squid_csv),
    Layout("openssh_csv", ("lineid", "date", "day", "time", "component", "content"), _openssh_csv),
    Layout("linux_csv", ("month", "date", "time", "component", "content"), _linux_csv),
    Layout("windows_security_csv", ("keywords", "date_and_time", "source", "event_id", "task_category"), _windows_security),
    Layout("apache_csv", ("timestamp", "remote_addr"), _classic_apache),
]}


def clean_header(name: str) -> str:
    """A column name without BOM and spaces around, lower case, spaces inside as underscores."""
    return name.replace("\ufeff", "").strip().lower().replace(" ", "_")


def with_clean_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_header(c) for c in df.columns])


def layouts(rows: DataFrame) -> dict[str, str | None]:
    """The first layout that fits each file's columns and, where asked for, its rows: one short row per file comes back.

    A file has a column if some row of it has a value there.
    """
    have = set(rows.columns)
    open_ = [x for x in LAYOUTS.values() if set(x.columns) <= have]
    used = sorted({c for x in open_ for c in x.columns})
    probes = [F.max(F.col(f"`{c}`").isNotNull()).alias(f"c_{c}") for c in used]
    for x in open_:
        if x.process:
            probes.append(F.max(F.coalesce(F.lower("process") == x.process, F.lit(False))).alias(f"p_{x.name}"))
        if x.evidence:
            probes.append(F.max(F.coalesce(F.col("message").rlike(x.evidence), F.lit(False))).alias(f"e_{x.name}"))
    found = {}
    for r in rows.groupBy("file").agg(F.count("*").alias("n"), *probes).collect():
        fits = (x.name for x in open_ if all(r[f"c_{c}"] for c in x.columns) and (not x.process or r[f"p_{x.name}"]) and (not x.evidence or r[f"e_{x.name}"]))
        found[r.file] = next(fits, None)
    return found


def adapt(rows: DataFrame) -> list[tuple[str | None, DataFrame]]:
    """(layout, event columns with row_id) of structured files (file, row_id, columns); rows as they are where no layout fits."""
    rows = with_clean_header(rows)
    chosen = layouts(rows)
    out = []
    for name in sorted(set(chosen.values()), key=str):
        files = rows.sparkSession.createDataFrame([(f,) for f, x in chosen.items() if x == name], "file string")
        mine = rows.join(files, "file", "left_semi")
        out.append((name, mine.drop("file") if name is None else apply(LAYOUTS[name].with_id, rows=mine)))
    return out
