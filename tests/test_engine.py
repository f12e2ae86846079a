"""Golden lines, thresholds, edge cases, the API, streaming."""

import datetime as dt
import math
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from logloom import api, schema
from logloom.operators import baselines, detectors as D, noise, report, series
from logloom.plans.dialect import SPARK, apply, bind, doubles, only_group
from logloom.sources import adapters, parsers, readers, sinks
from logloom.streaming import detect as streaming

T0 = dt.datetime(2025, 3, 1, 8, 0, 0)
COLUMNS = "timestamp timestamp, row_id bigint, n bigint, dest_port bigint, http_status bigint, bytes bigint, win_id bigint, " + ", ".join(f"{c} string" for c in schema.TEXT)


def events(spark, rows):
    names = [c.strip().split()[0] for c in COLUMNS.split(",")]
    full = [{"timestamp": T0, "row_id": i, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in full], COLUMNS)


def found(spark, text, rows, **more):
    return {(r.subject, round(r.score, 4), r.severity) for r in apply(text, logs=events(spark, rows), **more).collect()}


# Lines made up for these tests from the formats' definitions.
GOLDEN = [
    ("openssh", "Mar  4 11:22:33 gate7 sshd[811]: Accepted publickey for ines from 172.16.8.21 port 50110", {"host": "gate7", "pid": "811", "username": "ines", "source_ip": "172.16.8.21", "action": "login", "status": "success"}),
    ("firewall_kv", "Mar  4 11:22:34 edge2 firewall[42]: action=ALLOW user=omar device=pad9 src=172.16.8.22 dst=172.16.0.9 dst_host=wiki.corp.test dport=8443 proto=TCP bytes=60123 rule=wiki", {"username": "omar", "dest_ip": "172.16.0.9", "dest_port": "8443", "bytes_sent": "60123", "action": "allow", "status": "success", "severity": "INFO"}),
    ("firewall_iptables", "Mar  4 11:22:35 edge3 kernel: [77.125] DROP IN=eth4 OUT= MAC=y SRC=198.51.100.77 DST=172.16.0.3", {"source_ip": "198.51.100.77", "dest_ip": "172.16.0.3", "action": "drop", "status": "blocked"}),
    ("dhcp", "Mar  4 11:22:36 pool1 dhcpd: DHCPDISCOVER from 02:aa:bb:cc:dd:01 via eth6", {"mac_address": "02:aa:bb:cc:dd:01", "interface": "eth6", "action": "discover", "status": "info"}),
    ("squid", "1700000000.250 88 172.16.8.23 TCP_MISS/200 4096 GET http://docs.corp.test/a - DIRECT/203.0.113.50 text/css", {"domain": "docs.corp.test", "dest_ip": "203.0.113.50", "action": "cache_miss", "bytes_sent": 4096, "username": None}),
    ("suricata_fast", "03/04/2025-11:22:37.000042  [**] [1:7:3] Odd client hello [**] [Classification: Attempted Recon] [Priority: 3] {UDP} 172.16.8.24:4001 -> 203.0.113.51:161", {"sid": "1:7:3", "message": "Odd client hello", "action": "attack", "priority": 3, "dest_port": 161}),
    ("zeek_dns", "04-Mar-2025 11:22:38.001 client @0x9c1 172.16.8.25#3055 (mx.corp.test): query: mx.corp.test IN MX + (172.16.0.53)", {"domain": "mx.corp.test", "query_type": "MX", "dest_ip": "172.16.0.53", "status": "success"}),
    ("dnsmasq", "Mar  4 11:22:39 ns2 dnsmasq[5]: query[AAAA] img.corp.test from 172.16.8.26", {"domain": "img.corp.test", "query_type": "AAAA", "source_ip": "172.16.8.26", "action": "query"}),
    ("winevent", "2025-03-04 18:22:40 WinEvent: EventID=4634 Provider=Security Session end: SubjectUserName=petra IpAddress=172.16.8.27", {"event_id": 4634, "username": "petra", "source_ip": "172.16.8.27", "action": "logoff"}),
    ("winevent_structured", "2025-03-04 18:22:41 Host=dc3 Channel=Security EventID=4624 Level=Info User=quinn SrcIp=172.16.8.28 LogonType=10", {"host": "dc3", "event_id": 4624, "username": "quinn", "action": "login", "program": "Security"}),
    ("router_ios", "Mar  4 11:22:42 core-4 ios[9]: %SYS-5-CONFIG_I: Configured from vty by rosa (172.16.8.29) using device rosa-pad", {"host": "core-4", "username": "rosa", "device": "rosa-pad", "action": "config_change"}),
    ("sysmon", "2025-03-04 11:22:43 Sysmon: EventID=3 User=sami Device=sami-pc SrcIp=172.16.8.30 DestinationIp=203.0.113.52 DestinationPort=853 Protocol=tcp Image=D:\\t\\q.exe", {"event_id": 3, "host": "sami-pc", "destination_port": 853, "image": "D:\\t\\q.exe", "action": "network_connect"}),
    ("syslog", "Mar  4 11:22:44 app5 sudo: tara : TTY=pts/3 ; PWD=/srv ; USER=root ; COMMAND=/usr/bin/id", {"username": "tara", "action": "sudo", "status": "success"}),
    ("apache", 'Mar  4 11:22:45 www3 httpd[31]: 172.16.8.31 - uma [04/Mar/2025:11:22:45 +0000] "GET /q?x=2 HTTP/1.1" 404 77 "-" "Agent Device/slate4 Dept/Legal Attack/lfi" vhost=shop attack=rce', {"host": "www3", "method": "GET", "path": "/q?x=2", "http_status": "404", "device": "slate4", "dept": "Legal", "attack_type": "lfi", "action": "client_error", "vhost": "shop"}),
    ("modsecurity", '2025-03-04 11:22:46 ModSecurity: Warning. rule hit [msg "Path traversal"] [uri "/d"] [client 198.51.100.78] [id "930100"]', {"message": "Path traversal", "uri": "/d", "rule_id": 930100}),
    ("keyvalue", "2025-03-04 11:22:47 unit8 action=ALLOW proto=TCP src=172.16.8.32:700 dst=203.0.113.53:990", {"source_ip": "172.16.8.32", "src_port": "700", "dest_port": "990", "status": "success"}),
]


@pytest.mark.parametrize("name,line,want", GOLDEN, ids=[g[0] for g in GOLDEN])
def test_golden_lines(spark, name, line, want):
    df = spark.createDataFrame([(1, line), (2, "no such format"), (3, None), (4, "")], "line_no long, line string")
    rows = parsers.parse(df, name).collect()
    assert len(rows) == 1 and rows[0].timestamp is not None
    assert {k: rows[0][k] for k in want} == want


def test_times(spark):
    df = spark.createDataFrame([(1, GOLDEN[0][1]), (2, GOLDEN[8][1]), (3, GOLDEN[15][1]), (4, GOLDEN[4][1])], "line_no long, line string")
    first = lambda name: parsers.parse(df, name).select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert first("openssh") == f"{parsers.YEAR}-03-04 11:22:33"
    assert first("winevent") == "2025-03-04 11:22:40"  # local time to UTC
    assert parsers.parse(df.where("line_no = 3"), "keyvalue").select(F.date_format("timestamp", "HH:mm:ss")).first()[0] == "11:22:47"
    assert first("squid") == "2023-11-14 22:13:20"


def test_sniff_and_merge(spark):
    lines = [(1, 0, i, GOLDEN[0][1]) for i in range(5)] + [(1, 0, 5, "  continued"), (1, 64, 0, "over the split"), (1, 64, 1, GOLDEN[0][1]), (1, 128, 9, "no start here"), (1, 192, 2, "nor here"), (2, 0, 0, "orphan"), (2, 0, 1, GOLDEN[3][1])]
    df = spark.createDataFrame(lines, "file int, split long, line_no long, line string")
    merged = sorted((r.file, r.line.removeprefix(GOLDEN[0][1])) for r in apply(parsers.merge_multiline, lines=df).collect())
    assert merged == [(1, "")] * 4 + [(1, "\n  continued\nover the split"), (1, "\nno start here\nnor here"), (2, GOLDEN[3][1]), (2, "orphan")]
    assert parsers.sniff(df.select("line_no", "line").where("file = 1 and split = 0")) == "openssh"
    assert parsers.sniff(spark.createDataFrame([(1, "a=1 b=2")], "line_no long, line string")) == "keyvalue"
    assert parsers.sniff_files(df) == {1: "openssh", 2: "keyvalue"}


def test_adapters_choose_by_columns_and_rows_of_each_file(spark):
    rows = spark.createDataFrame([("f", 1, "2025-01-01 00:00:00", "h", "dhcpd", "DHCPACK on 10.0.0.1 to 00:11:22:33:44:55 via eth0"), ("g", 2, "2025-01-01 00:00:00", "h", "ios", "%SYS-5-CONFIG_I: Configured from vty by eve (10.0.0.1)")], ["file", "row_id", "\ufefftimestamp", " Host", "Process", "message"])
    out = {name: [(r.row_id, r.action) for r in df.collect()] for name, df in adapters.adapt(rows)}
    assert out == {"dhcp_extended_csv": [(1, "ack")], "router_csv": [(2, "config_change")]}
    plain = spark.createDataFrame([("f", 5, 1)], "file string, row_id int, x int")
    [(name, same)] = adapters.adapt(plain)
    assert name is None and same.columns == ["row_id", "x"]


OUT, IN = "203.0.113.9", "10.0.0.1"
deny = lambda k, **x: [{"status": "blocked", "source_ip": "9.9.9.9", "dest_port": 100 * i, **x} for i in range(k)]
web = lambda k, code, **x: [{"http_status": code, "source_ip": OUT, "username": "amy", "path": "/p", **x}] * k
ssh = lambda m, **x: {"message": m, **x}
sysmon = lambda image, ip=OUT, **x: {"program": "sysmon", "username": "amy", "dept": "Sales", "image": image, "dest_ip": ip, **x}
login = lambda k, **x: [{"source_ip": OUT, **x}] * k

win = lambda k, **x: [{"win_id": k, "username": "amy", "message": "Event " + " ".join(f'{a}="{b}"' for a, b in x.items())}]


def beats(n, gap, jitter=0, **x):
    return [{"program": "sysmon", "username": "amy", "dest_ip": OUT_BEAT, "timestamp": T0 + dt.timedelta(seconds=gap * i + jitter * (i % 3)), **x} for i in range(n)]


OUT_BEAT = "8.8.4.4"


@pytest.mark.parametrize("text,rows,want", [
    # firewall rules apply once some row names a firewall, ufw or iptables in its program, or has a firewall's status
    (D.deny_burst_ip, deny(5, program="ufw"), {"9.9.9.9"}), (D.deny_burst_ip, deny(5), {"9.9.9.9"}), (D.deny_burst_ip, deny(4), set()),
    (D.deny_burst_ip, deny(5, status=None, action="DROP", program="iptables[3]"), {"9.9.9.9"}), (D.deny_burst_ip, deny(5, status=None, action="DROP", program="app"), set()),
    (D.deny_burst_ip, deny(5, status="drop", program="app") + [{"status": "Accepted"}], {"9.9.9.9"}),
    (D.exfil_row, [{"program": "UFW", "action": "allow", "source_ip": IN, "dest_ip": OUT, "bytes": 11 << 20}], {IN}), (D.exfil_row, [{"program": "UFW", "action": "allow", "source_ip": IN, "dest_ip": OUT, "bytes": 10 << 20}], set()),
    # web rules: the web server's rows if there are any, else all rows with web columns
    (D.suspicious_operations, web(1, 500), {"amy"}), (D.suspicious_operations, web(1, 500) + [{"program": "apache"}], set()), (D.suspicious_operations, web(1, 500, program="apache"), {"amy"}), (D.suspicious_operations, [{"method": "DELETE", "username": "amy"}], set()),
    (D.takeover_public, web(6, 401, username=None) + web(1, 200), {"amy"}), (D.takeover_public, web(5, 401, username=None) + web(1, 200), set()),
    (D.bruteforce_target, web(10, 401, source_ip=IN), {"amy"}), (D.bruteforce_target, web(9, 401, source_ip=IN), set()),
    (D.web_auth_failure, web(3, 403, action="GET") + web(2, 200, action="web_access"), {"amy"}), (D.web_auth_failure, web(3, 401, action="login") + web(2, 200, action="POST"), set()), (D.web_auth_failure, web(2, 401, action="get") + web(3, 200, action="get"), set()),
    # SSH logins: user and address of the text, from sshd or from a text that says so
    (D.ssh_lateral, [ssh("Accepted password for amy from 10.0.0.2 port 9", program="sshd[4]")], {"amy"}), (D.ssh_lateral, [ssh("accepted publickey for amy from 10.0.0.2 port 9")], {"amy"}),
    (D.ssh_lateral, [ssh("Accepted keyboard for amy from 10.0.0.2 port 9", program="sshd")], set()), (D.ssh_lateral, [ssh("Accepted password for amy", program="sshd", username="amy", source_ip=IN)], set()), (D.ssh_lateral, [ssh("Failed password for amy from 10.0.0.2 port 9", program="sshd")], set()),
    # processes: the name after the last separator of either kind, with a risky name in it; not for technical users or inner targets
    (D.suspicious_process, [sysmon("C:\\Windows\\System32\\PowerShell.exe")], {"amy"}), (D.suspicious_process, [sysmon("c:/tools/psexec.exe")], {"amy"}), (D.suspicious_process, [sysmon("C:\\x/y\\mycmd.exe")], {"amy"}),
    (D.suspicious_process, [sysmon("C:\\powershell.exe\\chrome.exe")], set()), (D.suspicious_process, [sysmon("C:\\x\\cmd.exe", IN)], set()), (D.suspicious_process, [sysmon("C:\\x\\cmd.exe", dept="ITAdmin")], set()), (D.suspicious_process, [sysmon(None)], set()),
    # failed logins by address: rows of sshd or with login or logon in the action; fail or denied in the status
    (D.bruteforce_by_ip, login(3, program="SSHD[1]", status="Failure") + login(2, program="sshd", status="success"), {OUT}), (D.bruteforce_by_ip, login(5, action="user_logon", status="access_denied"), {OUT}),
    (D.bruteforce_by_ip, login(5, action="connect", status="failed"), set()), (D.bruteforce_by_ip, login(2, action="login", status="failed") + login(3, action="login", status="ok"), set()), (D.bruteforce_by_ip, login(4, action="login", status="failed"), set()), (D.bruteforce_by_ip, login(9, action="login", status="failed", source_ip=" "), set()),
    # access to lsass by SourceImage; tasks and services by action, path and name
    (D.lsass_dump, win(10, SourceImage="C:\\t\\dump.exe", TargetImage="C:\\Windows\\LSASS.exe", GrantedAccess="0x1"), {"amy"}), (D.lsass_dump, win(10, SourceImage="a.exe", TargetImage="notepad.exe", GrantedAccess="0x1"), set()), (D.lsass_dump, win(11, SourceImage="a.exe", TargetImage="lsass.exe", GrantedAccess="0x1"), set()),
    (D.schtask, win(4698, TaskName="Daily", Action="powershell.exe -enc QQ=="), {"amy"}), (D.schtask, win(4698, TaskName="OneDrive x", Action="a.exe"), {"amy"}), (D.schtask, win(4698, TaskName="Daily", Action="backup.exe"), set()), (D.schtask, win(4698, TaskName="Telemetry", Action=""), set()),
    (D.service_install, win(7045, ServiceName="Spooler", ImagePath="C:\\Temp\\x.exe"), {"amy"}), (D.service_install, win(7045, ServiceName="Update_7", ImagePath="C:\\ok.exe"), {"amy"}), (D.service_install, win(7045, ServiceName="s", ImagePath="C:\\x\\lsass.exe"), {"amy"}),
    (D.service_install, win(7045, ServiceName="s", ImagePath="C:\\Windows\\System32\\lsass.exe"), set()), (D.service_install, win(7045, ServiceName="s", ImagePath="C:\\ProgramData\\Microsoft\\a.exe"), set()), (D.service_install, win(7045, ServiceName="s", ImagePath="C:\\ProgramData\\Other\\a.exe"), {"amy"}),
    # endpoint, router and web rules go by the message, whatever the program, and take from it what columns lack
    (D.suspicious_process, [{"program": "agent", "username": "amy", "dept": "Sales", "message": f"EventID=3 Image=C:\\x\\cmd.exe DestinationIp={OUT} DestinationPort=9"}], {"amy"}), (D.suspicious_process, [{"program": "agent", "username": "amy", "dept": "Sales", "image": "cmd.exe", "dest_ip": OUT, "message": "no telemetry"}], set()),
    (D.c2_beaconing, [b | {"program": "winlog", "dest_ip": None, "message": f"Sysmon EventID=3 DestinationIp={OUT_BEAT}"} for b in beats(10, 60)], {"amy"}),
    (D.edr_pattern, [{"program": "winlog", "username": "amy", "dept": "Sales", "message": f"SrcIp=10.0.0.{i} DestinationIp={OUT} DestinationPort=443 Image=C:\\powershell.exe"} for i in range(10)], {"amy"}),
    (D.suspicious_operations, [{"program": "apache", "message": '10.0.0.9 - eve [x] "DELETE /a HTTP/1.1" 200 5'}], {"eve"}), (D.suspicious_operations, [{"program": "apache", "username": "amy", "message": '10.0.0.9 - - [x] "GET /a?b HTTP/1.1" 500 5'}], {"amy"}),
    (D.web_exfil, [{"program": "apache", "message": '10.0.0.9 - eve [x] "GET /export/a.csv?x=1 HTTP/1.1" 200 60000'}], {"eve"}), (D.web_exfil, [{"program": "apache", "message": '10.0.0.9 - eve [x] "GET /a?file=/export/ HTTP/1.1" 200 60000'}], set()),
    # beacons: ten connections to one outer address at even distances; large transfers by text
    (D.c2_beaconing, beats(10, 60), {"amy"}), (D.c2_beaconing, beats(9, 60), set()), (D.c2_beaconing, beats(10, 400), set()), (D.c2_beaconing, beats(10, 60, dest_ip=IN), set()), (D.c2_beaconing, beats(10, 60, jitter=30), set()),
    (D.scp_exfil, [{"message": "amy -> 198.51.100.7:/x bytes=60000000"}], {"amy"}), (D.scp_exfil, [{"message": "amy -> 198.51.100.7:/x bytes=50000000"}], set()), (D.netfilter_exfil, [{"username": "amy", "message": "NETFILTER_PKT len=60000000 dst=198.51.100.7"}], {"amy"}), (D.netfilter_exfil, [{"username": "amy", "message": "len=60000000 dst=198.51.100.7"}], set()),
    # port scans: rows whose status (not action) is blocked or denied
    (D.port_scan, deny(5), {"9.9.9.9"}), (D.port_scan, deny(5, status="Denied"), {"9.9.9.9"}), (D.port_scan, deny(5, status="drop"), set()), (D.port_scan, deny(5, status=None, action="DENY"), set()), (D.port_scan, deny(4), set()),
])
def test_detectors_find_and_leave(spark, text, rows, want):
    assert {x[0] for x in found(spark, text, rows)} == want


def test_router_messages_of_any_program(spark):
    """BGP, OSPF and interface events are told by the message; 29 of a router named rtr went unseen once."""
    lines = {"bgp": "%BGP-5-ADJCHANGE: neighbor 10.0.0.2 Down", "interface": "%LINK-3-UPDOWN: Interface Gi0/1, changed state to down", "ospf": "%OSPF-5-ADJCHG: Process 1, Nbr 10.0.0.3 on Gi0/2 from FULL to DOWN"}
    for kind, text in (("bgp", D.bgp_unattributed), ("interface", D.interface_unattributed), ("ospf", D.ospf_unattributed)):
        rows = [{"program": "rtr", "host": "r1", "timestamp": T0 + dt.timedelta(seconds=i), "message": lines[kind]} for i in range(29)]
        logs = events(spark, rows)
        assert apply(text, logs=logs, ev=apply(D.router_events, logs=logs)).count() == 1
    rows = [{"program": "syslogd", "host": "r1", "timestamp": T0, "message": "%SYS-5-CONFIG_I: Configured from vty by eve (10.0.0.1)"}, {"program": "rtr-7", "host": "r1", "timestamp": T0, "message": "100% of %BGP memory"}]
    logs = events(spark, rows)
    assert [r.subject for r in apply(D.router_suspects, logs=logs, ev=apply(D.router_events, logs=logs)).collect()] == ["eve"]


def test_lookups_have_one_row_per_key(spark):
    """Repeated keys of lookup tables don't multiply events; the greatest values count."""
    logs = events(spark, [{"source_ip": "10.0.0.1", "dest_ip": "10.0.0.2", "username": "amy"}, {"source_ip": "10.0.0.2", "username": None}] * 5)
    assets = spark.createDataFrame([("10.0.0.1", "a"), ("10.0.0.1", "b"), ("10.0.0.2", "c"), ("10.0.0.2", None), (None, "n")], "ip string, name string")
    people = spark.createDataFrame([("amy", "Legal", "clerk"), ("amy", "Legal", "head"), ("amy", "Audit", "z"), (None, "x", "y")], "username string, department string, role string")
    out = api.enrich(logs, assets=assets, people=people).collect()
    assert len(out) == 10 and {(r.source_asset, r.destination_asset, r.department, r.role) for r in out} == {("b", "c", "Legal", "head"), ("c", None, None, None)}


def test_downloads_by_action_or_phrase(spark):
    rows = [{"username": "amy", "action": "File_Download"}, {"username": "amy", "message": "vừa TẢI XUỐNG tệp"}, {"username": "amy", "message": "Downloaded x"}, {"username": "amy", "message": "GET /export/a"}, {"message": "download"}]
    got = {r.username: (r.daily_mean, r.days) for r in apply(baselines.download_daily, logs=events(spark, rows)).collect()}
    assert got == {"amy": (3.0, 1), "<unknown>": (1.0, 1)} or got == {"amy": (3.0, 1), "(unknown)": (1.0, 1)}
    stats = spark.createDataFrame([("amy", 1.0, 0.5)], "username string, events_mean double, events_std double")
    many = [{"username": "amy", "action": "download"}] * 5
    assert {x[0] for x in found(spark, D.download_spike, many, stats=stats)} == {"amy"}
    assert not found(spark, D.download_spike, many[:4] + [{"username": "amy", "message": "/export/"}], stats=stats)


def test_rolling_by_minutes(spark):
    """Ten minutes with the current one, five at least, over midnight too, against plain arithmetic."""
    import statistics

    start = dt.datetime(2025, 3, 1, 23, 50)
    counts = [3, 0, 1, 7, 2, 2, 9, 0, 4, 4, 1, 6, 5, 0, 8]
    rows = [{"timestamp": start + dt.timedelta(minutes=m, seconds=i)} for m, c in enumerate(counts) for i in range(c)]
    got = [(r.epm, r.ma, r.sd) for r in apply(series.rolling10, logs=events(spark, rows)).orderBy("us").collect()]
    frames = [counts[max(0, m - 9) : m + 1] for m in range(len(counts))]
    want = [(f[-1], round(sum(f) / len(f), 6), round(statistics.pstdev(f), 6)) for f in frames if len(f) >= 5]
    assert got == [(e, pytest.approx(m, abs=2e-6), pytest.approx(s, abs=2e-6)) for e, m, s in want]


def test_no_window_takes_the_whole_table_and_no_frame_runs_to_the_end(spark, capsys):
    df = events(spark, [{"username": "a", "message": "x"}])
    apply(D.asof_priv, logs=df).explain()
    assert "UnboundedFollowing" not in (plan := capsys.readouterr().out) and "Window" in plan
    apply(noise.burst, logs=df).explain()
    windows = [x for x in capsys.readouterr().out.splitlines() if " Window [" in x]
    # those that order everything see one row per minute: they read first_key, last_key and runs, not rows of the table
    assert windows and all("slice" in x and "row_id" not in x for x in windows if "[slice" in x.split("], [")[-1] and "noise_key" not in x and x.count("], [") < 2)


@pytest.mark.parametrize("fails,oks,hit", [(2, 3, False), (3, 1, False), (3, 2, True), (3, 5, False), (5, 1, True)])
def test_bruteforce_thresholds(spark, fails, oks, hit):
    rows = [{"action": "login", "status": "failed", "source_ip": "10.0.0.1"}] * fails + [{"action": "login", "status": "success", "source_ip": "10.0.0.1"}] * oks
    got = found(spark, D.bruteforce_by_ip, rows + [{"action": "login", "status": "failed"}] * 9)
    assert bool(got) == hit
    if (fails, oks) == (5, 1):
        assert got == {("10.0.0.1", 9.0, "CRITICAL")}


@pytest.mark.parametrize("text,row,least", [
    (D.dns_amplification, {"program": "dnsmasq", "status": "large_answer", "username": "a"}, 3), (D.dns_nxdomain_flood, {"program": "dnsmasq", "status": "nxdomain", "host": "a"}, 10), (D.dhcp_frequent_release, {"program": "dhcpd", "action": "release", "username": "a"}, 3),
    (D.deny_burst_ip, {"program": "firewall", "status": "blocked", "source_ip": "a"}, 5), (D.policy_evasion, {"program": "firewall", "action": "ALLOW", "dest_port": 22, "source_ip": "a"}, 3), (D.foreign_access, {"source_country": "US", "username": "a"}, 2),
    (D.off_hours, {"timestamp": dt.datetime(2025, 3, 1, 20), "username": "a"}, 3), (D.dns_tunneling, {"program": "dnsmasq", "query_type": "TXT", "domain": "x.tunnel.io", "source_ip": "a"}, 1), (D.suspicious_operations, {"program": "apache", "method": "DELETE", "username": "a"}, 1),
])
def test_count_thresholds(spark, text, row, least):
    assert {x[0] for x in found(spark, text, [row] * least)} == {"a"}
    assert not found(spark, text, [row] * (least - 1) + [{k: v for k, v in row.items() if k not in ("username", "source_ip", "host")}] * 20)


def test_asof_takes_the_first_within_tolerance(spark):
    s = lambda x: T0 + dt.timedelta(seconds=x)
    p = lambda x, proc: {"timestamp": s(x), "win_id": 4688, "username": "a", "message": f'NewProcessName="{proc}" CommandLine="x"'}
    rows = [{"timestamp": s(0), "win_id": 4672, "username": "a"}, p(0, "same"), {"timestamp": s(5), "win_id": 4672, "username": "a"}, p(15, "edge"), p(15, "tie"), {"timestamp": s(20), "win_id": 4672, "username": "a"}, p(30.5, "late"), {"timestamp": s(1), "win_id": 4672, "username": "b"}]
    got = {(r.username, r.row_id): r.proc for r in apply(D.asof_priv, logs=events(spark, rows)).collect()}
    assert got == {("a", 0): "same", ("a", 2): "edge", ("a", 5): None, ("b", 7): None}


def test_interval_is_closed_and_counts_every_activity(spark):
    s = lambda x: T0 + dt.timedelta(seconds=x)
    conf = lambda x, h="r1": {"timestamp": s(x), "program": "router_ios", "host": h, "message": "%SYS-5-CONFIG_I: Configured from vty by eve (10.0.0.1)"}
    down = lambda x: {"timestamp": s(x), "program": "router_ios", "host": "r1", "message": "%BGP-5-ADJCHANGE: neighbor 10.0.0.2 Down"}
    text = bind(D.interval_matches, ev=D.router_events)
    got = sorted((r.row_id, r.activity) for r in apply(lambda d: text(d), logs=events(spark, [conf(0), conf(10), conf(20, "r2"), down(300), down(301), down(311), down(-1)])).collect())
    assert got == [(3, 0), (3, 1), (4, 1)]


def test_sessions_keep_an_exact_gap(spark):
    rows = [{"timestamp": T0 + dt.timedelta(minutes=m), "source_ip": "i", "username": "u"} for m in (0, 15, 30.5, 60)]
    assert sorted(r.session_id for r in apply(series.sessionize, logs=events(spark, rows)).collect()) == ["i-u-0", "i-u-0", "i-u-1", "i-u-2"]


def test_noise_runs_and_critical_rows(spark):
    day = dt.timedelta(days=1)
    opened, closed = "session opened for user x", "session closed for user x"
    at = lambda x, m, **k: {"timestamp": x, "message": m, **k}
    mid = dt.datetime(2025, 3, 1, 23, 59, 59)
    rows = [at(mid, opened), at(mid + dt.timedelta(seconds=2), opened), at(mid + dt.timedelta(seconds=3), closed), at(mid + dt.timedelta(seconds=4), opened), at(mid + day, opened), at(mid, opened, status="failed"), at(mid, "hello")]
    got = sorted((r.row_id, r.noise_key, r.collapsed_count) for r in apply(noise.burst, logs=events(spark, rows)).collect())
    assert got == [(0, "session_opened", 2), (2, "session_closed", 1), (3, "session_opened", 2)]
    full = {r.row_id: r for r in apply(noise.reduce_noise, logs=events(spark, rows)).collect()}
    assert sum(r.collapsed_count for r in full.values()) == len(rows) and full[5].noise_key is None


def test_group_rules_first_match_and_bad_rules(spark):
    got = {r.row_id: r.grp for r in apply(baselines.group_rules, logs=events(spark, [{"source_ip": "10.0.1.9", "username": "user7"}, {"username": "user7"}, {"host": "host2"}, {}])).collect()}
    assert got == {0: "Sales", 1: "Finance", 2: "Engineering", 3: "(unknown)"}


def test_single_rows_have_deviation_zero(spark):
    r = apply(baselines.user_stats, logs=events(spark, [{"username": "a"}, {"username": ""}])).collect()
    assert {(x.username, x.events_std) for x in r} == {("a", 0.0), ("(unknown)", 0.0)}


def test_rollup_caps(spark):
    rows = [("off_hours_access", "a", "odd", 9.0), ("ssh_lateral_movement", "b", "CRITICAL", 9.0), ("x", "c", "INFO", 3.4)]
    got = {r.subject: (r.severity_max, r.score_max) for r in apply(report.subject_rollup, alerts=spark.createDataFrame(rows, "type string, subject string, severity string, score double")).collect()}
    assert got == {"a": ("WARNING", 7.0), "b": ("CRITICAL", 9.0)}


def test_dialect():
    assert doubles("select 1.5, 'v 1.5', a1.2 from t") == "select 1.5e0, 'v 1.5', a1.2 from t"
    assert doubles("count_if(a in ('x)') and (b))") == "count(case when a in ('x)') and (b) then 1 end)"
    assert only_group(r"(a)([(]b)(?:c)\((d)", 3) == r"(?:a)(?:[(]b)(?:c)\((d)"


def test_api_end_to_end(spark, tmp_path):
    lines = [f"Mar  4 06:{i % 60:02d}:46 gate7 sshd[{i}]: {'Failed password' if i % 3 else 'Accepted password'} for amy from 203.0.113.7 port 22" for i in range(40)]
    (tmp_path / "auth.log").write_text("\n".join(lines) + "\n  continued\n")
    logs = api.ingest(spark, str(tmp_path / "auth.log"))
    assert logs.count() == 40 and logs.where("username = 'amy' and action = 'login'").count() == 40
    alerts = api.detect(api.enrich(api.reduce_noise(logs)), stats=api.train_baselines(logs)["user_stats"].limit(0), names=["bruteforce_by_ip", "new_user", "ssh_lateral"])
    assert {r.type for r in alerts.collect()} == {"credential_bruteforce_detected", "new_user", "ssh_lateral_movement"}
    assert {r.subject for r in api.report(alerts)["subjects"].collect()} == {"203.0.113.7", "amy"}
    api.save_baselines(api.train_baselines(logs), str(tmp_path / "b"), "ssh")
    assert api.load_baseline(spark, str(tmp_path / "b"), "user_stats", "ssh").count() == 1 and api.detect(logs, stats=api.load_baseline(spark, str(tmp_path / "b"), "user_stats", "ssh"), names=["new_user"]).count() == 0
    api.export_csv(logs, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "csv")).count() == 40


def test_training_store(spark, tmp_path):
    store, logs = str(tmp_path / "store"), tmp_path / "logs"
    logs.mkdir()
    line = "Mar  4 06:{:02d}:46 gate7 sshd[{}]: Accepted password for {} from 203.0.113.7 port 22"
    (logs / "a.log").write_text("\n".join(line.format(i, i, "amy") for i in range(20)))
    (logs / "b.log").write_text("\n".join(line.format(i, i, "bob") for i in range(20)))
    kind, first = api.train(spark, [str(logs / "a.log"), str(logs / "b.log")], store, rules=[{"match_col": "username", "type": "exact", "match": "amy", "group": "Sales"}])
    assert kind == "linuxsyslog"
    members = {r.grp: r.users for r in api.load_baseline(spark, store, "group_members", kind).collect()}
    assert members == {"Sales": ["amy"], "(unknown)": ["bob"]}
    (logs / "c.log").write_text("\n".join(line.format(i, i, u) for i, u in enumerate(["bob", "bob", "eve", "eve"])))
    _, second = api.train(spark, [str(logs / "c.log")], store, log_type=kind)
    assert second > first
    stats = {r.username: r.events_mean for r in api.load_baseline(spark, store, "user_stats", kind).collect()}
    assert stats == {"amy": 20.0, "bob": 2.0, "eve": 2.0}  # new rows, and old ones whose key is not among them
    state = {r["name"]: r for r in api.store_state(spark, store, kind).collect()}
    assert set(state) == set(api.STORE) and state["user_stats"].snapshots == 2 and state["user_stats"].rows == 3 and state["global_stats"].rows == 1 and len(state["user_stats"].sample) == 3
    assert api.load_baselines(spark, store, "dns") == {} and api.load_baseline(spark, store, "user_stats", "dns") is None
    assert set(api.load_baselines(spark, str(tmp_path / "none"), kind, fallback=store)) == set(api.STORE)
    old = tmp_path / "json"
    old.mkdir()
    (old / "user_stats.json").write_text('[{"username": "zoe", "events_mean": 3.5}]')
    (old / "global_baseline.json").write_text('[{"trained_at": "2025-01-01T00:00:00+00:00", "events_per_hour_mean": 1.0}, {"trained_at": "2025-02-01T00:00:00+00:00", "events_per_hour_mean": 2.0}]')
    assert api.migrate_json(spark, str(old), store, "generic") == ["user_stats", "global_stats"]
    assert api.load_baseline(spark, store, "global_stats", "generic").first().events_per_hour_mean == 2.0
    assert api.load_baseline(spark, store, "user_stats", "generic").first().username == "zoe"


def test_enrich_chain(spark, tmp_path):
    (tmp_path / "leases.csv").write_text("ip,mac,start,end\n10.0.0.1,02:aa,2025-03-01T07:00:00Z,2025-03-01T09:00:00Z\n10.0.0.1,02:bb,2025-03-01T09:00:00Z,2025-03-01T10:00:00Z\n10.0.0.2,02:cc,odd,2025-03-01T09:00:00Z\n")
    logs = events(spark, [{"source_ip": "10.0.0.1", "dest_ip": "203.0.113.9", "username": "amy", "path": "http://bad.test/x", "message": "mail amy@corp.test token=abc"}, {"timestamp": T0 + dt.timedelta(hours=1), "source_ip": "10.0.0.1"}, {"source_ip": "10.0.0.2"}])
    ranges = spark.createDataFrame([(10 << 24, (10 << 24) + 1, "XX")], "lo long, hi long, country string")
    indicators = spark.createDataFrame([("url", "http://bad.test/x"), ("ip", "203.0.113.9")], "kind string, value string")
    assets, people = spark.createDataFrame([("10.0.0.1", "desk")], "ip string, name string"), spark.createDataFrame([("amy", "Legal", "clerk")], "username string, department string, role string")
    out = api.enrich(logs, indicators, assets, people, api.read_leases(spark, str(tmp_path / "leases.csv")), ranges, common_schema=True)
    rows = {r.row_id: r for r in out.collect()}
    assert len(rows) == 3 and [rows[i].source_mac for i in range(3)] == ["02:aa", "02:bb", None] and [rows[i].geo_country for i in range(3)] == ["XX", "XX", None]
    r = rows[0]
    assert (r.indicators, r.matched, r.source_asset, r.department, r.ip_scope, r["user.name"]) == ("ip:dest_ip,url:path", True, "desk", "Legal", "private", "amy")
    assert r.message == "mail [redacted@email] token=***" and api.enrich(logs, mask=False).where("row_id = 0").first().message == "mail amy@corp.test token=abc"


def test_log_type_levels(spark):
    kind = lambda rows, cols=(): api.log_type_of(events(spark, rows), cols)
    assert kind([], ("Destination_IP",)) == "edr" and kind([], ("EventID",)) == "windows_eventlog" and kind([]) is None
    assert kind([{"message": "Sysmon: EventID=3 x"}] * 3) == "edr" and kind([{"message": "Host=a EventID=4"}] * 3) == "windows_eventlog"
    assert kind([{"message": "Sysmon: EventID=3 x", "program": "squid"}] * 2) == "proxy" and kind([{"program": "app", "message": "m"}, {"program": "Dnsmasq[3]", "message": "m"}]) == "dns"
    assert kind([{"program": "sysmon", "message": "SrcIp=1 Image=x"}] * 2) == "edr" and kind([{"program": "sysmon", "message": "m"}]) == "windows_eventlog"
    assert kind([{"message": "GET /x"}] * 2 + [{"message": "m"}] * 5) == "apache" and kind([{"message": "kernel: x"}]) == "linuxsyslog" and kind([{"message": "m"}]) is None


def test_search_over_all_fields(spark):
    subjects = spark.createDataFrame([("amy", "off_hours,port_scan", "WARNING"), ("bob", "new_user", "INFO"), ("eve", "new_user", None)], "subject string, types string, severity_max string")
    analysis = spark.createDataFrame([("amy", "HIGH", "Night work", "theft", "block"), ("bob", "LOW", "fine", "none", "wait")], "subject string, risk_level string, summary string, risks string, actions string")
    alerts = spark.createDataFrame([("eve", "A New Face"), ("eve", "again"), ("bob", None)], "subject string, text string")
    look = lambda *a, **k: {r.subject for r in apply(lambda d: report.client_search(d, *a, **k), subjects=subjects, analysis=analysis, alerts=alerts).collect()}
    assert [look(x) for x in ("AM", "scan", "night", "theft", "wait", "new face", "", "zz")] == [{"amy"}, {"amy"}, {"amy"}, {"amy"}, {"bob"}, {"eve"}, {"amy", "bob", "eve"}, set()]
    assert look("", ("WARNING",)) == {"amy"} and look("", kind="new_user") == {"bob", "eve"} and look("", kind="user") == set() and look("", level="LOW") == {"bob"} and look("", ()) == set()


def test_related_logs_fall_back_to_the_last_rows(spark):
    logs = events(spark, [{"username": "Amy"}, {"dest_ip": "9.9.9.9"}, {"source_ip": "9.9.9.9", "host": "H1"}] + [{"timestamp": T0 + dt.timedelta(seconds=i)} for i in range(1, 120)])
    alerts = spark.createDataFrame([(s,) for s in ("amy", "9.9.9.9", "h1", "nobody")], "subject string")
    got = {}
    for r in apply(report.related_logs, alerts=alerts, logs=logs).collect():
        got.setdefault(r.subject, set()).add(r.row_id)
    assert got == {"amy": {0}, "9.9.9.9": {1, 2}, "h1": {2}, "nobody": set(range(22, 122))}


def test_scores_from_a_file(spark, tmp_path):
    from logloom.functions import scoring

    try:
        (tmp_path / "s.json").write_text('{"severity_thresholds": {"CRITICAL": 7.0}, "attack_type_scores": {"suspicious_operations": 7.2}}')
        scoring.configure(str(tmp_path / "s.json"))
        rows = [{"program": "apache", "method": "DELETE", "username": "a"}]
        assert found(spark, D.suspicious_operations, rows) == {("a", 7.2, "CRITICAL")} and scoring.base("ddos_attack") == 5.0
    finally:
        scoring.configure()
    assert found(spark, D.suspicious_operations, rows) == {("a", 7.5, "WARNING")}


def test_local_time_and_doubled_alerts(spark, tmp_path):
    df = spark.createDataFrame([(dt.datetime(2025, 9, 22, 19, 15),), (dt.datetime(2025, 9, 21, 5, 0),)], "timestamp timestamp")
    assert {r[0] for r in df.select(F.expr(report.local_time(SPARK, "timestamp"))).collect()} == {"02:15 AM, Thứ Ba, 23/09/2025", "12:00 PM, Chủ Nhật, 21/09/2025"}
    logs = events(spark, deny(5) + [{"program": "apache", "method": "DELETE", "username": "a"}])
    names = ["deny_burst_ip", "suspicious_operations"]
    assert api.detect(logs, names=names).count() == 2 and api.detect(logs, names=names, compat_duplicates=True).count() == 3
    api.write_report(api.detect(logs, names=names), str(tmp_path / "r"))
    assert {r.subject for r in api.load_report(spark, str(tmp_path / "r")).collect()} == {"9.9.9.9", "a"}


def test_sinks_post_and_count(spark):
    import http.server
    import json
    import threading

    got = []

    class Receiver(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            got.append(body)
            self.send_response(500 if body.get("text") == "bad" else 200)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Receiver)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    rows = spark.createDataFrame([(f"s{i}", None if i else "x") for i in range(5)], "subject string, more string").coalesce(1)
    assert tuple(sinks.post_results(rows, url, batch=2)) == (5, 0, None)
    assert [len(b["results"]) for b in got] == [2, 2, 1] and got[0]["results"][1] == {"subject": "s1", "more": None}
    sent = sinks.post_texts(spark.createDataFrame([("good",), ("bad",), (None,)], "text string"), url)
    assert (sent.sent, sent.failed) == (1, 1) and "500" in sent.error
    server.shutdown()
    server.server_close()
    assert tuple(sinks.post_results(rows, url))[:2] == (0, 5)
    assert tuple(sinks.post_results(rows.limit(0), url)) == (0, 0, None)


def test_result_payload(spark):
    subjects = spark.createDataFrame([("amy", 3, "a,b", "WARNING", 6.0), ("bob", 1, "c", "INFO", 2.0)], "subject string, alerts long, types string, severity_max string, score_max double")
    told = spark.createDataFrame([("amy", "a", "one", 5.0), ("amy", "b", None, 6.0), ("amy", "a", "two", 1.0), ("bob", "c", "x", 2.0)], "subject string, type string, text string, score double")
    analysis = spark.createDataFrame([("bob", "LOW", "fine", "r1 | r2", "wait")], "subject string, risk_level string, summary string, risks string, actions string")
    got = {r.subject: r for r in apply(report.result_payload, subjects=subjects, told=told, analysis=analysis).collect()}
    assert got["amy"].events == "[b]  | [a] one | +1 more alerts..." and got["amy"].alert_types == "a, b" and got["amy"].risk_level == "Trung bình"
    assert got["bob"].events == "[c] x" and got["bob"].recommendation == "wait" and got["bob"].summary == "fine"


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufefftimestamp;client_ip;user;method;url;http_status;bytes_sent;duration;content_type\n2025-01-01 00:00:00;1.2.3.4;amy;GET;http://e.org/x;200;5;1;t\n")
    row = api.ingest(spark, str(tmp_path / "a.csv")).first()
    assert (row.program, row.source_ip, row.bytes) == ("squid", "1.2.3.4", 5)
    (tmp_path / "a.ndjson").write_text('{"a": {"b": 1}, "message": "m"}\nnot json\n')
    got = readers.read_json(spark, str(tmp_path / "a.ndjson")).collect()
    assert {(r.a_b, r.message) for r in got} == {(1, "m"), (None, "not json")}
    (tmp_path / "l.txt").write_bytes(b"caf\xe9 \x80\r\nzwei")
    assert [r.line for r in readers.read_binary_lines(spark, str(tmp_path / "l.txt")).orderBy("line_no").collect()] == ["café €", "zwei"]
    assert api.ingest(spark, str(tmp_path / "l.txt")).count() == 0 and [r.line for r in readers.unparsed(spark, str(tmp_path / "l.txt")).collect()] == ["café €\nzwei"]


def test_a_folder_of_unlike_files_keeps_every_row(spark, tmp_path):
    ssh = [f"Mar  4 06:{i:02d}:46 gate7 sshd[{i}]: Accepted password for amy from 203.0.113.7 port 22" for i in range(40)]
    win = [f"2025-03-04 18:{i:02d}:40 WinEvent: EventID=4634 Provider=Security SubjectUserName=jos\xe9 IpAddress=172.16.8.27" for i in range(30)]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a b.log").write_text("\n".join([*ssh, "%% no such line"]))
    (tmp_path / "logs" / "win.txt").write_bytes("\n".join(win).encode("cp1252"))
    (tmp_path / "logs" / "one.csv").write_text("timestamp,client_ip,user,method,url,http_status,bytes_sent,duration,content_type\n" + "2025-01-01 00:00:00,1.2.3.4,amy,GET,http://e.org/x,200,5,1,t\n" * 3 + "bad,row\n")
    (tmp_path / "logs" / "two.csv").write_text("timestamp;client_ip;user;method;url;http_status;bytes_sent;duration;content_type\n" + "2025-01-01 00:00:00;1.2.3.5;bob;GET;http://e.org/x;200;5;1;t\n" * 2)
    (tmp_path / "logs" / "long.csv").write_text('keywords,date and time,source,event id,task category,message\nAudit Success,03/04/2025 18:00:00,Security,4624,Logon,"An account\nwas logged on.\nAccount Name: eve"\n')
    (tmp_path / "logs" / "x.ndjson").write_text('{"timestamp": "2025-01-01 00:00:00", "message": "m", "source_ip": "1.2.3.6"}\n' * 2)
    logs = api.ingest(spark, str(tmp_path / "logs"))
    rows = logs.collect()
    assert len(rows) == 40 + 30 + 3 + 2 + 1 + 2 and len({r.row_id for r in rows}) == len(rows)
    assert {r.row_id for r in logs.collect()} == {r.row_id for r in rows}  # the same when read again
    assert {r.username for r in rows if r.program == "winevent"} == {"jos\xe9"}
    assert sum(r.source_ip == "1.2.3.4" for r in rows) == 3 and sum(r.source_ip == "1.2.3.5" for r in rows) == 2
    assert [r.action for r in rows if r.username == "eve"] == ["login"]
    assert [(r.line, r.log_format) for r in readers.unparsed(spark, str(tmp_path / "logs")).collect()] == []  # joined to the record before
    reduced = api.reduce_noise(logs).agg(F.sum("collapsed_count"), F.count_distinct("row_id"), F.count("*")).first()
    assert reduced[0] == len(rows) and reduced[1] == reduced[2]
    assert api.enrich(logs).count() == len(rows)


def test_equal_rows_stay_as_many_as_they_are(spark):
    df = spark.createDataFrame([(T0, "same")] * 3, "timestamp timestamp, message string").coalesce(1)
    logs = schema.event_table(df)
    assert {r.row_id for r in logs.collect()} == {0, 1, 2}
    assert api.reduce_noise(logs).agg(F.sum("collapsed_count")).first()[0] == 3


def test_merge_by_key(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int"), spark.createDataFrame([("b", 5, "x"), (None, 6, "y")], "k string, v int, w string")
    assert sorted((r.k, r.v, r.w or "") for r in api.merge_by_key(old, new, "k").collect()) == [("a", 1, ""), ("b", 5, "x")]


def test_streaming(spark, tmp_path):
    rows = events(spark, [{"program": "firewall", "status": "blocked", "source_ip": "9.9.9.9"}] * 12 + [{"timestamp": T0 + dt.timedelta(hours=1), "status": "blocked", "source_ip": "8.8.8.8"}])
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streaming.deny_bursts(stream).writeStream.outputMode("append").format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.source_ip, r.blocked) for r in spark.table("bursts").collect()] == [("9.9.9.9", 12)]


def test_the_rest_stands_without_the_subpackage(tmp_path):
    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('logloom.llm'): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e, logloom.api\n"
        "assert set(e.queries()) - set(e.oracle_sql()) == {'isolation_forest'} and len(e.oracle_sql()) > 150 and not any(k.startswith('op') for k in e.queries())\n"
    )
    subprocess.run([sys.executable, "-B", "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])


def test_calendars_of_fifty_years(spark):
    """Two rows of 1971 and 2025: statistics and bursts without generated minutes, hours a day at a time."""
    import time

    early = [{"timestamp": dt.datetime(1971, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=i), "bytes": 10} for i in range(12)]
    late = [{"timestamp": dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc), "bytes": 30}] * 9
    logs = events(spark, early + late)
    stats = apply(baselines.global_stats, logs=logs)
    stats.collect()  # compiled
    began = time.monotonic()
    r, found = stats.first(), apply(D.rolling, logs=logs).collect()
    assert time.monotonic() - began < 5
    hours = (dt.datetime(2025, 1, 1) - dt.datetime(1971, 1, 1)).days * 24 + 1
    assert r.events_per_hour_mean == round(21 / hours, 6) and r.max_events_per_hour == 12 and r.upload_bytes_per_hour_p95 == 0 and r.bytes_per_hour_mean == round((120 + 270) / hours, 4)
    mean = 21 / hours
    assert r.events_per_hour_std == pytest.approx(math.sqrt(((12 - mean) ** 2 + (9 - mean) ** 2 + (hours - 2) * mean**2) / (hours - 1)), abs=1e-6)
    assert [(x.epm, x.ma, x.sd) for x in found] == [(9, 0.0, 0.0)]
    assert apply(series.hourly, logs=logs).agg(F.count("*"), F.sum("epm"), F.count_if(F.col("epm") == 0)).first()[:] == (hours, 21, hours - 2)
    assert apply(baselines.global_stats, logs=logs.limit(0)).first()[:] == (None, 0.0, None, 0.0, None, None, None)


def test_literals_of_patterns():
    """Every text that fits a rule holds one of its literals."""
    import random
    import re

    from logloom.functions.patterns import literals

    assert literals(r"sudo.*usermod.*sudo") == ("usermod",) and set(literals(r"(pg_dump|mysqldump)\s+x")) == {"pg_dump", "mysqldump"} and literals(r"a?b*") == ()
    assert literals(r"[a-z]+=\d") == () and literals(r"(?:abcd)?xyz") == ("xyz",)
    rng = random.Random(1)
    rules = D.PRIVILEGE + D.DATABASE + D.DATABASE_USE + D.SERVICES + D.PERSISTENCE
    parts = [w for _, p, _ in rules for w in re.findall(r"[A-Za-z_/.:*|-]+", p)] + [" ", "  ", "-", "x", "\n", "|", "https://h", "TO", "s", "u+s"]
    hits = 0
    for _ in range(30000):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        for _, p, _ in rules:
            if re.search("(?i)" + p, text):
                hits += 1
                some = literals(p)
                assert not some or any(x in text.lower() for x in some), (p, text)
    assert hits > 1000 and sum(bool(literals(p)) for _, p, _ in rules) > 0.8 * len(rules)
