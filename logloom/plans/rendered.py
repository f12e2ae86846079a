"""Lines of each format rendered from the log table, for checking the parsers."""

from __future__ import annotations

from .dialect import Dialect, Text

U = "coalesce(username, '-')"


def s(x: str) -> str:
    return f"cast({x} as string)"


def pick(*options: str) -> str:
    """One of some texts, by line number."""
    body = " ".join(f"when {i} then {o}" for i, o in enumerate(options))
    return f"case row_id % {len(options)} {body} end"


def bodies(d: Dialect) -> dict[str, str]:
    rfc, iso = d.format("timestamp", "%b %d %H:%M:%S"), d.format("timestamp", "%Y-%m-%d %H:%M:%S")
    clf = d.format("timestamp", "%d/%b/%Y:%H:%M:%S")
    rest = f"""'] "' || method || ' ' || path || ' HTTP/1.1" ' || {s("coalesce(http_status, 204)")} || ' ' || {s("bytes")} || ' "-" "' || user_agent || {pick("''", "' Attack/sqli'", "''")} || '" vhost=' || dst_host"""
    ends = f"' src=' || source_ip || ' dst=' || dest_ip"
    ports = f"' src=' || source_ip || ':' || {s('1024 + n')} || ' dst=' || dest_ip || ':' || {s('dest_port')}"
    return {
        "suricata_fast": f"""{d.format("timestamp", "%m/%d/%Y")} || '-' || {d.format("timestamp", "%H:%M:%S")} || '.255000  [**] [1:' || {s("1000 + n")} || ':1] ET RULE [**] [Classification: ' || {pick("'Attempted Information Leak'", "'Policy Violation'", "'Malware Command'", "'Misc activity'")} || '] [Priority: ' || {s("n % 4")} || '] {{TCP}} ' || source_ip || ':' || {s("1024 + n")} || ' -> ' || dest_ip || ':' || {s("dest_port")}""",
        "suricata_simple": f"""{iso} || ' SURICATA ' || {pick("'ALERT'", "'INFO'")} || ': signature="ET ' || {s("n % 5")} || ' x" severity=High' || {ends} || ' proto=tcp'""",
        "zeek_dns": f"""{d.format("timestamp", "%d-%b-%Y")} || ' ' || {d.format("timestamp", "%H:%M:%S")} || '.255 client @0x42 ' || source_ip || '#' || {s("1024 + n")} || ' (' || domain || '): query: ' || domain || ' IN ' || query_type || ' ' || {pick("'+'", "'+E'", "'-'")} || ' (192.168.1.53)'""",
        "apache": f"{rfc} || ' ' || host || ' httpd[7]: ' || source_ip || ' - ' || {U} || ' [' || {clf} || ' +0000' || {rest} || {pick("''", "' attack=xss'")}",
        "apache_combined": f"source_ip || ' - ' || {U} || ' [' || {clf} || ' +0000' || {rest} || ' host=' || host",
        "squid": f"{s(f'cast(floor({d.micros('timestamp')} / 1000000) as bigint)')} || '.123 ' || {s('n')} || ' ' || source_ip || ' ' || {pick("'TCP_MISS'", "'TCP_HIT'", "'TCP_DENIED'", "'TCP_TUNNEL'")} || '/200 ' || {s('bytes')} || ' ' || method || ' ' || {pick("'http://a.example.org:81'", "'https://b.example.net'", "'c.example.com:443'")} || path || ' ' || {U} || ' DIRECT/' || {pick("dest_ip", "'-'")} || ' text/html'",
        "modsecurity": f"""{iso} || ' ModSecurity: Warning. Pattern match [msg "SQL ' || {s("n % 4")} || '"] [uri "' || path || '"] [client ' || source_ip || ']' || {pick("''", "' [id \"' || " + s("942100 + n") + " || '\"]'")}""",
        "vpcflow": f"{iso} || ' aws:vpcflow' || {ends} || ' dport=' || {s('dest_port')} || ' protocol=6 action=' || {pick("'ACCEPT'", "'REJECT'")} || ' bytes=' || {s('bytes')}",
        "netflow": f"{iso} || ' NETFLOW' || {ports} || ' proto=tcp bytes=' || {s('bytes')} || ' pkts=' || {s('n')} || ' action=' || {pick("'permit'", "'Deny'", "'ALLOW'")}",
        "sysmon": f"{iso} || ' Sysmon: EventID=' || {pick("'3'", "'1'", "'x'")} || ' User=' || {U} || {pick("' Device=' || device", "''")} || ' SrcIp=' || source_ip || ' DestinationIp=' || dest_ip || ' DestinationPort=' || {s('dest_port')} || ' Protocol=tcp Image=' || image",
        "router_ios": f"{rfc} || ' ' || host || ' ios[5]: ' || {pick("'%SEC_LOGIN-5-LOGIN_SUCCESS: Login Success [user:' || " + U + " || '] [Source:' || source_ip || '] device=' || device", "'%SYS-5-CONFIG_I: Configured from vty by ' || " + U + " || ' (' || source_ip || ') using device ' || device", "'%BGP-5-ADJCHANGE: neighbor 10.0.0.1 Down'", "'%LINK-3-UPDOWN: Interface Gi0/1, changed state to up'", "'%NAT-6-MAP: portmap'", "'User logout from ' || source_ip", "'Something else'")}",
        "sysmon_network": f"{iso} || ' Sysmon: EventID=3 Image=' || image || ' DestinationIp=' || dest_ip || ' DestinationPort=' || {s('dest_port')} || ' Protocol=udp'",
        "winevent_structured": f"""{iso} || ' Host=' || host || ' Channel=Security EventID=' || {s("coalesce(win_id, 4625)")} || ' Level=' || {pick("'Info'", "'Warning'")} || ' User=' || {U} || ' SrcIp=' || source_ip || ' TargetImage="c:/lsass.exe" CommandLine="whoami /all"'""",
        "winevent": f"""{iso} || ' WinEvent: EventID=' || {s("coalesce(win_id, 1102)")} || ' Provider=Security SubjectUserName=' || {U} || ' IpAddress=' || source_ip || {pick("''", "' Device=' || device")} || ' NewProcessName="cmd.exe"'""",
        "openssh": f"{rfc} || ' ' || host || ' sshd[' || {s('n')} || ']: ' || {pick("'Accepted publickey for ' || " + U + " || ' from ' || source_ip || ' port 22'", "'Failed password for ' || " + U + " || ' from ' || source_ip", "'Disconnected from user x'", "'Connection closed by ' || source_ip", "'Server listening'")}",
        "firewall_kv": f"""{rfc} || ' ' || host || ' firewall[9]: action=' || {pick("'ALLOW'", "'DENY'", "'Reject'", "'odd'")} || ' user=' || {U} || ' device=' || device || ' src=' || source_ip || ' sport=' || {s("n")} || ' dst=' || dest_ip || ' dst_host=' || dst_host || ' dport=' || {s("dest_port")} || ' proto=TCP bytes=' || {s("bytes")} || ' rule="a b"'""",
        "firewall_iptables": f"{rfc} || ' ' || host || ' kernel: [12.5] ' || {pick("'ACCEPT '", "'DROP '", "'REJECT '", "''")} || 'IN=eth0 SRC=' || source_ip || ' DST=' || dest_ip",
        "dhcp": f"{rfc} || ' ' || {pick("host || ' '", "''")} || 'dhcpd[3]: DHCP' || {pick("'DISCOVER'", "'OFFER'", "'REQUEST'", "'ACK'", "'RELEASE'", "'INFORM'", "'NAK'")} || ' on ' || source_ip || ' to ' || mac_address || ' (' || {pick("device", "'pc'")} || ') via ' || interface || {pick("''", "' user=' || " + U)}",
        "bind": f"{rfc} || ' ' || host || ' named[4]: ' || {pick("'client ' || source_ip || '#53 (' || domain || '): query: ' || domain || ' A IN + rcode=NOERROR (user=' || " + U + " || ' device=' || device || ')'", "'client ' || source_ip || '#53: query: ' || domain || ' IN A rcode=NXDOMAIN'", "'lame server resolving x'", "'zone loaded'")}",
        "dnsmasq": f"{rfc} || ' ' || host || ' dnsmasq[8]: ' || {pick("'query[' || query_type || '] ' || domain || ' from ' || source_ip", "'forwarded ' || domain || ' to 8.8.8.8'", "'reply ' || domain || ' is LARGE_ANSWER'", "'reply ' || domain || ' is NXDOMAIN'", "'reply ' || domain || ' is 10.0.0.1'", "'refused'", "'started'")}",
        "linux": f"{rfc} || ' ' || host || ' ' || {pick("'kernel'", "'systemd'", "'network'")} || ': ' || {pick("'eth0: Link up'", "'eth0: link down'", "'DHCP lease ' || source_ip", "'other'")}",
        "config_change": f"{iso} || ' configd: core.' || host || ' configuration ' || {pick("'updated'", "'rolled back'", "'applied'")} || ' by ' || {U} || ' change_id=' || {s('n')}",
        "syslog_iso": f"{iso} || ' ' || host || ' ' || {pick("'sshd[1]'", "'app'")} || ': ' || {pick("'Accepted password for invalid user bob from ' || source_ip", "'Failed password for ' || " + U + " || ' from ' || source_ip", "'note'")}",
        "auth_daemon": f"{rfc} || ' ' || host || ' radiusd: ' || {pick("'Accepted password'", "'Failed password'", "'PAM authentication failure'", "'RADIUS Access-Accept'", "'radius access-reject'", "'TACACS+ authentication OK'", "'TACACS+ authentication FAIL'", "'unknown'")} || ' for ' || {U} || ' from ' || source_ip",
        "syslog": f"{rfc} || ' ' || host || ' ' || {pick("'sshd[1]: Accepted password for ' || " + U + " || ' from ' || source_ip", "'sshd[1]: Failed password for ' || " + U + " || ' from ' || source_ip", "'sudo: ' || " + U + " || ' : TTY=pts/0 ; COMMAND=/bin/ls'", "'sudo: pam_unix(sudo:session): session opened for user root by ' || coalesce(username, 'x') || '(uid=1)'", "'sudo: session closed for user root'", "'CRON[2]: CRON (' || coalesce(username, 'x') || ') CMD (/opt/r.sh)'", "'app: hello'")}",
        "keyvalue": f"{iso} || ' fw01 action=' || {pick("'ALLOW'", "'DENY'", "'established'")} || ' status=' || {pick("'x'", "'ok'")} || ' proto=UDP' || {ports} || ' user=' || {U}",
    }


def lines(name: str) -> Text:
    return lambda d: f"select row_id as line_no, {bodies(d)[name]} as line from @logs"


def stream(d: Dialect) -> str:
    """Files with continuation lines: two of three lines begin a record; seven files at a time, new ones after 1000 lines each, in splits of 100 lines."""
    rfc = d.format("timestamp", "%b %d %H:%M:%S")
    return f"select 'f' || cast(row_id % 7 as string) || '.' || cast(cast(floor(row_id / 7000) as bigint) as string) as file, cast(floor(row_id / 700) as bigint) as split, row_id as line_no, case when row_id % 3 = 2 then '  at frame ' || cast(n as string) else {rfc} || ' ' || host || ' app: start' end as line from @logs"
