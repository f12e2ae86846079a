"""Quality profile, level upgrades, subject roll-up, caps, summaries, export."""

from __future__ import annotations

from ..functions import ip as ipf
from ..functions import scoring as S
from ..plans.dialect import Dialect
from .detectors import n

# Words of critical and of warning lines.
CRITICAL_WORDS = "kernel panic|panic:|segfault|oops|oom-killer|out of memory"
WARNING_WORDS = "error|failed|timeout|retry|throttle|denied"
LOG_CRITICAL, LOG_WARNING = "critical|error|failed|denied|blocked", "warning|retry|timeout|throttle"
# Alert types that are exempt from the cap, and patterns of high risk.
EXEMPT = """lsass_credential_dumping_detected windows_privilege_escalation_detected schtask_persistence_detected service_persistence_detected data_exfiltration_detected
organized_attack_chain persistence_technique_detected privilege_escalation_detected sensitive_db_access_detected service_manipulation_detected credential_bruteforce_detected
ssh_lateral_movement cron_job_overlap firewall_deny_burst firewall_port_scan firewall_exfiltration edr_suspicious_network_activity edr_data_exfiltration_detected
edr_lateral_movement_detected edr_port_scan_detected edr_rdp_bruteforce_detected edr_lolbins_outbound_detected edr_network_spike dns_amplification dns_nxdomain_storm dns_tunneling""".split()
HIGH_RISK = "config_tampering|_correlated|PRIMARY_SUSPECT"
MIN_SCORE, CAP = 3.5, 7.0


def quality_profile(d: Dialect) -> str:
    cols = ("source_ip", "username", "action", "status", "message")
    nulls = ", ".join(f"{n(f'count_if({c} is null)')} as null_{c}" for c in cols)
    return f"select {n('count(*)')} as rows, {n('count_if(timestamp is null)')} as bad_timestamps, {nulls}, {d.micros('min(timestamp)')} as first_us, {d.micros('max(timestamp)')} as last_us from @logs"


def heuristic_level(d: Dialect) -> str:
    low = "lower(coalesce(message, ''))"
    return f"select row_id, case when {d.has(low, CRITICAL_WORDS)} then 'CRITICAL' when {d.has(low, WARNING_WORDS)} then 'WARNING' else 'INFO' end as level from @logs"


def upgrades(d: Dialect) -> str:
    """Levels raised by bursts of failures of an address and by a success after a failure from outside.

    A failed row rises when its address has a minute of three failures (of five:
    to critical) by one user; a success from outside rises when the same address
    and user failed in the two minutes before, the same instant not counted.
    """
    failed = "lower(status) = 'failed'"
    burst = f"""select source_ip, max(c) as fails from (select source_ip, username, {d.minute('timestamp')} as m, count(*) as c
      from @logs where {failed} and source_ip is not null and username is not null
      group by 1, 2, 3) as b group by source_ip"""
    us = d.micros("timestamp")
    recent = f"select row_id, count_if({failed}) over (partition by source_ip, username order by us range between 120000000 preceding and 1 preceding) as k from (select *, {us} as us from @logs) as t"
    late = f"lower(l.status) = 'success' and not {ipf.private_strict(d, 'l.source_ip')} and r.k > 0 and l.username is not null and l.source_ip is not null"
    level = f"case when {late} then 'CRITICAL' when lower(l.status) = 'failed' and b.fails >= 5 then 'CRITICAL' when lower(l.status) = 'failed' and b.fails >= 3 and h.level = 'INFO' then 'WARNING' else h.level end"
    why = f"""case when {late} then 'success_after_failed_public_ip' when lower(l.status) = 'failed' and b.fails >= 5 and h.level <> 'CRITICAL' then 'burst_failed>=5'
      when lower(l.status) = 'failed' and b.fails >= 3 and h.level = 'INFO' then 'burst_failed>=3'
      else '' end"""
    return f"""select l.row_id, {level} as level, {why} as reason from @logs as l join ({heuristic_level(d)}) as h on h.row_id = l.row_id
      join ({recent}) as r on r.row_id = l.row_id left join ({burst}) as b on b.source_ip = l.source_ip"""


def kept(d: Dialect) -> str:
    """Alerts of enough score, with severities repaired."""
    return f"select type, subject, {S.repaired('severity', 'score')} as severity, score from @alerts where score >= {MIN_SCORE}"


def subject_rollup(d: Dialect) -> str:
    """A row per subject; scores without a high-risk or exempt type are capped at 7, WARNING."""
    rank = "max(case severity when 'CRITICAL' then 2 when 'WARNING' then 1 else 0 end)"
    free = f"max(case when {d.has('type', HIGH_RISK)} or type in ({', '.join(repr(t) for t in EXEMPT)}) then 1 else 0 end)"
    inner = f"select subject, count(*) as c, {d.joined('type')} as types, {rank} as rk, max(score) as top, {free} as free from ({kept(d)}) as k group by subject"
    return f"""select subject, {n('c')} as alerts, types, case least(rk, 1 + free) when 2 then 'CRITICAL'
      when 1 then 'WARNING' else 'INFO' end as severity_max, case when free = 1 then top
      else least(top, {CAP}) end as score_max from ({inner}) as g"""


def summary(d: Dialect) -> str:
    return f"""select 'severity' as part, severity as name, {n('count(*)')} as alerts
      from ({kept(d)}) as k group by severity union all select 'type', type, {n('count(*)')}
      from ({kept(d)}) as k group by type union all select 'total', 'total', {n('count(*)')}
      from ({kept(d)}) as k union all select 'subjects', subject, {n('1')} from (select distinct subject
      from ({kept(d)}) as k order by subject limit 10) as s"""


def rendered_lines(d: Dialect) -> str:
    """A log line: the fields that are there, joined by dashes."""
    text = "concat_ws(' - ', " + ", ".join(["cast(" + d.micros("timestamp") + " as string)", "nullif(host, '')", "nullif(username, '')", "nullif(source_ip, '')", "nullif(action, '')", "nullif(status, '')", "nullif(message, '')"]) + ")"
    return f"select row_id, {text} as line from @logs"


def keyword_counts(d: Dialect) -> str:
    low = "lower(line)"
    return f"select {n(f'count_if({d.has(low, LOG_CRITICAL)})')} as critical, {n(f'count_if({d.has(low, LOG_WARNING)})')} as warning, {n('count(*)')} as lines from ({rendered_lines(d)}) as l"


def _related_by_key(limit: int) -> str:
    """Spark's text of ``related_logs``."""
    recent = "order by timestamp desc, row_id desc"
    # a row whose two addresses are the same is one row of that address
    same = [(0, "lower(username)"), (1, "source_ip"), (1, "case when dest_ip = source_ip then null else dest_ip end"), (2, "lower(host)")]
    newest = " union all ".join(f"select row_id, timestamp, {prio} as prio, key from (select *, row_number() over (partition by key {recent}) as rk from (select row_id, timestamp, {k} as key from @logs) as l where key is not null) as r where rk <= {limit}" for prio, k in same)
    subjects = "select subject, explode(array(struct(0 as prio, lower(subject) as key), struct(1 as prio, subject as key), struct(2 as prio, lower(subject) as key))) as k from (select distinct subject from @alerts) as s"
    hit = f"select s.subject, l.row_id, l.timestamp, l.prio from ({subjects}) as s left join ({newest}) as l on l.prio = s.k.prio and l.key = s.k.key"
    best = f"select *, min(prio) over (partition by subject) as own from ({hit}) as h"
    found = f"select subject, row_id from (select subject, row_id, row_number() over (partition by subject {recent}) as rk from ({best}) as b where prio = own) as r where rk <= {limit}"
    last = f"select row_id from @logs {recent} limit {limit}"
    alone = f"select subject from ({hit}) as h group by subject having max(prio) is null"
    return f"{found} union all select alone.subject, recent.row_id from ({alone}) as alone cross join ({last}) as recent"


def related_logs(d: Dialect, limit: int = 100) -> str:
    """The last rows of each subject: by user, else by either address, else by host, else the last rows of all.

    Users and hosts are compared in lower case.  In Spark the last rows of each user,
    address and host are found first, which tasks do before rows are shuffled; only
    these meet the subjects, so no task takes up all rows of a subject.
    """
    if d.name != "duck":
        return _related_by_key(limit)
    same = [("lower(l.username)", "lower(a.subject)"), ("l.source_ip", "a.subject"), ("l.dest_ip", "a.subject"), ("lower(l.host)", "lower(a.subject)")]
    subjects = "select distinct subject from @alerts"
    hit = " union ".join(f"select a.subject, l.row_id, l.timestamp, {prio} as prio from ({subjects}) as a join @logs as l on {c} = {k}" for prio, (c, k) in zip((0, 1, 1, 2), same))
    best = f"select *, min(prio) over (partition by subject) as own from ({hit}) as h"
    ranked = f"select subject, row_id, row_number() over (partition by subject order by timestamp desc, row_id desc) as rk from ({best}) as b where prio = own"
    found = f"select subject, row_id from ({ranked}) as r where rk <= {limit}"
    # at most ``limit`` rows for each subject that nothing fits
    last = f"select row_id from @logs order by timestamp desc, row_id desc limit {limit}"
    alone = f"select s.subject from ({subjects}) as s left join (select distinct subject from ({hit}) as h) as f on f.subject = s.subject where f.subject is null"
    return f"{found} union all select alone.subject, recent.row_id from ({alone}) as alone cross join ({last}) as recent"


def export_rows(d: Dialect) -> str:
    """Rows numbered from 1 by time.  Numbers come from counts per day and a window within the day."""
    day = "date_trunc('day', timestamp)"
    before = f"select {day} as day, sum(count(*)) over (order by {day} rows between unbounded preceding and 1 preceding) as before from @logs group by {day}"
    return f"""select cast(coalesce(before, 0) + row_number() over (partition by {day}
      order by timestamp, row_id) as bigint) as log_index, row_id, {d.micros('timestamp')} as us, username, source_ip, action, status, message
      from @logs as l join ({before}) as b on b.day = {day}"""


def webhook_payload(d: Dialect) -> str:
    """One payload per subject: the first two alerts by score and how many more."""
    ranked = f"select *, row_number() over (partition by subject order by score desc, type) as rk, count(*) over (partition by subject) as c from (select distinct type, subject, score from ({kept(d)}) as k) as x"
    return f"""select subject, max(case when rk = 1 then type end) as first_type, max(case
      when rk = 2 then type end) as second_type, case when max(c) > 2 then '+' || cast(max(c) - 2 as string) || ' more'
      else '' end as more from ({ranked}) as r group by subject"""


def result_payload(d: Dialect) -> str:
    """What a receiver of results gets per subject of @subjects: alert types and count, severity, score, two
    events of @told (subject, type, text, score) with how many more there are, and the
    analysis of @analysis (subject, risk_level, summary, risks, actions), with defaults.
    """
    ranked = "select *, row_number() over (partition by subject order by score desc, type, text) as rk, count(*) over (partition by subject) as c from @told"
    line = "'[' || type || '] ' || coalesce(text, '')"
    events = f"select subject, max(case when rk = 1 then {line} end) as first_event, max(case when rk = 2 then {line} end) as second_event, case when max(c) > 2 then '+' || cast(max(c) - 2 as string) || ' more alerts...' end as more from ({ranked}) as r group by subject"
    # What stands for a missing level and summary.
    return f"""select s.subject, replace(s.types, ',', ', ') as alert_types, s.alerts as alert_count, coalesce(a.risk_level, 'Trung bình') as risk_level, s.severity_max as severity, s.score_max as score,
      concat_ws(' | ', e.first_event, e.second_event, e.more) as events, coalesce(a.summary, 'Không có tóm tắt') as summary, coalesce(a.risks, '') as risk_analysis, coalesce(a.actions, '') as recommendation
      from @subjects as s left join ({events}) as e on e.subject = s.subject left join @analysis as a on a.subject = s.subject"""


def log_type(d: Dialect) -> str:
    """The class of each program name; the first key that it contains."""
    # Keys in the order in which they are looked for.
    keys = [("firewall", "firewall"), ("router_ios", "router"), ("named", "dns"), ("winevent", "windows_eventlog"), ("security", "windows_eventlog"), ("system",
        "windows_eventlog"), ("sysmon", "windows_eventlog"), ("dhcpd", "dhcp"), ("apache", "apache"), ("squid", "proxy"), ("suricata", "ids"), ("edr_network",
        "edrnetwork"), ("edr_sysmon", "edr"), ("syslog", "syslog"), ("sshd", "linuxsyslog"), ("sudo", "linuxsyslog"), ("cron", "linuxsyslog"), ("kernel", "linuxsyslog"),
        ("systemd", "linuxsyslog"), ("auth", "linuxsyslog")]
    case = " ".join(f"when contains(lower(program), '{k}') then '{v}'" for k, v in keys)
    return f"select program, case {case} else 'generic' end as log_type, {n('count(*)')} as rows from @logs where program is not null group by program"


def client_filter(d: Dialect, severities: tuple[str, ...] = ("CRITICAL", "WARNING"), text: str = "user1") -> str:
    """Alerts by severity set and by a text in type or subject."""
    low = text.lower()
    return f"select type, subject, severity, score from ({kept(d)}) as k where severity in ({', '.join(repr(s) for s in severities)}) and (contains(lower(type), '{low}') or contains(lower(subject), '{low}'))"


def client_search(d: Dialect, text: str, severities: tuple[str, ...] = ("CRITICAL", "WARNING", "INFO"), kind: str | None = None, level: str | None = None) -> str:
    """Subjects of @subjects (subject, types, severity_max) that pass all filters: an alert type, the
    analysis's risk level, severities, and a text in the subject, its types, the analysis's
    summary, risks or actions (@analysis: subject, risk_level, summary, risks, actions) or
    an alert's text (@alerts: subject, text).
    """
    low = d.text(text.strip().lower())
    fields = ("s.subject", "s.types", "a.summary", "a.risks", "a.actions")
    within = " or ".join(f"contains(lower(coalesce({f}, '')), {low})" for f in fields)
    wanted = [f"coalesce(upper(s.severity_max), 'INFO') in ({', '.join(d.text(x) for x in severities)})"] if severities else ["false"]
    if kind:
        wanted.append(f"contains(',' || s.types || ',', {d.text(',' + kind + ',')})")
    if level:
        wanted.append(f"a.risk_level = {d.text(level)}")
    if text.strip():
        wanted.append(f"({within} or t.subject is not null)")
    hits = f"select distinct subject from @alerts where contains(lower(coalesce(text, '')), {low})"
    return f"select s.subject, s.types, s.severity_max, a.risk_level from @subjects as s left join @analysis as a on a.subject = s.subject left join ({hits}) as t on t.subject = s.subject where {' and '.join(wanted)}"


def local_time(d: Dialect, ts: str) -> str:
    """An instant in UTC+7 as a reader there writes it: ``02:15 AM, Thứ Ba, 23/09/2025``."""
    local = d.plus(ts, 7, "hour")
    # The days of the week from Monday.
    days = ["Thứ Hai", "Thứ Ba", "Thứ Tư", "Thứ Năm", "Thứ Sáu", "Thứ Bảy", "Chủ Nhật"]
    number = f"extract(dayofweek_iso from {local})" if d.name == "spark" else f"isodow({local})"
    day = "case " + number + " " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(days, 1)) + " end"
    clock = f"case when hour({local}) % 12 = 0 then '12' else lpad(cast(hour({local}) % 12 as string), 2, '0') end || ':' || {d.format(local, '%M')} || case when hour({local}) < 12 then ' AM' else ' PM' end"
    return f"{clock} || ', ' || {day} || ', ' || {d.format(local, '%d/%m/%Y')}"


def prompts(d: Dialect) -> str:
    """A text for an analyst or a model per subject: its alerts by falling score."""
    line = "'- ' || type || ' (' || severity || ')'"
    distinct = f"select distinct subject, type, severity, cast(round(10 * score) as bigint) as tenth from ({kept(d)}) as k"
    order = "array_join(transform(array_sort(collect_list(struct(-tenth as o, type as t, " + line + " as x))), y -> y.x), '; ')" if d.name == "spark" else f"string_agg({line}, '; ' order by -tenth, type, {line})"
    return f"select subject, 'Subject ' || subject || ' has ' || cast(count(*) as string) || ' kinds of alerts: ' || {order} as prompt from ({distinct}) as a group by subject"


ANSWER = "Answer in JSON with summary, risks (list), risk_level (low, medium, high or critical) and actions (list)."
CONTEXT = 50  #: log lines that a subject's prompt shows


def alert_prompts(d: Dialect) -> str:
    """A text per distinct kept alert."""
    tenth = "cast(round(10 * score) as bigint)"
    points = f"cast(cast(floor({tenth} / 10.0) as bigint) as string) || '.' || cast({tenth} % 10 as string)"
    text = f"'Assess an alert of a security monitor. Severity: ' || severity || '. Subject: ' || subject || '. Kind: ' || type || '. Score: ' || {points} || '. {ANSWER}'"
    return f"select distinct type, subject, {text} as prompt from ({kept(d)}) as k where subject is not null"


def subject_prompts(d: Dialect) -> str:
    """The text of ``prompts`` with how many log lines belong to the subject, and the last CONTEXT of them in order of time."""
    rows = f"""select r.subject, l.row_id, l.timestamp, t.line, row_number() over (partition by r.subject order by l.timestamp desc, l.row_id desc) as rk
      from ({related_logs(d)}) as r join @logs as l on l.row_id = r.row_id join ({rendered_lines(d)}) as t on t.row_id = r.row_id"""
    shown = f"case when rk <= {CONTEXT} then line end"
    lines = f"array_join(transform(array_sort(collect_list(case when rk <= {CONTEXT} then struct(timestamp, row_id, line) end)), x -> x.line), '\\n')" if d.name == "spark" else f"string_agg({shown}, chr(10) order by timestamp, row_id)"
    found = f"select subject, count(*) as c, {lines} as lines from ({rows}) as x group by subject"
    newline = "'\\n'" if d.name == "spark" else "chr(10)"
    return f"""select p.subject, p.prompt || '. {ANSWER}' || coalesce({newline} || 'Log lines (' || cast(f.c as string) || '):' || {newline} || f.lines, '') as prompt
      from ({prompts(d)}) as p left join ({found}) as f on f.subject = p.subject"""


def offline_analysis(d: Dialect) -> str:
    """What is said of each subject where no model can be asked."""
    return f"""select distinct subject, 'No model could be asked; keep watching.' as summary, 'no assessment by a model' as risks, 'medium' as risk_level, 'keep watching' as actions, false as used_model
      from ({kept(d)}) as k where subject is not null"""


# Program names and the class that they stand for, in the order in which they are looked for.
PROGRAM_CLASSES = [
    ("firewall", "firewall"), ("router_ios", "router"), ("named", "dns"), ("dnsmasq", "dns"), ("winevent", "windows_eventlog"), ("security", "windows_eventlog"), ("system", "windows_eventlog"), ("sysmon", "windows_eventlog"),
    ("dhcpd", "dhcp"), ("apache", "apache"), ("httpd", "apache"), ("squid", "proxy"), ("suricata", "ids"), ("edr_network", "edrnetwork"), ("edr_sysmon", "edr"), ("syslog", "syslog"),
    ("sshd", "linuxsyslog"), ("sudo", "linuxsyslog"), ("cron", "linuxsyslog"), ("kernel", "linuxsyslog"), ("systemd", "linuxsyslog"), ("auth", "linuxsyslog"),
]


def table_class(d: Dialect, columns: tuple[str, ...] = ()) -> str:
    """One row, the class of a whole table: by telling columns of its file (``columns``), else by its first
    messages, else by program names (endpoint or Windows by the messages where they say
    sysmon), else by words in the first messages; null if nothing tells.
    """
    have = {c.lower() for c in columns}
    if have & {"destination_ip", "destination_port"}:
        return "select 'edr' as log_class"
    if have & {"channel", "eventid"}:
        return "select 'windows_eventlog' as log_class"
    m = "message"
    head = lambda k: f"select message from @logs where message is not null order by timestamp, row_id limit {k}"
    flags = {
        "edr": d.has(m, "Sysmon: EventID=|^\\s*Sysmon:"), "windows": f"({d.has(m, 'Channel=|EventID=|TargetFilename=')} and (contains({m}, 'Host=') or not contains({m}, 'Image=')))",
        "syslog": d.has(m, r"sshd\[|sudo\[|cron\[|kernel:|systemd\["), "firewall": d.has(m, "(?i)action=|proto="), "web": d.has(m, "GET |POST |HTTP/"),
    }
    fifty = f"select count(*) as k, {', '.join(f'count_if({c}) as {n_}' for n_, c in flags.items())} from ({head(50)}) as h"
    ends = f"select count_if((contains({m}, 'DestinationIp=') or contains({m}, 'SrcIp=')) and contains({m}, 'Image=')) as e, count_if(contains({m}, 'Host=') or contains({m}, 'Channel=')) as w from ({head(30)}) as h"
    rank = "case " + " ".join(f"when contains(lower(program), '{k}') then {i}" for i, (k, _) in enumerate(PROGRAM_CLASSES)) + " end"
    # of several programs the first by name that says anything
    programs = f"""select min_by({rank}, lower(program)) as rk, max(case when lower(program) = 'sysmon' then 1
      else 0 end) as sys from (select distinct program from @logs where program is not null) as p
      where {rank} is not null"""
    by_program = "case p.rk " + " ".join(f"when {i} then '{v}'" for i, (_, v) in enumerate(PROGRAM_CLASSES)) + " end"
    some = "greatest(3, floor(f.k / 4.0))"
    return f"""select case when f.edr >= {some} then 'edr' when f.windows >= {some} then 'windows_eventlog'
      when p.sys = 1 and s.e > s.w and s.e > 0 then 'edr' when p.sys = 1 and s.w > s.e and s.w > 0 then 'windows_eventlog'
      when p.rk is not null then {by_program}
      when f.syslog > f.k / 4.0 then 'linuxsyslog' when f.firewall > f.k / 4.0 then 'firewall' when f.web > f.k / 4.0 then 'apache' end as log_class
      from ({fifty}) as f cross join ({ends}) as s cross join ({programs}) as p"""


def log_class(d: Dialect) -> str:
    """The class of a file from its first fifty messages, before its program names are asked.

    A quarter of them (three at least) must fit; endpoint lines before Windows
    lines before system, firewall and web lines.
    """
    m = "coalesce(message, '')"
    flags = {
        "edr": f"({d.has(m, 'Sysmon: EventID=|^[ ]*Sysmon:')} or ({d.has(m, 'DestinationIp=|SrcIp=')} and contains({m}, 'Image=')))",
        "windows_eventlog": f"({d.has(m, 'Channel=|EventID=|TargetFilename=')} and (contains({m}, 'Host=') or not contains({m}, 'Image=')))",
        "linuxsyslog": d.has(m, r"sshd\[|sudo\[|cron\[|kernel:|systemd\["), "firewall": d.has(m, "(?i)action=|proto="), "apache": d.has(m, "GET |POST |HTTP/"),
    }
    counts = ", ".join(f"count_if({c}) as c{i}" for i, c in enumerate(flags.values()))
    pick = " ".join(f"when c{i} >= greatest(3, floor(k / 4.0)) then '{name}'" for i, name in enumerate(flags))
    head = "select program, message, row_number() over (partition by program order by timestamp, row_id) as rk from @logs where message is not null"
    return f"select program, case {pick} else 'generic' end as log_class from (select program, count(*) as k, {counts} from ({head}) as h where rk <= 50 group by program) as c"
