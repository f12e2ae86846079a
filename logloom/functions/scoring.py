"""Scores and severities."""

from __future__ import annotations

import json
from pathlib import Path

from ..plans.dialect import Dialect

# Base scores by attack type, modifiers and thresholds.
BASE = {
    "account_takeover": 10.0,
    "account_takeover_internal": 6.5,
    "data_exfiltration": 8.5,
    "suspicious_operations": 7.5,
    "brute_force_target": 7.0,
    "internal_movement": 6.0,
    "dns_tunneling": 9.0,
    "dns_amplification": 8.5,
    "dns_nxdomain_storm": 9.0,
    "dns_suspicious_domains": 7.5,
    "dns_nxdomain_flood": 6.5,
    "port_scan": 7.5,
    "ddos_attack": 9.0,
    "malware_c2": 9.5,
    "sql_injection": 8.5,
    "brute_force_ssh": 7.0,
    "unauthorized_access": 8.0,
    "privilege_escalation": 9.0,
    "lateral_movement": 7.0,
    "persistence_mechanism": 8.5,
    "dhcp_scope_conflict": 8.5,
    "dhcp_rogue_server": 9.0,
    "dhcp_user_device_mismatch": 7.0,
    "firewall_deny_burst": 7.5,
    "firewall_exfiltration": 8.5,
    "firewall_port_scan": 7.5,
    "firewall_policy_evasion": 8.0,
    "network_link_flap": 6.0,
    "cron_job_overlap": 5.0,
    "ssh_login_burst": 7.0,
    "linux_privilege_escalation": 9.0,
    "linux_persistence": 8.5,
    "linux_data_exfil": 8.5,
    "edr_process_injection": 9.5,
    "edr_credential_dumping": 9.5,
    "edr_lateral_movement": 8.0,
    "edr_data_staging": 8.0,
    "router_bgp_hijack": 9.5,
    "router_dos_attack": 9.0,
    "router_unauthorized_access": 8.5,
    "windows_credential_theft": 9.5,
    "windows_privilege_escalation": 9.0,
    "windows_persistence": 8.5,
    "windows_ransomware": 10.0,
    "dhcp_excessive_roaming": 6.0,
    "dhcp_frequent_release": 5.5,
}
MODIFIERS = {"high_volume": 1.0, "medium_volume": 0.5, "public_ip": 1.0, "blacklisted_ip": 1.5, "internal_ip": -1.0, "confirmed_success": 1.0, "failed_attempt": -0.5, "sensitive_data": 1.0, "public_data": 0.0, "multiple_targets": 0.5, "persistence": 1.0}
UNKNOWN, CRITICAL, WARNING, LOW, HIGH = 5.0, 8.0, 4.0, 1.0, 10.0

_OWN = dict(BASE), dict(MODIFIERS), CRITICAL, WARNING


def configure(source: str | dict | None = None) -> None:
    """Take scores from a JSON file (or its content): ``attack_type_scores``, ``score_modifiers``
    and ``severity_thresholds``; a part that is not there keeps the values above, as all do
    without a source.  Queries built from then on use them.
    """
    global CRITICAL, WARNING
    found = json.loads(Path(source).read_text("utf-8")) if isinstance(source, str) else source or {}
    levels = found.get("severity_thresholds", {})
    for table, own, new in ((BASE, _OWN[0], found.get("attack_type_scores")), (MODIFIERS, _OWN[1], found.get("score_modifiers"))):
        table.clear()
        table.update(own if new is None else {k: float(v) for k, v in new.items()})
    CRITICAL, WARNING = float(levels.get("CRITICAL", _OWN[2])), float(levels.get("WARNING", _OWN[3]))


def base(kind: str) -> float:
    return BASE.get(kind, UNKNOWN)


def total(kind: str, *modifiers: str) -> float:
    return max(LOW, min(HIGH, base(kind) + sum(MODIFIERS.get(m, 0.0) for m in modifiers)))


def severity(score: str, critical: float | None = None, warning: float | None = None) -> str:
    critical, warning = CRITICAL if critical is None else critical, WARNING if warning is None else warning
    return f"case when {score} >= {critical} then 'CRITICAL' when {score} >= {warning} then 'WARNING' else 'INFO' end"


def repaired(severity_col: str, score: str) -> str:
    """A severity that is none of the three is set by score: 6 and 4."""
    return f"case when {severity_col} in ('CRITICAL', 'WARNING', 'INFO') then {severity_col} when {score} >= 6 then 'CRITICAL' when {score} >= 4 then 'WARNING' else 'INFO' end"


def z(value: str, mean: str, sd: str) -> str:
    """z-score, 0 where the deviation is null, 0 or NaN."""
    return f"case when {sd} is null or {sd} = 0 or {sd} <> {sd} then 0.0 else ({value} - {mean}) / {sd} end"


def table(d: Dialect) -> str:
    """type, modifier, score, severity and how many: each type of ``@alerts`` scored anew, alone and with each modifier."""
    kinds = d.values([(k, v) for k, v in BASE.items()], ["attack_type", "b"])
    mods = d.values([(k, v) for k, v in MODIFIERS.items()] + [("none", 0.0)], ["modifier", "m"])
    raw = f"coalesce(b, {UNKNOWN}) + m"
    score = f"cast(greatest({LOW}, least({HIGH}, {raw})) as double)"
    return f"""select type, modifier, {score} as score, {severity(raw)} as severity, alerts from (select type, cast(count(*) as bigint) as alerts from @alerts group by type) as a
      left join {kinds} as k on k.attack_type = a.type cross join {mods} as x"""
