"""Six predicates of address classes; detectors differ in which they use."""

from __future__ import annotations

from ..plans.dialect import Dialect

RFC1918 = r"^(10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.)"
#: What a strict parser calls private besides: loopback, link-local, test and benchmark nets.
SPECIAL = r"^(0\.|10\.|127\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|192\.0\.0\.|192\.0\.2\.|192\.168\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|2[4-5]\d\.)"
VALID = r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$"


def private_rfc(d: Dialect, ip: str) -> str:
    """P1: RFC 1918 only."""
    return d.has(ip, RFC1918)


def private_strict(d: Dialect, ip: str) -> str:
    """P2: any special-use address; what is no address is not private."""
    return f"({d.has(ip, VALID)} and {d.has(ip, SPECIAL)})"


def external_test(d: Dialect, ip: str) -> str:
    """P3: a valid address outside RFC 1918 and loopback; test nets count as external."""
    return f"({d.has(ip, VALID)} and not {d.has(ip, RFC1918)} and not {d.has(ip, r'^(127|169\.254)\.')})"


def external_loopback(d: Dialect, ip: str) -> str:
    """P4: neither RFC 1918 nor loopback."""
    return f"({d.has(ip, VALID)} and not {d.has(ip, RFC1918)} and not {d.has(ip, r'^127\.')})"


def public_text(d: Dialect, ip: str) -> str:
    """P5: by prefix alone, so junk is public; null is not."""
    return f"({ip} is not null and not {d.has(ip, r'^(10\.|192\.168\.|127\.|172\.(1[6-9]|2\d|3[01])\.)')})"


def external_text(d: Dialect, ip: str) -> str:
    """P6: by prefix, without the loopback."""
    return f"({ip} is not null and not {d.has(ip, RFC1918)})"


def scope(d: Dialect, ip: str) -> str:
    return f"case when {private_strict(d, ip)} then 'private' else 'public' end"
