"""What a text must hold for a pattern to fit it: literals that are looked for before the pattern is tried."""

from __future__ import annotations

import re
from functools import lru_cache

from ..plans.dialect import Dialect

LEAST = 3  #: characters of a literal worth a look


def _needed(items) -> frozenset[str] | None:
    """Literals of which every match holds one, from a parsed pattern; None if none is sure."""
    found: list[frozenset[str]] = []
    run = ""
    for op, arg in items:
        name = str(op)
        if name == "LITERAL" and arg < 128:
            run += chr(arg).lower()
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        if name == "SUBPATTERN":
            inner = _needed(arg[-1])
        elif name == "BRANCH":
            parts = [_needed(x) for x in arg[1]]
            inner = frozenset().union(*parts) if all(parts) else None
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            inner = _needed(arg[2])
        else:
            inner = None
        if inner:
            found.append(inner)
    if run:
        found.append(frozenset([run]))
    return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=None)


@lru_cache(maxsize=None)
def literals(pattern: str) -> tuple[str, ...]:
    """Lower-case literals, one of which every text that fits holds in lower case; empty if none is sure and long enough."""
    found = _needed(re._parser.parse(pattern))
    return tuple(sorted(found)) if found and min(map(len, found)) >= LEAST else ()


def holds(d: Dialect, col: str, pattern: str) -> str:
    """``col`` fits ``pattern``, whatever the case; the pattern is tried only where one of its literals occurs."""
    some = literals(pattern)
    hit = d.has(col, "(?i)" + pattern)
    return f"(({' or '.join(f'contains(lower({col}), {d.text(x)})' for x in some)}) and {hit})" if some else hit
