"""Structured Streaming forms of the windowed operators.

Counts per minute, denial bursts and failed logins by key with a watermark;
sessions by gap.  Late rows beyond the watermark are dropped by the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detectors import BLOCKED

LATE = "10 minutes"


def per_minute(logs: DataFrame, late: str = LATE) -> DataFrame:
    return logs.withWatermark("timestamp", late).groupBy(F.window("timestamp", "1 minute")).agg(F.count("*").alias("events"))


def deny_bursts(logs: DataFrame, least: int = 10, late: str = LATE) -> DataFrame:
    """Minutes and addresses with many blocked rows."""
    blocked = logs.where(F.expr(BLOCKED) & F.col("source_ip").isNotNull())
    counts = blocked.withWatermark("timestamp", late).groupBy(F.window("timestamp", "1 minute"), "source_ip").agg(F.count("*").alias("blocked"))
    return counts.where(F.col("blocked") >= least)


def failed_logins(logs: DataFrame, least: int = 3, late: str = LATE) -> DataFrame:
    rows = logs.where((F.lower("status") == "failed") & F.col("username").isNotNull())
    counts = rows.withWatermark("timestamp", late).groupBy(F.window("timestamp", "1 minute"), "source_ip", "username").agg(F.count("*").alias("fails"))
    return counts.where(F.col("fails") >= least)


def sessions(logs: DataFrame, gap: str = "15 minutes", late: str = LATE) -> DataFrame:
    """Sessions of an address and user.  A gap of exactly ``gap`` ends one here; the batch form keeps it."""
    return logs.withWatermark("timestamp", late).groupBy(F.session_window("timestamp", gap), "source_ip", "username").agg(F.count("*").alias("events"))
