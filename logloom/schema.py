"""The event table: one nullable superset schema for all formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT = """program username source_ip dest_ip dst_host host device mac_address interface vlan action status method path user_agent image domain query_type
source_country dept result_code severity message""".split()
NUMBERS = ["row_id", "n", "dest_port", "http_status", "bytes", "win_id"]
#: Names that some formats use for a column of the table.
ALIASES = {"destination_ip": "dest_ip", "destination_port": "dest_port", "bytes_sent": "bytes", "event_id": "win_id", "client_ip": "source_ip", "ip_address": "source_ip", "process": "image", "url": "path", "group": "dept"}


def event_table(events: DataFrame) -> DataFrame:
    """Any parsed events in the table's columns; what a format lacks is null, never a scan.

    Rows without a ``row_id`` get one by their place, unique among equal rows; as
    long as the input is a stable scan (files, a written table) it stays the same.
    """
    have = set(events.columns)

    def column(name: str):
        names = [c for c in [name, *[a for a, b in ALIASES.items() if b == name]] if c in have]
        return F.coalesce(*[F.col(f"`{c}`").cast("string") for c in names]) if names else F.lit(None).cast("string")

    cols = [F.col("timestamp") if "timestamp" in have else F.lit(None).cast("timestamp").alias("timestamp")]
    cols += [column(c).alias(c) for c in TEXT]
    cols += [column(c).try_cast("bigint").alias(c) for c in NUMBERS if c != "row_id"]
    row = F.col("row_id").cast("bigint") if "row_id" in have else F.monotonically_increasing_id()
    return events.select(*cols, row.alias("row_id"))
