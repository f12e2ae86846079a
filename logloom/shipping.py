"""The package and files for workers that lack them."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .plans.dialect import scratch


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per application, where they may not have it on their path."""
    context = spark.sparkContext
    if getattr(context, "_logloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    with zipfile.ZipFile(buffer := io.BytesIO(), "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    target = f"{scratch(spark)}/logloom.zip"
    at = spark._jvm.org.apache.hadoop.fs.Path(target)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = store.create(at, False)
    out.write(bytearray(buffer.getvalue()))
    out.close()
    context.addPyFile(at.toUri().getPath() if store.getUri().getScheme() == "file" else target)
    context._logloom_shipped = True


def give_file(spark: SparkSession, path: str) -> str:
    """Give the workers a file that the driver can read; returns the name under which ``SparkFiles`` has it."""
    given = spark.sparkContext.__dict__.setdefault("_logloom_files", set())
    if path not in given:
        spark.sparkContext.addFile(path)
        given.add(path)
    return path.rstrip("/").rsplit("/", 1)[-1]
