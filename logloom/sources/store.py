"""A store of tables with commits: readers follow manifests, writers add one or lose the race and merge again.

A commit writes all of its tables first, under names of its own, and then one
manifest that names a folder for every table, by an operation that fails if the
manifest of that number is there already.  What has no manifest is never read, so
a job that dies between two tables changes nothing, and of two writers that began
from one manifest the second reads the first's and merges with it.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file in one step; False if it is there already."""
    at, fs = _at(spark, path)
    fs.mkdirs(at.getParent())
    side, _ = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(side, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(side.toUri().getPath(), at.toUri().getPath())  # a link to a name that exists fails
        else:
            gateway = spark.sparkContext._gateway
            kind = spark._jvm.org.apache.hadoop.fs.Options.Rename
            how = gateway.new_array(kind, 1)
            how[0] = kind.NONE
            spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri()).rename(side, at, how)
        return True
    except FileExistsError:
        return False
    except Exception:  # a rename onto a name that exists; anything else shows as a missing file
        if not fs.exists(at):
            raise
        return False
    finally:
        fs.delete(side, False)


class Store:
    """Tables of one log type below ``path``."""

    def __init__(self, spark: SparkSession, path: str, log_type: str):
        self.spark, self.folder = spark, f"{path.rstrip('/')}/log_type={log_type}"

    def numbers(self) -> list[int]:
        """Numbers of the manifests, rising."""
        at, fs = _at(self.spark, f"{self.folder}/manifests")
        if not fs.exists(at):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, number: int | None = None) -> dict:
        """A manifest, the last unless given; an empty one if there is none."""
        numbers = self.numbers()
        if not numbers:
            return {"number": 0, "tables": {}}
        text = self.spark.read.option("wholetext", True).text(f"{self.folder}/manifests/{number or numbers[-1]:012d}.json").first()[0]
        return json.loads(text)

    def table(self, name: str, manifest: dict | None = None) -> DataFrame | None:
        entry = (self.manifest() if manifest is None else manifest)["tables"].get(name)
        return self.spark.read.parquet(f"{self.folder}/{entry['folder']}") if entry else None

    def commit(self, tables: dict[str, DataFrame], merge: Callable[[str, DataFrame, DataFrame], DataFrame | None], trained_at: str, attempts: int = 20) -> int:
        """Add ``tables``, merged with what is there (None: the new one replaces it); returns the manifest's number.

        A table whose ``trained_at`` lies before that of the store counts as a snapshot but doesn't replace it.
        """
        fresh = f"data/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.folder}/{fresh}/{name}")
        for _ in range(attempts):
            base = self.manifest()
            entries = dict(base["tables"])
            mine = f"data/{uuid.uuid4().hex}"
            for name in tables:
                entry = {"folder": f"{fresh}/{name}", "trained_at": trained_at, "snapshots": 1}
                old = entries.get(name)
                if old:
                    entry["snapshots"] = old["snapshots"] + 1
                    both = merge(name, self.table(name, base), self.spark.read.parquet(f"{self.folder}/{fresh}/{name}"))
                    if both is not None:
                        both.write.parquet(f"{self.folder}/{mine}/{name}")
                        entry["folder"] = f"{mine}/{name}"
                    elif old["trained_at"] > trained_at:
                        entry |= {"folder": old["folder"], "trained_at": old["trained_at"]}
                entries[name] = entry
            number = base["number"] + 1
            if put_if_absent(self.spark, f"{self.folder}/manifests/{number:012d}.json", json.dumps({"number": number, "trained_at": trained_at, "tables": entries})):
                return number
        raise RuntimeError(f"{attempts} commits to {self.folder} lost their race")
