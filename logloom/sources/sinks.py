"""Sinks over HTTP: subjects' payloads to a webhook, texts to a chat.

Tasks post their own rows, so nothing passes through the driver but counts.  With a
``ledger`` (a folder that driver and executors share) each payload is delivered once:

* rows are keyed by a digest of address and payload; those that the ledger's table
  lists as delivered are left out, and what was delivered is added to it;
* a task marks each batch that went through in the ledger before it goes on, so a
  task that runs again, or a job that died before its rows were listed, doesn't post
  the batch a second time;
* a failed post is tried again with growing pauses, and every attempt carries the
  batch's digest as ``Idempotency-Key``: if a worker dies between the answer and the
  mark, a receiver that keeps keys sees that it has the batch already.

Without a ledger receivers see each row at least once.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.dialect import written
from ..shipping import ship
from .store import exists

COUNTS = "sent long, failed long, error string"


def _post(url: str, body: dict, timeout: float, key: str | None = None) -> str | None:
    """Post JSON; None if all went well, else what was wrong."""
    try:
        headers = {"Content-Type": "application/json"} | ({"Idempotency-Key": key} if key else {})
        request = urllib.request.Request(url, json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return None if answer.status == 200 else f"status {answer.status}"
    except OSError as e:
        return str(e) or type(e).__name__


def _totals(results: DataFrame) -> Row:
    return results.agg(F.coalesce(F.sum("sent"), F.lit(0)).alias("sent"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"), F.max("error").alias("error")).first()


class _Marks:
    """Marks of batches in a ledger, seen by all workers."""

    def __init__(self, ledger: str):
        from pyarrow import fs

        self.fs, at = fs.FileSystem.from_uri(ledger if "://" in ledger else f"file://{ledger}")
        self.folder = f"{at}/batches"

    def has(self, key: str) -> bool:
        return self.fs.get_file_info(f"{self.folder}/{key}").type.name == "File"

    def put(self, key: str) -> None:
        self.fs.create_dir(self.folder, recursive=True)
        with self.fs.open_output_stream(f"{self.folder}/{key}") as out:
            out.write(b"1")


def _deliver(rows: DataFrame, url: str, wrap, timeout: float, batch: int, ledger: str, attempts: int, pause: float) -> Row:
    """Post rows (j, JSON) once each; ``wrap`` makes the body of a batch."""
    spark = rows.sparkSession
    ship(spark)
    keyed = rows.select("j", F.sha2(F.concat(F.lit(url + "\n"), F.col("j")), 256).alias("digest")).dropDuplicates(["digest"])
    listed = f"{ledger.rstrip('/')}/rows"
    if exists(spark, listed):
        keyed = keyed.join(spark.read.option("recursiveFileLookup", True).parquet(listed).where("error is null").select("digest"), "digest", "left_anti")
    # a written table in a fixed order: an attempt that runs again makes the same batches
    waiting = written(keyed.repartition(max(1, min(64, keyed.count() // batch + 1)), "digest").sortWithinPartitions("digest"))

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = _Marks(ledger)
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame[k : k + batch]
                key = hashlib.sha256("".join(part["digest"]).encode()).hexdigest()
                wrong = None
                if not marks.has(key):
                    for attempt in range(attempts):
                        time.sleep(pause * (2**attempt - 1))
                        wrong = _post(url, wrap([json.loads(x) for x in part["j"]]), timeout, key)
                        if wrong is None:
                            marks.put(key)
                            break
                yield pd.DataFrame({"digest": part["digest"], "error": wrong})

    at = f"{listed}/{uuid.uuid4().hex}"
    files = waiting.mapInPandas(send, "digest string, error string")
    files.write.parquet(at)
    done = spark.read.schema("digest string, error string").parquet(at)
    return _totals(done.select(F.col("error").isNull().cast("long").alias("sent"), F.col("error").isNotNull().cast("long").alias("failed"), "error"))


def post_results(payloads: DataFrame, url: str, timeout: float = 30, batch: int = 500, ledger: str | None = None, attempts: int = 4, pause: float = 1.0) -> Row:
    """Post the rows as ``{"results": [...]}``, ``batch`` at a time; (sent, failed, error), where a failure stops nothing.

    With a ``ledger`` each row is sent once, with up to ``attempts`` tries.
    """
    rows = payloads.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    if ledger is not None:
        return _deliver(rows, url, lambda part: {"results": part}, timeout, batch, ledger, attempts, pause)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), batch):
                rows = [json.loads(x) for x in frame["j"][k : k + batch]]
                wrong = _post(url, {"results": rows}, timeout)
                yield pd.DataFrame({"sent": [0 if wrong else len(rows)], "failed": [len(rows) if wrong else 0], "error": [wrong]})

    return _totals(rows.mapInPandas(send, COUNTS))


def post_texts(texts: DataFrame, url: str, column: str = "text", timeout: float = 5, ledger: str | None = None, attempts: int = 4, pause: float = 1.0) -> Row:
    """Post each text as ``{"text": ...}``; (sent, failed, error).  With a ``ledger`` each distinct text is sent once."""
    if ledger is not None:
        rows = texts.where(F.col(column).isNotNull()).select(F.to_json(F.struct(F.col(column).alias("text"))).alias("j"))
        return _deliver(rows, url, lambda part: part[0], timeout, 1, ledger, attempts, pause)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame["t"]:
                wrong = _post(url, {"text": text}, timeout)
                yield pd.DataFrame({"sent": [int(not wrong)], "failed": [int(bool(wrong))], "error": [wrong]})

    return _totals(texts.where(F.col(column).isNotNull()).select(F.col(column).alias("t")).mapInPandas(send, COUNTS))


def stream_results(payloads: DataFrame, url: str, ledger: str, checkpoint: str, **how) -> StreamingQuery:
    """Post what a stream brings, batch by batch; a micro-batch that Spark runs again posts nothing twice."""

    def post(batch: DataFrame, _: int) -> None:
        post_results(batch, url, ledger=ledger, **how)

    return payloads.writeStream.foreachBatch(post).option("checkpointLocation", checkpoint).start()
