"""Payloads are delivered once: over repeated calls, jobs that died, and failing receivers."""

import json
import shutil
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from logloom.sources import sinks


class Receiver:
    def __init__(self):
        self.rows, self.keys, self.fail = Counter(), Counter(), 0
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                outer.keys[self.headers.get("Idempotency-Key")] += 1
                wrong = outer.fail > 0
                if wrong:
                    outer.fail -= 1
                else:
                    outer.rows.update(json.dumps(r, sort_keys=True) for r in (body["results"] if "results" in body else [body]))
                self.send_response(503 if wrong else 200)
                self.end_headers()

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}/hook"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


@pytest.fixture
def receiver():
    r = Receiver()
    yield r
    r.server.shutdown()


def payloads(spark, a, b):
    return spark.createDataFrame([(f"s{i}", i, None) for i in range(a, b)], "subject string, n int, note string").repartition(3)


def test_each_row_once(spark, receiver, tmp_path):
    ledger = str(tmp_path / "ledger")
    send = lambda df: sinks.post_results(df, receiver.url, batch=7, ledger=ledger, pause=0.01)
    assert send(payloads(spark, 0, 40).union(payloads(spark, 0, 5)))[:] == (40, 0, None)
    assert send(payloads(spark, 20, 60))[:] == (20, 0, None)  # twenty of them are listed
    assert len(receiver.rows) == 60 and set(receiver.rows.values()) == {1}
    assert send(payloads(spark, 0, 60))[:] == (0, 0, None) and send(payloads(spark, 0, 0))[:] == (0, 0, None)


def test_a_job_that_died_before_its_rows_were_listed(spark, receiver, tmp_path):
    """The batches' marks alone keep a second run of the same tasks from posting."""
    ledger = str(tmp_path / "ledger")
    send = lambda: sinks.post_results(payloads(spark, 0, 30), receiver.url, batch=4, ledger=ledger, pause=0.01)
    send()
    shutil.rmtree(f"{ledger}/rows")
    assert send()[:] == (30, 0, None) and set(receiver.rows.values()) == {1} and set(receiver.keys.values()) == {1}


def test_failures_are_tried_again(spark, receiver, tmp_path):
    ledger = str(tmp_path / "ledger")
    receiver.fail = 2
    assert sinks.post_results(payloads(spark, 0, 3), receiver.url, ledger=ledger, pause=0.01)[:] == (3, 0, None)
    assert set(receiver.keys.values()) == {3} and None not in receiver.keys
    receiver.fail = 100
    wrong = sinks.post_results(payloads(spark, 3, 5), receiver.url, ledger=ledger, attempts=2, pause=0.01)
    assert wrong[:2] == (0, 2) and "503" in wrong.error
    receiver.fail = 0
    assert sinks.post_results(payloads(spark, 3, 5), receiver.url, ledger=ledger, pause=0.01)[:] == (2, 0, None)
    assert len(receiver.rows) == 5 and set(receiver.rows.values()) == {1}


def test_texts_once(spark, receiver, tmp_path):
    texts = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "text string")
    for want in (2, 0):
        assert sinks.post_texts(texts, receiver.url, ledger=str(tmp_path / "l"), pause=0.01).sent == want
    assert set(receiver.rows.values()) == {1} and len(receiver.rows) == 2


def test_stream(spark, receiver, tmp_path):
    """A stream whose checkpoint is lost reads all again and posts nothing again."""
    payloads(spark, 0, 20).write.parquet(str(tmp_path / "in"))
    for k in range(2):
        stream = spark.readStream.schema("subject string, n int, note string").parquet(str(tmp_path / "in"))
        query = sinks.stream_results(stream, receiver.url, str(tmp_path / "ledger"), str(tmp_path / f"checkpoint{k}"), batch=6, pause=0.01)
        query.processAllAvailable()
        query.stop()
    assert len(receiver.rows) == 20 and set(receiver.rows.values()) == {1}
