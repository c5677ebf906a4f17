"""Probes of addresses against a server in this process."""

import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from pliego.operators import evidence as E
from pliego.sources import probes

SEEN = Counter()


class Site(BaseHTTPRequestHandler):
    def reply(self, status, headers, body=b""):
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k, v)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        if self.command == "GET":
            self.wfile.write(body)

    def answer(self):
        SEEN[self.command, self.path] += 1
        if self.path == "/a.pdf":
            self.reply(200, {"Content-Type": "application/pdf"})
        elif self.path == "/nohead":
            self.reply(405 if self.command == "HEAD" else 206, {"Content-Type": "application/octet-stream", "Content-Disposition": 'attachment; filename="x.docx"'}, b"PK\x03\x04rest")
        elif self.path == "/moved":
            self.reply(302, {"Location": "/a.pdf"})
        elif self.path == "/flaky" and SEEN[self.command, self.path] < 3:
            self.reply(503, {})
        elif self.path in ("/flaky", "/page"):
            self.reply(200, {"Content-Type": "text/html; charset=utf-8"})
        elif self.path == "/down":
            self.reply(500, {})
        else:
            self.reply(404, {"Content-Type": "text/html"})

    do_HEAD = do_GET = answer

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_answers_of_addresses(spark, site):
    paths = ["/a.pdf", "/a.pdf", "/nohead", "/moved", "/flaky", "/page", "/down", "/none"]
    rows = spark.createDataFrame([(i, site + p) for i, p in enumerate(paths)] + [(90, None), (91, " "), (92, "no scheme"), (93, "http://127.0.0.1:1/x")], "i int, u string")
    found = probes.probed(rows, "u", tasks=2, retries=2, delay=0, between=0, timeout=5).cache()
    got = {r["i"]: r for r in found.collect()}
    assert {i: (r["status"], r["magic"], r["method"], r["attempts"]) for i, r in got.items()} == {
        0: (200, "", "head", 1), 1: (200, "", "head", 1), 2: (206, "zip", "range_get", 1), 3: (200, "", "head", 1), 4: (200, "", "head", 3), 5: (200, "", "head", 1), 6: (None, None, None, 3), 7: (404, "", "range_get", 1),
        90: (None, None, None, None), 91: (None, None, None, None), 92: (None, None, None, 1), 93: (None, None, None, 3),
    }
    assert got[3]["final_url"] == site + "/a.pdf" and "500" in got[6]["error"] and got[92]["error"].startswith("ValueError") and got[93]["error"] and got[0]["error"] is None
    assert SEEN["HEAD", "/a.pdf"] == 2  # once for two rows, once for the one that moved
    judged = found.select("i", E.resolution(F.col("final_url"), F.col("status"), F.col("content_type"), F.col("disposition"), F.col("magic"), F.lit("c"), F.lit("k")).alias("r")).collect()
    assert {r["i"] for r in judged if r["r"]["merge_ready"]} == {0, 1, 2, 3}


def test_no_addresses(spark):
    assert probes.probed(spark.createDataFrame([], "u string"), "u").count() == 0
