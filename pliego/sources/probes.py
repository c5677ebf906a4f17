"""What addresses answer to: probes by header and first bytes, dealt out by host.

All addresses of a host go to one task, one after another with a pause, so a site is never
asked by two tasks at once; a host of very many addresses is one long task by intent. An
address is asked once, however many rows have it. What comes back is data for
``evidence.resolution``; a failure is a row with its error.
"""

from __future__ import annotations

import importlib
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paged import Passing, retry_pause

#: The first bytes of the kinds that count as documents.
MAGIC = {"pdf": b"%PDF", "zip": b"PK\x03\x04", "ole": b"\xd0\xcf\x11\xe0", "rtf": b"{\\rtf"}
_FIELDS = {"status": pa.int32(), "content_type": pa.string(), "disposition": pa.string(), "final_url": pa.string(), "magic": pa.string(), "method": pa.string(), "attempts": pa.int32(), "error": pa.string()}


class Reply(NamedTuple):
    status: int
    headers: dict[str, str]
    url: str
    body: bytes


def http(url: str, method: str, timeout: float, most: int) -> Reply:
    """The reply to a request; of a GET at most the first ``most`` bytes."""
    headers = {"Range": f"bytes=0-{most - 1}"} if method == "GET" else {}
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method=method, headers=headers), timeout=timeout) as r:
            return Reply(r.status, {k.lower(): v for k, v in r.headers.items()}, r.url, r.read(most) if method == "GET" else b"")
    except urllib.error.HTTPError as e:
        if e.code >= 500 and e.code != 501 or e.code == 429:
            raise Passing(str(e)) from e
        return Reply(e.code, {k.lower(): v for k, v in e.headers.items()}, e.url or url, b"")
    except OSError as e:
        raise Passing(str(e)) from e


def magic_of(body: bytes) -> str:
    return next((kind for kind, start in MAGIC.items() if body.startswith(start)), "")


def probe(url: str, ask: Callable[[str, str, float, int], Reply], retries: int, delay: float, backoff: float, timeout: float, most: int, pause: Callable[[float], None] = time.sleep) -> dict:
    """The answer of an address: by HEAD, and by the first bytes where HEAD is refused or tells no type of a document."""
    attempts, error = 0, None
    for attempt in range(retries + 1):
        if attempt:
            pause(retry_pause(attempt, delay, backoff))
        attempts += 1
        try:
            method, reply = "head", ask(url, "HEAD", timeout, most)
            kind = reply.headers.get("content-type", "").split(";")[0].strip().lower()
            if reply.status not in (200, 206) or kind in ("", "application/octet-stream"):
                method, reply = "range_get", ask(url, "GET", timeout, most)
            return {
                "status": reply.status, "content_type": reply.headers.get("content-type"), "disposition": reply.headers.get("content-disposition"), "final_url": reply.url, "magic": magic_of(reply.body), "method": method,
                "attempts": attempts, "error": None,
            }
        except Passing as e:
            error = str(e)
        except Exception as e:  # what is no reply at all will be none the next time
            error = f"{type(e).__name__}: {e}"
            break
    return dict.fromkeys(_FIELDS) | {"attempts": attempts, "error": error}


def probed(rows: DataFrame, url: str, transport: str = "pliego.sources.probes:http", tasks: int = 64, retries: int = 2, delay: float = 2.0, backoff: float = 2.0, timeout: float = 12.0, most: int = 1024, between: float = 0.8) -> DataFrame:
    """rows with status, content_type, disposition, final_url, magic, method, attempts and error of their address.

    Null and blank addresses are not asked. ``transport`` is module:function; the module must be
    there on all executors. ``between`` is the pause between two requests to one host.
    """
    host = F.lower(F.regexp_extract(F.col("_url"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    asked = rows.select(F.trim(F.col(url)).alias("_url")).where("_url <> ''").distinct().withColumn("_host", host).repartition(tasks, "_host").sortWithinPartitions("_host", "_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        module, _, name = transport.partition(":")
        ask, last = getattr(importlib.import_module(module), name), None
        for batch in batches:
            for address, own in zip(batch.column("_url").to_pylist(), batch.column("_host").to_pylist()):
                if own == last:
                    time.sleep(between)
                last = own
                found = probe(address, ask, retries, delay, backoff, timeout, most)
                yield pa.RecordBatch.from_arrays([pa.array([address]), *(pa.array([found[n]], t) for n, t in _FIELDS.items())], ["_url", *_FIELDS])

    ddl = "_url string, status int, content_type string, disposition string, final_url string, magic string, method string, attempts int, error string"
    answers = asked.mapInArrow(run, ddl)
    return rows.withColumn("_url", F.trim(F.col(url))).join(answers, "_url", "left").drop("_url")
