"""Paged feeds as a data source: one partition a feed, each following its pages' ``next`` links.

    spark.dataSource.register(PagedFeeds)
    spark.read.format("paged_feeds").option("feeds", '[{"name": "a", "url": "https://..."}]').load()

A page that fails for the moment (no answer, a server error, no feed in the answer) is tried
again after a growing pause with jitter; one that fails for good ends its feed with an error row.
Pages that were read stay.
"""

from __future__ import annotations

import importlib
import json
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import urljoin, urlsplit
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "feed string, page int, url string, content string, attempts int, retry_errors array<string>, error string"


class Answer(NamedTuple):
    status: int
    content_type: str
    url: str
    body: bytes


class Passing(OSError):
    """A failure that may pass: worth another try."""


def http(url: str, timeout: float) -> Answer:
    """The answer to a request; server errors, overload and broken connections may pass."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            return Answer(r.status, r.headers.get("Content-Type", ""), r.url, r.read())
    except urllib.error.HTTPError as e:
        if e.code >= 500 or e.code == 429:
            raise Passing(str(e)) from e
        raise
    except OSError as e:
        raise Passing(str(e)) from e


def landed(url: str, timeout: float) -> Answer:
    """A page that lies in a folder all executors see, by path or file URL; a file that is not there yet may come."""
    try:
        with open(urlsplit(url).path, "rb") as f:
            return Answer(200, "application/atom+xml", url, f.read())
    except FileNotFoundError as e:
        raise Passing(str(e)) from e


def retry_pause(attempt: int, delay: float, backoff: float, uniform: Callable[[float, float], float] = random.uniform) -> float:
    """Seconds before the try after ``attempt`` (from 1) failures: growing, give or take a fifth."""
    return delay * backoff ** (attempt - 1) * uniform(0.8, 1.2)


def described(answer: Answer, limit: int = 160) -> str:
    """What an answer that is no feed looks like, in one printable line."""
    text = re.sub(r"\s+", " ", answer.body[:600].decode("utf-8", "replace"))
    text = "".join(c for c in text if c >= " " and c != "\x7f").strip()
    text = text if len(text) <= limit else text[: limit - 1].rstrip() + "…"
    kind = answer.content_type.split(";")[0].strip() or "?"
    return f'non-Atom response status={answer.status} content-type={kind} final_url={answer.url or "?"} snippet="{text}"'


def next_link(root: ElementTree.Element, base: str) -> str:
    """The address of the next page, '' on the last one."""
    for child in root:
        if isinstance(child.tag, str) and child.tag.rpartition("}")[2] == "link" and child.get("rel") == "next" and (href := child.get("href", "").strip()):
            return urljoin(base, href)
    return ""


def read_page(url: str, fetch: Callable[[str, float], Answer], retries: int = 3, delay: float = 2.0, backoff: float = 2.0, timeout: float = 45.0, pause: Callable[[float], None] = time.sleep):
    """(answer, root, errors of tries that failed, error that ended it): one page, tried again while its failures may pass."""
    failed: list[str] = []
    for attempt in range(retries + 1):
        if attempt:
            pause(retry_pause(attempt, delay, backoff))
        try:
            answer = fetch(url, timeout)
        except Passing as e:
            failed.append(str(e))
            continue
        except Exception as e:  # whatever else went wrong will go wrong again
            return None, None, failed, f"{type(e).__name__}: {e}"
        head = answer.body[:3000].lower()
        if b"<feed" not in head and b"<entry" not in head:
            failed.append(described(answer))
            continue
        try:
            return answer, ElementTree.fromstring(answer.body), failed, None
        except ElementTree.ParseError as e:
            failed.append(f"XML parse error: {e}")
    return None, None, failed, failed[-1]


class _Feed(InputPartition):
    def __init__(self, name: str, url: str):
        super().__init__(name)
        self.name, self.url = name, url


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        get = lambda key, default: options.get(key, options.get(key.lower(), default))
        self.feeds = json.loads(get("feeds", "[]"))
        self.most, self.retries = int(get("maxPages", "1")), int(get("retries", "3"))
        self.delay, self.backoff, self.timeout = float(get("retryDelay", "2")), float(get("retryBackoff", "2")), float(get("timeout", "45"))
        self.between, self.transport = float(get("pageDelay", "0.4")), get("transport", "pliego.sources.paged:http")
        module, _, name = self.transport.partition(":")
        if not callable(getattr(importlib.import_module(module), name, None)):
            raise ValueError(f"{self.transport} is no function module:name")

    def partitions(self) -> list[InputPartition]:
        return [_Feed(f["name"], f["url"]) for f in self.feeds]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:  # without feeds there is no partition
            return
        module, _, name = self.transport.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        url, seen = partition.url, set()
        for page in range(1, self.most + 1):
            answer, root, failed, error = read_page(url, fetch, self.retries, self.delay, self.backoff, self.timeout)
            attempts = len(failed) + (error is None or not failed or error != failed[-1])
            yield partition.name, page, url, answer.body.decode("utf-8", "replace") if answer else None, attempts, failed, error
            seen.add(url)
            url = next_link(root, answer.url or url) if answer else ""
            if not url or url in seen:
                return
            if page < self.most:
                time.sleep(self.between)


class PagedFeeds(DataSource):
    """Options: feeds (JSON list of name and url), maxPages a feed, retries, retryDelay, retryBackoff, timeout, pageDelay (seconds), transport (module:function, ``http`` by default).

    Rows (feed, page, url, content, attempts, retry_errors, error): a page that could not be
    read has a null content and an error, and is its feed's last. A feed whose next link leads
    back to a page that was read ends there. Pages are text in UTF-8.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def feed_runs(pages: DataFrame) -> DataFrame:
    """(feed, pages_done, had_error, error, retry_count, retried_pages, retry_errors), one row for each feed that was read."""
    label = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit(": "))
    told = F.flatten(F.array_sort(F.collect_list(F.struct("page", F.transform("retry_errors", lambda e: F.concat(label, e)).alias("e"))))["e"])
    tries = F.sum(F.col("attempts") - 1)
    return pages.groupBy("feed").agg(
        F.count_if(F.col("error").isNull()).alias("pages_done"), (F.count("error") > 0).alias("had_error"), F.max(F.concat(label, F.col("error"))).alias("error"), tries.cast("long").alias("retry_count"),
        F.array_sort(F.collect_set(F.when(F.col("attempts") > 1, F.col("page")))).alias("retried_pages"), told.alias("retry_errors"),
    )


def feed_files(pages: DataFrame) -> DataFrame:
    """(file, xml) of the pages that were read, for ``feeds.entries``."""
    return pages.where("error IS NULL").select(F.concat_ws("#", "feed", "page").alias("file"), F.col("content").alias("xml"))
