"""Paged feeds: pages in order, tries with pauses, failures that pass and that don't."""

import json
from pathlib import Path

import pytest

from pliego.sources import feeds, paged

ATOM = '<feed xmlns="http://www.w3.org/2005/Atom">{link}{entries}</feed>'


def page(folder, name, number, last=False, to=None):
    link = "" if last else f'<link rel="self" href="x"/><link rel="next" href="{to or f"{name}{number + 1}.atom"}"/>'
    entry = f"<entry><id>{name}{number}</id><title>t{number}</title></entry>"
    (folder / f"{name}{number}.atom").write_text(ATOM.format(link=link, entries=entry))


def flaky(url, timeout):
    """As landed, but a page whose name ends in 2 fails twice: no answer, then a page of HTML."""
    answer = paged.landed(url, timeout)
    if url.endswith("2.atom"):
        count = Path(url + ".tries")
        n = int(count.read_text()) if count.exists() else 0
        count.write_text(str(n + 1))
        if n == 0:
            raise paged.Passing("connection reset")
        if n == 1:
            return answer._replace(status=503, content_type="text/html; charset=x", body=b"<html>\n  busy \x01</html>")
    return answer


def refused(url, timeout):
    raise ValueError("404 Client Error")


def read(spark, folder, names, transport="flaky", **options):
    spark.dataSource.register(paged.PagedFeeds)
    reader = spark.read.format("paged_feeds").option("feeds", json.dumps([{"name": n, "url": str(folder / f"{n}1.atom")} for n in names]))
    for k, v in {"maxPages": 9, "retryDelay": 0, "pageDelay": 0, "transport": f"tests.test_paged:{transport}" if transport in ("flaky", "refused") else transport, **options}.items():
        reader = reader.option(k, str(v))
    return reader.load()


@pytest.fixture
def folder(tmp_path):
    for n in (1, 2, 3):
        page(tmp_path, "a", n, last=n == 3)
    page(tmp_path, "b", 1, to="b1.atom")
    page(tmp_path, "c", 1)
    return tmp_path


def test_a_page_that_fails_twice_is_read(spark, folder):
    rows = read(spark, folder, ["a", "b"]).cache()
    assert rows.rdd.getNumPartitions() == 2
    got = {(r["feed"], r["page"]): r for r in rows.collect()}
    assert {k: (r["attempts"], r["error"]) for k, r in got.items()} == {("a", 1): (1, None), ("a", 2): (3, None), ("a", 3): (1, None), ("b", 1): (1, None)}
    assert got["a", 2]["retry_errors"] == ["connection reset", f'non-Atom response status=503 content-type=text/html final_url={folder}/a2.atom snippet="<html> busy </html>"']
    runs = {r["feed"]: r for r in paged.feed_runs(rows).collect()}
    assert (runs["a"]["pages_done"], runs["a"]["had_error"], runs["a"]["retry_count"], runs["a"]["retried_pages"], runs["a"]["retry_errors"][0]) == (3, False, 2, [2], "p2: connection reset")
    assert sorted(r["id"] for r in feeds.parsed(feeds.entries(paged.feed_files(rows))).collect()) == ["a1", "a2", "a3", "b1"]


def test_pages_before_a_failure_stay(spark, folder):
    rows = read(spark, folder, ["c"], retries=2).collect()
    assert [(r["page"], r["attempts"], r["content"] is None) for r in rows] == [(1, 1, False), (2, 3, True)]
    run = paged.feed_runs(read(spark, folder, ["c"], retries=2)).first()
    assert run["pages_done"] == 1 and run["had_error"] and run["error"].startswith("p2: ") and run["retry_count"] == 2 and len(run["retry_errors"]) == 3


def test_a_refusal_is_not_tried_again(spark, folder):
    rows = read(spark, folder, ["a"], transport="refused").collect()
    assert [(r["page"], r["attempts"], r["error"]) for r in rows] == [(1, 1, "ValueError: 404 Client Error")]


def test_page_cap_and_no_feeds(spark, folder):
    assert read(spark, folder, ["a"], maxPages=1, transport="pliego.sources.paged:landed").count() == 1
    assert read(spark, folder, []).count() == 0
    with pytest.raises(Exception, match="no function"):
        read(spark, folder, ["a"], transport="json:nothing").count()


def test_pauses_grow_with_jitter():
    assert [paged.retry_pause(k, 2, 3, lambda a, b: b) for k in (1, 2, 3)] == pytest.approx([2.4, 7.2, 21.6])
    assert all(1.6 <= paged.retry_pause(1, 2, 3) <= 2.4 for _ in range(50))
    waits = []
    broken = lambda url, timeout: paged.Answer(200, "", url, b"<feed><x></feed>")
    answer, root, failed, error = paged.read_page("u", broken, 2, 1, 2, pause=waits.append)
    assert answer is None and len(failed) == 3 and error == failed[-1] and error.startswith("XML parse error") and len(waits) == 2 and waits[1] > waits[0]
