"""Operator 11: pattern rules by their rarest token, against every rule on every url."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from pliego.llm import url_rules as U

URLS = [
    "http://example.com/en/1", "https://www.example.com/en/1", "https://a.www.EXAMPLE.com/en/", "http://example.com/EN/1", "http://notexample.com/en/", "http://example.com", "http://example.com?x=/en/",
    "http://com/", "http://xcom/", "ftp://a.net/es/x#top", "http://a.net/fr", "http://a.net/fr/", "http://a.net/es", "http://free-casino.example.org/a", "http://casinos.example.org/a", "http://a.org/tag/b/page/2", "http://a.org/x.exe",
    "http://a.org/x.exe/y", "http://a.org/cgi-bin/z", None, "", "no scheme", "://", "http:///en/", "http://example.com:80/en/", "http://u@example.com/en/", "http://é.example.com/en/ñ", "a://b://example.com/en/", "http://a.net/es/" + "x" * 20000,
    "http://example.com/\nen/", "http://CASINO.org/", "http://a.org/CASINO/", "http://example.com/en/1", "http://example.com/en/1",
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, 1, "x", 2) for i, u in enumerate(URLS)] + [(None, URLS[0], 1, "x", 2)]
    return spark.createDataFrame(rows, "page_id long, url string, host long, rule string, `a.b c` long").repartition(3).cache()


def direct(url, rules):
    rest = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    hits = [r for r in rules if re.search(r.regex, host + path)]
    best = max(hits, key=lambda r: (r.level, len(r.name), r.name), default=None)
    return host, path, best.name if best and best.level else None, best.name if best and not best.level else None, best.verdict if best else "allow"


MORE = (*U.SITES, *U.PATTERNS, U.pattern("free", "block"), U.pattern("|a.org/x*.exe", "allow"), U.pattern("xxxx", "block"))


@pytest.mark.parametrize("inline", [U.INLINE, 0])
@pytest.mark.parametrize("rules", [U.SITES + U.PATTERNS, MORE, U.SITES[:1], ()])
def test_judged_as_by_all_rules(pages, rules, inline):
    found = U.judged(pages, rules, columns=["page_id", "url"], inline=inline)
    want = [(i, *direct(u, rules)) for i, u in [*enumerate(URLS), (None, URLS[0])]]
    got = [tuple(r) for r in found.select("row.page_id", "host", "path", "rule", "pattern", "verdict").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_pages_and_clashing_names(spark, pages):
    assert U.judged(pages).select("row.*").columns == pages.columns
    assert U.judged(pages.limit(0)).count() == 0 and U.judged(pages.limit(0), inline=0).count() == 0


def test_tokens_are_whole_in_every_match():
    assert U.pattern("||example.com/en/").tokens == ("com", "en", "example")
    assert U.pattern("||example.com/en").tokens == ("com", "example")
    assert U.pattern("casino").tokens == () and U.pattern("^casino^").tokens == ("casino",) and U.pattern("|a-*b.c|").tokens == ("a", "c")


def test_rules_lie_under_their_rarest_token(spark):
    rows = spark.createDataFrame([("http://a.com/en/",)] * 5 + [("http://b.com/fr/",)] * 2, "url string")
    host, path = U.host_and_path(F.col("url"))
    filed = U._filed(rows.select(U._tokens(F.concat(host, path)).alias("tokens")), [U.site("block", "com/en/"), U.site("block", "com/fr/"), U.site("block", "com/de/"), U.pattern("x")])
    assert [(t, n, [r.name for r in held]) for t, n, held in filed] == [("", 0, ["x"]), ("de", 0, ["com/de/"]), ("en", 5, ["com/en/"]), ("fr", 2, ["com/fr/"])]


def test_agrees_with_sql(pages, tmp_path):
    path = str(tmp_path / "p.parquet")
    pages.coalesce(1).write.parquet(path)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    cols = ["page_id", "host", "path", "rule", "pattern", "verdict"]
    want = c.execute(f"SELECT {', '.join(cols)} FROM ({U.ORACLE_SQL})").fetchall()
    got = U.judged(pages, columns=["page_id"]).select("row.page_id", *cols[1:]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_no_python_worker_and_no_shuffle_of_pages(pages):
    plan = U.judged(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("InMemoryRelation")[0]
