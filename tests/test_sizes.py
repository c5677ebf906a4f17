"""Queries against SQL on rows that the small tables lack, and what keeps their work in proportion."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import rows

from pliego.functions.semantics import fold_accents, fold_plain
from pliego.operators import appendix, privacy
from pliego.plans import registry


def agrees(spark, folder, name, tables):
    """The query and its SQL give the same rows on the folder's tables."""
    duck = duckdb.connect()
    for t in tables:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    ours, theirs = registry.queries()[name](spark, str(folder)), duck.sql(registry.oracle_sql()[name])
    return rows(ours.columns, map(tuple, ours.collect())) == rows(theirs.columns, theirs.fetchall())


def test_counts_of_a_plan_without_targets(spark, sf_dir, tmp_path):
    """Every record id has several records of each key, so no document has a target: SQL's sums are null."""
    for t in ("events", "orders"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    people = spark.range(12 * 1200).selectExpr("id AS c_custkey", "element_at(array('BUILDING', 'MACHINERY', 'OTHER'), CAST(id DIV 1200 % 3 + 1 AS INT)) AS c_mktsegment", "5000.0D AS c_acctbal")
    people.write.parquet(f"{tmp_path}/customer.parquet")
    assert agrees(spark, tmp_path, "append_counts", ("events", "orders", "customer"))


@pytest.mark.parametrize("text", ["x undß y", "die ıde", "中de中", "lĭcense de", "LICÉNSE", " the ", "ünd", "a_de", "dë", "theß stüpid"])
def test_kinds_of_texts_with_other_letters(spark, tmp_path, text):
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert agrees(spark, tmp_path, "kw_classify", ("documents",))


@pytest.mark.parametrize("name", ["feed_notices", "feed_details"])
def test_texts_of_notices_are_made_once(spark, sf_dir, name):
    """A notice's text is neither computed again for each test of it nor moved line by line."""
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<feed>") == 1 and plan.index("<cac:TenderResult>") < plan.index("Aggregate")


def test_pages_of_links_are_built_once(spark, sf_dir):
    plan = registry.queries()["page_candidates"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.count("MapInArrow") == 1


def test_values_of_answers_are_computed_once(spark, sf_dir):
    """The name in a header feeds six values of an answer."""
    plan = registry.queries()["resolutions"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("[^;]+") <= 2


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keys_of_trees_are_cut_into_words_once(spark):
    trees = spark.createDataFrame([(1, '{"a": 1}')], "d int, t string")
    plan = optimized(privacy.summary(privacy.tree_findings(trees, "d", "t", "public-build")))
    assert plan.count("(?<=[a-z0-9])(?=[A-Z])") == 2  # of the key and of the nearest key above


def test_numbers_after_marked_labels_are_found(spark):
    values = spark.createDataFrame([("telèfon 600 123 456",), ("DNÍ: 12345678A",), ("tel 60012345",), ("Ñie x1234567b",), (None,)], "v string")
    got = values.select(privacy.phone_like(F.col("v")), privacy.personal_id_like(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True), (False, False), (False, True), (None, None)]


def test_only_lines_with_a_first_word_are_normalised(spark):
    texts = spark.createDataFrame([(1, "Objeto del contrato")], "d int, t string")
    assert optimized(appendix.section_lines(texts, "d", "t")).count(r"(?U)\s+") == 1


def test_plain_folds_are_the_same(spark):
    texts = spark.createDataFrame([("Abc \x7f",), ("ÁÉÍ Ñç",), ("İ",), ("",), (None,)], "t string")
    assert all(r[0] == r[1] for r in texts.select(fold_accents(F.col("t")), fold_plain(F.col("t"))).collect())
