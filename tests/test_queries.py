"""Every registered query with SQL agrees with DuckDB on the same tables."""

import duckdb
import pytest

from pliego.plans import registry

SF = "/root/testdata/sf0.001"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def same(v):
    if v is None or v != v:
        return None
    return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v


def rows(names, data):
    return sorted((tuple(same(r[names.index(c)]) for c in sorted(names)) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, sf_dir, duck, name):
    ours = registry.queries()[name](spark, sf_dir)
    theirs = duck.sql(registry.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours.columns, map(tuple, ours.collect())) == rows(theirs.columns, theirs.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_training_data_operators(tmp_path):
    """The library works when those folders are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "pliego", tmp_path / "pliego", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = (
        "import __spark_entry__ as e; n = e.queries(); assert n and not [x for x in n if x.startswith('op') and x[2].isdigit() or x == 'pipeline']; e.oracle_sql()\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"assert e.entry(spark).count() == 10 and n['top_sources'](spark, {SF!r}).count() > 0"
    )
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=240)
    (tmp_path / "pliego" / "llm").mkdir()
    (tmp_path / "pliego" / "llm" / "__init__.py").touch()
    (tmp_path / "pliego" / "llm" / "queries.py").write_text("import a_package_that_is_not_here")
    (tmp_path / "corpus_pipeline.py").write_text("from pliego.llm import queries")
    subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; assert e.queries()"], cwd=tmp_path, check=True, timeout=120)
