"""Every query with SQL gives what DuckDB gives on the same tables; every other one runs."""

from pathlib import Path

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: "" if v is None else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    if not Path(SF).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", ["oof_scores", "regression_imputation", "cluster_distances", "pseudo_labels", "hill_climb", "rank_gauss", "row_level_scores", "refit_blend", "best_method", "subset_comparison"])
def test_models_run(spark, duck, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
