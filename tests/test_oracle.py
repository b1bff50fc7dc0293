"""Every query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__

FOLDER = Path("/root/testdata/sf0.001")
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, float) else v


@pytest.mark.skipif(not FOLDER.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, duck, name):
    df, rel = __spark_entry__.queries()[name](spark, str(FOLDER)), duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


@pytest.mark.skipif(not FOLDER.exists(), reason="no tables")
def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_queries_without_sql_are_known():
    without = set(__spark_entry__.queries()) - set(SQL)
    models = {"gbt_scores", "rf_scores", "logreg_scores", "isolation_forest_scores", "bootstrap_auc_diff", "feature_ablation", "hypothetical_score", "smr_intervals", "provider_split_features", "capacity_variants", "repeated_splits", "fold_features", "grid_search", "cv_separability", "split_comparison"}
    assert {n for n in without if not n.startswith("op") and n != "pipeline"} == models
