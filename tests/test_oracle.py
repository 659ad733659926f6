"""Every registered query against its DuckDB SQL (the driver's gate), on
the smallest shared tables."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from helpers import rows_of

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

#: the training-data queries are tested in tests/llm
LLM = {n for n in E.queries() if n.startswith("op") and n[2:].split("_")[0].isdigit()} | {"pipeline"}

#: recomputed in tests/test_full_queries.py
NO_SQL = {"model_report_full", "model_report_files_full", "memory_fit_linear_4", "memory_forecast_4", "balanced_clusters",
          "extract_detections_full", "forecast_forest", "forecast_net"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) - LLM))
def test_query_matches_oracle(spark, duck, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = duck.execute(E.oracle_sql()[name]).df()
    gc, gr = rows_of(got)
    wc, wr = rows_of(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


def test_every_query_has_an_oracle():
    assert set(E.queries()) - LLM - NO_SQL == set(E.oracle_sql()) - LLM


def test_every_query_has_a_stable_schema(spark):
    for name, fn in E.queries().items():
        if name in LLM | NO_SQL:  # those run in test_full_queries
            continue
        df = fn(spark, SF_SMALL)
        assert len(df.columns) == len(set(df.columns)), name


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["bin_x", "bin_y", "n", "sum_vx", "sum_vy", "ux", "uy"]
