"""Every query with SQL gives the rows of that SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalogue, page_queries, stored_queries  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return ""
        return repr(float(v)) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)

    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, duck, name):
    ours, theirs = catalogue.QUERIES[name](spark, DIR).toPandas(), duck.execute(catalogue.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.QUERIES["guarded_append"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "l_shipdate" not in plan and "Python" not in plan


def test_a_page_scans_the_observations_twice(spark):
    """Once for the stored columns of all products, once for the recent prices of the page."""
    for name in ("grid_desconto", "grid_search", "artist_page", "style_page", "carousel"):
        plan = catalogue.QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("l_extendedprice#") > 0 and len([line for line in plan.splitlines() if "Relation" in line and "l_orderkey" in line]) <= 2, name


def test_intake_reads_pages_once(spark):
    """The prices need the records twice; the pages are read before, into a stored table."""
    for name in ("intake_prices", "intake_products", "intake_counts", "intake_waiting"):
        assert "MapInArrow" not in catalogue.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString(), name
