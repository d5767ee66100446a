"""Every registered query of the engine's own operators against DuckDB."""

import duckdb
import pytest

from strandlake.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels conversations pages".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", catalogue.ORACLES)
def test_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), duck.sql(catalogue.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True).fillna(-9) for x in (got, want))
    assert len(got) == len(want)
    assert (got.values == want.values).all()


@pytest.mark.parametrize("name", ["a15_density", "j09_mask", "j10_overlap_semi", "j07_nearest"])
def test_range_plans_have_no_nested_loop(spark, name):
    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
