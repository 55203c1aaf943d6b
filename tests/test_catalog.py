"""Every named query against its SQL, and the shape of the plans."""

import glob
import math
import os
import re

import duckdb
import pandas as pd
import pytest

from ledgerloom import catalog
from ledgerloom.catalog import LOADS, QUERIES
from ledgerloom.oracles import ORACLES
from ledgerloom.sources import fixture
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.sql(f"CREATE VIEW {name} AS FROM '{path}'")
    return connection


def plain(frame):
    def text(value):
        if value is None or value is pd.NaT or value is pd.NA:
            return "NULL"
        if isinstance(value, float):
            return "NULL" if math.isnan(value) else repr(float(value))
        return str(value)

    ordered = frame[sorted(frame.columns)]
    return sorted("|".join(map(text, row)) for row in ordered.itertuples(index=False))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    expected = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(got) > 0
    assert plain(got) == plain(expected)


def plan_of(spark, name):
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in LOADS])
def test_plans_have_no_pairing_of_all_rows_and_no_python(spark, name):
    plan = plan_of(spark, name)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoop|EvalPython|InPandas|InArrow", plan)


def test_reports_without_monthly_money_do_not_read_the_lines(spark):
    for name in ("status_summary", "ledger_count", "facet_values", "top_budget"):
        plan = plan_of(spark, name)
        assert ("l_extendedprice" in plan) == (name == "top_budget")
        assert name == "top_budget" or "lineitem" not in plan


def test_ranked_pages_do_not_sort_the_whole_ledger(spark):
    for name in ("top_budget", "latest_page", "first_by_id", "quality_report_lines"):
        assert "TakeOrderedAndProject" in plan_of(spark, name)


def test_reports_aggregate_before_they_shuffle(spark):
    for name in ("regional_summary", "category_budget_table", "view_budget_actual", "s_curve"):
        assert "partial_sum" in plan_of(spark, name)


def test_one_project_holding_a_third_of_the_feed_keeps_results_whole(spark, duck, tmp_path):
    """The keyed changes over a feed in which a third of all events hit one project."""
    for path in glob.glob(f"{SMALL}/*.parquet"):
        if not path.endswith("events.parquet"):
            os.symlink(path, tmp_path / os.path.basename(path))
    duck.sql(
        "COPY (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id) "
        f"FROM events) TO '{tmp_path}/events.parquet' (FORMAT parquet)"
    )
    skewed = duckdb.connect()
    for path in glob.glob(f"{tmp_path}/*.parquet"):
        skewed.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS FROM '{path}'")
    for name in ("last_operation", "set_actual", "partial_update", "cascade_delete",
                 "monitoring_constraints", "stream_apply"):
        got = QUERIES[name](spark, str(tmp_path)).toPandas()
        assert plain(got) == plain(skewed.sql(ORACLES[name]).df()), name


def test_the_ledger_comes_dealt_by_its_id(spark):
    led, keys = fixture.ledger(spark, SMALL), spark.range(10_000).selectExpr("CAST(id AS STRING) AS id_root")
    # The names of nations and regions are always few.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "3000")
    try:
        dealt, met = (
            df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
            for df in (led, led.join(keys, "id_root", "left_anti"))
        )
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Only the keys move to meet it.
    assert met == dealt + 1


def test_lines_move_before_they_are_summed(spark):
    plan = fixture.ledger(spark, SMALL)._jdf.queryExecution().executedPlan().toString().splitlines()
    sums = next(i for i, line in enumerate(plan) if "partial_sum" in line)
    assert any("REPARTITION_BY_COL" in line for line in plan[sums:])


def test_broken_events_are_left_out_without_a_join(spark):
    good = catalog._good_feed(spark, SMALL)
    assert "Join" not in good._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < good.count() < fixture.feed(spark, SMALL).count()
