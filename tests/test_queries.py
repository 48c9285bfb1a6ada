"""Registered queries against their SQL on the smallest data set."""

import importlib.util
import os

import duckdb
import pytest

from panelforge.plans.catalog import QUERIES
from panelforge.plans.market import TABLES

SF = "/root/testdata/sf0.001"
_spec = importlib.util.spec_from_file_location("check_sql", os.path.join(os.path.dirname(__file__), "..", "tools", "check_sql.py"))
check_sql = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check_sql)

SAMPLE = (
    "price_upsert_old_wins", "series_upsert", "clean_prices_chain", "merger_synthesis", "share_rates_on_prices", "sector_index",
    "sector_fundamentals", "cross_asset_features", "pca_residual_target", "train_test_sets", "ensemble_by_rank",
    "long_short_performance", "daily_numerai", "metric_suite", "monthly_return", "daily_profit_by_sector", "monthly_leveraged",
    "deposits_rolled_forward", "reduced_units", "orders_netted", "label_agreement", "distance_groups",
)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    q = QUERIES[name]
    got = q.run(spark, SF).toPandas()
    assert check_sql.compare(got, duck.execute(q.full_sql()).df()) == ""
    assert len(got)
    spark.catalog.clearCache()


def test_every_query_names_what_it_covers():
    assert all(q.covers for q in QUERIES.values())


def test_latest_row_per_key_is_trimmed_before_the_shuffle(spark):
    plan = QUERIES["full_disclosures_latest"].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_days_with_null_features_keep_their_prediction_row(spark):
    import datetime as dt
    import random

    from panelforge.plans import catalog_learning as CL
    from panelforge.plans.market import SERIES_NAMES, Market
    rng = random.Random(3)
    days = [dt.date(1999, 10, 1) + dt.timedelta(days=i) for i in range(140)]
    rows = [(d, s, None if s == "A" and d == dt.date(2000, 1, 20) else rng.gauss(0, 0.01), 100.0, 100.0 + rng.gauss(0, 1)) for d in days for s in ("A", "B")]
    market = Market(spark, SF)
    market.__dict__["index"] = spark.createDataFrame(rows, "Date date, Sector string, `1d_return` double, Open double, Close double")
    quotes = [(n, d, 100.0 + rng.gauss(0, 1)) for d in days for n in SERIES_NAMES]
    market.__dict__["series"] = spark.createDataFrame(quotes, "Name string, Date date, Close double")
    keys = {(d, s) for d in days for s in ("A", "B") if d >= dt.date(2000, 1, 1)}
    linear = {(r.Date, r.Sector): r.Pred for r in CL.sector_lasso_predictions(market).collect()}
    trees = {(r.Date, r.Sector): r.Pred for r in CL.boosted_tree_predictions(market).collect()}
    assert set(linear) == keys and set(trees) == keys
    assert None not in linear.values()  # features are carried forward over the day without a return
    assert None not in trees.values()
    assert CL.complete_inputs(market)[1].filter("Date = '2000-01-21'").count() == 1
