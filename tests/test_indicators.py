from __future__ import annotations

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from emporia.operators import kpi, topk
from emporia.sources.star import sales
from emporia.sources.store import work_table


@pytest.mark.parametrize("n", [1, 2, 3, 10, 999, 1000, 5001])
def test_exact_median(spark, n):
    rng = random.Random(n)
    values = [rng.choice([1.5, 1.5, rng.uniform(0, 100)]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert kpi.exact_median(df, "v").first()[0] == statistics.median(values)


def test_median_of_nothing(spark):
    assert kpi.exact_median(spark.createDataFrame([], "v double"), "v").first()[0] is None


def test_median_of_many_equal_values(spark):
    df = spark.range(9000).select(F.when(F.col("id") < 6000, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    assert kpi.exact_median(df, "v").first()[0] == 5.0


def test_monthly_series_fills_gaps(spark):
    rows = [("a", dt.date(2020, 11, 30), 1.0), ("a", dt.date(2020, 11, 2), 2.0), ("a", dt.date(2021, 2, 1), 4.0),
            ("b", dt.date(2020, 1, 1), 8.0), (None, dt.date(2020, 1, 1), 9.0)]
    fact = spark.createDataFrame(rows, "product_name string, purchase_date date, revenue double")
    found = {(r.series_key, str(r.ds)): r.y for r in kpi.monthly_series(fact, "product_name").collect()}
    assert found == {
        ("a", "2020-11-01"): 3.0, ("a", "2020-12-01"): 0.0, ("a", "2021-01-01"): 0.0, ("a", "2021-02-01"): 4.0,
        ("b", "2020-01-01"): 8.0,
    }
    total = kpi.monthly_series(fact).agg(F.count("*"), F.sum("y")).first()
    assert tuple(total) == (14, 24.0)


def test_customer_features_without_quantity(spark):
    fact = spark.createDataFrame(
        [("a", 10.0, 0.0), ("b", 1.0, 2.0), ("c", 5.0, 1.0), (None, 99.0, 1.0)],
        "client_id string, total_price double, quantity double",
    )
    rows = {r.client_id: (r.mean_spend, r.high_value) for r in kpi.customer_features(fact).collect()}
    assert rows == {"a": (None, 1), "b": (0.5, 0), "c": (5.0, 0)}


def test_null_keys_are_left_out(spark):
    fact = spark.createDataFrame(
        [("T", "c1", 1.0), (None, "c2", 2.0), ("T", "c1", 3.0)], "delegation string, client_id string, revenue double"
    )
    assert [tuple(r) for r in kpi.clients_by_delegation(fact).collect()] == [("T", 1)]
    assert [tuple(r) for r in topk.top_delegations(fact).collect()] == [("T", 4.0)]


def test_breakdowns_sum_to_the_total(spark, folder):
    fact = work_table(sales(spark, folder))
    total = round(kpi.total_sales(fact).first()[0], 2)
    for table in (
        kpi.revenue_by_category(fact), kpi.revenue_by_brand(fact), kpi.revenue_by_quarter(fact),
        kpi.revenue_by_month(fact), kpi.revenue_by_season(fact),
        kpi.monthly_series(fact, "product_name").withColumnRenamed("y", "revenue"),
    ):
        assert round(table.agg(F.sum("revenue")).first()[0], 2) == total


@pytest.mark.parametrize("n", [3, 1500])
def test_ranking_for_small_and_large_n(spark, n):
    df = spark.range(4000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 4001).alias("v"))
    ranked = topk.ranked_within(df, ["g"], [F.desc("v")], n).collect()
    for g in (0, 1):
        expected = sorted((i * 7919 % 4001 for i in range(g, 4000, 2)), reverse=True)[:n]
        assert [r.v for r in sorted(ranked, key=lambda r: r["rank"]) if r.g == g] == expected


def test_ranking_is_trimmed_before_the_shuffle(spark, folder):
    plan = topk.top_products_per_delegation(sales(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_columns_are_pruned(spark, folder):
    plan = topk.top_products_by_revenue(sales(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert "struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan.replace("\n", "")
    assert "TakeOrderedAndProject" in plan


def test_insights_leave_out_nulls(spark):
    fact = spark.createDataFrame(
        [("a", None, "T"), ("b", None, "S"), ("b", "x", None), (None, None, None)],
        "product_name string, category string, delegation string",
    )
    assert tuple(topk.auto_insights(fact).first()) == ("b", "x", "S", 4)


def test_accounts(spark):
    df = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 5), None), (2, dt.datetime(2024, 1, 9), dt.datetime(2024, 2, 1))],
        "id long, created_at timestamp, last_login timestamp",
    )
    assert tuple(kpi.account_stats(df).first()) == (2, 1)
    assert [tuple(r) for r in kpi.signups_by_month(df).collect()] == [("2024-01", 2)]


@pytest.mark.parametrize("values", [
    [5.0] * 400, [float(i) for i in range(999)], [0.0] * 50 + [1e9] * 50, [i * 1e-9 for i in range(300)] + [1e9 + i for i in range(300)],
    [-3.5, None, 2.0], [1.0, 2.0], [float("nan"), 1.0, 7.0, 9.0], [1e300, -1e300, 0.5, 0.25], [2.0**i for i in range(300)],
])
def test_median_by_refined_histograms(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = [v for v in values if v is not None and v == v]
    assert kpi.exact_median(df, "v", cells=8, few=4).first()[0] == statistics.median(known)
