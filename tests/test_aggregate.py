from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from merchantry.operators import aggregate, prep


def test_null_keys_belong_to_no_group(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("a", None)], "k string, v int")
    assert [tuple(r) for r in aggregate.sum_by(df, ["k"], "v").collect()] == [("a", 1)]


def test_sum_of_nothing_is_zero(spark):
    df = spark.createDataFrame([("a", None)], "k string, v int")
    assert aggregate.sum_by(df, ["k"], "v").first()["v"] == 0


def test_spread_stats_on_known_sample(spark):
    df = spark.createDataFrame([("z", float(v)) for v in (1, 2, 2, 3, 10, 25)], "k string, v double")
    row = aggregate.spread_stats(df, ["k"], "v").first()
    assert (row["variance"], row["skew"], row["kurt"], row["iqr"]) == (86.97, 1.89, 3.41, 6.25)
    assert (row["minimum"], row["maximum"]) == (1.0, 25.0)


def test_spread_of_few_values_has_no_moments(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0), ("c", 1.0), ("c", 2.0), ("c", 4.0)],
                               "k string, v double")
    rows = {r["k"]: r for r in aggregate.spread_stats(df, ["k"], "v").collect()}
    assert rows["a"]["std_dev"] is None and rows["b"]["skew"] is None and rows["c"]["kurt"] is None
    assert rows["c"]["skew"] is not None


@pytest.mark.parametrize("accuracy", [50, 1000])
def test_quantiles_are_exact_for_hot_and_repetitive_groups(spark, accuracy):
    rng = random.Random(3)
    groups = {
        "hot": [rng.gauss(0, 1000) for _ in range(5000)],
        "copies": [rng.choice([1.0, 2.0, 2.0, 2.0, 900.0]) for _ in range(3000)],
        "tail": [rng.paretovariate(0.5) for _ in range(2000)],
        "one": [7.5],
        "two": [1.0, 2.0],
    }
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    wanted = {"low": 0.0, "q1": 0.25, "mid": 0.5, "q99": 0.99, "high": 1.0}
    got = {r["k"]: r for r in aggregate.quantiles_by(df, ["k"], "v", wanted, accuracy).collect()}
    for key, vs in groups.items():
        for name, q in wanted.items():
            assert got[key][name] == pytest.approx(np.quantile(vs, q), rel=1e-12), (key, name)


def test_row_mean_skips_zero_cells(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 4.0), ("a", 8.0), ("b", 0.0)], "k string, v double")
    got = {r["k"]: r["average"] for r in aggregate.row_mean_nonzero(df, ["k"], "v").collect()}
    assert got == {"a": 6.0, "b": None}


def test_coercions(spark):
    df = spark.createDataFrame([("x", "12.5", "2001-02-03"), ("y", "abc", "nope")], "k string, v string, date string")
    numbers = {r["k"]: r["v"] for r in prep.coerce_numeric(df, ["k", "date"]).collect()}
    assert numbers == {"x": 12.5, "y": None}
    assert [r["k"] for r in prep.coerce_dates(df).collect()] == ["x"]


def test_empty_selection_keeps_everything(spark):
    df = spark.createDataFrame([(1,), (2,)], "v int")
    assert prep.filter_in(df, "v", []).count() == 2
    assert prep.filter_in(df, "v", None).count() == 2
    assert prep.filter_in(df, "v", [2]).count() == 1


def test_unknown_filter_is_an_error(spark):
    df = spark.createDataFrame([(1,)], "year int")
    with pytest.raises(ValueError):
        prep.cascading_filters(df, df, {"colour": ["red"]})


def test_quantile_plan_has_no_unbounded_collect(spark):
    df = spark.range(10).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v"))
    plan = aggregate.quantiles_by(df, ["k"], "v", {"m": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "percentile(" not in plan


def test_quantiles_of_one_group_of_a_million_values(spark):
    # 7919 is prime to 1,000,003, so every value below it occurs once.
    df = spark.range(1_000_003).select(F.lit("a").alias("k"), ((F.col("id") * 7919) % 1_000_003).cast("double").alias("v"))
    wanted = {"q1": 0.25, "mid": 0.5, "q999": 0.999}
    got = aggregate.quantiles_by(df, ["k"], "v", wanted).first()
    for name, q in wanted.items():
        assert got[name] == pytest.approx(q * 1_000_002, rel=1e-12)


def test_quantiles_of_infinite_missing_and_huge_values(spark):
    inf, nan = float("inf"), float("nan")
    groups = {"ends": [-inf, 1.0, 2.0, inf], "nan": [1.0, 2.0, nan], "wide": [-1.7e308, 0.0, 5e-324, 1.7e308],
              "null": [None, 3.0, None], "same": [4.0] * 7, "none": [None], "inf": [inf, inf, inf]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r["k"]: r for r in aggregate.quantiles_by(df, ["k"], "v", {"low": 0.0, "mid": 0.5, "high": 1.0}, 4).collect()}
    assert "none" not in got
    assert tuple(got["ends"][1:]) == (-inf, 1.5, inf)
    assert got["nan"]["low"] == 1.0 and got["nan"]["mid"] == 2.0 and np.isnan(got["nan"]["high"])
    assert (got["wide"]["low"], got["wide"]["high"]) == (-1.7e308, 1.7e308) and got["wide"]["mid"] <= 5e-324
    assert tuple(got["null"][1:]) == (3.0, 3.0, 3.0) and tuple(got["same"][1:]) == (4.0, 4.0, 4.0)
    assert tuple(got["inf"][1:]) == (inf, inf, inf)
