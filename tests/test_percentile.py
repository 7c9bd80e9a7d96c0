"""Percent rank against the built-in window."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tractus.operators.percentile import percent_rank, percent_rank_window, value_ranks


def _vals(df, col="p"):
    return [r[col] for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("fn", [percent_rank_window, percent_rank,
                                lambda d, v, o, a: percent_rank(d, v, o, a, ranges=3)])
def test_edge_frame_nulls_and_ties(spark, fn):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, None), (5, None)], "id int, v double")
    assert _vals(fn(df, "v", "p", False)) == [0.5, 0.0, 0.0, 0.75, 0.75]
    assert _vals(fn(df, "v", "p", True)) == [0.5, 0.75, 0.75, 0.0, 0.0]


def test_one_row_is_zero(spark):
    df = spark.createDataFrame([(1, 1.0)], "id int, v double")
    assert _vals(percent_rank(df, "v", "p", True)) == [0.0]
    assert _vals(percent_rank_window(df, "v", "p", True)) == [0.0]


def test_all_null_and_constant(spark):
    df = spark.createDataFrame([(i, None) for i in range(4)], "id int, v double")
    assert _vals(percent_rank(df, "v", "p", False, ranges=4)) == [0.0] * 4
    df = spark.createDataFrame([(i, 7.0) for i in range(4)], "id int, v double")
    assert _vals(percent_rank(df, "v", "p", True, ranges=4)) == [0.0] * 4


values = st.one_of(st.none(), st.just(float("nan")), st.integers(-5, 5).map(float),
                   st.floats(-1e6, 1e6, allow_nan=False))


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(values, st.sampled_from(["a", "b", None])), min_size=1, max_size=60),
       asc=st.booleans(), grouped=st.booleans(), buckets=st.integers(1, 9))
def test_distributed_equals_builtin(spark, rows, asc, grouped, buckets):
    df = spark.createDataFrame([(i, v, g) for i, (v, g) in enumerate(rows)], "id int, v double, g string")
    by = ["g"] if grouped else None
    a = _vals(percent_rank_window(df, "v", "p", asc, by))
    b = _vals(percent_rank(df, "v", "p", asc, by, ranges=buckets))
    assert len(a) == len(b) == len(rows)
    assert all(x == y or (math.isnan(x) and math.isnan(y)) for x, y in zip(a, b))


@pytest.mark.parametrize("kind", ["double", "bigint", "decimal(20,4)", "string"])
def test_skewed_value_stays_exact(spark, kind):
    """Half of the rows carry one value, of any type: it is one counted row."""
    df = spark.range(4000).select(
        F.col("id"), F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") % 101).cast(kind).alias("v"))
    a = percent_rank_window(df, "v", "p", False)
    b = percent_rank(df, "v", "q", False, ranges=16)
    assert a.join(b.select("id", "q"), "id").filter(F.col("p") != F.col("q")).count() == 0
    assert value_ranks(df, "v", ranges=16).count() == 101


def test_no_single_partition_over_rows(spark):
    """Only the totals, a row per range, may meet in one task."""
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 1237).cast("double").alias("v"))
    out = percent_rank(df, "v", "p", True, ranges=8)
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    singles = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert singles
    for i in singles:
        assert "HashAggregate(keys=[_range" in lines[i + 1], lines[i + 1]
    builtin = percent_rank_window(df, "v", "p", True)
    assert "SinglePartition" in builtin._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("by", [None, ["g"]])
def test_many_buckets_equal_builtin(spark, by):
    df = spark.range(20000).select(F.col("id").cast("int").alias("id"),
                                   ((F.col("id") * 7919) % 5003).cast("double").alias("v"),
                                   (F.col("id") % 3).cast("string").alias("g"))
    a = percent_rank_window(df, "v", "p", False, by)
    b = percent_rank(df, "v", "q", False, by, ranges=1024)
    assert a.join(b.select("id", "q"), "id").filter(F.col("p") != F.col("q")).count() == 0


@pytest.mark.parametrize("asc", [True, False])
def test_grouped_heavy_nan_null_equal_builtin(spark, asc):
    rows = []
    for i in range(6000):
        g = ["a", "b", None][i % 3]
        v = 7.0 if i % 4 == 0 else (float("nan") if i % 11 == 0 else (None if i % 13 == 0 else float(i % 97)))
        rows.append((i, v, g))
    df = spark.createDataFrame(rows, "id int, v double, g string")
    a = percent_rank_window(df, "v", "p", asc, ["g"])
    b = percent_rank(df, "v", "q", asc, ["g"], ranges=8)
    j = a.join(b.select("id", "q"), "id")
    assert j.count() == 6000
    assert j.filter(~((F.col("p") == F.col("q")) | (F.isnan("p") & F.isnan("q")))).count() == 0


def test_wide_integers_are_not_merged_by_double_cast(spark):
    big = 2 ** 60
    rows = [(i, big + (i % 3)) for i in range(300)]      # three values, one double
    df = spark.createDataFrame(rows, "id int, v bigint")
    a = percent_rank_window(df, "v", "p", True)
    b = percent_rank(df, "v", "q", True, ranges=4)
    assert a.join(b.select("id", "q"), "id").filter(F.col("p") != F.col("q")).count() == 0
