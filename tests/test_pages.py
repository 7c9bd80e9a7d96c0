"""Pages of a stored, ordered table."""

import random

import pytest
from pyspark.sql import functions as F

from tractus.operators.pages import n_pages, ranges, read_page, write_pages
from tractus.session import scratch_dir

SCHEMA = "score double, name string, k int"
ORDER = [("score", False), ("name", True)]


def _table(spark, n, seed=3):
    r = random.Random(seed)
    rows = [(None if i % 17 == 0 else float(r.randrange(40)), None if i % 29 == 0 else f"n{r.randrange(500)}", i) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_pages_follow_the_order(spark):
    rows, df = _table(spark, 1000)
    path = write_pages(df, scratch_dir(spark, "pages"), ORDER, range_rows=90)
    want = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] is not None, x[1] or ""))
    seen = []
    assert n_pages(spark, path, 130) == 8
    for p in range(9):
        got = read_page(spark, path, SCHEMA, ORDER, p, 130).orderBy("position").collect()
        assert [g.position for g in got] == list(range(130 * p, min(130 * p + 130, 1000)))
        assert [(g.score, g.name) for g in got] == [x[:2] for x in want[130 * p:130 * p + 130]]
        seen += [g.k for g in got]
    assert sorted(seen) == list(range(1000))


def test_equal_rows_fill_several_ranges(spark):
    df = spark.range(5000).select(F.lit(1.0).alias("score"), F.lit("x").alias("name"), F.lit(1).alias("k"))
    path = write_pages(df, scratch_dir(spark, "pages"), ORDER, range_rows=500)
    assert ranges(spark, path).agg(F.max("n")).first()[0] < 1500
    assert read_page(spark, path, SCHEMA, ORDER, 499, 10).count() == 10 and read_page(spark, path, SCHEMA, ORDER, 500, 10).count() == 0


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables(spark, n):
    path = write_pages(_table(spark, n)[1], scratch_dir(spark, "pages"), ORDER)
    assert n_pages(spark, path) == n and read_page(spark, path, SCHEMA, ORDER).count() == n


def test_a_deep_page_reads_one_range(spark):
    df = spark.range(100_000).select((-F.col("id")).cast("double").alias("score"), F.col("id").cast("string").alias("name"), F.col("id").cast("int").alias("k"))
    path = write_pages(df, scratch_dir(spark, "pages"), ORDER, range_rows=2_000)
    page = read_page(spark, path, SCHEMA, ORDER, 9_000)
    assert [r.k for r in page.orderBy("position").collect()] == list(range(90_000, 90_010))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_range" in plan
    assert len(page.inputFiles()) > 1   # the whole table, before pruning
    kept = ranges(spark, path).where("first <= 90000 and first + n > 90000").first()
    assert kept.n < 8_000
