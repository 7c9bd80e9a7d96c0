"""Percent rank of a column, exact, with one plan at every size.

``percent_rank`` = (rows strictly before in the order) / (n - 1), ties equal, 0
for a one-row peer set.  Null placement follows Spark: an ascending order
puts NULLs first, a descending order puts them last, and NULLs tie with each
other; NaN is above every number.

The rank of a row depends on its value alone, so rows are first counted per
(group, value) with partial sums in the tasks: a value that a third of all rows
carry becomes one counted row.  The counted values are laid out by a
range partitioning on (group, value) - each value once, so ranges are even -
and numbered by the range they are in.  Three sums give a value's rank:
the counts before it inside its range (a window per range and group), the counts
of its group in the ranges before (a window over at most one row per range
and group), and the group's total.  Ranks are joined back on (group, value).

Any orderable type works (wide integers, decimals, strings): values are only
compared, never cast.  The counted values are written to the shared folder
once, so the range of a value is the same however often a task is repeated.
``percent_rank_window`` is the built-in window, which sorts a peer set in
one task; it is the reference of the tests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tractus.session import materialize


def _order(c: Column, ascending: bool) -> Column:
    return c.asc_nulls_first() if ascending else c.desc_nulls_last()


def percent_rank_window(df: DataFrame, value: str, out: str, ascending: bool = True,
                        by: list[str] | None = None) -> DataFrame:
    """Built-in ``percent_rank().over(partitionBy(by).orderBy(value))``."""
    order = _order(F.col(value), ascending)
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(order)
    return df.withColumn(out, F.percent_rank().over(w))


def _same(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> Column:
    """NULL-safe equality of the key pairs (a NULL group is a group)."""
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in keys])


def value_ranks(df: DataFrame, value: str, ascending: bool = True, by: list[str] | None = None,
                ranges: int | None = None) -> DataFrame:
    """(_g0.., _v, _pr): the percent rank of every distinct (group, value).

    ``ranges``: number of ranges of distinct values (default: the
    session's shuffle partitions)."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = [f"_g{i}" for i in range(len(by or []))]
    counted = (df.select(*[F.col(c).alias(g) for c, g in zip(by or [], groups)], F.col(value).alias("_v"))
               .groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_n")))
    order = [F.col(g).asc_nulls_first() for g in groups] + [_order(F.col("_v"), ascending)]
    laid = materialize(counted.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()),
                       "value-counts")

    before = Window.unboundedPreceding, -1
    inside = Window.partitionBy("_range", *groups).orderBy(_order(F.col("_v"), ascending)).rowsBetween(*before)
    local = laid.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    group = Window.partitionBy(*groups)
    totals = (laid.groupBy("_range", *groups).agg(F.sum("_n").alias("_t"))
              .select(F.col("_range").alias("_r"), *[F.col(g).alias(f"{g}r") for g in groups],
                      F.coalesce(F.sum("_t").over(group.orderBy("_range").rowsBetween(*before)), F.lit(0)).alias("_off"),
                      F.sum("_t").over(group).alias("_all")))
    ranked = local.join(totals, _same(local, totals, [("_range", "_r"), *[(g, f"{g}r") for g in groups]]))
    rank = F.when(F.col("_all") > 1, (F.col("_off") + F.col("_in")).cast("double")
                  / (F.col("_all") - 1).cast("double")).otherwise(F.lit(0.0))
    return ranked.select(*groups, "_v", rank.alias("_pr"))


def percent_rank(df: DataFrame, value: str, out: str, ascending: bool = True,
                 by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with its percent rank as column ``out``.

    Callers should materialize an expensive input first: it is read for
    the counts and for the rows."""
    ranks = value_ranks(df, value, ascending, by, ranges)
    keys = [(c, f"_g{i}") for i, c in enumerate(by or [])] + [(value, "_v")]
    joined = df.join(ranks, _same(df, ranks, keys))
    return joined.select(*[df[c] for c in df.columns if c != out], F.col("_pr").alias(out))
