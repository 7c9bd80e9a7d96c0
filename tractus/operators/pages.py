"""Pages of a stored, ordered table.

``table_page`` sorts for every page and keeps all rows before it.  A served
table is written once here, as ranges of the sort order, with a small table of
the ranges' row counts and first places.  A page then reads the one range (or
the few) that holds it, however deep it lies.

Cases: nulls come first in ascending order, last in descending; rows
equal in all sort columns keep one stored order, and many of them are spread over
several ranges; an empty table has empty pages; a page behind the end is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from tractus.operators.serve import PAGE_SIZE

#: Rows of a range, about: what one task sorts and what reading a page costs.
RANGE_ROWS = 100_000
_RANGE, _TIE = "_range", "_tie"


def _order(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc_nulls_first() if asc else F.col(c).desc_nulls_last() for c, asc in order] + [F.col(_TIE)]


def write_pages(df: DataFrame, path: str, order: list[tuple[str, bool]], range_rows: int = RANGE_ROWS) -> str:
    """Writes ``df`` below ``path``: ``rows``, partitioned by range, and ``ranges``
    (_range, first, n).  ``order``: (column, ascending)."""
    spark = df.sparkSession
    n = max(1, -(-df.count() // range_rows))
    # the tie makes every row distinct, so that a value which a third of the rows hold fills several ranges
    (df.withColumn(_TIE, F.monotonically_increasing_id())
     .repartitionByRange(n, *_order(order)).sortWithinPartitions(*_order(order))
     .withColumn(_RANGE, F.spark_partition_id()).write.mode("overwrite").partitionBy(_RANGE).parquet(f"{path}/rows"))
    stored = _rows(spark, path, StructType(df.schema.fields)).groupBy(_RANGE).agg(F.count(F.lit(1)).alias("n"))
    # one row per range reaches this window
    first = F.coalesce(F.sum("n").over(Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stored.select(_RANGE, first.alias("first"), "n").write.mode("overwrite").parquet(f"{path}/ranges")
    return path


def _rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    full = StructType(list(schema.fields)).add(_TIE, LongType()).add(_RANGE, IntegerType())
    return spark.read.schema(full).parquet(f"{path}/rows")


def ranges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{_RANGE} int, first long, n long").parquet(f"{path}/ranges")


def read_page(spark: SparkSession, path: str, schema: StructType | str, order: list[tuple[str, bool]], page: int = 0,
              page_size: int = PAGE_SIZE) -> DataFrame:
    """One page of a table that ``write_pages`` wrote, with the ``position`` of each row (from
    0).  At most ``page_size`` range rows reach the driver, as a range holds one row at least."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    low, high = page * page_size, (page + 1) * page_size
    held = ranges(spark, path).where((F.col("first") < high) & (F.col("first") + F.col("n") > low)).collect()
    start = min((r.first for r in held), default=0)
    rows = _rows(spark, path, schema).where(F.col(_RANGE).isin([r[_RANGE] for r in held]) if held else F.lit(False))
    w = Window.orderBy(F.col(_RANGE), *_order(order))
    paged = rows.orderBy(F.col(_RANGE), *_order(order)).offset(max(low - start, 0)).limit(page_size)
    return paged.withColumn("position", F.row_number().over(w).cast("long") - 1 + max(low, start)).drop(_TIE, _RANGE)


def n_pages(spark: SparkSession, path: str, page_size: int = PAGE_SIZE) -> int:
    total = ranges(spark, path).agg(F.sum("n")).first()[0] or 0
    return -(-total // page_size)
