"""Helpers shared by the operators: reading, bounded Arrow slices, folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tractus.session import materialize, materialize_counted  # noqa: F401  (re-exported for the operators)

#: Texts handed to Python at once: rows and code points of one slice.
SLICE_ROWS = 256
#: Most bits of the table that tells rows which a join may meet from others; it is broadcast as 64-bit words.
FILTER_BITS = 1 << 25


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): other columns are dropped before any work, so that
    extra columns with clashing names never matter; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


class Memory(dict):
    """Values made on first use.  When ``limit`` new ones are held, the
    older generation goes and they become the older one, so that values in use
    stay and at most twice ``limit`` are held."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def crc_mod(col: Column | str, n: int) -> Column:
    """crc32(value as text) mod n; null for a null value."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(n)).cast("int")


def marked(rows: DataFrame, key: Column, ids: DataFrame, count: int) -> DataFrame:
    """``rows`` plus a boolean ``_may``: true wherever ``key`` is one of ``ids`` (one column, about
    ``count`` values), and for a few other rows, which the join itself must leave out; a null is none of them.

    Rows with long texts that meet nothing need no shuffle then.  The table has 8 to 16 bits for an id and never more
    than FILTER_BITS; beyond that it tells fewer rows apart, and all still hold."""
    bits = min(FILTER_BITS, max(64, 1 << (8 * count).bit_length()))

    def place(c):
        return F.pmod(F.xxhash64(c.cast("long")), F.lit(bits)).alias("_place")

    table = (ids.select(place(F.col(ids.columns[0]))).groupBy(F.expr("_place div 64").alias("_word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(_place % 64 as int)))").alias("_bits")))
    met = F.expr("coalesce(getbit(_bits, cast(_place % 64 as int)) = 1, false)")
    return (rows.withColumn("_place", place(key)).join(F.broadcast(table), F.expr("_place div 64 = _word"), "left")
            .withColumn("_may", met & key.isNotNull()).drop("_place", "_word", "_bits"))


@contextmanager
def shuffles_freed(spark: SparkSession):
    """The shuffle files behind a table written here go when it is written, not when
    the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize_freed(df: DataFrame, purpose: str) -> tuple[DataFrame, int]:
    """``materialize_counted`` with ``shuffles_freed``."""
    with shuffles_freed(df.sparkSession):
        return materialize_counted(df, purpose)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str,
               rows: int = SLICE_ROWS,
               finish: Callable[[], dict | None] | None = None) -> DataFrame:
    """``mapInArrow`` in slices of a few hundred rows, so that the Python
    objects of one slice stay small whatever the Arrow batch holds.

    ``fn`` gets a record batch and returns columns by name; ``finish``
    may add rows at the end of the partition.
    """
    from pyspark.sql.types import StructType
    arrow = _arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                out = fn(b.slice(at, rows))
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)
        if finish is not None:
            out = finish()
            if out is not None:
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
