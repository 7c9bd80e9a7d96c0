"""A polygon or point layer stored so that an extent reads a part of it.

Each feature gets its bounding box and a sort key: the level of its size (halvings
of the layer's extent, down to the side of an average range), then the place of its centre on a Z-order curve.  The layer
is written in ranges of that order, so a range holds neighbours of like size,
and a few large features do not widen the boxes of the small ones.  A table with
one row per range holds the ranges' boxes.

An extent query semi-joins the features to the ranges that meet the extent, which Spark
turns into partition pruning at run time while it finds their table small enough to broadcast;
inside a range the conditions on the four box columns reach the Parquet scan and prune
row groups.

Cases: boxes that touch the extent belong to it; features without a geometry, without points or with NaN
coordinates are stored with null boxes and meet no extent; equal features fill several
ranges; a layer of one point is one range, an empty one has none; box columns of the layer's
own are refused.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

BOX = ["xmin", "ymin", "xmax", "ymax"]
RANGE_ROWS = 100_000
#: Bits of the curve per axis.
BITS = 16
_RANGE, _SIZE, _PLACE, _TIE = "_range", "_size", "_place", "_tie"


def bounds(geometry: str | Column = "geometry") -> list[Column]:
    """xmin, ymin, xmax, ymax of a nested polygon geometry, evaluated inside the row."""
    g = F.col(geometry) if isinstance(geometry, str) else geometry
    points = F.flatten(F.flatten(g))

    def least(axis: str, pick) -> Column:
        v = pick(F.transform(points, lambda p: p[axis]))
        bad = F.exists(points, lambda p: F.isnan(p["x"]) | F.isnan(p["y"]) | p["x"].isNull() | p["y"].isNull())
        return F.when(~bad, v)

    return [least("x", F.array_min).alias("xmin"), least("y", F.array_min).alias("ymin"),
            least("x", F.array_max).alias("xmax"), least("y", F.array_max).alias("ymax")]


def _spread(v: Column) -> Column:
    """The bits of a 16-bit number on every other place."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def _place(low: str, high: str, start: float, length: float) -> Column:
    share = ((F.col(low) + F.col(high)) / 2 - F.lit(start)) / F.lit(length)
    return F.floor(share * (2 ** BITS - 1)).cast("long")


def write_layer(layer: DataFrame, path: str, geometry: str = "geometry", range_rows: int = RANGE_ROWS) -> str:
    """Writes ``rows`` (the layer with its boxes, partitioned by range) and ``ranges`` (box and row count of each)."""
    clash = {c.lower() for c in layer.columns} & {*BOX, _RANGE, _SIZE, _PLACE, _TIE}
    if clash:
        raise ValueError(f"the layer has columns {sorted(clash)} already")
    spark = layer.sparkSession
    boxed = layer.select("*", *bounds(geometry))
    whole = boxed.agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in BOX[:2]], *[F.max(c).alias(c) for c in BOX[2:]]).first()
    x0, y0 = whole.xmin or 0.0, whole.ymin or 0.0
    side = max((whole.xmax or 0.0) - x0, (whole.ymax or 0.0) - y0) or 1.0
    extent = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")) / F.lit(side)
    n = max(1, -(-whole.n // range_rows))
    # features smaller than a range of even density do not widen it: they share the finest level
    finest = min(BITS, math.ceil(math.log2(n) / 2))
    size = F.when(extent > 2.0 ** -finest, F.floor(-F.log2(extent))).when(extent.isNotNull(), F.lit(finest)).cast("int")
    curve = _spread(_place("xmin", "xmax", x0, side)).bitwiseOR(F.shiftleft(_spread(_place("ymin", "ymax", y0, side)), 1))
    order = [_SIZE, _PLACE, _TIE]
    (boxed.withColumns({_SIZE: size, _PLACE: curve, _TIE: F.monotonically_increasing_id()})
     .repartitionByRange(n, *order).sortWithinPartitions(*order).drop(*order)
     .withColumn(_RANGE, F.spark_partition_id()).write.mode("overwrite").partitionBy(_RANGE).parquet(f"{path}/rows"))
    (_rows(spark, path, StructType(layer.schema.fields)).groupBy(_RANGE)
     .agg(*[F.min(c).alias(c) for c in BOX[:2]], *[F.max(c).alias(c) for c in BOX[2:]], F.count(F.lit(1)).alias("n"))
     .write.mode("overwrite").parquet(f"{path}/ranges"))
    return path


def _rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    full = StructType(list(schema.fields))
    for c in BOX:
        full = full.add(c, DoubleType())
    return spark.read.schema(full.add(_RANGE, IntegerType())).parquet(f"{path}/rows")


def ranges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{_RANGE} int, {', '.join(f'{c} double' for c in BOX)}, n long").parquet(f"{path}/ranges")


def _meets(xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    return ((F.col("xmin") <= F.lit(float(xmax))) & (F.col("xmax") >= F.lit(float(xmin)))
            & (F.col("ymin") <= F.lit(float(ymax))) & (F.col("ymax") >= F.lit(float(ymin))))


def read_extent(spark: SparkSession, path: str, schema: StructType | str, xmin: float, ymin: float,
                xmax: float, ymax: float) -> DataFrame:
    """The features whose box meets the extent, with their boxes."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    meets = _meets(xmin, ymin, xmax, ymax)
    held = ranges(spark, path).where(meets).select(_RANGE)
    return _rows(spark, path, schema).where(meets).join(held, _RANGE, "left_semi").drop(_RANGE)
