"""GeoJSON feature layers.

Features are read one per line (the layout written by
``tractus.sinks.features``), so a layer is split across tasks like any
JSON-lines file; FeatureCollection documents are read with
``collection=True`` (``tractus.sources.collection``: many tasks per document).

The geometry's ``coordinates`` are read as raw JSON text and parsed by
geometry type into the nested struct form used by the geo operators:
Polygon / MultiPolygon -> parts > rings > points{x, y}; Point -> a
``point`` struct column.  Shapefile decoding is not provided.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tractus.functions.geometry import GEOMETRY_TYPE


def feature_schema(properties: StructType) -> StructType:
    geom = StructType([StructField("type", StringType()), StructField("coordinates", StringType())])
    return StructType([StructField("type", StringType()),
                       StructField("geometry", geom),
                       StructField("properties", properties)])


def _to_pts(arr):
    return F.transform(arr, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def read_features(spark: SparkSession, path: str, properties: StructType | str,
                  collection: bool = False) -> DataFrame:
    """Properties as columns, plus ``geometry`` (polygonal, nested) and
    ``point`` (struct<x, y>, for Point features)."""
    if isinstance(properties, str):
        properties = StructType.fromDDL(properties)
    if collection:
        from tractus.sources.collection import read_collection
        return read_collection(spark, path, properties)
    return geometry_columns(spark.read.schema(feature_schema(properties)).option("mode", "FAILFAST").json(path))


def geometry_columns(df: DataFrame) -> DataFrame:
    """Parsed features -> properties, ``geometry`` and ``point``."""
    gtype = F.col("geometry.type")
    coords = F.col("geometry.coordinates")
    poly = F.from_json(coords, "array<array<array<double>>>")
    multi = F.from_json(coords, "array<array<array<array<double>>>>")
    pt = F.from_json(coords, "array<double>")
    geometry = (F.when(gtype == "Polygon", F.array(F.transform(poly, _to_pts)))
                .when(gtype == "MultiPolygon",
                      F.transform(multi, lambda part: F.transform(part, _to_pts)))
                .cast(GEOMETRY_TYPE))
    point = F.when(gtype == "Point", F.struct(pt[0].alias("x"), pt[1].alias("y")))
    return df.select("properties.*", geometry.alias("geometry"), point.alias("point"))
