"""K3, K5, K6: GeoJSON features and records.

Features are built per row with ``to_json(struct(...))`` on the
executors and written as text (one feature per line), so a layer of
any size streams out in parallel.  A single FeatureCollection document
is only assembled for a bounded result (the served top N).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def polygon_coordinates(geometry: str | Column = "geometry") -> Column:
    """Nested struct geometry (parts > rings > points{x,y}) -> GeoJSON
    MultiPolygon coordinates ``[[[[x, y], ...], ...], ...]``."""
    g = F.col(geometry) if isinstance(geometry, str) else geometry
    return F.transform(g, lambda part: F.transform(
        part, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))))


def polygon_feature(df: DataFrame, geometry: str = "geometry") -> Column:
    """K3: one MultiPolygon Feature per row, every other column a property."""
    props = [c for c in df.columns if c != geometry]
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("MultiPolygon").alias("type"),
                 polygon_coordinates(geometry).alias("coordinates")).alias("geometry"),
        F.struct(*props).alias("properties")))


def write_polygon_features(df: DataFrame, path: str, geometry: str = "geometry",
                           mode: str = "overwrite") -> str:
    """K3: GeoJSON features, one per line."""
    df.select(polygon_feature(df, geometry).alias("value")).write.mode(mode).text(path)
    return path


def write_collection(features: DataFrame, path: str, feature: str = "feature", name: str | None = None) -> str:
    """K3: a column of feature texts as ONE FeatureCollection document.

    The document is a folder of parts, written in parallel: the head with
    one feature, the other features each behind a comma, and the tail.  Joined
    in the order of their names (``hadoop fs -getmerge``, or the store's own
    compose) the parts are the document; ``read_collection(..., one_document=True)``
    reads the folder as it is.  Null texts are left out; features keep no order; no features: an
    empty collection.  ``name`` becomes the collection's name.
    """
    from tractus.session import materialize
    spark = features.sparkSession
    # the place of a row is written with it, so exactly one row is the first in every later job
    rows = materialize(features.where(F.col(feature).isNotNull())
                       .select(F.col(feature).alias("feature"), F.monotonically_increasing_id().alias("at")), "features")
    first = rows.agg(F.min("at")).first()[0]
    title = F.concat(F.lit('"name":'), F.substring(F.to_json(F.array(F.lit(name))), 2, 1 << 30)) if name else F.lit(None).cast("string")
    # to_json of an array of one text, without its brackets
    title = F.coalesce(F.concat(F.regexp_replace(title, r"\]$", ""), F.lit(",")), F.lit(""))
    head = rows.where(F.col("at") == F.lit(first)).agg(F.max("feature").alias("f")).select(
        F.concat(F.lit('{"type":"FeatureCollection",'), title, F.lit('"features":['), F.coalesce("f", F.lit(""))).alias("value"))
    rest = rows.where(F.col("at") != F.lit(first)).select(F.concat(F.lit(","), "feature").alias("value"))
    tail = spark.range(0, 1, 1, 1).select(F.lit("]}").alias("value"))
    head.unionByName(rest).unionByName(tail).write.mode("overwrite").text(path)
    return path


def point_feature(df: DataFrame, lat: str = "lat", lon: str = "lon") -> Column:
    """K5: lat/lon become a Point geometry ``[lon, lat]``; every other
    column becomes a property."""
    props = [c for c in df.columns if c not in (lat, lon)]
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"),
                 F.array(F.col(lon), F.col(lat)).alias("coordinates")).alias("geometry"),
        F.struct(*props).alias("properties")))


def point_features(df: DataFrame, lat: str = "lat", lon: str = "lon",
                   keep: list[str] | None = None) -> DataFrame:
    """K5 as a DataFrame: ``keep`` columns plus ``feature`` JSON text."""
    return df.select(*(keep or []), point_feature(df, lat, lon).alias("feature"))


def records(df: DataFrame, max_rows: int) -> list[dict]:
    """K6: rows as dicts for a table widget.  Refuses results larger than
    ``max_rows`` (the served N), so nothing unbounded reaches the driver."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"records(): more than {max_rows} rows")
    return [r.asDict(recursive=True) for r in rows]
