"""The serving view of a ranked level table (O3-O5, F2, F3, P10,
T4, K5, A6-A8).

Everything that leaves the cluster is bounded by the requested N or the
page size; aggregates for the map (domain, extent, clusters) run as
ordinary grouped aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractus.functions.columns import tooltip
from tractus.operators.columns import title_header
from tractus.sinks.features import point_feature

# Fixed values of the dashboard.
SERVE_SIZES = (20, 50, 100, 200, 500)
DEFAULT_N = 20
PAGE_SIZE = 10
HIDDEN_COLUMNS = ("lat", "lon", "description")
#: Degrees are summed as decimals, so that means do not depend on the order of the points.
POSITION = "decimal(24,12)"


def top_n(ranked: DataFrame, name: str, n: int = DEFAULT_N,
          required: list[str] | None = None) -> DataFrame:
    """O3 + F2: the n best rows by rank (name breaks rank ties), THEN drop
    rows with a NULL in a required column (default: any) - so fewer than n rows
    may come back.  A level without descriptions does not require one."""
    return ranked.orderBy(F.col("rank").asc_nulls_last(), F.col(name).asc_nulls_first()) \
        .limit(n).na.drop("any", subset=required)


def with_tooltip(df: DataFrame, name: str, description: str | None = "description") -> DataFrame:
    """T4: ``name <br> description`` (levels without a description show
    the name only)."""
    d = description if description in df.columns else None
    return df.withColumn("tooltip", tooltip(name, d))


def serve_top_n(ranked: DataFrame, name: str, n: int = DEFAULT_N, described: bool = True) -> DataFrame:
    """C6 table rows: top n, complete rows only, with tooltip.  ``described``
    False: a level without descriptions (the census tracts), whose rows
    are complete with name, rank and point and whose tooltip is the name."""
    if described:
        return with_tooltip(top_n(ranked, name, n), name)
    top = top_n(ranked, name, n, [name, "rank", "lat", "lon"])
    return with_tooltip(top, name, None)


def table_page(df: DataFrame, name: str, predicate: Column | str | None = None,
               sort: list[tuple[str, bool]] | None = None, page: int = 0,
               page_size: int = PAGE_SIZE,
               hidden: tuple[str, ...] = HIDDEN_COLUMNS) -> DataFrame:
    """F3 + O4 + O5 + P10: user filter, multi-column sort (name as the
    final tie-break), one page, display header."""
    if predicate is not None:
        df = df.filter(F.expr(predicate) if isinstance(predicate, str) else predicate)
    order = [F.col(c).asc_nulls_first() if asc else F.col(c).desc_nulls_last()
             for c, asc in (sort or [("rank", True)])]
    order.append(F.col(name).asc_nulls_first())
    paged = df.orderBy(*order).offset(page * page_size).limit(page_size)
    return title_header(paged, hidden)


def features(df: DataFrame, name: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """K5: (name, GeoJSON Point feature) per row."""
    return df.select(name, point_feature(df, lat, lon).alias("feature"))


def domain_extent(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """A6 + A7: colour domain 0..max(rank) and the bounding box."""
    return df.agg(F.lit(0).alias("vmin"), F.max("rank").alias("vmax"),
                  F.min(lat).alias("south"), F.max(lat).alias("north"),
                  F.min(lon).alias("west"), F.max(lon).alias("east"),
                  F.count(F.lit(1)).alias("n"))


def _cells(df: DataFrame, cell: float, lat: str, lon: str, value: str) -> DataFrame:
    """Per grid cell: points, valued points and the sums of value, latitude and longitude."""
    return (df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
            .groupBy(F.floor(F.col(lon) / F.lit(cell)).alias("cell_x"),
                     F.floor(F.col(lat) / F.lit(cell)).alias("cell_y"))
            .agg(F.count(F.lit(1)).alias("point_count"), F.count(value).alias("_n"), F.sum(value).alias("_value"),
                 *[F.sum(F.col(c).cast(POSITION)).alias(a) for c, a in ((lat, "_lat"), (lon, "_lon"))]))


def _means(cells: DataFrame) -> list[Column]:
    n = F.col("point_count")
    return [n, F.try_divide(F.col("_value").cast("double"), F.col("_n").cast("double")).alias("mean_value"),
            (F.col("_lat").cast("double") / n).alias("lat"), (F.col("_lon").cast("double") / n).alias("lon")]


def grid_clusters(df: DataFrame, zoom: int, lat: str = "lat", lon: str = "lon",
                  value: str = "rank") -> DataFrame:
    """Points clustered on a grid of 360 / 2^zoom degrees; per cell the
    point count, the mean value (the client's cluster colour; points without a value are
    left out of it) and the mean position.  Positions, whole numbers and decimals are summed exactly."""
    cells = _cells(df, 360.0 / (2 ** zoom), lat, lon, value)
    return cells.select("cell_x", "cell_y", *_means(cells))


def grid_cluster_pyramid(df: DataFrame, zooms: list[int], lat: str = "lat", lon: str = "lon",
                         value: str = "rank") -> DataFrame:
    """A8 for every zoom level of a map, from the finest up: points are grouped once, at the
    finest zoom, and coarser cells are sums of these cells, as cells nest.  The
    points are read and shuffled (after partial sums) once, whatever the number of levels; each
    occupied fine cell, not each point, is repeated per level."""
    finest = max(zooms)
    cells = _cells(df, 360.0 / (2 ** finest), lat, lon, value)
    level = F.explode(F.lit(sorted(zooms)).cast("array<int>"))
    sums = [F.sum(c).alias(c) for c in ("point_count", "_n", "_value", "_lat", "_lon")]
    shift = lambda c: F.call_function("shiftright", F.col(c), F.lit(finest) - F.col("zoom")).alias(c)
    up = (cells.select("*", level.alias("zoom")).select("zoom", shift("cell_x"), shift("cell_y"), "point_count", "_n", "_value", "_lat", "_lon")
          .groupBy("zoom", "cell_x", "cell_y").agg(*sums))
    return up.select("zoom", "cell_x", "cell_y", *_means(up))
