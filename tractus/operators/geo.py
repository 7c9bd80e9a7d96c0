"""Layer preparation as DataFrame jobs.

* ``project``: reproject every vertex (G1, G2).
* ``with_area`` / ``areas_by_keys``: planar area per unit and per region
  key (G3, G4).  For a non-overlapping coverage the area of a merged
  region equals the sum of its units' areas, so regions are summed by a
  grouped aggregate (partial + final) and re-attached by key; no
  geometry is merged for areas.
* ``edges`` / ``dissolve``: merged outline per key by edge cancellation
  (G5): every ring is exploded into directed edges with quantised end
  points; an edge shared by two units of the same key appears twice and
  cancels.  The grouping key includes the edge, so a state with a third
  of all units is spread over many tasks.  Valid for a noded coverage
  (shared vertices bit-equal after quantisation); overlaps over-count.
* ``interior_point`` / ``interior_point_rows``: scan-line point
  guaranteed inside the area (G6); the rows variant evaluates a whole
  geometry held in one row with higher-order functions (no shuffle),
  the edge variant works on edge tables (merged outlines).  Rule:
  the representative-point rule of the common geometry engines: scan at
  the middle between the vertex heights closest to the envelope centre,
  pair sorted edge crossings, take the middle of the widest interior
  chord (leftmost on ties), widest part wins.  Merged outlines are
  scanned as one polygon (all their rings); a region split into several
  separate parts therefore gets one scan line, not one per part.
* ``dissolve_attributes``: first attribute value per key, made
  deterministic as the value of the smallest unit id (A9).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tractus.operators.components import components

from tractus.functions.geometry import geometry_area, interior_point_expr, ring_signed_area
from tractus.functions.projection import project_geometry

DEGREE_QUANTUM = 1e-7


def project(df: DataFrame, srid: int, geometry: str = "geometry") -> DataFrame:
    """Reproject the geometry column in place."""
    return df.withColumn(geometry, project_geometry(F.col(geometry), srid))


def with_area(df: DataFrame, out: str, geometry: str = "geometry",
              scale: float = 1.0) -> DataFrame:
    """Planar area column (times ``scale``, e.g. 1e-6 for km^2)."""
    a = geometry_area(F.col(geometry))
    return df.withColumn(out, a * F.lit(scale) if scale != 1.0 else a)


def areas_by_keys(df: DataFrame, area: str, keys: dict[str, str]) -> DataFrame:
    """For each ``out -> key`` the summed area of the key, re-attached
    to every unit (one aggregate + one join per key; the aggregates
    have one row per region and are broadcast by AQE)."""
    out = df
    for out_col, key in keys.items():
        agg = df.groupBy(key).agg(F.sum(area).alias(out_col)).filter(F.col(key).isNotNull())
        out = out.join(agg, key, "left")
    return out


def _q(c: Column, quantum: float) -> Column:
    return F.round(c / F.lit(quantum)).cast("bigint")


def spread(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """The units dealt evenly over the shuffle's tasks, so that a file of few splits does not make
    few tasks hold the edges of all units."""
    width = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(width, F.xxhash64(geometry))


def edges(df: DataFrame, keys: list[str], geometry: str = "geometry",
          quantum: float = DEGREE_QUANTUM) -> DataFrame:
    """Directed edges of every ring, oriented shell counter-clockwise and
    holes clockwise: (keys, part, ring, x0, y0, x1, y1, qx0, qy0, qx1, qy1)."""
    parts = df.select(*keys, F.posexplode(geometry).alias("part", "_rings"))
    rings = parts.select(*keys, "part", F.posexplode("_rings").alias("ring", "_pts"))
    sa = ring_signed_area(F.col("_pts"))
    flip = ((F.col("ring") == 0) & (sa < 0)) | ((F.col("ring") > 0) & (sa > 0))
    pts = F.when(flip, F.reverse("_pts")).otherwise(F.col("_pts"))
    n = F.size("_pts")
    pairs = F.arrays_zip(F.slice(pts, 1, n - 1).alias("a"), F.slice(pts, 2, n - 1).alias("b"))
    e = rings.select(*keys, "part", "ring", F.explode(pairs).alias("_e"))
    return e.select(*keys, "part", "ring",
                    F.col("_e.a.x").alias("x0"), F.col("_e.a.y").alias("y0"),
                    F.col("_e.b.x").alias("x1"), F.col("_e.b.y").alias("y1"),
                    _q(F.col("_e.a.x"), quantum).alias("qx0"),
                    _q(F.col("_e.a.y"), quantum).alias("qy0"),
                    _q(F.col("_e.b.x"), quantum).alias("qx1"),
                    _q(F.col("_e.b.y"), quantum).alias("qy1"))


def dissolve(df: DataFrame, key: str, geometry: str = "geometry",
             quantum: float = DEGREE_QUANTUM) -> DataFrame:
    """Outline edges of the union of all units per key.

    Returns (key, x0, y0, x1, y1, qx0, qy0, qx1, qy1), oriented so that
    the region lies to the left of every edge.
    """
    own = df.filter(F.col(key).isNotNull()).select(F.col(key).alias(key), F.col(geometry).alias("_g"))
    e = edges(spread(own, "_g"), [key], "_g", quantum)
    a = F.struct(F.col("qx0").alias("x"), F.col("qy0").alias("y"))
    b = F.struct(F.col("qx1").alias("x"), F.col("qy1").alias("y"))
    # shuffled before any sum, which would hold a reading task's edges and halves them at most;
    # the ends of an edge held once are its only values, summed by hash and not by sorting
    ends = ("x0", "y0", "x1", "y1", "qx0", "qy0", "qx1", "qy1")
    return (e.withColumns({"_lo": F.least(a, b), "_hi": F.greatest(a, b)}).repartition(key, "_lo", "_hi")
            .groupBy(key, "_lo", "_hi")
            .agg(F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(c) for c in ends])
            .filter(F.col("_n") == 1)
            .select(key, *ends))


def outline_area(outline: DataFrame, key: str, quantum: float = DEGREE_QUANTUM) -> DataFrame:
    """Area enclosed by outline edges, exact: cross products of the
    quantised integer coordinates summed as DECIMAL, then scaled."""
    cross = (F.col("qx0").cast("decimal(38,0)") * F.col("qy1").cast("decimal(38,0)")
             - F.col("qx1").cast("decimal(38,0)") * F.col("qy0").cast("decimal(38,0)"))
    return (outline.groupBy(key)
            .agg(F.sum(cross).alias("_twice"))
            .select(key, (F.col("_twice").cast("double") / F.lit(2.0 * round(1 / quantum) ** 2))
                    .alias("area")))


def dissolve_attributes(df: DataFrame, key: str, order: str, attrs: list[str]) -> DataFrame:
    """One row per key; each attribute from the unit with the
    smallest ``order`` value (pandas' 'first', made deterministic)."""
    return df.groupBy(key).agg(*[F.min_by(a, order).alias(a) for a in attrs])


def _avg(a: Column, b: Column) -> Column:
    return (a + b) / F.lit(2.0)


def interior_point(e: DataFrame, keys: list[str], part: str | None = "part") -> DataFrame:
    """(keys, x, y) from directed edges (x0, y0, x1, y1).

    ``part`` groups the edges of one polygon; None scans all edges of a
    key as one polygon (merged outlines).
    """
    e = e if part else e.withColumn("part", F.lit(0))
    part = part or "part"
    grp = [*keys, part]
    # scan line: middle of the vertex heights closest around the
    # envelope centre (every vertex is the start of one edge)
    env = (e.groupBy(*grp)
           .agg(F.min(F.least("y0", "y1")).alias("_miny"),
                F.max(F.greatest("y0", "y1")).alias("_maxy"))
           .withColumn("_c", _avg(F.col("_miny"), F.col("_maxy"))))
    ev = e.join(env, grp)
    scan = (ev.groupBy(*grp)
            .agg(F.max(F.when(F.col("y0") <= F.col("_c"), F.col("y0"))).alias("_lo"),
                 F.min(F.when(F.col("y0") > F.col("_c"), F.col("y0"))).alias("_hi"),
                 F.first("_miny").alias("_miny"), F.first("_maxy").alias("_maxy"))
            .select(*grp, _avg(F.greatest(F.coalesce("_lo", "_miny"), F.col("_miny")),
                               F.least(F.coalesce("_hi", "_maxy"), F.col("_maxy"))).alias("_y")))
    ec = e.join(scan, grp)
    y0, y1, x0, x1, sy = (F.col(c) for c in ("y0", "y1", "x0", "x1", "_y"))
    crosses = ~(((y0 > sy) & (y1 > sy)) | ((y0 < sy) & (y1 < sy)))
    counted = (y0 != y1) & ~((y0 == sy) & (y1 < sy)) & ~((y1 == sy) & (y0 < sy))
    xint = F.when(x0 == x1, x0).otherwise(x0 + (sy - y0) / ((y1 - y0) / (x1 - x0)))
    cx = ec.filter(crosses & counted).select(*grp, "_y", xint.alias("_x"))
    # pair sorted crossings (1st-2nd, 3rd-4th, ...): bounded by the
    # number of edges one horizontal line meets
    w = Window.partitionBy(*grp).orderBy("_x")
    pairs = (cx.withColumn("_pair", F.floor((F.row_number().over(w) - 1) / 2))
             .groupBy(*grp, "_pair")
             .agg(F.min("_x").alias("_x1"), F.max("_x").alias("_x2"), F.first("_y").alias("_y"))
             .withColumn("_w", F.col("_x2") - F.col("_x1")))
    best = F.struct(F.col("_w"), -F.col("_pair"), -F.col(part))
    return (pairs.groupBy(*keys)
            .agg(F.max_by(F.struct(_avg(F.col("_x1"), F.col("_x2")).alias("x"),
                                   F.col("_y").alias("y")), best).alias("_p"))
            .select(*keys, "_p.x", "_p.y"))


def interior_point_rows(df: DataFrame, keys: list[str], geometry: str = "geometry") -> DataFrame:
    """G6 for whole geometries held in one row (units): the same rule as
    ``interior_point`` evaluated inside each row - no explode, no shuffle."""
    p = interior_point_expr(F.col(geometry))
    return df.select(*keys, p["x"].alias("x"), p["y"].alias("y"))


def unit_adjacency(df: DataFrame, key: str, unit: str, geometry: str = "geometry",
                   quantum: float = DEGREE_QUANTUM) -> DataFrame:
    """Pairs (a, b) of units of the same key that share an edge - one pair
    per shared edge, never all pairs of a group."""
    own = df.filter(F.col(key).isNotNull()).select(F.col(key).alias(key), F.col(unit).alias(unit), F.col(geometry).alias("_g"))
    e = edges(spread(own, "_g"), [key, unit], "_g", quantum)
    a = F.struct(F.col("qx0").alias("x"), F.col("qy0").alias("y"))
    b = F.struct(F.col("qx1").alias("x"), F.col("qy1").alias("y"))
    shared = (e.withColumns({"_lo": F.least(a, b), "_hi": F.greatest(a, b)}).repartition(key, "_lo", "_hi")
              .groupBy(key, "_lo", "_hi")
              .agg(F.min(unit).alias("a"), F.max(unit).alias("b"), F.count(F.lit(1)).alias("_n"))
              .filter((F.col("_n") == 2) & (F.col("a") != F.col("b"))))
    return shared.select("a", "b").distinct()


def connected_parts(df: DataFrame, key: str, unit: str, geometry: str = "geometry",
                    quantum: float = DEGREE_QUANTUM) -> DataFrame:
    """(unit, key, part): part = smallest unit id of the connected block of
    same-key units (units touching along an edge).  A long row of cells
    takes a number of rounds that grows with the logarithm of its length
    (``operators.components``)."""
    found = components(unit_adjacency(df, key, unit, geometry, quantum))
    units = df.filter(F.col(key).isNotNull()).select(unit, key)
    return (units.join(found, units[unit] == found["id"], "left")
            .select(units[unit], units[key], F.coalesce("component", units[unit]).alias("part")))


def interior_point_parts(df: DataFrame, key: str, unit: str, geometry: str = "geometry",
                         quantum: float = DEGREE_QUANTUM) -> DataFrame:
    """G6 for merged regions made of several separate parts: one scan
    line per part (its own outline, holes included), widest chord over
    the parts wins - the per-polygon rule of the geometry engines."""
    parts = connected_parts(df, key, unit, geometry, quantum)
    tagged = df.join(parts.select(unit, "part"), unit)
    tagged = tagged.withColumn("_kp", F.struct(F.col(key).alias("k"), F.col("part").alias("p")))
    outline = dissolve(tagged, "_kp", geometry, quantum)
    outline = outline.select(F.col("_kp.k").alias(key), F.col("_kp.p").alias("part"),
                             "x0", "y0", "x1", "y1")
    return interior_point(outline, [key], "part")
