"""Merged regions as polygons - rings linked from outline edges.

    polygons = region_polygons(layer, "CF", "GEOID10")      # (CF, geometry)

1. Borders (``borders``): the edges of all polygons, grouped by (region, undirected
   edge).  An edge that two polygons of a region hold in opposite directions is inner and joins
   them; an edge held once is outline.  Any other edge is a fault.
2. Parts: polygons joined by inner edges (``operators.components``).  A part's
   interior is connected, so it is one polygon: a shell and its holes.
3. Links: the rays at each outline vertex are sorted by angle; an edge that
   arrives goes on with the first edge that leaves, counter-clockwise from where it came, so
   the walk keeps to the same piece of the outside.  As the inside of a part is
   connected, no ring passes a vertex twice, touching holes come apart, and
   the ring with a positive area is the shell.
4. Rings (``rank_cycles``): list ranking by pointer doubling, for all rings at
   once.  Every round doubles the stretch that each edge has seen, so a coast of a million
   edges takes 20 rounds; each round is one join of plain rows, written to the shared folder.
5. A ring's points are collected in order, starting at its smallest vertex.  Only here
   does a row hold a whole ring, which is the form of the result.

Cases: regions without a key are left out; a unit may have several polygons; repeated points are
dropped; an empty layer gives no row.  Faults (an edge held three times, or twice in one
direction) stop the work, or leave their regions out (``faults="skip"``);
``operators.coverage`` names the units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tractus.operators.components import components
from tractus.operators.geo import DEGREE_QUANTUM, edges, spread
from tractus.session import materialize, remove_path, scratch_dir

EDGE = ("x0", "y0", "x1", "y1", "qx0", "qy0", "qx1", "qy1")


def unit_edges(layer: DataFrame, key: str, unit: str, geometry: str = "geometry",
               quantum: float = DEGREE_QUANTUM) -> DataFrame:
    """(key, unit, piece, EDGE): directed edges, the inside on their left, without
    repeated points.  ``piece`` numbers the polygons of a unit."""
    own = layer.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(unit).alias("unit"), F.col(geometry).alias("geometry"))
    e = edges(spread(own), ["key", "unit"], "geometry", quantum).withColumnRenamed("part", "piece")
    return e.where("qx0 <> qx1 or qy0 <> qy1").select("key", "unit", "piece", *EDGE)


def ends() -> tuple[Column, Column]:
    a = F.struct(F.col("qx0").alias("x"), F.col("qy0").alias("y"))
    b = F.struct(F.col("qx1").alias("x"), F.col("qy1").alias("y"))
    return F.least(a, b), F.greatest(a, b)


def angle(dx: Column, dy: Column) -> Column:
    """A number that grows with the direction's angle, 0 to 4 counter-clockwise from
    east.  Directions that differ by less than about 1e-15 may come out equal."""
    r = dx / (F.abs(dx) + F.abs(dy))
    return F.when(dy < 0, 3.0 + r).otherwise(1.0 - r)


def borders(e: DataFrame) -> DataFrame:
    """(key, n, forward, a, b, EDGE): one row per region and undirected edge, held n times, ``forward``
    times in the direction of growing coordinates, by the polygons a to b."""
    lo, hi = ends()
    own = F.struct("unit", "piece")
    start = F.struct(F.col("qx0").alias("x"), F.col("qy0").alias("y"))
    # shuffled before any sum: an edge is held twice at most, so the reading tasks would only hold and sort theirs
    return (e.withColumns({"_lo": lo, "_hi": hi}).repartition("key", "_lo", "_hi").groupBy("key", "_lo", "_hi")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(start == F.col("_lo")).alias("forward"),
                 F.min(own).alias("a"), F.max(own).alias("b"), F.max(F.struct(*EDGE)).alias("_e"))
            .select("key", "n", "forward", "a", "b", "_e.*"))


FAULT = "n > 2 or (n = 2 and forward <> 1)"


def region_outlines(e: DataFrame, faults: str = "raise") -> DataFrame:
    """(key, part, EDGE) of the outline of every region; ``part`` is the smallest (unit, piece) of
    the block of polygons that hang together by edges."""
    spark = e.sparkSession
    path, seen = scratch_dir(spark, "borders"), Observation()
    b = borders(e)
    b.observe(seen, F.count_if(F.expr(FAULT)).alias("faults")).write.mode("overwrite").parquet(path)
    b = spark.read.schema(b.schema).parquet(path)
    if seen.get["faults"]:
        if faults == "raise":
            raise ValueError(f"{seen.get['faults']} edges are held three times or twice in one direction; see operators.coverage")
        b = b.join(b.where(FAULT).select("key").distinct(), "key", "left_anti")
    found = components(b.where("n = 2 and a <> b").select("a", "b"))
    outline = b.where("n = 1").select("key", "a", *EDGE)
    return (outline.join(found, outline["a"] == found["id"], "left")
            .select("key", F.coalesce("component", "a").alias("part"), *EDGE))


def next_edges(outline: DataFrame) -> DataFrame:
    """(id, next) of a table (id, key, part, EDGE): the edge that follows in its ring."""
    dx, dy = F.col("qx1") - F.col("qx0"), F.col("qy1") - F.col("qy0")
    arrives = outline.select("key", "part", F.col("qx1").alias("vx"), F.col("qy1").alias("vy"), "id",
                             F.lit(True).alias("arrives"), angle(-dx, -dy).alias("angle"))
    leaves = outline.select("key", "part", F.col("qx0").alias("vx"), F.col("qy0").alias("vy"), "id",
                            F.lit(False).alias("arrives"), angle(dx, dy).alias("angle"))
    w = Window.partitionBy("key", "part", "vx", "vy").orderBy("angle", "arrives")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ray = F.struct("id", "arrives")
    after = F.coalesce(F.lead(ray).over(w), F.first(ray).over(whole))
    return (arrives.unionByName(leaves).withColumn("after", after).where("arrives")
            .select("id", F.when(~F.col("after.arrives"), F.col("after.id")).alias("next")))


def rank_cycles(links: DataFrame) -> DataFrame:
    """(id, ring, pos, length) of a table (id, next) made of cycles: ``ring`` is the smallest
    id of the cycle and has pos 0.

    Each row knows the smallest id among the next 2^k rows and the way to it; joining it with
    the row 2^k further on doubles k.  When a round finds no smaller id, every row knows its cycle's."""
    spark = links.sparkSession
    kind = links.schema["id"].dataType.simpleString()
    state, path, span = links.select("id", "next", F.col("id").alias("ring"), F.lit(0).cast("long").alias("way")), None, 1
    while True:
        if path is None:
            step, better = state, F.lit(True)
        else:
            far = state.select(F.col("id").alias("next"), F.col("next").alias("_n"), F.col("ring").alias("_r"), F.col("way").alias("_w"))
            step, better = state.join(far, "next"), F.col("_r") < F.col("ring")
        seen, new = Observation(), scratch_dir(spark, "rings")
        step = step.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(better).alias("better"))
        if path is not None:
            step = step.select("id", F.col("_n").alias("next"), F.least("ring", "_r").alias("ring"),
                               F.when(better, F.col("_w") + span).otherwise(F.col("way")).alias("way"))
        step.write.mode("overwrite").parquet(new)
        state = spark.read.schema(f"id {kind}, next {kind}, ring {kind}, way long").parquet(new)
        if path is not None:
            remove_path(spark, path)
            span *= 2
        path, got = new, seen.get
        if not got["rows"] or not got["better"]:
            break
    size = state.groupBy("ring").agg(F.count(F.lit(1)).alias("length"))
    return state.join(size, "ring").select("id", "ring", F.pmod(F.col("length") - F.col("way"), "length").alias("pos"), "length")


def rings(outline: DataFrame, quantum: float = DEGREE_QUANTUM) -> DataFrame:
    """(key, part, hole, first, points, area) of an outline (key, part, EDGE): ``points`` is closed and starts
    at the ring's smallest vertex ``first``; ``area`` is positive for shells, negative for holes."""
    own = materialize(outline.withColumn("id", F.monotonically_increasing_id()), "outline")
    links = materialize(next_edges(own), "links")
    if not links.where("next is null").isEmpty():
        raise ValueError("an outline does not close; see operators.coverage")
    placed = own.join(rank_cycles(links), "id")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    vertex = F.struct("pos", F.col("qx0").alias("qx"), F.col("qy0").alias("qy"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    got = placed.groupBy("key", "part", "ring").agg(
        F.array_sort(F.collect_list(vertex)).alias("v"), F.min(F.struct(F.col("qx0").alias("qx"), F.col("qy0").alias("qy"), "pos")).alias("first"),
        F.sum(big("qx0") * big("qy1") - big("qx1") * big("qy0")).alias("twice"))
    at, n = F.col("first.pos").cast("int"), F.size("v")
    turned = F.concat(F.slice("v", at + 1, n), F.slice("v", F.lit(1), at + 1))
    return got.select("key", "part", (F.col("twice") < 0).alias("hole"), F.struct("first.qx", "first.qy").alias("first"),
                      F.transform(turned, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"),
                      (F.col("twice").cast("double") / F.lit(2.0 * round(1 / quantum) ** 2)).alias("area"))


def polygon_parts(all_rings: DataFrame) -> DataFrame:
    """(key, part, first, polygon, area): the shell, then its holes by their first vertex."""
    ring = F.struct("hole", "first", "points")
    return (all_rings.groupBy("key", "part")
            .agg(F.array_sort(F.collect_list(ring)).alias("r"), F.sum("area").alias("area"))
            .select("key", "part", F.col("r")[0]["first"].alias("first"), F.transform("r", lambda x: x["points"]).alias("polygon"), "area"))


def region_polygons(layer: DataFrame, key: str, unit: str, geometry: str = "geometry", quantum: float = DEGREE_QUANTUM,
                    faults: str = "raise", node: bool = True) -> DataFrame:
    """(key, geometry, area): the units of each region merged to one multi-polygon, its polygons by
    their first vertex.  ``node``: split borders where only one side has a vertex (``operators.coverage``)."""
    e = unit_edges(layer, key, unit, geometry, quantum)
    if node:
        from tractus.operators.coverage import node_edges
        e = node_edges(e)
    parts = polygon_parts(rings(region_outlines(e, faults), quantum))
    p = F.struct("first", "polygon", "area")
    return (parts.groupBy("key").agg(F.array_sort(F.collect_list(p)).alias("p"))
            .select(F.col("key").alias(key), F.transform("p", lambda x: x["polygon"]).alias(geometry),
                    F.aggregate("p", F.lit(0.0), lambda s, x: s + x["area"]).alias("area")))
