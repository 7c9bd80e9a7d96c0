"""Noding of shared borders, and the check that a layer is a coverage.

``node_edges`` splits an edge at the vertices that lie on it, as where one of two
neighbours has an extra vertex on their border.  In a coverage only edges without an equal
partner can hold such a vertex, and only ends of such edges can be one, so a layer that is noded
costs one grouped count.  The check trusts nothing and looks at every edge and vertex.

``coverage_faults`` names the units that break the rules on which summed areas and
cancelled edges rely.  Four tests, which together find every overlap:

* ``edge``: an edge held more than once in one direction, or both ways by one unit;
* ``vertex``: at a vertex the inside corners of two polygons overlap;
* ``crossing``: two edges cross between their ends;
* ``inside``: a polygon lies inside another one.

Near pairs are found by a grid of many levels: an edge (or a polygon) goes to the level whose
cells are just larger than it, where it meets four cells at most (nine with a
tolerance), and looks at its own cells of each coarser level in use (at most 34).
So neither one long border nor a dense city makes a cell hold many long edges.

Cases: units without a key or geometry take no part; repeated points are dropped; an
empty layer has no faults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tractus.functions.geometry import interior_point_expr
from tractus.operators.geo import DEGREE_QUANTUM, spread
from tractus.operators.rings import EDGE, angle, ends, unit_edges
from tractus.session import materialize

#: Distance, in quanta, up to which a vertex lies on an edge.
TOLERANCE = 1.0


def _level(w: Column, h: Column) -> Column:
    """Smallest level whose cells, 2^level wide, are at least that large."""
    return F.ceil(F.log2(F.greatest(w, h, F.lit(1)).cast("double"))).cast("int")


def _cell(c: Column, level: Column) -> Column:
    # floor division by 2^level, for negative numbers too
    return F.call_function("shiftright", c, level)


def _cells(level: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The cells of a level that a box meets, as an array of (level, cx, cy)."""
    return F.flatten(F.transform(F.sequence(_cell(x0, level), _cell(x1, level)), lambda cx: F.transform(
        F.sequence(_cell(y0, level), _cell(y1, level)), lambda cy: F.struct(level.alias("level"), cx.alias("cx"), cy.alias("cy")))))


def _levels(df: DataFrame) -> list[int]:
    """Levels in use (34 at most)."""
    return sorted(r["level"] for r in df.select("level").distinct().collect())


def _box(df: DataFrame, tolerance: int = 0) -> DataFrame:
    t = F.lit(tolerance)
    return df.withColumns({"bx0": F.least("qx0", "qx1") - t, "by0": F.least("qy0", "qy1") - t,
                           "bx1": F.greatest("qx0", "qx1") + t, "by1": F.greatest("qy0", "qy1") + t})


def _big(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def _cross(ax: str, ay: str, bx: str, by: str, px: str, py: str) -> Column:
    """Twice the area of the triangle a, b, p, exactly: positive where p is left of a -> b."""
    return ((_big(bx) - _big(ax)) * (_big(py) - _big(ay)) - (_big(by) - _big(ay)) * (_big(px) - _big(ax)))


def node_edges(e: DataFrame, tolerance: float = TOLERANCE, trusted: bool = True) -> DataFrame:
    """``e`` (key, unit, piece, EDGE) with edges split at the vertices on them.  ``trusted``: the
    layer is a coverage, so edges held twice need no look."""
    lo, hi = ends()
    if trusted:
        held = F.count(F.lit(1)).over(Window.partitionBy("_lo", "_hi"))
        tagged = materialize(e.withColumns({"_lo": lo, "_hi": hi}).withColumn("_n", held).drop("_lo", "_hi"), "edges")
    else:
        tagged = e.withColumn("_n", F.lit(1))
    matched = tagged.where("_n > 1").select(*e.columns)
    size = _level(F.abs(F.col("qx1") - F.col("qx0")), F.abs(F.col("qy1") - F.col("qy0")))
    alone = materialize(tagged.where("_n = 1").select(*e.columns, size.alias("level"), F.monotonically_increasing_id().alias("_id")), "single-edges")
    levels = _levels(alone)
    if not levels:
        return matched
    start = alone.select(F.col("qx0").alias("vx"), F.col("qy0").alias("vy"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    end = alone.select(F.col("qx1").alias("vx"), F.col("qy1").alias("vy"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    vertices = (start.unionAll(end).groupBy("vx", "vy").agg(F.min(F.struct("x", "y")).alias("p"))
                .select("vx", "vy", "p", F.explode(F.lit(levels).cast("array<int>")).alias("level"))
                .withColumns({"cx": _cell(F.col("vx"), F.col("level")), "cy": _cell(F.col("vy"), F.col("level"))}))
    reach = int(-(-tolerance // 1))
    boxed = _box(alone, reach).withColumn("_c", F.explode(_cells(F.col("level"), F.col("bx0"), F.col("by0"), F.col("bx1"), F.col("by1"))))
    boxed = boxed.select("_id", *e.columns, "bx0", "by0", "bx1", "by1", "_c.*")
    dx, dy = F.col("qx1") - F.col("qx0"), F.col("qy1") - F.col("qy0")
    # how far along the edge: 0 at its start, its squared length at its end
    along = (F.col("vx") - F.col("qx0")).cast("double") * dx + (F.col("vy") - F.col("qy0")).cast("double") * dy
    length2 = dx.cast("double") * dx + dy.cast("double") * dy
    off = _cross("qx0", "qy0", "qx1", "qy1", "vx", "vy").cast("double")
    inside = F.col("vx").between(F.col("bx0"), F.col("bx1")) & F.col("vy").between(F.col("by0"), F.col("by1"))
    is_end = ((F.col("vx") == F.col("qx0")) & (F.col("vy") == F.col("qy0"))) | ((F.col("vx") == F.col("qx1")) & (F.col("vy") == F.col("qy1")))
    cuts = (boxed.join(vertices, ["level", "cx", "cy"])
            .where(inside & ~is_end & (along > 0) & (along < length2) & (off * off <= tolerance * tolerance * length2))
            .groupBy("_id", *e.columns).agg(F.array_sort(F.collect_list(F.struct(along.alias("t"), "vx", "vy", "p"))).alias("_cuts")))
    whole = alone.join(cuts.select("_id"), "_id", "left_anti").select(*e.columns)
    point = lambda qx, qy, x, y: F.struct(qx.alias("qx"), qy.alias("qy"), x.alias("x"), y.alias("y"))
    points = F.concat(F.array(point(*(F.col(c) for c in ("qx0", "qy0", "x0", "y0")))),
                      F.transform("_cuts", lambda c: point(c["vx"], c["vy"], c["p"]["x"], c["p"]["y"])),
                      F.array(point(*(F.col(c) for c in ("qx1", "qy1", "x1", "y1")))))
    n = F.size("_cuts") + 1
    pairs = F.arrays_zip(F.slice("_p", F.lit(1), n).alias("a"), F.slice("_p", F.lit(2), n).alias("b"))
    pieces = (cuts.withColumn("_p", points).select("key", "unit", "piece", F.explode(pairs).alias("s"))
              .select("key", "unit", "piece", *[F.col(f"s.{s}.{q}{c}").alias(f"{q}{c}{i}") for q in ("", "q") for i, s in ((0, "a"), (1, "b")) for c in "xy"]))
    return matched.unionByName(whole).unionByName(pieces)


def _edge_faults(e: DataFrame) -> DataFrame:
    """Holders of an edge in a direction that more than one polygon holds, or that its own unit holds the other way."""
    lo, hi = ends()
    forward = F.struct(F.col("qx0").alias("x"), F.col("qy0").alias("y")) == F.col("_lo")
    rows = e.withColumns({"_lo": lo, "_hi": hi}).withColumn("_f", forward)
    bad = (rows.groupBy("_lo", "_hi").agg(F.count_if("_f").alias("f"), F.count_if(~F.col("_f")).alias("b"), F.min("unit").alias("u"), F.max("unit").alias("v"))
           .where("f > 1 or b > 1 or (f = 1 and b = 1 and u = v)"))
    return (rows.join(bad, ["_lo", "_hi"]).where("(_f and f > 1) or (not _f and b > 1) or (f = 1 and b = 1)")
            .select("unit", F.lit("edge").alias("fault")))


def _corners(own: DataFrame) -> DataFrame:
    """(id, next) within each polygon: the leaving edge that closes the inside corner of an arriving one,
    clockwise from where it came."""
    dx, dy = F.col("qx1") - F.col("qx0"), F.col("qy1") - F.col("qy0")
    arrives = own.select("unit", "piece", F.col("qx1").alias("vx"), F.col("qy1").alias("vy"), "id", F.lit(True).alias("arrives"), angle(-dx, -dy).alias("angle"))
    leaves = own.select("unit", "piece", F.col("qx0").alias("vx"), F.col("qy0").alias("vy"), "id", F.lit(False).alias("arrives"), angle(dx, dy).alias("angle"))
    w = Window.partitionBy("unit", "piece", "vx", "vy").orderBy(F.desc("angle"), "arrives")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ray = F.struct("id", "arrives")
    after = F.coalesce(F.lead(ray).over(w), F.first(ray).over(whole))
    return (arrives.unionByName(leaves).withColumn("after", after).where("arrives and not after.arrives")
            .select("id", F.col("after.id").alias("next")))


def _vertex_faults(e: DataFrame) -> DataFrame:
    """Rays of all polygons at each vertex, by angle: clockwise from where a polygon's edge came,
    the next other direction must be where this polygon goes on."""
    dx, dy = F.col("qx1") - F.col("qx0"), F.col("qy1") - F.col("qy0")
    own = materialize(e.withColumn("id", F.monotonically_increasing_id()), "edge-ids")
    # a polygon's own corners: each arriving edge with the leaving one
    links = _corners(own)
    out = own.select(F.col("id").alias("next"), angle(dx, dy).alias("goes"))
    corners = (own.select("id", "unit", F.col("qx1").alias("vx"), F.col("qy1").alias("vy"), angle(-dx, -dy).alias("came"))
               .join(links, "id").join(out, "next"))
    rays = (own.select(F.col("qx1").alias("vx"), F.col("qy1").alias("vy"), angle(-dx, -dy).alias("came"))
            .unionAll(own.select("qx0", "qy0", angle(dx, dy))).distinct())
    w = Window.partitionBy("vx", "vy").orderBy(F.desc("came"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = rays.withColumn("after", F.coalesce(F.lead("came").over(w), F.first("came").over(whole)))
    return (corners.join(after, ["vx", "vy", "came"]).where("after <> goes").select("unit", F.lit("vertex").alias("fault")))


def _crossing_faults(e: DataFrame) -> DataFrame:
    """Pairs of edges that cross between their ends.  Equal edges are looked at once."""
    lo, hi = ends()
    lines = (e.groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.min("unit").alias("u"), F.max("unit").alias("v"))
             .select(F.monotonically_increasing_id().alias("id"), "u", "v", F.col("lo.x").alias("qx0"), F.col("lo.y").alias("qy0"),
                     F.col("hi.x").alias("qx1"), F.col("hi.y").alias("qy1")))
    lines = materialize(_box(lines).withColumn("level", _level(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0"))), "lines")
    levels = _levels(lines)
    if not levels:
        return lines.select(F.col("u").alias("unit"), F.lit("crossing").alias("fault")).limit(0)
    every = F.lit(levels).cast("array<int>")
    box = [F.col(c) for c in ("bx0", "by0", "bx1", "by1")]
    base = lines.select("id", "u", "v", "level", "qx0", "qy0", "qx1", "qy1", "bx0", "by0", "bx1", "by1")
    large = base.withColumn("_c", F.explode(_cells(F.col("level"), *box))).select(
        F.col("_c.level").alias("level"), F.col("_c.cx").alias("cx"), F.col("_c.cy").alias("cy"),
        *[F.col(c).alias(f"l_{c}") for c in ("id", "u", "v", "qx0", "qy0", "qx1", "qy1", "bx0", "by0", "bx1", "by1")])
    small = (base.withColumnRenamed("level", "own").withColumn("_l", F.explode(F.filter(every, lambda x: x >= F.col("own"))))
             .withColumn("_c", F.explode(_cells(F.col("_l"), *box))).select(
        F.col("_c.level").alias("level"), F.col("_c.cx").alias("cx"), F.col("_c.cy").alias("cy"), "own", "id", "u", "v", "qx0", "qy0", "qx1", "qy1", "bx0", "by0", "bx1", "by1"))
    meet = ((F.col("bx0") <= F.col("l_bx1")) & (F.col("l_bx0") <= F.col("bx1")) & (F.col("by0") <= F.col("l_by1")) & (F.col("l_by0") <= F.col("by1")))
    # the pair meets in several cells; the one with the corner of both boxes counts
    here = ((_cell(F.greatest("bx0", "l_bx0"), F.col("level")) == F.col("cx")) & (_cell(F.greatest("by0", "l_by0"), F.col("level")) == F.col("cy")))
    once = (F.col("own") < F.col("level")) | (F.col("id") < F.col("l_id"))
    s = [_cross("qx0", "qy0", "qx1", "qy1", "l_qx0", "l_qy0"), _cross("qx0", "qy0", "qx1", "qy1", "l_qx1", "l_qy1"),
         _cross("l_qx0", "l_qy0", "l_qx1", "l_qy1", "qx0", "qy0"), _cross("l_qx0", "l_qy0", "l_qx1", "l_qy1", "qx1", "qy1")]
    proper = (F.signum(s[0].cast("double")) * F.signum(s[1].cast("double")) < 0) & (F.signum(s[2].cast("double")) * F.signum(s[3].cast("double")) < 0)
    pairs = small.join(large, ["level", "cx", "cy"]).where(once & meet & here & proper)
    return pairs.select(F.explode(F.array("u", "v", "l_u", "l_v")).alias("unit"), F.lit("crossing").alias("fault"))


def _inside_faults(layer: DataFrame, key: str, unit: str, geometry: str, quantum: float) -> DataFrame:
    """Polygons whose interior point lies inside another polygon."""
    own = spread(layer.where(F.col(key).isNotNull()).select(F.col(unit).alias("unit"), F.col(geometry).alias("_g")), "_g")
    pieces = (own.select("unit", F.posexplode("_g").alias("piece", "rings"))
              .withColumn("p", interior_point_expr(F.array("rings"))))
    xs, ys = F.transform(F.col("rings")[0], lambda p: p["x"]), F.transform(F.col("rings")[0], lambda p: p["y"])
    q = lambda c: F.round(c / F.lit(quantum)).cast("long")
    boxed = pieces.where("p is not null").select("unit", "piece", "rings", "p", q(F.array_min(xs)).alias("bx0"), q(F.array_min(ys)).alias("by0"),
                                                 q(F.array_max(xs)).alias("bx1"), q(F.array_max(ys)).alias("by1"))
    boxed = materialize(boxed.withColumn("level", _level(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0"))), "boxes")
    levels = _levels(boxed)
    if not levels:
        return boxed.select("unit", F.lit("inside").alias("fault")).limit(0)
    points = (boxed.select("unit", "piece", "p.x", "p.y", F.explode(F.lit(levels).cast("array<int>")).alias("level"))
              .withColumns({"cx": _cell(q(F.col("x")), F.col("level")), "cy": _cell(q(F.col("y")), F.col("level"))}))
    large = boxed.withColumn("_c", F.explode(_cells(F.col("level"), *[F.col(c) for c in ("bx0", "by0", "bx1", "by1")]))).select(
        F.col("unit").alias("l_unit"), F.col("piece").alias("l_piece"), "rings", "bx0", "by0", "bx1", "by1", "_c.*")
    px, py = F.col("x"), F.col("y")

    def crossings(ring: Column) -> Column:
        """Edges of a ring that a ray from the point to the right meets."""
        n = F.size(ring) - 1
        pairs = F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: F.when(
            ((a["y"] > py) != (b["y"] > py)) & (px < (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0))
        return F.aggregate(pairs, F.lit(0), lambda s, v: s + v)

    met = F.aggregate("rings", F.lit(0), lambda s, ring: s + crossings(ring))
    in_box = q(px).between(F.col("bx0"), F.col("bx1")) & q(py).between(F.col("by0"), F.col("by1"))
    other = (F.col("unit") != F.col("l_unit")) | (F.col("piece") != F.col("l_piece"))
    found = points.join(large, ["level", "cx", "cy"]).where(other & in_box & (met % 2 == 1))
    return found.select(F.explode(F.array("unit", "l_unit")).alias("unit"), F.lit("inside").alias("fault"))


def coverage_faults(layer: DataFrame, key: str, unit: str, geometry: str = "geometry",
                    quantum: float = DEGREE_QUANTUM, node: bool = True) -> DataFrame:
    """(unit, fault, n): how often a unit takes part in a fault of each kind; no row for a coverage."""
    e = unit_edges(layer, key, unit, geometry, quantum)
    e = materialize(node_edges(e, trusted=False) if node else e, "noded-edges")
    faults = (_edge_faults(e).unionByName(_vertex_faults(e)).unionByName(_crossing_faults(e))
              .unionByName(_inside_faults(layer, key, unit, geometry, quantum)))
    return faults.groupBy(F.col("unit").alias(unit), "fault").agg(F.count(F.lit(1)).alias("n"))
