"""Planar geometry expressions on nested-array geometries.

A geometry is ``array<array<array<struct<x double, y double>>>>``:
parts (polygons) > rings (ring 0 = shell, others = holes) > points,
rings closed (last point = first point).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT_TYPE = "struct<x:double,y:double>"
GEOMETRY_TYPE = f"array<array<array<{POINT_TYPE}>>>"


def ring_signed_area(ring: Column) -> Column:
    """Shoelace sum, positive for a counter-clockwise ring.

    Terms are taken relative to the first vertex: projected coordinates
    are ~1e7 m and raw products would lose the digits that matter.
    """
    o = ring[0]
    idx = F.sequence(F.lit(0), F.greatest(F.size(ring) - 2, F.lit(0)))

    def term(acc, i):
        a, b = ring[i], ring[i + 1]
        return acc + ((a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"]))

    return F.when(F.size(ring) >= 4, F.aggregate(idx, F.lit(0.0), term) / F.lit(2.0)) \
        .otherwise(F.lit(0.0))


def polygon_area(part: Column) -> Column:
    """|shell| - sum |holes|."""
    return F.aggregate(
        F.transform(part, lambda ring, i: F.when(i == 0, F.abs(ring_signed_area(ring)))
                    .otherwise(-F.abs(ring_signed_area(ring)))),
        F.lit(0.0), lambda acc, a: acc + a)


def geometry_area(g: Column) -> Column:
    """Planar area of a (multi)polygon = sum over parts."""
    return F.aggregate(F.transform(g, polygon_area), F.lit(0.0), lambda acc, a: acc + a)


def point_x(p: Column) -> Column:
    """T5."""
    return p["x"]


def point_y(p: Column) -> Column:
    """T5."""
    return p["y"]


def _half(a: Column, b: Column) -> Column:
    return (a + b) / F.lit(2.0)


def _ring_edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.arrays_zip(F.slice(ring, 1, n - 1).alias("a"), F.slice(ring, 2, n - 1).alias("b"))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda
    variable (keeps the expression tree linear instead of inlining the
    value at every use)."""
    return F.transform(F.array(value), body)[0]


def _part_chord(part: Column) -> Column:
    """Widest interior chord of one polygon on its scan line:
    struct<w, neg_pair, x, y> (w = -1 when the line meets no edge)."""
    def with_ys(ys):
        return _let(F.struct(F.array_min(ys).alias("mn"), F.array_max(ys).alias("mx")),
                    lambda m: _let(scan_y(ys, m), with_sy))

    def scan_y(ys, m):
        c = _half(m["mn"], m["mx"])
        lo = F.greatest(F.coalesce(F.array_max(F.filter(ys, lambda y: y <= c)), m["mn"]), m["mn"])
        hi = F.least(F.coalesce(F.array_min(F.filter(ys, lambda y: y > c)), m["mx"]), m["mx"])
        return _half(lo, hi)

    def with_sy(sy):
        def counted(e):
            y0, y1 = e["a"]["y"], e["b"]["y"]
            crosses = ~(((y0 > sy) & (y1 > sy)) | ((y0 < sy) & (y1 < sy)))
            return crosses & (y0 != y1) & ~((y0 == sy) & (y1 < sy)) & ~((y1 == sy) & (y0 < sy))

        def xint(e):
            x0, x1, y0, y1 = e["a"]["x"], e["b"]["x"], e["a"]["y"], e["b"]["y"]
            return F.when(x0 == x1, x0).otherwise(x0 + (sy - y0) / ((y1 - y0) / (x1 - x0)))

        xs = F.array_sort(F.flatten(F.transform(
            part, lambda ring: F.transform(F.filter(_ring_edges(ring), counted), xint))))
        return _let(xs, lambda xs: chord(xs, sy))

    def chord(xs, sy):
        chords = F.transform(
            F.sequence(F.lit(0), F.floor(F.size(xs) / 2).cast("int") - 1),
            lambda i: F.struct((xs[2 * i + 1] - xs[2 * i]).alias("w"), (-i).alias("neg_pair"),
                               _half(xs[2 * i], xs[2 * i + 1]).alias("x"), sy.alias("y")))
        empty = F.struct(F.lit(-1.0).alias("w"), F.lit(0).alias("neg_pair"),
                         F.lit(None).cast("double").alias("x"),
                         F.lit(None).cast("double").alias("y"))
        return F.when(F.size(xs) >= 2, F.array_max(chords)).otherwise(empty)

    ys = F.flatten(F.transform(part, lambda ring: F.transform(ring, lambda p: p["y"])))
    return _let(ys, with_ys)


def interior_point_expr(g: Column) -> Column:
    """G6 per row: the scan-line interior point of a (multi)polygon,
    computed inside the row (no shuffle).  Same rule as the edge-table
    version in ``tractus.operators.geo.interior_point``: widest chord,
    leftmost on ties, first part on ties."""
    def cand(part, k):
        return _let(_part_chord(part), lambda c: F.struct(
            c["w"].alias("w"), (-k).alias("neg_part"), c["neg_pair"].alias("neg_pair"),
            c["x"].alias("x"), c["y"].alias("y")))
    return _let(F.array_max(F.transform(g, cand)),
                lambda best: F.struct(best["x"].alias("x"), best["y"].alias("y")))
