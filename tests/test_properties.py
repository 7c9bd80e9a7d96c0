"""Property checks on the bound driver tables."""

import pytest
from pyspark.sql import functions as F

from tractus.operators import geo as G
from tractus.plans import domain as D
from tractus.sources import bindings as B

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("key", ["CF", "SF"])
def test_outline_area_equals_sum_of_unit_areas(spark, key):
    cells = B.cells(spark, SF)
    unit = G.with_area(cells, "a").groupBy(key).agg(F.sum("a").alias("units"))
    outline = G.outline_area(G.dissolve(cells, key), key)
    rows = outline.join(unit, key).collect()
    assert len(rows) == cells.select(key).distinct().count()
    assert all(abs(r.area - r.units) < 1e-9 for r in rows)


def test_enrichment_keeps_row_count(spark):
    assert D.enriched_units(spark, SF).count() == B.units(spark, SF).count() \
        == B.region_units(spark, SF).count()


def test_merged_interior_points_lie_in_their_region(spark):
    cells = B.cells(spark, SF)
    pts = G.interior_point(G.dissolve(cells, "CF"), ["CF"], None)
    ring = F.col("geometry")[0][0]
    box = cells.select("CF", F.array_min(F.transform(ring, lambda p: p["x"])).alias("x0"),
                       F.array_max(F.transform(ring, lambda p: p["x"])).alias("x1"),
                       F.array_min(F.transform(ring, lambda p: p["y"])).alias("y0"),
                       F.array_max(F.transform(ring, lambda p: p["y"])).alias("y1"))
    # in (or on the shared edge of) some cell of the region ...
    inside = pts.join(box, "CF").filter((F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) &
                                        (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1")))
    assert inside.select("CF").distinct().count() == pts.count() == 15
    # ... and strictly inside the region's envelope (not on its outline)
    env = box.groupBy("CF").agg(F.min("x0").alias("a"), F.max("x1").alias("b"),
                                F.min("y0").alias("c"), F.max("y1").alias("d"))
    strict = pts.join(env, "CF").filter((F.col("x") > F.col("a")) & (F.col("x") < F.col("b")) &
                                        (F.col("y") > F.col("c")) & (F.col("y") < F.col("d")))
    assert strict.count() == 15
