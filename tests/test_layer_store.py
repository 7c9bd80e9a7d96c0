"""A layer stored in ranges of a space-filling curve."""

import random

import pytest

from tractus.functions.geometry import GEOMETRY_TYPE
from tractus.operators.layer_store import ranges, read_extent, write_layer
from tractus.session import scratch_dir

SCHEMA = f"k int, geometry {GEOMETRY_TYPE}"


def _box(x, y, w, h):
    return [[[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]]]


def _layer(spark, n, seed=5):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        size = 400.0 if k % 97 == 0 else r.random() * 3
        rows.append((k, None if k % 41 == 3 else _box(r.random() * 1000, r.random() * 1000, size, size / 2)))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def _meeting(rows, x0, y0, x1, y1):
    out = set()
    for k, g in rows:
        if g:
            xs, ys = [p[0] for p in g[0][0]], [p[1] for p in g[0][0]]
            if min(xs) <= x1 and max(xs) >= x0 and min(ys) <= y1 and max(ys) >= y0:
                out.add(k)
    return out


def test_extents_against_brute_force(spark):
    rows, layer = _layer(spark, 1500)
    path = write_layer(layer, scratch_dir(spark, "layer"), range_rows=60)
    assert sum(r.n for r in ranges(spark, path).collect()) == 1500
    for box in [(0, 0, 1400, 1400), (300, 300, 340, 360), (500, 0, 500, 1400), (-9, -9, -1, -1), (999, 999, 5000, 5000)]:
        got = [r.k for r in read_extent(spark, path, SCHEMA, *box).select("k").collect()]
        assert len(got) == len(set(got)) and set(got) == _meeting(rows, *box)


def test_an_extent_reads_few_ranges(spark):
    rows, layer = _layer(spark, 4000)
    path = write_layer(layer, scratch_dir(spark, "layer"), range_rows=100)
    part = read_extent(spark, path, SCHEMA, 200, 200, 230, 230)
    assert {r.k for r in part.collect()} == _meeting(rows, 200, 200, 230, 230)
    done = part._jdf.queryExecution()
    assert "dynamicpruning" in done.optimizedPlan().toString()
    assert "LessThanOrEqual(xmin,230.0)" in done.executedPlan().toString()
    boxes = ranges(spark, path)
    met = boxes.where("xmin <= 230 and xmax >= 200 and ymin <= 230 and ymax >= 200").count()
    assert met <= boxes.count() / 3


def test_touching_boxes_and_odd_geometries(spark):
    nan = float("nan")
    layer = spark.createDataFrame([(1, _box(0.0, 0.0, 1.0, 1.0)), (2, _box(1.0, 0.0, 1.0, 1.0)), (3, None), (4, []),
                                   (5, _box(nan, 0.0, 1.0, 1.0)), (1, _box(0.0, 0.0, 1.0, 1.0))], SCHEMA)
    path = write_layer(layer, scratch_dir(spark, "layer"), range_rows=2)
    assert sorted(r.k for r in read_extent(spark, path, SCHEMA, 1, 0, 1, 0).collect()) == [1, 1, 2]
    assert sorted(r.k for r in read_extent(spark, path, SCHEMA, 1.5, 0, 9, 9).collect()) == [2]


@pytest.mark.parametrize("rows", [[], [(1, _box(2.0, 2.0, 0.0, 0.0))], [(1, None)]])
def test_small_layers(spark, rows):
    path = write_layer(spark.createDataFrame(rows, SCHEMA), scratch_dir(spark, "layer"))
    assert read_extent(spark, path, SCHEMA, 0, 0, 9, 9).count() == sum(g is not None for _, g in rows)


def test_own_box_columns_are_refused(spark):
    with pytest.raises(ValueError, match="xmin"):
        write_layer(spark.createDataFrame([(1, None, 2.0)], SCHEMA + ", xmin double"), "/nowhere")
