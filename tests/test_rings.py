"""Merged polygons, noding and the coverage check, against hand-made layers and a plain tracer."""

import random

import pytest
from pyspark.sql import functions as F

from tractus.operators import coverage as C
from tractus.operators import rings as R
from tractus.operators.geo import dissolve, outline_area
from tractus.sinks.features import write_polygon_features
from tractus.sources.geojson import read_features
from tractus.session import scratch_dir

from conftest import GEOM

SCHEMA = f"id int, key string, geometry {GEOM}"


def shape(*polygons):
    return [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings] for rings in polygons]


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def cell(x, y):
    return shape([box(x, y, x + 1, y + 1)])


def merged(spark, rows, **kw):
    out = R.region_polygons(spark.createDataFrame(rows, SCHEMA), "key", "id", **kw)
    return {r.key: ([[[(p.x, p.y) for p in ring] for ring in part] for part in r.geometry], round(r.area, 9)) for r in out.collect()}


def faults(spark, rows, **kw):
    return sorted(map(tuple, C.coverage_faults(spark.createDataFrame(rows, SCHEMA), "key", "id", **kw).collect()))


def test_two_cells_and_a_second_part(spark):
    got = merged(spark, [(1, "k", cell(0, 0)), (2, "k", cell(1, 0)), (3, "k", cell(5, 5)), (4, None, cell(9, 9))])
    assert got == {"k": ([[[(0, 0), (1, 0), (2, 0), (2, 1), (1, 1), (0, 1), (0, 0)]], [[(5, 5), (6, 5), (6, 6), (5, 6), (5, 5)]]], 3.0)}


def grid(keys):
    """{(x, y): key} to rows of unit cells."""
    return [(i, k, cell(x, y)) for i, ((x, y), k) in enumerate(sorted(keys.items()))]


def trace(cells):
    """Merged polygons of a set of cells: blocks by flood fill, the outside by flood fill, one ring
    per piece of the outside."""
    def fill(start, inside):
        seen, todo = {start}, [start]
        while todo:
            x, y = todo.pop()
            for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if n not in seen and inside(n):
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)

    out = []
    for block in {fill(c, cells.__contains__) for c in cells}:
        xs, ys = [c[0] for c in block], [c[1] for c in block]
        frame = lambda n: min(xs) - 1 <= n[0] <= max(xs) + 1 and min(ys) - 1 <= n[1] <= max(ys) + 1
        empty = [(x, y) for x in range(min(xs) - 1, max(xs) + 2) for y in range(min(ys) - 1, max(ys) + 2) if (x, y) not in block]
        rings = []
        for void in {fill(e, lambda n: frame(n) and n not in block) for e in empty}:
            follow = {}
            for x, y in block:
                for a, b, n in (((x, y), (x + 1, y), (x, y - 1)), ((x + 1, y), (x + 1, y + 1), (x + 1, y)),
                                ((x + 1, y + 1), (x, y + 1), (x, y + 1)), ((x, y + 1), (x, y), (x - 1, y))):
                    if n in void:
                        assert a not in follow      # no vertex twice in a ring
                        follow[a] = b
            at = min(follow)
            ring = [at]
            while follow[ring[-1]] != at:
                ring.append(follow[ring[-1]])
            assert len(ring) == len(follow)
            area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2
            rings.append((area < 0, at, ring + [at]))
        rings.sort()
        assert [r[0] for r in rings] == [False] + [True] * (len(rings) - 1)
        out.append([r[2] for r in rings])
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_layers_equal_flood_fill(spark, seed):
    r = random.Random(seed)
    keys = {(x, y): r.choice("aabc") for x in range(14) for y in range(11) if r.random() < 0.9}
    got = merged(spark, grid(keys))
    for k in "abc":
        cells = {c for c, v in keys.items() if v == k}
        assert got[k] == (trace(cells), float(len(cells)))


def test_holes_that_touch_each_other_and_the_shell(spark):
    keys = {(x, y): "k" for x in range(6) for y in range(6)}
    for c in ((1, 1), (2, 2), (3, 1), (5, 4), (4, 3)):
        keys[c] = "hole"
    got = merged(spark, grid(keys))
    cells = {c for c, v in keys.items() if v == "k"}
    assert got["k"][0] == trace(cells) and len(got["k"][0]) == 1 and len(got["k"][0][0]) == 5
    assert len(got["hole"][0]) == 5        # cells that touch in a corner are parts of their own


def test_area_equals_outline_area(spark):
    keys = {(x, y): "ab"[(x // 3 + y // 2) % 2] for x in range(9) for y in range(8)}
    rows = grid(keys)
    got = merged(spark, rows)
    want = {r.key: r.area for r in outline_area(dissolve(spark.createDataFrame(rows, SCHEMA), "key"), "key").collect()}
    assert {k: v[1] for k, v in got.items()} == pytest.approx(want)


def test_round_trip_keeps_coordinates(spark):
    keys = {(x, y): "k" for x in range(3) for y in range(3) if (x, y) != (1, 1)}
    d = R.region_polygons(spark.createDataFrame(grid(keys), SCHEMA), "key", "id")
    back = read_features(spark, write_polygon_features(d, scratch_dir(spark, "rings")), "key string, area double")
    assert back.select("key", "geometry", "area").collect() == d.select("key", "geometry", "area").collect()
    assert back.first().area == 8.0


def test_units_with_holes_parts_and_clockwise_rings(spark):
    ring = list(reversed(box(0, 0, 3, 3)))                   # clockwise shell
    hole = box(1, 1, 2, 2)                                   # counter-clockwise hole
    rows = [(1, "k", shape([ring, hole])), (2, "k", shape([box(3, 0, 4, 3)], [box(7, 7, 8, 8)])), (3, "j", cell(1, 1)), (4, "k", []), (5, "k", None)]
    got = merged(spark, rows)
    assert got["k"][1] == 8.0 + 3.0 + 1.0 and [len(p) for p in got["k"][0]] == [2, 1]
    assert got["k"][0][0][1] == [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)] and got["j"][1] == 1.0


def test_repeated_points_and_empty_layer(spark):
    twice = shape([[(0, 0), (0, 0), (1, 0), (1, 1), (1, 1), (0, 1), (0, 0)]])
    assert merged(spark, [(1, "k", twice)]) == {"k": ([[[(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]]], 1.0)}
    assert merged(spark, []) == {} and faults(spark, []) == []


def test_long_ring(spark):
    """3,000 cells in a row: two sides of 3,000 edges."""
    got = merged(spark, [(i, "k", shape([box(i / 100, 0, (i + 1) / 100, 1)])) for i in range(3000)], node=False)
    assert len(got["k"][0]) == 1 and len(got["k"][0][0][0]) == 6003 and got["k"][1] == pytest.approx(30.0)


# ------------------------------------------------------------------ noding
def test_t_junctions_dissolve_to_one_ring(spark):
    left = shape([[(0, 0), (2, 0), (2, 4), (0, 4), (0, 0)]])
    right = shape([[(2, 0), (4, 0), (4, 4), (2, 4), (2, 3), (2, 1), (2, 0)]])
    assert merged(spark, [(1, "k", left), (2, "k", right)])["k"][0] == [[[(0, 0), (2, 0), (4, 0), (4, 4), (2, 4), (0, 4), (0, 0)]]]
    # three neighbours along one side, on slanted borders and within the tolerance
    a = shape([[(0, 0), (3, 9), (-5, 9), (0, 0)]])
    b = shape([[(0, 0), (5, 0), (1, 3), (0, 0)]])
    c = shape([[(1, 3), (5, 0), (3, 9), (2.00000004, 6), (1, 3)]])
    got = merged(spark, [(1, "k", a), (2, "k", b), (3, "k", c)])
    assert got["k"][0] == [[[(-5, 9), (0, 0), (5, 0), (3, 9), (-5, 9)]]]
    assert len(merged(spark, [(1, "k", a), (2, "k", b), (3, "k", c)], node=False)["k"][0]) == 2


def test_one_long_border_with_many_vertices(spark):
    wall = (1000, "k", shape([box(0, -1, 500, 0)]))
    got = merged(spark, [wall] + [(i, "k", cell(i, 0)) for i in range(500)])
    assert [len(p) for p in got["k"][0]] == [1] and got["k"][1] == 1000.0


def test_noding_keeps_a_noded_layer(spark):
    e = R.unit_edges(spark.createDataFrame(grid({(x, y): "k" for x in range(4) for y in range(4)}), SCHEMA), "key", "id")
    for trusted in (True, False):
        assert sorted(map(tuple, C.node_edges(e, trusted=trusted).collect())) == sorted(map(tuple, e.collect()))


# ------------------------------------------------------------------ coverage check
def test_a_coverage_has_no_faults(spark):
    rows = grid({(x, y): "ab"[x % 2] for x in range(5) for y in range(5) if (x, y) != (2, 2)})
    hole = (90, "c", shape([box(10, 0, 13, 3), box(11, 1, 12, 2)]))
    fill = (91, "c", cell(11, 1))
    wall = (92, "c", shape([box(0, -1, 5, 0)]))            # T-junctions are no faults
    assert faults(spark, rows + [hole, fill, wall]) == []


def test_each_fault_is_found(spark):
    assert faults(spark, [(1, "k", cell(0, 0)), (2, "k", cell(0, 0))])[:2] == [(1, "edge", 4), (1, "inside", 2)]
    # one inside the other, apart from its sides
    assert faults(spark, [(1, "k", shape([box(0, 0, 9, 9)])), (2, "j", cell(1, 3))]) == [(1, "inside", 1), (2, "inside", 1)]
    # sides that cross between their ends
    plus = faults(spark, [(1, "k", shape([box(0, 4, 9, 5)])), (2, "k", shape([box(4, 0, 5, 9)]))])
    assert [f for f in plus if f[1] == "crossing"] == [(1, "crossing", 8), (2, "crossing", 8)]
    # through a common vertex
    diamond = shape([[(2, 0), (4, 2), (2, 4), (0, 2), (2, 0)]])
    got = faults(spark, [(1, "k", diamond), (2, "k", shape([[(4, 2), (6, 3), (2, 2.5), (2, 1.5), (6, 1), (4, 2)]]))])
    assert {f[:2] for f in got} >= {(1, "vertex"), (2, "vertex")} or {f[1] for f in got} >= {"vertex", "crossing"}


def test_edges_held_three_times(spark):
    rows = [(1, "k", cell(0, 0)), (2, "k", cell(1, 0)), (3, "k", cell(1, 0)), (4, "fine", cell(5, 0))]
    with pytest.raises(ValueError, match="coverage"):
        merged(spark, rows)
    assert list(merged(spark, rows, faults="skip")) == ["fine"]


# ------------------------------------------------------------------ list ranking
def test_rank_cycles(spark):
    r = random.Random(5)
    links, want = [], {}
    ids = list(range(400))
    r.shuffle(ids)
    while ids:
        ring, ids = ids[:r.randint(1, 70)], ids[70:]
        links += list(zip(ring, ring[1:] + ring[:1]))
        at = ring.index(min(ring))
        want |= {x: (min(ring), i, len(ring)) for i, x in enumerate(ring[at:] + ring[:at])}
    got = R.rank_cycles(spark.createDataFrame(links, "id long, next long"))
    assert {x.id: (x.ring, x.pos, x.length) for x in got.collect()} == want
    assert R.rank_cycles(spark.createDataFrame([], "id long, next long")).count() == 0


def test_plans_have_no_cross_join(spark):
    rows = grid({(x, y): "k" for x in range(3) for y in range(3)})
    d = C.coverage_faults(spark.createDataFrame(rows, SCHEMA), "key", "id")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan
