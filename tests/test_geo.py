"""Spatial operators: projections, areas, dissolve, interior points, GeoJSON."""

import pytest
from pyspark.sql import functions as F

from tractus.functions.projection import cea_6933, laea_3035
from tractus.operators import geo as G
from tractus.session import scratch_dir
from tractus.sinks.features import write_polygon_features
from tractus.sources.geojson import read_features

from conftest import GEOM, poly


def _xy(spark, fn, lon, lat):
    x, y = fn(F.lit(lon), F.lit(lat))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    return r.x, r.y


def test_projection_reference_points(spark):
    x, y = _xy(spark, laea_3035, 5.0, 50.0)
    assert x == pytest.approx(3962799.45, abs=0.01) and y == pytest.approx(2999718.85, abs=0.01)
    assert _xy(spark, laea_3035, 10.0, 52.0) == pytest.approx((4321000.0, 3210000.0), abs=1e-6)
    x, y = _xy(spark, cea_6933, 180.0, 90.0)
    assert 4 * x * y / 1e6 == pytest.approx(510.0656e6, rel=1e-6)


def test_small_cell_area_both_projections(spark):
    ring = [(-100.0, 35.0), (-99.95, 35.0), (-99.95, 35.05), (-100.0, 35.05), (-100.0, 35.0)]
    df = spark.createDataFrame([(1, poly(ring))], f"id int, geometry {GEOM}")
    a = G.with_area(G.project(df, 6933), "a", scale=1e-6).first().a
    b = G.with_area(G.project(df, 3035), "a", scale=1e-6).first().a
    assert a == pytest.approx(25.31131, abs=1e-4) and b == pytest.approx(25.31130, abs=1e-4)


def test_ring_with_hole_and_u_shape(spark):
    sq = poly([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)])
    u = poly([(0, 0), (9, 0), (9, 9), (6, 9), (6, 2), (2, 2), (2, 9), (0, 9), (0, 0)])
    df = spark.createDataFrame([(1, sq), (2, u)], f"id int, geometry {GEOM}")
    areas = {r.id: r.a for r in G.with_area(df, "a").collect()}
    assert areas == {1: 15.0, 2: 53.0}
    pts = {r.id: (r.x, r.y) for r in G.interior_point(G.edges(df, ["id"]), ["id"]).collect()}
    assert pts[2] == (7.5, 5.5)          # inside the wider arm, not the centroid
    assert pts[1] == (2.0, 3.0)          # beside the hole


def test_coverage_dissolve(spark):
    a = poly([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)])
    b = poly([(1, 0), (2, 0), (2, 1), (1, 1), (1, 0)])
    df = spark.createDataFrame([(1, "k", a), (2, "k", b)], f"id int, key string, geometry {GEOM}")
    out = G.dissolve(df, "key")
    assert out.count() == 6
    assert G.outline_area(out, "key").first().area == 2.0
    assert G.interior_point(out, ["key"], None).first().asDict() == {"key": "k", "x": 1.0, "y": 0.5}


def test_clockwise_input_is_reoriented(spark):
    cw = poly([(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)])
    df = spark.createDataFrame([(1, "k", cw)], f"id int, key string, geometry {GEOM}")
    assert G.outline_area(G.dissolve(df, "key"), "key").first().area == 1.0


def test_geojson_roundtrip(spark):
    df = spark.createDataFrame([(1, "n", poly([(0, 0), (1, 0), (1, 1), (0, 0)]))],
                               f"id bigint, name string, geometry {GEOM}")
    path = write_polygon_features(df, scratch_dir(spark, "gj-test"))
    back = read_features(spark, path, "id bigint, name string").first()
    assert back.id == 1 and back.name == "n"
    assert [(p.x, p.y) for p in back.geometry[0][0]] == [(0, 0), (1, 0), (1, 1), (0, 0)]


def test_row_local_interior_point_equals_edge_version(spark):
    shapes = [poly([(0, 0), (9, 0), (9, 9), (6, 9), (6, 2), (2, 2), (2, 9), (0, 9), (0, 0)]),
              poly([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]),
              poly([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]) + poly([(5, 0), (8, 0), (8, 1), (5, 1), (5, 0)]),
              poly([(0, 0), (3, 1), (1, 4), (0, 0)]),
              poly([(0, 0), (2, 0), (2, 1), (3, 1), (3, 3), (0, 3), (0, 0)])]
    df = spark.createDataFrame(list(enumerate(shapes)), f"id int, geometry {GEOM}")
    a = sorted(tuple(r) for r in G.interior_point_rows(df, ["id"]).collect())
    b = sorted(tuple(r) for r in G.interior_point(G.edges(df, ["id"]), ["id"]).collect())
    assert a == b
    assert a[2][1:] == (6.5, 0.5)   # the wider of two parts wins


def test_multi_part_region_scans_each_part(spark):
    tall = poly([(0, 0), (1, 0), (1, 10), (0, 10), (0, 0)])
    wide_a = poly([(5, 0), (10, 0), (10, 1), (5, 1), (5, 0)])
    wide_b = poly([(10, 0), (15, 0), (15, 1), (10, 1), (10, 0)])
    df = spark.createDataFrame([(1, "k", tall), (2, "k", wide_a), (3, "k", wide_b)],
                               f"id int, key string, geometry {GEOM}")
    parts = {r.id: r.part for r in G.connected_parts(df, "key", "id").collect()}
    assert parts == {1: 1, 2: 2, 3: 2}
    # one scan line over both parts would only meet the tall part (0.5, 5.5);
    # per part, the wide part's chord (width 10) wins
    assert G.interior_point_parts(df, "key", "id").first().asDict() == {"key": "k", "x": 10.0, "y": 0.5}
    assert G.interior_point(G.dissolve(df, "key"), ["key"], None).first().asDict() == \
        {"key": "k", "x": 0.5, "y": 5.5}


def test_long_chain_of_cells_is_one_part(spark):
    """A row of cells with shuffled ids: rounds grow with the logarithm of its length."""
    import random
    ids = list(range(2000))
    random.Random(4).shuffle(ids)
    rows = [(i, "k" if x < 1200 or x > 1300 else "other",
             poly([(x, 0), (x + 1, 0), (x + 1, 1), (x, 1), (x, 0)])) for x, i in enumerate(ids)]
    df = spark.createDataFrame(rows, f"id int, key string, geometry {GEOM}")
    got = {r.id: r.part for r in G.connected_parts(df, "key", "id", quantum=1.0).collect()}
    for lo, hi in ((0, 1200), (1200, 1301), (1301, 2000)):
        assert {got[i] for i in ids[lo:hi]} == {min(ids[lo:hi])}


def test_components_of_random_graphs(spark):
    import random
    from tractus.operators.components import components
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(260)] + [(None, 5), (7, None), (9, 9)]
    links += [(1000 + i, 1000 + i + 1) for i in range(64)] + [(5000, 5001 + i) for i in range(200)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {x.id: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _plain_components(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_contracted_components(spark):
    """Paths, a grid, a star and random graphs, contracted before the stars; ids may be structs."""
    import random
    from tractus.operators.components import components
    r = random.Random(5)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(None, 5), (7, None), (9, 9), (8, 6), (8, 6), (6, 8)]
    links += [(1000 + i, 1001 + i) for i in range(90)] + [(5000, 5001 + i) for i in range(200)]
    links += [(9000 + 20 * i + j, 9000 + 20 * i + j + d) for i in range(20) for j in range(20) for d in (1, 20) if j < 19 or d > 1]
    want = _plain_components(links)
    df = spark.createDataFrame(links, "a long, b long")
    assert {x.id: x.component for x in components(df, small=10).collect()} == want
    pairs = df.select(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("unit"), F.lit(0).alias("piece"))).alias(c) for c in "ab"])
    assert {x.id.unit: x.component.unit for x in components(pairs, small=10).collect()} == want


def test_a_long_graph_takes_few_passes_over_its_edges(spark, monkeypatch):
    """Edges written in all rounds together stay within a few times the graph's."""
    from tractus.operators import components as C
    seen = []
    write = C._write
    monkeypatch.setattr(C, "_write", lambda e, purpose: seen.append(write(e, purpose)) or seen[-1])
    links = spark.range(4000).selectExpr("id as a", "id + 1 as b")
    assert C.components(links, small=100).where("component <> 0").isEmpty()
    assert sum(s[2][0] for s in seen) < 5 * 4000


def test_edges_are_not_aggregated_by_the_tasks_that_read_the_units(spark):
    """One task per input split read, exploded and sorted all edges of a file of one split."""
    from tractus.operators import geo as G
    df = spark.createDataFrame([(i, "A", poly([(i, 0), (i + 1, 0), (i + 1, 1), (i, 1), (i, 0)])) for i in range(40)],
                               f"unit long, key string, geometry {GEOM}").coalesce(1)
    plan = G.dissolve(df, "key")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert plan.count("Exchange") == 2 and plan.rindex("Aggregate") < plan.index("Exchange")
    out = G.dissolve(df, "key").collect()
    assert len(out) == 82 and {r.key for r in out} == {"A"}
