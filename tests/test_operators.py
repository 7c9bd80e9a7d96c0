"""Operators on hand-made frames (FIXTURES section 3) and golden facts."""


import math

import pytest

from tractus.operators.columns import pad_id, title_header
from tractus.operators.density import DensityLevel, density_enrichment, group_density
from tractus.operators.explain import explain_level
from tractus.operators.places import attach_principal_place
from tractus.operators.rank import rank_level
from tractus.operators.serve import grid_cluster_pyramid, grid_clusters, table_page, top_n


def test_principal_place_ties(spark):
    units = spark.createDataFrame([(1, "A County"), (2, "B County"), (3, None)],
                                  "unit_id int, county_name string")
    places = spark.createDataFrame(
        [("x", "A", 10.0, 1.0, 2.0, 2), ("y", "A", 10.0, 3.0, 4.0, 1), ("z", "B", 5.0, 5.0, 6.0, 3)],
        "city string, county_name string, population double, lat double, lng double, id int")
    all_ = attach_principal_place(units, places, suffix=" County", ties="all")
    assert all_.filter("unit_id = 1").count() == 2
    nulls = spark.createDataFrame([("p", "A", None, 1.0, 1.0, 7), ("q", "A", None, 1.0, 1.0, 8)],
                                  places.schema)
    assert attach_principal_place(units, nulls, suffix=" County", ties="all") \
        .filter("unit_id = 1").count() == 2  # all-NULL populations tie at rank 1
    one = attach_principal_place(units, places, suffix=" County", ties="one").orderBy("unit_id").collect()
    assert [(r.unit_id, r.city) for r in one] == [(1, "y"), (2, "z"), (3, None)]


def test_density_levels_null_key_and_zero_area(spark):
    df = spark.createDataFrame([(1, "a", 10, 2.0, 5.0), (2, "a", 20, 3.0, 5.0), (3, None, 5, 0.0, 1.0)],
                               "unit_id int, k string, pop bigint, area double, k_area double")
    out = density_enrichment(df, "pop", "area", "ud",
                             [DensityLevel("k", "kd", "k_area", True),
                              DensityLevel("k", "kd2", "area", False)]).orderBy("unit_id").collect()
    assert [r.ud for r in out] == [5.0, 20 / 3, None]
    assert [r.kd for r in out] == [6.0, 6.0, None]
    assert [r.kd2 for r in out] == [6.0, 6.0, None]
    assert out[0].kd2 == 30 / 5.0
    g = {r.k: r.d for r in group_density(df, "k", "pop", "area", "d", False).collect()}
    assert g[None] is None  # 5 / 0 -> NULL, the NULL group exists in the aggregate


def test_top3_ties_keep_list_order(spark):
    metrics = [f"m{i}" for i in range(7)]
    df = spark.createDataFrame([("s1", *[1.0] * 7), ("s2", *[1.0] * 7)],
                               "k string, " + ", ".join(f"{m} double" for m in metrics))
    d = explain_level(df, "k", metrics, 3).orderBy("k").collect()
    assert d[0].description == "Ranks highly in: m0: 0%, m1: 0%, m2: 0%"


def test_explain_null_key_is_peer_without_description(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0)], "k string, m double")
    d = {r.k: r.description for r in explain_level(df, "k", ["m"], 3).collect()}
    assert d == {"a": "Ranks highly in: m: 0%", "b": "Ranks highly in: m: 50%"}


def test_rank_golden_56_groups_8_all_null(spark):
    # 48 groups with distinct scores, 8 with only NULL scores share rank 49
    rows = [(f"g{i:02d}", float(100 - i)) for i in range(48)] + [(f"n{i}", None) for i in range(8)]
    df = spark.createDataFrame(rows, "k string, score double")
    centres = spark.createDataFrame([(f"g{i:02d}", 1.0, 2.0) for i in range(56) if i != 5],
                                    "key string, lat double, lon double")
    out = rank_level(df, "k", "score", 501, centres, "key").collect()
    ranks = sorted(r["rank"] for r in out)
    assert len(out) == 56 and ranks[:48] == list(range(1, 49)) and ranks[48:] == [49] * 8
    assert sum(r.lat is None for r in out) == 9  # g05 and the 8 n* keys have no centre
    assert rank_level(df, "k", "score", 10).count() == 10


def test_rank_drop_incomplete_before_rank(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0)], "k string, score double")
    centres = spark.createDataFrame([("a", 1.0, 1.0), ("c", 1.0, 1.0)], "k string, lat double, lon double")
    out = rank_level(df, "k", "score", 501, centres, drop_incomplete_before_rank=True).orderBy("rank").collect()
    assert [(r.k, r["rank"]) for r in out] == [("a", 1), ("c", 2)]


def test_serve_top_n_then_drop(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 1.0), ("b", 2, None, 1.0), ("c", 3, 1.0, 1.0),
                                ("d", 4, 1.0, 1.0)], "k string, rank int, lat double, lon double")
    assert [r.k for r in top_n(df, "k", 3).collect()] == ["a", "c"]


def test_table_page_and_header(spark):
    df = spark.createDataFrame([(f"k{i:02d}", i, 1.0, 1.0, "d") for i in range(25)],
                               "census_tract string, rank int, lat double, lon double, description string")
    page = table_page(df, "census_tract", "rank >= 3", [("rank", False)], page=1)
    assert page.columns == ["Census_Tract", "Rank"]
    assert [r.Rank for r in page.collect()] == list(range(14, 4, -1))
    assert title_header(df).columns == ["Census_Tract", "Rank"]


def test_pad_id_keeps_leading_zero(spark):
    df = spark.createDataFrame([("1073013300",), ("27073180300",)], "id string")
    assert [r.id for r in pad_id(df, "id").collect()] == ["01073013300", "27073180300"]


def test_grid_clusters(spark):
    df = spark.createDataFrame([(1, 10.1, 10.1), (3, 10.2, 10.2), (5, 50.0, 50.0)],
                               "rank int, lat double, lon double")
    out = sorted((r.point_count, r.mean_value) for r in grid_clusters(df, 3).collect())
    assert out == [(1, 5.0), (2, 2.0)]


def test_records_bounded(spark):
    import pytest
    from tractus.sinks.features import records
    df = spark.createDataFrame([(i, f"k{i}") for i in range(5)], "rank int, k string")
    assert len(records(df, 5)) == 5 and records(df, 5)[0].keys() == {"rank", "k"}
    with pytest.raises(ValueError):
        records(df, 4)


def test_level_table_partition_pruning(spark):
    from tractus.session import scratch_dir
    from tractus.sinks.files import write_parquet
    from tractus.sources.files import read_level_table
    df = spark.createDataFrame([("state", "a", 1), ("county", "b", 1)], "level string, name string, rank int")
    path = write_parquet(df, scratch_dir(spark, "lv"), ["level"])
    out = read_level_table(spark, path, "county", "name string, rank int, level string")
    assert [r.name for r in out.collect()] == ["b"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "county" in plan


def test_composite_county_key_keeps_same_names_apart(spark):
    # two states each have a county called "Kent": by name only they merge
    df = spark.createDataFrame([("A", "Kent", 1.0, 5.0), ("B", "Kent", 2.0, 1.0),
                                ("A", "Ada", 3.0, 2.0)], "state string, county string, m double, score double")
    by_name = rank_level(df, "county", "score").collect()
    assert len(by_name) == 2
    both = rank_level(df, ["state", "county"], "score",
                      descriptions=explain_level(df, ["state", "county"], ["m"], 1),
                      descriptions_key=["state", "county"]).orderBy("rank").collect()
    assert [(r.state, r.county, r["rank"]) for r in both] == [("A", "Kent", 1), ("A", "Ada", 2), ("B", "Kent", 3)]
    assert both[2].description == "Ranks highly in: m: 50%"
    mx = rank_level(df, "state", "score", agg="max").orderBy("rank").collect()
    assert [(r.state, r["rank"]) for r in mx] == [("A", 1), ("B", 2)]


def test_composite_score_strict_and_scaled(spark):
    from tractus.operators.score import composite_score
    df = spark.createDataFrame([(1, 10.0, 2.0, 5.0), (2, None, 1.0, 4.0), (3, 30.0, 3.0, None)],
                               "id int, a double, b double, d double")
    plain = {r.id: r.score for r in composite_score(df, ["a", "b"], "d").collect()}
    assert plain[2] is None                       # strict: any NULL term -> NULL
    assert float(plain[1]) == 12.0                # densest unit: percentile 0
    assert float(plain[3]) == 34.0                # NULL density ranks last: percentile 1
    scaled = {r.id: r.score for r in
              composite_score(df, ["a", "b"], "d", scales={"a": 0.1}).collect()}
    assert float(scaled[1]) == 3.0 and float(scaled[3]) == 7.0


def test_empty_inputs(spark):
    from tractus.operators.percentile import percent_rank
    from tractus.operators import geo as G
    empty = spark.createDataFrame([], "id int, v double, k string, score double")
    assert percent_rank(empty, "v", "p", True).count() == 0
    assert percent_rank(empty, "v", "p", True, ["k"]).count() == 0
    assert rank_level(empty, "k", "score").count() == 0
    g = spark.createDataFrame([(1, [])], "id int, geometry array<array<array<struct<x:double,y:double>>>>")
    assert G.interior_point_rows(g, ["id"]).first().x is None


def test_cluster_pyramid_sums_to_the_points_at_every_zoom(spark):
    import random
    r = random.Random(3)
    rows = [(r.uniform(-90, 90), r.uniform(-180, 180), None if i % 9 == 0 else i) for i in range(500)] + [(None, 1.0, 5), (1.0, None, 5)] + [(10.0, 20.0, 7)] * 200
    df = spark.createDataFrame(rows, "lat double, lon double, rank int")
    zooms = [0, 3, 5, 9]
    got = grid_cluster_pyramid(df, zooms).collect()
    for z in zooms:
        cell = 360.0 / 2 ** z
        want = {}
        for lat, lon, rank in rows:
            if lat is not None and lon is not None:
                want.setdefault((math.floor(lon / cell), math.floor(lat / cell)), []).append((rank, lat, lon))
        level = {(c.cell_x, c.cell_y): c for c in got if c.zoom == z}
        assert sum(c.point_count for c in level.values()) == 700 and set(level) == set(want)
        for k, points in want.items():
            ranks = [p[0] for p in points if p[0] is not None]
            assert level[k].point_count == len(points)
            assert level[k].mean_value == (sum(ranks) / len(ranks) if ranks else None)
            assert level[k].lat == pytest.approx(sum(p[1] for p in points) / len(points)) and level[k].lon == pytest.approx(sum(p[2] for p in points) / len(points))
        one = {(c.cell_x, c.cell_y): tuple(c) for c in grid_clusters(df, z).collect()}
        assert {k: (*k, *tuple(c)[3:]) for k, c in level.items()} == one
