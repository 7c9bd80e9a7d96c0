"""Command line: rank on CSV inputs, then serve one level."""

import json

import pytest

from tractus.__main__ import main
from tractus.session import scratch_dir
from tractus.sources.screening import INDICATOR_COLUMNS


def _write(path, header, rows):
    with open(path.removeprefix("file:") + "/part.csv", "w") as f:
        f.write(header + "\n")
        for r in rows:
            f.write(",".join("" if x is None else str(x) for x in r) + "\n")
    return path


def test_rank_then_serve(spark, capsys):
    ind = list(INDICATOR_COLUMNS)
    tracts = _write(scratch_dir(spark, "cli-t"),
                    ",".join(["Census tract ID", "County Name", "State", "Total population",
                              *[f'"{c}"' for c in ind], "geo_area", "cf_area", "sf_area"]),
                    [(f"{i:011d}", f"C{i % 4} County", f"S{i % 2}", 100 + i,
                      *[(i * (j + 3)) % 10 / 10 for j in range(7)], 1.0 + i % 3, 9.0, 20.0)
                     for i in range(8)])
    cities = _write(scratch_dir(spark, "cli-c"), "city,county_name,population,lat,lng,id",
                    [(f"Town{k}", f"C{k}", 10 * k, 30.0 + k, -90.0 - k, k) for k in range(4)])
    states = _write(scratch_dir(spark, "cli-s"), ",SF,lat,lon,geo_size", [(0, "S0", 31.0, -91.0, 1.0)])
    counties = _write(scratch_dir(spark, "cli-k"), ",CF,SF,lat,lon,geo_size",
                      [(k, f"C{k} County", "S0", 30.0, -90.0, 1.0) for k in range(4)])
    points = _write(scratch_dir(spark, "cli-p"), ",GEOID10,CF,SF,lat,lon,geo_size",
                    [(i, str(i), "C", "S", 30.0 + i, -90.0, 1.0) for i in range(8)])   # zeros lost
    out = scratch_dir(spark, "cli-out")
    main(["rank", "--tracts", tracts, "--cities", cities, "--state-points", states,
          "--county-points", counties, "--tract-points", points, "--out", out])
    capsys.readouterr()
    main(["serve", "--ranked", out, "--level", "county", "--n", "20"])
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert len(rows) == 4 and sorted(r["rank"] for r in rows) == [1, 2, 3, 4]
    assert all(r["description"].startswith("Ranks highly in: ") and " <br> " in r["tooltip"]
               for r in rows)
    main(["serve", "--ranked", out, "--level", "state", "--n", "20", "--features"])
    feats = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert len(feats) == 1 and feats[0]["geometry"]["coordinates"] == [-91.0, 31.0]
    main(["serve", "--ranked", out, "--level", "census_tract", "--n", "20"])
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert len(rows) == 8 and all(r["tooltip"] == r["name"] and r["lat"] == 30.0 + int(r["name"]) for r in rows)
    main(["serve", "--ranked", out, "--level", "city", "--n", "20"])
    assert all("Town" in json.loads(x)["name"] for x in capsys.readouterr().out.splitlines())


def test_serve_csv_level(spark, capsys):
    path = scratch_dir(spark, "level-csv").removeprefix("file:")
    with open(path + "/t.csv", "w") as f:
        f.write("extra,rank,name,lon,lat,description\nx,2,B,-1.5,3,late\ny,1,A,-2.5,4,early\nz,3,C,null,5,none\n")
    main(["serve", "--ranked", path, "--format", "csv", "--level", "county", "--n", "20"])
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(r["name"], r["rank"], r["lat"], r["lon"]) for r in rows] == [("A", 1, 4.0, -2.5), ("B", 2, 3.0, -1.5)]
    assert rows[0]["tooltip"] == "A <br> early"
    with open(path + "/t.csv", "w") as f:
        f.write("name,lat,lon\nA,1,2\n")
    with pytest.raises(ValueError, match="rank"):
        main(["serve", "--ranked", path, "--format", "csv", "--level", "county", "--n", "20"])


def test_prepare_layer(spark, capsys):
    """Areas and centre tables from a polygon layer; a county of two blocks and a U shape."""
    from tractus.operators.layer import attach_areas, prepare_layer
    from tractus.sinks.features import write_polygon_features

    from conftest import GEOM, poly

    def box(x, y, w=1, h=1):
        return poly([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)])

    u = poly([(20, 0), (29, 0), (29, 9), (26, 9), (26, 2), (22, 2), (22, 9), (20, 9), (20, 0)])
    rows = [("1", "A", "S", box(0, 0)), ("2", "A", "S", box(1, 0)), ("3", "A", "S", box(5, 0, 3)), ("4", "B", "T", u)]
    layer = spark.createDataFrame(rows, f"GEOID10 string, CF string, SF string, geometry {GEOM}")
    folder = scratch_dir(spark, "cli-layer")
    write_polygon_features(layer, folder)
    out = scratch_dir(spark, "cli-prepared")
    main(["prepare", "--layer", folder, "--out", out])
    assert len(capsys.readouterr().out.splitlines()) == 4
    read = lambda n: {r[0]: r for r in spark.read.option("header", True).csv(f"{out}/{n}").collect()}
    counties, tracts, areas = read("county_points"), read("tract_points"), read("areas")
    assert (float(counties["A"].lon), float(counties["A"].lat), counties["A"].SF) == (6.5, 0.5, "S")   # the wider block
    assert (float(tracts["4"].lon), float(tracts["4"].lat)) == (27.5, 5.5)                             # inside the wider arm
    own = [float(areas[i].geo_area) for i in "123"]
    assert abs(float(areas["1"].cf_area) - sum(own)) < 1e-6 and abs(own[2] - 3 * own[0]) < 1e-6 * own[2]
    p = prepare_layer(layer)
    t = attach_areas(spark.createDataFrame([("00000000001", 9.0), ("00000000077", 9.0)], "census_tract_id string, geo_area double"), p.areas)
    got = {r.census_tract_id: r.geo_area for r in t.collect()}
    assert abs(got["00000000001"] - own[0]) < 1e-6 and got["00000000077"] is None
