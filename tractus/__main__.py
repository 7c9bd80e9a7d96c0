"""Command line: the whole ranking and the served view without a notebook.

    python -m tractus prepare --layer tracts.geojson --out /shared/layer
    python -m tractus rank --tracts tracts.csv --cities cities.csv \\
        --state-points state_points.csv --county-points county_points.csv \\
        --tract-points tract_points.csv --out /shared/ranked
    python -m tractus serve --ranked /shared/ranked --level city --n 20

``rank`` writes one parquet table partitioned by ``level``; ``serve``
reads one level (partition-pruned), takes the N best complete rows and
prints them as JSON lines (or GeoJSON features with ``--features``).
"""

from __future__ import annotations

import argparse
import json
import sys

SERVE_SIZES = (20, 50, 100, 200, 500)
LEVELS = ("state", "county", "city", "census_tract")
UNDESCRIBED = ("census_tract",)
RANKED_SCHEMA = ("name string, rank int, lat double, lon double, description string, "
                 "level string")


def _rank(args: argparse.Namespace) -> None:
    from tractus.plans.areas import rank_areas
    from tractus.session import get_session
    from tractus.sinks.files import write_parquet
    from tractus.sources.screening import read_centres, read_cities, read_tracts
    spark = get_session(args.master)
    if args.checkpoint_dir:
        spark.sparkContext.setCheckpointDir(args.checkpoint_dir)
    tracts = read_tracts(spark, args.tracts, args.format)
    if args.areas:
        from tractus.operators.layer import attach_areas
        tracts = attach_areas(tracts, spark.read.option("header", True).csv(args.areas).selectExpr(
            "GEOID10", "double(geo_area)", "double(cf_area)", "double(sf_area)"))
    table = rank_areas(tracts,
                       read_cities(spark, args.cities, args.format),
                       read_centres(spark, args.state_points, ["SF"]),
                       read_centres(spark, args.county_points, ["CF"]),
                       read_centres(spark, args.tract_points, ["GEOID10"]),
                       n=args.limit, ties=args.ties, match_places=args.match_places)
    write_parquet(table, args.out, ["level"])
    print(json.dumps({"written": args.out}))


def _prepare(args: argparse.Namespace) -> None:
    from tractus.operators.layer import prepare_layer
    from tractus.session import get_session
    from tractus.sinks.files import write_csv
    from tractus.sources.geojson import read_features
    spark = get_session(args.master)
    if args.checkpoint_dir:
        spark.sparkContext.setCheckpointDir(args.checkpoint_dir)
    layer = read_features(spark, args.layer, "GEOID10 string, CF string, SF string", collection=args.collection)
    p = prepare_layer(layer, srid=args.srid)
    for name, table in (("areas", p.areas), ("tract_points", p.unit_centres),
                        ("county_points", p.county_centres), ("state_points", p.state_centres)):
        print(json.dumps({"written": write_csv(table, f"{args.out.rstrip('/')}/{name}")}))


def _serve(args: argparse.Namespace) -> None:
    from tractus.operators.serve import features, serve_top_n
    from tractus.session import get_session
    from tractus.sinks.features import records
    from tractus.sources.files import read_level_csv, read_level_table
    spark = get_session(args.master)
    read = read_level_csv if args.format == "csv" else read_level_table
    ranked = read(spark, args.ranked, args.level, RANKED_SCHEMA)
    top = serve_top_n(ranked, "name", args.n, described=args.level not in UNDESCRIBED)
    if args.features:
        out = records(features(top, "name"), args.n)
        for r in out:
            print(r["feature"])
    else:
        for r in records(top, args.n):
            print(json.dumps(r))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="python -m tractus")
    p.add_argument("--master", default=None, help="Spark master (default: from spark-submit)")
    sub = p.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("rank", help="score, explain and rank all levels")
    for name in ("tracts", "cities", "state-points", "county-points", "tract-points", "out"):
        r.add_argument(f"--{name}", required=True)
    r.add_argument("--format", default="csv", help="tracts/cities format: csv or parquet")
    r.add_argument("--areas", default=None, help="area table made by prepare, joined to the tracts")
    r.add_argument("--limit", type=int, default=501)
    r.add_argument("--ties", choices=("one", "all"), default="one")
    r.add_argument("--match-places", action="store_true",
                   help="match the cities' county names by normalised names and common words")
    r.add_argument("--checkpoint-dir", default=None,
                   help="shared folder for materialized tables (else spark.checkpoint.dir)")
    r.set_defaults(fn=_rank)
    q = sub.add_parser("prepare", help="areas and centre tables from a polygon layer")
    q.add_argument("--layer", required=True, help="GeoJSON features with GEOID10, CF, SF")
    q.add_argument("--out", required=True, help="folder for areas, tract_, county_ and state_points")
    q.add_argument("--collection", action="store_true", help="the layer is one FeatureCollection document")
    q.add_argument("--srid", type=int, default=6933, choices=(6933, 3035))
    q.add_argument("--checkpoint-dir", default=None)
    q.set_defaults(fn=_prepare)
    s = sub.add_parser("serve", help="N best complete rows of one level")
    s.add_argument("--ranked", required=True)
    s.add_argument("--level", choices=LEVELS, default="city")
    s.add_argument("--format", choices=("parquet", "csv"), default="parquet",
                   help="parquet: the table that rank wrote; csv: a level's table with header")
    s.add_argument("--n", type=int, choices=SERVE_SIZES, default=20)
    s.add_argument("--features", action="store_true", help="GeoJSON point features")
    s.set_defaults(fn=_serve)
    args = p.parse_args(argv)
    args.fn(args)


if __name__ == "__main__":
    main(sys.argv[1:])
