"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the
matching DuckDB oracle SQL.  Every query reads the driver tables (or
tables Spark derives from them) in full.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractus.plans import domain as D
from tractus.plans import oracle as O
from tractus.session import materialize
from tractus.sources import bindings as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- C3
@register("composite_score", O.chain() + """
SELECT unit_id, density_percentile, CAST(score AS DOUBLE) AS score FROM scored""")
def composite_score(spark, src):
    s = D.scored_units(spark, src)
    return s.select("unit_id", "density_percentile", F.col("score").cast("double").alias("score"))


# ---------------------------------------------------------------- C4
for _lv, _key in (("state", "state"), ("county", "county_name"), ("city", "city")):
    def _explain(spark, src, _lv=_lv):
        return D.explain(D.enriched_units(spark, src), _lv)
    register(f"explain_{_lv}", O.chain(O.explain_ctes(_key, _lv)) +
             f"\nSELECT k AS {_key}, description FROM desc_{_lv}")(_explain)


# ---------------------------------------------------------------- C5
for _lv in ("state", "county", "city", "tract"):
    def _rank(spark, src, _lv=_lv):
        return D.ranked(spark, src, _lv)
    register(f"rank_{_lv}", O.chain(O.ranked_ctes(_lv)) + f"\nSELECT * FROM ranked_{_lv}")(_rank)


# ============================================================ helpers
def _r(c, digits: int):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _units_sql(*extra: str) -> str:
    return O.ctes(O.CTE_UNITS, *extra)


# ------------------------------------------------------- S1 P1 P2 P3 P9
@register("scan_project_rename", """
SELECT c_custkey AS unit_id, c_name AS name, c_nationkey AS nation_key, c_acctbal AS balance
FROM customer""")
def scan_project_rename(spark, src):
    from tractus.operators.columns import drop, project, rename
    from tractus.sources.tables import read_table
    c = read_table(spark, src, "customer",
                   ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], B.TABLE_TYPES)
    c = rename(c, {"c_custkey": "unit_id", "c_name": "name", "c_nationkey": "nation_key",
                   "c_acctbal": "balance"})
    return drop(project(c, "unit_id", "name", "nation_key", "balance", "c_mktsegment"),
                "c_mktsegment")


# --------------------------------------------------------------- P11
@register("preview_units", _units_sql() + """
SELECT unit_id, county_name, state, population FROM units ORDER BY unit_id LIMIT 5""")
def preview_units(spark, src):
    from tractus.operators.columns import preview
    u = B.units(spark, src).select("unit_id", "county_name", "state", "population")
    return preview(u, 5, ["unit_id"])


# ---------------------------------------------------------- S2 S3 K1
_CSV_SCHEMA = "CF string, SF string, lat double, lon double"


@register("csv_null_scan", f"""
SELECT n_name AS CF, r_name AS SF,
       CASE WHEN n_nationkey NOT IN {B.COUNTY_CENTRES_MISSING} THEN CAST(25 + n_nationkey AS DOUBLE) END AS lat,
       CASE WHEN n_nationkey NOT IN {B.COUNTY_CENTRES_MISSING} THEN CAST(-120 + 2 * n_nationkey AS DOUBLE) END AS lon
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def csv_null_scan(spark, src):
    from tractus.session import scratch_dir
    from tractus.sinks.files import write_csv
    from tractus.sources.files import read_csv
    from tractus.sources.tables import read_table
    n = read_table(spark, src, "nation", ["n_name", "n_regionkey"], B.TABLE_TYPES)
    r = read_table(spark, src, "region", ["r_regionkey", "r_name"], B.TABLE_TYPES)
    names = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_name").alias("CF"), F.col("r_name").alias("SF"))
    table = names.join(B.county_centres(spark, src).drop("SF"), "CF", "left")
    path = write_csv(table, scratch_dir(spark, "csv"))
    return read_csv(spark, path, _CSV_SCHEMA, null_value="null")


# ----------------------------------------------------------------- K2
@register("json_records_roundtrip", O.ctes(O.CTE_TRACT_CENTRES) + "\nSELECT * FROM tract_centres")
def json_records_roundtrip(spark, src):
    from tractus.session import scratch_dir
    from tractus.sinks.files import write_json_records
    from tractus.sources.files import read_json_records
    path = write_json_records(B.tract_centres(spark, src), scratch_dir(spark, "json"))
    return read_json_records(spark, path, "GEOID10 bigint, lat double, lon double")


# ---------------------------------------------------------- P4 P5 P8
@register("unit_density", _units_sql() + """
SELECT lpad(CAST(unit_id AS VARCHAR), 11, '0') AS census_tract_id, population, geo_area,
       CAST(population AS DOUBLE) / nullif(geo_area, 0) AS unit_density,
       geo_area * CAST(1e-06 AS DOUBLE) AS geo_area_km2
FROM units""")
def unit_density(spark, src):
    from tractus.operators.columns import pad_id, scale_columns
    from tractus.operators.density import unit_density as ud
    u = B.units(spark, src).select("unit_id", "population", "geo_area")
    u = ud(u, "population", "geo_area", "unit_density")
    u = scale_columns(u.withColumn("geo_area_km2", F.col("geo_area")), ["geo_area_km2"], 1e-6)
    return pad_id(u, "unit_id").withColumnRenamed("unit_id", "census_tract_id")


# ------------------------------------------------------ C1 T1 W1 F1 J1
@register("principal_place", O.ctes(O.CTE_UNITS, O.CTE_PLACES) + f"""
, best_all AS (
  SELECT * FROM (
    SELECT '{B.NATION_PREFIX}' || county_name AS region_key, city, lat AS city_lat,
           lng AS city_lon, id AS city_id,
           rank() OVER (PARTITION BY '{B.NATION_PREFIX}' || county_name
                        ORDER BY population DESC NULLS LAST) AS r
    FROM places) t WHERE r = 1)
SELECT u.unit_id, u.county_name, b.city, b.city_id, b.city_lat, b.city_lon
FROM units u LEFT JOIN best_all b ON u.county_name = b.region_key""")
def principal_place(spark, src):
    from tractus.operators.places import attach_principal_place
    u = B.units(spark, src).select("unit_id", "county_name")
    out = attach_principal_place(u, B.places(spark, src), prefix=B.NATION_PREFIX,
                                 ties="all", keep=D.PLACE_KEEP)
    return out.select("unit_id", "county_name", "city", "city_id", "city_lat", "city_lon")


_NAME_SQL = "regexp_replace(trim(regexp_replace(strip_accents(lower({})), '[^a-z0-9]+', ' ', 'g')), '( (county|parish|borough))+$', '')"


@register("place_keys_repaired", f"""
WITH u AS (
  SELECT DISTINCT r_name AS state, 'San José ' || n_name || ' County' AS unit, {_NAME_SQL.format("'San José ' || n_name || ' County'")} AS name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
s AS (
  SELECT r_name AS state, CASE s_nationkey % 5 WHEN 0 THEN 'San José ' || n_name || ' County' WHEN 1 THEN 'SAN JOSE ' || n_name || ' PARISH'
         WHEN 2 THEN 'Sán José ' || replace(n_name, '_', '-') || ' Borough' WHEN 3 THEN 'San José de ' || n_name
         ELSE '{B.UNMATCHED_PREFIX}' || CAST(s_nationkey AS VARCHAR) END AS place
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT state, place, {_NAME_SQL.format('place')} AS name, count(*) AS n_places FROM s GROUP BY state, place),
j AS (
  SELECT p.state, p.place, u.unit, u.unit = p.place AS same, u.name = p.name AS alike,
         len(list_intersect(string_split(p.name, ' '), string_split(u.name, ' ')))
         / CAST(len(list_distinct(string_split(p.name, ' ') || string_split(u.name, ' '))) AS DOUBLE) AS share
  FROM p JOIN u ON u.state = p.state),
best AS (
  SELECT state, place, max(CASE WHEN same THEN unit END) AS same_unit, max(CASE WHEN alike THEN unit END) AS alike_unit,
         arg_max(unit, share) AS near_unit, max(share) AS share FROM j GROUP BY state, place),
tops AS (SELECT state, place, count(*) AS n FROM j JOIN best USING (state, place) WHERE j.share = best.share GROUP BY state, place)
SELECT state, place AS county_name, n_places,
       CASE WHEN same_unit IS NOT NULL THEN same_unit WHEN alike_unit IS NOT NULL THEN alike_unit WHEN share >= 0.6 AND n = 1 THEN near_unit END AS matched_key,
       CASE WHEN same_unit IS NOT NULL THEN 'exact' WHEN alike_unit IS NOT NULL THEN 'normalised' WHEN share >= 0.6 AND n = 1 THEN 'similar'
            WHEN share >= 0.6 THEN 'ambiguous' ELSE 'unmatched' END AS how,
       CASE WHEN same_unit IS NOT NULL OR alike_unit IS NOT NULL THEN 1.0::DOUBLE WHEN share >= 0.6 AND n = 1 THEN share END AS similarity
FROM p LEFT JOIN best USING (state, place) LEFT JOIN tops USING (state, place)""")
def place_keys_repaired(spark, src):
    from tractus.operators.place_keys import match_keys
    return match_keys(B.spelled_counties(spark, src), B.spelled_places(spark, src), block=("state",))


# ----------------------------------------------------------------- J5
@register("inner_merge_area", _units_sql() + """
, ca AS (SELECT county_name, SUM(geo_area) AS county_area FROM units GROUP BY county_name)
SELECT u.unit_id, u.county_name, ca.county_area
FROM units u JOIN ca ON u.county_name = ca.county_name""")
def inner_merge_area(spark, src):
    from tractus.operators.joins import join_using
    u = B.units(spark, src)
    ca = u.groupBy("county_name").agg(F.sum("geo_area").alias("county_area"))
    return join_using(u.select("unit_id", "county_name"), ca, "county_name", "inner")


# ----------------------------------------------------------------- J4
@register("composite_key_left_join", _units_sql() + """
SELECT l.unit_id, l.county_name, l.state, l.population, r.geo_area, r.cf_area, r.sf_area
FROM units l LEFT JOIN (SELECT unit_id, county_name, state, geo_area, cf_area, sf_area
                        FROM units WHERE geo_area > 0) r
  ON l.unit_id = r.unit_id AND l.county_name = r.county_name AND l.state = r.state""")
def composite_key_left_join(spark, src):
    from tractus.operators.joins import join_using
    u = B.units(spark, src)
    left = u.select("unit_id", "county_name", "state", "population")
    right = u.filter(F.col("geo_area") > 0).select("unit_id", "county_name", "state",
                                                   "geo_area", "cf_area", "sf_area")
    return join_using(left, right, ["unit_id", "county_name", "state"], "left")


# -------------------------------------------------------------- A1 A2
@register("group_density_replicated", _units_sql() + """
SELECT county_name, CAST(SUM(population) AS DOUBLE) / nullif(MAX(cf_area), 0) AS county_density
FROM units GROUP BY county_name""")
def group_density_replicated(spark, src):
    from tractus.operators.density import group_density
    return group_density(B.units(spark, src), "county_name", "population", "cf_area",
                         "county_density", replicated=True)


@register("group_density_additive", _units_sql() + """
SELECT state, CAST(SUM(population) AS DOUBLE) / nullif(SUM(geo_area), 0) AS state_density
FROM units GROUP BY state""")
def group_density_additive(spark, src):
    from tractus.operators.density import group_density
    return group_density(B.units(spark, src), "state", "population", "geo_area",
                         "state_density", replicated=False)


# ----------------------------------------------------------- C2 J2 J3
@register("density_enrichment", O.chain() + """
SELECT unit_id, city, unit_density, county_density, state_density, city_density FROM enriched""")
def density_enrichment(spark, src):
    return D.enriched_units(spark, src).select("unit_id", "city", "unit_density", "county_density",
                                               "state_density", "city_density")


# ----------------------------------------------------------------- W2
_W2_SQL = O.chain() + """
SELECT unit_id, unit_density, density_percentile FROM pctd"""


@register("global_percentile_desc", _W2_SQL)
def global_percentile_desc(spark, src):
    return global_percentile_distributed(spark, src)


@register("global_percentile_distributed", _W2_SQL)
def global_percentile_distributed(spark, src):
    from tractus.operators.score import density_percentile
    # the two columns alone: the indicators' joins fall away
    e = materialize(D.enriched_units(spark, src).select("unit_id", "unit_density"), "densities")
    return density_percentile(e, "unit_density", "density_percentile")


# ---------------------------------------------------------- A3 R1 W3 W5
def _sums_sql(key: str) -> str:
    cols = ", ".join(f'CAST(SUM("{m}") AS DOUBLE) AS "{m}"' for m in O.IND)
    return f"sums AS (SELECT {key}, {cols} FROM units GROUP BY {key})"


def _long_sql(key: str) -> str:
    unions = " UNION ALL ".join(
        f"SELECT {key}, '{m}' AS variable, {i} AS pos, \"{m}\" AS value FROM sums"
        for i, m in enumerate(O.IND))
    return f"long AS ({unions})"


@register("metric_sums", _units_sql(_sums_sql("state")) + "\nSELECT * FROM sums")
def metric_sums(spark, src):
    from tractus.operators.explain import metric_sums as ms
    return ms(B.units(spark, src), "state", B.INDICATORS)


@register("unpivot_metrics", _units_sql(_sums_sql("state"), _long_sql("state")) +
          "\nSELECT * FROM long")
def unpivot_metrics(spark, src):
    from tractus.operators.explain import metric_sums as ms
    from tractus.operators.explain import unpivot_metrics as um
    return um(ms(B.units(spark, src), "state", B.INDICATORS), "state", B.INDICATORS)


_W3_SQL = _units_sql(_sums_sql("county_name"), _long_sql("county_name"), """
pct AS (SELECT county_name, variable, pos,
               percent_rank() OVER (PARTITION BY variable ORDER BY value ASC NULLS FIRST) AS value
        FROM long)""")


def _peer(spark, src):
    from tractus.operators.explain import metric_sums as ms
    from tractus.operators.explain import peer_percentiles, unpivot_metrics as um
    sums = materialize(ms(B.units(spark, src), "county_name", B.INDICATORS), "metric-sums")
    return peer_percentiles(um(sums, "county_name", B.INDICATORS))


@register("peer_percentiles", _W3_SQL + "\nSELECT * FROM pct")
def peer_percentiles_q(spark, src):
    return _peer(spark, src)


@register("peer_percentiles_distributed", _W3_SQL + "\nSELECT * FROM pct")
def peer_percentiles_distributed(spark, src):
    return _peer(spark, src)


@register("top3_metrics", _W3_SQL + """
SELECT * FROM (
  SELECT county_name, variable, pos, value,
         CAST(row_number() OVER (PARTITION BY county_name ORDER BY value DESC NULLS LAST, pos ASC)
              AS INTEGER) AS rn
  FROM pct WHERE county_name IS NOT NULL) t
WHERE rn <= 3""")
def top3_metrics(spark, src):
    from tractus.operators.explain import top_metrics
    return top_metrics(_peer(spark, src), "county_name", 3)


# ---------------------------------------------------------------- C6
def _served_sql(n: int = 20) -> str:
    return f"""
served AS (
  SELECT *, county_name || ' <br> ' || description AS tooltip FROM (
    SELECT * FROM ranked_county ORDER BY rank ASC NULLS LAST, county_name ASC NULLS FIRST
    LIMIT {n}) t
  WHERE county_name IS NOT NULL AND rank IS NOT NULL AND lat IS NOT NULL
    AND lon IS NOT NULL AND description IS NOT NULL)"""


def _served(spark, src, n: int = 20):
    from tractus.operators.serve import serve_top_n
    return serve_top_n(D.ranked(spark, src, "county"), "county_name", n)


@register("serve_top_n", O.chain(O.ranked_ctes("county"), _served_sql()) + "\nSELECT * FROM served")
def serve_top_n_q(spark, src):
    return _served(spark, src)


@register("serve_top_n_tract", O.chain(O.ranked_ctes("tract")) + """
SELECT *, CAST(unit_id AS VARCHAR) AS tooltip FROM (
  SELECT * FROM ranked_tract ORDER BY rank ASC NULLS LAST, unit_id ASC NULLS FIRST LIMIT 20) t
WHERE unit_id IS NOT NULL AND rank IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL""")
def serve_top_n_tract(spark, src):
    from tractus.operators.serve import serve_top_n
    ranked = D.ranked(spark, src, "tract").withColumn("description", F.lit(None).cast("string"))
    return serve_top_n(ranked, "unit_id", 20, described=False).drop("description")


@register("serve_table_page", O.chain(O.ranked_ctes("county")) + """
SELECT county_name AS County_Name, rank AS Rank FROM ranked_county
WHERE rank <= 20
ORDER BY lat DESC NULLS LAST, rank ASC NULLS FIRST, county_name ASC NULLS FIRST
LIMIT 10 OFFSET 10""")
def serve_table_page(spark, src):
    from tractus.operators.serve import table_page
    return table_page(D.ranked(spark, src, "county"), "county_name", "rank <= 20",
                      [("lat", False), ("rank", True)], page=1)


@register("serve_features", O.chain(O.ranked_ctes("county"), _served_sql()) + """
SELECT county_name, CAST(json_object(
    'type', 'Feature',
    'geometry', json_object('type', 'Point', 'coordinates', json_array(lon, lat)),
    'properties', json_object('county_name', county_name, 'rank', rank,
                              'description', description, 'tooltip', tooltip)) AS VARCHAR) AS feature
FROM served""")
def serve_features(spark, src):
    from tractus.operators.serve import features
    return features(_served(spark, src), "county_name")


@register("serve_domain_extent", O.chain(O.ranked_ctes("county"), _served_sql()) + """
SELECT 0 AS vmin, max(rank) AS vmax, min(lat) AS south, max(lat) AS north,
       min(lon) AS west, max(lon) AS east, count(*) AS n
FROM served""")
def serve_domain_extent(spark, src):
    from tractus.operators.serve import domain_extent
    return domain_extent(_served(spark, src))


@register("csv_inferred_scan", """
SELECT lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS geoid, c_custkey AS number, c_acctbal AS amount,
       c_custkey % 2 = 0 AS even, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment
FROM customer""")
def csv_inferred_scan(spark, src):
    from tractus.session import scratch_dir
    from tractus.sinks.files import write_csv
    from tractus.sources.files import read_csv_inferred
    c = B._read(spark, src, "customer", ["c_custkey", "c_acctbal", "c_mktsegment"])
    k = F.col("c_custkey")
    rows = c.select(F.lpad(k.cast("string"), 11, "0").alias("geoid"), k.alias("number"), F.col("c_acctbal").alias("amount"),
                    (k % 2 == 0).alias("even"), F.when(k % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    return read_csv_inferred(spark, write_csv(rows, scratch_dir(spark, "csv")))


#: Rows of a range of the page index, and the pages asked for as shares of the table.
PAGE_RANGE_ROWS = 500
PAGE_SHARES = (0, 3, 7)


@register("serve_indexed_pages", O.chain() + f""", placed AS (
  SELECT unit_id, score, row_number() OVER (ORDER BY score DESC NULLS LAST, unit_id) - 1 AS position, count(*) OVER () AS n FROM scored)
SELECT unit_id, score, position FROM placed, (VALUES {', '.join(f'({k})' for k in PAGE_SHARES)}) s(k)
WHERE position // 10 = ((n + 9) // 10) * k // 8""")
def serve_indexed_pages(spark, src):
    from functools import reduce

    from tractus.operators.pages import n_pages, read_page, write_pages
    from tractus.session import scratch_dir
    scored, order = D.scored_units(spark, src).select("unit_id", "score"), [("score", False), ("unit_id", True)]
    path = write_pages(scored, scratch_dir(spark, "pages"), order, PAGE_RANGE_ROWS)
    pages = n_pages(spark, path)
    return reduce(lambda a, b: a.unionByName(b), [read_page(spark, path, scored.schema, order, pages * k // 8) for k in PAGE_SHARES])


#: Rows of a range of the layer store, low so that small layers have several.
LAYER_RANGE_ROWS = 500


@register("layer_extent", O.ctes(O.CTE_CORNERS) + """
, boxes AS (SELECT GEOID10, SF, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM corners GROUP BY GEOID10, SF),
asked AS (SELECT min(xmin) AS x0, min(ymin) AS y0, max(xmax) AS x1, min(ymin) + (max(ymax) - min(ymin)) / 4 AS y1 FROM boxes WHERE SF = 'S1')
SELECT b.* FROM boxes b, asked WHERE xmin <= x1 AND xmax >= x0 AND ymin <= y1 AND ymax >= y0""")
def layer_extent(spark, src):
    from tractus.operators.layer_store import BOX, bounds, read_extent, write_layer
    from tractus.session import scratch_dir
    cells = B.cells(spark, src).select("GEOID10", "SF", "geometry")
    path = write_layer(cells, scratch_dir(spark, "layer"), range_rows=LAYER_RANGE_ROWS)
    x0, y0, x1, y1 = (cells.where("SF = 'S1'").select(*bounds()).agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first())
    if x0 is None:
        return cells.limit(0).select("GEOID10", "SF", *bounds())
    return read_extent(spark, path, cells.schema, x0, y0, x1, y0 + (y1 - y0) / 4).select("GEOID10", "SF", *BOX)


GRID_ZOOM = 9
PYRAMID_ZOOMS = list(range(3, 13))


_POINTS_SQL = """
, points AS (SELECT lat, lon, score FROM scored LEFT JOIN tract_centres ON GEOID10 = unit_id WHERE lat IS NOT NULL AND lon IS NOT NULL)"""
_MEANS_SQL = """count(*) AS point_count, CAST(sum(score) AS DOUBLE) / CAST(nullif(count(score), 0) AS DOUBLE) AS mean_value,
       round(CAST(sum(CAST(lat AS DECIMAL(24,12))) AS DOUBLE) / count(*), 6) AS lat,
       round(CAST(sum(CAST(lon AS DECIMAL(24,12))) AS DOUBLE) / count(*), 6) AS lon"""


def _scored_points(spark, src):
    """Every scored tract with its point (none where the centre is unknown)."""
    from tractus.operators.joins import left_join_renamed
    scored = D.scored_units(spark, src).select("unit_id", "score")
    return left_join_renamed(scored, B.tract_centres(spark, src), "unit_id", "GEOID10")


@register("grid_clusters", O.chain() + _POINTS_SQL + f"""
SELECT CAST(floor(lon / {O._d(360.0 / 2 ** GRID_ZOOM)}) AS BIGINT) AS cell_x,
       CAST(floor(lat / {O._d(360.0 / 2 ** GRID_ZOOM)}) AS BIGINT) AS cell_y, {_MEANS_SQL}
FROM points GROUP BY 1, 2""")
def grid_clusters(spark, src):
    from tractus.operators.serve import grid_clusters as gc
    out = gc(_scored_points(spark, src), GRID_ZOOM, value="score")
    return out.withColumn("lat", _r("lat", 6)).withColumn("lon", _r("lon", 6))


# ============================================================ geometry
def _corners_xy(g):
    """Ring-0 corners 0..3 of each cell as (GEOID10, idx, x, y)."""
    return (g.select("GEOID10", F.posexplode(F.col("geometry")[0][0]).alias("idx", "p"))
            .filter(F.col("idx") < 4)
            .select("GEOID10", "idx", F.col("p.x").alias("x"), F.col("p.y").alias("y")))


for _srid in (6933, 3035):
    def _proj(spark, src, _srid=_srid):
        from tractus.operators.geo import project
        xy = _corners_xy(project(B.cells(spark, src), _srid))
        return xy.select("GEOID10", "idx", _r("x", 2).alias("x"), _r("y", 2).alias("y"))
    register(f"project_{_srid}", O.ctes(O.CTE_CORNERS, O.projected_corners_cte(_srid)) + """
SELECT GEOID10, idx, round(x, 2) AS x, round(y, 2) AS y FROM pcorners WHERE idx < 4""")(_proj)


def _unit_areas(spark, src):
    from tractus.operators.geo import project, with_area
    return with_area(project(B.cells(spark, src), 6933), "geo_area", scale=1e-6)


_AREA_SQL = O.ctes(O.CTE_CORNERS, O.projected_corners_cte(6933), O.unit_area_cte())


@register("unit_area", _AREA_SQL + """
SELECT GEOID10, round(area * CAST(1e-06 AS DOUBLE), 6) AS geo_area FROM uarea""")
def unit_area(spark, src):
    return _unit_areas(spark, src).select("GEOID10", _r("geo_area", 6).alias("geo_area"))


def _area_table(spark, src):
    from tractus.operators.geo import areas_by_keys
    a = _unit_areas(spark, src).select("GEOID10", "CF", "SF", "geo_area")
    return areas_by_keys(a, "geo_area", {"cf_area": "CF", "sf_area": "SF"})


_AREA_KEYS_SQL = """
akeys AS (
  SELECT GEOID10, CF, SF, area * CAST(1e-06 AS DOUBLE) AS geo_area,
         SUM(area * CAST(1e-06 AS DOUBLE)) OVER (PARTITION BY CF) AS cf_area,
         SUM(area * CAST(1e-06 AS DOUBLE)) OVER (PARTITION BY SF) AS sf_area
  FROM uarea)"""


@register("area_by_key", _AREA_SQL + "," + _AREA_KEYS_SQL.strip("\n") + """
SELECT GEOID10, CF, SF, round(geo_area, 6) AS geo_area, round(cf_area, 6) AS cf_area,
       round(sf_area, 6) AS sf_area
FROM akeys""")
def area_by_key(spark, src):
    t = _area_table(spark, src)
    return t.select("GEOID10", "CF", "SF", *[_r(c, 6).alias(c) for c in ("geo_area", "cf_area", "sf_area")])


_OUTLINE_SQL = O.ctes(O.CTE_CORNERS, O.CTE_CELL_EDGES, O.outline_ctes("CF"))


@register("dissolve_outline", _OUTLINE_SQL + """
SELECT k AS CF, qx0, qy0, qx1, qy1 FROM outline""")
def dissolve_outline(spark, src):
    from tractus.operators.geo import dissolve
    return dissolve(B.cells(spark, src), "CF").select("CF", "qx0", "qy0", "qx1", "qy1")


@register("dissolve_attributes", O.ctes(O.CTE_CORNERS) + """
SELECT CF, arg_min(SF, GEOID10) AS SF, min(GEOID10) AS first_unit
FROM corners WHERE idx = 0 GROUP BY CF""")
def dissolve_attributes(spark, src):
    from tractus.operators.geo import dissolve_attributes as da
    c = B.cells(spark, src)
    return da(c, "CF", "GEOID10", ["SF"]).join(
        c.groupBy("CF").agg(F.min("GEOID10").alias("first_unit")), "CF")


@register("outline_area", O.ctes(O.CTE_CORNERS, O.CTE_CELL_EDGES, O.outline_ctes("SF")) + """
SELECT k AS SF, CAST(SUM(CAST(qx0 AS HUGEINT) * qy1 - CAST(qx1 AS HUGEINT) * qy0) AS DOUBLE)
       / CAST(2e14 AS DOUBLE) AS area
FROM outline GROUP BY k""")
def outline_area(spark, src):
    from tractus.operators.geo import dissolve, outline_area as oa
    return oa(dissolve(B.cells(spark, src), "SF"), "SF")


_IPOINT_UNIT_SQL = """
ip_unit AS (
  SELECT a.GEOID10, (a.x + b.x) / CAST(2.0 AS DOUBLE) AS x, (a.y + c.y) / CAST(2.0 AS DOUBLE) AS y
  FROM corners a JOIN corners b ON a.GEOID10 = b.GEOID10 AND b.idx = 1
       JOIN corners c ON a.GEOID10 = c.GEOID10 AND c.idx = 2
  WHERE a.idx = 0)"""


def _unit_points(spark, src):
    from tractus.operators.geo import interior_point_rows
    return interior_point_rows(B.cells(spark, src), ["GEOID10"])


@register("interior_point", O.ctes(O.CTE_CORNERS, _IPOINT_UNIT_SQL) + "\nSELECT * FROM ip_unit")
def interior_point_q(spark, src):
    return _unit_points(spark, src)


@register("interior_point_outline", O.ctes(O.CTE_CORNERS, O.CTE_CELL_EDGES, O.outline_ctes("CF"),
                                           O.scanline_ctes("outline")) + """
SELECT k AS CF, x, y FROM ipoint""")
def interior_point_outline(spark, src):
    from tractus.operators.geo import dissolve, interior_point
    return interior_point(dissolve(B.cells(spark, src), "CF"), ["CF"], None)


# Every county of the cell layer is one connected block, so the per-part
# result equals the one-scan-line SQL above; multi-part regions are
# covered by tests/test_geo.py against hand-computed points.
@register("interior_point_parts", O.ctes(O.CTE_CORNERS, O.CTE_CELL_EDGES, O.outline_ctes("CF"),
                                         O.scanline_ctes("outline")) + """
SELECT k AS CF, x, y FROM ipoint""")
def interior_point_parts(spark, src):
    from tractus.operators.geo import interior_point_parts as ipp
    return ipp(B.cells(spark, src), "CF", "GEOID10")


@register("layer_geojson_roundtrip", O.ctes(O.CTE_CORNERS) + """
SELECT GEOID10, CF, SF, CAST(count(*) AS INTEGER) AS n_points, min(x) AS min_x, max(x) AS max_x,
       min(y) AS min_y, max(y) AS max_y
FROM corners GROUP BY GEOID10, CF, SF""")
def layer_geojson_roundtrip(spark, src):
    from tractus.session import scratch_dir
    from tractus.sinks.features import write_polygon_features
    from tractus.sinks.files import write_parquet
    from tractus.sources.geojson import read_features
    pq = write_parquet(B.cells(spark, src), scratch_dir(spark, "layer"), ["SF"])
    layer = spark.read.parquet(pq)
    gj = write_polygon_features(layer, scratch_dir(spark, "geojson"))
    back = read_features(spark, gj, "GEOID10 bigint, CF string, SF string, geo_size double")
    ring = F.col("geometry")[0][0]
    xs = F.transform(ring, lambda p: p["x"])
    ys = F.transform(ring, lambda p: p["y"])
    return back.select("GEOID10", "CF", "SF", F.size(ring).alias("n_points"),
                       F.array_min(xs).alias("min_x"), F.array_max(xs).alias("max_x"),
                       F.array_min(ys).alias("min_y"), F.array_max(ys).alias("max_y"))


@register("collection_roundtrip", O.ctes(O.CTE_CORNERS) + f"""
SELECT GEOID10, CF, SF, CAST(idx AS INTEGER) AS pos, {O._qz('x')} AS qx, {O._qz('y')} AS qy FROM corners""")
def collection_roundtrip(spark, src):
    from tractus.session import scratch_dir
    from tractus.sinks.features import polygon_feature, write_collection
    from tractus.sources.collection import read_collection
    layer = B.cells(spark, src)
    path = write_collection(layer.select(polygon_feature(layer).alias("feature")), scratch_dir(spark, "collection"), name='cells {"a}')
    back = read_collection(spark, path, "GEOID10 bigint, CF string, SF string", one_document=True)
    points = back.select("GEOID10", "CF", "SF", F.posexplode(F.col("geometry")[0][0]).alias("pos", "p"))
    return points.select("GEOID10", "CF", "SF", "pos", *[F.round(F.col(f"p.{c}") / F.lit(1e-7)).cast("bigint").alias(f"q{c}") for c in "xy"])


def _polygon_sql(key: str, edges: str = "cedges", *more: str) -> str:
    head = O.ctes(O.CTE_CORNERS, O.CTE_CELL_EDGES, *more, O.polygon_ctes(edges, key)).replace("WITH", "WITH RECURSIVE", 1)
    return head + f"""
SELECT k AS {key}, CAST(part_no AS INTEGER) AS part, CAST(ring AS INTEGER) AS ring, CAST(pos AS INTEGER) AS pos, qx, qy FROM polygons"""


def _polygon_points(polygons, key: str):
    """A row per point: polygon, ring (0: the shell) and place, all from 0, and the coordinates in 1e-7 degrees."""
    parts = polygons.select(key, F.posexplode("geometry").alias("part", "rings"))
    points = parts.select(key, "part", F.posexplode("rings").alias("ring", "points")).select(key, "part", "ring", F.posexplode("points").alias("pos", "p"))
    return points.select(key, "part", "ring", "pos", *[F.round(F.col(f"p.{c}") / F.lit(1e-7)).cast("bigint").alias(f"q{c}") for c in "xy"])


def _written_polygons(layer, spark, key: str):
    """The merged polygons written as GeoJSON features and read back."""
    from tractus.operators.rings import region_polygons
    from tractus.session import scratch_dir
    from tractus.sinks.features import write_polygon_features
    from tractus.sources.geojson import read_features
    path = write_polygon_features(region_polygons(layer, key, "GEOID10"), scratch_dir(spark, "polygons"))
    return read_features(spark, path, f"{key} string, area double")


@register("county_polygons", _polygon_sql("CF"))
def county_polygons(spark, src):
    return _polygon_points(_written_polygons(B.cells(spark, src), spark, "CF"), "CF")


@register("state_polygons", _polygon_sql("SF"))
def state_polygons(spark, src):
    return _polygon_points(_written_polygons(B.cells(spark, src), spark, "SF"), "SF")


@register("zone_polygons", _polygon_sql("ZONE", "zedges", O.CTE_ZONES))
def zone_polygons(spark, src):
    return _polygon_points(_written_polygons(B.zones(spark, src), spark, "ZONE"), "ZONE")


@register("noded_polygons", _polygon_sql("CF", "sedges", O.CTE_HALVED, O.CTE_SPLIT_EDGES))
def noded_polygons(spark, src):
    from tractus.operators.rings import region_polygons
    return _polygon_points(region_polygons(B.split_cells(spark, src), "CF", "GEOID10"), "CF")


@register("coverage_check", f"""
WITH pairs AS (
  SELECT a.c_custkey AS k, b.c_custkey AS right_k FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1
  WHERE a.c_custkey % {B.MOVED_MODULUS} = 0 AND a.c_custkey % {B.GRID_COLUMNS} < {B.GRID_COLUMNS - 1})
SELECT unnest([k, right_k]) AS GEOID10, fault, CAST(2 AS BIGINT) AS n FROM pairs, (VALUES ('edge'), ('vertex')) f(fault)""")
def coverage_check(spark, src):
    """Units that were moved over a neighbour: the neighbour's sides are held twice, and corners overlap."""
    from tractus.operators.coverage import coverage_faults
    return coverage_faults(B.moved_cells(spark, src), "CF", "GEOID10")


@register("point_layer_roundtrip", O.ctes(O.CTE_TRACT_CENTRES) + "\nSELECT * FROM tract_centres")
def point_layer_roundtrip(spark, src):
    from tractus.session import scratch_dir
    from tractus.sinks.features import point_feature
    from tractus.sources.geojson import read_features
    t = B.tract_centres(spark, src)
    path = scratch_dir(spark, "points")
    t.select(point_feature(t, "lat", "lon").alias("value")).write.mode("overwrite").text(path)
    back = read_features(spark, path, "GEOID10 bigint")
    return back.select("GEOID10", F.col("point.y").alias("lat"), F.col("point.x").alias("lon"))


# ----------------------------------------------------------------- C7
@register("layer_prep", O.ctes(O.CTE_UNITS, O.CTE_CORNERS, O.projected_corners_cte(6933),
                               O.unit_area_cte(), _AREA_KEYS_SQL, _IPOINT_UNIT_SQL) + """
SELECT u.unit_id, u.county_name, u.state, round(a.geo_area, 6) AS geo_area,
       round(a.cf_area, 6) AS cf_area, round(a.sf_area, 6) AS sf_area, p.y AS lat, p.x AS lon
FROM units u LEFT JOIN akeys a ON u.unit_id = a.GEOID10
     LEFT JOIN ip_unit p ON u.unit_id = p.GEOID10""")
def layer_prep(spark, src):
    from tractus.operators.joins import left_join_renamed
    from tractus.operators.layer import layer_areas, unit_centres
    u = B.units(spark, src).select("unit_id", "county_name", "state")
    cells = B.cells(spark, src)
    areas = layer_areas(cells).select("GEOID10", "geo_area", "cf_area", "sf_area")
    pts = unit_centres(cells).select("GEOID10", "lat", "lon")
    out = left_join_renamed(left_join_renamed(u, areas, "unit_id", "GEOID10"), pts, "unit_id", "GEOID10")
    return out.select("unit_id", "county_name", "state",
                      *[_r(c, 6).alias(c) for c in ("geo_area", "cf_area", "sf_area")], "lat", "lon")


def _centres_sql(key: str) -> str:
    return O.ctes(O.CTE_CORNERS, O.CTE_CELL_EDGES, O.outline_ctes(key), O.scanline_ctes("outline"))


@register("county_centres", _centres_sql("CF") + """
SELECT i.k AS CF, a.SF, i.y AS lat, i.x AS lon
FROM ipoint i JOIN (SELECT CF, arg_min(SF, GEOID10) AS SF FROM corners WHERE idx = 0 GROUP BY CF) a ON a.CF = i.k""")
def county_centres(spark, src):
    from tractus.operators.layer import region_centres
    return region_centres(B.cells(spark, src), "CF", attributes=("SF",))


@register("state_centres", _centres_sql("SF") + "\nSELECT k AS SF, y AS lat, x AS lon FROM ipoint")
def state_centres(spark, src):
    from tractus.operators.layer import region_centres
    return region_centres(B.cells(spark, src), "SF")


@register("layer_areas_3035", O.ctes(O.CTE_CORNERS, O.projected_corners_cte(3035), O.unit_area_cte(), _AREA_KEYS_SQL) + """
SELECT GEOID10, CF, SF, round(geo_area, 6) AS geo_area, round(cf_area, 6) AS cf_area, round(sf_area, 6) AS sf_area
FROM akeys""")
def layer_areas_3035(spark, src):
    from tractus.operators.layer import layer_areas
    t = layer_areas(B.cells(spark, src), srid=3035)
    return t.select("GEOID10", "CF", "SF", *[_r(c, 6).alias(c) for c in ("geo_area", "cf_area", "sf_area")])


# ------------------------------------------------ whole chain, S3, O1
_LEVELS_SQL = O.chain(*[O.ranked_ctes(lv) for lv in D.LEVEL_ORDER]) + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{lv}' AS level, CAST({O.LEVEL_SQL[lv][4]} AS VARCHAR) AS name, rank, lat, lon, "
    + ("description" if O.LEVEL_SQL[lv][1] else "CAST(NULL AS VARCHAR) AS description")
    + f" FROM ranked_{lv}" for lv in D.LEVEL_ORDER)


@register("ranked_levels", _LEVELS_SQL)
def ranked_levels(spark, src):
    return D.ranked_levels(spark, src)


@register("level_table_scan", O.chain(O.ranked_ctes("county")) + """
SELECT county_name AS name, rank, lat, lon, description FROM ranked_county""")
def level_table_scan(spark, src):
    from tractus.session import scratch_dir
    from tractus.sinks.files import write_parquet
    from tractus.sources.files import read_level_table
    path = write_parquet(D.ranked_levels(spark, src), scratch_dir(spark, "levels"), ["level"])
    schema = "name string, rank int, lat double, lon double, description string, level string"
    return read_level_table(spark, path, "county", schema)


@register("score_sorted", O.chain() + """
SELECT unit_id, CAST(score AS DOUBLE) AS score FROM scored ORDER BY score DESC NULLS LAST""")
def score_sorted(spark, src):
    s = D.scored_units(spark, src)
    return (s.select("unit_id", F.col("score").cast("double").alias("score"))
            .orderBy(F.col("score").desc_nulls_last()))



@register("grid_cluster_pyramid", O.chain() + _POINTS_SQL + f"""
, zooms AS (SELECT unnest({PYRAMID_ZOOMS}) AS zoom)
SELECT CAST(zoom AS INTEGER) AS zoom,
       CAST(floor(lon / (CAST(360.0 AS DOUBLE) / CAST(pow(2, zoom) AS DOUBLE))) AS BIGINT) AS cell_x,
       CAST(floor(lat / (CAST(360.0 AS DOUBLE) / CAST(pow(2, zoom) AS DOUBLE))) AS BIGINT) AS cell_y, {_MEANS_SQL}
FROM points, zooms GROUP BY 1, 2, 3""")
def grid_cluster_pyramid(spark, src):
    from tractus.operators.serve import grid_cluster_pyramid as gcp
    out = gcp(_scored_points(spark, src), PYRAMID_ZOOMS, value="score")
    return out.withColumn("lat", _r("lat", 6)).withColumn("lon", _r("lon", 6))


@register("serve_records", O.chain(O.ranked_ctes("county"), _served_sql()) + "\nSELECT * FROM served")
def serve_records(spark, src):
    """K6: the served rows as dicts, as a table widget takes them."""
    from tractus.sinks.features import records
    served = _served(spark, src)
    rows = records(served, 20)
    return spark.createDataFrame([tuple(r[c] for c in served.columns) for r in rows], served.schema)
