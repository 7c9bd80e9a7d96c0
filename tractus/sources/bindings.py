"""Bindings of the domain tables onto the shipped TPC-H-style tables.

The ranking operators need a unit table (one row per smallest area with
its region keys, population, areas and indicator columns), a places
lookup, centre points per level and a polygon layer.  These functions
derive all of them from the parquet tables with ordinary joins and
aggregates, so that the work grows with the data and DuckDB can compute
the same tables from the same files (see ``tractus.plans.oracle``).

Bindings (fixed values, shared with the oracle SQL):

* units: customer x nation x region; unit_id = c_custkey,
  county_name = n_name, state = r_name,
  population = round(abs(c_acctbal)) as BIGINT,
  geo_area = c_custkey % 97, cf_area / sf_area = sum of geo_area per
  county / state.
* unit indicators: all orders joined to lineitem, per customer: quantity,
  revenue, tax, discount (sums as DECIMAL(18,2)), lines (row count),
  returns (count of l_returnflag = 'R'), max_quantity; all of them are NULL for
  units with unit_id % 7 = 3, discount also for nations 7, 8.
* places: all suppliers; city = s_name, county_name = n_name without the
  'NATION_' prefix - for s_nationkey % 6 = 0 a name that matches no county,
  population = s_acctbal, lat = 25 + s_suppkey % 20,
  lng = -120 + s_suppkey % 50.
* county centres: per nation lat = 25 + n_nationkey,
  lon = -120 + 2 * n_nationkey; nations 3 and 9 have none.
* state centres: per region lat = 30 + 2 * r_regionkey,
  lon = -100 - 5 * r_regionkey; region 2 has none.
* tract centres: per customer the middle of its grid cell; the point is
  NULL where c_custkey % 11 = 0.
* zones: cells with a third key; 'Z<ix div 10>', but the cells (3, 1), (6, 1) and
  (7, 2) of each 10 x 10 block belong to the next zone (of five), so that zones have
  holes, holes that touch, and several parts.
* split cells: cells whose polygons have an extra vertex in the middle of each
  side where k is odd, so that borders with even neighbours are not noded.
* moved cells: cells with k % 101 = 0 moved right by 0.4 of a cell, over their neighbour.
* cells: per customer k a 0.05 degree square at column k % 50, row
  k div 50 of a grid with origin (-120, 25); county = 'C<ix div 10>_<iy
  div 10>', state = 'S<ix div 10>'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tractus.sources.tables import read_table

# Fixed values of the bindings (must equal the oracle SQL).
NULL_UNIT_MODULUS, NULL_UNIT_REMAINDER = 7, 3
UNMATCHED_PREFIX = "ELSEWHERE_"
RETURN_FLAG = "R"
NULL_DISCOUNT_NATIONS = (7, 8)
AREA_MODULUS = 97
PLACE_NATION_MODULUS = 6
NATION_PREFIX = "NATION_"
COUNTY_CENTRES_MISSING = (3, 9)
STATE_CENTRES_MISSING = (2,)
TRACT_CENTRE_MODULUS = 11
GRID_COLUMNS = 50
GRID_STEP = 0.05
GRID_ORIGIN_X = -120.0
GRID_ORIGIN_Y = 25.0
GRID_BLOCK = 10
ZONES, ENCLAVES = 5, ((3, 1), (6, 1), (7, 2))
MOVED_MODULUS, MOVED_BY = 101, 0.4

METRIC_DECIMAL = "decimal(18,2)"

# Column types of the driver tables (parquet physical types); readers
# pass them so that no schema-inference job runs per scan.
TABLE_TYPES = {
    "r_regionkey": "int", "r_name": "string",
    "n_nationkey": "int", "n_name": "string", "n_regionkey": "int",
    "c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double",
    "c_mktsegment": "string",
    "s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double",
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderpriority": "string",
    "l_orderkey": "bigint", "l_quantity": "double", "l_extendedprice": "double",
    "l_tax": "double", "l_discount": "double", "l_returnflag": "string",
}


def _read(spark: SparkSession, src: str, name: str, columns: list[str]) -> DataFrame:
    return read_table(spark, src, name, columns, TABLE_TYPES)

# Indicator columns of the unit table, in their fixed list order (the
# order decides ties in the explanation text).
INDICATORS = ["quantity", "revenue", "lines", "tax", "discount", "returns",
              "max_quantity"]


def unit_indicators(spark: SparkSession, src: str) -> DataFrame:
    """Per-customer indicators from all orders and lines (one row per
    customer that has any).

    At scale the join is a sort-merge join on the order key.  Partial
    aggregation runs before the shuffle on o_custkey, so a customer with a
    third of all lines is combined map-side."""
    orders = _read(spark, src, "orders", ["o_orderkey", "o_custkey"])
    lines = _read(spark, src, "lineitem",
                       ["l_orderkey", "l_quantity", "l_extendedprice",
                        "l_tax", "l_discount", "l_returnflag"])
    dec = METRIC_DECIMAL

    def dsum(c: str) -> Column:
        return F.sum(F.col(c).cast(dec)).cast(dec)

    return (lines.join(orders, lines.l_orderkey == orders.o_orderkey)
            .groupBy("o_custkey")
            .agg(dsum("l_quantity").alias("quantity"),
                 dsum("l_extendedprice").alias("revenue"),
                 F.count(F.lit(1)).alias("lines"),
                 dsum("l_tax").alias("tax"),
                 dsum("l_discount").alias("discount"),
                 F.count_if(F.col("l_returnflag") == RETURN_FLAG).alias("returns"),
                 F.max("l_quantity").alias("max_quantity")))


def region_units(spark: SparkSession, src: str) -> DataFrame:
    """customer x nation x region: unit key, county and state names."""
    c = _read(spark, src, "customer", ["c_custkey", "c_nationkey", "c_acctbal"])
    n = _read(spark, src, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = _read(spark, src, "region", ["r_regionkey", "r_name"])
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey))


def unit_regions(spark: SparkSession, src: str) -> DataFrame:
    """Unit keys, population and areas (no indicators).

    Columns: unit_id BIGINT, nation_key, county_name, state,
    population BIGINT, geo_area, cf_area, sf_area DOUBLE.  Region areas
    = sum of unit areas per key: aggregated once and joined back (the
    aggregate has one row per county/state and is broadcast by AQE)
    rather than a window partitioned by the key, which would put a hot
    state's units into a single task.
    """
    base = region_units(spark, src)
    u = base.select(F.col("c_custkey").alias("unit_id"),
                    F.col("c_nationkey").alias("nation_key"),
                    F.col("n_name").alias("county_name"),
                    F.col("r_name").alias("state"),
                    F.round(F.abs("c_acctbal")).cast("bigint").alias("population"),
                    (F.col("c_custkey") % AREA_MODULUS).cast("double").alias("geo_area"))
    cf = u.groupBy("county_name").agg(F.sum("geo_area").alias("cf_area"))
    sf = u.groupBy("state").agg(F.sum("geo_area").alias("sf_area"))
    return u.join(cf, "county_name", "left").join(sf, "state", "left")


def attach_indicators(regions: DataFrame, spark: SparkSession, src: str) -> DataFrame:
    """Left-join the per-unit indicators (computed once from orders x
    lineitem) to a table carrying ``unit_id`` and ``nation_key``."""
    ind = unit_indicators(spark, src).withColumnRenamed("o_custkey", "unit_id")
    out = regions.join(ind, "unit_id", "left")
    measured = F.col("unit_id") % NULL_UNIT_MODULUS != NULL_UNIT_REMAINDER
    out = out.withColumns({c: F.when(measured, F.col(c)) for c in INDICATORS})
    return out.withColumn("discount", F.when(~F.col("nation_key").isin(*NULL_DISCOUNT_NATIONS),
                                             F.col("discount")))


UNIT_COLUMNS = ["unit_id", "county_name", "state", "population", "geo_area", "cf_area",
                "sf_area", *INDICATORS]


def units(spark: SparkSession, src: str) -> DataFrame:
    """The unit (tract-grain) attribute table.

    Columns: unit_id BIGINT, county_name, state, population BIGINT,
    geo_area, cf_area, sf_area DOUBLE, and the INDICATORS.
    """
    return attach_indicators(unit_regions(spark, src), spark, src).select(*UNIT_COLUMNS)


def places(spark: SparkSession, src: str) -> DataFrame:
    """Places lookup: city, county_name (without prefix), population,
    lat, lng, id."""
    s = _read(spark, src, "supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"])
    n = _read(spark, src, "nation", ["n_nationkey", "n_name"])
    return (s.join(n, s.s_nationkey == n.n_nationkey)
            .select(F.col("s_name").alias("city"),
                    F.when(F.col("s_nationkey") % PLACE_NATION_MODULUS != 0,
                           F.replace(F.col("n_name"), F.lit(NATION_PREFIX), F.lit("")))
                    .otherwise(F.concat(F.lit(UNMATCHED_PREFIX), F.col("s_nationkey").cast("string")))
                    .alias("county_name"),
                    F.col("s_acctbal").alias("population"),
                    (F.lit(25) + F.col("s_suppkey") % 20).cast("double").alias("lat"),
                    (F.lit(-120) + F.col("s_suppkey") % 50).cast("double").alias("lng"),
                    F.col("s_suppkey").alias("id")))


def spelled_counties(spark: SparkSession, src: str) -> DataFrame:
    """The units' regions under names with an accent: unit_id, state, county_name."""
    u = region_units(spark, src)
    return u.select(F.col("c_custkey").alias("unit_id"), F.col("r_name").alias("state"),
                    F.concat(F.lit("San José "), F.col("n_name"), F.lit(" County")).alias("county_name"))


def spelled_places(spark: SparkSession, src: str) -> DataFrame:
    """The places with the same names spelled in five ways, by nation: as the units do, in
    capitals with another area word, with another accent and a hyphen, with a word more, and unknown ones."""
    s = _read(spark, src, "supplier", ["s_suppkey", "s_nationkey"])
    n = _read(spark, src, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = _read(spark, src, "region", ["r_regionkey", "r_name"])
    way, name = F.col("s_nationkey") % 5, F.col("n_name")
    spelled = (F.when(way == 0, F.concat(F.lit("San José "), name, F.lit(" County")))
               .when(way == 1, F.concat(F.lit("SAN JOSE "), name, F.lit(" PARISH")))
               .when(way == 2, F.concat(F.lit("Sán José "), F.replace(name, F.lit("_"), F.lit("-")), F.lit(" Borough")))
               .when(way == 3, F.concat(F.lit("San José de "), name))
               .otherwise(F.concat(F.lit(UNMATCHED_PREFIX), F.col("s_nationkey").cast("string"))))
    return (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("s_suppkey").alias("id"), F.col("r_name").alias("state"), spelled.alias("county_name")))


def county_centres(spark: SparkSession, src: str) -> DataFrame:
    """County centre points keyed by CF (county name), with SF."""
    n = _read(spark, src, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = _read(spark, src, "region", ["r_regionkey", "r_name"])
    return (n.filter(~F.col("n_nationkey").isin(*COUNTY_CENTRES_MISSING))
            .join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("n_name").alias("CF"), F.col("r_name").alias("SF"),
                    (F.lit(25) + F.col("n_nationkey")).cast("double").alias("lat"),
                    (F.lit(-120) + 2 * F.col("n_nationkey")).cast("double").alias("lon")))


def state_centres(spark: SparkSession, src: str) -> DataFrame:
    """State centre points keyed by SF (state name)."""
    r = _read(spark, src, "region", ["r_regionkey", "r_name"])
    return (r.filter(~F.col("r_regionkey").isin(*STATE_CENTRES_MISSING))
            .select(F.col("r_name").alias("SF"),
                    (F.lit(30) + 2 * F.col("r_regionkey")).cast("double").alias("lat"),
                    (F.lit(-100) - 5 * F.col("r_regionkey")).cast("double").alias("lon")))


def _grid_index(k: Column) -> tuple[Column, Column]:
    return k % GRID_COLUMNS, F.floor(k / GRID_COLUMNS)


def _grid_x(ix: Column) -> Column:
    return F.lit(GRID_ORIGIN_X) + F.lit(GRID_STEP) * ix.cast("double")


def _grid_y(iy: Column) -> Column:
    return F.lit(GRID_ORIGIN_Y) + F.lit(GRID_STEP) * iy.cast("double")


def tract_centres(spark: SparkSession, src: str) -> DataFrame:
    """Tract centre points keyed by GEOID10 (= unit_id)."""
    c = _read(spark, src, "customer", ["c_custkey"])
    ix, iy = _grid_index(F.col("c_custkey"))
    half = F.lit(GRID_STEP / 2)
    known = F.col("c_custkey") % TRACT_CENTRE_MODULUS != 0
    return c.select(F.col("c_custkey").alias("GEOID10"),
                    F.when(known, _grid_y(iy) + half).alias("lat"),
                    F.when(known, _grid_x(ix) + half).alias("lon"))


def zones(spark: SparkSession, src: str) -> DataFrame:
    """The cells with a region key ``ZONE`` whose regions have holes and several parts."""
    ix, iy = _grid_index(F.col("GEOID10"))
    bx = F.floor(ix / GRID_BLOCK)
    enclave = F.lit(False)
    for x, y in ENCLAVES:
        enclave = enclave | ((ix % GRID_BLOCK == x) & (iy % GRID_BLOCK == y))
    zone = F.when(enclave, (bx + 1) % ZONES).otherwise(bx)
    return cells(spark, src).withColumn("ZONE", F.concat(F.lit("Z"), zone.cast("string")))


def split_cells(spark: SparkSession, src: str) -> DataFrame:
    """The cells, every other one with an extra vertex in the middle of each side."""
    ring = F.col("geometry")[0][0]

    def middle(p, i):
        q = F.get(ring, i + 1)
        return F.array(p, F.struct(((p["x"] + q["x"]) / 2).alias("x"), ((p["y"] + q["y"]) / 2).alias("y")))

    split = F.concat(F.flatten(F.transform(F.slice(ring, 1, 4), middle)), F.slice(ring, 5, 1))
    return cells(spark, src).withColumn("geometry", F.when(F.col("GEOID10") % 2 == 1, F.array(F.array(split))).otherwise(F.col("geometry")))


def moved_cells(spark: SparkSession, src: str) -> DataFrame:
    """The cells, some of them moved over their right neighbour."""
    moved = F.transform("geometry", lambda part: F.transform(part, lambda ring: F.transform(
        ring, lambda p: F.struct((p["x"] + GRID_STEP * MOVED_BY).alias("x"), p["y"].alias("y")))))
    return cells(spark, src).withColumn("geometry", F.when(F.col("GEOID10") % MOVED_MODULUS == 0, moved).otherwise(F.col("geometry")))


def cells(spark: SparkSession, src: str) -> DataFrame:
    """Polygon layer: one square per customer.

    Columns: GEOID10 BIGINT, CF STRING, SF STRING, geo_size DOUBLE,
    geometry ARRAY<ARRAY<ARRAY<STRUCT<x,y>>>> (parts, rings, points).
    Corners come from integer grid indices, so shared edges are
    bit-equal.  Rings are closed and counter-clockwise.
    """
    c = _read(spark, src, "customer", ["c_custkey"])
    k = F.col("c_custkey")
    ix, iy = _grid_index(k)
    x0, x1 = _grid_x(ix), _grid_x(ix + 1)
    y0, y1 = _grid_y(iy), _grid_y(iy + 1)

    def pt(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    ring = F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0))
    bx = F.floor(ix / GRID_BLOCK)
    by = F.floor(iy / GRID_BLOCK)
    return c.select(
        k.alias("GEOID10"),
        F.concat(F.lit("C"), bx.cast("string"), F.lit("_"), by.cast("string")).alias("CF"),
        F.concat(F.lit("S"), bx.cast("string")).alias("SF"),
        F.lit(GRID_STEP * GRID_STEP).alias("geo_size"),
        F.array(F.array(ring)).alias("geometry"))
