"""Readers for the real inputs of the area ranking: the tract table of
the environmental screening tool, the cities lookup and the centre
tables written by the layer preparation.

Column names are normalised (spaces and punctuation -> '_', compared
case-insensitively, as a catalog upload does) and mapped to canonical
names.  Ids stay STRING with leading zeros restored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Source column names (after normalisation) and the names
# used by the ranking; the indicator names appear in the description
# text ("Ranks highly in: PM25: 98%, ...").  List order = tie order.
INDICATOR_COLUMNS = {
    "PM2.5_in_the_air__percentile_": "PM25",
    "Diesel_particulate_matter_exposure__percentile_": "Diesel_Particulate",
    "Current_asthma_among_adults_aged_greater_than_or_equal_to_18_years__percentile_": "Asthma",
    "Low_median_household_income_as_a_percent_of_area_median_income__percentile_": "Household_Income",
    "Expected_building_loss_rate__Natural_Hazards_Risk_Index___percentile_": "Building_Loss_Rate",
    "Expected_agricultural_loss_rate__Natural_Hazards_Risk_Index___percentile_": "Agricultural_Loss_Rate",
    "Traffic_proximity_and_volume__percentile_": "Traffic_Proximity",
}
KEY_COLUMNS = {
    "State": "state",
    "State_Territory": "state",
    "County_Name": "county_name",
    "Census_tract_ID": "census_tract_id",
    "Total_threshold_criteria_exceeded": "total_threshold_criteria_exceeded",
    "Total_categories_exceeded": "total_categories_exceeded",
    "Total_population": "total_population",
    "geo_area": "geo_area",
    "cf_area": "cf_area",
    "sf_area": "sf_area",
}
INDICATORS = list(INDICATOR_COLUMNS.values())
TRACT_ID_WIDTH = 11
COUNTY_SUFFIX = " County"

_TYPES = {"census_tract_id": "string", "state": "string", "county_name": "string",
          "total_threshold_criteria_exceeded": "int", "total_categories_exceeded": "int",
          "total_population": "bigint"}


def normalise(name: str) -> str:
    """'PM2.5 in the air (percentile)' -> 'PM2.5_in_the_air__percentile_'."""
    return re.sub(r"[ ,;{}()\n\t=/]", "_", name)


def tract_id(column: str):
    """Tract ids as text of a fixed width: exports lose leading zeros."""
    return F.lpad(F.regexp_replace(F.col(f"`{column}`").cast("string"), r"\.0$", ""), TRACT_ID_WIDTH, "0")


def canonical_tracts(df: DataFrame) -> DataFrame:
    """Rename and type the known columns; other columns are dropped."""
    lookup = {normalise(k).lower(): v for k, v in {**KEY_COLUMNS, **INDICATOR_COLUMNS}.items()}
    cols = []
    for c in df.columns:
        target = lookup.get(normalise(c).lower())
        if target is None:
            continue
        t = _TYPES.get(target, "double")
        col = F.col(f"`{c}`").cast(t)
        if target == "census_tract_id":
            col = tract_id(c)
        cols.append(col.alias(target))
    return df.select(*cols)


def read_tracts(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Tract table from a CSV export (header) or parquet, canonical names.
    The CSV is read as strings and cast explicitly (no inference pass)."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return canonical_tracts(reader.format(fmt).load(path))


def read_cities(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Cities lookup: city, county_name, population, lat, lng, id."""
    schema = "city string, county_name string, population bigint, lat double, lng double, id bigint"
    if fmt == "csv":
        raw = spark.read.option("header", True).csv(path)
        return raw.select(*[F.col(n).cast(t).alias(n) for n, t in
                            (f.split(" ") for f in schema.split(", "))])
    return spark.read.format(fmt).load(path).select("city", "county_name", "population",
                                                    "lat", "lng", "id")


def read_centres(spark: SparkSession, path: str, key_columns: list[str]) -> DataFrame:
    """Centre table written with a leading index column, e.g.
    ``,GEOID10,CF,SF,lat,lon,geo_size``: keys as STRING (tract ids padded to
    their width like the tract table's), lat/lon DOUBLE."""
    raw = spark.read.option("header", True).option("nullValue", "null").csv(path)
    out = [(tract_id(k) if k == "GEOID10" else F.col(k).cast("string")).alias(k) for k in key_columns]
    return raw.select(*out, F.col("lat").cast("double").alias("lat"),
                      F.col("lon").cast("double").alias("lon"))
