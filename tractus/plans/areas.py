"""The area ranking on the real inputs (tract table, cities lookup,
centre tables), in one call: C1 -> C2 -> C3 -> C4/C5 for the state,
county, city and tract levels.

    tracts = read_tracts(spark, "tracts.csv")
    cities = read_cities(spark, "cities.csv")
    table = rank_areas(tracts, cities,
                       read_centres(spark, "state_points.csv", ["SF"]),
                       read_centres(spark, "county_points.csv", ["CF"]),
                       read_centres(spark, "tract_points.csv", ["GEOID10"]))
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractus.operators.density import DensityLevel, density_enrichment
from tractus.operators.levels import LevelSpec, rank_levels
from tractus.operators.place_keys import match_keys, repaired_places
from tractus.operators.places import attach_principal_place, principal_places
from tractus.operators.score import composite_score
from tractus.session import materialize
from tractus.sources.screening import COUNTY_SUFFIX, INDICATORS

_RANKED = ["state", "county_name", "city_id", "census_tract_id"]
PLACE_KEEP = {"city": "city", "lat": "city_lat", "lng": "city_lon", "id": "city_id"}
DENSITY_LEVELS = [
    DensityLevel("county_name", "county_population_density", "cf_area", replicated=True),
    DensityLevel("state", "state_population_density", "sf_area", replicated=True),
    DensityLevel("city", "city_population_density", "geo_area", replicated=False),
]


def score_tracts(tracts: DataFrame, cities: DataFrame, ties: str = "one", suffix: str = COUNTY_SUFFIX,
                 ) -> tuple[DataFrame, DataFrame]:
    """(scored, enriched): tracts with principal city and four densities,
    written once, and the same with the descending density percentile and ``score``."""
    needed = ["state", "county_name", "census_tract_id", "total_population", "geo_area",
              "cf_area", "sf_area", *INDICATORS]
    missing = [c for c in needed if c not in tracts.columns]
    if missing:
        raise ValueError(f"tract table lacks columns {missing}")
    t = attach_principal_place(tracts, cities, "county_name", "county_name",
                               suffix=suffix, ties=ties, keep=PLACE_KEEP)
    t = density_enrichment(t, "total_population", "geo_area", "census_population_density",
                           DENSITY_LEVELS)
    t = materialize(t, "tracts")
    scored = composite_score(t, INDICATORS, "census_population_density",
                             density_out="census_population_density_percentile")
    return scored, t


def rank_areas(tracts: DataFrame, cities: DataFrame, state_centres: DataFrame,
               county_centres: DataFrame, tract_centres: DataFrame, n: int = 501,
               ties: str = "one", match_places: bool = False) -> DataFrame:
    """(level, name, rank, lat, lon, description) for the four levels.

    With ``match_places`` the cities' county names are matched by ``place_keys.match_keys``, so that
    parishes, boroughs and accented names find their cities, too; otherwise one suffix is added."""
    suffix = COUNTY_SUFFIX
    if match_places:
        cities, suffix = materialize(repaired_places(cities, match_keys(tracts, cities)), "cities"), ""
    scored, enriched = score_tracts(tracts, cities, ties, suffix)
    scored = materialize(scored.select(*_RANKED, "score"), "scored")
    city_points = principal_places(cities, "county_name", suffix=suffix, ties=ties,
                                   keep=PLACE_KEEP).select(
        "city_id", "city", F.col("city_lat").alias("lat"), F.col("city_lon").alias("lon"))
    specs = {
        "state": LevelSpec("state", "state", state_centres, "SF"),
        "county": LevelSpec("county_name", "county_name", county_centres, "CF"),
        "city": LevelSpec("city_id", "city", city_points, "city_id", "city",
                          drop_incomplete_before_rank=True),
        "census_tract": LevelSpec("census_tract_id", None, tract_centres, "GEOID10"),
    }
    return rank_levels(scored, specs, INDICATORS, "score", n, 3, enriched)
