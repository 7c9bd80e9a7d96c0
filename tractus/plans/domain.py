"""The area-ranking chain on the bound tables, level by level.

units -> principal place (C1) -> densities (C2) -> score (C3)
      -> explanation per level (C4) -> ranked table per level (C5)

``Levels`` describes each level (group key, centre table, description
key, display name).  All functions return lazy DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractus.operators.density import DensityLevel, density_enrichment
from tractus.operators.explain import explain_level
from tractus.operators.levels import LevelSpec, rank_levels, rank_one_level
from tractus.operators.places import attach_principal_place, principal_places
from tractus.operators.score import composite_score
from tractus.session import materialize
from tractus.sources import bindings as B

# Fixed values of the chain (shared with the oracle SQL).
RANK_LIMIT = 501
EXPLAIN_TOP = 3
DENSITY_LEVELS = [
    DensityLevel("county_name", "county_density", "cf_area", replicated=True),
    DensityLevel("state", "state_density", "sf_area", replicated=True),
    DensityLevel("city", "city_density", "geo_area", replicated=False),
]
PLACE_KEEP = {"city": "city", "lat": "city_lat", "lng": "city_lon", "id": "city_id"}


def enriched_units(spark: SparkSession, src: str, ties: str = "one",
                   checkpoint: bool = False) -> DataFrame:
    """Units with principal city and four densities.

    ``checkpoint=True`` writes the table to the shared checkpoint folder
    and cuts its lineage (orders x lineitem, places, three aggregates):
    the percentile reads it twice and every level reads the result.
    """
    # Place, densities and areas depend only on the unit keys, so they
    # are derived from the cheap region table; the indicators (the
    # orders x lineitem aggregate) are computed once and joined last.
    r = B.unit_regions(spark, src)
    p = B.places(spark, src)
    r = attach_principal_place(r, p, "county_name", "county_name",
                               prefix=B.NATION_PREFIX, ties=ties, keep=PLACE_KEEP)
    r = density_enrichment(r, "population", "geo_area", "unit_density", DENSITY_LEVELS)
    out = B.attach_indicators(r, spark, src).drop("nation_key")
    return materialize(out, "enriched") if checkpoint else out


def scored_and_enriched(spark: SparkSession, src: str,
                        exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """C3 (``density_percentile`` and ``score``) and the enriched units that it
    reads, written once to the shared folder."""
    enriched = enriched_units(spark, src, checkpoint=True)
    return composite_score(enriched, B.INDICATORS, "unit_density", exact=exact), enriched


def scored_units(spark: SparkSession, src: str, exact: bool = True) -> DataFrame:
    return scored_and_enriched(spark, src, exact)[0]


def city_centres(spark: SparkSession, src: str) -> DataFrame:
    """City points keyed by city_id (the principal places)."""
    best = principal_places(B.places(spark, src), "county_name", prefix=B.NATION_PREFIX,
                            keep=PLACE_KEEP)
    return best.select("city_id", "city", F.col("city_lat").alias("lat"),
                       F.col("city_lon").alias("lon"))


@dataclass(frozen=True)
class Level:
    key: str                      # group key of the ranking
    describe_by: str | None       # group key of the explanation (None: none)
    centres: Callable[[SparkSession, str], DataFrame] | None
    centres_key: str | None
    name: str                     # output name column
    drop_incomplete_before_rank: bool = False


LEVELS = {
    "state": Level("state", "state", B.state_centres, "SF", "state"),
    "county": Level("county_name", "county_name", B.county_centres, "CF", "county_name"),
    "city": Level("city_id", "city", city_centres, "city_id", "city",
                  drop_incomplete_before_rank=True),
    "tract": Level("unit_id", None, B.tract_centres, "GEOID10", "unit_id"),
}


def level_spec(spark: SparkSession, src: str, level: str) -> LevelSpec:
    lv = LEVELS[level]
    return LevelSpec(lv.key, lv.describe_by, lv.centres(spark, src) if lv.centres else None,
                     lv.centres_key, lv.name, lv.drop_incomplete_before_rank)


def explain(units: DataFrame, level: str) -> DataFrame:
    """C4 of one level; ``units`` need no score."""
    lv = LEVELS[level]
    return explain_level(units, lv.describe_by, B.INDICATORS, EXPLAIN_TOP)


def ranked(spark: SparkSession, src: str, level: str, n: int = RANK_LIMIT) -> DataFrame:
    """C5 for one level of the bound data."""
    scored, enriched = scored_and_enriched(spark, src)
    return rank_one_level(scored, level_spec(spark, src, level), B.INDICATORS, "score", n,
                          EXPLAIN_TOP, enriched)


LEVEL_ORDER = ("state", "county", "city", "tract")


def ranked_levels(spark: SparkSession, src: str, n: int = RANK_LIMIT) -> DataFrame:
    """All four ranked tables from ONE scored unit table, as one serving
    table (level, name, rank, lat, lon, description).

    Keys and score are written once for the four rankings; the three
    explanations read the enriched units.
    """
    scored, enriched = scored_and_enriched(spark, src)
    keys = sorted({LEVELS[lv].key for lv in LEVEL_ORDER})
    scored = materialize(scored.select(*keys, "score"), "scored")
    specs = {lv: level_spec(spark, src, lv) for lv in LEVEL_ORDER}
    return rank_levels(scored, specs, B.INDICATORS, "score", n, EXPLAIN_TOP, enriched)
