"""From one polygon layer to the area table and the centre tables.

    p = prepare_layer(read_features(spark, "tracts.geojson", "GEOID10 string, CF string, SF string"))
    tracts = attach_areas(read_tracts(spark, "tracts.csv"), p.areas)
    rank_areas(tracts, cities, p.state_centres, p.county_centres, p.unit_centres)

Areas are measured once per unit in an equal-area projection and summed per
region (G3, G4, P5); a unit's centre is its interior point, evaluated inside the
row (G6); a region's centre is the interior point of its dissolved outline, part
by part (G5, G6), with the attributes of its smallest unit (A9).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractus.operators.geo import (areas_by_keys, dissolve_attributes, interior_point_parts, interior_point_rows,
                                   project, with_area)

SQUARE_KM = 1e-6
EQUAL_AREA = 6933


@dataclass(frozen=True)
class PreparedLayer:
    areas: DataFrame            # unit, county, state, geo_area, cf_area, sf_area
    unit_centres: DataFrame     # unit, county, state, lat, lon
    county_centres: DataFrame   # county, state, lat, lon
    state_centres: DataFrame    # state, lat, lon


def layer_areas(layer: DataFrame, unit: str = "GEOID10", county: str = "CF", state: str = "SF",
                srid: int = EQUAL_AREA, scale: float = SQUARE_KM, geometry: str = "geometry") -> DataFrame:
    """Unit, county and state area of every unit (square kilometres by default)."""
    own = with_area(project(layer.select(unit, county, state, geometry), srid, geometry), "geo_area", geometry, scale)
    return areas_by_keys(own.select(unit, county, state, "geo_area"), "geo_area",
                         {"cf_area": county, "sf_area": state}).select(unit, county, state, "geo_area", "cf_area", "sf_area")


def unit_centres(layer: DataFrame, unit: str = "GEOID10", county: str = "CF", state: str = "SF",
                 geometry: str = "geometry") -> DataFrame:
    points = interior_point_rows(layer.select(unit, county, state, geometry), [unit, county, state], geometry)
    return points.select(unit, county, state, F.col("y").alias("lat"), F.col("x").alias("lon"))


def region_centres(layer: DataFrame, key: str, unit: str = "GEOID10", attributes: tuple[str, ...] = (),
                   geometry: str = "geometry") -> DataFrame:
    """(key, attributes, lat, lon) of every region: units merged by ``key``."""
    points = interior_point_parts(layer.select(unit, key, geometry), key, unit, geometry)
    points = points.select(key, F.col("y").alias("lat"), F.col("x").alias("lon"))
    if not attributes:
        return points
    return points.join(dissolve_attributes(layer, key, unit, list(attributes)), key).select(key, *attributes, "lat", "lon")


def prepare_layer(layer: DataFrame, unit: str = "GEOID10", county: str = "CF", state: str = "SF",
                  srid: int = EQUAL_AREA, geometry: str = "geometry") -> PreparedLayer:
    return PreparedLayer(layer_areas(layer, unit, county, state, srid, geometry=geometry),
                         unit_centres(layer, unit, county, state, geometry),
                         region_centres(layer, county, unit, (state,), geometry),
                         region_centres(layer, state, unit, (), geometry))


def attach_areas(tracts: DataFrame, areas: DataFrame, unit: str = "GEOID10",
                 tract_id: str = "census_tract_id") -> DataFrame:
    """The three areas joined to a tract table by its (padded) id; an area
    column that the table has already is replaced, tracts without a polygon get NULLs."""
    from tractus.sources.screening import tract_id as padded
    own = areas.select(padded(unit).alias(tract_id), "geo_area", "cf_area", "sf_area")
    return tracts.drop("geo_area", "cf_area", "sf_area").join(own, tract_id, "left")
