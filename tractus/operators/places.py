"""Attach each region's principal (most populous) place.

Places are matched to units by a region key after an affix repair
(T1: the lookup spells a county ``X`` where the units spell it
``X County`` or ``NATION_X``).  W1 + F1: best place per region.

``ties='all'`` keeps every place tied on the largest population (the
semantics of ``rank() == 1``): the maximum per region is a grouped
aggregate combined map-side, joined back on (region, population), so a
region holding a third of all places is never sorted by one task and
its hot join partition can be split by AQE.  Ties can duplicate units
downstream, so the default is ``ties='one'``: the smallest place id
wins, computed by ``max_by`` inside a grouped aggregate that also
combines map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractus.functions.columns import affix
from tractus.operators.joins import left_join_renamed

_KEY = "_place_region"


def principal_places(places: DataFrame, region_key: str = "county_name",
                     population: str = "population", place_id: str = "id",
                     keep: dict[str, str] | None = None, prefix: str = "",
                     suffix: str = "", ties: str = "one",
                     out_key: str = _KEY) -> DataFrame:
    """One row per region key (several on ties with ``ties='all'``).

    ``keep`` maps place columns to output names (default: city, lat ->
    city_lat, lng -> city_lon, id -> city_id).
    """
    keep = keep or {"city": "city", "lat": "city_lat", "lng": "city_lon", "id": "city_id"}
    p = places.select(affix(region_key, prefix, suffix).alias(out_key),
                      F.col(population).alias("_pop"), F.col(place_id).alias("_pid"),
                      *[F.col(src).alias(dst) for src, dst in keep.items()])
    outs = list(keep.values())
    if ties == "all":
        # NULL-safe: a region whose populations are all NULL keeps all
        # its places, as rank() == 1 does
        best_pop = (p.filter(F.col(out_key).isNotNull())
                    .groupBy(F.col(out_key).alias("_k")).agg(F.max("_pop").alias("_max")))
        cond = (F.col(out_key) == F.col("_k")) & F.col("_pop").eqNullSafe(F.col("_max"))
        return p.join(best_pop, cond).select(out_key, *outs)
    if ties != "one":
        raise ValueError("ties must be 'one' or 'all'")
    order = F.struct(F.col("_pop"), -F.col("_pid"))
    best = (p.filter(F.col(out_key).isNotNull())
            .groupBy(out_key)
            .agg(F.max_by(F.struct(*[F.col(c) for c in outs]), order).alias("_best")))
    return best.select(out_key, *[F.col(f"_best.{c}").alias(c) for c in outs])


def attach_principal_place(units: DataFrame, places: DataFrame,
                           unit_key: str = "county_name",
                           place_key: str = "county_name",
                           prefix: str = "", suffix: str = "",
                           ties: str = "one", population: str = "population",
                           place_id: str = "id",
                           keep: dict[str, str] | None = None) -> DataFrame:
    """Units + principal place columns (NULL where no place
    matches)."""
    best = principal_places(places, place_key, population, place_id, keep,
                            prefix, suffix, ties)
    return left_join_renamed(units, best, unit_key, _KEY, "left")
