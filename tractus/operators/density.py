"""Multi-level population density.

Unit density is a column ratio.  Region density is a grouped ratio,
either with a replicated region area (``sum(pop) / max(area)``, A1: the
region's area repeated on every unit) or with additive unit areas
(``sum(pop) / sum(area)``, A2).

Each region aggregate is computed once and joined back on its key.
The aggregate has one row per region, so AQE broadcasts it; the
alternative ``sum(..).over(partitionBy(key))`` would send all units of
a hot state through one task.  Units with a NULL key get NULL, as in a
left join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractus.functions.columns import ratio


@dataclass(frozen=True)
class DensityLevel:
    key: str
    out: str
    area: str
    replicated: bool = True  # True: sum(pop) / max(area); False: sum / sum


def unit_density(df: DataFrame, population: str, area: str, out: str) -> DataFrame:
    """Population / area per row; NULL for a NULL or zero area."""
    return df.withColumn(out, ratio(population, area))


def group_density(df: DataFrame, key: str | list[str], population: str,
                  area: str, out: str, replicated: bool = True) -> DataFrame:
    """A1 (replicated) / A2 (additive): one row per key value."""
    keys = [key] if isinstance(key, str) else list(key)
    den = F.max(area) if replicated else F.sum(area)
    return df.groupBy(*keys).agg(ratio(F.sum(population), den).alias(out))


def density_enrichment(df: DataFrame, population: str, unit_area: str,
                       unit_out: str, levels: list[DensityLevel]) -> DataFrame:
    """Unit density plus one density column per region level."""
    out = unit_density(df, population, unit_area, unit_out)
    for lv in levels:
        agg = group_density(df, lv.key, population, lv.area, lv.out, lv.replicated)
        out = out.join(agg.filter(F.col(lv.key).isNotNull()), lv.key, "left")
    return out
