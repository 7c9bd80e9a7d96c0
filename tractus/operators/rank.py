"""Ranked level table.

Sum the unit score per key and keep the n best keys (top-k is planned as
``TakeOrderedAndProject``: every partition keeps its own n best, the
driver merges n x partitions rows); those n rows are written once.  Centres
and descriptions are cut down to the n keys by a semi-join before anything
of them is shuffled (the keys are broadcast: n rows), then attached, and the n rows
are numbered with a competition rank (ties share, next skips).  The final
window holds at most n rows.

The key is a tie-break of the top-k so that the kept set is stable.
``drop_incomplete_before_rank`` reproduces the city table, which drops
rows with any NULL before numbering.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tractus.operators.joins import left_join_renamed
from tractus.session import materialize

SCORE = "_level_score"
AGGREGATES = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}
Keys = str | list[str]


def _keys(key: Keys) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def level_scores(units: DataFrame, key: Keys, score: str = "score", agg: str = "sum") -> DataFrame:
    """A4: aggregate of scores per key (``sum`` as in the reference; NULLs
    skipped, all-NULL -> NULL).  ``key`` may be a list, e.g. (state,
    county) so that same-named counties of different states stay apart."""
    return units.groupBy(*_keys(key)).agg(AGGREGATES[agg](score).alias(SCORE))


def top_keys(scores: DataFrame, key: Keys, n: int) -> DataFrame:
    """O2: n best keys, NULL scores last, key columns as tie-break."""
    return scores.orderBy(F.col(SCORE).desc_nulls_last(),
                          *[F.col(k).asc_nulls_first() for k in _keys(key)]).limit(n)


def rank_level(units: DataFrame, key: Keys, score: str = "score", n: int = 501,
               centres: DataFrame | None = None, centres_key: str | None = None,
               descriptions: DataFrame | None = None,
               descriptions_key: Keys | None = None, name: Keys | None = None,
               lat: str = "lat", lon: str = "lon",
               drop_incomplete_before_rank: bool = False, agg: str = "sum") -> DataFrame:
    """(name..., rank, lat, lon[, description]) for the n best keys.

    ``centres`` has ``centres_key`` plus ``lat``/``lon`` (and may carry
    the display ``name`` column, e.g. the city name for a city id key).
    ``descriptions`` has ``descriptions_key`` and ``description``.  With
    a list key, centres and descriptions join on the same column names.
    """
    keys = _keys(key)
    top = materialize(top_keys(level_scores(units, keys, score, agg), keys, n), "top-keys")

    def among(side: DataFrame, own: list[str], kept: DataFrame, cols: list[str]) -> DataFrame:
        few = F.broadcast(kept.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(cols)]).distinct())
        return side.join(few, reduce(lambda a, b: a & b, [side[o] == few[f"_k{i}"] for i, o in enumerate(own)]), "left_semi")

    # rows without a match would be dropped by the drop-any-null below, so
    # inner joins give the same rows (Catalyst keeps a left join there)
    how = "inner" if drop_incomplete_before_rank else "left"
    if centres is not None:
        centres = among(centres, [centres_key or keys[0]] if len(keys) == 1 else keys, top, keys)
        if len(keys) == 1:
            top = left_join_renamed(top, centres, keys[0], centres_key or keys[0], how)
        else:
            top = top.join(centres, keys, how)
    if descriptions is not None:
        dkeys = _keys(descriptions_key or key)
        descriptions = among(descriptions, dkeys, top, dkeys)
        top = top.join(descriptions.select(*dkeys, "description"), dkeys, how)
    names = _keys(name or key)
    cols = [*[F.col(c) for c in names], F.col(SCORE),
            (F.col(lat) if centres is not None else F.lit(None).cast("double")).alias("lat"),
            (F.col(lon) if centres is not None else F.lit(None).cast("double")).alias("lon")]
    if descriptions is not None:
        cols.append(F.col("description"))
    out = top.select(*cols)
    if drop_incomplete_before_rank:
        out = out.na.drop("any")
    w = Window.partitionBy().orderBy(F.col(SCORE).desc_nulls_last())
    out = out.withColumn("rank", F.rank().over(w))
    keep = [*names, "rank", "lat", "lon"] + (["description"] if descriptions is not None else [])
    return out.select(*keep)
