"""C4 + C5 for several levels at once: the public entry point for a
caller's own unit table.

    scored = composite_score(units, indicators, "unit_density")
    table = rank_levels(scored, {
        "state":  LevelSpec("state", describe_by="state", centres=states, centres_key="SF"),
        "county": LevelSpec(["state", "county"], describe_by=["state", "county"],
                            centres=counties),
        "tract":  LevelSpec("tract_id", centres=tracts, centres_key="GEOID10"),
    }, indicators)

Each level is explained (if ``describe_by`` is set) and ranked from the
same scored table; materialize that table once if it is expensive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractus.operators.explain import explain_level
from tractus.operators.rank import rank_level

Keys = str | list[str]


@dataclass(frozen=True)
class LevelSpec:
    key: Keys                          # group key of the ranking
    describe_by: Keys | None = None    # group key of the explanation (None: none)
    centres: DataFrame | None = None   # key + lat + lon (+ display name)
    centres_key: str | None = None     # centres' key column if named differently
    name: Keys | None = None           # output name column(s), default: key
    drop_incomplete_before_rank: bool = False
    agg: str = "sum"


def rank_one_level(scored: DataFrame, spec: LevelSpec, indicators: list[str],
                   score: str = "score", n: int = 501, top: int = 3,
                   indicators_of: DataFrame | None = None) -> DataFrame:
    """(name, rank, lat, lon[, description]) of one level.  The explanation
    reads ``indicators_of`` (the units before scoring) where it is given: it needs
    no score, and so no percentile of the units."""
    source = scored if indicators_of is None else indicators_of
    desc = explain_level(source, spec.describe_by, indicators, top) if spec.describe_by else None
    return rank_level(scored, spec.key, score, n, spec.centres, spec.centres_key,
                      desc, spec.describe_by, spec.name,
                      drop_incomplete_before_rank=spec.drop_incomplete_before_rank,
                      agg=spec.agg)


def rank_levels(scored: DataFrame, specs: dict[str, LevelSpec], indicators: list[str],
                score: str = "score", n: int = 501, top: int = 3,
                indicators_of: DataFrame | None = None) -> DataFrame:
    """All levels as one serving table (level, name, rank, lat, lon,
    description); composite names are joined with ', '."""
    parts = []
    for level, spec in specs.items():
        r = rank_one_level(scored, spec, indicators, score, n, top, indicators_of)
        names = [spec.name or spec.key] if isinstance(spec.name or spec.key, str) \
            else list(spec.name or spec.key)
        name = (F.col(names[0]).cast("string") if len(names) == 1
                else F.concat_ws(", ", *[F.col(c).cast("string") for c in names]))
        desc = F.col("description") if "description" in r.columns else F.lit(None).cast("string")
        parts.append(r.select(F.lit(level).alias("level"), name.alias("name"), "rank", "lat",
                              "lon", desc.alias("description")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
