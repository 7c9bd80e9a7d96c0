"""tractus — Spark-native area ranking.

Reusable DataFrame operators that turn a unit-level attribute table
(tracts, blocks, customers ...) into ranked, explained, map-ready area
tables at several levels of aggregation (unit, county, city, state).

Every operator takes DataFrames and column names and returns a lazy
DataFrame; Catalyst and AQE choose the physical plan.  The only actions
inside operators are the documented ones (quantile bounds of the
distributed percent rank, materialized tables in the shared checkpoint
folder, explicit round trips through files).

Main entry points::

    from tractus import (attach_principal_place, density_enrichment,
                         composite_score, explain_level, rank_level,
                         rank_levels, LevelSpec, percent_rank, rank_areas)
"""

from tractus.session import (checkpoint_base, get_session, materialize, recommended_conf,
                             scratch_dir)
from tractus.operators.density import DensityLevel, density_enrichment, group_density
from tractus.operators.explain import explain_level
from tractus.operators.levels import LevelSpec, rank_levels
from tractus.operators.percentile import percent_rank, percent_rank_window, value_ranks
from tractus.operators.places import attach_principal_place, principal_places
from tractus.operators.rank import rank_level
from tractus.operators.score import composite_score
from tractus.plans.areas import rank_areas

__all__ = [
    "DensityLevel", "LevelSpec", "attach_principal_place", "checkpoint_base",
    "composite_score", "density_enrichment", "explain_level", "get_session",
    "group_density", "materialize", "percent_rank", "percent_rank_window",
    "principal_places", "rank_areas", "rank_level", "rank_levels",
    "recommended_conf", "scratch_dir",
]
