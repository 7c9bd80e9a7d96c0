"""Plan shape of every registered query."""

import pytest

from tractus.plans import domain as D
from tractus.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
             "PythonUDF", "CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cross_join(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert not [f for f in FORBIDDEN if f in plan], plan


def test_ranking_uses_top_k_and_group_limit(spark):
    from tractus.operators.rank import level_scores, top_keys
    scored = D.scored_units(spark, SF)
    assert "TakeOrderedAndProject" in _plan(top_keys(level_scores(scored, "state"), "state", 501))
    assert "WindowGroupLimit" in _plan(QUERIES["rank_county"](spark, SF))       # top-3 metrics per key


def test_serving_top_n_is_top_k(spark):
    assert "TakeOrderedAndProject" in _plan(QUERIES["serve_top_n"](spark, SF))


def test_materialized_scan_prunes_columns(spark):
    plan = _plan(QUERIES["rank_tract"](spark, SF))
    # the enriched table is read back from parquet, not as opaque rows
    assert "FileScan parquet" in plan or "Scan parquet" in plan


def test_default_chain_has_no_single_partition_over_units(spark):
    """At every size: a single task may hold the totals of the percent rank (a
    row per range) or the at most n rows of the top-k, never units."""
    for df in (D.scored_units(spark, SF), D.ranked(spark, SF, "county"), QUERIES["global_percentile_desc"](spark, SF)):
        lines = _plan(df).splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                below = "\n".join(lines[i + 1:i + 14])
                assert "keys=[_range" in lines[i + 1] or "top-keys" in below, below


def test_explanation_reads_no_percentile_of_the_units(spark):
    assert "density_percentile" not in _plan(D.explain(D.enriched_units(spark, SF), "state"))


def test_enrichment_before_it_is_written(spark):
    """The plan behind the materialized table: orders and lines are joined on
    the order key, summed before the shuffle on the customer, each read once."""
    plan = _plan(D.enriched_units(spark, SF))
    assert plan.count("lineitem.parquet") == 1 and plan.count("orders.parquet") == 1
    assert "SinglePartition" not in plan and "partial_sum" in plan


def test_centres_are_cut_to_the_top_keys_first(spark):
    plan = _plan(D.ranked(spark, SF, "tract"))
    assert "LeftSemi" in plan and "BroadcastHashJoin" in plan
