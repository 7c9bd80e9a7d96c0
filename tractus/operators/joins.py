"""Equi-joins used by the enrichment and ranking steps.

No forced broadcast: lookup sides (centres, places, aggregates per
region) are small in practice, and Spark's size estimate plus AQE's
runtime statistics turn them into broadcast joins by themselves, while
a side that turns out large falls back to a sort-merge join (with AQE
skew splitting) instead of exhausting executor memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def left_join_renamed(left: DataFrame, right: DataFrame, left_key: str,
                      right_key: str, how: str = "left") -> DataFrame:
    """Join on differently named keys; the right key is dropped.

    Renaming the right key first turns the condition into a USING join,
    so the output has one key column.
    """
    if left_key != right_key:
        if left_key in right.columns:
            right = right.drop(left_key)
        right = right.withColumnRenamed(right_key, left_key)
    return left.join(right, left_key, how)


def join_using(left: DataFrame, right: DataFrame, keys: str | list[str],
               how: str = "left") -> DataFrame:
    """J2 (one key), J4 (composite key), J5 (``how='inner'``).
    NULL keys never match."""
    return left.join(right, keys if isinstance(keys, list) else [keys], how)
