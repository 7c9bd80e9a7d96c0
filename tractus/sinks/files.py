"""K1, K2, K4: table sinks.

All writers are distributed (one file per partition); nothing is
gathered on the driver.  Paths should be below a shared folder (see
``tractus.session.scratch_dir`` for the round-trip tests).
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, null_value: str = "null",
              mode: str = "overwrite") -> str:
    """K1: CSV with header; NULL written as ``null_value``."""
    (df.write.mode(mode).option("header", True).option("nullValue", null_value)
     .csv(path))
    return path


def write_json_records(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """K2: one JSON object per line (records orientation).  NULL fields
    are omitted, so read back with an explicit schema."""
    df.write.mode(mode).json(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> str:
    """K4: parquet, nested geometry kept as nested arrays; optionally
    partitioned (e.g. by ``level`` so a reader prunes to one level)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path
