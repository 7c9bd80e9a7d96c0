"""Projections that shape tables.

Pure plan rewrites: no action, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Bulk rename (unknown names are ignored, as in Spark)."""
    return df.withColumnsRenamed(mapping)


def project(df: DataFrame, *cols: str) -> DataFrame:
    """Fixed or variable column list."""
    return df.select(*cols)


def drop(df: DataFrame, *cols: str) -> DataFrame:
    """P3."""
    return df.drop(*cols)


def pad_id(df: DataFrame, col: str, width: int = 11) -> DataFrame:
    """P8 done right: keep ids as STRING and restore lost leading zeros.

    An 11-digit tract id does not fit INT; a BIGINT cast drops zeros.
    """
    return df.withColumn(col, F.lpad(F.col(col).cast("string"), width, "0"))


def scale_columns(df: DataFrame, cols: list[str], factor: float) -> DataFrame:
    """P5: one multiplication per column (m^2 -> km^2 with 1e-6)."""
    return df.withColumns({c: F.col(c) * F.lit(factor) for c in cols})


def title_header(df: DataFrame, hidden: tuple[str, ...] = ("lat", "lon", "description")) -> DataFrame:
    """P10: hide display-only columns, title-case the rest
    (``census_tract`` -> ``Census_Tract``, like Python's ``str.title``)."""
    def title(name: str) -> str:
        out, up = [], True
        for ch in name:
            out.append(ch.upper() if up else ch.lower())
            up = not ch.isalpha()
        return "".join(out)
    return df.select(*[F.col(c).alias(title(c)) for c in df.columns if c not in hidden])


def preview(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """First rows; deterministic when ``order_by`` is given."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)
