"""Scans of named tables.

A table is either a catalog table (``spark.table``) or a parquet dataset
below a folder.  Column pruning and filter pushdown reach the parquet
scan because everything downstream is declarative; ``columns`` only
documents the projection early.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, source: str, name: str,
               columns: list[str] | None = None,
               schema: dict[str, str] | None = None) -> DataFrame:
    """Read table ``name`` from a parquet folder or the catalog.

    ``source`` is a folder path holding ``<name>.parquet`` or the literal
    ``"catalog"`` for a metastore table.  With ``schema`` (column ->
    type) the parquet reader gets the schema of the requested columns
    and skips the footer-reading inference job.
    """
    if source == "catalog":
        df = spark.table(name)
        return df.select(*columns) if columns else df
    path = f"{source.rstrip('/')}/{name}.parquet"
    if schema and columns and all(c in schema for c in columns):
        ddl = ", ".join(f"`{c}` {schema[c]}" for c in columns)
        return spark.read.schema(ddl).parquet(path)
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df
