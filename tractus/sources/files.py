"""Text-file scans, with explicit or inferred schemas.

Callers pass a ``StructType`` or a DDL string where they know it.  Otherwise
``infer_csv_schema`` reads every value once, in one aggregate: each column
keeps the types that all of its values allow, so parts of the files merge by
"and" in any order, and ids keep their leading zeros as STRING.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DataType, DateType, DoubleType, LongType, StringType, StructField,
                               StructType)

_NUMBER = r"^[+-]?(0|[1-9][0-9]*)(\.[0-9]*)?([eE][+-]?[0-9]+)?$|^[+-]?\.[0-9]+([eE][+-]?[0-9]+)?$"


def _allowed(value: Column) -> list[tuple[DataType, Column]]:
    """The types that a text may have, narrowest first.  Leading zeros and whole
    numbers of more than 18 digits are no numbers."""
    return [(BooleanType(), F.lower(value).isin("true", "false")),
            (LongType(), value.rlike(r"^-?(0|[1-9][0-9]{0,17})$")),
            (DoubleType(), value.rlike(_NUMBER) & ~value.rlike(r"^[+-]?[0-9]{19,}$")),
            (DateType(), value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.when(value.isNotNull(), value.try_cast("date").isNotNull()))]


def _texts(spark: SparkSession, path: str, null_value: str) -> DataFrame:
    """Every column as text.  The header alone is read for the names; a file whose
    header differs is an error."""
    header = spark.read.option("header", True).csv(path).schema
    names = [f.name for f in header.fields]
    schema = StructType([StructField(n, StringType()) for n in names])
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
            .option("nullValue", null_value).option("mode", "FAILFAST").csv(path))


def infer_csv_schema(spark: SparkSession, path: str, null_value: str = "null", strings: tuple[str, ...] = ()) -> StructType:
    """The narrowest of BOOLEAN, BIGINT, DOUBLE and DATE that all values of a column allow, else STRING.

    All rows of all files count (one scan, one row to the driver).  Empty fields and ``null_value`` say
    nothing; a column without values is STRING, and so are the columns named in ``strings``.
    """
    df = _texts(spark, path, null_value)
    flags = [F.coalesce(F.bool_and(ok), F.lit(False)).alias(f"{i}:{t.typeName()}")
             for i, name in enumerate(df.columns) for t, ok in _allowed(F.col(f"`{name}`"))]
    got = df.agg(*flags).first().asDict() if flags else {}
    types = [next((t for t, _ in _allowed(F.lit("")) if name not in strings and got[f"{i}:{t.typeName()}"]), StringType())
             for i, name in enumerate(df.columns)]
    return StructType([StructField(n, t) for n, t in zip(df.columns, types)])


def read_csv_inferred(spark: SparkSession, path: str, null_value: str = "null", strings: tuple[str, ...] = ()) -> DataFrame:
    """CSV with header under its inferred schema; ids with leading zeros stay STRING."""
    schema = infer_csv_schema(spark, path, null_value, strings)
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
            .option("nullValue", null_value).option("mode", "FAILFAST").csv(path))


def check_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """S3: the table itself, or an error that names the columns it lacks."""
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"the table lacks {lacking}; it has {df.columns}")
    return df


def read_csv(spark: SparkSession, path: str, schema: StructType | str,
             null_value: str = "null", header: bool = True) -> DataFrame:
    """CSV with header; the text ``null_value`` becomes NULL.

    Empty fields are NULL as well (Spark's default), which matches the
    pandas reader the reference used.
    """
    return (spark.read
            .schema(schema)
            .option("header", header)
            .option("nullValue", null_value)
            .option("mode", "FAILFAST")
            .csv(path))


def read_json_records(spark: SparkSession, path: str,
                      schema: StructType | str) -> DataFrame:
    """K2 counterpart: JSON-lines records with an explicit schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_level_table(spark: SparkSession, path: str, level: str,
                     schema: StructType | str) -> DataFrame:
    """S3 with partition pruning: ranked tables of all levels stored once
    with ``partitionBy('level')``; the filter prunes to one folder."""
    return (spark.read.schema(schema).parquet(path)
            .filter(F.col("level") == level)
            .drop("level"))


def read_level_csv(spark: SparkSession, path: str, level: str, schema: StructType | str, null_value: str = "null",
                   optional: tuple[str, ...] = ("description",)) -> DataFrame:
    """S3: one level's ranked table as CSV with header, its columns in any order and others beside them.  A column
    of ``schema`` that the files lack is an error, or null if it is ``optional``; a ``level`` column,
    where there is one, is filtered.  A value that does not fit its type is an error."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    texts = _texts(spark, path, null_value)
    fields = [f for f in schema.fields if f.name != "level"]
    check_columns(texts, [f.name for f in fields if f.name not in optional])
    if "level" in texts.columns:
        texts = texts.where(F.col("level") == level)
    return texts.select(*[(F.col(f"`{f.name}`") if f.name in texts.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
