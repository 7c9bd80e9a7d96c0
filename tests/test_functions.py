"""Column functions: P4 P5 P6 P7 T1 T2 T3 T4."""

from pyspark.sql import functions as F

from tractus.functions.columns import (affix, list_text, percent_label, ratio, scale,
                                       strict_sum, tooltip, trunc_percent)


def one(spark, expr, schema="a double, b double", row=(1.0, 2.0)):
    return spark.createDataFrame([row], schema).select(expr.alias("x")).first()["x"]


def test_ratio_zero_and_null(spark):
    assert one(spark, ratio("a", "b")) == 0.5
    assert one(spark, ratio("a", "b"), row=(1.0, 0.0)) is None
    assert one(spark, ratio("a", "b"), row=(1.0, None)) is None


def test_scale(spark):
    assert one(spark, scale("a", 1e-6), row=(2e6, 0.0)) == 2.0


def test_strict_sum_null(spark):
    assert one(spark, strict_sum(["a", "b"])) == 3.0
    assert one(spark, strict_sum(["a", "b"]), row=(1.0, None)) is None
    assert str(one(spark, strict_sum(["a", "b"], "decimal(30,12)"))) == "3.000000000000"


def test_trunc_percent_truncates(spark):
    assert one(spark, trunc_percent("a"), row=(0.29, 0.0)) == 28
    assert one(spark, trunc_percent("a"), row=(0.999, 0.0)) == 99


def test_affix_and_labels(spark):
    s = "n string, v double"
    assert one(spark, affix("n", suffix=" County"), s, ("Kent", 0.5)) == "Kent County"
    assert one(spark, affix("n", prefix="NATION_"), s, ("7", 0.5)) == "NATION_7"
    assert one(spark, affix("n", suffix=" County"), s, (None, 0.5)) is None
    assert one(spark, percent_label("n", "v"), s, ("PM25", 0.98)) == "PM25: 98%"
    arr = F.array(F.lit("A: 1%"), F.lit(None).cast("string"), F.lit("B: 2%"))
    assert one(spark, list_text(arr), s, ("x", 0.0)) == "Ranks highly in: A: 1%, B: 2%"
    assert one(spark, tooltip("n", "n"), s, ("x", 0.0)) == "x <br> x"
