"""
this repo") on one scale factor: median of three warm runs each.

    python tests/variants.py /root/testdata/sf0.1
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tractus.operators.density import density_enrichment  # noqa: E402
from tractus.operators.explain import explain_level  # noqa: E402
from tractus.operators.percentile import percent_rank, percent_rank_window  # noqa: E402
from tractus.plans import domain as D  # noqa: E402
from tractus.session import get_session, materialize  # noqa: E402
from tractus.sources import bindings as B  # noqa: E402


def seven_windows(df, key, metrics):
    """The reference's shape: one global window per metric (each a
    single-partition exchange), top 3 per key afterwards."""
    sums = df.groupBy(key).agg(*[F.sum(m).cast("double").alias(m) for m in metrics])
    for m in metrics:
        sums = sums.withColumn(m, F.percent_rank().over(Window.partitionBy().orderBy(F.col(m))))
    long = sums.unpivot([key], metrics, "variable", "value")
    w = Window.partitionBy(key).orderBy(F.col("value").desc())
    return long.withColumn("rn", F.row_number().over(w)).filter("rn <= 3")


def window_density(df, levels):
    out = df.withColumn("unit_density", F.try_divide("population", "geo_area"))
    for lv in levels:
        w = Window.partitionBy(lv.key)
        den = F.max(lv.area).over(w) if lv.replicated else F.sum(lv.area).over(w)
        out = out.withColumn(lv.out, F.when(F.col(lv.key).isNotNull(),
                                            F.try_divide(F.sum("population").over(w), den)))
    return out


def main(src: str) -> None:
    spark = get_session("local[8]", 8)
    if not spark.sparkContext.getCheckpointDir():
        import tempfile
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tractus-variants-"))
    enriched = materialize(D.enriched_units(spark, src), "variants")
    scored = materialize(D.scored_units(spark, src), "variants-scored")
    regions = materialize(D.enriched_units(spark, src).select(
        "unit_id", "county_name", "state", "city", "population", "geo_area", "cf_area", "sf_area"),
        "variants-regions")
    variants = {
        "w2_builtin_window": lambda: percent_rank_window(enriched, "unit_density", "p", False),
        "w2_distributed": lambda: percent_rank(enriched, "unit_density", "p", False),
        "c4_seven_global_windows": lambda: seven_windows(scored, "county_name", B.INDICATORS),
        "c4_unpivoted_window": lambda: explain_level(scored, "county_name", B.INDICATORS, 3),
        "c2_aggregate_join": lambda: density_enrichment(regions, "population", "geo_area",
                                                        "unit_density", D.DENSITY_LEVELS),
        "c2_window_per_key": lambda: window_density(regions, D.DENSITY_LEVELS),
    }
    out = {}
    for name, build in variants.items():
        runs = []
        for i in range(4):
            t = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - t)
        out[name] = round(statistics.median(runs), 3)
    print(json.dumps({"sf_dir": src, "median_sec": out}))


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
