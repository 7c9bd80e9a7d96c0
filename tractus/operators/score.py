"""Composite score = strict sum of indicator columns plus a
density percentile (P6 + W2).

The density percentile is descending (densest unit -> 0, NULL density
-> highest), ranked by the distributed percent rank at every size.

``exact=True`` casts every term to DECIMAL(18 + scale, scale) before adding: the
score is summed again per region and compared for ties, and floating
sums depend on the order of addition.  ``scale`` (default 12) is the number of
decimals kept: terms are rounded to it, and a term of 10^18 or more is an error, never a wrong sum.  A NaN or infinite term has no decimal form: the
score is NULL, like that of a NULL term.  ``exact=False`` adds doubles as they
are (NaN stays NaN).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractus.functions.columns import strict_sum
from tractus.operators.percentile import percent_rank

SCORE_SCALE = 12


def density_percentile(df: DataFrame, density: str, out: str,
                       ascending: bool = False) -> DataFrame:
    """Global percent rank of the unit density."""
    return percent_rank(df, density, out, ascending)


def composite_score(df: DataFrame, indicators: list[str], density: str,
                    out: str = "score", density_out: str = "density_percentile",
                    ascending: bool = False, exact: bool = True,
                    scales: dict[str, float] | None = None,
                    scale: int = SCORE_SCALE) -> DataFrame:
    """``score`` = indicators + density percentile; NULL if any term is NULL.

    ``scales`` multiplies single indicators first (e.g. 0.01 for an
    indicator given in 0-100 while the percentile is 0-1); default 1,
    the plain sum."""
    df = density_percentile(df, density, density_out, ascending)
    kind = f"decimal({18 + scale},{scale})"

    def exact_term(c):
        # a double without a decimal form (NaN, infinity) counts as NULL
        v = F.col(c)
        if dict(df.dtypes)[c] in ("double", "float"):
            v = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
        return v.cast(kind)
    terms = []
    for c in [*indicators, density_out]:
        factor = (scales or {}).get(c)
        if exact:
            term = exact_term(c)
            terms.append(term if factor is None else (term * F.lit(factor).cast("decimal(20,10)")).cast(kind))
        elif factor is None:
            terms.append(F.col(c))
        else:
            terms.append(F.col(c) * F.lit(factor))
    return df.withColumn(out, strict_sum(terms, kind if exact else None))
