"""Column expressions (JVM-side, inside whole-stage codegen).

P4 ratio, P5 unit scale, P6 strict sum, P7 truncating percent,
T1 key affixes, T2 percent label, T3 list text, T4 tooltip.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """Num / den as DOUBLE; NULL when den is NULL or 0.

    ``try_divide`` keeps ANSI mode from failing the job on a zero area.
    """
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def scale(c: ColumnOrName, factor: float) -> Column:
    """P5: multiply by a constant (1e-6 turns m^2 into km^2)."""
    return _c(c) * F.lit(factor)


def strict_sum(cols: list[ColumnOrName], as_type: str | None = None) -> Column:
    """Plain ``a + b + ...``; NULL if any input is NULL.

    With ``as_type`` (e.g. ``decimal(30,12)``) every term is cast first,
    so that sums of the result are exact and equal groups tie exactly
    (floating sums depend on the order of addition).
    """
    terms = [_c(c).cast(as_type) if as_type else _c(c) for c in cols]
    total = reduce(add, terms)
    return total.cast(as_type) if as_type else total


def trunc_percent(c: ColumnOrName) -> Column:
    """``(v * 100)`` cast to INT, i.e. truncated toward zero."""
    return (_c(c) * F.lit(100)).cast("int")


def affix(c: ColumnOrName, prefix: str = "", suffix: str = "") -> Column:
    """Add a prefix / suffix so that keys of two tables agree.
    NULL in, NULL out."""
    parts = ([F.lit(prefix)] if prefix else []) + [_c(c)] + ([F.lit(suffix)] if suffix else [])
    return F.concat(*parts) if len(parts) > 1 else _c(c)


def percent_label(name: ColumnOrName, value: ColumnOrName) -> Column:
    """``name: NN%`` with NN the truncated percentage."""
    return F.concat(_c(name), F.lit(": "), trunc_percent(value).cast("string"), F.lit("%"))


def list_text(items: ColumnOrName, prefix: str = "Ranks highly in: ",
              sep: str = ", ") -> Column:
    """Prefix + items joined by sep (NULL items are skipped)."""
    return F.concat(F.lit(prefix), F.concat_ws(sep, _c(items)))


def tooltip(name: ColumnOrName, description: ColumnOrName | None) -> Column:
    """T4: ``name <br> description``; without a description the name."""
    if description is None:
        return _c(name).cast("string")
    return F.format_string("%s <br> %s", _c(name), _c(description))
