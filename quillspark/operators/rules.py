"""Rules that a sheet only stores, evaluated: validation of values and conditional formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {
    "between": lambda c, a, b: c.between(a, b),
    "notBetween": lambda c, a, b: ~c.between(a, b),
    "equal": lambda c, a, b: c == a,
    "notEqual": lambda c, a, b: c != a,
    "greaterThan": lambda c, a, b: c > a,
    "lessThan": lambda c, a, b: c < a,
    "greaterThanOrEqual": lambda c, a, b: c >= a,
    "lessThanOrEqual": lambda c, a, b: c <= a,
}
KINDS = ("whole", "decimal", "date", "time", "textLength")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_range(value, kind: str, operator: str, first, second=None) -> Column:
    """Whether a value passes a range validation: whole, decimal, date, time or textLength by eight operators.
    Blank passes; what isn't of the kind doesn't."""
    c = _col(value)
    if kind == "textLength":
        typed = F.length(c.cast("string"))
    elif kind == "whole":
        number = c.try_cast("double")
        typed = F.when(number == F.floor(number), number)
    elif kind == "decimal":
        typed = c.try_cast("double")
    elif kind == "date":
        typed = c.try_cast("timestamp")
    else:
        typed = F.date_format(c.try_cast("timestamp"), "HH:mm:ss")
    lit = lambda x: F.lit(x).cast("timestamp") if kind == "date" and isinstance(x, str) else F.lit(x)
    passes = COMPARE[operator](typed, lit(first), lit(second) if second is not None else None)
    return c.isNull() | F.coalesce(passes, F.lit(False))


def in_list(value, items: list[str]) -> Column:
    """Whether a value is one of a dropdown's items. Blank passes."""
    c = _col(value)
    return c.isNull() | c.cast("string").isin(list(items))


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with violations: the names of the rules that a row breaks, in their order."""
    broken = [F.when(~F.coalesce(passes, F.lit(False)), F.lit(name)) for name, passes in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))


def highlighted(value, operator: str, first, second=None) -> Column:
    """Whether a cell-value format applies. Blank never."""
    c = _col(value)
    return F.coalesce(COMPARE[operator](c, F.lit(first), F.lit(second) if second is not None else None), F.lit(False))


def with_bounds(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """df with low and high of the value's range. Sums before the shuffle, so that one range over all rows, or a
    key with most rows, isn't gathered in a task as a window would."""
    low, high = F.min(value).alias("low"), F.max(value).alias("high")
    if not keys:
        return df.crossJoin(F.broadcast(df.agg(low, high)))  # one row
    return df.join(df.groupBy(*keys).agg(low, high), keys)


def share(value, low="low", high="high") -> Column:
    v, a, b = _col(value), _col(low), _col(high)
    return F.when(b > a, (v - a) / (b - a)).otherwise(F.when(v.isNotNull(), F.lit(0.0)))


def icon(part: Column, icons: int = 3) -> Column:
    """The icon of a share of the range: cuts at round(100 p / icons) percent."""
    out = F.lit(0)
    for p in range(1, icons):
        out = F.when(part * 100 >= round(100 * p / icons), F.lit(p)).otherwise(out)
    return F.when(part.isNotNull(), out)


def data_bar(part: Column, width: int = 100) -> Column:
    return F.bround(part * width, 0).cast("int")


def color_scale(part: Column, low: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    """The colour between two, as six hex digits."""
    mixed = [F.lpad(F.hex(F.bround(F.lit(a) + part * (b - a), 0).cast("int")), 2, "0") for a, b in zip(low, high, strict=True)]
    return F.concat(*mixed)


def expression(sql: str) -> Column:
    """A rule given as an SQL predicate over the row's columns; formulas of a sheet are not evaluated."""
    return F.coalesce(F.expr(sql).cast("boolean"), F.lit(False))
