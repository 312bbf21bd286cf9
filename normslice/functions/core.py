"""Column functions with one NULL rule: unknown stays unknown, NaN is unknown too."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Seconds in each duration unit, aliases included.
UNIT_SECONDS = {"W": 604800.0, "w": 604800.0, "D": 86400.0, "d": 86400.0, "H": 3600.0, "h": 3600.0, "T": 60.0, "min": 60.0, "S": 1.0, "s": 1.0, "ms": 0.001}
NEVER = (1 << 63) - 1  # sorts after every real instant


def number(column: Column) -> Column:
    """As DOUBLE; text that is no number, and NaN, are NULL."""
    x = column.try_cast("double")
    return F.when(~F.isnan(x), x)


def saturate(z: Column, threshold: float, width: float) -> Column:
    """0 up to the threshold, then rising to 1 over the width; a width of 0 is a strict step; NULL stays NULL."""
    if width <= 0:
        ramp = F.when(z > threshold, F.lit(1.0)).otherwise(F.lit(0.0))
    else:
        ramp = F.least(F.greatest((z - threshold) / width, F.lit(0.0)), F.lit(1.0))
    return F.when(z.isNotNull(), ramp)


def member(column: Column, values: Iterable) -> Column:
    """Two-valued ``IN``: NULL is in no set."""
    return F.coalesce(column.isin(list(values)), F.lit(False))


def micros(timestamp: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), timestamp.cast("timestamp_ntz"))


def instant(us: Column) -> Column:
    """The timestamp without zone at so many microseconds since 1970."""
    return F.timestamp_micros(us).cast("timestamp_ntz")


def duration(start: Column, end: Column, unit: str) -> Column:
    """Time between two instants in microseconds, in the unit."""
    return (end - start) / F.lit(1e6) / F.lit(UNIT_SECONDS[unit])


def every(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def either(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def total(columns: Sequence[Column]) -> Column:
    """Sum of columns, NULL if any is NULL; 0 for none."""
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def average_rank(value: Column, partition: Sequence[Column] = ()) -> Column:
    """Rank with ties sharing their mean rank."""
    ordered = Window.partitionBy(*partition).orderBy(value)
    peers = Window.partitionBy(*partition, value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(peers) - 1) / 2.0


def correlation(x: str, y: str) -> Column:
    """Pearson's aggregate over rows where both are known; NULL if one does not vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 0, F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0)))


def finite_or_none(value: float | None, what: str, least: float | None = None) -> None:
    """Refuses a parameter that is no finite number in its range; None is taken."""
    from normslice.plans.constraints import finite

    if value is not None:
        finite(value, what, least=least)
