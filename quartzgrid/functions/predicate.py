"""The hot-point predicate: strictly above a threshold, in the precision of the column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hot(temp: Column, threshold: float, precision: str = "float") -> Column:
    """``temp > threshold`` with the threshold in the column's precision. NaN is not hot; null is null.

    A bare comparison keeps NaN, which Spark orders above everything.
    """
    if precision not in ("float", "double"):
        raise ValueError(f"precision must be float or double, not {precision}")
    return ~F.isnan(temp) & (temp > F.lit(threshold).cast(precision))


def size_error(size: Column, baseline: Column) -> Column:
    """Relative difference of two sizes, 0 if the baseline is empty."""
    return F.when(baseline == 0, F.lit(0.0)).otherwise(F.abs(size - baseline) / baseline)
