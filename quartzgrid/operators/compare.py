"""Side-by-side comparison of two outputs by their place in Z-order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layout import first_points


def positional(a: DataFrame, b: DataFrame, n: int = 5) -> DataFrame:
    """The first n places that both outputs have, with both points' code, id and temperature, and whether they agree."""
    left = first_points(a, n).select("rn", *[F.col(c).alias(f"a_{c}") for c in ("id", "morton", "temp")])
    right = first_points(b, n).select("rn", *[F.col(c).alias(f"b_{c}") for c in ("id", "morton", "temp")])
    same = (F.col("a_id") == F.col("b_id")) & (F.col("a_temp") == F.col("b_temp"))
    return left.join(right, "rn").withColumn("same", same)
