"""Packing hot points on a two-dimensional surface."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .compact import compact
from .layout import with_position


def to_surface(points: DataFrame, threshold: float, width: int) -> DataFrame:
    """The n-th hot point in Z-order at ``sx = n mod width, sy = n div width`` with ``c0..c3`` = vx, vy, temp, 1."""
    if width < 1:
        raise ValueError("width must be 1 or more")
    placed = with_position(compact(points, threshold))
    return placed.select(
        F.pmod("pos", F.lit(width)).alias("sx"), F.expr(f"pos div {int(width)}").alias("sy"),
        F.col("vx").alias("c0"), F.col("vy").alias("c1"), F.col("temp").alias("c2"), F.lit(1.0).cast("float").alias("c3"),
    )


def surface_height(n: int, width: int) -> int:
    """Rows of a surface that has room for all input points."""
    return -(-n // width)


def surface_shape(points: DataFrame, width: int) -> DataFrame:
    """``width, height`` of the surface that has room for all points."""
    if width < 1:
        raise ValueError("width must be 1 or more")
    return points.agg(F.count(F.lit(1)).alias("n")).select(F.lit(width).cast("long").alias("width"), F.expr(f"(n + {width - 1}) div {width}").alias("height"))
