"""Point sources: the generated grid, and adapters from tables to points.

A point is ``id, x, y, vx, vy, temp``: a unique key, coordinates, velocity and temperature.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(c, T.FloatType()) for c in ("x", "y", "vx", "vy", "temp")]])


def _uniform(position: Column) -> Column:
    """A number in [0, 1) from a position by a linear congruence (not a random stream: SQL can repeat it)."""
    state = position * F.lit(1103515245).cast("long") + F.lit(12345)
    return state.bitwiseAND(F.lit(2147483647)) / F.lit(2147483648.0)


def generate_points(spark: SparkSession, n: int, spacing: float = 1.0, seed: int = 0) -> DataFrame:
    """The first n points of a row-major grid of floor(sqrt(n)) columns; n of 0 or less gives no points.

    vx and vy are uniform in (-5, 5), temp in (10, 40); another seed shifts the positions of the draws.
    """
    n = max(0, n)
    width = max(1, isqrt(n))
    i = F.col("id")
    draw = lambda k: _uniform(i * 3 + F.lit(k + 3 * seed).cast("long"))
    return spark.range(n).select(
        "id",
        (F.pmod(i, F.lit(width)) * F.lit(float(spacing))).cast("float").alias("x"),
        (F.floor(i / width) * F.lit(float(spacing))).cast("float").alias("y"),
        (F.lit(-5.0) + F.lit(10.0) * draw(0)).cast("float").alias("vx"),
        (F.lit(-5.0) + F.lit(10.0) * draw(1)).cast("float").alias("vy"),
        (F.lit(10.0) + F.lit(30.0) * draw(2)).cast("float").alias("temp"),
    )


def grid_shape(n: int) -> tuple[int, int]:
    """(columns, rows) of the grid before it is trimmed to n points."""
    width = max(1, isqrt(max(0, n)))
    return width, -(-max(0, n) // width)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points from Parquet with the schema given: a file that differs from it is an error when it is read."""
    return spark.read.schema(POINT).parquet(path)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return t.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("x"), F.col("o_orderkey").alias("y"),
        (F.col("o_custkey") % 11 - 5).cast("float").alias("vx"), (F.col("o_orderkey") % 11 - 5).cast("float").alias("vy"),
        (F.col("o_totalprice") / 10000).cast("float").alias("temp"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    return t.select(
        F.col("event_id").alias("id"), (F.col("event_id") % 4096).alias("x"), F.col("user_id").alias("y"),
        (F.col("event_id") % 11 - 5).cast("float").alias("vx"), (F.col("user_id") % 11 - 5).cast("float").alias("vy"), F.col("value").cast("float").alias("temp"),
    )


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a unique key (the table has none): ``id`` is the order. For queries that don't rank rows."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(
        F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"),
        (F.col("l_partkey") % 11 - 5).cast("float").alias("vx"), (F.col("l_suppkey") % 11 - 5).cast("float").alias("vy"), F.col("l_quantity").cast("float").alias("temp"),
    )


ADAPTERS = {"orders": orders, "events": events, "lineitem": lineitem}


def widen(points: DataFrame) -> DataFrame:
    """Single to double precision."""
    return points.withColumns({c: F.col(c).cast("double") for c in ("x", "y", "vx", "vy", "temp")})


def narrow(points: DataFrame) -> DataFrame:
    """Double to single precision."""
    return points.withColumns({c: F.col(c).cast("float") for c in ("x", "y", "vx", "vy", "temp")})
