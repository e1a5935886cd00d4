"""The benchmark matrix: sizes x block sizes x precisions, timed on a sink that discards rows."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicate import hot, size_error
from ..operators.compact import compact
from ..operators.layout import with_morton
from ..sources.points import generate_points, widen

SIZES = tuple(1 << e for e in range(10, 24))
BLOCK_SIZES = (32, 64, 128, 256, 512, 1024)
PRECISIONS = ("float", "double")
THRESHOLD = 25.0


def matrix(spark: SparkSession, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """``size, block_size, precision`` of every cell."""
    column = lambda name, values: spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))
    blocks, precisions = column("block_size", BLOCK_SIZES), column("precision", PRECISIONS)
    return column("size", sizes).crossJoin(F.broadcast(blocks)).crossJoin(F.broadcast(precisions))


def block_counts(spark: SparkSession, sizes: tuple[int, ...] = (1 << 10, 1 << 12)) -> DataFrame:
    """The part of the matrix that repeats exactly: ``size, block_size, precision, blocks, hot_count, error``.

    ``blocks`` is the number of blocks of neighbours in row-major order that the size needs, ``hot_count`` the points
    above the threshold in the precision, ``error`` its relative difference to the count in single precision.
    """
    out = None
    for size in sizes:
        points = generate_points(spark, size)
        wide = widen(points).select(F.col("temp").alias("wide"), "id")
        both = points.join(wide, "id").agg(F.count_if(hot(F.col("temp"), THRESHOLD)).alias("float"), F.count_if(hot(F.col("wide"), THRESHOLD, "double")).alias("double"))
        one = both.select(F.lit(size).alias("size"), "float", "double")
        out = one if out is None else out.unionByName(one)
    cells = matrix(spark, sizes).join(out, "size")
    own = F.when(F.col("precision") == "double", F.col("double")).otherwise(F.col("float"))
    return cells.select("size", "block_size", "precision", F.ceil(F.col("size") / F.col("block_size")).cast("long").alias("blocks"), own.alias("hot_count"), size_error(own, F.col("float")).alias("error"))


def run_cell(spark: SparkSession, size: int, block_size: int, precision: str) -> dict:
    """Time one cell; the error compares its count with that of the plain filter in single precision.

    The block size has no counterpart in Spark's plan and is only recorded.
    """
    points = with_morton(generate_points(spark, size))
    own = widen(points) if precision == "double" else points
    start = time.perf_counter()
    compact(own, THRESHOLD, precision).write.format("noop").mode("overwrite").save()
    took = (time.perf_counter() - start) * 1000
    count, baseline = compact(own, THRESHOLD, precision).count(), compact(points, THRESHOLD).count()
    return {"size": size, "block_size": block_size, "precision": precision, "time_ms": took, "error": abs(count - baseline) / baseline if baseline else 0.0}


def run_matrix(spark: SparkSession, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    cells = sorted(matrix(spark, sizes).collect())
    rows = [run_cell(spark, *c) for c in cells]
    return spark.createDataFrame(rows, "size int, block_size int, precision string, time_ms float, error float")
