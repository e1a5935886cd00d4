"""Compaction: the filter to hot points, and the counts and ranks by block and warp."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicate import hot, size_error
from . import bins
from .layout import with_position

#: Every name gives the same rows; Catalyst picks the physical plan.
VARIANTS = ("cpu", "library", "naive", "shared", "warp", "bitmask", "bin_atomic", "bin_partition")
WARP, BLOCK = 32, 256


def compact(points: DataFrame, threshold: float, precision: str = "float") -> DataFrame:
    """The points above the threshold: one filter, no exchange."""
    return points.where(hot(F.col("temp"), threshold, precision))


def compact_count(points: DataFrame, threshold: float) -> DataFrame:
    return points.agg(F.count(F.lit(1)).alias("size"), F.count_if(hot(F.col("temp"), threshold)).alias("hot_count"))


def compact_variant(points: DataFrame, variant: str, threshold: float, k: int = 8, precision: str = "float") -> DataFrame:
    """The hot points by a named variant; ``k`` matters to the order of ``bin_partition`` alone."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant}")
    if variant == "bin_partition":
        return bins.partition_compact(points, k, threshold, precision).select(points.columns)
    bins.check_bits(k)
    return compact(points, threshold, precision)


def group_counts(points: DataFrame, threshold: float, width: int, name: str) -> DataFrame:
    """Hot points among each ``width`` neighbours in Z-order (blocks of 256, warps of 32)."""
    placed = with_position(points)
    return placed.groupBy(F.expr(f"pos div {int(width)}").alias(name)).agg(F.count(F.lit(1)).alias("size"), F.count_if(hot(F.col("temp"), threshold)).alias("hot_count"))


def group_ranks(points: DataFrame, threshold: float, width: int, name: str) -> DataFrame:
    """The hot points with their place (from 0) among the hot ones of their block or warp."""
    placed = with_position(points).withColumn(name, F.expr(f"pos div {int(width)}"))
    kept = placed.where(hot(F.col("temp"), threshold))
    rank = F.row_number().over(Window.partitionBy(name).orderBy("pos"))
    return kept.withColumn("rank", rank.cast("long") - 1)


def warp_ballots(points: DataFrame, threshold: float) -> DataFrame:
    """``warp, ballot, votes``: for each 32 neighbours in Z-order a mask with a bit for each hot one, and their number."""
    placed = with_position(points)
    vote = F.when(hot(F.col("temp"), threshold), F.expr(f"shiftleft(1L, cast(pos % {WARP} AS int))")).otherwise(0)
    masks = placed.groupBy(F.expr(f"pos div {WARP}").alias("warp")).agg(F.sum(vote).alias("ballot"))
    return masks.withColumn("votes", F.bit_count("ballot").cast("long"))


def multi_threshold(points: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """Hot points by threshold, in one pass over the points."""
    sums = points.agg(*[F.count_if(hot(F.col("temp"), t)).alias(f"c{i}") for i, t in enumerate(thresholds)])
    pairs = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"c{i}").alias("hot_count")) for i, t in enumerate(thresholds)])
    return sums.select(F.explode(pairs).alias("p")).select("p.*")


def equivalence(points: DataFrame, threshold: float, k: int = 8) -> DataFrame:
    """``variant, hot_count, error``: each variant's count, and its relative error to the first one."""
    counts = None
    for v in VARIANTS:
        one = compact_variant(points, v, threshold, k).agg(F.count(F.lit(1)).alias("hot_count")).withColumn("variant", F.lit(v))
        counts = one if counts is None else counts.unionByName(one)
    base = counts.where(F.col("variant") == VARIANTS[0]).select(F.col("hot_count").alias("_base"))
    return counts.crossJoin(F.broadcast(base)).select("variant", "hot_count", size_error(F.col("hot_count"), F.col("_base")).alias("error"))


def multiset_difference(a: DataFrame, b: DataFrame) -> int:
    """Rows of one side that the other lacks, repeated rows counted: 0 for equal outputs."""
    return a.exceptAll(b).count() + b.exceptAll(a).count()
