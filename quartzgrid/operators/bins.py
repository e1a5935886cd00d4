"""Bins of the low k bits: histogram, offsets, scatter slots, per-bin summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.morton import bin_id, check_bits
from ..functions.predicate import hot
from .layout import coded

#: Bins that are broadcast: 2^k rows of a few longs each.
BROADCAST_BITS = 20
#: Bits of a block of bins.
BLOCK_BITS = 15
#: Sizes up to which a bin is handled by a warp, or by one block.
WARP, BLOCK = 32, 1024


def with_bin(points: DataFrame, k: int) -> DataFrame:
    return points.withColumn("bin", bin_id(F.col("morton"), k))


def histogram(points: DataFrame, k: int, dense: bool = False) -> DataFrame:
    """``bin, size`` of the bins that have points, or of all 2^k. Points without a code are in no bin."""
    counts = with_bin(coded(points), k).groupBy("bin").agg(F.count(F.lit(1)).alias("size"))
    if not dense:
        return counts
    every = points.sparkSession.range(1 << check_bits(k)).withColumnRenamed("id", "bin")
    return every.join(counts, "bin", "left").select("bin", F.coalesce("size", F.lit(0)).alias("size"))


def _with_before(df: DataFrame, value: str, name: str, k: int) -> DataFrame:
    """``df`` (a row a bin) plus the sum of ``value`` over the bins before. Up to 2^20 bins stand in one window; more
    are summed up in blocks of 2^15 bins, and the blocks (2^15 at most, for 2^30 bins) in one window."""
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    if k <= BROADCAST_BITS:
        return df.withColumn(name, F.coalesce(F.sum(value).over(past(Window.orderBy("bin"))), F.lit(0)))
    df = df.withColumn("_block", F.shiftright("bin", BLOCK_BITS))
    blocks = df.groupBy(F.col("_block").alias("_of")).agg(F.sum(value).alias("_sum"))
    blocks = blocks.select("_of", F.coalesce(F.sum("_sum").over(past(Window.orderBy("_of"))), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(value).over(past(Window.partitionBy("_block").orderBy("bin"))), F.lit(0))
    joined = df.withColumn("_inside", inside).join(F.broadcast(blocks), F.col("_block") == F.col("_of"))  # 2^15 rows + 1
    return joined.withColumn(name, F.col("_before") + F.col("_inside")).drop("_block", "_of", "_inside", "_before")


def offsets(points: DataFrame, k: int) -> DataFrame:
    """``bin, size, offset`` of all 2^k bins, and the last row ``2^k, 0, number of points``."""
    sizes = histogram(points, k, dense=True)
    end = points.sparkSession.range(1).select(F.lit(1 << k).cast("long").alias("bin"), F.lit(0).cast("long").alias("size"))
    return _with_before(sizes.unionByName(end), "size", "offset", k)


def _by_bin(df: DataFrame, k: int) -> DataFrame:
    """A table of at most 2^k rows: broadcast as long as k bounds it, else joined by shuffle."""
    return F.broadcast(df) if k <= BROADCAST_BITS else df


def scatter_slots(points: DataFrame, k: int) -> DataFrame:
    """``points`` with ``bin`` and ``slot``: the place from 0 if bins are laid out one after the other, each in
    Z-order. Bins are numbered in parallel; the slots are a permutation of 0 to n - 1."""
    starts = _with_before(histogram(points, k), "size", "_offset", k).select("bin", "_offset")
    rank = F.row_number().over(Window.partitionBy("bin").orderBy("morton", "id"))
    binned = with_bin(coded(points), k)
    return binned.join(_by_bin(starts, k), "bin").withColumn("slot", F.col("_offset") + rank - 1).drop("_offset")


def strategy(size: Column) -> Column:
    """The label of the strategy for a bin of so many points; it never affects rows."""
    return F.when(size <= WARP, "bitmask").when(size <= BLOCK, "warp").otherwise("shared")


def summary(points: DataFrame, k: int, threshold: float, precision: str = "float") -> DataFrame:
    """``bin, size, hot_count, kernel`` of the bins that have points."""
    binned = with_bin(coded(points), k)
    sums = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("size"), F.count_if(hot(F.col("temp"), threshold, precision)).alias("hot_count"))
    return sums.withColumn("kernel", strategy(F.col("size")))


def output_offsets(points: DataFrame, k: int, threshold: float, precision: str = "float") -> DataFrame:
    """``summary`` plus ``out_offset``: where each bin's hot points begin in the compacted output."""
    return _with_before(summary(points, k, threshold, precision), "hot_count", "out_offset", k)


def partition_compact(points: DataFrame, k: int, threshold: float, precision: str = "float") -> DataFrame:
    """The hot points, bins in order: ``bin``, ``out_slot`` (from 0 without gaps) and the bin's ``kernel``.

    The filter comes before the numbering, so only hot rows are exchanged.
    """
    per_bin = output_offsets(points, k, threshold, precision).select("bin", F.col("out_offset").alias("_out"), "kernel")
    kept = with_bin(coded(points).where(hot(F.col("temp"), threshold, precision)), k)
    rank = F.row_number().over(Window.partitionBy("bin").orderBy("morton", "id"))
    return kept.join(_by_bin(per_bin, k), "bin").withColumn("out_slot", F.col("_out") + rank - 1).drop("_out")


def one_bin(points: DataFrame, k: int, number: int, threshold: float) -> DataFrame:
    """The hot points of one bin."""
    return with_bin(points, k).where(F.col("bin") == number).where(hot(F.col("temp"), threshold))
