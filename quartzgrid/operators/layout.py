"""Morton codes on points, and the two orders by code: total and clustered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from ..functions.morton import cell, morton


def _cell_of(points: DataFrame, name: str) -> Column:
    whole = isinstance(points.schema[name].dataType, (ByteType, ShortType, IntegerType, LongType))
    return cell(F.col(name), whole)


def with_morton(points: DataFrame) -> DataFrame:
    """``points`` plus ``morton`` from x and y; null where a coordinate has no cell."""
    return points.withColumn("morton", morton(_cell_of(points, "x"), _cell_of(points, "y")))


def coded(points: DataFrame) -> DataFrame:
    """The points that have a code. The filter is on the coordinates: short, and a plain null test for integers, where
    one on the code would be computed in full a second time."""
    return points.where(_cell_of(points, "x").isNotNull() & _cell_of(points, "y").isNotNull())


def sort_by_morton(points: DataFrame) -> DataFrame:
    """Total order by code; equal codes by id. A range exchange and a sort: every partition sorts its own range."""
    return points.orderBy("morton", "id")


def cluster_by_morton(points: DataFrame, partitions: int | None = None) -> DataFrame:
    """Range partitions of codes, each sorted: the layout to write, without a global merge."""
    ranged = points.repartitionByRange(partitions, "morton") if partitions else points.repartitionByRange("morton")
    return ranged.sortWithinPartitions("morton", "id")


def first_points(points: DataFrame, n: int) -> DataFrame:
    """The first n points in Z-order with their place ``rn`` (from 1). Takes n before numbering: a top-n per task,
    and the numbering sees n rows."""
    top = points.orderBy("morton", "id").limit(n)
    return top.withColumn("rn", F.row_number().over(Window.orderBy("morton", "id")).cast("long"))


#: Ranges of codes that positions are counted by, at most (and one for points without a code).
RANGES = 4096
#: Rows that a range should hold at most.
RANGE_ROWS = 250_000


def range_bounds(points: DataFrame) -> list[int]:
    """Codes that cut the points into ranges of about equal numbers: quantiles, found by one pre-aggregated pass."""
    rows = points.count()
    n = min(RANGES, max(1, points.sparkSession.sparkContext.defaultParallelism, -(-rows // RANGE_ROWS)))
    cuts = points.where("morton is not null").select("morton").approxQuantile("morton", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    return sorted({int(c) for c in cuts})


def with_position(points: DataFrame) -> DataFrame:
    """``points`` plus ``pos``, the place in Z-order from 0, without bringing all rows into one task.

    Rows are dealt to ranges of codes whose bounds are quantiles of the codes themselves, so a grid that fills a small
    part of the code space is spread as evenly as one that fills all. Counts are summed up over at most 4,097 ranges,
    and rows are numbered inside their range. The bounds are found when this is called. Points without a code come first. Points of one code stay together; a
    code that holds most of the points makes one large (spilling) sort.
    """
    cuts = range_bounds(points)
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    key = F.when(F.col("morton").isNull(), -1).otherwise(_bucket(F.col("morton"), bounds, len(cuts)))
    counts = points.groupBy(key.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # at most RANGES + 1 rows
    ranged = points.withColumn("_range", key).join(F.broadcast(offsets), "_range")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("morton", "id"))
    return ranged.withColumn("pos", F.col("_before") + inside - 1).drop("_range", "_before")


def _bucket(value: Column, bounds: Column, n: int) -> Column:
    """How many of the n sorted bounds are no greater than the value: a binary search in as many steps as n has bits."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))]).cast("array<int>")
    passed = lambda at, step: F.coalesce(F.get(bounds, at + step - 1) <= value, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(passed(at, step), step).otherwise(0))
