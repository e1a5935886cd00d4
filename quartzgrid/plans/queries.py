"""The registry of queries over the driver's tables. Every key has its SQL in :mod:`.oracles`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.morton import SPREAD, binary32, spread_steps
from ..operators import bins, compact, compare, layout, surface
from ..sources.points import ADAPTERS, generate_points, narrow, widen
from . import bench

Query = Callable[[SparkSession, str], DataFrame]
DEMO, BENCH = 30.0, 25.0


def _points(name: str) -> Query:
    return lambda spark, sf_dir: layout.with_morton(ADAPTERS[name](spark, sf_dir))


orders, events, lineitem = _points("orders"), _points("events"), _points("lineitem")


def morton_encode(spark, sf_dir):
    return orders(spark, sf_dir).select("id", "x", "y", "morton")


def _bin_query(k: int) -> Query:
    return lambda spark, sf_dir: bins.with_bin(orders(spark, sf_dir), k).select("id", "bin")


def binary_format(spark, sf_dir):
    return orders(spark, sf_dir).select("id", binary32(F.col("morton")).alias("bits"))


def bit_trace(spark, sf_dir):
    """The value of x after each spreading step, by order."""
    points = orders(spark, sf_dir)
    names = ["original", *[f"shift {s}" for s, _ in SPREAD]]
    steps = [F.struct(F.lit(i).alias("step"), F.lit(n).alias("label"), v.alias("value")) for i, (n, v) in enumerate(zip(names, spread_steps(F.col("x")), strict=True))]
    return points.select("id", F.explode(F.array(*steps)).alias("s")).select("id", "s.step", "s.label", binary32(F.col("s.value")).alias("bits"), "s.value")


def compact_float(spark, sf_dir):
    return compact.compact(orders(spark, sf_dir), DEMO).select("id", "x", "y", "vx", "vy", "temp")


def compact_double(spark, sf_dir):
    return compact.compact(widen(orders(spark, sf_dir)), BENCH, "double").select("id", "x", "y", "temp")


def narrowed(spark, sf_dir):
    return narrow(widen(orders(spark, sf_dir))).select("id", "x", "y", "vx", "vy", "temp")


def compact_lineitem(spark, sf_dir):
    return compact.compact(lineitem(spark, sf_dir), DEMO).select("id", "x", "y", "temp", "morton")


def compact_count(spark, sf_dir):
    return compact.compact_count(lineitem(spark, sf_dir), DEMO)


def _variant(name: str) -> Query:
    return lambda spark, sf_dir: compact.compact_variant(events(spark, sf_dir), name, DEMO).select("id", "x", "y", "temp", "morton")


def bin_histogram(spark, sf_dir):
    return bins.histogram(lineitem(spark, sf_dir), 8)


def bin_histogram_dense(spark, sf_dir):
    return bins.histogram(lineitem(spark, sf_dir), 12, dense=True)


def bin_offsets(spark, sf_dir):
    return bins.offsets(lineitem(spark, sf_dir), 8)


def bin_scatter_slots(spark, sf_dir):
    return bins.scatter_slots(orders(spark, sf_dir), 8).select("id", "bin", "slot")


def bin_partition_compact(spark, sf_dir):
    return bins.partition_compact(orders(spark, sf_dir), 8, DEMO).select("id", "bin", "out_slot", "kernel")


def bin_summary_auto_kernel(spark, sf_dir):
    return bins.summary(events(spark, sf_dir), 8, DEMO)


def bin_output_offsets(spark, sf_dir):
    return bins.output_offsets(lineitem(spark, sf_dir), 8, DEMO).select("bin", "hot_count", "out_offset")


def warp_ballots(spark, sf_dir):
    return compact.warp_ballots(orders(spark, sf_dir), DEMO)


def surface_shape(spark, sf_dir):
    """Width and height of a surface with room for all points."""
    return surface.surface_shape(orders(spark, sf_dir), 64)


def one_bin(spark, sf_dir):
    return bins.one_bin(orders(spark, sf_dir), 8, 42, DEMO).select("id", "bin", "temp")


def flagship(spark, sf_dir):
    """Points by bin: how many there are, and how many are hot."""
    return bins.summary(lineitem(spark, sf_dir), 8, DEMO)


def _counts(width: int, name: str) -> Query:
    return lambda spark, sf_dir: compact.group_counts(orders(spark, sf_dir), DEMO, width, name)


def _ranks(width: int, name: str) -> Query:
    return lambda spark, sf_dir: compact.group_ranks(orders(spark, sf_dir), DEMO, width, name).select("id", name, "rank")


def morton_sort(spark, sf_dir):
    return layout.with_position(orders(spark, sf_dir)).select("id", "morton", "pos")


def morton_sort_topn(spark, sf_dir):
    return layout.first_points(orders(spark, sf_dir), 10).select("rn", "id", "x", "y", "vx", "vy", "temp", "morton")


def morton_cluster(spark, sf_dir):
    return layout.cluster_by_morton(orders(spark, sf_dir)).select("id", "morton")


def surface_pack_w64(spark, sf_dir):
    return surface.to_surface(orders(spark, sf_dir), DEMO, 64)


def grid_generate_n1000(spark, sf_dir):
    return generate_points(spark, 1000)


def positional_compare(spark, sf_dir):
    points = orders(spark, sf_dir)
    return compare.positional(compact.compact(points, BENCH), compact.compact_variant(points, "bin_partition", BENCH))


def variant_equivalence(spark, sf_dir):
    return compact.equivalence(events(spark, sf_dir), DEMO)


def morton_of_floats(spark, sf_dir):
    """Codes of coordinates in double precision, some of them negative or beyond 32 bits: truncated toward zero; -1 without a code."""
    points = orders(spark, sf_dir)
    x = F.col("x") * 0.75 - 100
    y = F.when(F.col("id") % 97 == 0, F.lit(1e12)).otherwise(F.col("y") / 4)
    wide = points.withColumns({"x": x.cast("double"), "y": y.cast("double")})
    return layout.with_morton(wide).select("id", "x", "y", F.coalesce("morton", F.lit(-1).cast("long")).alias("morton"))


def grid_positions(spark, sf_dir):
    """Places in Z-order on the generated grid, whose codes fill a small part of the code space."""
    return layout.with_position(layout.with_morton(generate_points(spark, 1 << 14))).select("id", "morton", "pos")


def bench_counts(spark, sf_dir):
    return bench.block_counts(spark)


def bench_matrix(spark, sf_dir):
    return bench.matrix(spark)


def multi_threshold(spark, sf_dir):
    return compact.multi_threshold(lineitem(spark, sf_dir), (BENCH, DEMO))


def queries() -> dict[str, Query]:
    plain = (
        morton_encode, binary_format, bit_trace, compact_float, compact_double, narrowed, compact_lineitem, compact_count, bin_histogram,
        bin_histogram_dense, bin_offsets, bin_scatter_slots, bin_partition_compact, bin_summary_auto_kernel, bin_output_offsets, warp_ballots, surface_shape, one_bin, flagship, morton_sort,
        morton_sort_topn, morton_cluster, surface_pack_w64, grid_generate_n1000, positional_compare, variant_equivalence, bench_matrix, multi_threshold,
        morton_of_floats, grid_positions, bench_counts,
    )
    out: dict[str, Query] = {f.__name__: f for f in plain}
    out |= {f"bin_id_k{k}": _bin_query(k) for k in (4, 8, 12)}
    out |= {f"compact_{v}": _variant(v) for v in compact.VARIANTS}
    out |= {"block_counts_256": _counts(256, "block"), "block_counts_64": _counts(64, "block"), "block_counts_1024": _counts(1024, "block"), "warp_counts_32": _counts(32, "warp"), "block_rank": _ranks(256, "block"), "warp_rank": _ranks(32, "warp")}
    return out
