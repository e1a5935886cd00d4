"""Command line: generate points, sort them in Z-order, compact them, and print counts."""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bins
from ..operators.compact import compact, compact_variant
from ..operators.layout import with_morton
from ..sources.points import generate_points
from ..sources.sinks import format_points

THRESHOLD = 30.0
KERNELS = ("auto", "bitmask", "shared", "warp")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quartzgrid", description="Spatial point compaction in Z-order bins")
    p.add_argument("-n", type=int, default=100, help="number of points")
    p.add_argument("-r", action="store_true", help="another seed each run")
    p.add_argument("-t", action="store_true", help="show timings")
    side = p.add_mutually_exclusive_group()
    side.add_argument("-c", action="store_true", help="the plain filter only")
    side.add_argument("-g", action="store_true", help="the chosen variant only")
    p.add_argument("-k", type=int, default=8, help="bits of the bin number")
    p.add_argument("--mode", choices=("naive", "bin"), default="naive")
    p.add_argument("--variant", choices=("atomic", "partition"), default="partition")
    p.add_argument("--kernel", choices=KERNELS, default="auto")
    return p


def run_demo(spark: SparkSession, n: int = 100, k: int = 8, mode: str = "naive", variant: str = "partition", kernel: str = "auto", seed: int = 0) -> dict[str, DataFrame]:
    """The demo's tables: ``points``, ``plain`` (the filter), ``chosen`` (by mode and variant) and, for partitions,
    ``bins`` with the strategy label of each bin (``kernel`` other than auto sets it for all)."""
    points = with_morton(generate_points(spark, n, seed=seed))
    name = "naive" if mode == "naive" else f"bin_{variant}"
    out = {"points": points, "plain": compact(points, THRESHOLD), "chosen": compact_variant(points, name, THRESHOLD, k)}
    if name == "bin_partition":
        summary = bins.summary(points, k, THRESHOLD)
        out["bins"] = summary if kernel == "auto" else summary.withColumn("kernel", F.lit(kernel))
    return out


def main(args: Sequence[str] | None = None) -> int:
    given = parser().parse_args(args)
    bins.check_bits(given.k)
    spark = SparkSession.builder.appName("quartzgrid").getOrCreate()
    seed = time.time_ns() % 1_000_003 if given.r else 0
    found = run_demo(spark, given.n, given.k, given.mode, given.variant, given.kernel, seed)
    print(f"points {found['points'].count()}, threshold {THRESHOLD}, mode {given.mode}, k {given.k}")
    for name, wanted in (("plain", not given.g), ("chosen", not given.c)):
        if wanted:
            start = time.perf_counter()
            count = found[name].count()
            print(f"{name}: {count}" + (f" in {(time.perf_counter() - start) * 1000:.1f} ms" if given.t else ""))
    print(format_points(found["plain"], "hot", 10))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
