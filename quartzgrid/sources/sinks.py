"""Sinks: benchmark CSV, clustered Parquet, and text listings of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BENCH_COLUMNS = ("size", "block_size", "precision", "time_ms", "error")


def write_bench_csv(results: DataFrame, path: str) -> None:
    """One CSV file with a header; a benchmark matrix is a few hundred rows. Folders are made, failures raise."""
    results.select(*BENCH_COLUMNS).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_clustered(points: DataFrame, path: str) -> None:
    """Parquet in Z-order, so that row groups have tight ranges of codes and readers can skip them."""
    points.write.mode("overwrite").parquet(path)


def format_points(points: DataFrame, title: str = "", most: int = 20) -> str:
    """A listing of the first points in Z-order with two decimals: for people, not for comparison."""
    count = points.count()
    lines = [f"{title} ({count} points):"] if title else []
    for p in points.orderBy("morton", "id").limit(most).select("x", "y", "vx", "vy", "temp").collect():
        lines.append(f"  at ({p.x:.2f}, {p.y:.2f}) velocity ({p.vx:.2f}, {p.vy:.2f}) temperature {p.temp:.2f}")
    if count > most:
        lines.append(f"  ... first {most} of {count} points")
    return "\n".join(lines)


def format_summary(counts: DataFrame) -> str:
    rows = counts.orderBy("variant").collect()
    return "\n".join(f"{r['variant']:<20} {r['hot_count']:>12}" for r in rows)


def binary_lines(steps: DataFrame) -> str:
    """The bit trace, one line a step."""
    return "\n".join(f"{r['bits']}  {r['value']:>10}  {r['label']}" for r in steps.orderBy("step").select("step", "label", "bits", F.col("value")).collect())
