"""Golden codes, edge rows and the properties of bins, slots and ranks."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quartzgrid.functions.morton import bin_id, binary32, cell, morton, spread_steps
from quartzgrid.functions.predicate import hot
from quartzgrid.operators import bins, compact, compare, layout, surface
from quartzgrid.plans import bench, cli
from quartzgrid.sources import points as sources
from quartzgrid.sources import sinks

GOLDEN = [
    (0, 0, 0), (1, 0, 1), (0, 1, 2), (3, 5, 39), (255, 255, 65535), (256, 0, 65536), (65535, 0, 1431655765), (0, 65535, 2863311530), (65535, 65535, 4294967295),
    (65536, 0, 65536), (65792, 7, 65578), (100000, 70000, 1108831744), (-1, -3, 4294967287), (12345, 54321, 2803896131),
]


def test_golden_codes(spark):
    df = spark.createDataFrame(GOLDEN, "x long, y long, want long")
    assert df.where(morton(cell(F.col("x"), True), cell(F.col("y"), True)) != F.col("want")).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 65535), st.integers(0, 65535)), min_size=1, max_size=50))
def test_codes_interleave_bits(spark, pairs):
    want = [sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(16)) for x, y in pairs]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, x long, y long")
    got = [r[0] for r in df.select("i", morton(F.col("x"), F.col("y")).alias("m")).orderBy("i").select("m").collect()]
    assert got == want


def test_cells_of_odd_coordinates(spark):
    values = [0.9, 1.0, -1.0, -0.5, 2.7, 65536.0, 3e9, 1e10, math.nan, math.inf, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(cell(F.col("x"))).collect()]
    assert got == [0, 1, 4294967295, 0, 2, 65536, None, None, None, None, None]


def test_hot_edges(spark):
    above = float(np.nextafter(np.float32(30), np.float32(31)))
    values = [30.0, above, math.nan, math.inf, -math.inf, None]
    df = spark.createDataFrame([(v,) for v in values], "temp float")
    assert [r[0] for r in df.where(hot(F.col("temp"), 30.0)).collect()] == [above, math.inf]
    # the threshold takes the column's precision: 30.1 in single precision is above 30.1 in double
    one = spark.createDataFrame([(30.1,)], "temp float")
    assert one.where(hot(F.col("temp"), 30.1)).count() == 0
    with pytest.raises(ValueError):
        hot(F.col("temp"), 1, "half")


@pytest.mark.parametrize("k", [-1, 31])
def test_bad_bits(k):
    with pytest.raises(ValueError):
        bins.check_bits(k)


def test_bits_and_trace(spark):
    df = spark.createDataFrame([(5,)], "v long")
    assert df.select(binary32(F.col("v"))).first()[0] == "0" * 29 + "101"
    assert [r for r in df.select(*spread_steps(F.lit(0))).first()] == [0] * 5
    assert df.select(bin_id(F.lit(39), 0)).first()[0] == 0


@pytest.mark.parametrize("n", [0, 1, 31, 33, 257])
@pytest.mark.parametrize("k", [0, 7, 16])
def test_bin_properties(spark, n, k):
    points = layout.with_morton(sources.generate_points(spark, n))
    rows = bins.scatter_slots(points, k).select("slot", "bin", "morton").collect()
    assert sorted(r.slot for r in rows) == list(range(n))
    assert all(r.bin == r.morton & ((1 << k) - 1) for r in rows)
    if k <= 7:
        steps = sorted(bins.offsets(points, k).collect())
        assert steps[-1] == ((1 << k), 0, n) and all(a.offset + a.size == b.offset for a, b in zip(steps, steps[1:], strict=False))
    out = sorted(r[0] for r in bins.partition_compact(points, k, 30.0).select("out_slot").collect())
    assert out == list(range(compact.compact(points, 30.0).count()))


def test_variants_agree(spark):
    points = layout.with_morton(sources.generate_points(spark, 1000))
    plain = compact.compact(points, 30.0).cache()
    assert plain.count() == 334 and compact.compact(points, 25.0).count() == 501
    for v in compact.VARIANTS:
        assert compact.multiset_difference(plain, compact.compact_variant(points, v, 30.0, 5)) == 0
    assert compact.multiset_difference(plain, compact.compact(plain, 30.0)) == 0
    wide = compact.compact(sources.widen(points), 25.0, "double")
    assert wide.count() == 501
    with pytest.raises(ValueError):
        compact.compact_variant(points, "other", 30.0)


def test_no_hot_rows_and_points_without_code(spark):
    rows = [(1, math.nan, 0.0, 0.0, 0.0, 50.0), (2, 3.0, 5.0, 0.0, 0.0, 10.0), (3, 3.0, 5.0, 0.0, 0.0, 40.0), (3, 3.0, 5.0, 0.0, 0.0, 40.0)]
    points = layout.with_morton(spark.createDataFrame(rows, sources.POINT))
    assert compact.compact(points, 100.0).count() == 0
    assert compact.compact(points, 30.0).count() == 3
    assert {tuple(r) for r in bins.summary(points, 4, 30.0).collect()} == {(7, 3, 2, "bitmask")}
    assert sorted(r.pos for r in layout.with_position(points).collect()) == [0, 1, 2, 3]
    assert surface.to_surface(points, 30.0, 2).select("sx", "sy").distinct().count() == 3


def test_surface_and_compare(spark):
    points = layout.with_morton(sources.generate_points(spark, 100))
    packed = surface.to_surface(points, 30.0, 7)
    n = packed.count()
    assert sorted((r.sy * 7 + r.sx) for r in packed.collect()) == list(range(n)) and surface.surface_height(100, 7) == 15
    assert all(r.same for r in compare.positional(points, points).collect())
    with pytest.raises(ValueError):
        surface.to_surface(points, 30.0, 0)


@pytest.mark.parametrize("n", [1 << 20, 1 << 12])
def test_positions_are_dealt_evenly(spark, n):
    """A grid fills the lowest codes alone; its ranges still hold about equal numbers of points."""
    points = layout.with_morton(sources.generate_points(spark, n))
    cuts = layout.range_bounds(points)
    assert len(cuts) >= 3
    sizes = [r["count"] for r in points.groupBy(layout._bucket(F.col("morton"), F.array(*map(F.lit, cuts)), len(cuts)).alias("b")).count().collect()]
    assert len(sizes) == len(cuts) + 1 and sum(sizes) == n and max(sizes) < 2 * n / len(sizes)
    if n < 1 << 20:
        rows = sorted(layout.with_position(points).select("morton", "id", "pos").collect())
        assert [r.pos for r in rows] == list(range(n))


def test_buckets(spark):
    cuts = [3, 7, 7, 20, 31]
    df = spark.range(40)
    for n in range(6):
        own = cuts[:n]
        bounds = F.array(*map(F.lit, own)).cast("array<long>") if own else F.array().cast("array<long>")
        got = [r[0] for r in df.select(layout._bucket(F.col("id"), bounds, n)).collect()]
        assert got == [sum(c <= v for c in own) for v in range(40)]


def test_many_bins_in_blocks(spark, monkeypatch):
    points = layout.with_morton(sources.generate_points(spark, 3000))
    one = sorted(map(tuple, bins.offsets(points, 9).collect()))
    monkeypatch.setattr(bins, "BROADCAST_BITS", 4)
    monkeypatch.setattr(bins, "BLOCK_BITS", 5)
    assert sorted(map(tuple, bins.offsets(points, 9).collect())) == one
    assert sorted(r.slot for r in bins.scatter_slots(points, 9).collect()) == list(range(3000))


def test_layout_prunes(spark, tmp_path):
    points = layout.with_morton(sources.generate_points(spark, 5000))
    clustered = layout.cluster_by_morton(points, 4)
    sinks.write_clustered(clustered, str(tmp_path / "z"))
    back = spark.read.parquet(str(tmp_path / "z"))
    assert back.count() == 5000
    plan = back.where("morton < 100")._jdf.queryExecution().toString()
    assert "LessThan(morton,100)" in plan
    ranges = sorted(tuple(r) for r in back.groupBy(F.input_file_name()).agg(F.min("morton"), F.max("morton")).select("min(morton)", "max(morton)").collect())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert [r.morton for r in layout.sort_by_morton(points).collect()] == sorted(r.morton for r in points.collect())


def test_filter_needs_no_exchange(spark, sf_dir):
    plan = compact.compact(sources.orders(spark, sf_dir), 30.0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "o_orderdate" not in plan


def test_bench_and_csv(spark, tmp_path):
    assert bench.matrix(spark).count() == 168
    cell_ = bench.run_cell(spark, 1024, 256, "double")
    assert cell_["error"] == 0 and cell_["time_ms"] > 0
    results = spark.createDataFrame([cell_], "size int, block_size int, precision string, time_ms float, error float")
    sinks.write_bench_csv(results, str(tmp_path / "new" / "bench"))
    assert spark.read.option("header", True).csv(str(tmp_path / "new" / "bench")).columns == list(sinks.BENCH_COLUMNS)


def test_cli_and_listing(spark, capsys):
    found = cli.run_demo(spark, 100, 8, "bin", "partition")
    assert found["plain"].count() == found["chosen"].count() == 32
    assert cli.main(["-n", "50", "-t", "--mode", "bin"]) == 0
    assert "plain:" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["--mode", "other"])
    text = sinks.format_points(found["points"], "all", 3)
    assert text.splitlines()[0] == "all (100 points):" and text.endswith("first 3 of 100 points")
    assert len(sinks.format_summary(compact.equivalence(found["points"], 30.0)).splitlines()) == len(compact.VARIANTS)


def test_sources(spark, sf_dir, tmp_path):
    points = sources.generate_points(spark, 10)
    points.write.parquet(str(tmp_path / "p"))
    assert sources.read_points(spark, str(tmp_path / "p")).count() == 10
    assert sources.grid_shape(10) == (3, 4) and sources.generate_points(spark, -5).count() == 0
    a, b = (sources.generate_points(spark, 50, seed=s).agg(F.sum("temp")).first()[0] for s in (0, 1))
    assert a != b and sources.generate_points(spark, 4, spacing=2.5).agg(F.max("x")).first()[0] == 2.5


def test_stream(spark, sf_dir, tmp_path):
    from quartzgrid.streaming.points import hot_stream

    points = sources.generate_points(spark, 1000)
    points.write.parquet(str(tmp_path / "in"))
    stream = hot_stream(spark.readStream.schema(points.schema).parquet(str(tmp_path / "in")), 30.0)
    query = stream.writeStream.format("memory").queryName("hot_points").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("hot_points").count() == 334
