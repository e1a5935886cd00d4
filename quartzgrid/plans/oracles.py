"""DuckDB SQL for every query of :mod:`.queries`."""

from __future__ import annotations

#: Fixed values of the benchmark and the names of the variants, written out apart from the code that they judge.
VARIANTS = ("cpu", "library", "naive", "shared", "warp", "bitmask", "bin_atomic", "bin_partition")
SIZES = (1024, 2048, 4096, 8192, 16384, 32768, 65536, 131072, 262144, 524288, 1048576, 2097152, 4194304, 8388608)
BLOCK_SIZES = (32, 64, 128, 256, 512, 1024)
PRECISIONS = ("float", "double")

_SOURCES = {
    "orders": """SELECT o_orderkey AS id, o_custkey AS x, o_orderkey AS y, (o_custkey % 11 - 5)::FLOAT AS vx, (o_orderkey % 11 - 5)::FLOAT AS vy,
        (o_totalprice / 10000)::FLOAT AS temp FROM orders""",
    "events": """SELECT event_id AS id, event_id % 4096 AS x, user_id AS y, (event_id % 11 - 5)::FLOAT AS vx, (user_id % 11 - 5)::FLOAT AS vy,
        value::FLOAT AS temp FROM events""",
    "lineitem": """SELECT l_orderkey AS id, l_partkey AS x, l_suppkey AS y, (l_partkey % 11 - 5)::FLOAT AS vx, (l_suppkey % 11 - 5)::FLOAT AS vy,
        l_quantity::FLOAT AS temp FROM lineitem""",
}
_STEPS = ((8, 16711935), (4, 252645135), (2, 858993459), (1, 1431655765))


def _spread(table: str, column: str, tag: str) -> str:
    """CTEs that add tag0..tag4: the value after each spreading step."""
    out = [f"{tag}_0 AS (SELECT *, {column} & 4294967295 AS {tag}0 FROM {table})"]
    for i, (shift, mask) in enumerate(_STEPS):
        out.append(f"{tag}_{i + 1} AS (SELECT *, ({tag}{i} | ({tag}{i} << {shift})) & {mask} AS {tag}{i + 1} FROM {tag}_{i})")
    return ", ".join(out)


def _points(source: str) -> str:
    return f"WITH source AS ({_SOURCES[source]}), {_spread('source', 'x', 'sx')}, {_spread('sx_4', 'y', 'sy')}, points AS (SELECT *, sx4 | (sy4 << 1) AS morton FROM sy_4)"


def _hot(threshold: float, kind: str = "FLOAT") -> str:
    return f"(NOT isnan(temp) AND temp > {threshold}::{kind})"


_ORDERS, _EVENTS, _LINEITEM = map(_points, ("orders", "events", "lineitem"))
_PLACED = f"{_ORDERS}, placed AS (SELECT *, row_number() OVER (ORDER BY morton, id) - 1 AS pos FROM points)"
_FIRST = "SELECT row_number() OVER (ORDER BY morton, id) AS rn, * FROM points WHERE NOT isnan(temp) AND temp > 25::FLOAT"


def _counts(width: int, name: str) -> str:
    return f"{_PLACED} SELECT pos // {width} AS {name}, count(*) AS size, count(*) FILTER ({_hot(30)}) AS hot_count FROM placed GROUP BY 1"


def _ranks(width: int, name: str) -> str:
    return f"{_PLACED} SELECT id, pos // {width} AS {name}, row_number() OVER (PARTITION BY pos // {width} ORDER BY pos) - 1 AS rank FROM placed WHERE {_hot(30)}"


def _summary(points: str) -> str:
    return f"""{points} SELECT morton & 255 AS bin, count(*) AS size, count(*) FILTER ({_hot(30)}) AS hot_count,
        CASE WHEN count(*) <= 32 THEN 'bitmask' WHEN count(*) <= 1024 THEN 'warp' ELSE 'shared' END AS kernel FROM points GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    trace = " UNION ALL ".join(
        f"SELECT id, {i} AS step, '{label}' AS label, lpad(bin(sx{i}), 32, '0') AS bits, sx{i} AS value FROM points" for i, label in enumerate(["original", *[f"shift {s}" for s, _ in _STEPS]])
    )
    cells = " CROSS JOIN ".join([
        f"(SELECT unnest([{', '.join(map(str, SIZES))}])::INTEGER AS size)", f"(SELECT unnest([{', '.join(map(str, BLOCK_SIZES))}])::INTEGER AS block_size)",
        f"(SELECT unnest([{', '.join(repr(p) for p in PRECISIONS)}]) AS precision)",
    ])
    draw = lambda k: f"((((id * 3 + {k}) * 1103515245 + 12345) & 2147483647) / 2147483648.0::DOUBLE)"
    grid = lambda n, w: f"""SELECT id, (id % {w})::FLOAT AS x, (id // {w})::FLOAT AS y, (10 + 30 * {draw(2)})::FLOAT AS temp FROM (SELECT unnest(range({n})) AS id)"""
    counts = " UNION ALL ".join(f"SELECT {n}::INTEGER AS size, count(*) FILTER ({_hot(25)}) AS f, count(*) FILTER ({_hot(25, 'DOUBLE')}) AS d FROM ({grid(n, w)})" for n, w in ((1024, 32), (4096, 64)))
    out = {
        "bench_counts": f"""SELECT size, block_size, precision, (size + block_size - 1) // block_size::BIGINT AS blocks, CASE precision WHEN 'double' THEN d ELSE f END AS hot_count,
            CASE precision WHEN 'double' THEN abs(d - f) / f::DOUBLE ELSE 0::DOUBLE END AS error
            FROM ({counts}) CROSS JOIN (SELECT unnest([{', '.join(map(str, BLOCK_SIZES))}])::INTEGER AS block_size) CROSS JOIN (SELECT unnest([{', '.join(repr(p) for p in PRECISIONS)}]) AS precision)""",
        "grid_positions": f"""WITH source AS (SELECT id, x::BIGINT AS x, y::BIGINT AS y FROM ({grid(16384, 128)})), {_spread('source', 'x', 'sx')}, {_spread('sx_4', 'y', 'sy')}
            SELECT id, sx4 | (sy4 << 1) AS morton, row_number() OVER (ORDER BY sx4 | (sy4 << 1), id) - 1 AS pos FROM sy_4""",
        "morton_of_floats": f"""WITH raw AS (SELECT id, x * 0.75::DOUBLE - 100 AS fx, CASE WHEN id % 97 = 0 THEN 1e12::DOUBLE ELSE y / 4::DOUBLE END AS fy FROM ({_SOURCES['orders']})),
            source AS (SELECT *, CASE WHEN abs(fx) < 2147483648 THEN trunc(fx)::BIGINT & 4294967295 END AS x, CASE WHEN abs(fy) < 2147483648 THEN trunc(fy)::BIGINT & 4294967295 END AS y FROM raw),
            {_spread('source', 'x', 'sx')}, {_spread('sx_4', 'y', 'sy')} SELECT id, fx AS x, fy AS y, coalesce(sx4 | (sy4 << 1), -1) AS morton FROM sy_4""",
        "block_counts_64": _counts(64, "block"),
        "block_counts_1024": _counts(1024, "block"),
        "morton_encode": f"{_ORDERS} SELECT id, x, y, morton FROM points",
        "binary_format": f"{_ORDERS} SELECT id, lpad(bin(morton), 32, '0') AS bits FROM points",
        "bit_trace": f"{_ORDERS} {trace}",
        "compact_float": f"{_ORDERS} SELECT id, x, y, vx, vy, temp FROM points WHERE {_hot(30)}",
        "compact_double": f"{_ORDERS} SELECT id, x::DOUBLE AS x, y::DOUBLE AS y, temp::DOUBLE AS temp FROM points WHERE {_hot(25, 'DOUBLE')}",
        "narrowed": f"{_ORDERS} SELECT id, x::FLOAT AS x, y::FLOAT AS y, vx, vy, temp FROM points",
        "compact_lineitem": f"{_LINEITEM} SELECT id, x, y, temp, morton FROM points WHERE {_hot(30)}",
        "compact_count": f"{_LINEITEM} SELECT count(*) AS size, count(*) FILTER ({_hot(30)}) AS hot_count FROM points",
        "bin_histogram": f"{_LINEITEM} SELECT morton & 255 AS bin, count(*) AS size FROM points GROUP BY 1",
        "bin_histogram_dense": f"{_LINEITEM} SELECT b.bin, count(p.morton) AS size FROM (SELECT unnest(range(4096)) AS bin) b LEFT JOIN points p ON p.morton & 4095 = b.bin GROUP BY 1",
        "bin_offsets": f"""{_LINEITEM}, sizes AS (SELECT b.bin, count(p.morton) AS size FROM (SELECT unnest(range(257)) AS bin) b LEFT JOIN points p ON p.morton & 255 = b.bin GROUP BY 1)
            SELECT bin, size, coalesce(sum(size) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM sizes""",
        "bin_scatter_slots": f"{_ORDERS} SELECT id, morton & 255 AS bin, row_number() OVER (ORDER BY morton & 255, morton, id) - 1 AS slot FROM points",
        "bin_partition_compact": f"""{_ORDERS}, sized AS (SELECT *, count(*) OVER (PARTITION BY morton & 255) AS size FROM points)
            SELECT id, morton & 255 AS bin, row_number() OVER (ORDER BY morton & 255, morton, id) - 1 AS out_slot,
                   CASE WHEN size <= 32 THEN 'bitmask' WHEN size <= 1024 THEN 'warp' ELSE 'shared' END AS kernel FROM sized WHERE {_hot(30)}""",
        "bin_summary_auto_kernel": _summary(_EVENTS),
        "flagship": _summary(_LINEITEM),
        "bin_output_offsets": f"""{_LINEITEM}, sums AS (SELECT morton & 255 AS bin, count(*) FILTER ({_hot(30)}) AS hot_count FROM points GROUP BY 1)
            SELECT bin, hot_count, coalesce(sum(hot_count) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS out_offset FROM sums""",
        "warp_ballots": f"""{_PLACED}, masks AS (SELECT pos // 32 AS warp, sum(CASE WHEN {_hot(30)} THEN 1::BIGINT << (pos % 32)::INTEGER ELSE 0 END)::BIGINT AS ballot FROM placed GROUP BY 1)
            SELECT warp, ballot, bit_count(ballot)::BIGINT AS votes FROM masks""",
        "surface_shape": "SELECT 64::BIGINT AS width, (count(*) + 63) // 64 AS height FROM orders",
        "one_bin": f"{_ORDERS} SELECT id, morton & 255 AS bin, temp FROM points WHERE morton & 255 = 42 AND {_hot(30)}",
        "morton_sort": f"{_PLACED} SELECT id, morton, pos FROM placed",
        "morton_sort_topn": f"{_PLACED} SELECT pos + 1 AS rn, id, x, y, vx, vy, temp, morton FROM placed WHERE pos < 10",
        "morton_cluster": f"{_ORDERS} SELECT id, morton FROM points",
        "surface_pack_w64": f"""{_ORDERS}, kept AS (SELECT *, row_number() OVER (ORDER BY morton, id) - 1 AS pos FROM points WHERE {_hot(30)})
            SELECT pos % 64 AS sx, pos // 64 AS sy, vx AS c0, vy AS c1, temp AS c2, 1::FLOAT AS c3 FROM kept""",
        "grid_generate_n1000": f"""SELECT id, (id % 31)::FLOAT AS x, (id // 31)::FLOAT AS y, (-5 + 10 * {draw(0)})::FLOAT AS vx, (-5 + 10 * {draw(1)})::FLOAT AS vy,
            (10 + 30 * {draw(2)})::FLOAT AS temp FROM (SELECT unnest(range(1000)) AS id)""",
        "positional_compare": f"""{_ORDERS}, kept AS ({_FIRST}) SELECT rn, id AS a_id, morton AS a_morton, temp AS a_temp, id AS b_id, morton AS b_morton, temp AS b_temp, true AS same
            FROM kept WHERE rn <= 5""",
        "variant_equivalence": f"{_EVENTS} SELECT unnest([{', '.join(repr(v) for v in VARIANTS)}]) AS variant, count(*) FILTER ({_hot(30)}) AS hot_count, 0::DOUBLE AS error FROM points",
        "bench_matrix": f"SELECT * FROM {cells}",
        "multi_threshold": f"""{_LINEITEM} SELECT 25::DOUBLE AS threshold, count(*) FILTER ({_hot(25)}) AS hot_count FROM points
            UNION ALL SELECT 30::DOUBLE, count(*) FILTER ({_hot(30)}) FROM points""",
        "block_counts_256": _counts(256, "block"),
        "warp_counts_32": _counts(32, "warp"),
        "block_rank": _ranks(256, "block"),
        "warp_rank": _ranks(32, "warp"),
    }
    out |= {f"bin_id_k{k}": f"{_ORDERS} SELECT id, morton & {(1 << k) - 1} AS bin FROM points" for k in (4, 8, 12)}
    out |= {f"compact_{v}": f"{_EVENTS} SELECT id, x, y, temp, morton FROM points WHERE {_hot(30)}" for v in VARIANTS}
    return out
