"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters the records over memory-sized buckets by a seeded hash. Pass two permutes every bucket by
Fisher-Yates (Spark's ``shuffle`` draws the inside-out form) and gives each record its slot.

* Law ``key``: the shard is the highest of the seeded hashes of (key, shard number), so the key and the shard
  count decide it alone, and one more shard takes rows only into itself.
* The permutation is drawn over positions, never over arrays of records: records reach their bucket by one
  exchange, get their position by a sort that can spill, and look up the permuted position. Memory per bucket
  is one array of positions, which ``bucket_rows`` bounds.
* A bucket is chosen from the key and the record's place in its input, so a key that holds a third of all rows
  (a null key included) still spreads over the buckets of its shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, fresh

#: Bytes of records that one task of the exchange gets.
TASK_BYTES = 128 << 20


def _weights(key: Column, seed: int, n: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), key, F.lit(s)) for s in range(n)]


def shard_of(key: Column, n_shards: int, seed: int = 17) -> Column:
    """The shard of a key: the number whose seeded hash is highest (the lowest number on a tie)."""
    w = F.array(*_weights(key, seed, n_shards))
    return (F.array_position(w, F.array_max(w)) - 1).cast("int")


def shard_records(
    df: DataFrame,
    n_shards: int = 8,
    *,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 17,
    bucket_bytes: int = 16 << 20,
    bucket_rows: int = 16_384,
) -> DataFrame:
    """All rows and columns of ``df`` plus ``size``, ``shard``, ``slot`` and ``grown_shard``.

    ``size`` is the UTF-8 length of the text plus 1 (a null text has length 0), ``shard`` is 0 to
    ``n_shards`` - 1, ``slot`` is the place in the shard, gapless from 0, and ``grown_shard`` is the shard
    with one shard more. Input columns that have one of these names are replaced.

    The rows are read once for their number, and once to be stored with their buckets; buckets are counted and rows
    moved from there, so the split of ``df`` into partitions doesn't matter.

    Null keys count as one key. Repeated rows keep a slot each. An empty table gives an empty result. Very long
    texts are moved whole and never held in arrays.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    df = df.drop(*[c for c in df.columns if c.lower() in ("size", "shard", "slot", "grown_shard")])
    sub, spread, pos, perm, base, n, of_shard, of_sub = fresh(df, "_sub", "_spread", "_pos", "_perm", "_base", "_n", "_of_shard", "_of_sub")
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1
    rows, total = df.agg(F.count(F.lit(1)), F.sum(size)).first()
    buckets = max(1, -(-(total or 0) // (bucket_bytes * n_shards)), -(-rows // (bucket_rows * n_shards)))

    w = F.array(*_weights(F.col(key), seed, n_shards + 1))
    first = F.slice(w, 1, n_shards)
    shard = (F.array_position(first, F.array_max(first)) - 1).cast("int")
    grown = F.when(F.element_at(w, n_shards + 1) > F.array_max(first), F.lit(n_shards)).otherwise(shard)
    # The exchange of the records grows with their bytes, whatever the session's number of shuffle partitions is.
    partitions = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // TASK_BYTES))
    scattered = (
        df.withColumn(spread, F.xxhash64(F.lit(~seed), F.col(key), F.monotonically_increasing_id()))
        .withColumns({"size": size, "shard": shard, "grown_shard": grown})
        .withColumn(sub, F.pmod(F.col(spread), F.lit(buckets)).cast("int"))
    )
    scattered = durable(scattered)  # the spread of a row depends on its place, which another read may change

    # One row a bucket: where its slots begin, and the permutation of its positions. The number of partitions and
    # the order in them are fixed, so a task that runs again draws the same permutations.
    counts = scattered.groupBy("shard", sub).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy("shard").orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    drawn = (
        counts.withColumn(base, F.coalesce(F.sum(n).over(before), F.lit(0)))
        .repartition(max(8, rows // 4_000_000), "shard", sub)
        .sortWithinPartitions("shard", sub)
        .withColumn(perm, F.shuffle(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")), F.lit(seed)))
        .select(F.col("shard").alias(of_shard), F.col(sub).alias(of_sub), base, perm)
    )
    placed = scattered.repartition(partitions, "shard", sub).withColumn(pos, F.row_number().over(Window.partitionBy("shard", sub).orderBy(spread)))
    slot = (F.col(base) + F.element_at(F.col(perm), F.col(pos))).cast("long")
    return (
        placed.join(drawn, (F.col("shard") == F.col(of_shard)) & (F.col(sub) == F.col(of_sub)))
        .withColumn("slot", slot)
        .select(*[F.col(f"`{c}`") for c in df.columns], "size", "shard", "slot", "grown_shard")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the result of :func:`shard_records` as one folder a shard, each file in the order of its slots."""
    files = F.floor(F.col("slot") / 262_144)
    sharded.repartition("shard", files).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
