"""The shard of a key against a plain version, and the last join of the Jaccard join where nothing is broadcast."""

import struct

import brute
import pytest
import xxhash

from quartzgrid.llm import ngram_join, sharding


def plain_shard(key, n, seed=17):
    """The shard number of the highest 64-bit hash of seed, key and number, one after the other; a null is passed over."""
    weights = []
    for s in range(n):
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
        h = h if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), h)
        h = xxhash.xxh64_intdigest(struct.pack("<i", s), h)
        weights.append(h - 2**64 if h >= 2**63 else h)
    return weights.index(max(weights))


@pytest.mark.parametrize("n", [1, 8])
def test_shards_by_the_law(table, n):
    keys = [None, 0, -1, 2**63 - 1, -(2**63), *range(1, 200)]
    for r in sharding.shard_records(table([(k, "text") for k in keys] + [(None, None)]), n).collect():
        assert (r["shard"], r["grown_shard"]) == (plain_shard(r["doc_id"], n), plain_shard(r["doc_id"], n + 1))


def test_jaccard_without_broadcasts(table, prose, monkeypatch, spark):
    monkeypatch.setattr(ngram_join, "SMALL_ROWS", 0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ngram_join.jaccard_join(table(prose))
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == brute.jaccard(prose) and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
