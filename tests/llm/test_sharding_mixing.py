import math
import zlib
from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from rows import same_rows
from quartzgrid.llm import mixing, oracles, queries, sharding


def check_shards(rows, n):
    places = defaultdict(list)
    for r in rows:
        places[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < n and (r["grown_shard"] == r["shard"] or r["grown_shard"] == n)
    for own in places.values():
        assert sorted(own) == list(range(len(own)))


def test_shards_hold_every_row_once(table, prose):
    df = table([*prose, (None, "x"), (None, None), (5, "same"), (5, "same")])
    out = sharding.shard_records(df, 4, bucket_rows=10)
    rows = out.collect()
    check_shards(rows, 4)
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in df.collect())
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in rows)
    assert len({r["shard"] for r in rows if r["doc_id"] == 5}) == 1
    assert out.columns == [c for c in df.columns if c not in ("size", "shard")] + ["size", "shard", "slot", "grown_shard"]
    again = sharding.shard_records(df, 4, bucket_rows=10).collect()
    assert Counter(map(str, rows)) == Counter(map(str, again))
    # one more shard: the grown shard is the shard that the key then has
    five = {(r["doc_id"], r["text"]): r["shard"] for r in sharding.shard_records(df, 5).collect()}
    assert all(five[r["doc_id"], r["text"]] == r["grown_shard"] for r in rows)


def test_shards_are_shuffled(table):
    rows = sharding.shard_records(table([(i, "t") for i in range(400)], 1), 1, bucket_rows=100).orderBy("slot").collect()
    ids = [r["doc_id"] for r in rows]
    rising = sum(a < b for a, b in zip(ids, ids[1:], strict=False))
    assert ids != sorted(ids) and 140 < rising < 260


def test_hot_key_spreads_over_buckets(table):
    df = table([(None, f"t{i}") for i in range(300)])
    rows = sharding.shard_records(df, 3, bucket_rows=20).collect()
    check_shards(rows, 3)
    assert len({r["shard"] for r in rows}) == 1


def test_empty_and_bad(table, spark):
    assert sharding.shard_records(table([]), 4).collect() == []
    with pytest.raises(ValueError):
        sharding.shard_records(table([]), 0)


def test_written_shards(table, prose, spark, tmp_path):
    out = sharding.shard_records(table(prose), 3)
    sharding.write_shards(out.drop("size"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(prose)
    assert spark.read.parquet(str(tmp_path / "s" / "shard=1")).count() == out.where("shard = 1").count()


def test_query_of_sharding(spark, sf_dir):
    rows = queries.op1_sharding(spark, sf_dir).collect()
    check_shards(rows, 8)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["law"] == "key" for r in rows)


SOURCES = [(i, "w " * (i % 9), "en", s) for i, s in enumerate(["a"] * 120 + ["b"] * 30 + ["c"] * 5 + [None] * 9 + ["Z"] * 2)]


def check_mix(rows, docs):
    want = brute.mix(docs)
    taken, largest = Counter(), Counter()
    for r in rows:
        assert math.isclose(r["target"], want[r["source"]][1], abs_tol=1e-6) and r["source_size"] == want[r["source"]][0]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, (_, target) in want.items():
        assert abs(taken[s] - target) <= 2 + sum(1 for r in rows if r["source"] == s and r["size"] != 0 and 0 < r["taken"] % r["size"])


def test_mix_meets_targets(table):
    df = table(SOURCES)
    rows = mixing.mix_sources(df).collect()
    assert len(rows) == len(SOURCES)
    check_mix(rows, [(d, t, s) for d, t, _, s in SOURCES])
    again = mixing.mix_sources(table(SOURCES, 5)).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in rows) == Counter((r["doc_id"], r["taken"]) for r in again)


def test_mix_of_repeated_rows(table):
    docs = [(1, "w w w", "en", "a")] * 40 + [(None, None, "en", "b"), (3, "", "en", "b"), (4, "w " * 50, "en", "c"), (None, "w", "en", "a")]
    rows = mixing.mix_sources(table(docs)).collect()
    assert len(rows) == len(docs)
    want = brute.mix([(d, t, s) for d, t, _, s in docs])
    for s, (_, target) in want.items():
        assert abs(sum(r["taken"] for r in rows if r["source"] == s) - target) <= 41
    assert mixing.mix_sources(table([])).collect() == []
    assert [r["taken"] for r in mixing.mix_sources(table([(1, None), (2, " ")])).collect()] == [0, 0]


@pytest.mark.parametrize("key", [None, 5])
def test_mix_cuts_one_document_of_a_hot_key(table, key):
    """Most of a source has one key; its texts differ, so one document at most is cut, and whole copies meet the target."""
    docs = [(key, f"t{i} " * 5, "en", "a") for i in range(400)] + [(i, "w " * 10, "en", "b") for i in range(90)] + [(900 + i, "w " * 7, "en", "c") for i in range(80)]
    mix = mixing.mix_sources(table(docs)).withColumn("times", mixing.copies(F.col("size"), F.col("taken")))
    rows = mix.collect()
    assert len(rows) == len(docs)
    for s, (_, target) in brute.mix([(d, t, s) for d, t, _, s in docs]).items():
        own = [r for r in rows if r["source"] == s]
        assert sum(r["taken"] % r["size"] != 0 for r in own) <= 1
        assert abs(sum(r["taken"] for r in own) - target) <= 1
        assert abs(sum(r["times"] * r["size"] for r in own) - target) <= 10


def test_copies(spark):
    df = spark.createDataFrame([(10, 0), (10, 4), (10, 5), (10, 25), (10, 30), (0, 0)], "s long, t long")
    assert [r[0] for r in df.select(mixing.copies(F.col("s"), F.col("t"))).collect()] == [0, 0, 1, 3, 3, 0]


def test_query_of_mixing(spark, sf_dir, duck):
    got = queries.op4_mixing(spark, sf_dir).toPandas()
    assert not same_rows(got, duck.execute(oracles.MIX).df())
