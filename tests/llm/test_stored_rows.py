"""Results when files are split otherwise from one action to the next, as after the loss of an executor."""

import brute
import pytest

import corpus_pipeline
from quartzgrid.llm import decontamination, ngram_join, sharding, substrings
from quartzgrid.llm.common import durable

SPLIT = "spark.sql.leafNodeDefaultParallelism"


@pytest.fixture
def other_splits(spark, monkeypatch):
    """Each durable() is followed by another number of cores to split files by."""
    turns = []

    def switched(df, **options):
        out = durable(df, **options)
        turns.append(out)
        spark.conf.set(SPLIT, 4 if len(turns) % 2 else 6)
        return out

    for module in (ngram_join, substrings, decontamination, corpus_pipeline):
        monkeypatch.setattr(module, "durable", switched)
    spark.conf.set(SPLIT, 6)
    yield turns
    spark.conf.unset(SPLIT)


def test_splits_differ(spark, table, prose, other_splits):
    df = table(prose, 12)
    spark.conf.set(SPLIT, 4)
    few = df.rdd.getNumPartitions()
    spark.conf.set(SPLIT, 6)
    assert spark.read.parquet(*df.inputFiles()).rdd.getNumPartitions() != few


def test_jaccard(table, prose, other_splits):
    got = ngram_join.jaccard_join(table(prose, 12)).collect()
    assert other_splits and sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute.jaccard(prose)


def test_repeats(spark, table, prose, other_splits):
    df = table(prose, 12)
    got = substrings.remove_repeats(df, window=60, gram=16).collect()
    assert other_splits
    spark.conf.unset(SPLIT)
    want = substrings.remove_repeats(durable(df), window=60, gram=16).collect()
    assert any(r["n_removed"] for r in want)
    assert sorted((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in want)


def test_stages(spark, table, prose, tmp_path, other_splits):
    passage = "benchmark passage of thirteen words which must never be found in training data again"
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [*prose, *((2000 + i, f"{passage} number{i}") for i in range(9))]
    df = table(rows, 12)
    single = corpus_pipeline.near_duplicates(spark, df, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in single) == sorted({c for _, _, c in brute.jaccard(rows)})
    clean = corpus_pipeline.decontaminated(spark, df, str(tmp_path)).collect()
    assert other_splits and sorted(r["doc_id"] for r in clean) == sorted(k for k, _ in prose)


def test_shards_come_from_stored_buckets(table, prose):
    df = table(prose, 12)
    assert not set(sharding.shard_records(df, 4).inputFiles()) & set(df.inputFiles())
