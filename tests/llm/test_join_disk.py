"""What the Jaccard join keeps on disk and moves, and that counting parts of tokens loses nothing."""

import random
from pathlib import Path

import brute
import pytest

from quartzgrid.llm import common, ngram_join
from quartzgrid.llm.common import discard, durable, scratch


def columns_stored(spark):
    paths = [p for p in common._tables.get(spark.sparkContext.applicationId, []) if Path(p.removeprefix("file:")).exists()]
    return [set(spark.read.parquet(p).columns) for p in paths]


def found(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_join(df).collect())


def test_discard(spark):
    with scratch(spark):
        outer = durable(spark.range(2))
        with scratch(spark):
            one, two = durable(spark.range(3)), durable(spark.range(4), keep=True)
            before = len(common._tables[spark.sparkContext.applicationId])
            discard(one, spark.range(5), outer)
            assert len(common._tables[spark.sparkContext.applicationId]) == before - 2
            durable(spark.range(6))
        assert two.count() == 4 and len(common._tables[spark.sparkContext.applicationId]) == before - 2


def test_texts_and_probes_are_gone_when_pairs_are_verified(spark, table, prose, monkeypatch):
    common.clean_up(spark)
    seen = []

    def spied(pairs, sets, percent):
        seen.append(columns_stored(spark))
        return verify(pairs, sets, percent)

    verify = ngram_join._verify
    monkeypatch.setattr(ngram_join, "_verify", spied)
    assert found(table(prose)) == brute.jaccard(prose)
    assert seen
    for stored in seen:
        assert not any({"text", "low", "x"} & c for c in stored) and sum("tokens" in c for c in stored) == 1


def test_copies_of_unlike_texts_are_settled_before_all_tokens_are_counted(spark, table, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(30)]
    docs = [(100 * i + k, t) for i, t in enumerate(texts) for k in range(4)]
    rows = []

    def spied(df, keep=False):
        out = durable(df, keep)
        if out.columns == ["cls", "n", "tokens"]:
            rows.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "durable", spied)
    assert found(table(docs)) == brute.jaccard(docs)
    assert rows == [0]


def test_few_pairs_and_the_classes_asked_for_are_broadcast(spark):
    sets = durable(spark.range(1000).selectExpr("id AS cls", "10L AS n", "sequence(id div 2 * 100, id div 2 * 100 + 9) AS tokens"))
    pairs = durable(spark.createDataFrame([(2, 3), (3, 4)], "a long, b long"))
    out = ngram_join._verify(pairs, sets, 80)
    assert [tuple(r) for r in out.collect()] == [(2, 3)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2


@pytest.mark.parametrize("bits", [3, 8, 14, 64])
def test_parts_of_tokens_that_collide(table, prose, monkeypatch, bits):
    monkeypatch.setattr(ngram_join, "PROBE_BITS", bits)
    assert found(table(prose)) == brute.jaccard(prose)


def test_joins_beyond_the_bound_of_broadcasts(table, prose, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL_ROWS", 0)
    assert found(table(prose)) == brute.jaccard(prose)
