"""Tables that a result does not read are removed; those that it reads stay."""

from pathlib import Path

import corpus_pipeline
from quartzgrid.llm import common, ngram_join
from quartzgrid.llm.common import durable, scratch


def tables(spark):
    return {p for p in common._tables.get(spark.sparkContext.applicationId, []) if Path(p.removeprefix("file:")).exists()}


def test_blocks(spark):
    before, kept = tables(spark), set(common._kept)
    with scratch(spark):
        durable(spark.range(3))
        with scratch(spark):
            inner, lost = durable(spark.range(4), keep=True), durable(spark.range(5))
            assert lost.count() == 5 and len(tables(spark) - before) == 3
        assert len(tables(spark) - before) == 2
        out = durable(inner.selectExpr("id + 1 AS id"), keep=True)
    assert len(tables(spark) - before) == 1 and out.count() == 4 and common._kept == kept


def test_failure_removes_tables(spark):
    before = tables(spark)
    try:
        with scratch(spark):
            durable(spark.range(3), keep=False)
            raise ValueError
    except ValueError:
        pass
    assert tables(spark) == before


def test_results_outlive_their_blocks(spark, table, prose, tmp_path, sf_dir):
    docs, before = table(prose), tables(spark)
    found = ngram_join.jaccard_join(docs)
    assert len(tables(spark) - before) == 3
    assert found.count() == len(prose) and sorted(map(str, found.collect())) == sorted(map(str, found.collect()))
    before = tables(spark)
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert len(tables(spark) - before) == 2 and kept.columns == docs.columns
    clean = corpus_pipeline.decontaminated(spark, kept, sf_dir)
    assert len(tables(spark) - before) == 4 and 0 < clean.count() <= kept.count() < len(prose)
