from collections import Counter
from pathlib import Path

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quartzgrid.llm import queries
from quartzgrid.llm.common import clean_up, durable, fresh, shared_folder


def test_names():
    own = queries.queries()
    assert [k.split("_")[0] for k in own] == [*(f"op{n}" for n in range(1, 11)), "language", "secrets", "media", "chat"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_fresh_names(spark):
    assert fresh(spark.range(1).withColumn("_H", F.lit(1)), "_h", "x") == ["_h_", "x"]


def test_durable_tables_can_be_removed(spark):
    df = durable(spark.range(5))
    (path,) = {str(f).rsplit("/", 1)[0].removeprefix("file://") for f in df.inputFiles()}
    assert df.count() == 5 and Path(path).exists()
    clean_up(spark)
    assert not Path(path).exists()


def test_shared_folder_must_be_set_on_a_cluster(spark, monkeypatch):
    class Far:
        master = "spark://host"

        def getConf(self):
            return self

        def get(self, key):
            return None

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda k, d: d)})()
        sparkContext = Far()

    with pytest.raises(ValueError):
        shared_folder(Session())


def test_stages(spark, table, tmp_path):
    """Each stage on a small table, judged on its own input by plain versions."""
    sentence = "the and of with that this from have not are but "
    docs = [(i, f"{sentence * 3} number{i} {'more words ' + str(i) + ' '}{sentence * (i % 4)}" + " ".join(f"u{i}x{j}" for j in range(40)), "en", "ab"[i % 2]) for i in range(30)]
    docs += [(100 + i, docs[i][1], "en", "b") for i in range(4)] + [(200, "12 34 56", "en", "a"), (201, None, "en", None), (202, "", None, "c")]
    passage = "benchmark passage of thirteen words which must never be found in training data again"
    docs += [(300, f"{passage} the and of", "en", "a"), (None, sentence * 9 + "without a name", "en", "b")]
    df = table(docs).select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / str(i)))
        before, now = now, spark.read.parquet(str(tmp_path / str(i)))
        seen.append([(r["doc_id"], r["text"], r["source"]) for r in now.collect()])
        if name != "sharding":
            assert now.columns == before.columns
    language, single, clean, mixed, sharded = seen
    assert {d for d, _, _ in language} == {d for d, *_ in docs} - {200, 201, 202}
    want = brute.jaccard([(d if d is not None else 10**6, t) for d, t, _ in language])
    assert sorted(10**6 if d is None else d for d, _, _ in single) == sorted({c for _, _, c in want})
    assert {d for d, _, _ in clean} == {d for d, _, _ in single} - {300}
    times = Counter(mixed)
    assert set(times) <= set(clean) and max(times.values()) <= 3
    for source, (_, target) in brute.mix([(d, t, s) for d, t, s in clean]).items():
        words = sum(len(brute.WORDS.findall(t)) for _, t, s in mixed if s == source)
        assert abs(words - target) <= max(len(brute.WORDS.findall(t)) for _, t, s in clean if s == source)
    assert Counter(sharded) == times
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == times


def test_stages_of_an_empty_table(spark, table, tmp_path):
    table([]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
