"""From raw documents to training shards, in five stages; each stage's result is written and read again.

language: documents in no known language go. near_duplicates: one document of each component stays. decontamination:
documents that hold benchmark passages go. mixing: documents are left out or repeated so that sources meet their
targets. sharding: every document gets its shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzgrid.llm import decontamination, langid, mixing, ngram_join, sharding
from quartzgrid.llm.common import durable, fresh, scratch, small

#: Row numbers that are broadcast to pick rows, by count; above, the rows are joined by shuffle.
SMALL_ROWS = 2_000_000


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents stored with a number each, and the name of its column: the operator and :func:`_pick` read the
    same numbers, however files are split."""
    (own,) = fresh(docs, "_row")
    return durable(docs.withColumn(own, F.monotonically_increasing_id()), keep=True), own


def _pick(docs: DataFrame, own: str, rows: DataFrame, how: str) -> DataFrame:
    """The documents of :func:`_numbered` that are, or are not, among the row numbers that an operator reported."""
    (theirs,) = fresh(docs, "_chosen")
    chosen = small(durable(rows.select(F.col("row").alias(theirs)), keep=True), SMALL_ROWS)
    return docs.join(chosen, F.col(own) == F.col(theirs), how).drop(own)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(docs, langid.train(docs))
    return found.where("accepted").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id stays (of equal ones the first row; without doc_id last)."""
    with scratch(spark):
        stored, own = _numbered(docs)
        found = ngram_join.jaccard_join(stored, row=own)
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
        return _pick(stored, own, found.groupBy("component").agg(first.alias("x")).select("x.row"), "left_semi")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    with scratch(spark):
        stored, own = _numbered(docs)
        return _pick(stored, own, decontamination.decontaminate(stored, benchmark, row=own).where("contaminated"), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; the one that the budget cuts is taken whole from half on."""
    mix = mixing.mix_sources(docs)
    times = mixing.copies(F.col("size"), F.col("taken"))
    (copy,) = fresh(mix, "_copy")
    return mix.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), times)).alias(copy)).select(docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_records(docs, 8)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Language identification cannot be expressed in SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = durable(docs)
    return docs
