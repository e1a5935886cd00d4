"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Every source has a word budget, its target. A source that is larger than its budget keeps the documents whose
seeded hash lies under a threshold; one that is smaller repeats all of its documents and takes the threshold
for the rest. The threshold is found without sorting documents: words are summed by source and by the leading
12 bits of the hash, the bucket in which the budget ends is refined by the next 12 bits, and what is left by
the whole hash. A document that the budget cuts takes a part of its words; documents of equal hash (rows of equal
key and text) share that part evenly. The text is part of the hash, so different documents without a key, or of one
key, are cut apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, fresh, small

HASH_BITS, STEP_BITS = 60, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_hash(key: Column, text: Column, seed: int) -> Column:
    """60 bits of the MD5 digest of the seed, the key and the text, in plain SQL; a null key counts as one key, and a
    null text as an empty one."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """``source, source_size`` (one row a source) plus ``target``: shares of the sum of all sizes by weight.

    Sources take the weights in turn, by code point with null last. No target is above ``max_repeat`` times its
    source's size; what is above goes to the others by weight, again and again. That end state has one water
    level: a source gets min(its cap, level x weight), and the level follows from running sums over the sources
    by cap / weight. One row a source stands in one window; sources are few next to documents.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("_w", w).withColumn("_cap", (F.col("source_size") * max_repeat).cast("double"))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    rows = rows.withColumns({
        "_caps": F.coalesce(F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_ws": F.coalesce(F.sum("_w").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_all_w": F.sum("_w").over(every),
        "_all": F.sum("source_size").over(every).cast("double"),
    })
    level = (F.col("_all") - F.col("_caps")) / (F.col("_all_w") - F.col("_ws"))
    rows = rows.withColumn("_level", F.when(level * F.col("_w") <= F.col("_cap"), level))
    return rows.select("source", "source_size", F.least("_cap", F.max("_level").over(every) * F.col("_w")).alias("target"))


def _thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source: ``_full`` repeats of everything, then every hash under ``_cut``, and the share ``_part``
    / ``_group`` of the documents at ``_cut``."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    at = targets.withColumn("_full", whole).withColumn("_left", F.floor(F.col("target") - F.col("_full") * F.col("source_size")).cast("long"))
    at = at.withColumn("_at", F.lit(0).cast("long"))
    done = 0
    for bits in (STEP_BITS, STEP_BITS, HASH_BITS - 2 * STEP_BITS):
        inside = sized.select(F.col("source").alias("_s"), F.col("_h"), F.col("size"), F.shiftright("_h", HASH_BITS - done).alias("_p"))
        inside = inside.join(small_by_source(at.select("source", F.col("_at").alias("_q"))), F.col("_s").eqNullSafe(F.col("source")) & (F.col("_p") == F.col("_q")))
        done += bits
        sums = inside.groupBy(F.col("_s"), F.shiftright("_h", HASH_BITS - done).alias("_b")).agg(F.sum("size").alias("_sum"))
        run = sums.withColumn("_run", F.sum("_sum").over(Window.partitionBy("_s").orderBy("_b")))
        at = (
            run.join(small_by_source(at.select("source", "source_size", "target", "_full", "_left")), F.col("_s").eqNullSafe(F.col("source")))
            .where("_run >= _left")
            .groupBy("_s")
            .agg(F.min_by(F.struct("source_size", "target", "_full", (F.col("_left") - F.col("_run") + F.col("_sum")).alias("_left"), F.col("_b").alias("_at"), "_sum"), "_b").alias("_x"))
            .select(F.col("_s").alias("source"), "_x.*")
        )
        at = durable(at)
    return at.select("source", "source_size", "target", "_full", F.col("_at").alias("_cut"), F.col("_left").alias("_part"), F.col("_sum").alias("_group"))


def small_by_source(df: DataFrame, most: int = 50_000) -> DataFrame:
    """A table of one row a source, broadcast if it is counted to be small. Beyond that the join is shuffled,
    and adaptive execution splits a hot source."""
    return small(df, most)


def mix_sources(
    df: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    max_repeat: int = 3,
    seed: int = 11,
) -> DataFrame:
    """All rows and columns of ``df`` plus ``size``, ``source_size``, ``target`` and ``taken``.

    ``size`` is the number of words of the text (null: 0), ``target`` the budget of the row's source, ``taken``
    the words that the mix takes from this row, repeats counted: at most ``max_repeat`` x ``size``. Reruns agree.
    Input columns that have one of these names are replaced.

    A null source is a source of its own and comes last; a null key is one key, whose texts are told apart. Sources
    without words get the target 0. Rows of equal key and text share one hash: all of them, none, or an even part of
    each, in whole words, is taken. An empty table gives an empty result.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in ("size", "source_size", "target", "taken")])
    h, of, found_at = fresh(df, "_h", "_of", "_found_at")
    measured = {"size": word_count(F.col(text)), h: mix_hash(F.col(key), F.col(text), seed)}
    sized = durable(df.select(F.col(source).alias("source"), measured["size"].alias("size"), measured[h].alias("_h")))
    targets = durable(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat))
    cuts = _thresholds(sized, targets)
    found = small_by_source(cuts.select(F.col("source").alias(of), F.struct(*[c for c in cuts.columns if c != "source"]).alias(found_at)))
    at = F.col(found_at)
    part = F.floor(F.col("size") * at["_part"] / at["_group"])
    extra = F.when(F.col(h) < at["_cut"], F.col("size")).when((F.col(h) == at["_cut"]) & (at["_group"] > 0), part).otherwise(0)
    return (
        df.withColumns(measured)
        .join(found, F.col(source).eqNullSafe(F.col(of)), "left")
        .withColumn("taken", (at["_full"] * F.col("size") + extra).cast("long"))
        .select(*[F.col(f"`{c}`") for c in df.columns], "size", at["source_size"].alias("source_size"), at["target"].alias("target"), "taken")
    )


def copies(size: Column, taken: Column) -> Column:
    """How many whole copies a row of the mix stands for; the document that the budget cuts counts from half on."""
    return F.when(size > 0, F.floor((taken + size / 2) / size)).otherwise(0).cast("int")
