"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

An item's windows are its runs of 13 words (a shorter item is one window). A document holds a window only if it
holds all of the window's shingles of three words, so one shingle a window is prefix enough for containment: the
rarest, by counts over all documents. Documents are joined with those shingles alone. A candidate must fit by
position and length, and then its words are compared with the window's, exactly.

The benchmark side is broadcast if it is counted to be small; the documents' words are then read twice (counts, then
candidates) and never shuffled. Beyond that bound texts are stored with row numbers, and the join is shuffled by
shingle, with positions alone: words are fetched afterwards, once a document, for the positions that fit.

Windows are told apart by a 64-bit hash of their words; their words themselves are compared with the document's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, durable, numbered, small

#: All but the code points 00-2F, 3A-60 and 7B-7F, spelled as what they leave of lower-cased text: the regex engine
#: is many times faster on this class than on the negated one.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
WINDOW, SHINGLE = 13, 3
#: Most windows that are broadcast (each is a few hundred bytes).
SMALL_WINDOWS = 200_000


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of the decontamination rule; none of a null text."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _hash(get: list[Column]) -> Column:
    return F.xxhash64(F.lit(len(get)), *get)


def item_windows(items: DataFrame, *, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``item, words``: the windows of every item that has words."""
    w = F.col("_w")
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - window + 1, F.lit(1)))
    return (
        items.select(F.col(item).alias("item"), words(F.col(text)).alias("_w"))
        .where(F.size("_w") > 0)
        .select("item", F.explode(F.transform(starts, lambda s: F.slice(w, s, window))).alias("words"))
    )


def _shingles(windows: DataFrame) -> DataFrame:
    """``window, words, size, offset, shingle``: each window's shingles of three words, or of all if it has fewer."""
    w = F.col("words")
    k = F.least(F.size(w), F.lit(SHINGLE))
    offsets = F.sequence(F.lit(0), F.size(w) - k)
    at = windows.select("window", "words", F.size(w).alias("size"), k.alias("k"), F.explode(offsets).alias("offset"))
    shingle = F.lit(None).cast("long")
    for n in range(1, SHINGLE + 1):
        shingle = F.when(F.col("k") == n, _hash([F.get(w, F.col("offset") + i) for i in range(n)])).otherwise(shingle)
    return at.withColumn("shingle", shingle)


def _positions(docs: DataFrame, ks: list[int]) -> DataFrame:
    """``row, words, pos, shingle``: every shingle of every document."""
    one = lambda k, i: _hash([F.get("words", i + j) for j in range(k)])
    starts = F.when(F.size("words") >= min(ks), F.sequence(F.lit(0), F.size("words") - min(ks)))  # not a filter, which would split texts twice
    at = docs.select("row", "words", F.explode(starts).alias("pos"))
    if len(ks) == 1:
        return at.withColumn("shingle", one(ks[0], F.col("pos")))
    many = F.array_compact(F.array(*[F.when(F.col("pos") + k <= F.size("words"), one(k, F.col("pos"))) for k in ks]))
    return at.select("*", F.explode(many).alias("shingle"))


HITS = ("row", "key", "n_words", "start", "end", "window")


def _read_hits(docs: DataFrame, ks: list[int], prefix: DataFrame) -> DataFrame:
    """:data:`HITS` by a broadcast of ``prefix``, and one row without a window for every document: one pass, so that
    row numbers are drawn once."""
    one = lambda k: F.when(F.col("pos") + k <= F.size("words"), _hash([F.get("words", F.col("pos") + i) for i in range(k)]))
    at = docs.select("row", "key", "words", F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("pos"))
    every = at.select("*", F.explode_outer(F.when(F.col("pos") >= 0, F.array_compact(F.array(*map(one, ks))))).alias("shingle")) if len(ks) > 1 else at.withColumn("shingle", F.when(F.col("pos") >= 0, one(ks[0])))
    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.col("size") <= F.size("words"))
    same = F.slice("words", F.when(fits, start + 1).otherwise(1), F.col("size")) == F.col("window_words")
    return (
        every.join(F.broadcast(prefix), (F.col("shingle") == F.col("s")) & fits & same, "left")
        .where("pos < 0 or window is not null")
        .select("row", "key", F.size("words").cast("long").alias("n_words"), start.alias("start"), (start + F.col("size")).alias("end"), "window")
    )


def _shuffled_hits(docs: DataFrame, ks: list[int], prefix: DataFrame) -> DataFrame:
    """:data:`HITS` for a benchmark of any size. Positions go to the shingles' partitions without words; the words of
    a document are fetched once, for its positions that fit. ``docs`` must be stored."""
    start = F.col("pos") - F.col("offset")
    bare = _positions(docs, ks).select("row", "pos", F.size("words").alias("n_words"), "shingle")
    found = bare.join(prefix.select("s", "offset", "size", "window"), (F.col("shingle") == F.col("s")) & (start >= 0) & (start + F.col("size") <= F.col("n_words")))
    found = durable(found.select("row", F.struct(start.alias("start"), "size", "window").alias("x")).groupBy("row").agg(F.collect_list("x").alias("x")))
    read = docs.join(found, "row").select("row", "key", "words", F.explode("x").alias("x")).select("row", "key", "words", "x.*")
    read = read.join(prefix.select(F.col("window").alias("w"), "window_words"), F.col("window") == F.col("w"))
    read = read.where(F.slice("words", F.col("start") + 1, F.col("size")) == F.col("window_words"))
    n_words = F.size("words").cast("long").alias("n_words")
    hits = read.select("row", "key", n_words, "start", (F.col("start") + F.col("size")).alias("end"), "window")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("end", "int"), ("window", "long"))]
    return hits.unionByName(docs.select("row", "key", n_words, *none))


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    row: str | None = None,
    window: int = WINDOW,
) -> DataFrame:
    """One row a document: the key (as ``key``), ``n_words``, ``spans`` (hit runs of words, as struct<start, end>),
    ``n_hit``, ``items`` (ids as strings, sorted as strings), ``n_items`` and ``contaminated``.

    A word is hit if it lies inside any occurrence of a window; a document is contaminated if it has hit words and
    they are a twentieth of its words or more. ``row`` of the result tells rows of equal key apart; to pick rows of
    ``docs`` by it, store ``docs`` with unique numbers and give their column as ``row``.

    Columns of either side may have any names. Null and empty texts have no words. Items without words have no windows. Equal windows of several items count
    for each item. Repeated rows are judged each; other columns are ignored; empty tables give empty results, or no
    hits.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    source = docs
    docs = docs.select(number.alias("row"), F.col(key).alias("key"), words(F.col(text)).alias("words"))
    by_item = item_windows(items, item=item, text=item_text, window=window)
    ids = durable(by_item.select("words", F.col("item").cast("string").alias("item")).distinct().withColumn("window", F.xxhash64("words")))
    windows = ids.select("window", "words").distinct()
    shingles = durable(_shingles(windows))
    ks = sorted(r[0] for r in shingles.select(F.least("size", F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]

    # Rarity over all documents. A window with a shingle that no document has occurs nowhere.
    wanted = small(durable(shingles.select(F.col("shingle").alias("s")).distinct()), SMALL_WINDOWS * 2)
    found = _positions(docs, ks).select("shingle").join(wanted, F.col("shingle") == F.col("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    rated = shingles.join(found, F.col("shingle") == F.col("s"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    prefix = rated.groupBy("window", "words", "size").agg(F.min(F.struct("n", "shingle", "offset")).alias("x"))
    prefix = prefix.where("x.n > 0").select("window", F.col("words").alias("window_words"), "size", F.col("x.shingle").alias("s"), F.col("x.offset").alias("offset"))
    prefix = durable(prefix)
    few = prefix.limit(SMALL_WINDOWS + 1).count() <= SMALL_WINDOWS

    if few:
        hits = durable(_read_hits(docs, ks, prefix))
    else:
        if row is None:
            stored = numbered(source, None, key=F.col(key), text=F.col(text))
            docs = stored.select("row", "key", words(F.col("text")).alias("words"))
        hits = durable(_shuffled_hits(docs, ks, prefix))
    real = F.col("window").isNotNull()
    per_doc = hits.groupBy("row", "key").agg(F.max("n_words").alias("n_words"), F.sort_array(F.collect_set(F.when(real, F.struct("start", "end")))).alias("runs"))
    joined = hits.where(real).select("row", "window").distinct().join(small(ids.select("window", "item"), SMALL_WINDOWS), "window")
    named = joined.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    # Runs by start: a run adds what reaches beyond the furthest end so far.
    covered = F.aggregate(
        "runs",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, r: F.struct(F.greatest(a["end"], r["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(a["end"], r["start"]))).cast("long").alias("n")),
    )
    out = per_doc.withColumn("n_hit", covered["n"]).join(named, "row", "left")
    out = out.withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select(
        F.col("key").alias(key),
        "n_words",
        F.col("runs").alias("spans"),
        "n_hit",
        "items",
        F.size("items").cast("long").alias("n_items"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "row",
    )
