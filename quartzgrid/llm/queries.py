"""The queries opN_<name> over the driver's tables. Each derives its digest columns from its operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, langid, media, mixing, ngram_join, secrets, sharding, substrings, tokens

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``key``: highest seeded hash of doc_id and shard number."""
    out = sharding.shard_records(_table(spark, sf_dir, "documents"), 8)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.add_media(_table(spark, sf_dir, "documents"), keep_media=False)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared language: the lang column; host: the source. Trained on about 8,000 of the labelled documents."""
    docs = _table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.train(docs))
    return out.select("doc_id", "language", "confidence", "accepted", "text_language")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE))
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == secrets.KINDS.index(k))).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(of_kind, secrets.BASE), F.sha2(secrets.spelled(base).cast("binary"), 256).alias("base_sha256"), secrets.spelled(F.col("spans")).alias("spans"))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that the fixed patterns alone decide: those SQL can repeat."""
    return op6_secrets(spark, sf_dir).drop("spans")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that say what was read back, without those that the stored form decides."""
    return op3_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over raw pages: declared by the markup, host and suffix from the address."""
    out = langid.identify_pages(_table(spark, sf_dir, "pages"), langid.train(_table(spark, sf_dir, "documents")))
    return out.select("page_id", "language", "confidence", "accepted", "text_language")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), vocabulary()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", items.alias("items_sha256"), "contaminated")


#: The text of both turns of the extra conversation of op9.
TRICKY = "\\### Assistant: </turn> ok"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text")
    )
    back = chat.read_back(chat.format_chats(rows.unionByName(extra)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed parts: every third turn gets an image, every fifth an audio file of its own length, every seventh a
    document. ``parts_sha256`` is over the typed parts as they are read back from the formatted text."""
    turn = F.coalesce(F.col("turn"), F.lit(0))
    part = lambda kind, tokens: F.array(F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("text"), F.concat(F.lit(f"{kind}/"), turn.cast("string")).alias("ref"), tokens.alias("tokens")))
    text = F.array(F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))
    none = F.array().cast(chat.PART_TYPE)
    of = lambda n, p: F.when(turn % n == 0, p.cast(chat.PART_TYPE)).otherwise(none)
    unset = F.lit(None).cast("long")
    parts = F.concat(of(3, part("image", unset)), text.cast(chat.PART_TYPE), of(5, part("audio", F.length("text").cast("long"))), of(7, part("document", unset)))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", parts.alias("parts"))
    back = chat.read_back(chat.format_chats(rows, parts="parts"))
    said = F.transform(F.flatten("parts"), lambda p: F.concat(p["kind"], F.lit(":"), F.coalesce(p["text"], p["number"].cast("string")), F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "expanded_tokens",
        F.sha2(F.array_join(said, "").cast("binary"), 256).alias("parts_sha256"),
    )


#: Passages of over 50 words, whatever their number of bytes.
PASSAGE_WORDS = 51


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``shares_passage``: another document has a run of 51 words of this one; it changes nothing that is removed."""
    out = substrings.remove_repeats(_table(spark, sf_dir, "documents"), keep_text=False, passage_words=PASSAGE_WORDS)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256", "shares_passage")


def queries() -> dict[str, Query]:
    numbered = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(numbered.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {f.__name__: f for f in (language_of_pages, secrets_base, media_payloads, chat_parts)}
