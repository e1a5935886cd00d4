r"""Chat formatting of typed content parts, with DataFrame functions only.

A visitor walks the parts of every turn in order: text is escaped, and an image, audio or document part becomes
a placeholder ``<part:kind:number>``, its reference recorded as an attachment with its expanded token count.

The template of a turn is ``<turn>role: content</turn>`` and a line feed. Roles and texts are escaped so that none
of the template's own characters is left in them: ``\`` becomes ``\b``, ``<`` becomes ``\l`` and, in roles, ``:``
becomes ``\c``. As every backslash then starts a pair, replacing the pairs gives the text back exactly, and the
markers can be found by a plain search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"
#: Tokens that one attachment of a kind expands to if the part itself doesn't say.
PART_TOKENS = {"image": 256, "audio": 128, "document": 512}
PART_TYPE = "array<struct<kind:string,text:string,ref:string,tokens:bigint>>"


def escape(text: Column, role: bool = False) -> Column:
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(text, F.lit(":"), F.lit("\\c")) if role else text


def unescape(text: Column, role: bool = False) -> Column:
    text = F.replace(text, F.lit("\\c"), F.lit(":")) if role else text
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _tokens(part: Column) -> Column:
    by_kind = F.lit(0).cast("long")
    for kind, n in PART_TOKENS.items():
        by_kind = F.when(part["kind"] == kind, F.lit(n).cast("long")).otherwise(by_kind)
    return F.coalesce(part["tokens"], by_kind)


def _visit(part: Column, number: Column) -> Column:
    """The content of one part. Kinds other than text (null counts as text) are placeholders."""
    kind = F.coalesce(part["kind"], F.lit("text"))
    mark = F.concat(F.lit("<part:"), escape(kind, True), F.lit(":"), number.cast("string"), F.lit(">"))
    return F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(mark)


def format_chats(
    rows: DataFrame,
    *,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    parts: str | None = None,
    loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row a conversation: ``conv_id, formatted, segments, attachments, expanded_tokens``.

    ``rows`` has a row a turn. ``parts`` may name a column of :data:`PART_TYPE`; without it, or where it is null,
    the text is the only part. ``segments`` has per turn the role, its place in ``formatted`` (``start`` counts
    code points from 0; ``skip`` is the length of the head before the content), ``length`` of the content and
    whether it is under the loss mask. ``attachments`` has turn, kind, reference and tokens in order;
    ``expanded_tokens`` is their sum.

    Turns are ordered by turn, role and text, null first, so ties have a defined order and repeated rows stay. A
    null text or role is empty; a null conversation is one conversation. Other columns are ignored. An empty
    table gives an empty result. A formatted conversation is one string value, so one conversation has to fit
    into 2 GB; its rows meet in the task that builds that value.
    """
    only = F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))
    given = F.coalesce(F.col(parts).cast(PART_TYPE), only) if parts else only
    turns = rows.select(
        F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), given.alias("parts"), F.coalesce(F.col(text), F.lit("")).alias("raw")
    )
    turns = turns.select(
        "conv_id",
        "turn",
        "role",
        "raw",
        F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit(": ")).alias("head"),
        F.array_join(F.transform("parts", _visit), "").alias("content"),
        F.filter("parts", lambda p: F.coalesce(p["kind"], F.lit("text")) != "text").alias("media"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "raw", "content")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = F.length("head") + F.length("content") + len(CLOSE)
    turns = turns.select(
        "conv_id",
        F.row_number().over(order).alias("at"),
        F.concat("head", "content", F.lit(CLOSE)).alias("piece"),
        F.struct(
            "role",
            F.coalesce(F.sum(whole).over(before), F.lit(0)).cast("long").alias("start"),
            F.length("head").cast("long").alias("skip"),
            F.length("content").cast("long").alias("length"),
            F.col("role").isin(*loss_roles).alias("loss"),
        ).alias("segment"),
        F.transform("media", lambda p: F.struct(F.col("turn").alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))).alias("media"),
    )
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "piece", "segment", "media"))).alias("t"))
    chats = chats.select(
        "conv_id",
        F.array_join(F.col("t.piece"), "").alias("formatted"),
        F.col("t.segment").alias("segments"),
        F.flatten(F.col("t.media")).alias("attachments"),
    )
    return chats.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def _parts(content: Column) -> Column:
    """The typed parts of an escaped content, in order: text unescaped, or the number of a placeholder. Escaped text
    has no ``<`` of its own, so every one begins a placeholder."""
    pieces = F.split(content, "<part:", -1)
    typed = F.transform(
        pieces,
        lambda p, i: F.when(i == 0, F.array(F.struct(F.lit("text").alias("kind"), unescape(p).alias("text"), F.lit(None).cast("int").alias("number")))).otherwise(
            F.array(
                F.struct(
                    unescape(F.substring_index(p, ":", 1), True).alias("kind"),
                    F.lit(None).cast("string").alias("text"),
                    F.substring_index(F.substring_index(F.substr(p, F.locate(":", p) + 1), ">", 1), ":", -1).cast("int").alias("number"),
                ),
                F.struct(F.lit("text").alias("kind"), unescape(F.substr(p, F.locate(">", p) + 1)).alias("text"), F.lit(None).cast("int").alias("number")),
            )
        ),
    )
    return F.filter(F.flatten(typed), lambda p: (p["kind"] != "text") | p["number"].isNotNull() | (p["text"] != ""))


def read_back(chats: DataFrame) -> DataFrame:
    """``chats`` plus ``turns`` (role and text read from ``formatted``), ``parts`` (per turn its typed parts: kind,
    text, number of the placeholder) and ``loss_text`` (all text under the mask).

    In ``turns`` and ``loss_text``, placeholders of attachments stay in the text as they are; ``parts`` tells them from
    a text that spells one, as placeholders are taken apart before anything is unescaped. Neighbouring texts are read
    as one, and empty ones not at all.
    """
    pieces = F.split("formatted", CLOSE, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    content = lambda p: F.substr(p, F.locate(": ", p) + 2)
    parsed = F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), ": ", 1), True).alias("role"), unescape(content(p)).alias("text")))
    chats = chats.withColumn("_p", pieces).withColumns({"turns": parsed, "parts": F.transform("_p", lambda p: _parts(content(p)))})
    under = F.filter(F.arrays_zip("segments", "_p"), lambda z: z["segments"]["loss"])
    masked = F.transform(under, lambda z: unescape(F.substr(z["_p"], (z["segments"]["skip"] + 1).cast("int"), z["segments"]["length"].cast("int"))))
    return chats.withColumn("loss_text", F.array_join(masked, "")).drop("_p")
