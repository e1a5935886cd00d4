"""Suffix-array deduplication: removal of long byte strings that occur more than once in a corpus.

Every window of ``window`` bytes belongs to one anchor, its gram of the least hash, so equal windows anywhere in the
corpus have equal anchors at equal places. Anchors split the corpus into small groups in which all equal windows
meet:

1. Each text gives its anchors and the region of bytes that each anchor's windows cover, with a digest of the region.
2. Anchors of one occurrence have no equal windows. A region that occurs twice or more (by 128 bits of BLAKE2b, for
   which no two different strings of equal digest are known) is repeated as a whole. What is left are groups of an
   equal anchor and different regions.
3. In those groups, regions without a window of an equal hash are put aside. For the rest, the suffix array gives,
   by previous and next smaller positions in suffix order, the longest previous factor of each place (and, by
   larger positions, the longest next factor). A window start is repeated if its factor reaches over the window.
4. A group of more than ``most_regions`` different regions isn't gathered into one task: the windows of its
   regions are counted by their digest instead, pre-aggregated per task.

The rolling hashes, which different strings can be made to share, only bring strings together or put them aside as
not repeated; they never call anything repeated.

:func:`remove_repeats` can also tell which texts share a run of so many words with another row: passages that can be
too short for the window of bytes. Most such texts have a whole region, or their whole text, in common with another
row. The rest is found by marks, the least grams of words in each run, and by the hashes of the runs whose mark
several texts have.

Texts are read as UTF-8 bytes, matches never cross texts, and all judgements are made on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, numbered, ship, small
from .lpf import Rolling, anchors, factors, word_edges, word_windows

WINDOW, GRAM = 400, 64
#: Words of a gram that marks a run of words.
PASSAGE_GRAM = 8
#: Different regions of one anchor that one task handles together (about 2 MB of text).
MOST_REGIONS = 4096
#: Rows of one long that are broadcast to pick texts, by count.
SMALL_ROWS = 2_000_000
#: Window starts of one text that are hashed in one go.
PIECE = 4 << 20
#: Bytes of regions that are read, and of those whose suffix array is built, in one go (small arrays stay in cache).
HELD_BYTES, KERNEL_BYTES = 1 << 20, 1 << 15


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _digest(data: bytes | memoryview) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _text_anchors(raw: bytes, window: int, gram: int) -> tuple[list[np.ndarray], np.ndarray]:
    """([anchor, two halves of the region's digest, first, last, number], later runs) of a text, in pieces of bounded
    memory.

    An anchor and region that occur again in one text are given once, with their number; the runs of the later ones
    are returned apart, as they are repeated for certain.
    """
    found = []
    for lo in range(0, max(1, len(raw) - window + 1), PIECE):
        data = np.frombuffer(raw, np.uint8, min(PIECE + window - 1, len(raw) - lo), lo)
        _, h, first, last = anchors(data, window, gram)
        if len(h):
            found.append((_signed(h), first + lo, last + lo))
    if not found:
        return [np.zeros(0, np.int64)] * 6, np.zeros((0, 2), np.int64)
    h, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    view, known, once, number, later = memoryview(raw), {}, [], [], []
    for i, (a, b) in enumerate(zip(first.tolist(), (last + window).tolist(), strict=True)):
        place = known.setdefault(_digest(view[a:b]), len(once))
        if place == len(once):
            once.append(i)
            number.append(1)
        else:
            number[place] += 1
            later.append(i)
    region = np.frombuffer(b"".join(known), np.int64).reshape(-1, 2)
    return [h[once], region[:, 0], region[:, 1], first[once], last[once], np.array(number)], np.stack([first[later], last[later]], 1)


def _lists(columns: dict[str, list[np.ndarray]]) -> pa.ListArray:
    """array<struct> from one array a row and field."""
    sizes = [len(x) for x in next(iter(columns.values()))]
    flat = pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in columns.values()], list(columns))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), flat)


def _find_anchors(window: int, gram: int, words: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {k: [] for k in ("anchor", "region", "check", "first", "last", "n", "wide")}
            own: dict[str, list] = {"first": [], "last": []}
            sizes, digests, marks, runs = [], [], [], []
            for text in batch.column("text"):
                raw = (text.as_py() or "").encode()
                columns, later = _text_anchors(raw, window, gram)
                starts, ends = word_edges(raw) if words else (np.zeros(0, np.int64),) * 2
                whole = np.searchsorted(ends, columns[4] + window, "right") - np.searchsorted(starts, columns[3])
                for k, v in zip(found, [*columns, (whole >= words if words else whole > 0).astype(np.int64)], strict=True):
                    found[k].append(v)
                own["first"].append(later[:, 0])
                own["last"].append(later[:, 1])
                sizes.append(len(raw))
                digests.append(hashlib.sha256(raw).hexdigest())
                of_runs = word_windows(raw, (starts, ends), words, PASSAGE_GRAM, PIECE)[0] if words else np.zeros(0, np.uint64)
                marks.append(_signed(np.unique(of_runs)))
                runs.append(len(of_runs))
            ends = pa.array(np.r_[0, np.cumsum([len(m) for m in marks])], pa.int32())
            flat = pa.array(np.concatenate(marks) if marks else np.zeros(0, np.int64), pa.int64())
            columns = [batch.column("row"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), _lists(found), _lists(own)]
            columns += [pa.ListArray.from_arrays(ends, flat), pa.array(runs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "key", "n_bytes", "digest", "found", "own", "marks", "runs"])

    return run


ANCHOR_TYPE = (
    "n_bytes long, digest string, found array<struct<anchor:long,region:long,check:long,first:long,last:long,n:long,wide:long>>, own array<struct<first:long,last:long>>,"
    " marks array<long>, runs long"
)
_RUN = pa.struct([("first", pa.int64()), ("last", pa.int64())])


def _cut_regions(window: int):
    """Per wanted region of a text: its bytes; or, in groups that are too large, the digests of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("row", "anchor", "first", "data", "digests")}
            for row, text, wanted in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
                raw = text.as_py().encode()
                view = memoryview(raw)
                for w in wanted:
                    digests = [_digest(view[at : at + window]) for at in range(w["first"], w["last"] + 1)] if w["large"] else None
                    for k, v in (("row", row), ("anchor", w["anchor"]), ("first", w["first"]), ("data", None if w["large"] else raw[w["first"] : w["last"] + window]), ("digests", digests)):
                        rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=REGION_ARROW)

    return run


REGION_TYPE = "row long, anchor long, first long, data binary, digests array<binary>"
REGION_ARROW = pa.schema([("row", pa.int64()), ("anchor", pa.int64()), ("first", pa.int64()), ("data", pa.binary()), ("digests", pa.list_(pa.binary()))])


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False]))
    return zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True)


Region = tuple[int, int, int, bytes]  # anchor, row, first byte, bytes


def _candidates(regions: list[Region], window: int) -> list[Region]:
    """The regions of which some window has the hash of another window, cut to the span of such windows."""
    hashes = [Rolling(np.frombuffer(d, np.uint8)).all_of(window) for *_, d in regions]
    ends = np.cumsum([len(h) for h in hashes])
    flat = np.concatenate(hashes)
    order = np.argsort(flat)
    same = flat[order][1:] == flat[order][:-1]
    again = np.zeros(len(flat), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    out = []
    for (anchor, row, first, d), h, end in zip(regions, hashes, ends.tolist(), strict=True):
        at = np.flatnonzero(again[end - len(h) : end])
        if len(at):
            out.append((anchor, row, first + int(at[0]), d[at[0] : at[-1] + window]))
    return out


def _repeated_runs(regions: list[Region], window: int, keep_first: bool) -> Iterator[tuple[int, int, int]]:
    """(row, first, last) of the window starts that the suffix array of the regions finds again."""
    # a byte that UTF-8 never has ends each region, so no window over an end equals a real one
    data = np.frombuffer(b"\xff".join([*(d for *_, d in regions), b""]), np.uint8)
    before, after = factors(data, window, window)
    reach = before if keep_first else np.maximum(before, after)
    at = 0
    for _, row, first, d in regions:
        for a, b in _runs(reach[at : at + len(d) - window + 1] >= window):
            yield row, first + a, first + b
        at += len(d) + 1


def _packed(regions: list[Region], most: int) -> Iterator[list[Region]]:
    """Whole groups of an anchor, together up to about ``most`` bytes; ``regions`` are sorted by anchor."""
    own: list[Region] = []
    size = 0
    for i, region in enumerate(regions):
        if size > most and region[0] != regions[i - 1][0]:
            yield own
            own, size = [], 0
        own.append(region)
        size += len(region[3])
    if own:
        yield own


def _match_regions(window: int, keep_first: bool):
    """Runs of repeated window starts. Partitions are sorted by anchor; whole groups go through one kernel call
    (equal windows have equal anchors, so groups don't mix up)."""

    def flush(regions: list[Region]) -> Iterator[pa.RecordBatch]:
        found = [x for own in _packed(_candidates(regions, window), KERNEL_BYTES) for x in _repeated_runs(own, window, keep_first)]
        if found:
            yield pa.RecordBatch.from_pydict(dict(zip(("row", "first", "last"), map(list, zip(*found, strict=True)), strict=True)), schema=RUN_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[Region] = []
        size = 0
        for batch in batches:
            for region in zip(*(batch.column(c).to_pylist() for c in ("anchor", "row", "first", "data")), strict=True):
                if size > HELD_BYTES and region[0] != waiting[-1][0]:
                    yield from flush(waiting)
                    waiting, size = [], 0
                waiting.append(region)
                size += len(region[3])
        if waiting:
            yield from flush(waiting)

    return run


RUN_ARROW = pa.schema([("row", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def _cut_texts(window: int, keep_text: bool):
    """What is left of the texts that have repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, text, runs in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("runs").to_pylist(), strict=True):
                raw = np.frombuffer(text.as_py().encode(), np.uint8)
                change = np.zeros(len(raw) + 1, np.int64)
                at = np.array([(r["first"], r["last"]) for r in runs], np.int64)
                np.add.at(change, at[:, 0], 1)
                np.add.at(change, at[:, 1] + window, -1)
                gone = np.cumsum(change)[:-1] > 0
                spans = list(_runs(gone))
                kept = raw[~gone].tobytes()
                out.append({
                    "row": row, "n_removed": int(gone.sum()), "removed": [{"first": a, "last": b} for a, b in spans],
                    "kept_digest": hashlib.sha256(kept).hexdigest(), "kept": kept if keep_text else None,
                })
            yield pa.RecordBatch.from_pylist(out, schema=CUT_ARROW)

    return run


CUT_TYPE = "row long, n_removed long, removed array<struct<first:long,last:long>>, kept_digest string, kept binary"
CUT_ARROW = pa.schema([("row", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(_RUN)), ("kept_digest", pa.string()), ("kept", pa.binary())])


def _passage_runs(words: int):
    """``of, run``: the different runs of words of a text that have one of the wanted marks, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, text, wanted in zip(batch.column("of").to_pylist(), batch.column("text"), batch.column("wanted"), strict=True):
                raw = text.as_py().encode()
                mark, whole = word_windows(raw, word_edges(raw), words, PASSAGE_GRAM, PIECE)
                own = np.unique(_signed(whole[np.isin(_signed(mark), wanted.values.to_numpy())]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), of), pa.int64()), pa.array(own, pa.int64())], ["of", "run"])

    return run


def _passages(base: DataFrame, docs: DataFrame, known: DataFrame, words: int) -> DataFrame:
    """``of, shares_passage``: for each text (a hash of its digest) whether another row has a run of ``words`` words of
    it. ``known`` has row numbers of which that is known.

    Of the others the marks of their runs are looked up among all texts. Runs are read for the marks that several
    texts have, once a text.
    """
    of = F.xxhash64("digest").alias("of")
    texts = base.groupBy(of).agg(F.min("row").alias("row"), (F.count(F.lit(1)) > 1).alias("again"), F.max("runs").alias("runs"))
    settled = F.col("known").isNotNull() | (F.col("again") & (F.col("runs") > 0))
    texts = durable(texts.join(known.select("row", F.lit(True).alias("known")), "row", "left").select("of", "row", settled.alias("settled")))
    marks = base.select("row", "marks").join(small(texts, SMALL_ROWS), "row").select("of", "row", "settled", F.explode("marks").alias("mark"))
    common = marks.groupBy("mark").agg(F.min("of").alias("lo"), F.max("of").alias("hi"), F.min("settled").alias("all")).where("lo < hi and not all").select("mark")
    wanted = marks.join(durable(common), "mark").groupBy("of", "row").agg(F.collect_list("mark").alias("wanted"))
    found = durable(_pick(docs, durable(wanted), 1).select("of", "text", "wanted").mapInArrow(_passage_runs(words), "of long, run long"))
    several = found.groupBy("run").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo < hi").select("run")
    shared = found.join(several, "run").select("of", F.lit(True).alias("shared")).distinct()
    return texts.join(shared, "of", "left").select("of", (F.col("settled") | F.col("shared").isNotNull()).alias("shares_passage"))


def _pick(docs: DataFrame, chosen: DataFrame, window: int) -> DataFrame:
    """``row, text`` and the columns of ``chosen`` (by ``row``). If the row numbers are counted to be few, they are
    broadcast first, so that other texts are not shuffled."""
    texts = docs.where(F.octet_length("text") >= window).select("row", "text")
    rows = small(chosen.select("row"), SMALL_ROWS)
    return texts.join(rows, "row", "left_semi").join(chosen, "row")


def remove_repeats(
    df: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    keep_first: bool = False,
    keep_text: bool = True,
    most_regions: int = MOST_REGIONS,
    passage_words: int | None = None,
) -> DataFrame:
    """One row a row of ``df``: key, ``n_bytes``, ``n_removed``, ``removed`` (maximal runs of bytes, first and last),
    ``kept_sha256`` and, with ``keep_text``, ``kept`` (the bytes that stay; null where nothing was removed).

    With ``passage_words`` also ``shares_passage``: whether another row has a run of so many words of the text (split
    at ASCII white space, as they are spelled; runs are compared by 64-bit hashes). It changes nothing that is removed.

    Removed is every byte covered by a string of ``window`` bytes that also starts anywhere else. With
    ``keep_first``, the occurrence that comes first by row (and place in it) stays, and later ones go.

    Numbers, keys and texts are stored together and read from there, so ``df`` is read once, and its split into
    partitions doesn't matter. Null and empty texts have no
    bytes. Repeated rows are copies of each other. Very long texts are processed whole. Other columns are ignored;
    an empty table gives an empty result. A third of all rows may be one text, or one passage: equal regions are
    counted, not gathered, and large groups of different regions are counted by window.
    """
    ship(df.sparkSession)
    docs = numbered(df, None, key=F.col(key), text=F.col(text))
    base = durable(docs.mapInArrow(_find_anchors(window, gram, passage_words), f"row long, key {docs.schema['key'].dataType.simpleString()}, {ANCHOR_TYPE}"))
    each = base.select("row", F.explode("found").alias("f")).select("row", "f.*")
    # equal regions: how many, and which is first
    region = ["anchor", "region", "check"]
    regions = each.groupBy(*region).agg(F.sum("n").alias("n"), F.min(F.struct("row", "first", "last")).alias("one"), F.max("row").alias("last_row"))
    regions = durable(regions.select(*region, "n", "one.*", "last_row"))
    by_anchor = regions.groupBy("anchor").agg(F.sum("n").alias("of_anchor"), F.count(F.lit(1)).alias("different"), F.min("n").alias("least_n"))
    by_anchor = by_anchor.where("of_anchor > 1")
    known = regions.join(by_anchor, "anchor")

    # whole regions that are repeated: every occurrence is
    whole = known.where("n > 1").select(*region, F.col("row").alias("first_row"), F.col("first").alias("first_place"), (F.col("last_row") > F.col("row")).alias("shared"))
    repeated = durable(each.join(whole, region).select("row", "first", "last", "first_row", "first_place", (F.col("shared") & (F.col("wide") > 0)).alias("passage")))
    with_passage = repeated.where("passage").select("row").distinct()
    if keep_first:
        repeated = repeated.where((F.col("row") != F.col("first_row")) | (F.col("first") != F.col("first_place")))
    repeated = repeated.select("row", "first", "last").unionByName(base.select("row", F.explode("own").alias("o")).select("row", "o.*"))

    # different regions of one anchor, one occurrence of each
    open_groups = known.where(F.col("different") > 1) if keep_first else known.where("different > 1 and least_n = 1")
    open_groups = open_groups.withColumn("large", F.col("different") > most_regions)
    has_large = by_anchor.where(F.col("different") > most_regions).limit(1).count() > 0

    def cut(large: bool) -> DataFrame:
        wanted = open_groups.where(F.col("large") == large).groupBy("row").agg(F.collect_list(F.struct("anchor", "first", "last", "large")).alias("wanted"))
        return _pick(docs, durable(wanted), window).mapInArrow(_cut_regions(window), REGION_TYPE)

    parts = cut(False).select("row", "anchor", "first", "data")
    order = ["anchor", "row", "first"]
    matched = parts.repartition("anchor").sortWithinPartitions(*order).mapInArrow(_match_regions(window, keep_first), "row long, first long, last long")
    repeated = repeated.unionByName(matched)
    if has_large:
        windows = cut(True).select("row", "anchor", "first", F.posexplode("digests").alias("i", "digest"))
        windows = windows.select("row", "anchor", (F.col("first") + F.col("i")).alias("first"), "digest")
        several = windows.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "first")).alias("one")).where("n > 1")
        large = windows.join(several, ["anchor", "digest"])
        if keep_first:
            large = large.where((F.col("row") != F.col("one.row")) | (F.col("first") != F.col("one.first")))
        # neighbouring starts become one run: their distance to their number in the region's order is the same
        island = F.col("first") - F.row_number().over(Window.partitionBy("row", "anchor").orderBy("first"))
        large = large.select("row", "anchor", "first", island.alias("island")).groupBy("row", "anchor", "island")
        repeated = repeated.unionByName(large.agg(F.min("first").alias("first"), F.max("first").alias("last")).select("row", "first", "last"))

    runs = repeated.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    left = _pick(docs, durable(runs), window).mapInArrow(_cut_texts(window, keep_text), CUT_TYPE)
    out = base.select("row", "key", "n_bytes", "digest").join(left, "row", "left")
    if passage_words:
        out = out.withColumn("of", F.xxhash64("digest")).join(_passages(base, docs, with_passage, passage_words), "of", "left")
    return out.select(
        F.col("key").alias(key),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<struct<first:bigint,last:bigint>>")).alias("removed"),
        F.coalesce("kept_digest", "digest").alias("kept_sha256"),
        *(["shares_passage"] if passage_words else []),
        *(["kept"] if keep_text else []),
    )
