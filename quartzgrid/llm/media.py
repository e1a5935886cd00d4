"""Media columns: texts stored as FLAC, read back with all checksums verified, as features and PCM blocks."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flac
from .common import fresh, ship

#: Payload bytes that are encoded and decoded in one go: bounds the memory of a Python worker. A longer text
#: makes a batch of its own.
BATCH_BYTES = 3 << 20
#: Order of the linear predictors that frames can take instead of a fixed one.
LPC_ORDER = 2
MEDIA = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary,"
    " seek array<struct<sample:long,offset:long,samples:long>>"
)


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes and zero bytes up to a positive multiple of 64; a null text is an empty one."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def feature_of(pcm: bytes) -> str:
    """Loudness, sign changes and spread of the samples, in integers so that equal samples give equal text."""
    energy = turns = rough = peak = 0
    for lo in range(0, len(pcm), flac.RUN):  # with the sample before, for the differences
        x = np.frombuffer(pcm, np.uint8, min(flac.RUN + (lo > 0), len(pcm) - lo + (lo > 0)), lo - (lo > 0)).astype(np.int64) - 128
        own = x[1:] if lo else x
        energy += int((own * own).sum())
        turns += int(((x[1:] < 0) != (x[:-1] < 0)).sum())
        rough += int(np.abs(np.diff(x)).sum())
        peak = max(peak, int(np.abs(own).max()))
    return f"samples={len(pcm)};energy={energy};crossings={turns};roughness={rough};peak={peak}"


def _batches(texts: pd.Series) -> Iterator[list[bytes]]:
    own, size = [], 0
    for text in texts:
        p = payload_of(text)
        if own and size + len(p) > BATCH_BYTES:
            yield own
            own, size = [], 0
        own.append(p)
        size += len(p)
    if own:
        yield own


def flac_media(text: Column, keep_media: bool = True) -> Column:
    """A struct of :data:`MEDIA` for each text: its FLAC form, what is read back from that, and the seek points.

    Sizes and digests of the payload, its last 64 bytes' checksum and the feature come from the decoded stream.
    Without ``keep_media`` the stream itself and its seek points stay null and never leave the Python worker.
    Null and empty texts are 64 zero bytes. Texts of any length are processed whole.
    """

    @F.pandas_udf(MEDIA)
    def convert(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            rows = []
            lengths = iter([len((t or "").encode()) for t in texts])
            for payloads in _batches(texts):
                streams = flac.encode(payloads, LPC_ORDER)
                for stream, pcm in zip(streams, flac.decode(streams), strict=True):
                    rows.append((
                        next(lengths), len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), feature_of(pcm),
                        stream if keep_media else None,
                        [dict(zip(("sample", "offset", "samples"), p, strict=True)) for p in flac.seek_points(stream)] if keep_media else None,
                    ))
            yield pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "seek"])

    return convert(text)


def flac_blocks(media: Column, from_sample: int = 0, to_sample: int | None = None) -> Column:
    """The PCM blocks of FLAC columns that overlap a range of samples, as array<struct<sample, pcm>>, found by seek
    point. A null stream gives null; a stream whose checksums do not hold is an error."""

    @F.pandas_udf("array<struct<sample:long,pcm:binary>>")
    def read(streams: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else [{"sample": a, "pcm": b} for a, b in flac.pcm_blocks(bytes(s), from_sample, to_sample)] for s in streams], dtype=object)

    return read(media)


def add_media(df: DataFrame, text: str = "text", keep_media: bool = True) -> DataFrame:
    """``df`` plus the columns of :data:`MEDIA`; input columns of these names are replaced. Row by row, no shuffle.

    Null and empty texts are stored as 64 zero bytes; repeated rows are stored each, alike; an empty table gives an
    empty result. Long texts are encoded and decoded in runs of 512 frames, so that a worker needs a few times the
    text itself besides a fixed amount.
    """
    ship(df.sparkSession)
    names = [x.split()[0] for x in MEDIA.split(", ")][:7] + ["media", "seek"]
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    if not keep_media:
        names = names[:7]
    (made,) = fresh(df, "_media")
    return df.select(*kept, flac_media(F.col(text), keep_media).alias(made)).select("*", *[F.col(made)[n].alias(n) for n in names]).drop(made)
