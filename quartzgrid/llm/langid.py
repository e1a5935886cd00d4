"""Language identification by Bayesian evidence fusion.

The posterior of a language is the product of

* the likelihood of the text: hashed byte trigrams under a multinomial model of each language, trained here on a
  bounded sample of each language's labelled rows, counted as at most :data:`EVIDENCE` independent trigrams;
* the likelihood of the declared language (markup or metadata), which tells the truth with probability ``trust``;
* the prior of the row's host, smoothed towards that of its address suffix, which is smoothed towards that of the
  whole table. These priors come from one grouped aggregation over all rows of what the text alone says.

One more hypothesis, ``und``, stands for text in no known language: all trigrams are equally likely under it. Rows
for which it wins, rows without letters and rows whose best language stays under ``least`` are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, ship, small

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
#: Trigrams of one text overlap and repeat; together they weigh no more than so many independent ones.
EVIDENCE = 200
#: Bytes scored in one go.
PIECE = 1 << 20
UND = "und"
#: Letters are lower-cased; other ASCII bytes become spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def trigrams(data: bytes) -> np.ndarray:
    """Bucket numbers of the byte trigrams."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return (code * np.uint32(2654435761) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)


def fold(text: str | None) -> bytes:
    return b" " + (text or "").encode().translate(FOLD) + b"  "


@dataclass(frozen=True)
class Model:
    """Log probability of each bucket by language; the last row is ``und``."""

    languages: tuple[str, ...]
    table: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """(texts, languages + 1): log likelihoods, as if of :data:`EVIDENCE` trigrams at most."""
        out = np.zeros((len(texts), len(self.table)))
        at, own, size = 0, [], 0
        for i, text in enumerate([*texts, None]):
            data = fold(text) if i < len(texts) else b""
            if own and (size + len(data) > PIECE or i == len(texts)):
                flat = trigrams(b"".join(own))
                ends = np.cumsum([len(x) for x in own])
                starts = ends - [len(x) for x in own]
                # the last two trigrams of a text reach into the next one: leave them out
                keep = np.ones(len(flat) + 2, bool)
                keep[ends - 1] = keep[ends - 2] = False
                for k, row in enumerate(self.table):
                    values = np.where(keep, np.append(row[flat], np.float32([0, 0])), 0)
                    out[at : at + len(own), k] = np.add.reduceat(values, starts, dtype=np.float64)
                n = np.array([len(x) - 2 for x in own])
                out[at : at + len(own)] *= (np.minimum(n, EVIDENCE) / n)[:, None]
                at, own, size = i, [], 0
            if i == len(texts):
                break
            if len(data) > PIECE:  # one long text, in pieces that overlap by two bytes
                n = len(data) - 2
                for lo in range(0, n, PIECE):
                    out[i] += self.table[:, trigrams(data[lo : min(lo + PIECE, n) + 2])].sum(axis=1, dtype=np.float64)
                out[i] *= EVIDENCE / n
                at = i + 1
                continue
            own.append(data)
            size += len(data)
        return out


def train(
    df: DataFrame,
    *,
    text: str = "text",
    declared: str = "lang",
    key: str = "doc_id",
    rows: int = 8_000,
    least_rows: int = 5,
    each: int = 500,
    seed: int = 5,
) -> Model:
    """Fit the text model on about ``rows`` labelled rows, the same number of each language.

    Every language with ``least_rows`` labelled rows in the whole table is in the model: it gives about
    ``rows`` / languages rows, or ``each`` where that is more, or all that it has. Which ones is drawn by a seeded
    hash of text and key (of the text alone without such a column), and the row of the least hash is always drawn.
    Rows of equal text and key are drawn as one. Without labelled rows the model knows ``und`` alone, and every row
    will be rejected.
    """
    ship(df.sparkSession)
    of = [F.col(text)] + [F.col(key)] * (key in df.columns)
    labelled = df.where(F.col(declared).isNotNull() & F.col(text).isNotNull()).select(
        F.lower(F.col(declared)).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit(seed), *of).alias("h")
    )
    # one row a language
    known = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).where(F.col("n") >= least_rows).collect()
    total = sum(r["n"] for r in known)
    most = rows if total <= rows else max(each, rows // len(known))
    # hashes are drawn up to a bound; the least one is within it, so no language is without a row
    bounds = [(r["lang"], max(r["least"], min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, most / r["n"]))))) for r in known]
    bound = df.sparkSession.createDataFrame(bounds, "lang string, bound long")
    sample = labelled.join(F.broadcast(bound), "lang").where("h <= bound").select("lang", "text", "h").distinct()

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, own in zip(batch["lang"], batch["text"], strict=True):
                c = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                c[:BUCKETS] += np.bincount(trigrams(fold(own)), minlength=BUCKETS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype("int32"), "n": c[at]})

    # at most (languages x buckets) rows, whatever the size of the table
    sums = sample.mapInPandas(tally, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names, tables = [], []
    for lang, own in sorted(sums.groupby("lang"), key=lambda x: x[0]):
        c = np.zeros(BUCKETS)
        c[own["bucket"].to_numpy()] = own["n"].to_numpy()
        p = (c + 0.1) / (c.sum() + 0.1 * BUCKETS)
        names.append(lang)
        tables.append(np.log(p))
    tables.append(np.full(BUCKETS, -np.log(BUCKETS)))
    return Model(tuple(names), np.array(tables, np.float32))


def text_scores(text: Column, model: Model) -> Column:
    """array<double>: the log likelihood of each text by language, ``und`` last. Row by row, no shuffle."""

    @F.pandas_udf("array<double>")
    def score(series: pd.Series) -> pd.Series:
        return pd.Series(list(model.scores(list(series))), dtype=object)

    return score(text)


def markup_language(html: Column) -> Column:
    """The primary language that the markup's html tag declares, or null."""
    return F.lower(F.nullif(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1), F.lit("")))


def address_parts(url: Column) -> tuple[Column, Column]:
    """(host, its last label) of an address, or nulls."""
    host = F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    return host, F.substring_index(host, ".", -1)


def identify(
    df: DataFrame,
    model: Model,
    *,
    text: str = "text",
    declared: str | Column | None = "lang",
    host: str | Column | None = "source",
    suffix: Column | None = None,
    trust: float = 0.9,
    least: float = 0.5,
    smoothing: float = 20.0,
    und_prior: float = 1e-4,
) -> DataFrame:
    """All rows and columns of ``df`` plus ``language``, ``confidence``, ``accepted`` and ``text_language``.

    ``text_language`` is what the text alone says, ``language`` the winner of the fusion and ``confidence`` its
    posterior. Input columns that have one of these names are replaced.

    Null evidence of any kind is no evidence: a null declaration is skipped, a null host or suffix is a group of
    its own. Texts that are null, empty or without letters are ``und`` and rejected. Whole texts are scored.
    Repeated rows are judged each; an empty table gives an empty result.

    A host that holds a third of all rows is pre-aggregated per task; its prior comes back as one row a host,
    broadcast if counted to be small, else by a join that adaptive execution can split.
    """
    ship(df.sparkSession)
    df = df.drop(*[c for c in df.columns if c.lower() in ("language", "confidence", "accepted", "text_language")])
    s, h, x, d, best, h1, x1, prior = fresh(df, "_scores", "_host", "_suffix", "_declared", "_best", "_of_host", "_of_suffix", "_prior")
    column = lambda c: F.col(c) if isinstance(c, str) else F.lit(None).cast("string") if c is None else c
    names = [*model.languages, UND]
    scored = df.withColumns({
        h: column(host).cast("string"),
        x: column(suffix).cast("string"),
        d: F.lower(column(declared).cast("string")),
        s: text_scores(F.col(text), model),
    })

    # Grouped aggregation over all rows: what the texts of each host say.
    winner = F.array_position(F.col(s), F.array_max(s)).cast("int")
    by_host = durable(scored.select(h, x, winner.alias("b")).groupBy(h, x).agg(*[F.count_if(F.col("b") == i + 1).cast("double").alias(f"c{i}") for i in range(len(names))]))
    totals = by_host.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0.0)) for i in range(len(names))]).first()
    whole = [(t + 1.0) / (sum(totals) + len(names)) for t in totals]
    whole[-1] = und_prior
    by_suffix = by_host.groupBy(x).agg(*[F.sum(f"c{i}").alias(f"x{i}") for i in range(len(names))]).withColumnRenamed(x, "_x")
    n_suffix = sum((F.col(f"x{i}") for i in range(1, len(names))), F.col("x0"))
    n_host = sum((F.col(f"c{i}") for i in range(1, len(names))), F.col("c0"))
    suffix_prior = [(F.col(f"x{i}") + smoothing * whole[i]) / (n_suffix + smoothing) for i in range(len(names))]
    host_prior = [F.log((F.col(f"c{i}") + smoothing * suffix_prior[i]) / (n_host + smoothing)) for i in range(len(names))]
    host_prior[-1] = F.log(F.lit(und_prior))
    priors = by_host.join(by_suffix, F.col(x).eqNullSafe(F.col("_x"))).select(F.col(h).alias(h1), F.col(x).alias(x1), F.array(*host_prior).alias(prior))

    other = (1 - trust) / max(1, len(names) - 1)
    told = F.array(*[F.when(F.col(d).isNull(), 0.0).otherwise(F.when(F.col(d) == n, float(np.log(trust))).otherwise(float(np.log(other)))) for n in names])
    joined = scored.join(small(durable(priors), 50_000), F.col(h).eqNullSafe(F.col(h1)) & F.col(x).eqNullSafe(F.col(x1)), "left")
    fused = F.zip_with(F.zip_with(F.col(s), F.col(prior), lambda a, b: a + b), told, lambda a, b: a + b)
    fused = joined.withColumn(best, fused)
    top = F.array_max(best)
    posterior = 1.0 / F.aggregate(best, F.lit(0.0), lambda a, v: a + F.exp(v - top))
    labels = F.array(*map(F.lit, names))
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    language = F.when(letters, F.element_at(labels, F.array_position(best, top).cast("int"))).otherwise(UND)
    return fused.select(
        *[F.col(f"`{c}`") for c in df.columns],
        language.alias("language"),
        F.when(letters, posterior).otherwise(0.0).alias("confidence"),
        (letters & (language != UND) & (posterior >= least)).alias("accepted"),
        F.when(letters, F.element_at(labels, F.array_position(s, F.array_max(s)).cast("int"))).otherwise(UND).alias("text_language"),
    )


def identify_pages(df: DataFrame, model: Model, *, url: str = "url", html: str = "html", **options) -> DataFrame:
    """:func:`identify` for raw pages: declared by the markup, host and suffix from the address. Tags are not text.

    A null or empty page has no text and is rejected; a null address, or one without a host, is a group of its own.
    Repeated rows are judged each; other columns may have any names; an empty table gives an empty result.
    """
    host, suffix = address_parts(F.col(url))
    (t,) = fresh(df, "_plain")
    plain = F.regexp_replace(F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    out = identify(df.withColumn(t, plain), model, text=t, declared=markup_language(F.col(html)), host=host, suffix=suffix, **options)
    return out.drop(t)
