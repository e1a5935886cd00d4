r"""Secret scans with DataFrame functions only: fixed patterns, and a randomness test battery for long tokens.

A token is a run of 20 or more letters, digits and ``+ / _ -`` (with base64 padding). Its encoding is inferred from
its characters, and three tests take "symbols drawn evenly and independently from that alphabet" as hypothesis:

* chi-squared over the symbol counts (tail by the Wilson-Hilferty normal approximation),
* runs of symbols in the lower and upper half of the alphabet (Wald-Wolfowitz),
* serial correlation of neighbouring symbols.

Fisher's method combines the three. Two false-discovery controls stand side by side within each encoding and length
class, as the power of the tests depends on both; no token is left out beforehand.

* A token is dismissed as ordinary text where randomness is rejected, with the share of real secrets among the
  dismissed held at ``rate`` by Benjamini and Hochberg.
* The p values of real secrets are even, so the tokens in the upper half of p values tell how many secrets there are
  (Storey). What else is above a p value must be ordinary: tokens are reported only from a p value on above which that
  estimated share of ordinary ones is at most ``rate``.

A token that passes both is a span of kind ``random``. The second control can cost real secrets in a class full of
ordinary tokens; in a class of a few tokens it has little to go by, and the first decides.
Ranks come from a histogram of p values by encoding and class, which is bounded, so no global sort is made.

Positions: splitting a text at a pattern gives the gaps between its matches; running sums over gaps and matches are
the code point offsets. They are computed over rows, so the number of matches in one text is not bounded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, fresh

#: Base patterns in their listed order: pattern, group that has a least length, that length.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: A shorter equal of the hex pattern: maximal runs of fewer characters would be dropped anyway.
SEARCH = {"hex": r"[0-9a-f]{24,}"}
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = (*BASE, "random")

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the smallest alphabet up: name, pattern of a whole token, alphabet.
ENCODINGS = (
    ("digits", r"^[0-9]+$", DIGITS),
    ("hex", r"^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("HEX", r"^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("word", r"^[A-Z]?[a-z]+$", LOWER),
    ("upper", r"^[A-Z]+$", UPPER),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", r"^[A-Z0-9]+$", DIGITS + UPPER),
    ("lower36", r"^[a-z0-9]+$", DIGITS + LOWER),
    ("base62", r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("base64", r"^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("mixed", r"", UPPER + LOWER + DIGITS + "+/-_"),
)
#: Lower ends of the length classes.
CLASSES = (20, 24, 32, 48, 96)
#: Bins of the histogram: so many to a factor of ten of the p value, down to the last bin.
BINS, LAST_BIN = 50, 5000
#: The bins below this one hold the upper half of p values.
EVEN = 15


def _normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution (Abramowitz and Stegun 26.2.17)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) * (1 / math.sqrt(2 * math.pi)) * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _normal_tail(F.abs(z)))


def battery(df: DataFrame, token: str) -> DataFrame:
    """``df`` plus ``encoding, length, p_even, p_runs, p_serial, p_value`` for the tokens in a column.

    Trailing padding is not tested. Tokens of one symbol repeated, or of length 1, get the p value 0. A null token
    gets nulls. Linear in the length of the token.
    """
    body = F.regexp_replace(token, "=+$", "")
    encoding, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern, letters in reversed(ENCODINGS):
        test = body.rlike(pattern) if pattern else F.lit(True)
        encoding, alphabet = F.when(test, name).otherwise(encoding), F.when(test, letters).otherwise(alphabet)
    x, a, n = F.col("_x"), F.col("_size"), F.col("length")
    df = df.withColumn("_body", body).withColumns({"encoding": encoding, "_letters": alphabet, "length": F.length("_body")}).withColumn("_size", F.length("_letters"))
    # a replaced symbol shortens the token by its count
    counts = F.transform(F.split("_letters", ""), lambda c: F.when(c == "", 0).otherwise(n - F.length(F.replace(F.col("_body"), c, F.lit("")))))
    df = df.withColumn("_counts", counts).withColumn("_x", F.transform(F.filter(F.split("_body", ""), lambda c: c != ""), lambda c: F.instr(F.col("_letters"), c).cast("double")))
    add = lambda values, f: F.aggregate(values, F.lit(0.0), lambda s, v: s + f(v))
    walk = F.aggregate(
        x,
        F.struct(F.lit(None).cast("boolean").alias("high"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("highs")),
        lambda s, v: F.struct(
            (v > a / 2).alias("high"),
            (s["runs"] + F.when(s["high"].isNull() | (s["high"] != (v > a / 2)), 1.0).otherwise(0.0)).alias("runs"),
            (s["highs"] + F.when(v > a / 2, 1.0).otherwise(0.0)).alias("highs"),
        ),
    )
    df = df.withColumns({
        "_walk": walk,
        "_squares": add("_counts", lambda v: v.cast("double") * v),
        "_sum": add(x, lambda v: v),
        "_sum2": add(x, lambda v: v * v),
        "_lag": add(F.zip_with(x, F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), lambda p, q: F.coalesce(p * q, F.lit(0.0))), lambda v: v),
    })
    free = (a - 1).cast("double")
    chi = F.greatest(F.col("_squares") * a / n - n, F.lit(0.0))
    even = _normal_tail((F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))
    high, low = F.col("_walk.highs"), n - F.col("_walk.highs")
    expected = 2 * high * low / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    runs = F.when((n > 1) & (spread > 0), _two_sided((F.col("_walk.runs") - expected) / F.sqrt(spread))).otherwise(0.0)
    mean = F.col("_sum") / n
    spread2 = F.col("_sum2") - n * mean * mean
    first, last = F.element_at(x, 1), F.element_at(x, -1)
    covariance = F.col("_lag") - mean * (2 * F.col("_sum") - first - last) + (n - 1) * mean * mean
    serial = F.when((n > 1) & (spread2 > 1e-9), _two_sided((covariance / spread2 + 1 / n) * F.sqrt(n.cast("double")))).otherwise(0.0)
    df = df.withColumns({"p_even": even, "p_runs": runs, "p_serial": serial})
    least = F.lit(1e-100)
    half = -F.log(F.greatest("p_even", least)) - F.log(F.greatest("p_runs", least)) - F.log(F.greatest("p_serial", least))
    combined = F.exp(-half) * (1 + half + half * half / 2)  # upper tail of chi-squared with six degrees
    return df.withColumn("p_value", combined).drop("_body", "_letters", "_size", "_counts", "_x", "_walk", "_squares", "_sum", "_sum2", "_lag")


def dismissed(tokens: DataFrame, rate: float = 0.05) -> DataFrame:
    """``encoding, class, last_bin``: tokens of an encoding and length class are dismissed from that bin on. One row
    an encoding and class.

    Both controls read a histogram of p values. For Benjamini-Hochberg the p value of a bin is taken as its upper end,
    which errs on keeping. For the share of ordinary tokens among the reported it is the lower end; the tokens in the
    upper half of p values count as one more than they are, so that a class of few tokens is not emptied by chance.
    """
    p = lambda b: F.pow(F.lit(10.0), -b / BINS)
    bins = tokens.groupBy("encoding", "class", "bin").agg(F.count(F.lit(1)).alias("n"))
    of_class = Window.partitionBy("encoding", "class")
    ranked = bins.withColumns({
        "rank": F.sum("n").over(of_class.orderBy(F.desc("bin"))),
        "above": F.sum("n").over(of_class.orderBy("bin")),
        "all": F.sum("n").over(of_class),
        "even": F.sum(F.when(F.col("bin") < EVEN, F.col("n")).otherwise(0)).over(of_class),
    })
    secrets = (F.col("even") + 1) / (1 - 10 ** (-EVEN / BINS)) * (1 - p(F.col("bin") + 1))
    rejected = p(F.col("bin")) <= rate * F.col("rank") / F.col("all")
    reported = F.col("above") - secrets <= rate * F.col("above")
    ends = ranked.groupBy("encoding", "class").agg(F.min(F.when(rejected, F.col("bin"))).alias("first"), F.max(F.when(reported, F.col("bin") + 1)).alias("end"))
    return ends.select("encoding", "class", F.least("first", F.coalesce("end", F.lit(0))).alias("last_bin"))


def _found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<kind, at, gap, len, keep, token>> of all matches, whether kept or not: gaps need every one."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("g"), whole.alias("m"), part.alias("p"))
    some = F.transform(
        F.filter(zipped, lambda z: z["m"].isNotNull()),
        lambda z, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            i.alias("at"),
            F.length(z["g"]).cast("long").alias("gap"),
            F.length(z["m"]).cast("long").alias("len"),
            (F.length(z["p"]) >= least).alias("keep"),
            (z["m"] if kind == "random" else F.lit(None).cast("string")).alias("token"),
        ),
    )
    return F.when(text.rlike(pattern), some).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<kind:int,at:int,gap:bigint,len:bigint,keep:boolean,token:string>>"


def scan_secrets(df: DataFrame, *, key: str = "doc_id", text: str = "text", rate: float = 0.05) -> DataFrame:
    """One row a row of ``df``: the key and ``spans``, an array of struct<start, kind, end> by start, then kind.

    Offsets are code points, ends exclusive; kinds count as listed in :data:`KINDS`. All spans of the base patterns
    stay, whatever the tests say. A null text has no spans; whole texts are scanned; repeated rows are scanned
    each; other columns are ignored; an empty table gives an empty result.
    """
    t, r = "_text", "_row"
    docs = df.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias(r), F.coalesce(F.col(text), F.lit("")).alias(t))
    mark = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("gap"), F.lit(0).cast("long").alias("len"), F.lit(False).alias("keep"), F.lit(None).cast("string").alias("token")))
    every = [_found(F.col(t), k, SEARCH.get(k, p), g, n) for k, (p, g, n) in BASE.items()] + [_found(F.col(t), "random", TOKEN, 0, 20)]
    # One row a match, and one a document that keeps those without matches: a single pass over the texts.
    rows = docs.select("_key", r, F.explode(F.concat(mark.cast(SPANS), *every)).alias("s")).select("_key", r, "s.*")
    before = Window.partitionBy(r, "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before)).withColumn("start", F.col("end") - F.col("len"))
    rows = durable(rows.where("keep or kind < 0").select("_key", r, "kind", "start", "end", "token"))

    random = KINDS.index("random")
    tested = battery(rows.where(F.col("kind") == random), "token")
    length_class = sum((F.when(F.col("length") >= c, 1).otherwise(0) for c in CLASSES), F.lit(0))
    spot = F.least(F.lit(LAST_BIN), F.floor(-F.log10(F.greatest(F.col("p_value"), F.lit(1e-100))) * BINS)).cast("int")
    tested = durable(tested.select("_key", r, "kind", "start", "end", "encoding", length_class.alias("class"), spot.alias("bin")))
    # at most one row an encoding and length class
    tested = tested.join(F.broadcast(dismissed(tested, rate)), ["encoding", "class"], "left").where("last_bin is null or bin < last_bin")
    names = ["_key", r, "kind", "start", "end"]
    spans = rows.where(F.col("kind") != random).select(names).unionByName(tested.select(names))
    found = F.sort_array(F.collect_list(F.when(F.col("kind") >= 0, F.struct("start", "kind", "end"))))
    return spans.groupBy(r, "_key").agg(found.alias("spans")).select(F.col("_key").alias(key), "spans")


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
