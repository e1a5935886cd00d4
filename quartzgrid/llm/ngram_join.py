"""N-gram Jaccard self-join by token-combination prefixes.

The set of a text is its distinct shingles of five words, as 64-bit hashes. Two texts link when the Jaccard
similarity of their sets reaches ``percent``; components follow links. The steps:

1. *No partner.* A text that needs p = n - ceil(percent n) + 1 tokens to be unlike any other, and has p tokens that
   no other text has, links with none. The tokens under a fixed hash value, about ``probe`` of all, are counted
   over all texts; most texts end here.
2. *Classes.* Texts of equal sets are one class from here on. Step 1 is done once more over the classes left: copies
   no longer hold each other's tokens, nor do texts that have ended.
3. *Prefixes.* The tokens of the classes left are counted, and each class takes its prefix in the order of rarity,
   extended by one token: linked classes share a token in their prefixes, and two in the extended ones.
4. *Cells.* A class stands in the lists of its prefix tokens by its band of sizes: as the smaller one of a pair in
   its own band, as the larger one in every band of sizes that it could still link with at that rank. So a pair
   meets in the cell (token, band of the smaller one), and a list of equal sizes that are too unlike is empty.
   A cell is rare as long as the pairs across its components are no more than ``rare_pairs`` for each entry.
5. *Rare tokens* are indexed singly: all pairs of their cells are verified.
6. *Frequent tokens.* First, early links: in every frequent cell one central class is verified against all others,
   in rounds, so that a group of near copies becomes one component after a number of checks in proportion to its
   size, not to its pairs. Cells that are rare from then on are indexed singly; the classes of the others are indexed
   by combinations of two of their frequent tokens, which both members of a linked pair have in the same band.

No pair is left out: a pair that isn't verified is in one component already, or lacks the tokens to be linked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, discard, durable, numbered, scratch, small
from .components import components

SHINGLE, PERCENT = 5, 80
#: Share of all tokens that step 1 counts.
PROBE = 0.3
#: So many leading bits of a token are counted in step 1. Two tokens with equal ones only look shared, which ends no text.
PROBE_BITS = 48
#: A cell is rare as long as the pairs across its components are no more than so many for each entry.
RARE_PAIRS = 8
#: Rounds of early links at most; they end as soon as a round leaves more than half of the open entries.
PIVOT_ROUNDS = 6
#: Bands of sizes in a factor of 100 / percent.
BANDS = 2
#: Rows of one long that are broadcast to pick texts, by count; above, the texts are joined by shuffle.
SMALL_ROWS = 2_000_000


def shingle_set(words: Column, n: int = SHINGLE) -> Column:
    """Sorted distinct hashes of the runs of ``n`` words; fewer words, but not none, are one run.

    ``words`` must be a plain column, as it is read once a run.
    """
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)]))
    whole = F.array(F.xxhash64(words))
    return F.when(F.size(words) >= n, F.sort_array(F.array_distinct(runs))).when(F.size(words) > 0, whole).otherwise(F.array().cast("array<bigint>"))


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """``row, key, tokens`` from ``row, key, text``."""
    words = F.coalesce(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
    split = docs.select("row", "key", words.alias("words"))
    return split.select("row", "key", shingle_set(F.col("words"), n).alias("tokens"))


def prefix_size(n: Column, percent: int) -> Column:
    """n - ceil(percent n / 100) + 1: so many tokens that another set lacks make the similarity too low."""
    return n - F.floor((n * percent + 99) / 100) + 1


def _overlap(a: Column, b: Column, percent: int) -> Column:
    """The number of shared tokens that sets of two sizes need."""
    return F.floor((percent * (a + b) + 99 + percent) / (100 + percent))


def _band(n: Column, percent: int) -> Column:
    return F.floor(F.log(n.cast("double")) * (BANDS / math.log(100 / percent))).cast("int")


def _cells(lists: DataFrame, percent: int) -> DataFrame:
    """The entries of ``cls, n, m, r, token`` by cell: ``token, band, small`` and the rest.

    At rank ``r`` (from 0) of its ``m`` tokens that others have too, a class can share ``m - r`` tokens, plus the one
    by which prefixes are extended. That bounds the partner's size: no entry is made for sizes beyond.
    """
    n = F.col("n")
    left = F.col("m") - F.col("r") + 1
    least = F.floor((n * percent + 99) / 100)
    most = F.least(n, F.floor(left * (100 + percent) / percent) - n)  # the largest partner that is no larger itself
    bands = F.when(most >= least, F.sequence(_band(least, percent), _band(most, percent))).otherwise(F.array().cast("array<int>"))
    own = F.when(left >= _overlap(n, n, percent), F.array(F.struct(_band(n, percent).alias("band"), F.lit(True).alias("small")))).otherwise(F.array().cast("array<struct<band:int,small:boolean>>"))
    roles = F.concat(own, F.transform(bands, lambda b: F.struct(b.alias("band"), F.lit(False).alias("small"))))
    return lists.select("*", F.explode(roles).alias("x")).select(*[F.col(c) for c in lists.columns], "x.band", "x.small")


def _met(entries: DataFrame, cell: list[str], percent: int) -> DataFrame:
    """The pairs ``a, b`` (a < b) that meet in a cell, in different components, and fit by size and ranks."""
    x, y = ({c: F.col(c + tail) for c in ("cls", "n", "m", "r", "label")} for tail in ("", "_"))
    small = entries.where("small").select(*cell, *x)
    large = entries.where("not small").select(*cell, *[F.col(c).alias(f"{c}_") for c in x])
    need = _overlap(x["n"], y["n"], percent)
    fits = (x["n"] * 100 >= y["n"] * percent) & (x["r"] + need <= x["m"] + 1) & (y["r"] + need <= y["m"] + 1)
    ordered = (x["n"] < y["n"]) | ((x["n"] == y["n"]) & (x["cls"] < y["cls"]))
    both = small.join(large, cell).where(ordered & fits & (x["label"] != y["label"]))
    return both.select(F.least("cls", "cls_").alias("a"), F.greatest("cls", "cls_").alias("b")).distinct()


def _rated(entries: DataFrame, cell: list[str]) -> DataFrame:
    """``cell, size, pairs`` of the cells in which entries of different components meet."""
    s, p = F.count_if(F.col("small")), F.count_if(~F.col("small"))
    by_label = entries.groupBy(*cell, "label").agg(s.alias("s"), p.alias("p"))
    sums = by_label.groupBy(*cell).agg(F.sum("s").alias("s"), F.sum("p").alias("p"), F.sum(F.col("s") * F.col("p")).alias("same"))
    return sums.select(*cell, (F.col("s") + F.col("p")).alias("size"), (F.col("s") * F.col("p") - F.col("same")).alias("pairs")).where("pairs > 0")


def _with_partner(lows: DataFrame, percent: int) -> DataFrame:
    """The ``row``s of ``row, n, low`` that another of them could link with: not those with enough tokens of their own.

    ``row`` follows ``token`` in the shuffled rows, so that the bytes that differ are next to each other.
    """
    counted = lows.select(F.explode("low").alias("token"), "row").groupBy("token").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("c"))
    alone = counted.where("c = 1").groupBy("row").agg(F.count(F.lit(1)).alias("own"))
    left = lows.select("row", "n").join(alone, "row", "left")
    return left.where((F.col("n") > 0) & (F.coalesce("own", F.lit(0)) < prefix_size(F.col("n"), percent))).select("row")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar. ``pairs`` are distinct and durable. ``sets`` has ``cls, n, tokens``;
    tokens of one class only may be missing there, as they are in no intersection. Only the sets of the pairs move."""
    asked = small(durable(pairs.select(F.col("a").alias("cls")).distinct()), SMALL_ROWS)
    left = sets.join(asked, "cls", "left_semi").select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = right.join(small(pairs.select("a", "b"), SMALL_ROWS), "b").join(left, "a")
    shared = F.size(F.array_intersect("ta", "tb")).cast("long")
    return both.where(shared * 100 >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b")


def _combinations(entries: DataFrame) -> DataFrame:
    """The entries of each class by all combinations of two tokens of one band and side: ``token, second, band``.

    The rank is that of the later token: both are within the extended prefix.
    """
    other = entries.select(*[F.col(c).alias(f"{c}2") for c in ("cls", "band", "small")], F.col("token").alias("second"), F.col("r").alias("r2"))
    same = (F.col("cls") == F.col("cls2")) & (F.col("band") == F.col("band2")) & (F.col("small") == F.col("small2"))
    both = entries.join(other, same & (F.col("token") < F.col("second")))
    return both.select("token", "second", "band", "small", "cls", "n", "m", F.greatest("r", "r2").alias("r"), "label")


class _Links:
    """The links found so far, and the component of each class by them: worked out anew only when there are new ones."""

    def __init__(self) -> None:
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None

    def add(self, found: DataFrame) -> None:
        found = durable(found)
        if found.limit(1).count():
            self.links = found if self.links is None else self.links.unionByName(found)
            self.labels = durable(components(self.links))

    def label(self, lists: DataFrame) -> DataFrame:
        """``lists`` plus ``label``: the component of ``cls``, or the class itself."""
        if self.labels is None:
            return lists.withColumn("label", F.col("cls"))
        return lists.join(small(self.labels, SMALL_ROWS), F.col("cls") == F.col("node"), "left").withColumn("label", F.coalesce("label", "cls")).drop("node")


def jaccard_join(
    df: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    row: str | None = None,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    probe: float = PROBE,
    rare_pairs: int = RARE_PAIRS,
    pivot_rounds: int = PIVOT_ROUNDS,
) -> DataFrame:
    """One row a row of ``df``: the key, ``n_shingles``, ``component_id`` (the least key that links reach, itself
    included), ``row`` (a number of the row within its input) and ``component`` (a row number that is the same for all
    rows of a component, and for no others).

    Numbers, keys and texts are stored together and read from there, so ``df`` is read once, and its split into
    partitions doesn't matter. If ``df`` is stored with unique row numbers already, ``row`` names their column, and
    ``row`` of the result has these numbers. A null or empty text, or one of white space, has an empty set and links with nothing. Repeated rows link. Null keys are not the least of
    any component, unless all of it are null. Other columns are ignored; an empty table gives an empty result.
    Whole texts are read. A third of all rows may be copies, or share passages: copies are one class, and lists are
    aggregated per task or joined in a way that can be split.
    """
    if percent < 2 * (100 - percent):
        raise ValueError("percent must be 67 or more: below, different sets can link by one token")
    with scratch(df.sparkSession):
        docs = numbered(df, row, key=F.col(key), text=F.col(text))
        out = _join(docs, shingle, percent, probe, rare_pairs, pivot_rounds)
    return out.withColumnRenamed("key", key)


def _join(docs: DataFrame, shingle: int, percent: int, probe: float, rare_pairs: int, pivot_rounds: int) -> DataFrame:
    """:func:`jaccard_join` for ``row, key, text``. The result reads three kept tables, and no other."""
    tokens, n = F.col("tokens"), F.size("tokens").cast("long")
    under = int(-(2**63) + probe * 2**64)
    low = F.transform(F.filter(tokens, lambda t: t < under), lambda t: t.bitwiseAND(-(1 << (64 - PROBE_BITS))))
    base = durable(_sets(docs, shingle).select("row", "key", n.alias("n"), F.xxhash64(tokens).alias("k1"), F.xxhash64(F.lit(1), tokens).alias("k2"), low.alias("low")))
    rows = durable(base.drop("low"), keep=True)

    # 1. texts with p tokens of their own
    rest = durable(_with_partner(base, percent))
    # 2. classes of equal sets, by size and 128 bits of hash; the first row stands for each
    classes = durable(rows.join(small(rest, SMALL_ROWS), "row", "left_semi").groupBy("n", "k1", "k2").agg(F.min("row").alias("cls")))
    firsts = small(classes.select(F.col("cls").alias("row")), SMALL_ROWS)
    unsettled = durable(_with_partner(base.join(firsts, "row", "left_semi"), percent))
    discard(base)
    texts = docs.join(small(unsettled, SMALL_ROWS), "row", "left_semi")
    full = durable(_sets(texts, shingle).select(F.col("row").alias("cls"), n.alias("n"), "tokens"))
    discard(docs)

    # 3. prefixes by rarity; tokens of one class alone come first in that order and need no list
    each = full.select(F.explode("tokens").alias("token"), "cls")
    common = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = each.join(common, "token")
    by_class = Window.partitionBy("cls")
    shared = shared.withColumn("rank", F.row_number().over(by_class.orderBy("df", "token"))).withColumn("m", F.count(F.lit(1)).over(by_class))
    gathered = shared.groupBy("cls").agg(F.collect_list(F.struct("rank", "token")).alias("x"), F.max("m").alias("m")).join(small(full.select("cls", "n"), SMALL_ROWS), "cls")
    free = prefix_size(F.col("n"), percent) - (F.col("n") - F.col("m"))  # prefix places left for shared tokens
    sets = gathered.where(free > 0).select("cls", "n", F.sort_array("x")["token"].alias("tokens"), free.cast("int").alias("places"), (F.col("m") / F.col("n")).alias("central"))
    sets = durable(sets)
    discard(full)
    # 4. cells; every class is a component of its own so far
    lists = sets.select("cls", "n", F.size("tokens").alias("m"), "central", F.posexplode(F.slice("tokens", F.lit(1), F.col("places") + 1)).alias("r", "token"))
    cell = ["token", "band"]
    entries = durable(_cells(lists, percent).withColumn("label", F.col("cls")))
    is_rare = F.col("pairs") <= rare_pairs * F.col("size")
    dealt = durable(entries.join(_rated(entries, cell).select(*cell, is_rare.alias("rare")), cell))
    discard(entries)
    links, tested = _Links(), None

    def check(pairs: DataFrame) -> bool:
        """Verify the pairs that are new; whether there were any."""
        nonlocal tested
        pairs = durable(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        if pairs.limit(1).count() == 0:
            return False
        tested = pairs if tested is None else tested.unionByName(pairs)
        links.add(_verify(pairs, sets, percent))
        return True

    # 5. rare tokens singly
    check(_met(dealt.where("rare"), cell, percent))

    # 6. frequent tokens: early links, then single cells that have become rare, and combinations of two
    often = durable(links.label(dealt.where("not rare").drop("label", "rare")))
    discard(dealt)
    left = often.count()
    for turn in range(pivot_rounds):
        if left == 0:
            break
        # the first pivot is the class with the most shared tokens; later ones come from a random component
        by = [F.lit(0) if turn == 0 else F.xxhash64(F.lit(turn), "label"), F.col("central"), -F.col("cls")]
        pivots = often.where("small").groupBy(*cell).agg(F.max_by(F.struct("cls", "n", "m", "label"), F.struct(*by)).alias("p"))
        need = _overlap(F.col("n"), F.col("p.n"), percent)
        alike = (F.col("n") * 100 >= F.col("p.n") * percent) & (F.col("p.n") * 100 >= F.col("n") * percent) & (need <= F.col("m")) & (need <= F.col("p.m"))
        pairs = often.join(pivots, cell).where((F.col("label") != F.col("p.label")) & alike)
        if not check(pairs.select(F.least("cls", "p.cls").alias("a"), F.greatest("cls", "p.cls").alias("b")).distinct()):
            break
        now = links.label(often.drop("label"))
        now = durable(now.join(_rated(now, cell).select(*cell), cell, "left_semi"))
        before, left, often = left, now.count(), now
        if left > before / 2:
            break
    if left:
        rated = _rated(often, cell)
        often = often.join(rated, cell)
        check(_met(often.where(is_rare), cell, percent))
        two = durable(_combinations(links.label(often.where(~is_rare).drop("label"))))
        check(_met(two, ["token", "second", "band"], percent))

    # component of each class, least key of each component
    named = links.label(classes).withColumn("cls", F.col("label")).drop("label")
    # empty sets are in no class
    keyed = durable(rows.groupBy("n", "k1", "k2").agg(F.min("key").alias("least")).join(named, ["n", "k1", "k2"]), keep=True)
    # both sides are stored, so that the classes of a large component can be split where the least keys are too many
    least = durable(keyed.groupBy("cls").agg(F.min("least").alias("component_id")), keep=True)
    of_class = keyed.join(small(least, SMALL_ROWS), "cls").select("n", "k1", "k2", "component_id", F.col("cls").alias("component"))
    out = rows.join(of_class, ["n", "k1", "k2"], "left")
    return out.select("key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"), "row", F.coalesce("component", "row").alias("component"))
