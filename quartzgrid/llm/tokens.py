"""Token counts of byte-level byte-pair encoding, by a heap of adjacent pairs and a linked list of symbols.

A word starts as its bytes. The adjacent pair of the lowest rank is popped again and again (the leftmost of equal
rank first), its two symbols become one, and the pairs with both neighbours are pushed. The count is the number
of bytes minus the number of merges; no token identifiers are made.
"""

from __future__ import annotations

import functools
import json
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

#: The published pre-tokenisation pattern of this family of byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers that Unicode 16.0 added to 15.1, as first and last code points (fixed values). The library's
#: classes are those of Unicode 16.0, while the classes of the regex module and of Python move with their releases.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: From here on some code points are unassigned in Unicode 16.0, so the classes of releases differ.
UNSURE = regex.compile("[\u0558-\U0010FFFF]")
#: Distinct words whose counts a Python worker remembers; then it starts anew. Longer words are not remembered.
CACHE_WORDS, CACHE_CHARS = 500_000, 64


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such a vocabulary: printable bytes for themselves, the rest in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranges(kind: str, added: tuple[tuple[int, int], ...]) -> str:
    """A regex class body: the code points of a kind (L, N) in Unicode 15.1, and the added ranges."""
    from unicodedata import category

    own = [cp for cp in range(0x110000) if category(chr(cp))[0] == kind]
    own = sorted({*own, *(cp for a, b in added for cp in range(a, b + 1))})
    runs: list[list[int]] = []
    for cp in own:
        if runs and runs[-1][1] == cp - 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


@functools.lru_cache(1)
def unicode_16_words() -> regex.Pattern:
    """:data:`PATTERN` with its classes spelled out as of Unicode 16.0."""
    letters, numbers = _ranges("L", LETTERS_16), _ranges("N", NUMBERS_16)
    pattern = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return regex.compile(pattern)


class TokenCounter:
    """Counts the tokens of whole texts for a vocabulary file of byte-level byte-pair encoding."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        letters = byte_letters()
        symbols = {letter: b for letter, b in letters.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made = symbols.setdefault(a + b, len(symbols))
            self.merges.setdefault((symbols[a], symbols[b]), (rank, made))
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
        self.words = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def word(self, data: bytes) -> int:
        """The number of symbols that are left of one word."""
        n = left = len(data)
        symbol, following, before = list(data), list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        heap = [(merges[pair][0], i) for i, pair in enumerate(zip(data, data[1:], strict=False)) if pair in merges]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = following[i]
            if symbol[i] < 0 or j >= n:
                continue
            found = merges.get((symbol[i], symbol[j]))
            if found is None or found[0] != rank:  # the pair has changed since it was pushed
                continue
            symbol[i], symbol[j] = found[1], -1
            left -= 1
            k = following[i] = following[j]
            if k < n:
                before[k] = i
                if (new := merges.get((symbol[i], symbol[k]))) is not None:
                    heappush(heap, (new[0], i))
            h = before[i]
            if h >= 0 and (new := merges.get((symbol[h], symbol[i]))) is not None:
                heappush(heap, (new[0], h))
        return left

    def _plain(self, text: str) -> int:
        total, known = 0, self.known
        words = self.words if text.isascii() or UNSURE.search(text) is None else unicode_16_words()
        for word, times in Counter(words.findall(text)).items():
            n = known.get(word)
            if n is None:
                n = self.word(word.encode())
                if len(word) <= CACHE_CHARS:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[word] = n
            total += n * times
        return total

    def count(self, text: str | None) -> int:
        """Tokens of a whole text (null: 0). Special strings in it are one token each, as the library has it."""
        if not text:
            return 0
        if self.special is None or self.special.search(text) is None:
            return self._plain(text)
        return sum(map(self._plain, self.special.split(text))) + len(self.special.findall(text))


@functools.lru_cache(4)
def load(path: str) -> TokenCounter:
    """One counter a Python worker and file."""
    return TokenCounter(path)


def token_count(text: Column, path: str) -> Column:
    """The number of tokens of each text; ``path`` is a vocabulary file that every worker has. Row by row, no shuffle."""

    @F.pandas_udf("long")
    def count(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = load(path)
        for texts in series:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return count(text)


def count_tokens(df: DataFrame, path: str, *, text: str = "text", limit: int = 1024) -> DataFrame:
    """``df`` plus ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Input columns of these names are replaced. A null text counts as empty; no text is cut. Repeated rows are
    counted each; an empty table gives an empty result.
    """
    ship(df.sparkSession)
    df = df.drop(*[c for c in df.columns if c.lower() in ("n_bytes", "n_tokens", "over_limit")])
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return df.withColumn("n_tokens", token_count(F.col(text), path)).select(*[F.col(f"`{c}`") for c in df.columns], n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
