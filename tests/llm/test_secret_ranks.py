"""The battery and its false-discovery control against a plain version: which tokens are spans of kind random."""

import math
import re

import numpy as np
import pytest

from quartzgrid.llm import secrets

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets by the characters that a token may have, the first that fits holds.
KINDS = [
    ("[0-9]+", DIGITS), ("[0-9a-f]+", DIGITS + "abcdef"), ("[0-9A-F]+", DIGITS + "ABCDEF"), ("[A-Z]?[a-z]+", LOWER), ("[A-Z]+", UPPER), ("[A-Z2-7]+", UPPER + "234567"),
    ("[A-Z0-9]+", DIGITS + UPPER), ("[a-z0-9]+", DIGITS + LOWER), ("[A-Za-z0-9]+", UPPER + LOWER + DIGITS), ("[A-Za-z0-9+/]+", UPPER + LOWER + DIGITS + "+/"),
    ("[A-Za-z0-9_-]+", UPPER + LOWER + DIGITS + "-_"), (".*", UPPER + LOWER + DIGITS + "+/-_"),
]


def tail(z):
    return math.erfc(z / math.sqrt(2)) / 2


def both_tails(z):
    return min(1.0, 2 * tail(abs(z)))


def p_value(body, letters):
    """Chi-squared, runs and serial correlation of a token, combined by Fisher's method."""
    a, n = len(letters), len(body)
    x = [letters.find(c) + 1.0 for c in body]
    # a capital before lower-case letters is outside the alphabet, and has no cell of its own
    chi, free = max(sum(body.count(c) ** 2 for c in letters) * a / n - n, 0.0), a - 1.0
    even = tail(((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)))
    high = [v > a / 2 for v in x]
    h = sum(high)
    expected = 2 * h * (n - h) / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    seen = 1 + sum(p != q for p, q in zip(high, high[1:]))
    runs = both_tails((seen - expected) / math.sqrt(spread)) if spread > 0 else 0.0
    mean = sum(x) / n
    around = sum((v - mean) ** 2 for v in x)
    pairs = sum((p - mean) * (q - mean) for p, q in zip(x, x[1:]))
    serial = both_tails((pairs / around + 1 / n) * math.sqrt(n)) if around > 1e-9 else 0.0
    half = -sum(math.log(max(p, 1e-100)) for p in (even, runs, serial))
    return math.exp(-half) * (1 + half + half * half / 2)


def plain_random(texts, rate=0.05):
    """{(key, start, end)} of the tokens that are not dismissed."""
    found = []
    for key, text in texts:
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", text or ""):
            body = m[0].rstrip("=")
            kind = next(i for i, (p, _) in enumerate(KINDS) if re.fullmatch(p, body))
            score = -math.log10(max(p_value(body, KINDS[kind][1]), 1e-100)) * 50
            size = sum(len(body) >= c for c in (20, 24, 32, 48, 96))
            found.append(((key, m.start(), m.end()), (kind, size), min(5000, math.floor(score))))
    kept = set()
    for group in {g for _, g, _ in found}:
        own = sorted((b for _, g, b in found if g == group), reverse=True)
        passed = [b for b in set(own) if 10 ** (-b / 50) <= rate * sum(o >= b for o in own) / len(own)]
        # secrets are even in p; 15 bins hold the p values above a half, nearly
        secrets_of_all = (sum(o < 15 for o in own) + 1) / (1 - 10**-0.3)
        up_to = [b for b in set(own) if sum(o <= b for o in own) - secrets_of_all * (1 - 10 ** (-(b + 1) / 50)) <= rate * sum(o <= b for o in own)]
        kept |= {span for span, g, b in found if g == group and (not passed or b < min(passed)) and up_to and b <= max(up_to)}
    return kept


def planted(seed):
    """Random keys of many alphabets and sizes, and ordinary long names and lines."""
    rng = np.random.default_rng(seed)
    words = ["value", "count", "index", "table", "river", "stone", "number", "of", "the", "cloud", "winter", "paper"]
    alphabets = [DIGITS, DIGITS + "abcdef", LOWER, UPPER, UPPER + "234567", DIGITS + LOWER, UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_"]
    rows = [f"x {''.join(rng.choice(list(letters), n))}{'=' * (n % 3)} y" for letters in alphabets for n in (20, 25, 40, 64, 130) for _ in range(4)]
    names = [list(rng.choice(words, rng.integers(5, 14))) for _ in range(90)]
    rows += [f"see {'_'.join(w)} there" for w in names[:30]] + [f"see {''.join(x.title() for x in w)} there" for w in names[30:60]] + [f"see {''.join(w)}" for w in names[60:]]
    rows += ["-" * 60, "=" * 40, "ab" * 30 + "==", "a" * 5000, "0123456789" * 5, "", None, "two " + "Zq7" * 9 + " in " + "A" * 21 + "=="]
    return [(i, t) for i, t in enumerate(rows)] + [(0, rows[0]), (None, rows[1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_spans_are_those_of_the_plain_version(table, seed):
    texts = planted(seed)
    got = {(r["doc_id"], s["start"], s["end"]) for r in secrets.scan_secrets(table(texts)).collect() for s in r["spans"] if s["kind"] == 3}
    assert got == plain_random(texts)
    assert 100 < len(got) < 230


@pytest.mark.parametrize("keys", [0, 200])
def test_ordinary_names_are_a_small_share_of_what_is_reported(table, keys):
    """Names of many words overlap with random keys in their p values; what is reported is keys in the main."""
    rng = np.random.default_rng(9)
    syllables = [a + b for a in ("b", "c", "d", "g", "l", "m", "n", "p", "r", "s", "st", "t", "tr") for b in ("a", "e", "en", "er", "i", "in", "o", "on", "u")]
    words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(400)]
    names = ["".join(w.title() for w in rng.choice(words, rng.integers(4, 7))) for _ in range(1500)]
    names = [w for w in names if len(w) >= 20]
    random = ["".join(rng.choice(list(UPPER + LOWER + DIGITS), n)) for n in (24, 32, 40, 64) for _ in range(keys // 4)]
    rows = [(i, f"see {w} there") for i, w in enumerate(names + random)]
    got = [r["doc_id"] for r in secrets.scan_secrets(table(rows)).collect() if r["spans"]]
    false = sum(i < len(names) for i in got)
    assert false <= 0.01 * len(names)
    assert len(got) - false >= 0.85 * keys
