"""Plain versions of the operators, for small inputs: no Spark, no shared code."""

from __future__ import annotations

import hashlib
import re

WORDS = re.compile("[^\x20\x09-\x0d]+")
PLAIN_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def jaccard(docs, percent=80):
    """[(key, set size, least key of its component)] for distinct keys."""
    sets = {}
    for key, text in docs:
        w = WORDS.findall(lower(text))
        sets[key] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    least = {k: k for k in sets}
    keys = sorted(sets)
    links = []
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                links.append((a, b))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return [(k, len(sets[k]), least[k]) for k in keys]


def decontaminate(docs, items, window=13):
    """[(key, words, hit words, item ids, contaminated)] in the order of docs."""
    windows = {}
    for item, text in items:
        w = PLAIN_WORDS.findall(lower(text))
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    out = []
    for key, text in docs:
        w, hit, ids = PLAIN_WORDS.findall(lower(text)), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if found := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    ids |= found
        out.append((key, len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return out


ASSIGN = re.compile(
    r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base_spans(text):
    """[(start, kind, end)] of the fixed patterns."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def repeats(docs, window, keep_first=False):
    """[(key, bytes, removed, spans, digest of the rest)] in the order of docs."""
    count, past, out = {}, set(), []
    for _, text in docs:
        raw = (text or "").encode()
        for i in range(len(raw) - window + 1):
            count[raw[i : i + window]] = count.get(raw[i : i + window], 0) + 1
    for key, text in docs:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - window + 1):
            w = raw[i : i + window]
            if (w in past) if keep_first else count[w] > 1:
                gone[i : i + window] = [True] * window
            past.add(w)
        rest = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(raw), sum(gone), spans, sha(rest)))
    return out


def mix(docs, weights=(1, 2, 3), most=3):
    """{source: (size, target)} by resharing the excess again and again."""
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(WORDS.findall(text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, open_, target = sum(sizes.values()), list(names), {}
    while open_:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > most * sizes[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = float(most * sizes[s])
        open_ = [s for s in open_ if s not in full]
    return {s: (sizes[s], target[s]) for s in names}
