"""The queries of language identification against a plain version of the whole fusion."""

import math
import re
from collections import Counter, defaultdict
from urllib.parse import urlsplit

import pytest

from quartzgrid.llm import queries

BUCKETS, UND = 2**14, "und"


def folded(text):
    raw = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in (text or "").encode())
    return b" " + raw + b"  "


def grams(text):
    data = folded(text)
    return Counter((((data[i] << 16) + (data[i + 1] << 8) + data[i + 2]) * 2654435761 % 2**32) >> 18 for i in range(len(data) - 2))


def fitted(rows):
    """{language: function from bucket to log probability}, und last, from (key, text, language)."""
    of = defaultdict(set)
    counts = Counter(lang.lower() for _, text, lang in rows if lang and text is not None)
    for key, text, lang in rows:
        if lang and text is not None:
            of[lang.lower()].add((key, text))
    out = {}
    for lang in sorted(x for x in of if counts[x] >= 5):
        c = Counter()
        for _, text in of[lang]:
            c.update(grams(text))
        total = sum(c.values()) + 0.1 * BUCKETS
        out[lang] = {b: math.log((c[b] + 0.1) / total) for b in range(BUCKETS)}
    return out | {UND: dict.fromkeys(range(BUCKETS), -math.log(BUCKETS))}


def fuse(model, rows):
    """[(winner, posterior, accepted, winner by text)] from (text, declared, host, suffix)."""
    names = list(model)
    scores = []
    for text, *_ in rows:
        g = grams(text)
        n = sum(g.values())
        scores.append([sum(model[x][b] * k for b, k in g.items()) * min(n, 200) / n for x in names])
    best = [s.index(max(s)) for s in scores]
    votes = lambda chosen: [sum(1 for i in chosen if best[i] == k) for k in range(len(names))]
    by_host, by_suffix = defaultdict(list), defaultdict(list)
    for i, (_, _, host, suffix) in enumerate(rows):
        by_host[host, suffix].append(i)
        by_suffix[suffix].append(i)
    whole = [(v + 1) / (len(rows) + len(names)) for v in votes(range(len(rows)))]
    whole[-1] = 1e-4
    out = []
    for i, (text, told, host, suffix) in enumerate(rows):
        up = [(v + 20 * w) / (len(by_suffix[suffix]) + 20) for v, w in zip(votes(by_suffix[suffix]), whole)]
        prior = [(v + 20 * u) / (len(by_host[host, suffix]) + 20) for v, u in zip(votes(by_host[host, suffix]), up)]
        prior[-1] = 1e-4
        say = [1.0 if told is None else 0.9 if told.lower() == x else 0.1 / (len(names) - 1) for x in names]
        total = [s + math.log(p) + math.log(q) for s, p, q in zip(scores[i], prior, say)]
        top = max(total)
        sure = 1 / sum(math.exp(t - top) for t in total)
        language = names[total.index(top)]
        if not any(c.isalpha() for c in text or ""):
            out.append((UND, 0.0, False, UND))
        else:
            out.append((language, sure, language != UND and sure >= 0.5, names[best[i]]))
    return out


def compare(got, want):
    assert got.keys() == want.keys()
    for k, (language, sure, accepted, by_text) in want.items():
        r = got[k]
        assert (r["language"], r["accepted"], r["text_language"]) == (language, accepted, by_text), k
        assert r["confidence"] == pytest.approx(sure, abs=1e-3), k


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()


def test_query_of_languages(spark, sf_dir, documents):
    model = fitted([(r["doc_id"], r["text"], r["lang"]) for r in documents])
    want = fuse(model, [(r["text"], r["lang"], r["source"], None) for r in documents])
    compare({r["doc_id"]: r for r in queries.op5_language(spark, sf_dir).collect()}, {r["doc_id"]: w for r, w in zip(documents, want)})


def test_query_of_pages(spark, sf_dir, documents):
    model = fitted([(r["doc_id"], r["text"], r["lang"]) for r in documents])
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    rows = []
    for p in pages:
        html = p["html"] or ""
        told = re.search(r"""<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", html, re.I)
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"<(script|style)\b.*?</\1>", " ", html, flags=re.I | re.S))
        host = urlsplit(p["url"] or "").hostname
        rows.append((plain, told and told[1], host, host and host.rsplit(".", 1)[-1]))
    compare({r["page_id"]: r for r in queries.language_of_pages(spark, sf_dir).collect()}, {p["page_id"]: w for p, w in zip(pages, fuse(model, rows))})
