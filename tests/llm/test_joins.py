"""Jaccard join, decontamination, repeats: against brute force."""

import random
import re

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quartzgrid.llm import components, decontamination, lpf, ngram_join, oracles, queries, substrings
from rows import same_rows


def docs_of(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


@pytest.mark.parametrize("options", [{}, {"pivot_rounds": 0, "rare_pairs": 0}, {"pivot_rounds": 1, "rare_pairs": 0, "probe": 0.05, "percent": 67}])
def test_jaccard(table, prose, options):
    got = ngram_join.jaccard_join(table(prose), **options).collect()
    want = brute.jaccard(prose, options.get("percent", 80))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    parts = {}
    for r in got:
        assert parts.setdefault(r["component"], r["component_id"]) == r["component_id"] or r["n_shingles"] == 0
    assert len(parts) == len({k for _, _, k in want})


def test_jaccard_of_a_large_group(table):
    """Near copies that are not all linked to each other, and boilerplate that links nothing."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(80)]
    docs = []
    for i in range(70):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    docs += [(100 + i, " ".join(base[:20] + [f"y{rng.randrange(10**6)}" for _ in range(12)])) for i in range(60)]
    for options in ({}, {"pivot_rounds": 0, "rare_pairs": 2}):
        got = ngram_join.jaccard_join(table(docs), **options).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute.jaccard(docs)


def test_combinations_find_links_that_single_tokens_and_pivots_leave(table, monkeypatch):
    """Chains of texts: each links with the next one alone, and its tokens live in many texts of the chain."""
    rng = random.Random(5)
    docs = []
    for chain in range(4):
        w = [f"c{chain}w{i}" for i in range(120)]
        for i in range(40):
            for _ in range(2):
                w[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
            docs.append((100 * chain + i, " ".join(w)))
    df, seen = table(docs), []

    def spied(entries):
        out = made(entries)
        seen.append(out.count())
        return out if whole else out.limit(0)

    made = ngram_join._combinations
    monkeypatch.setattr(ngram_join, "_combinations", spied)
    found = lambda: sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_join(df, rare_pairs=0, pivot_rounds=1).collect())
    whole = True
    assert found() == brute.jaccard(docs) and seen[0] > 0
    whole = False
    assert found() != brute.jaccard(docs)


def test_cells_grow_with_the_input(table):
    """Five times the groups of near copies: the index has about five times the entries."""

    def entries(groups):
        rng = random.Random(2)
        docs = []
        for g in range(groups):
            base = [f"g{g}w{i}" for i in range(100)]
            for i in range(12):
                w = list(base)
                for _ in range(i % 4):
                    w[rng.randrange(100)] = f"x{rng.randrange(10**7)}"
                docs.append((100 * g + i, " ".join(w)))
        made = []
        cells = ngram_join._cells

        def spied(lists, percent):
            out = cells(lists, percent)
            made.append(out.count())
            return out

        with pytest.MonkeyPatch.context() as m:
            m.setattr(ngram_join, "_cells", spied)
            ngram_join.jaccard_join(table(docs))
        return made[0]

    few, many = entries(4), entries(20)
    assert 3 * few < many < 7 * few


def test_jaccard_edges(table):
    with pytest.raises(ValueError):
        ngram_join.jaccard_join(table([]), percent=66)
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (1, "A B C D E F"), (None, "a b c d e f"), (9, None), (8, ""), (7, " \n"), (6, "one two"), (5, "ONE two"), (4, "one")]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_join(table(rows)).collect())
    assert got == [(0, 2, 1), (1, 2, 1), (3, 2, 1), (3, 2, 1), (4, 1, 4), (5, 1, 5), (6, 1, 5), (7, 0, 7), (8, 0, 8), (9, 0, 9)]
    assert ngram_join.jaccard_join(table([])).collect() == []


def test_query_of_jaccard(spark, sf_dir, duck):
    out = queries.op2_jaccard(spark, sf_dir).toPandas()
    assert not same_rows(out, duck.execute(oracles.JACCARD).df())
    got = spark.createDataFrame(out).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute.jaccard(docs_of(spark, sf_dir))


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (5, 6), (6, 5)]
    least = {n: n for link in links for n in link}
    for _ in range(300):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: least[n] for n in linked}


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"), (2, "short item"), (10, "Short  ITEM!"), (3, "x"), (4, ""), (5, None), (6, "...")]


def test_decontaminate(table, spark):
    body = "pi rho sigma tau upsilon phi chi psi omega "
    rows = [
        (1, body + ITEMS[0][1] + " " + body), (2, body + "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " + body), (3, "a short, item here " * 2), (4, body * 60 + ITEMS[0][1]),
        (5, None), (6, ""), (7, "X"), (7, "X"), (None, "x y"), (8, "ÉX x"), (9, "SHORT-ITEM short short item item"), (10, "the " + ITEMS[0][1].upper() + " mu nu xi"),
    ]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontamination.decontaminate(table(rows), items).collect()
    same = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(same((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"])) for r in got) == sorted(map(same, brute.decontaminate(rows, ITEMS)))
    none = decontamination.decontaminate(table(rows), items.limit(0)).collect()
    assert len(none) == len(rows) and not any(r["n_hit"] for r in none)
    assert decontamination.decontaminate(table([]), items).collect() == []


def test_decontaminate_by_shuffle(table, spark, monkeypatch):
    """Beyond the bound nothing of the benchmark is broadcast, and no words go along with the positions."""
    monkeypatch.setattr(decontamination, "SMALL_WINDOWS", 0)
    plans, write = {}, decontamination.durable

    def spied(df):
        plans[tuple(df.columns)] = df._jdf.queryExecution().executedPlan().toString()
        return write(df)

    monkeypatch.setattr(decontamination, "durable", spied)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        long = " ".join(f"v{i}" for i in range(3000))
        rows = [(i, ITEMS[0][1] if i % 3 else "other words") for i in range(20)] + [(30, f"{long} {ITEMS[0][1]} {long}"), (31, None), (32, "x short item")]
        got = decontamination.decontaminate(table(rows), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got) == brute.decontaminate(rows, ITEMS)
    lines = [x.strip(" :+-") for x in plans["row", "x"].splitlines()]
    assert any(x.startswith("SortMergeJoin [shingle") for x in lines) and not any(x.startswith("Broadcast") for x in lines)
    at = next(i for i, x in enumerate(lines) if x.startswith("Exchange hashpartitioning(shingle"))
    sent = next(x for x in lines[at:] if x.startswith("Project"))
    assert "shingle#" in sent and not re.search(r"[\[ ]words#\d+[,\]]", sent)


def test_decontaminate_with_clashing_names(table, spark):
    """Columns of either side that are called like working columns change nothing."""
    items = spark.createDataFrame([(*x, "a", 1, 2, 3) for x in ITEMS], "item_id long, text string, window string, row int, words int, size int")
    rows = [(1, ITEMS[0][1]), (2, "none")]
    got = decontamination.decontaminate(table(rows).withColumn("words", F.lit(1)).withColumn("pos", F.lit(1)), items).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got) == brute.decontaminate(rows, ITEMS)


def test_query_of_decontamination(spark, sf_dir, duck):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = [(d, w, h, len(i), brute.sha(",".join(i)), c) for d, w, h, i, c in brute.decontaminate(docs_of(spark, sf_dir), items)]
    out = queries.op8_decontamination(spark, sf_dir).toPandas()
    assert not same_rows(out, duck.execute(oracles.DECONTAMINATION).df())
    got = spark.createDataFrame(out).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(w[5] for w in want)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab", min_size=1, max_size=60).map(str.encode), st.integers(0, 3))
def test_factors(data, copies):
    data = data + data[: len(data) // 2] * copies
    before, after = lpf.factors(np.frombuffer(data, np.uint8), 64)

    def common(i, j):
        k = 0
        while max(i, j) + k < len(data) and data[i + k] == data[j + k]:
            k += 1
        return min(k, 64)

    for i in range(len(data)):
        assert min(64, before[i]) == max((common(i, j) for j in range(i)), default=0)
        assert min(64, after[i]) == max((common(i, j) for j in range(i + 1, len(data))), default=0)


def test_anchors_own_every_window():
    rng = np.random.default_rng(2)
    for n in (0, 39, 40, 41, 500):
        data = rng.integers(97, 100, n, dtype=np.uint8)
        at, _, first, last = lpf.anchors(data, 40, 8)
        starts = [s for a, b in zip(first, last, strict=True) for s in range(a, b + 1)]
        assert starts == list(range(max(0, n - 39)))
        assert ((at >= last) & (at + 8 <= first + 40)).all()


@pytest.mark.parametrize("options", [{}, {"most_regions": 1}, {"keep_first": True}, {"keep_first": True, "most_regions": 1}])
def test_repeats(table, prose, options):
    rows = [*prose, (2000, "ab" * 300), (2001, "ab" * 40), (2002, "é" * 90), (2003, "é" * 30), (2004, "long " * 2000)]
    df = table(rows, 1)
    order = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = brute.repeats(order, 60, options.get("keep_first", False))
    out = substrings.remove_repeats(df, window=60, gram=16, **options)
    got = out.select("doc_id", "n_bytes", "n_removed", F.size("removed"), "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(w[2] for w in want)
    assert all(brute.sha(bytes(r["kept"])) == r["kept_sha256"] for r in out.where("kept is not null").collect())


def test_repeats_in_pieces(table, prose, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 64)
    raw = ("abcdefghij" * 40 + "xyz").encode()
    columns, later = substrings._text_anchors(raw, 60, 16)
    starts = [s for a, b in [*zip(columns[3], columns[4], strict=True), *later.tolist()] for s in range(a, b + 1)]
    assert sorted(starts) == list(range(len(raw) - 59))


def test_repeats_edges(table):
    rows = [(1, None), (2, ""), (None, "q" * 500), (3, "q" * 399), (4, "z" * 400), (4, "z" * 400)]
    got = substrings.remove_repeats(table(rows)).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in got) == [(0, 500, 500), (1, 0, 0), (2, 0, 0), (3, 399, 0), (4, 400, 400), (4, 400, 400)]
    assert substrings.remove_repeats(table([])).collect() == []


def colliding_texts():
    """Two texts of 600 bytes whose windows all differ, but whose rolling sums modulo 2^64 are the same."""
    p = np.array([1], dtype=object)
    for e in (1, 2, 4, 8, 16, 32, 64, 3, 6, 12, 24, 5, 10, 7, 384):
        p = np.convolve(p, np.array([-1, *[0] * (e - 1), 1], dtype=object))
    one = np.random.default_rng(20).integers(105, 114, 600)
    other = one.copy()
    other[10 : 10 + len(p)] += p.astype(int)
    return [bytes(x.astype(np.uint8)).decode() for x in (one, other)]


@pytest.mark.parametrize("options", [{}, {"most_regions": 1}])
def test_repeats_of_colliding_texts(table, options):
    texts = colliding_texts()
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    whole = [int(lpf.Rolling(d).hashes(np.array([0]), np.array([600]))[0]) for d in data]
    marks = [lpf.anchors(d, 400, 64) for d in data]
    assert whole[0] == whole[1] and len(marks[0][0]) == len(marks[1][0]) == 1 and marks[0][1] == marks[1][1]
    rows = [(1, texts[0]), (2, texts[1]), (3, "q" * 200 + texts[1][:450])]
    got = substrings.remove_repeats(table(rows), **options).select("doc_id", "n_bytes", "n_removed", F.size("removed"), "kept_sha256").collect()
    want = brute.repeats(rows, 400)
    assert sorted(map(tuple, got)) == want and [w[2] for w in want] == [0, 450, 450]


def test_passages(table, prose):
    rows = [*prose, (3000, "p " * 90), (3001, None), (3002, prose[0][1])]
    got = substrings.remove_repeats(table(rows), passage_words=20).collect()
    runs = lambda t: [tuple(w[i : i + 20]) for w in [brute.WORDS.findall(t or "")] for i in range(len(w) - 19)]
    own = [(d, t, set(runs(t))) for d, t in rows]
    count = {}
    for _, _, s in own:
        for r in s:
            count[r] = count.get(r, 0) + 1
    want = sorted((d, any(count[r] > 1 for r in runs(t))) for d, t, _ in own)
    assert sorted((r["doc_id"], r["shares_passage"]) for r in got) == want and {x for _, x in want} == {False, True}
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == sorted((r["doc_id"], r["n_removed"]) for r in substrings.remove_repeats(table(rows)).collect())
    assert substrings.remove_repeats(table([]), passage_words=20).collect() == []


def test_query_of_repeats(spark, sf_dir, duck):
    out = queries.op10_repeats(spark, sf_dir).toPandas()
    assert not same_rows(out, duck.execute(oracles.REPEATS).df())
    got = spark.createDataFrame(out).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute.repeats(docs_of(spark, sf_dir), 400))
