"""Texts of over a million characters, among short ones, are read whole by the operators without Python workers."""

import random

import brute
import pytest

from quartzgrid.llm import chat, decontamination, mixing, secrets, sharding

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards watch"
KEY = "password = Xy7Lq0Pw9"


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(6)
    return " ".join(rng.choice(["river", "Stone", "cloud\n", "wörter", "x9"]) for _ in range(200_000)) + f" {ITEM} {KEY} end"


@pytest.fixture(scope="module")
def docs(table, long_text):
    return table([(1, long_text), (2, f"{KEY} here"), (3, ITEM), (4, "")])


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_sizes(docs, long_text):
    sharded = by_id(sharding.shard_records(docs, 2))
    assert sharded[1]["size"] == len(long_text.encode()) + 1 and sharded[1]["text"] == long_text
    assert by_id(mixing.mix_sources(docs))[1]["size"] == len(brute.WORDS.findall(long_text)) > 200_000


def test_secrets_at_the_end(docs, long_text):
    spans = [(s["start"], s["kind"], s["end"]) for s in by_id(secrets.scan_secrets(docs))[1]["spans"]]
    assert spans == brute.base_spans(long_text) and spans[0][0] > 1_000_000


def test_benchmark_words_at_the_end(docs, long_text, spark):
    items = spark.createDataFrame([(9, ITEM)], "item_id long, text string")
    got = by_id(decontamination.decontaminate(docs, items))
    for key, words, hit, ids, contaminated in brute.decontaminate([(1, long_text), (3, ITEM), (4, "")], [(9, ITEM)]):
        r = got[key]
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (words, hit, ids, contaminated)
    assert got[1]["n_hit"] == 13 and not got[1]["contaminated"] and got[3]["contaminated"]


def test_chat_of_long_turns(spark, long_text):
    rows = [(1, 0, "user", long_text), (1, 1, "assistant", long_text[::-1])]
    back = chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert [(t["role"], t["text"]) for t in back[0]["turns"]] == [r[2:] for r in rows] and back[0]["loss_text"] == rows[1][3]
