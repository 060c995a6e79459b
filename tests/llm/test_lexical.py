"""Ranked search against a score of every document for every query, and the packed numbers."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrove.llm import lexical

DOCS = "doc_id long, text string, score long, item_id long, term string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans(lexical.UPPER, lexical.LOWER)


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, queries, k=50):
    docs = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n_docs, tokens = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    asked = {}
    for item, text in queries:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in asked.items():
        found = []
        for i, c, n in docs:
            m = 50 + 50 * n * n_docs // tokens
            score = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in words if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(sorted(found)[:k], 1)]
    return out


def words(rng, n):
    return " ".join(f"{'W' if rng.random() < 0.2 else 'w'}{min(int(rng.zipf(1.3)), 400)}" for _ in range(n))


def corpus(n, seed=1):
    rng = np.random.default_rng(seed)
    return [(int(i), words(rng, int(rng.integers(1, 80)))) for i in rng.permutation(n)]


def held(spark, docs, queries, k=50, tokens=500, slices=3):
    found = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], DOCS).repartition(slices)
    asked = spark.createDataFrame([(i, t, 1) for i, t in queries], "item_id long, text string, doc_id long")
    got = lexical.search(lexical.build(found, shard_tokens=tokens), asked, k)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, queries, k), key=key)


@pytest.mark.parametrize(("k", "tokens"), [(50, 500), (3, 200), (1, 100_000)])
def test_as_brute_force(spark, k, tokens):
    rng = np.random.default_rng(9)
    held(spark, corpus(400), [(i, words(rng, int(rng.integers(1, 25)))) for i in range(30)], k, tokens)


def test_queries_in_groups_and_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERIES_AT_ONCE", 4)
    monkeypatch.setattr(lexical, "FEW", 10)
    rng = np.random.default_rng(10)
    held(spark, corpus(150, 2), [(i, words(rng, 8)) for i in range(15)], 5)


def test_edges(spark):
    docs = corpus(60, 3) + [(None, "w1 w2 w2"), (None, "w1 w2 w2"), (7, "w1"), (7, "w1"), (7, "w2"), (900, None), (901, ""), (902, "--- !"), (903, "w1 " * 5000), (-5, "Été ÉTÉ 漢字 ǅ İ w1_w2 w1 w2"), (904, "퟿\U0001f600 w3")]
    queries = [(1, "w1 W1 w2"), (1, "w3"), (None, "w1"), (None, "W2"), (2, None), (3, ""), (4, "unknown"), (5, "été ÉTÉ"), (6, "漢字 ǅ İ"), (7, "\U0001f600")]
    held(spark, docs, queries)
    held(spark, docs, queries, 2, 10)
    held(spark, docs * 3, [(1, "w1")], 7)


def test_equal_scores_go_by_doc_id(spark):
    held(spark, [(i, "same text") for i in range(120)] + [(1000 + i, "other words here") for i in range(300)], [(1, "same"), (2, "other text")], 50, 40)


def test_empty_tables(spark):
    held(spark, [], [(1, "w1")])
    held(spark, corpus(20), [])
    held(spark, [(1, None), (2, "..")], [(1, "w1")])
    held(spark, [(1, "everywhere"), (2, "everywhere")], [(1, "everywhere")])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**62)))
def test_numbers_come_back(numbers):
    data, end = lexical.packed(np.array(numbers, np.int64))
    assert lexical.unpacked(data.tobytes()).tolist() == numbers
    for i, n in enumerate(numbers):
        assert lexical.unpacked(data[end[i] : end[i + 1]].tobytes()).tolist() == [n]
