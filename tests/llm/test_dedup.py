"""Near-duplicates, line dedup, components and decontamination against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexigrove.llm import decontaminate, lines, simhash
from lexigrove.llm.components import components
from lexigrove.llm.edits import all_within, distance_within, few_edits, similar
from lexigrove.llm.scratch import Scratch

VOCABULARY = [f"w{i}" for i in range(300)]


def text(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def altered(rng, t):
    words = t.split(" ")
    words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    base = [text(rng, rng.choice([3, 40, 120])) for _ in range(40)]
    near = [altered(rng, t) for t in base[:20] for _ in range(3)]
    odd = [None, "", "  \n ", "One", "one", "a b c d", "Ünïcode É x y z", base[0], base[0], "ab " * 30_000]
    return list(enumerate(base + near + odd))


def frame(spark, rows):
    """documents with columns that clash with names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", *[F.lit(7).alias(c) for c in ("fp", "key", "component", "first", "line_no", "a", "b", "component_id", "fingerprint")])


def naive_fingerprint(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def united(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(spark, corpus):
    fps = [naive_fingerprint(t) for _, t in corpus]
    root = united(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    got = simhash.near_duplicates(frame(spark, corpus)).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == [(i, f"{fps[i]:016x}", root[i]) for i in range(len(fps))]
    assert len(set(root)) < len(fps)


def test_close_pairs_are_all_found_once(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for x in list(fps):
        for k in (1, 2, 4, 5):
            fps.add(x ^ sum(1 << b for b in rng.sample(range(64), k)))
    signed = {x - (1 << 64) if x >> 63 else x for x in fps}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    got = [tuple(r) for r in simhash.close_pairs(df, 4, 7).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_simhash_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "same text here again"), (5, "same text here again"), (5, "same text here again"), (3, "same text here again"), (None, None), (9, "")]
    got = sorted(map(str, [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(frame(spark, rows)).collect()]))
    assert got == sorted(map(str, [(None, 3), (5, 3), (5, 3), (3, 3), (None, 9), (9, 9)]))
    kept = simhash.keep_one(frame(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [3, 9] and len(kept.columns) == 11
    assert simhash.near_duplicates(frame(spark, [])).count() == 0 and simhash.keep_one(frame(spark, [])).count() == 0


def test_majority_counts_long_runs():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * 2 + rng.integers(0, 2, 3000, dtype=np.uint64)
    counts = np.array([0, 1, 255, 256, 0, 2000, 488])
    want, at = [], 0
    for n in counts:
        part = [int(x) for x in h[at : at + n]]
        want.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in part) > len(part)))
        at += n
    assert simhash.majority(h, counts).tolist() == want


@pytest.mark.parametrize("last", [0, 15_000])
def test_components(spark, monkeypatch, last):
    monkeypatch.setattr("lexigrove.llm.components.LAST_EDGES", last)
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (500, 500)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    root = united(600, edges)
    got = {r["node"]: r["component"] for r in components(df, Scratch(spark, "t")).collect()}
    assert set(got) == {x for e in edges if e[0] != e[1] for x in e}
    assert len({(root[n], c) for n, c in got.items()}) == len({root[n] for n in got}) == len(set(got.values()))
    assert components(df.where("false"), Scratch(spark, "t")).count() == 0


def naive_lines(docs):
    occurrences = {}
    for i, t in docs:
        for n, line in enumerate((t or "").split("\n")):
            norm = lines.normalised(line)
            if norm:
                occurrences.setdefault(norm, []).append((i, n))
    norms = list(occurrences)
    long = [len(n.split()) >= lines.FEW for n in norms]
    root = united(len(norms), [(i, j) for i in range(len(norms)) for j in range(i) if long[i] and long[j] and similar(norms[i], norms[j], 0.8)])
    best = {}
    for k, n in enumerate(norms):
        best[root[k]] = min([best.get(root[k], min(occurrences[n])), *occurrences[n]])
    return {o: best[root[k]] for k, n in enumerate(norms) for o in occurrences[n]}


@pytest.mark.parametrize("chunk", [2, 2000])
def test_line_dedup(spark, monkeypatch, chunk):
    monkeypatch.setattr(lines, "CHUNK", chunk)
    rng = random.Random(11)
    base = [text(rng, rng.choice([4, 6, 30, 60])) for _ in range(30)]
    pool = base + [altered(rng, x) for x in base for _ in range(2)] + [x.upper() + "!" for x in base[:10]] + [" ".join(reversed(x.split())) for x in base[:10]]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(6)))) for i in range(60)] + [(100, None), (101, ""), (102, "\n\n"), (103, "w1 " * 20_000 + "\n" + base[5]), (104, "I love 你好世界再见朋友\nok\n \n..."), (105, "OK!\ni LOVE 你好世界再见朋友")]
    want = naive_lines(docs)
    got = lines.duplicate_lines(frame(spark, docs)).collect()
    assert {(r["doc_id"], r["line_no"]): (r["first_doc_id"], r["first_line_no"]) for r in got} == want
    assert all(r["kept"] == ((r["doc_id"], r["line_no"]) == want[r["doc_id"], r["line_no"]]) for r in got)
    cleaned = {r["doc_id"]: r["text"] for r in lines.clean(frame(spark, docs)).collect()}
    for i, t in docs:
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if want.get((i, n), (i, n)) == (i, n))
        assert cleaned[i] == kept
    assert lines.duplicate_lines(frame(spark, [])).count() == 0


def test_line_dedup_of_repeated_rows(spark):
    line = "one two three four five six"
    rows = [(1, line), (1, line), (None, line), (2, line + "\nother words stand here in line two")]
    got = {(r["doc_id"], r["line_no"]): r["kept"] for r in lines.duplicate_lines(frame(spark, rows)).collect()}
    assert got == {(None, 0): True, (1, 0): False, (2, 0): False, (2, 1): True}


def test_levenshtein_bound():
    rng = random.Random(2)

    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(2000):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randrange(15))) for _ in range(2))
        if rng.random() < 0.5:
            b = a[:6] + b
        most = rng.randrange(12)
        assert distance_within(a, b, most) == (full(a, b) <= most) == all_within([(a, b, most)])[0]
        assert not few_edits(a.split(), b.split(), most) or full(" ".join(a.split()), " ".join(b.split())) <= most


def test_many_distances_at_once():
    rng = random.Random(4)
    pairs = []
    for n in [1, 5, 63, 64, 65, 128, 129, 400] * 60:
        a = [rng.choice("abcdé中") for _ in range(n)]
        b = list(a)
        for _ in range(rng.randrange(max(2, n // 3))):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice("abc") * rng.randrange(2)
        pairs.append(("".join(a), "".join(b), n // 5))
    assert all_within(pairs) == [distance_within(*x) for x in pairs]


def test_decontamination(spark):
    rng = random.Random(13)
    items = [(i, text(rng, rng.choice([3, 5, 20, 33, 64, 65]))) for i in range(40)] + [(50, None), (51, ""), (1, text(rng, 20))]
    docs = [(i, text(rng, rng.choice([2, 50, 3000]))) for i in range(40)] + [(90, None), (91, "")]
    for n, (_, t) in enumerate(items[:40]):
        words = docs[n][1].split(" ")
        part = t.split(" ") if n % 3 else altered(rng, t).upper().split(" ")
        at = rng.randrange(len(words))
        docs[n] = (n, " ".join(words[:at] + part + words[at:]))
    docs.append((5, docs[5][1]))
    want = []
    for d, t in docs:
        own = decontaminate.shingles(decontaminate.words(t))
        for i, it in items:
            s = decontaminate.shingles(decontaminate.words(it))
            if s and (k := len(s & own)) >= 0.8 * len(s):
                want.append((d, i, k, len(s), k / len(s)))
    bench = spark.createDataFrame(items + items[:3], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.contained(frame(spark, docs), bench).collect()))
    assert got == sorted(want) and len(want) > 20
    left = decontaminate.clean(frame(spark, docs), bench)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(d for d, _ in docs if d not in {w[0] for w in want})
    assert decontaminate.contained(frame(spark, docs), bench.where("false")).count() == 0
    assert decontaminate.contained(frame(spark, []), bench).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 2)
    words = [f"{a} b{a} c{a} d{a} e{a} f{a}" for a in range(5)]
    got = decontaminate.contained(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), spark.createDataFrame(list(enumerate(words)), "item_id long, text string"))
    assert sorted(r["item_id"] for r in got.collect()) == [0, 1, 2, 3, 4]


def test_blocks_hold_the_bounds(spark, monkeypatch):
    """Each block is within both bounds or one item; every item is in one block; a long one stands alone."""
    monkeypatch.setattr(decontaminate, "BLOCK", 7)
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 400)
    rows = [(i, f"item {i} " * (1 + i % 9)) for i in range(100)] + [(200, "z" * 5000), (201, None), (3, "item 3 " * 4)]
    items, parts = decontaminate._blocks(spark.createDataFrame(rows, "item_id long, text string"), Scratch(spark, "t"))
    blocks = {}
    for r in items.collect():
        blocks.setdefault(r["block"], []).append(r)
    assert sorted(r["item_id"] for b in blocks.values() for r in b) == [*range(100), 200] and max(blocks) < parts
    assert all(len(b) == 1 or len(b) <= 7 and sum(len(r["text"]) for r in b) <= 400 for b in blocks.values())
    words = [f"{a} b{a} c{a} d{a} e{a} f{a} g{a} h{a} i{a} j{a} k{a} l{a} m{a} n{a}" for a in range(30)]
    docs = spark.createDataFrame([(d, " ".join(words[d : d + 3])) for d in range(28)], "doc_id long, text string")
    got = decontaminate.contained(docs, spark.createDataFrame(list(enumerate(words)), "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(d, d + k) for d in range(28) for k in range(3)]


@pytest.mark.parametrize("shingles", [1, 8, 9, 16, 17, 40, 64, 65, 300])
def test_recall_by_size_of_item(spark, shingles):
    """Items of all sizes inside long documents, with as many shingles altered as still count, are all found."""
    rng = random.Random(shingles)
    fresh = lambda n: [f"q{rng.randrange(10**9)}" for _ in range(n)]
    items, docs = [], []
    for i in range(40):
        ws = fresh(shingles + 4)
        items.append((i, " ".join(ws)))
        gone = shingles // 5 if i % 2 else 0  # cut off at an end: as many shingles less
        part = ws[gone:] if i % 4 == 1 else ws[: len(ws) - gone]
        docs.append((i, " ".join(fresh(rng.randrange(3000)) + part + fresh(rng.randrange(3000)))))
    got = decontaminate.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(i, i) for i in range(40)]
