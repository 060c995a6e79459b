"""Vector codes against a plain restatement in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from lexigrove.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [math.floor(float(np.float32(x)) * scale) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], None
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v, p: min((far(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        groups = [[[] for _ in books[p]] for p in range(parts)]
        for _, v, _ in kept:
            for p in range(parts):
                groups[p][best(v, p)[1]].append(cut(v, p))
        books = [[[sum(x) // len(g) for x in zip(*g, strict=True)] if g else books[p][e] for e, g in enumerate(groups[p])] for p in range(parts)]
    out, by = [], {}
    for i, v, lab in kept:
        found = [best(v, p) for p in range(parts)]
        error = sum(d for d, _ in found)
        by[lab] = by.get(lab, 0) + error
        out.append([i, "".join(f"{e:02x}" for _, e in found), error, lab])
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(i, code, error, by[lab]) for i, code, error, lab in out], sha


def vectors(n, seed=3, width=16):
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(0, 0.3, width).astype(np.float32).tolist(), int(rng.integers(0, 3)) if rng.random() < 0.8 else None) for i in rng.permutation(n)]
    return rows


def ran(spark, rows):
    df = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], SCHEMA).repartition(5)
    found = vector_codes.compress(df)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return found.collect()


def held(spark, rows):
    found = ran(spark, rows)
    want, sha = brute(rows)
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted([tuple(r)[:4] for r in found], key=key) == sorted(want, key=key)
    assert {r["codebooks_sha256"] for r in found} == ({sha} if want else set())


def test_as_brute_force(spark):
    rows = vectors(300)
    rows += [(1000, rows[0][1], 1)] * 40 + [(1001, None, 1), (1002, [None] * 16, 2), (1003, [math.nan] + [0.0] * 15, 0), (1004, [math.inf] + [0.0] * 15, 0), (1005, [-math.inf] * 16, None)]
    held(spark, rows)


def test_repeated_and_null_ids(spark):
    rows = [(5, v, lab) for _, v, lab in vectors(25, 4)] + [(None, v, lab) for _, v, lab in vectors(8, 5)] + vectors(6, 6)
    held(spark, rows)


def test_few_and_no_rows(spark):
    held(spark, vectors(5, 7))
    held(spark, vectors(1, 8))
    assert ran(spark, []) == []
    assert ran(spark, [(1, None, 0), (2, [math.nan] * 16, 0)]) == []


def test_equal_vectors_and_short_parts(spark):
    held(spark, [(i, [0.25] * 8, i % 2) for i in range(40)])
    held(spark, [(i, [float(i % 3)] * 8, None) for i in range(40)])
    assert {tuple(r)[1:4] for r in ran(spark, [(i, [], 0) for i in range(3)])} == {("00" * 8, 0, 0)}


def test_search_drops_no_nearest_entry():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 8, 17):
        for spread in (2, 1000):
            book = rng.integers(-spread, spread, (16, width))
            x = rng.integers(-spread, spread, (width, 500))
            far = ((x.T[:, None, :] - book[None]) ** 2).sum(2)
            which, distance = vector_codes.nearest(x, book)
            assert (which == far.argmin(1)).all() and (distance == far.min(1)).all()


def test_lengths_that_do_not_fit_raise(spark):
    for rows in ([(1, [0.0] * 16, 0), (2, [0.0] * 8, 0)], [(1, [0.0] * 12, 0)], [(1, [1e9] * 8, 0)]):
        with pytest.raises(Exception, match="length|beyond"):
            ran(spark, rows)


def test_codes_decode_to_their_entries(spark):
    rows = vectors(60, 9)
    df = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], SCHEMA)
    books = vector_codes.train(df)
    codes = vector_codes.assign(df, books)
    exact = {i: v for i, v, _ in rows}
    for r in vector_codes.decode(codes, books).collect():
        floors = [math.floor(float(np.float32(x)) * 4096) for x in exact[r["vec_id"]]]
        assert sum((int(y * 4096) - x) ** 2 for x, y in zip(floors, r["vector"], strict=True)) == r["error"]
