"""The quality classifier: contexts against a naive count, the network's slopes, calibration, held-out accuracy and edge cases."""

import zlib

import numpy as np
import pytest

from lexigrove.llm import quality

DOCS = "doc_id long, text string, lang string, score double, quality string"
WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]


def documents(n, seed=5):
    """Plain prose, or every fourth text prose with marks after each word."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [WORDS[k] for k in rng.integers(0, len(WORDS), 60)]
        bad = i % 4 == 0
        rows.append((i, " ".join(w + "$$$" if bad and rng.random() < 0.5 else w for w in words), "en", 0.5, "x", 0 if bad else 1))
    return rows


def made(spark, rows):
    docs = spark.createDataFrame([r[:5] for r in rows], DOCS).repartition(4)
    return docs, spark.createDataFrame([(r[0], r[5]) for r in rows if r[5] is not None], "doc_id long, quality int")


def test_contexts_are_those_of_all_texts(spark):
    rows = documents(60)
    rows.append((99, None, None, None, None, None))
    docs, _ = made(spark, rows)
    names = [*quality.SHAPES, *sorted({"$$$", *WORDS[:50]})]
    found = quality.context_vectors(docs, names)
    index, numbers = quality.index_vectors(names), quality.Numbers(names)
    want = np.zeros_like(found)
    for r in rows:
        ids = numbers.of(r[1])
        for i, a in enumerate(ids):
            for j in range(max(0, i - quality.WINDOW), min(len(ids), i + quality.WINDOW + 1)):
                if i != j:
                    want[a] += index[ids[j]]
    assert (found == want).all() and found.any()


def test_contexts_across_blocks(spark, monkeypatch):
    docs, _ = made(spark, documents(20))
    names = [*quality.SHAPES, *WORDS]
    whole = quality.context_vectors(docs.coalesce(1), names)
    text = " ".join(r[1] for r in documents(20))
    numbers = quality.Numbers(names)
    assert len(numbers.of(text)) > 1000
    monkeypatch.setattr(quality, "AT_ONCE", 64)
    assert (quality.context_vectors(docs.coalesce(1), names) == whole).all()


def test_index_vectors_are_fixed_ternary_and_nearly_orthogonal():
    x = quality.index_vectors(WORDS)
    assert set(np.unique(x)) == {-1, 0, 1} and (np.abs(x).sum(1) == quality.NONZERO).all()
    assert (x == quality.index_vectors(WORDS)).all()
    assert np.abs((x @ x.T)[~np.eye(len(x), dtype=bool)]).mean() < 1


def test_every_unit_has_a_number():
    numbers = quality.Numbers([*quality.SHAPES, "known"])
    for text in ("known", "Unknown", "ABC", "aBc", "12 345", "?!", "a\n\nb", "ß ǅ ªº", "漢字", "é" * 50, "_ __", "x̂", "٣"):
        assert len(numbers.of(text)) == len(quality.UNIT.findall(text))
    assert len(numbers.of("")) == len(numbers.of(None)) == 0


def test_the_network_learns_what_no_line_parts():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = quality.fit(x, y, np.ones(600), hidden=16, epochs=800)
    assert ((quality.logits(x, net) > 0) == (y > 0)).mean() > 0.93


@pytest.mark.parametrize("true", [0.5, 1.0, 3.0])
def test_temperature_restores_probabilities(true):
    rng = np.random.default_rng(2)
    z = rng.normal(0, 3, 20000)
    y = (rng.random(20000) < 1 / (1 + np.exp(-z / true))).astype(float)
    assert abs(quality.temperature(z, y, np.ones(20000)) - true) < 0.1 * true
    assert quality.temperature(z, np.ones(20000), np.ones(20000)) == 1.0


def test_held_out_rows_are_told_apart_and_scores_are_calibrated(spark):
    rows = documents(400)
    docs, labels = made(spark, rows)
    found = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(found) == 400
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert {r[0] for r in held} == {i for i, r in found.items() if r["held_out"]}
    assert np.mean([found[r[0]]["predicted"] == r[5] for r in held]) >= 0.95
    assert abs(np.mean([found[r[0]]["score"] for r in held]) - np.mean([r[5] for r in held])) < 0.1


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark):
    rows = documents(120)
    flipped = [(*r[:2], "zz", 9.0, "y", 1 - r[5] if zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[5]) for r in rows]
    one, two = ({r["doc_id"]: r["score"] for r in quality.classify(*made(spark, x)).collect()} for x in (rows, flipped))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_edges(spark):
    rows = documents(80) + [(None, "null id", None, None, None, None), (500, None, None, None, None, None), (501, "", None, None, None, None), (502, "long $$$ " * 50_000, "en", 1.0, "", 7), (3, "again", "en", 1.0, "", 0)]
    docs, labels = made(spark, rows)
    found = quality.classify(docs, labels)
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = found.collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[500] == by[501]
    none = quality.classify(docs, labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.5} and {r["predicted"] for r in none} == {1}
    assert {r["score"] for r in quality.classify(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert quality.classify(docs.where("false"), labels).count() == 0
