"""Packing moves no tokens, and what is stored is not grouped again."""

import re

import numpy as np

from lexigrove.functions.analysis import ARABIC, LATIN
from lexigrove.operators import boolean, index, packed
from lexigrove.sources.sinks import index_lines
from test_packed import documents, same, stored


def _exchanges(df) -> int:
    return len(re.findall(r"Exchange (hash|range)partitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_packing_needs_no_exchange(spark):
    df = spark.createDataFrame(documents(100), "doc_id long, text string, doc_seq long")
    for profile in (LATIN, ARABIC):
        assert _exchanges(packed.pack(df, profile, "doc_id", "text")) == 0


def test_blocks_end_at_tokens(spark, monkeypatch):
    monkeypatch.setattr(packed, "TOKENS", 100)
    rows = [(i, " ".join(f"w{(i * j) % 17}" for j in range(30 if i % 9 else 250)), i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc_seq long").coalesce(1)
    batches = df.selectExpr("doc_id AS row", "doc_id", "split(text, ' ') AS tokens").toArrow().to_batches()
    out = [b for b in packed._in_blocks(16)(iter(batches))]
    size = [sum(len(p) for p in b.column("positions").flatten().to_pylist()) for b in out]
    assert sum(size) == sum(len(t.split()) for _, t, _ in rows) and max(size) == 250 and len(out) > 60 / 16
    found = sorted((t, d, p) for b in out for t, ds, ps in zip(*(b.column(c).to_pylist() for c in ("term", "ids", "positions")), strict=True) for d, each in zip(ds, ps, strict=True) for p in each)
    assert found == sorted((t, d, p) for d, text, _ in rows for p, t in enumerate(text.split()))


def test_stored_lists_are_not_grouped(spark, tmp_path):
    plain, at = stored(spark, tmp_path, documents())
    same(index_lines(plain.postings), index_lines(at.postings, at.lists, at.term_stats))
    assert _exchanges(index_lines(at.postings, at.lists, at.term_stats)) == _exchanges(index.arabic_only(at)[0].term_stats) == 0
    for find in (index.top_terms, index.rare_terms):
        assert find(plain).collect() == find(at).collect()


def test_lists_and_lengths_of_repeated_ids(spark, tmp_path):
    rows = documents(60) + [(3, "w1 w1 again", 900), (3, "w1", 901), (None, "w1 null", 902)]
    plain, at = stored(spark, tmp_path, rows)
    same(index_lines(plain.postings), index_lines(at.postings, at.lists, at.term_stats))
    assert {r["doc_id"]: r["dl"] for r in at.doc_stats.collect()}[3] == sum(len(t.split()) for i, t, _ in rows if i == 3 and t)


def test_parts_are_written_when_asked_for(spark, tmp_path):
    plain, at = stored(spark, tmp_path, documents())
    parts = lambda: {x.name for x in (tmp_path / "at").iterdir()}
    assert not parts() & {"pairs", "norms"}
    same(plain.doc_stats, at.doc_stats)
    boolean.search(at, '"w0 w1"').collect()
    assert parts() & {"pairs", "norms"} == {"pairs"}
    norms = {r["doc_id"]: round(r["norm"], 9) for r in plain.norms.collect()}
    assert norms == {r["doc_id"]: round(r["norm"], 9) for r in at.norms.collect()} and parts() >= {"pairs", "norms"}
    again = packed.load(spark, str(tmp_path / "at"), LATIN)
    written = (tmp_path / "at" / "norms" / "_SUCCESS").stat().st_mtime_ns
    assert again.complete().norms.count() == len(norms) and (tmp_path / "at" / "norms" / "_SUCCESS").stat().st_mtime_ns == written


def test_lengths_come_from_the_packing_task(spark, tmp_path):
    rows = [(1, "مكتوب كتب كاتب كتب", 1), (2, "والكتاب مدرسة", 2), (3, None, 3), (None, "كتب", 4)]
    plain, at = stored(spark, tmp_path, rows, ARABIC.with_lexicons(protected=["كاتب"]))
    same(plain.doc_stats.where("doc_id is not null"), at.doc_stats.where("doc_id is not null"))
    assert at.doc_stats.where("doc_id is null").first()["dl"] == 1 and at.blocks.where("term is null").isEmpty()


def test_order_of_numbers_too_large_for_one():
    draw = np.random.default_rng(4)
    for high in (50, 1 << 40):
        columns = [draw.integers(0, n, 2000) for n in (9, high, high)]
        order = np.lexsort(columns[::-1])
        assert all((a == c[order]).all() for a, c in zip(packed._in_order(*columns), columns, strict=True))
    assert [len(c) for c in packed._in_order(*[np.zeros(0, np.int64)] * 3)] == [0, 0, 0]
