"""Packed postings are the plain ones, pruned ranking is the plain one, and a changed table is indexed anew."""

import random

import pytest
from pyspark.sql import functions as F

from lexigrove.functions.analysis import ARABIC, LATIN
from lexigrove.operators import boolean, index, packed, ranking
from lexigrove.plans import catalog


def documents(n=300, seed=1, kind="long"):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    rows = [(i, " ".join(pick.choices(words, weights, k=pick.randint(0, 60))), i) for i in range(n)]
    rows.append((n, None, n))
    return [(f"d{i}" if kind == "string" else i, text, seq) for i, text, seq in rows]


def stored(spark, tmp_path, rows, profile=LATIN, kind="long", block=16):
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string, doc_seq long").repartition(3)
    packed.store(df, profile, str(tmp_path / "at"), "doc_id", "text", block=block)
    return index.build_index(df, profile, "doc_id", "text"), packed.load(spark, str(tmp_path / "at"), profile)


def same(a, b):
    assert sorted(map(tuple, a.select(*b.columns).collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_postings_and_statistics(spark, tmp_path, kind):
    rows = documents(kind=kind)
    rows += [(rows[3][0], "w1 w1 again", 900), (rows[3][0], "w1", 901)]  # rows of one id
    plain, at = stored(spark, tmp_path, rows, kind=kind)
    for part in ("postings", "tf", "term_stats", "doc_stats", "documents"):
        same(getattr(plain, part).select(*(c for c in getattr(at, part).columns)), getattr(at, part))
    norms = {r["doc_id"]: r["norm"] for r in plain.norms.collect()}
    assert {r["doc_id"]: pytest.approx(norms[r["doc_id"]]) for r in at.norms.collect()} == {r["doc_id"]: r["norm"] for r in at.norms.collect()} and at.norms.count() == len(norms)
    assert (at.n_docs, at.n_tokens, at.repeated) == (plain.n_docs, plain.n_tokens, True)
    blocks = at.blocks.where("term = 'w0'").collect()
    assert len(blocks) > 5 and all(r["ids"] == sorted(r["ids"]) and r["n"] == len(r["ids"]) and r["first"] == r["ids"][0] and r["last"] == r["ids"][-1] for r in blocks)


def test_stemmed_postings(spark, tmp_path):
    profile = ARABIC.with_lexicons(protected=["كاتب"])
    plain, at = stored(spark, tmp_path, [(1, "مكتوب كتب كاتب كتب", 1), (2, "والكتاب مدرسة", 2)], profile)
    same(plain.postings, at.postings)
    same(plain.tf, at.tf)


def test_phrases_by_pairs(spark, tmp_path):
    plain, at = stored(spark, tmp_path, documents(500, 3))
    frequent = {r["term"] for r in at.term_stats.where(F.col("df") >= packed.FREQUENT * at.n_docs).collect()}
    assert {"w0", "w1"} <= frequent and "w199" not in frequent
    assert at.units([["w0", "w1"], ["w199", "w0", "w1", "w2"], ["w0", "w199"], ["w0", "w0", "w0"]]) == [[(0, "w0 w1")], [(0, "w199"), (1, "w0 w1"), (3, "w2")], [(0, "w0"), (1, "w199")], [(0, "w0 w0"), (2, "w0")]]
    asked = {p: f'"{p}"' for p in ("w0 w1", "w1 w0", "w0 w0", "w0 w0 w0", "w2 w0 w1", "w0 w1 w90", "w90 w0 w1 w0", "w199 w198", "w0 nothing", "w0")}
    same(boolean.search_many(plain, asked), boolean.search_many(at, asked))
    read = at.pairs.where("term = 'w0 w1'").agg(F.sum(F.size(F.flatten("positions")))).first()[0]
    assert 0 < read < at.only(["w0", "w1"]).count() / 3


def test_empty_corpus(spark, tmp_path):
    _, at = stored(spark, tmp_path, [])
    asked = ranking.queries_frame(spark, {"q": "w1"})
    assert at.n_docs == at.n_tokens == 0 and packed.rank_bm25(at, asked).count() == ranking.rank_cosine(at, asked).count() == 0


QUERIES = {"1": "w0 w1 w150", "2": "w180", "3": "w2 w2 w90 w0", "4": "nothing", "5": "w0 w1", "6": "w199 w198 w197"}


@pytest.mark.parametrize("k", [1, 5, 50, 1000])
def test_pruned_ranking(spark, tmp_path, k):
    _, at = stored(spark, tmp_path, documents(400, k))
    asked = ranking.queries_frame(spark, QUERIES)
    show = lambda rows: sorted((r["qid"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in rows.collect())
    assert show(packed.rank_bm25(at, asked, k)) == show(ranking.rank_bm25(at, asked, k)) != []


def test_repeated_ids_are_not_pruned(spark, tmp_path):
    _, at = stored(spark, tmp_path, documents(100) + [(5, "w150 w150", 5), (5, "w150", 5)])
    asked = ranking.queries_frame(spark, QUERIES)
    assert sorted(map(tuple, packed.rank_bm25(at, asked, 3).collect())) == sorted(map(tuple, ranking.rank_bm25(at, asked, 3).collect()))


def test_most_blocks_are_left_packed(spark, tmp_path):
    pick = random.Random(2)
    rows = [(i, "the of " + " ".join(f"x{pick.randint(0, 5000)}" for _ in range(20)) + (" rare" if i in (7, 900) else ""), i) for i in range(1000)]
    _, at = stored(spark, tmp_path, rows, block=10)
    _, bounded = packed.pruned_blocks(at, ranking.queries_frame(spark, {"q": "the rare"}), 2)
    kept, every = bounded.where("bound >= least").count(), bounded.count()
    assert every >= 100 and kept <= 4


def test_filter_reaches_the_scan(spark, tmp_path):
    _, at = stored(spark, tmp_path, documents())
    plan = at.only(["w3"])._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan or "EqualTo(term" in plan
    assert "positions" not in at.term_stats._jdf.queryExecution().executedPlan().toString()


def test_cosine_needs_no_window(spark, tmp_path):
    _, at = stored(spark, tmp_path, documents())
    scores = ranking.cosine_scores(at, ranking.queries_frame(spark, QUERIES))
    assert "Window" not in scores._jdf.queryExecution().executedPlan().toString()
    assert all(r[0] == 1.0 for r in scores.groupBy("qid").agg(F.max("score")).select("max(score)").collect())


def test_a_changed_table_is_indexed_anew(spark, tmp_path):
    write = lambda n: spark.createDataFrame([(i, f"word{i}") for i in range(n)], "doc_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    write(3)
    assert catalog.indexed(spark, str(tmp_path)).n_docs == 3 and catalog.indexed(spark, str(tmp_path)).n_docs == 3
    write(5)
    assert catalog.indexed(spark, str(tmp_path)).term_stats.count() == 5
