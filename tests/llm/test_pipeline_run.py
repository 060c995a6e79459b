"""The whole pipeline over a small table with every odd kind of row, against brute force for each stage."""

import hashlib
import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from test_dedup import altered, naive_fingerprint, naive_lines, text, united
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from lexigrove.llm import decontaminate
from lexigrove.llm.queries import VOCABULARY

CLASHING = ("fp", "key", "component", "first", "line_no", "a", "b", "component_id", "fingerprint", "doc", "lines", "id", "label", "score", "n", "__hit")


def written(spark, folder, docs, items=(), labels=()):
    df = spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", "text", F.length("text").alias("n_chars"), *[F.lit(7).alias(c) for c in CLASHING])
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").withColumn("doc_id", F.lit(1)).write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def naive(docs, items):
    """What is left of docs, as (doc_id, text), after the stages that follow toxicity."""
    firsts = naive_lines(docs)
    cut = {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if firsts.get((i, n), (i, n)) == (i, n)) for i, t in docs}
    ids = sorted(cut)
    fps = [naive_fingerprint(cut[i]) for i in ids]
    root = united(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    left = [ids[i] for i in range(len(ids)) if root[i] == i]
    wanted = [s for _, t in items if (s := decontaminate.shingles(decontaminate.words(t)))]
    hit = lambda t: any(len(s & decontaminate.shingles(decontaminate.words(t))) >= 0.8 * len(s) for s in wanted)
    return [(i, cut[i]) for i in left if not hit(cut[i])]


def corpus():
    rng = random.Random(23)
    shared = [text(rng, n) for n in (4, 7, 30, 55)]
    docs = [(i, "\n".join([text(rng, rng.choice([3, 12, 60])) for _ in range(rng.randrange(1, 4))] + rng.sample(shared, rng.randrange(3)))) for i in range(40)]
    docs += [(40 + i, altered(rng, docs[i][1])) for i in range(8)] + [(50 + i, docs[i + 8][1]) for i in range(5)]
    items = [(i, text(rng, n)) for i, n in enumerate((5, 8, 20, 70))] + [(9, None), (10, ""), (11, "two words"), (0, text(rng, 30))]
    docs += [(60 + k, text(rng, 20) + " " + t + " " + text(rng, 15)) for k, (_, t) in enumerate(items) if t]
    docs += [(80, None), (81, ""), (82, "\n \n"), (83, None), (84, "w1 w2 " * 30_000), (85, "Ünïcode É 好世界 😀 x y z"), (86, "...")]
    rng.shuffle(docs)
    return docs, items


def test_run(spark, tmp_path):
    docs, items = corpus()
    want = naive(docs, items)
    ranks = load_tiktoken_bpe(public_tokenizers.path(VOCABULARY))
    library = tiktoken.Encoding("library", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, written(spark, tmp_path / "t", docs, items)).collect()}
    assert sorted(got) == sorted(i for i, _ in want) and 30 < len(want) < len(docs) - 12
    for i, t in want:
        ids = library.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_stages_keep_columns(spark, tmp_path):
    docs, items = corpus()
    path = written(spark, tmp_path / "t", docs[:30], items)
    at = spark.read.parquet(f"{path}/documents.parquet")
    columns = at.columns
    bare = corpus_pipeline.dedup_lines(spark, at.drop("n_chars"), path)
    assert bare.columns == [c for c in columns if c != "n_chars"] and bare.count() == 30
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, path)
        assert at.columns == columns, name
        assert at.where("fp <> 7 or component <> 7 or __hit <> 7 or n_chars <> length(text)").isEmpty(), name
    at = corpus_pipeline.encode(spark, at, path)
    assert at.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and at.count() > 0


def test_empty_tables(spark, tmp_path):
    items = [(1, "one two three four five six")]
    assert corpus_pipeline.run(spark, written(spark, tmp_path / "none", [])).count() == 0
    nulls = corpus_pipeline.run(spark, written(spark, tmp_path / "nulls", [(None, None), (3, None), (3, None)], items, [(3, None, None), (None, 1, 0), (8, 1, 1)])).collect()
    assert {r["doc_id"] for r in nulls} <= {3, None} and any(r["doc_id"] == 3 for r in nulls) and all(r["n_tokens"] == 0 for r in nulls)


def test_repeated_rows(spark, tmp_path):
    """Rows that repeat a doc_id are one document: its lines stay in each, and one row of it is left."""
    one, two = "one two three four five six seven", "other words are standing in this line"
    got = corpus_pipeline.run(spark, written(spark, tmp_path / "t", [(4, one), (4, one), (2, two), (9, one + "\n" + two)])).collect()
    assert sorted(r["doc_id"] for r in got) == [2, 4, 9] and sorted(r["n_tokens"] > 0 for r in got) == [False, True, True]
