"""Scans and sinks on small files."""

import pytest

from lexigrove.api import SearchEngine
from lexigrove.cli import main
from lexigrove.config import EngineConfig
from lexigrove.functions.analysis import LATIN
from lexigrove.operators.evaluation import evaluate, per_query
from lexigrove.operators.index import build_index
from lexigrove.sources import sinks, text_files
from lexigrove.sources.articles import last_by_id, read_articles

XML = """<?xml version="1.0"?><Corpus>
<Article><ID> 1 </ID><HEADLINE>one <b>x</b> tail</HEADLINE><TEXT>first</TEXT><TEXT>second</TEXT></Article>
<Section><Article><ID>2</ID><TEXT>nested</TEXT></Article></Section>
<Article><HEADLINE>no id</HEADLINE><TEXT>t</TEXT></Article>
<Article><ID> </ID><TEXT>blank id</TEXT></Article>
<Article><ID>3</ID><HEADLINE></HEADLINE><TEXT> </TEXT></Article>
<!-- <Article><ID>4</ID><TEXT>comment</TEXT></Article> -->
<Article><ID>1</ID><TEXT>again</TEXT></Article>
</Corpus>"""


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_strict_articles(spark, tmp_path):
    rows = read_articles(spark, write(tmp_path, "a.xml", XML)).orderBy("doc_seq").collect()
    assert [(r["id"], r["headline"], r["text"], r["full_text"]) for r in rows] == [("1", "one", "first", "one first"), ("2", "", "nested", " nested"), ("1", "", "again", " again")]
    store = {r["id"]: r["text"] for r in last_by_id(read_articles(spark, str(tmp_path / "a.xml"))).collect()}
    assert store == {"1": "again", "2": "nested"}


def test_rootless_and_broken_files(spark, tmp_path):
    two = "<Article><ID>1</ID><TEXT>a</TEXT></Article><!-- & --><Article><ID>2</ID><TEXT>b</TEXT></Article>"
    assert read_articles(spark, write(tmp_path, "two.xml", two)).count() == 2
    assert read_articles(spark, write(tmp_path, "lead.xml", ' <?xml version="1.0"?><r>' + two + "</r>")).count() == 2
    assert read_articles(spark, write(tmp_path, "bad.xml", two + "<Article><ID>3</ID><TEXT>a & b</TEXT></Article>")).count() == 0


def test_fast_articles(spark, tmp_path):
    flat = "<C>" + "".join(f"<Article><ID>{i}</ID><HEADLINE>h</HEADLINE><TEXT>t{i}</TEXT></Article>" for i in range(3)) + "</C>"
    rows = read_articles(spark, write(tmp_path, "flat.xml", flat), strict=False).collect()
    assert sorted(r["id"] for r in rows) == ["0", "1", "2"]


def test_missing_corpus_raises(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_articles(spark, str(tmp_path / "none.xml")).count()


def test_query_files(spark, tmp_path):
    path = write(tmp_path, "q.txt", "1 old\n\n# note here\n  2 b  c \nlonely\n1 new one\n")
    assert {r["qid"]: r["text"] for r in text_files.read_queries(spark, path).collect()} == {"1": "new one", "2": "b  c"}
    assert text_files.read_queries(spark, str(tmp_path / "none")).count() == 0


def test_lexicons(spark, tmp_path):
    path = write(tmp_path, "s.txt", "# c\nعلى\nالذين\n\nعلى\n")
    assert text_files.read_stopwords(spark, path) == {"على", "ذين"}
    assert text_files.read_stopwords(spark, path, normalized=True) == {"علي", "ذين"}
    assert text_files.read_protected_words(spark, write(tmp_path, "p.txt", "الألماني\nتونس\n")) == {"الماني", "تونس"}
    assert text_files.read_protected_words(spark, str(tmp_path / "none")) == frozenset()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        text_files.read_stopwords(spark, str(tmp_path / "none"))


QRELS = "1 0 a 1\n1\t0  b 0 extra\n1 0 c 2\nshort 1\n2 0 a 1\n3 0 a 0\n1 0 a 1\n4 0 z bad\n"
RUN = "1,x,0.9\n1,a,0.8\n1,c,0.8\n2,b\n"


def test_evaluation(spark, tmp_path):
    qrels, run = text_files.read_qrels(spark, write(tmp_path, "qrels", QRELS)), text_files.read_results(spark, write(tmp_path, "run", RUN))
    each = {r["qid"]: r for r in per_query(qrels, run, 2).collect()}
    assert set(each) == {"1", "2"}
    assert each["1"]["ap"] == pytest.approx((1 / 2 + 2 / 3) / 2) and each["1"]["rr"] == 0.5
    assert each["1"]["p_at_k"] == 0.5 and each["1"]["r_at_k"] == 0.5 and each["2"]["ap"] == 0
    got = evaluate(qrels, run, 2).first()
    assert got["map"] == pytest.approx((1 / 2 + 2 / 3) / 4) and got["mrr"] == 0.25
    assert main(["evaluate", "--qrels", str(tmp_path / "qrels"), "--results", str(tmp_path / "run"), "--k", "2"], spark)["mrr"] == 0.25
    nothing = evaluate(qrels.where("false"), run).first()
    assert nothing["map"] == 0.0


def read_all(path):
    return "".join(p.read_text(encoding="utf-8") for p in sorted(path.glob("part-*")))


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("10", "b a", 0), ("9", "a b a", 1), ("x", "a", 2)], "id string, full_text string, doc_seq long")
    index = build_index(docs, LATIN)
    sinks.save_index(index.postings, str(tmp_path / "index"))
    assert read_all(tmp_path / "index") == "a:3\n\t9: 0,2\n\t10: 1\n\tx: 0\nb:2\n\t9: 1\n\t10: 0\n"
    sinks.save_postings(index.postings, str(tmp_path / "postings"))
    assert spark.read.parquet(str(tmp_path / "postings")).count() == 6
    engine = SearchEngine(index, EngineConfig())
    asked = spark.createDataFrame([("2", "a AND b"), ("10", "NOT b")], "qid string, text string")
    engine.batch(asked, asked, str(tmp_path / "out"))
    assert read_all(tmp_path / "out" / "results.boolean") == "2,9\n2,10\n10,x\n"
    assert read_all(tmp_path / "out" / "results.ranked").splitlines()[0].endswith(",1.0000")
    assert [r["doc_id"] for r in engine.dispatch("a AND b", "boolean")] == ["9", "10"] and engine.last_seconds > 0
    assert engine.dispatch("b")[0]["rank"] == 1 and engine.dispatch("b", algorithm="bm25")


def test_cli_batch(spark, tmp_path):
    corpus = write(tmp_path, "c.xml", "<C><Article><ID>1</ID><TEXT>كأس مصر</TEXT></Article><Article><ID>2</ID><TEXT>مصر</TEXT></Article></C>")
    queries = write(tmp_path, "q.txt", "1 مصر\n2 كأس\n")
    main(["batch", "--corpus", corpus, "--boolean", queries, "--ranked", queries, "--output", str(tmp_path / "o")], spark)
    assert read_all(tmp_path / "o" / "results.boolean") == "1,1\n1,2\n2,1\n"
