"""The Arabic chain on the hand fixture: six articles, their tokens, and answers computed by hand."""

import random

import pytest
from pyspark.sql import functions as F

from lexigrove.functions.analysis import ARABIC, analyze, analyze_texts, clean_term, has_foreign, is_protected, normalize, stemmed, strip_article
from lexigrove.functions.stemmer import KEPT, stem
from lexigrove.operators.boolean import near_by_join, search, search_many
from lexigrove.operators.index import arabic_only, build_index, foreign_terms
from lexigrove.operators.ranking import cosine_scores, queries_frame, rank_bm25, rank_cosine

ARTICLES = [
    ("1", "كأس الأمم", "فوز مصر على تونس 3-1"),
    ("2", "مصر", "كأسُ الأُمَمِ في مصر، فوز صلاح!"),
    ("3", "تونس", "مباراة تونس و أوغندا"),
    ("4", "", "لاعب المغرب hello 2025"),
    ("5", "في", "من"),
    ("10", "مصر", "جنوب أفريقيا ــ كأس العالم"),
]
TOKENS = {
    "1": "كاس امم فوز مصر علي تونس 3 1",
    "2": "مصر كاس امم مصر فوز صلاح",
    "3": "تونس مباراة تونس اوغندا",
    "4": "عب مغرب 2025",
    "5": "",
    "10": "مصر جنوب افريقيا كاس عالم",
}
# Without stemming, so that scores hold for any stemmer.
PLAIN = ARABIC.with_lexicons(stopwords=["في", "من", "و", "على"])
PLAIN = type(PLAIN)("arabic", PLAIN.stopwords)


@pytest.fixture(scope="module")
def articles(spark):
    rows = [(i, f"{h} {t}", n) for n, (i, h, t) in enumerate(ARTICLES)]
    return spark.createDataFrame(rows, "id string, full_text string, doc_seq long").cache()


@pytest.fixture(scope="module")
def index(articles):
    return build_index(articles, PLAIN)


def test_tokens(articles):
    got = {r[0]: " ".join(r[1]) for r in articles.select("id", analyze(F.col("full_text"), PLAIN)).collect()}
    assert got == TOKENS


def test_normalisation(spark):
    cases = {"  إأآ  ى ": "ااا ي", "مُحَمَّدٌ": "محمد", "كــأس": "كاس", "رحمٰن": "رحمن", "": "", None: "", "ة ؤ ئ ٱ": "ة ؤ ئ ٱ"}
    rows = spark.createDataFrame(list(cases.items()), "a string, b string")
    assert all(r[0] == r[1] for r in rows.select(normalize(F.col("a")), "b").collect())
    assert all(r[0] == r[1] for r in rows.select(clean_term(F.col("a")), "b").collect())


def test_articles_are_stripped_once(spark):
    cases = {"الكتاب": "كتاب", "إلكتاب": "كتاب", "للكتاب": "كتاب", "لاعب": "عب", "لا": "لا", "ال": "ال", "ا": "ا", "الالف": "الف", "كتاب": "كتاب"}
    rows = spark.createDataFrame(list(cases.items()), "a string, b string")
    assert {r[0]: r[1] for r in rows.select("a", strip_article(F.col("a"))).collect()} == cases


def test_foreign_terms(spark, articles):
    rows = spark.createDataFrame([("كاس", False), ("2025", False), ("abc", True), ("كاسa", True)], "t string, f boolean")
    assert all(r[0] == r[1] for r in rows.select(has_foreign(F.col("t")), "f").collect())
    at = build_index(articles, PLAIN)
    kept, removed = arabic_only(at)
    assert foreign_terms(at).first()[0] == 0 and removed.count() == 0 and kept.postings.count() == 26


def test_index_statistics(index):
    assert index.n_docs == 6 and index.avgdl == pytest.approx(26 / 6)
    assert {r["doc_id"]: r["dl"] for r in index.doc_stats.collect()} == {"1": 8, "2": 6, "3": 4, "4": 3, "5": 0, "10": 5}
    df = {r["term"]: r["df"] for r in index.term_stats.collect()}
    assert [df[t] for t in ("كاس", "مصر", "فوز", "تونس", "امم", "صلاح")] == [3, 3, 2, 2, 2, 1]
    assert index.document_frequency("كاس").first()[0] == 3 and index.document_frequency("لاشيء").first()[0] == 0
    assert index.term_frequency("مصر", "2").first()[0] == 2 and index.positions("مصر", "2").first()[0] == [0, 3]
    assert {r[0] for r in index.documents_with("امم").collect()} == {"1", "2"}


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("مصر AND NOT تونس", ["2", "10"]),
        ("NOT مصر", ["3", "4", "5"]),
        ('"كأس الأمم"', ["1", "2"]),
        ('"الأمم مصر"', ["2"]),
        ("#1(مصر,فوز)", ["1", "2"]),
        ("#2(كأس,تونس)", []),
        ("مصر تونس", ["1", "2", "10"]),
        ("في AND مصر", []),
        ("مصر AND NOT في", ["1", "2", "10"]),
        ("   ", []),
    ],
)
def test_boolean(index, query, expected):
    assert [r[0] for r in search(index, query).collect()] == expected


def test_near_by_join_agrees(index):
    assert {r[0] for r in near_by_join(index.postings, ["مصر"], ["فوز"], 1).collect()} == {"1", "2"}


def test_bm25(spark, index):
    rows = rank_bm25(index, queries_frame(spark, {"a": "مصر كأس", "b": "فوز صلاح", "c": "hello"})).collect()
    got = {(r["qid"], r["rank"]): (r["doc_id"], round(r["score"], 6)) for r in rows}
    assert got == {("a", 1): ("2", 1.458956), ("a", 2): ("10", 1.304211), ("a", 3): ("1", 1.029819), ("b", 1): ("2", 2.220660), ("b", 2): ("1", 0.764860)}


def test_cosine(spark, index):
    asked = queries_frame(spark, {"a": "مصر كأس", "b": "فوز صلاح"})
    raw = {(r["qid"], r["doc_id"]): round(r["raw"], 6) for r in cosine_scores(index, asked).collect()}
    assert raw == {("a", "2"): 0.428788, ("a", "10"): 0.301196, ("a", "1"): 0.260015, ("b", "2"): 0.799080, ("b", "1"): 0.152323}
    top = {(r["qid"], r["rank"]): (r["doc_id"], round(r["score"], 6)) for r in rank_cosine(index, asked, 2).collect()}
    assert top == {("a", 1): ("2", 1.0), ("a", 2): ("10", 0.702436), ("b", 1): ("2", 1.0), ("b", 2): ("1", 0.190623)}


def test_ties_keep_document_order(spark):
    rows = spark.createDataFrame([("b", "كاس", 0), ("a", "كاس", 1), ("c", "شيء", 2)], "id string, full_text string, doc_seq long")
    got = rank_bm25(build_index(rows, PLAIN), queries_frame(spark, {"q": "كاس"})).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == ["b", "a"]


def test_repeated_ids_are_one_document(spark):
    rows = spark.createDataFrame([("1", "كاس مصر", 0), ("1", "مصر", 1), ("2", None, 2)], "id string, full_text string, doc_seq long")
    at = build_index(rows, PLAIN)
    assert at.n_docs == 2 and at.positions("مصر", "1").first()[0] == [0, 1]


def test_empty_table(spark):
    at = build_index(spark.createDataFrame([], "id string, full_text string, doc_seq long"), PLAIN)
    assert search_many(at, {"q": "NOT كاس"}).count() == 0 and at.avgdl == 0.0
    assert rank_cosine(at, queries_frame(spark, {"q": "كاس"})).count() == 0


def stems(spark, words):
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    return {r["word"]: r["stem"] for r in rows.select("word", stem(F.col("word")).alias("stem")).collect()}


def test_stemmer_shapes(spark):
    cases = {"كاتب": "كتب", "مكتوب": "كتب", "استخدم": "خدم", "مدرسة": "درس", "والكتاب": "كتب", "": "", None: "", "من": "من", "اليوم": "اليوم", "كَتَبَ": "كتب", "افعوعل": "فعل", "افعوغل": "عوغل", "زلزلة": "زلزل", "متدحرج": "دحرج", "2025": "2025", "ووصل": "وصل", "أكل": "اكل", "مستكشفان": "كشف"}
    assert stems(spark, cases) == cases


def by_place(word):
    """The same rules as conditions on letters by place."""
    w = "".join(ch for ch in word or "" if not "\u064b" <= ch <= "\u0652")
    if w in KEPT:
        return w
    one_off = lambda w: w[:-1] if w[-1] in "ةهيكتان" else w[1:] if w[0] in "لبفسويتنا" else w
    if len(w) >= 6 and w[:3] in ("كال", "بال", "ولل", "وال"):
        w = w[3:]
    elif len(w) >= 5 and w[:2] in ("ال", "لل"):
        w = w[2:]
    if len(w) >= 6 and w[-3:] in ("تمل", "همل", "تان", "تين", "كمل"):
        w = w[:-3]
    elif len(w) >= 5 and w[-2:] in ("ون", "ات", "ان", "ين", "تن", "كم", "هن", "نا", "يا", "ها", "تم", "كن", "ني", "وا", "ما", "هم"):
        w = w[:-2]
    if len(w) >= 4 and w[:2] == "وو":
        w = w[1:]
    if w[:1] in ("آ", "أ", "إ"):
        w = "ا" + w[1:]
    if len(w) == 7:
        w = one_off(w)
    if len(w) == 6:
        a, b, c, d, e, f = w
        if w[:3] in ("است", "مست"):
            return d + e + f
        if a == "م" and d == "ا" and f == "ة":
            return b + c + e
        if a == "ا" and c == "ت" and e == "ا":
            return b + d + f
        if a == "ا" and d == "و" and c == e:
            return b + e + f
        if a == "ت" and c == "ا" and e == "ي":
            return b + d + f
        w = one_off(w)
        if len(w) == 6:
            return b + c + d + f if a == "ا" and e == "ا" else c + d + e + f if a + b == "مت" else w
    if len(w) == 5:
        a, b, c, d, e = w
        for fits, root in (
            (a == "ا" and c in "ات", b + d + e), (a == "م" and d in "ايو", b + c + e), (a in "اتم" and e == "ة", b + c + d), (a in "ميت" and c == "ت", b + d + e),
            (a in "مت" and c == "ا", b + d + e), (c in "او" and e == "ة", a + b + d), (a in "ام" and b == "ن", c + d + e), (a == "ا" and d == "ا", b + c + e), (d == "ا" and e == "ن", a + b + c),
            (a == "ت" and d == "ي", b + c + e), (b == "ا" and d == "و", a + c + e), (b == "و" and c == "ا", a + d + e), (c == "ا" and d == "ئ", a + b + e), (b == "ا" and e == "ة", a + c + d), (c == "ا" and e == "ي", a + b + d),
        ):
            if fits:
                return root
        w = one_off(w)
        if len(w) == 5:
            return w[1:] if a in "اتم" else w[:4] if e == "ة" else a + b + d + e if c == "ا" else w
    if len(w) == 4:
        a, b, c, d = w
        return b + c + d if a == "م" else a + c + d if b == "ا" else a + b + d if c in "اوي" else a + b + c if d == "ة" else one_off(w)
    return w


def test_stemmer_by_place(spark):
    pick = random.Random(5)
    letters = "ابتةكلمنهويسفقدزئءؤأإآعرق"
    heads, tails = ["", "", "ال", "وال", "است", "مت", "وو", "م", "ت", "ا"], ["", "", "ات", "تان", "ون", "ة", "ها", "ني", "ا"]
    words = {pick.choice(heads) + "".join(pick.choice(letters) for _ in range(pick.randint(0, 7))) + pick.choice(tails) for _ in range(30_000)} | set(KEPT)
    assert len({len(w) for w in words}) > 10
    assert stems(spark, words) == {w: by_place(w) for w in words}


def test_protected_words_stay(spark):
    profile = ARABIC.with_lexicons(protected=["كاتب"])
    rows = spark.createDataFrame([("كاتب",), ("مكتوب",)], "token string")
    assert {r["token"]: r["term"] for r in stemmed(rows, "token", profile).collect()} == {"كاتب": "كاتب", "مكتوب": "كتب"}
    assert analyze_texts(spark, ["كاتب مكتوب", ""], profile) == [["كاتب", "كتب"], []]
    assert [r[0] for r in rows.select(is_protected(F.col("token"), profile)).collect()] == [True, False]
