"""The Arabic chain over the shared tables: their texts, letter by letter in Arabic script, with DuckDB twins.

The tables hold no Arabic. A fixed translation of the Latin letters gives texts that have what the chain acts on: hamza
seats, alif maqsura, vowel marks, tatweel, articles and negations at the beginning of words, punctuation and digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.functions import analysis, stemmer
from lexigrove.functions.analysis import Profile
from lexigrove.operators import boolean, index, ranking
from lexigrove.plans import catalog

LETTERS, SCRIPT = "abcdefghijklmnopqrstuvwxyz!?;,", "ابأدلفإهيجكىمنوٌقرستآـوخةزء؟؛،"
STOP = ("لل", "هن", "من", "انا", "ل")
PROTECTED = ("تهل", "الهي", "إنج")
PLAIN = Profile("arabic")
STOPPED = PLAIN.with_lexicons(stopwords=STOP)
GUARDED = PLAIN.with_lexicons(stopwords=STOP, protected=PROTECTED)
STEMMED = Profile("arabic", stopwords=frozenset(STOP), protected=frozenset(PROTECTED), stems=True)
UNGUARDED = Profile("arabic", stopwords=frozenset(STOP), protected=frozenset(PROTECTED), stems=True, protect=False)
QUERIES_ASKED = {"1": "تهل وف", "2": "اند تو تو", "3": "إن دل"}


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.translate(F.lower("text"), LETTERS, SCRIPT).alias("text"), F.col("doc_id").alias("doc_seq"))


def _index(spark: SparkSession, sf_dir: str, profile: Profile = STOPPED) -> index.Index:
    return catalog.indexed(spark, sf_dir, profile, corpus)


def arabic_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", F.md5(analysis.normalize(F.col("text")).cast("binary")).alias("normalized"))


def arabic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.token_rows(corpus(spark, sf_dir), PLAIN, "doc_id", "text").select("doc_id", "token", F.col("pos").cast("long").alias("pos"))


def arabic_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.token_rows(corpus(spark, sf_dir), STOPPED, "doc_id", "text").select("doc_id", "token", F.col("pos").cast("long").alias("pos"))


def arabic_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tokens the protected words keep from the stemmer."""
    rows = index.token_rows(corpus(spark, sf_dir), GUARDED, "doc_id", "text").where(analysis.is_protected(F.col("token"), GUARDED))
    return rows.groupBy("token").agg(F.count("*").alias("n"))


def arabic_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the raw texts, and what is left of them without article and marks."""
    words = corpus(spark, sf_dir).select(F.explode(F.split("text", "[ \n]+")).alias("word")).where("word <> ''").distinct()
    return words.select("word", analysis.strip_article(F.col("word")).alias("stripped"), analysis.normalize(analysis.strip_article(F.col("word"))).alias("normalized"))


def arabic_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boolean.search_many(_index(spark, sf_dir), {"q": '"وف تهل"'}).select("doc_id")


def arabic_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boolean.search_many(_index(spark, sf_dir), {"q": "تهل AND NOT (اند OR تو) OR #3(يس,وف)"}).select("doc_id")


def arabic_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ranking.bm25_scores(_index(spark, sf_dir), ranking.queries_frame(spark, QUERIES_ASKED))
    return ranking.top(scores, 10, F.round("score", 9)).select("qid", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def arabic_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each token's term with and without protection."""
    tokens = index.token_rows(corpus(spark, sf_dir), STEMMED, "doc_id", "text").groupBy("token").agg(F.count("*").alias("n"))
    rows = analysis.stemmed(analysis.stemmed(tokens, "token", STEMMED, "term"), "token", UNGUARDED, "unguarded")
    return rows.select("token", "n", "term", "unguarded")


def arabic_stemmed_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, STEMMED).postings.select("doc_id", "term", F.col("pos").cast("long").alias("pos"))


def arabic_stemmed_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ranking.bm25_scores(_index(spark, sf_dir, STEMMED), ranking.queries_frame(spark, QUERIES_ASKED))
    return ranking.top(scores, 10, F.round("score", 9)).select("qid", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


_NORMAL = lambda c: f"trim(regexp_replace(regexp_replace(translate({c}, 'إأآى', 'اااي'), '[\\x{{064B}}-\\x{{065F}}\\x{{0670}}\\x{{0640}}]', '', 'g'), '\\s+', ' ', 'g'))".replace("{{", "{").replace("}}", "}")
_STRIP = lambda c: f"CASE WHEN regexp_matches({c}, '^(ال|إل|أل|لل|لا).') THEN substr({c}, 3) ELSE {c} END"
_LISTED = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_CORPUS = f"c AS (SELECT doc_id, translate(lower(coalesce(text, '')), '{LETTERS}', '{SCRIPT}') AS text FROM documents)"
_FOUND = f"found AS (SELECT doc_id, regexp_extract_all(regexp_replace({_NORMAL('text')}, '[،؛؟؞!-/:-@\\[-`{{-~٪-٬]', ' ', 'g'), '[\\x{{0600}}-\\x{{06FF}}0-9]+') AS f FROM c)".replace("{{", "{").replace("}}", "}")
_ALL = f"WITH {_CORPUS}, {_FOUND}, tok AS (SELECT doc_id, list_filter(list_transform(f, lambda x: {_STRIP('x')}), lambda x: x <> '') AS t FROM found)"
_KEPT = _ALL.replace("tok AS", "every AS") + f", tok AS (SELECT doc_id, list_filter(t, lambda x: NOT list_contains({_LISTED(STOP)}, x)) AS t FROM every)"
_POSTINGS = "postings AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM tok)"
_HAS = lambda w: f"list_contains(t, '{w}')"
_ASKED = ", ".join(f"('{q}', '{w}')" for q, text in QUERIES_ASKED.items() for w in text.replace("إ", "ا").split() if w not in STOP)

#: The stemmer's rules as conditions on letters by place, step by step: w is the word so far, o what it was before a step.
_OFF = lambda w: f"CASE WHEN right({w}, 1) IN ('ة','ه','ي','ك','ت','ا','ن') THEN left({w}, -1) WHEN left({w}, 1) IN ('ل','ب','ف','س','و','ي','ت','ن','ا') THEN substr({w}, 2) ELSE {w} END"
_LETTERS_OF = lambda places: " || ".join(f"w[{i}]" for i in places)
_RULES = {
    6: [("left(w, 3) IN ('است', 'مست')", "456"), ("w[1] = 'م' AND w[4] = 'ا' AND w[6] = 'ة'", "235"), ("w[1] = 'ا' AND w[3] = 'ت' AND w[5] = 'ا'", "246"), ("w[1] = 'ا' AND w[4] = 'و' AND w[3] = w[5]", "256"), ("w[1] = 'ت' AND w[3] = 'ا' AND w[5] = 'ي'", "246")],
    5: [("w[1] = 'ا' AND w[3] IN ('ا','ت')", "245"), ("w[1] = 'م' AND w[4] IN ('ا','ي','و')", "235"), ("w[1] IN ('ا','ت','م') AND w[5] = 'ة'", "234"), ("w[1] IN ('م','ي','ت') AND w[3] = 'ت'", "245"), ("w[1] IN ('م','ت') AND w[3] = 'ا'", "245"), ("w[3] IN ('ا','و') AND w[5] = 'ة'", "124"), ("w[1] IN ('ا','م') AND w[2] = 'ن'", "345"), ("w[1] = 'ا' AND w[4] = 'ا'", "235"), ("w[4] = 'ا' AND w[5] = 'ن'", "123"), ("w[1] = 'ت' AND w[4] = 'ي'", "235"), ("w[2] = 'ا' AND w[4] = 'و'", "135"), ("w[2] = 'و' AND w[3] = 'ا'", "145"), ("w[3] = 'ا' AND w[4] = 'ئ'", "125"), ("w[2] = 'ا' AND w[5] = 'ة'", "134"), ("w[3] = 'ا' AND w[5] = 'ي'", "124")],
    4: [("w[1] = 'م'", "234"), ("w[2] = 'ا'", "134"), ("w[3] IN ('ا','و','ي')", "124"), ("w[4] = 'ة'", "123")],
}
_LONG_RULES = {6: [("w[1] = 'ا' AND w[5] = 'ا'", "2346"), ("left(w, 2) = 'مت'", "3456")], 5: [("w[1] IN ('ا','ت','م')", "2345"), ("w[5] = 'ة'", "1234"), ("w[3] = 'ا'", "1245")], 4: []}


def _stem_sql(source: str) -> str:
    """CTEs from `source` (token) to stem (token, stem)."""
    cases = lambda rules, otherwise: f"CASE {' '.join(f'WHEN {c} THEN {_LETTERS_OF(p)}' for c, p in rules)} ELSE {otherwise} END" if rules else otherwise
    cuts = [
        "CASE WHEN length(w) >= 6 AND left(w, 3) IN ('كال','بال','ولل','وال') THEN substr(w, 4) WHEN length(w) >= 5 AND left(w, 2) IN ('ال','لل') THEN substr(w, 3) ELSE w END",
        "CASE WHEN length(w) >= 6 AND right(w, 3) IN ('تمل','همل','تان','تين','كمل') THEN left(w, -3) WHEN length(w) >= 5 AND right(w, 2) IN ('ون','ات','ان','ين','تن','كم','هن','نا','يا','ها','تم','كن','ني','وا','ما','هم') THEN left(w, -2) ELSE w END",
        "CASE WHEN length(w) >= 4 AND left(w, 2) = 'وو' THEN substr(w, 2) ELSE w END",
        "regexp_replace(w, '^[آأإ]', 'ا')",
        f"CASE WHEN length(w) = 7 THEN {_OFF('w')} ELSE w END",
    ]
    steps = [f"t0 AS (SELECT token, regexp_replace(token, '[\\x{{064B}}-\\x{{0652}}]', '', 'g') AS w FROM {source})", f"t1 AS (SELECT token, w, list_contains({_LISTED(stemmer.KEPT)}, w) AS done FROM t0)"]
    for cut in cuts:
        steps.append(f"t{len(steps)} AS (SELECT token, CASE WHEN done THEN w ELSE {cut} END AS w, done FROM t{len(steps) - 1})")
    for n in (6, 5, 4):
        steps.append(f"t{len(steps)} AS (SELECT token, w, done, CASE WHEN NOT done AND length(w) = {n} THEN {cases(_RULES[n], _OFF('w'))} ELSE w END AS o FROM t{len(steps) - 1})")
        same = f"NOT done AND length(w) = {n} AND length(o) = {n}"
        steps.append(f"t{len(steps)} AS (SELECT token, CASE WHEN {same} THEN {cases(_LONG_RULES[n], 'w')} ELSE o END AS w, done OR ({same}) AS done FROM t{len(steps) - 1})")
    return ", ".join(steps) + f", stem AS (SELECT token, w AS stem FROM t{len(steps) - 1})"


_GUARDED = f"CASE WHEN list_contains({_LISTED(PROTECTED)}, {_NORMAL(_STRIP('token'))}) OR length(stem) < 2 THEN token ELSE stem END"
_STEMMED = f"{_KEPT}, tokens AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM tok), words AS (SELECT token, count(*) AS n FROM tokens GROUP BY ALL), {_stem_sql('words')}, terms AS (SELECT token, n, {_GUARDED} AS term, CASE WHEN stem = '' THEN token ELSE stem END AS unguarded FROM words JOIN stem USING (token)), postings AS (SELECT doc_id, term AS token, pos FROM tokens JOIN terms USING (token))"
_BM25 = """tf AS (SELECT token, doc_id, count(*) AS tf FROM postings GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY ALL),
        n AS (SELECT CAST(count(DISTINCT doc_id) AS DOUBLE) AS n FROM documents), dl AS (SELECT doc_id, CAST(len(t) AS DOUBLE) AS dl FROM tok), av AS (SELECT sum(dl) / count(*) AS avgdl FROM dl),
        score AS (SELECT qid, doc_id, sum(qtf * ln((n - df + 5e-1) / (df + 5e-1) + 1) * tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * dl / avgdl))) AS score
          FROM qt JOIN tf USING (token) JOIN df USING (token) JOIN dl USING (doc_id), n, av GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM score WHERE score > 0)
        SELECT qid, doc_id, round(score, 4) AS score, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 10"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (arabic_normalized, arabic_tokens, arabic_stopped, arabic_protected, arabic_stripped, arabic_phrase, arabic_boolean, arabic_bm25, arabic_stemmed, arabic_stemmed_postings, arabic_stemmed_bm25)}

ORACLE_SQL: dict[str, str] = {
    "arabic_normalized": f"WITH {_CORPUS} SELECT doc_id, md5({_NORMAL('text')}) AS normalized FROM c",
    "arabic_tokens": f"{_ALL}, {_POSTINGS} SELECT doc_id, token, pos FROM postings",
    "arabic_stopped": f"{_KEPT}, {_POSTINGS} SELECT doc_id, token, pos FROM postings",
    "arabic_protected": f"{_KEPT}, {_POSTINGS} SELECT token, count(*) AS n FROM postings WHERE list_contains({_LISTED(PROTECTED)}, {_NORMAL(_STRIP('token'))}) GROUP BY ALL",
    "arabic_stripped": f"WITH {_CORPUS}, w AS (SELECT DISTINCT unnest(string_split_regex(text, '[ \\n]+')) AS word FROM c) SELECT word, {_STRIP('word')} AS stripped, {_NORMAL(_STRIP('word'))} AS normalized FROM w WHERE word <> ''",
    "arabic_phrase": f"{_KEPT} SELECT doc_id FROM tok WHERE len(list_filter(range(1, len(t)), lambda i: t[i] = 'وف' AND t[i + 1] = 'تهل')) > 0",
    "arabic_boolean": f"{_KEPT} SELECT doc_id FROM tok WHERE ({_HAS('تهل')} AND NOT ({_HAS('اند')} OR {_HAS('تو')})) OR len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'يس' AND list_contains(t[greatest(1, i - 3):i + 3], 'وف'))) > 0",
    "arabic_bm25": f"""{_KEPT}, {_POSTINGS},
        qt AS (SELECT qid, token, count(*) AS qtf FROM (VALUES {_ASKED}) v(qid, token) GROUP BY ALL), {_BM25}""",
    "arabic_stemmed": f"{_STEMMED} SELECT token, n, term, unguarded FROM terms",
    "arabic_stemmed_postings": f"{_STEMMED} SELECT doc_id, token AS term, pos FROM postings",
    "arabic_stemmed_bm25": f"""{_STEMMED.replace("words AS (SELECT token, count(*) AS n FROM tokens GROUP BY ALL)", f"qw AS (SELECT * FROM (VALUES {_ASKED}) v(qid, token)), words AS (SELECT token, count(*) AS n FROM (SELECT token FROM tokens UNION ALL SELECT token FROM qw) GROUP BY ALL)")},
        qt AS (SELECT qid, term AS token, count(*) AS qtf FROM qw JOIN terms USING (token) GROUP BY ALL), {_BM25}""",
}
