"""Named queries over the shared test tables, each with the same question in DuckDB SQL.

The tables hold no Arabic, so they are read with the `latin` profile (and `digits`, which keeps what the Arabic chain keeps of
such text); the Arabic chain is covered by fixtures in tests/. Scores are shown with four decimals and ranked on nine, so that
the order of a floating-point sum cannot flip two rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.functions.analysis import DIGITS, LATIN, Profile
from lexigrove.operators import batch, boolean, display, evaluation, index, packed, ranking
from lexigrove.sources import workspace
from lexigrove.sources.sinks import index_lines

STOP = ("a", "an", "and", "de", "in", "la", "of", "on", "the", "to")
STOPPED = LATIN.with_lexicons(stopwords=STOP)
RANKED = {
    "1": "licensed under the apache license",
    "2": "idiot moron worthless clown",
    "3": "thereon onwhst therhe ingth the",
    "4": "apache apache license version",
    "5": "una de los ciones que el",
}
BOOLEAN = {
    "1": "license",
    "2": "idiot OR moron",
    "3": '"under the"',
    "4": "licensed AND NOT apache",
    "5": "#3(licensed,license)",
    "6": "(mit OR apache) AND license",
    "7": "NOT the",
    "8": "und die",
}


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.col("doc_id").alias("doc_seq"))


def built(spark: SparkSession, sf_dir: str, profile: Profile = LATIN) -> index.Index:
    return index.build_index(corpus(spark, sf_dir), profile, "doc_id", "text")


#: Where this process has stored an index, by session, tables and profile, and the files it was made of.
_STORED: dict[tuple, tuple[str, tuple]] = {}


def _files(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of each of a table's files, as the store lists them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return tuple(sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in found))


def indexed(spark: SparkSession, sf_dir: str, profile: Profile = LATIN, of: Callable[[SparkSession, str], DataFrame] = corpus) -> packed.StoredIndex:
    """The index of a corpus, built and stored when a session first asks for it and read back until the table's files change; the
    replaced one is deleted."""
    key, files = (spark.sparkContext.applicationId, sf_dir, profile, of.__module__), _files(spark, f"{sf_dir}/documents.parquet")
    path, made_of = _STORED.get(key, (None, None))
    if made_of != files:
        if path:
            old = spark._jvm.org.apache.hadoop.fs.Path(path)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        path = workspace.fresh(spark, "index")
        packed.store(of(spark, sf_dir), profile, path, "doc_id", "text")
        _STORED[key] = path, files
    return packed.load(spark, path, profile)


_TOKENS = "tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents)"
_STOPPED = f"tok AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: NOT list_contains({list(STOP)!r}, x)) AS t FROM documents)"
_POSTINGS = "postings AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM tok)"
_BASE = f"WITH {_TOKENS}, {_POSTINGS}"
_STATS = """
    tf AS (SELECT term, doc_id, count(*) AS tf FROM postings GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
    n AS (SELECT CAST(count(DISTINCT doc_id) AS DOUBLE) AS n FROM documents),
    dl AS (SELECT doc_id, CAST(len(t) AS DOUBLE) AS dl FROM tok),
    av AS (SELECT sum(dl) / count(*) AS avgdl FROM dl)"""


_SEEN = ", seen AS (SELECT term, s.doc_id AS doc, s.pos AS pos FROM (SELECT term, min({'doc_id': doc_id, 'pos': pos}) AS s FROM postings GROUP BY ALL))"


def _asked(queries: dict[str, str]) -> str:
    values = ", ".join(f"('{k}', '{v}')" for k, v in queries.items())
    return f"""
    qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM (VALUES {values}) q(qid, text)) GROUP BY ALL)"""


_BM25 = """
    score AS (SELECT qid, doc_id, sum(qtf * ln((n - df + 5e-1) / (df + 5e-1) + 1) * tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * dl / avgdl))) AS score
      FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), n, av GROUP BY ALL)"""
_COSINE = """
    w AS (SELECT term, doc_id, (1 + log10(tf)) * log10(n / df) AS w FROM tf JOIN df USING (term), n),
    norm AS (SELECT doc_id, CASE WHEN sum(w * w) = 0 THEN 1e0 ELSE sqrt(sum(w * w)) END AS norm FROM w GROUP BY ALL),
    wq AS (SELECT qid, term, (1 + log10(qtf)) * log10(n / df) AS wq FROM qt JOIN df USING (term), n),
    qnorm AS (SELECT qid, CASE WHEN sum(wq * wq) = 0 THEN 1e0 ELSE sqrt(sum(wq * wq)) END AS qnorm FROM wq GROUP BY ALL),
    dot AS (SELECT qid, doc_id, sum(wq * w) AS dot FROM wq JOIN w USING (term) GROUP BY ALL),
    raw AS (SELECT qid, doc_id, least(1e0, greatest(0e0, dot / (qnorm * norm))) AS raw FROM dot JOIN qnorm USING (qid) JOIN norm USING (doc_id)),
    score AS (SELECT qid, doc_id, raw / max(raw) OVER (PARTITION BY qid) AS score FROM raw WHERE raw > 0)"""
_TOP = """
    ranked AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM score WHERE score > 0)"""
_ROW = "qid, doc_id, round(score, 4) AS score, CAST(rank AS BIGINT) AS rank"


def _ranked_sql(kind: str, queries: dict[str, str], select: str = f"SELECT {_ROW} FROM ranked WHERE rank <= 10") -> str:
    return f"{_BASE}, {_STATS}, {_asked(queries)}, {_BM25 if kind == 'bm25' else _COSINE}, {_TOP} {select}"


def _ranked(spark: SparkSession, sf_dir: str, kind: str, queries: dict[str, str], k: int = 10) -> DataFrame:
    at, asked = indexed(spark, sf_dir), ranking.queries_frame(spark, queries)
    scores = ranking.bm25_scores(at, asked) if kind == "bm25" else ranking.cosine_scores(at, asked)
    return ranking.top(scores, k, F.round("score", 9))


def _shown(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("qid", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"), *more)


def _search(query: str, profile: Profile = LATIN) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: boolean.search_many(indexed(spark, sf_dir, profile), {"q": query}).select("doc_id")


def _has(term: str) -> str:
    return f"list_contains(t, '{term}')"


def _phrase(words: str) -> str:
    parts = words.split()
    return f"len(list_filter(range(1, len(t) - {len(parts) - 2}), lambda i: {' AND '.join(f"t[i + {j}] = '{w}'" for j, w in enumerate(parts))})) > 0"


def _near(a: str, b: str, d: int) -> str:
    return f"len(list_filter(range(1, len(t) + 1), lambda i: t[i] = '{a}' AND list_contains(t[greatest(1, i - {d}):i + {d}], '{b}'))) > 0"


def _where(condition: str, tokens: str = _TOKENS) -> str:
    return f"WITH {tokens} SELECT doc_id FROM tok WHERE {condition}"


#: Query text, the same as a condition over a document's token list t, and the profile.
SEARCHES: dict[str, tuple[str, str, Profile]] = {
    "bool_term": ("license", _has("license"), LATIN),
    "bool_and": ("licensed AND version", f"{_has('licensed')} AND {_has('version')}", LATIN),
    "bool_or": ("idiot OR moron", f"{_has('idiot')} OR {_has('moron')}", LATIN),
    "bool_and_not": ("licensed AND NOT apache", f"{_has('licensed')} AND NOT {_has('apache')}", LATIN),
    "bool_not": ("NOT the", f"NOT {_has('the')}", LATIN),
    "bool_precedence": ("mit OR apache AND version", f"{_has('mit')} OR ({_has('apache')} AND {_has('version')})", LATIN),
    "bool_nested_parens": ("((mit OR apache) AND license) OR (NOT (of OR de) AND NOT en)", f"(({_has('mit')} OR {_has('apache')}) AND {_has('license')}) OR (NOT ({_has('of')} OR {_has('de')}) AND NOT {_has('en')})", LATIN),
    "bool_first_operand": ("apache mit", _has("apache"), LATIN),
    "bool_leftover_paren": ("license OR (apache AND version", _has("license"), LATIN),
    "bool_stray_paren": ("license OR version) AND apache", f"({_has('license')} OR {_has('version')}) AND {_has('apache')}", LATIN),
    "bool_not_stray_paren": ("NOT ) license", "false", LATIN),
    "bool_empty_quotes": ('"" OR license', "false", LATIN),
    "bool_not_empty_quotes": ('NOT ""', "false", LATIN),
    "bool_after_empty_quotes": ('"" license', _has("license"), LATIN),
    "bool_underflow": ("AND license", "false", LATIN),
    "bool_split_operand": ("gnu-mit", f"{_has('gnu')} OR {_has('mit')}", LATIN),
    "bool_stopword": ("license AND NOT the", _has("license"), STOPPED),
    "phrase_2": ('"of the"', _phrase("of the"), LATIN),
    "phrase_3": ('"under the apache"', _phrase("under the apache"), LATIN),
    "phrase_repeated": ('"the the"', _phrase("the the"), LATIN),
    "phrase_over_stopwords": ('"under the apache"', _phrase("under apache"), STOPPED),
    "proximity_d": ("#5(the,of)", _near("the", "of", 5), LATIN),
    "proximity_far": ("#40(license,the)", _near("license", "the", 40), LATIN),
    "proximity_same_term": ("#3(license,license)", _has("license"), LATIN),
    "proximity_zero": ("#0(the,of)", "false", LATIN),
    "proximity_in_boolean": ("#2(mit,license) OR #2(apache,version)", f"{_near('mit', 'license', 2)} OR {_near('apache', 'version', 2)}", LATIN),
}


def _batch_boolean_sql() -> str:
    has = {"1": _has("license"), "2": f"{_has('idiot')} OR {_has('moron')}", "3": _phrase("under the"), "4": f"{_has('licensed')} AND NOT {_has('apache')}", "5": _near("licensed", "license", 3), "6": f"({_has('mit')} OR {_has('apache')}) AND {_has('license')}", "7": f"NOT {_has('the')}", "8": _has("und")}
    return f"WITH {_TOKENS} " + " UNION ALL ".join(f"SELECT '{qid}' AS qid, doc_id FROM tok WHERE {c}" for qid, c in has.items())


def tokens_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.token_rows(corpus(spark, sf_dir), DIGITS, "doc_id", "text").select("doc_id", "token", F.col("pos").cast("long").alias("pos"))


def postings_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).postings.select("term", "doc_id", F.col("pos").cast("long").alias("pos"))


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds and stores the index anew; one row of its totals."""
    path = workspace.fresh(spark, "index")
    packed.store(corpus(spark, sf_dir), LATIN, path, "doc_id", "text")
    at = packed.load(spark, path, LATIN).complete()
    return at.doc_stats.agg(F.count("*").alias("documents"), F.sum("dl").alias("tokens")).join(at.term_stats.agg(F.count("*").alias("terms")))


def postings_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir, STOPPED).postings.select("term", "doc_id", F.col("pos").cast("long").alias("pos"))


def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir).term_stats.select("term", F.col("df").cast("long").alias("df"))


def doc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir).doc_stats.select("doc_id", F.col("dl").cast("long").alias("dl"))


def tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir).tf.select("term", "doc_id", "tf")


def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir).weights.select("term", "doc_id", F.round("w", 6).alias("w"))


def doc_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir).norms.select("doc_id", F.round("norm", 6).alias("norm"))


def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index.collection_stats(indexed(spark, sf_dir))
    return rows.select("documents", "terms", F.round("mean_terms_per_document", 6).alias("mean_terms_per_document"), F.round("mean_term_length", 6).alias("mean_term_length"))


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = indexed(spark, sf_dir)
    df, tf_ = at.document_frequency("license"), at.term_frequency("the", 1)
    return df.select(F.lit("df").alias("what"), F.col("df").alias("n")).union(tf_.select(F.lit("tf"), "tf")).union(at.positions("the", 1).select(F.lit("positions"), F.coalesce(F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a * 31 % 1000003 + x), F.lit(0).cast("long"))))


def documents_with_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir).documents_with("apache")


def foreign_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.foreign_terms(indexed(spark, sf_dir))


def arabic_only_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = index.arabic_only(indexed(spark, sf_dir))
    return kept.term_stats.select("term", "df")


def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.top_terms(indexed(spark, sf_dir)).select("term", "df", F.round("share", 4).alias("share"))


def rare_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.rare_terms(indexed(spark, sf_dir))


def index_dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = indexed(spark, sf_dir)
    return index_lines(at.postings, at.lists, at.term_stats).select("term", "line")


def bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_ranked(spark, sf_dir, "bm25", {"1": RANKED["1"]}))


def bm25_dup_query_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_ranked(spark, sf_dir, "bm25", {"4": RANKED["4"]}))


def cosine_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_ranked(spark, sf_dir, "cosine", {"1": RANKED["1"]}))


def batch_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_ranked(spark, sf_dir, "cosine", RANKED))


def batch_ranked_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_ranked(spark, sf_dir, "bm25", RANKED))


def bm25_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch again, unpacking only blocks that can hold a result."""
    return _shown(packed.rank_bm25(indexed(spark, sf_dir), ranking.queries_frame(spark, RANKED), 10, key=F.round("score", 9)))


def batch_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boolean.search_many(indexed(spark, sf_dir), BOOLEAN)


def batch_boolean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch as rows, and the searches of this catalogue that read the same profile."""
    queries = BOOLEAN | {name: query for name, (query, _, profile) in SEARCHES.items() if profile is LATIN}
    return batch.search_batch(indexed(spark, sf_dir), ranking.queries_frame(spark, queries))


def batch_boolean_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each benchmark item: its second and third words and not its fourth, or its last two as a phrase."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id is not null").select(F.col("item_id").cast("string").alias("qid"), words.alias("w")).where("size(w) >= 4")
    at = lambda i: F.concat(F.lit("#0("), F.element_at("w", i), F.lit(","), F.element_at("w", i), F.lit(")"))
    text = F.concat(at(2), F.lit(" AND "), at(3), F.lit(" AND NOT "), at(4), F.lit(' OR "'), F.element_at("w", -2), F.lit(" "), F.element_at("w", -1), F.lit('"'))
    return batch.search_batch(indexed(spark, sf_dir), rows.select("qid", text.alias("text")))


def confidence_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranked(spark, sf_dir, "cosine", RANKED, 15).withColumn("score", F.round("score", 4))
    return _shown(rows.withColumn("confidence", display.cosine_label(F.col("score"))), "confidence")


def confidence_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranked(spark, sf_dir, "bm25", RANKED, 15)
    return _shown(rows.withColumn("confidence", display.bm25_label(F.col("rank"))), "confidence")


def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = display.summary(_ranked(spark, sf_dir, "bm25", RANKED, 50))
    return rows.select("qid", "n", F.round("best", 4).alias("best"), F.round("mean", 4).alias("mean"))


def display_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, query = indexed(spark, sf_dir), "license OR apache AND NOT apache OR mit"
    return display.boolean_rows(at, boolean.search_many(at, {"q": query}), query)


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 runs of the ranked queries held against the quality labels as judgements."""
    qrels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.explode(F.array(*map(F.lit, RANKED))).alias("qid"), "doc_id", F.col("quality").alias("rel"))
    run = _ranked(spark, sf_dir, "bm25", RANKED, 50)
    row = evaluation.evaluate(qrels, run, 10)
    return row.select(*[F.round(c, 6).alias(c) for c in ("map", "mrr", "p_at_k", "r_at_k")])


_BANDS = "CASE WHEN round(score, 4) > 8e-1 THEN '🟢 Excellente' WHEN round(score, 4) > 5e-1 THEN '🟡 Bonne' WHEN round(score, 4) > 2e-1 THEN '🟠 Faible' ELSE '🔴 Très faible' END"
_PLACES = "CASE WHEN rank <= 3 THEN '🟢 Top 3' WHEN rank <= 10 THEN '🟡 Top 10' ELSE '⚪ Classé' END"
_BLOCKS = "[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿0-9]"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (tokens_digits, postings_latin, index_build, postings_stopped, term_df, doc_length, tf, tfidf_weights, doc_norms, collection_stats, lookups, documents_with_term, foreign_terms, arabic_only_terms, top_terms, rare_terms, index_dump_lines, bm25_top10, bm25_dup_query_term, cosine_top10, batch_ranked, batch_ranked_bm25, bm25_pruned, batch_boolean, batch_boolean_rows, batch_boolean_items, confidence_cosine, confidence_bm25, result_summary, display_boolean, eval_metrics)
} | {name: _search(query, profile) for name, (query, _, profile) in SEARCHES.items()}

ORACLE_SQL: dict[str, str] = {
    "tokens_digits": "WITH tok AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\\x{0600}-\\x{06FF}0-9]+') AS t FROM documents) SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM tok",
    "postings_latin": f"{_BASE} SELECT term, doc_id, pos FROM postings",
    "postings_stopped": f"WITH {_STOPPED}, {_POSTINGS} SELECT term, doc_id, pos FROM postings",
    "index_build": f"{_BASE} SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS documents, count(*) AS tokens, count(DISTINCT term) AS terms FROM postings",
    "term_df": f"{_BASE} SELECT term, count(DISTINCT doc_id) AS df FROM postings GROUP BY ALL",
    "doc_length": f"WITH {_TOKENS} SELECT doc_id, len(t) AS dl FROM tok",
    "tf": f"{_BASE} SELECT term, doc_id, count(*) AS tf FROM postings GROUP BY ALL",
    "tfidf_weights": f"{_BASE}, {_STATS} SELECT term, doc_id, round((1 + log10(tf)) * log10(n / df), 6) AS w FROM tf JOIN df USING (term), n",
    "doc_norms": f"{_BASE}, {_STATS}, w AS (SELECT doc_id, (1 + log10(tf)) * log10(n / df) AS w FROM tf JOIN df USING (term), n) SELECT doc_id, round(CASE WHEN sum(w * w) = 0 THEN 1e0 ELSE sqrt(sum(w * w)) END, 6) AS norm FROM w GROUP BY ALL",
    "collection_stats": f"{_BASE}, {_STATS} SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS documents, count(*) AS terms, round(CAST(sum(df) AS DOUBLE) / (SELECT n FROM n), 6) AS mean_terms_per_document, round(avg(length(term)), 6) AS mean_term_length FROM df",
    "lookups": f"{_BASE} SELECT 'df' AS what, count(DISTINCT doc_id) AS n FROM postings WHERE term = 'license' UNION ALL SELECT 'tf', count(*) FROM postings WHERE term = 'the' AND doc_id = 1 UNION ALL SELECT 'positions', coalesce((SELECT list_reduce(list_prepend(0::BIGINT, list(pos ORDER BY pos)), lambda a, x: a * 31 % 1000003 + x) FROM postings WHERE term = 'the' AND doc_id = 1), 0)",
    "documents_with_term": f"WITH {_TOKENS} SELECT doc_id FROM tok WHERE {_has('apache')}",
    "foreign_terms": f"{_BASE} SELECT count(DISTINCT term) AS n FROM postings WHERE NOT regexp_full_match(term, '{_BLOCKS}+')",
    "arabic_only_terms": f"{_BASE} SELECT term, count(DISTINCT doc_id) AS df FROM postings WHERE regexp_full_match(term, '{_BLOCKS}+') GROUP BY ALL",
    "top_terms": f"{_BASE}, {_STATS} {_SEEN} SELECT term, df, round(df / (SELECT n FROM n) * 100, 4) AS share FROM df JOIN seen USING (term) ORDER BY df DESC, doc, pos LIMIT 10",
    "rare_terms": f"{_BASE}, {_STATS} {_SEEN} SELECT term, greatest((SELECT count(*) FROM df WHERE df = 1) - 10, 0) AS more FROM df JOIN seen USING (term) WHERE df = 1 ORDER BY doc, pos LIMIT 10",
    "index_dump_lines": f"{_BASE}, {_STATS} SELECT term, term || ':' || df AS line FROM df UNION ALL SELECT term, chr(9) || doc_id || ': ' || string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FROM postings GROUP BY term, doc_id",
    "bm25_top10": _ranked_sql("bm25", {"1": RANKED["1"]}),
    "bm25_dup_query_term": _ranked_sql("bm25", {"4": RANKED["4"]}),
    "cosine_top10": _ranked_sql("cosine", {"1": RANKED["1"]}),
    "batch_ranked": _ranked_sql("cosine", RANKED),
    "batch_ranked_bm25": _ranked_sql("bm25", RANKED),
    "bm25_pruned": _ranked_sql("bm25", RANKED),
    "batch_boolean": _batch_boolean_sql(),
    "batch_boolean_rows": _batch_boolean_sql() + "".join(f" UNION ALL SELECT '{name}', doc_id FROM tok WHERE {condition}" for name, (_, condition, profile) in SEARCHES.items() if profile is LATIN),
    "batch_boolean_items": f"""WITH {_TOKENS}, w AS (SELECT CAST(item_id AS VARCHAR) AS qid, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
        d AS (SELECT doc_id, t, list_distinct(t) AS s, ' ' || array_to_string(t, ' ') || ' ' AS line FROM tok)
        SELECT qid, doc_id FROM w, d WHERE len(w) >= 4 AND (list_contains(s, w[2]) AND list_contains(s, w[3]) AND NOT list_contains(s, w[4]) OR contains(line, ' ' || w[-2] || ' ' || w[-1] || ' '))""",
    "confidence_cosine": _ranked_sql("cosine", RANKED, f"SELECT {_ROW}, {_BANDS} AS confidence FROM ranked WHERE rank <= 15"),
    "confidence_bm25": _ranked_sql("bm25", RANKED, f"SELECT {_ROW}, {_PLACES} AS confidence FROM ranked WHERE rank <= 15"),
    "result_summary": _ranked_sql("bm25", RANKED, "SELECT qid, count(*) AS n, round(max(score), 4) AS best, round(avg(score), 4) AS mean FROM ranked WHERE rank <= 50 GROUP BY ALL"),
    "display_boolean": f"""{_BASE},
        q AS (SELECT unnest(['license', 'or', 'apache', 'and', 'not', 'apache', 'or', 'mit']) AS term),
        hit AS (SELECT doc_id FROM tok WHERE {_has('license')} OR ({_has('apache')} AND NOT {_has('apache')}) OR {_has('mit')}),
        c AS (SELECT doc_id, term, count(*) AS n FROM postings GROUP BY ALL)
        SELECT doc_id, count(n) AS found, CAST(coalesce(sum(n), 0) AS BIGINT) AS occurrences, CASE WHEN count(n) > 0 THEN 'license, or, apache... (+5)' ELSE '0 terme(s) trouvé(s)' END AS terms
        FROM hit LEFT JOIN (SELECT c.doc_id, c.n FROM q JOIN c USING (term)) USING (doc_id) GROUP BY ALL""",
    "eval_metrics": _ranked_sql("bm25", RANKED, f"""
        , qr AS (SELECT qid, doc_id FROM labels, (VALUES {', '.join(f"('{q}')" for q in RANKED)}) q(qid) WHERE quality > 0),
        nr AS (SELECT qid, count(*) AS n_rel FROM qr GROUP BY ALL),
        m AS (SELECT r.qid, r.rank, CASE WHEN qr.doc_id IS NULL THEN 0 ELSE 1 END AS hit FROM ranked r LEFT JOIN qr ON r.qid = qr.qid AND r.doc_id = qr.doc_id WHERE rank <= 50),
        h AS (SELECT *, sum(hit) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM m),
        e AS (SELECT qid, sum(CASE WHEN hit = 1 THEN CAST(hits AS DOUBLE) / rank END) AS gains, min(CASE WHEN hit = 1 THEN rank END) AS first, sum(CASE WHEN hit = 1 AND rank <= 10 THEN 1 ELSE 0 END) AS at_k FROM h GROUP BY ALL)
        SELECT round(avg(coalesce(gains / n_rel, 0)), 6) AS map, round(avg(coalesce(1e0 / first, 0)), 6) AS mrr, round(avg(coalesce(at_k / 1e1, 0)), 6) AS p_at_k, round(avg(coalesce(CAST(at_k AS DOUBLE) / n_rel, 0)), 6) AS r_at_k FROM nr LEFT JOIN e USING (qid)"""),
} | {name: _where(condition, _STOPPED if profile.stopwords else _TOKENS) for name, (_, condition, profile) in SEARCHES.items()}
