"""Boolean, phrase and proximity retrieval.

The postings are read once for each kind of leaf (terms, phrases, proximities), cut down to the leaves' terms. Each kind
gives (leaf, doc_id) hits; hits become one row of flags per document, and each query one boolean column over them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.functions.analysis import analyze_texts
from lexigrove.operators.index import Index
from lexigrove.plans.query_language import Leaf, Node, denotation, leaves


#: A query batch of at most this many (term, leaf) entries is broadcast to the postings; a larger one is joined by shuffle.
FEW_ENTRIES = 100_000


def _few(rows: DataFrame) -> bool:
    return rows.limit(FEW_ENTRIES + 1).count() <= FEW_ENTRIES


def _asked(postings: DataFrame, entries: DataFrame) -> DataFrame:
    """The postings of the entries' terms, beside each entry: one scan for all leaves of a kind."""
    return postings.join(F.broadcast(entries) if _few(entries) else entries, "term")


def containing_rows(postings: DataFrame, entries: DataFrame) -> DataFrame:
    """(leaf, doc_id): documents with any of a leaf's terms, for entries (term, leaf)."""
    return _asked(postings, entries).select("leaf", "doc_id").distinct()


def phrase_rows(postings: DataFrame, entries: DataFrame) -> DataFrame:
    """(leaf, doc_id): documents with a leaf's terms at consecutive positions, for entries (term, leaf, i, n).

    A posting that is a phrase's i-th term votes for the start pos - i; a start with a vote for every i is an
    occurrence. One aggregation on (leaf, doc_id, start), however long the phrases and however many.
    """
    starts = _asked(postings, entries).groupBy("leaf", "doc_id", (F.col("pos") - F.col("i")).alias("start")).agg(F.count_distinct("i").alias("votes"), F.max("n").alias("n"))
    return starts.where("votes = n").select("leaf", "doc_id").distinct()


def near_rows(postings: DataFrame, entries: DataFrame) -> DataFrame:
    """(leaf, doc_id): documents where a left and a right term stand at most the leaf's distance apart, in either order, for
    entries (term, leaf, l, r, d), one for each term of a leaf.

    The nearest right position at or before a left one, and the other way round, are running maxima over a document's
    positions, so no pairs of positions are made: one exchange and one sort. A term of both lists is 0 apart.
    """
    so_far = Window.partitionBy("leaf", "doc_id").orderBy("pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda side: F.max(F.when(F.col(side), F.col("pos"))).over(so_far)
    gaps = _asked(postings, entries).withColumn("last_l", last("l")).withColumn("last_r", last("r"))
    hit = (F.col("l") & (F.col("pos") - F.col("last_r") <= F.col("d"))) | (F.col("r") & (F.col("pos") - F.col("last_l") <= F.col("d")))
    return gaps.where(hit).select("leaf", "doc_id").distinct()


def _entries(postings: DataFrame, entries: list[tuple], schema: str) -> DataFrame:
    return postings.sparkSession.createDataFrame(entries, f"term string, {schema}")


def containing_each(postings: DataFrame, leaves: dict[int, list[str]]) -> DataFrame:
    return containing_rows(postings, _entries(postings, [(t, leaf) for leaf, terms in leaves.items() for t in dict.fromkeys(terms)], "leaf long"))


def phrases(postings: DataFrame, leaves: dict[int, list[tuple[int, str]]]) -> DataFrame:
    """leaves: what each looks up, and where in the phrase it stands."""
    return phrase_rows(postings, _entries(postings, [(t, leaf, i, len(units)) for leaf, units in leaves.items() for i, t in units], "leaf long, i int, n int"))


def near_each(postings: DataFrame, leaves: dict[int, tuple[list[str], list[str], int]]) -> DataFrame:
    entries = [(t, leaf, t in left, t in right, d) for leaf, (left, right, d) in leaves.items() for t in dict.fromkeys([*left, *right])]
    return near_rows(postings, _entries(postings, entries, "leaf long, l boolean, r boolean, d int"))


def containing(postings: DataFrame, terms: list[str]) -> DataFrame:
    return containing_each(postings, {0: terms}).select("doc_id")


def phrase(postings: DataFrame, terms: list[str]) -> DataFrame:
    return phrases(postings, {0: list(enumerate(terms))}).select("doc_id")


def near(postings: DataFrame, left: list[str], right: list[str], distance: int) -> DataFrame:
    return near_each(postings, {0: (left, right, distance)}).select("doc_id")


def near_by_join(postings: DataFrame, left: list[str], right: list[str], distance: int) -> DataFrame:
    """The same as near(), as an equi-join on doc_id with a band condition."""
    a = postings.where(F.col("term").isin(left)).select("doc_id", "pos")
    b = postings.where(F.col("term").isin(right)).select(F.col("doc_id").alias("other"), F.col("pos").alias("at"))
    return a.join(b, (F.col("doc_id") == F.col("other")) & (F.abs(F.col("pos") - F.col("at")) <= distance), "left_semi").select("doc_id").distinct()


def _hits(index: Index, every: list[Leaf], terms: dict[Leaf, list[list[str]]]) -> list[DataFrame]:
    """(leaf, doc_id) tables, one for each kind of leaf that can match something."""
    plain, rows, close = {}, {}, {}
    for i, x in enumerate(every):
        found = terms[x]
        if not found or not all(found):
            continue
        if x.kind == "near":
            close[i] = (found[0], found[1], x.distance)
        elif x.kind == "phrase" and len(found[0]) > 1:
            rows[i] = found[0]
        else:
            plain[i] = found[0]
    units = dict(zip(rows, index.units(list(rows.values())), strict=True))
    postings = lambda lists: index.postings_of(sorted({t for ts in lists for t in ts}))
    out = []
    if plain:
        out.append(containing_each(postings(plain.values()), plain))
    if units:
        out.append(phrases(postings([t for _, t in us] for us in units.values()), units))
    if close:
        out.append(near_each(postings([*left, *right] for left, right, _ in close.values()), close))
    return out


def _condition(node: Leaf | Node, flag: dict[Leaf, Column]) -> Column:
    if isinstance(node, Leaf):
        return flag[node]
    parts = [_condition(p, flag) for p in node.parts]
    return ~parts[0] if node.op == "NOT" else parts[0] & parts[1] if node.op == "AND" else parts[0] | parts[1]


def search_many(index: Index, queries: dict[str, str]) -> DataFrame:
    """(qid, doc_id) for a batch of queries, in one plan; a blank query matches nothing."""
    spark = index.documents.sparkSession
    asked = {qid: denotation(text) for qid, text in queries.items() if text and text.strip()}
    every = list(dict.fromkeys(x for node in asked.values() for x in leaves(node)))
    texts = [t for x in every for t in x.texts]
    analysed = iter(analyze_texts(spark, texts, index.profile))
    terms = {x: [next(analysed) for _ in x.texts] for x in every}
    empty = index.documents.where("false").select(F.lit("").alias("qid"), "doc_id")
    if not asked:
        return empty
    found = _hits(index, every, terms)
    flags = {x: F.lit(False) for x in every}
    rows = index.documents
    if found:
        hits = reduce(DataFrame.union, found)
        each = hits.groupBy("doc_id").agg(*[F.max(F.col("leaf") == i).alias(f"leaf_{i}") for i in range(len(every))])
        rows = rows.join(each, "doc_id", "left")
        flags = {x: F.coalesce(F.col(f"leaf_{i}"), F.lit(False)) for i, x in enumerate(every)}
    answers = [F.when(_condition(node, flags), F.lit(qid)) for qid, node in asked.items()]
    return rows.select("doc_id", F.explode(F.array_compact(F.array(*answers))).alias("qid")).select("qid", "doc_id")


def search(index: Index, query: str) -> DataFrame:
    """(doc_id) of one query, ordered by number and then by text."""
    found = search_many(index, {"q": query}).select("doc_id")
    return found.orderBy(F.expr("try_cast(doc_id AS BIGINT)").asc_nulls_last(), "doc_id")
