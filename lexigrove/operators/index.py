"""The positional inverted index as DataFrames, and lookups and statistics over it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.analysis import Profile, analyze, has_foreign, stemmed


@dataclass(frozen=True)
class Index:
    """documents (doc_id, doc_seq): the universe, documents without tokens included. postings (term, doc_id, pos).

    tf, term_stats, doc_stats, weights, norms and the two totals derive from these, or are read where the index is a stored
    one; nothing is collected but the totals.
    """

    documents: DataFrame
    postings: DataFrame
    profile: Profile
    stored: bool = False

    @cached_property
    def tf(self) -> DataFrame:
        """(term, doc_id, tf)"""
        return self.postings.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))

    @cached_property
    def term_stats(self) -> DataFrame:
        """(term, df)"""
        return self.tf.groupBy("term").agg(F.count("*").alias("df"))

    @cached_property
    def lists(self) -> DataFrame:
        """(term, doc_id, p): the sorted positions."""
        return self.postings.groupBy("term", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("p"))

    @cached_property
    def doc_stats(self) -> DataFrame:
        """(doc_id, doc_seq, dl): 0 for a document without tokens."""
        lengths = self.postings.groupBy("doc_id").agg(F.count("*").alias("dl"))
        return self.documents.join(lengths, "doc_id", "left").select("doc_id", "doc_seq", F.coalesce("dl", F.lit(0)).alias("dl"))

    @cached_property
    def weights(self) -> DataFrame:
        """(term, doc_id, w): (1 + log10 tf) log10(N / df)"""
        idf = F.log10(F.lit(float(self.n_docs)) / F.col("df"))
        return self.tf.join(self.term_stats, "term").select("term", "doc_id", ((1 + F.log10("tf")) * idf).alias("w"))

    @cached_property
    def norms(self) -> DataFrame:
        """(doc_id, norm) of documents with tokens: the length of the weight vector, 1 where that is 0."""
        norms = self.weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return norms.select("doc_id", F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm")).alias("norm"))

    @cached_property
    def n_docs(self) -> int:
        return self.documents.count()

    @cached_property
    def n_tokens(self) -> int:
        return self.doc_stats.agg(F.sum("dl")).first()[0] or 0

    def first_seen(self, terms: DataFrame) -> DataFrame:
        """terms (term, ...) with `seen`: the least (place of the document, position) at which each stands."""
        places = self.postings.join(terms.select("term"), "term", "left_semi").join(self.documents, "doc_id")
        return terms.join(places.groupBy("term").agg(F.min(F.struct("doc_seq", "pos")).alias("seen")), "term")

    @property
    def avgdl(self) -> float:
        return self.n_tokens / self.n_docs if self.n_docs else 0.0

    def only(self, terms: list[str]) -> DataFrame:
        """The postings of a few terms."""
        return self.postings.where(F.col("term").isin(terms)) if terms else self.postings.where("false")

    def units(self, phrases: list[list[str]]) -> list[list[tuple[int, str]]]:
        """For each phrase what to look up and where it stands in it."""
        return [list(enumerate(terms)) for terms in phrases]

    def postings_of(self, units: list[str]) -> DataFrame:
        return self.only(units)

    # Lookups by term.
    def document_frequency(self, term: str) -> DataFrame:
        return self.only([term]).agg(F.countDistinct("doc_id").alias("df"))

    def term_frequency(self, term: str, doc_id) -> DataFrame:
        return self.only([term]).where(F.col("doc_id") == doc_id).agg(F.count("*").alias("tf"))

    def documents_with(self, term: str) -> DataFrame:
        return self.only([term]).select("doc_id").distinct()

    def positions(self, term: str, doc_id) -> DataFrame:
        return self.only([term]).where(F.col("doc_id") == doc_id).agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def token_rows(documents: DataFrame, profile: Profile, id_col: str = "id", text_col: str = "full_text") -> DataFrame:
    """(doc_id, token, pos): one narrow pass, positions counted after stopwords are gone and before stemming."""
    return documents.select(F.col(id_col).alias("doc_id"), F.posexplode(analyze(F.col(text_col), profile)).alias("pos", "token"))


def build_index(documents: DataFrame, profile: Profile, id_col: str = "id", text_col: str = "full_text", seq_col: str = "doc_seq") -> Index:
    """Rows of one id are one document: its place is the first row's, and each row's positions count from 0."""
    universe = documents.groupBy(F.col(id_col).alias("doc_id")).agg(F.min(seq_col).alias("doc_seq"))
    rows = stemmed(token_rows(documents, profile, id_col, text_col), "token", profile)
    return Index(universe, rows.select("term", "doc_id", "pos"), profile)


def arabic_only(index: Index) -> tuple[Index, DataFrame]:
    """The index without terms of foreign characters, and (term, df) of those removed."""
    kept = Index(index.documents, index.postings.where(~has_foreign(F.col("term"))), index.profile)
    if index.stored:  # what is known of a term doesn't depend on others
        vars(kept).update(tf=index.tf.where(~has_foreign(F.col("term"))), term_stats=index.term_stats.where(~has_foreign(F.col("term"))))
    removed = index.postings.where(has_foreign(F.col("term"))).groupBy("term").agg(F.countDistinct("doc_id").alias("df"))
    return kept, removed


def foreign_terms(index: Index) -> DataFrame:
    """(n): how many terms have foreign characters."""
    return index.term_stats.where(has_foreign(F.col("term"))).agg(F.count("*").alias("n"))


def collection_stats(index: Index) -> DataFrame:
    """One row: documents, terms, mean distinct terms of a document, mean term length."""
    each = index.term_stats.agg(F.count("*").alias("terms"), F.sum("df").alias("pairs"), F.avg(F.length("term")).alias("mean_term_length"))
    size = F.lit(index.n_docs).cast("long")
    return each.select(size.alias("documents"), "terms", (F.coalesce("pairs", F.lit(0)) / F.greatest(size, F.lit(1))).alias("mean_terms_per_document"), "mean_term_length")


def share_of_documents(df: Column, n_docs: int) -> Column:
    return df / F.lit(max(n_docs, 1)) * 100


def top_terms(index: Index, k: int = 10) -> DataFrame:
    """(term, df, share): the k most widespread terms, ties in the order in which terms were first seen. Only terms as widespread
    as the k-th are looked up in the postings."""
    least = index.term_stats.orderBy(F.desc("df")).limit(k).agg(F.min("df").alias("least"))
    widespread = index.term_stats.join(F.broadcast(least), F.col("df") >= F.col("least")).drop("least")
    return index.first_seen(widespread).orderBy(F.desc("df"), "seen").limit(k).select("term", "df", share_of_documents(F.col("df"), index.n_docs).alias("share"))


def rare_terms(index: Index, k: int = 10) -> DataFrame:
    """(term, more): the k terms of one document that were seen first, and how many such terms follow them."""
    once = index.term_stats.where("df = 1").select("term")
    return index.first_seen(once).orderBy("seen").limit(k).select("term").withColumn("more", F.greatest(F.lit(once.count() - k), F.lit(0)).cast("long"))
