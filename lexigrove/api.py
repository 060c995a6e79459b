"""The engine behind one object, and the batch run."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lexigrove.config import EngineConfig
from lexigrove.functions.analysis import ARABIC, Profile
from lexigrove.operators.batch import search_batch
from lexigrove.operators.boolean import search
from lexigrove.operators.index import Index, arabic_only, build_index
from lexigrove.operators.ranking import queries_frame, rank_bm25, rank_cosine
from lexigrove.sources import sinks, text_files
from lexigrove.sources.articles import read_articles


@dataclass
class SearchEngine:
    """An index with the ways to ask it. `last_seconds` is how long the last dispatch took, result included."""

    index: Index
    config: EngineConfig = EngineConfig()
    last_seconds: float | None = None

    @classmethod
    def from_config(cls, spark: SparkSession, config: EngineConfig) -> SearchEngine:
        """Read lexicons and corpus, index them, and keep only terms of Arabic characters and digits."""
        profile = ARABIC.with_lexicons(text_files.read_stopwords(spark, config.stopwords) if config.stopwords else (), text_files.read_protected_words(spark, config.protected_words) if config.protected_words else ())
        index, _ = arabic_only(build_index(read_articles(spark, config.corpus), profile))
        return cls(index, config)

    @classmethod
    def from_documents(cls, documents: DataFrame, profile: Profile, **columns: str) -> SearchEngine:
        return cls(build_index(documents, profile, **columns))

    def boolean(self, query: str) -> DataFrame:
        return search(self.index, query)

    def cosine(self, query: str, top_k: int = 50) -> DataFrame:
        return rank_cosine(self.index, queries_frame(self.index.documents.sparkSession, {"q": query}), top_k)

    def bm25(self, query: str, top_k: int = 50) -> DataFrame:
        return rank_bm25(self.index, queries_frame(self.index.documents.sparkSession, {"q": query}), top_k, self.config.k1, self.config.b)

    def dispatch(self, query: str, mode: str = "ranked", algorithm: str = "cosine") -> list:
        """The rows of one interactive search, timed: boolean, or ranked by either algorithm, at most 500."""
        began = time.perf_counter()
        if mode == "boolean":
            rows = self.boolean(query).collect()
        else:
            ask = self.cosine if algorithm == "cosine" else self.bm25
            rows = ask(query, self.config.top_k_interactive).orderBy("rank").collect()
        self.last_seconds = time.perf_counter() - began
        return rows

    def batch(self, boolean_queries: DataFrame, ranked_queries: DataFrame, output: str | None = None) -> tuple[DataFrame, DataFrame]:
        """All boolean queries, and all ranked ones by cosine with k = 10; written under `output` where it is given."""
        found = search_batch(self.index, boolean_queries)
        ranked = rank_cosine(self.index, ranked_queries, self.config.top_k_batch)
        if output:
            sinks.save_boolean_results(found, f"{output}/results.boolean")
            sinks.save_ranked_results(ranked, f"{output}/results.ranked")
            sinks.save_index(self.index.postings, f"{output}/index")
        return found, ranked
