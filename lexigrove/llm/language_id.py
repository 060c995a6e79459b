"""Language identification: known words by per-language log frequency, else ever shorter character n-grams.

Defined results: `und` with score 0 where a text is null or has no letter, or where nothing could be learned; a text
with letters of which no word and no n-gram is known gets the language with most training text, with score
1/languages; ties go to the alphabetically first. Repeated rows and null doc_ids each give a row; a null doc_id is
hashed as empty text; a lang whose texts have no letter is not learned; texts of any length are read whole; an empty table gives
an empty one. Only doc_id, text and, for learning, lang are read.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.scratch import Scratch

#: Learning takes about this many documents of each language at most (all, where there are fewer), by hash of doc_id.
SAMPLE = 2000
#: All words and n-grams of the sample are kept, those seen once, too. An expression costs in a language that has never shown it as
#: if it were seen so often in the largest table of its length: more than the rarest one anywhere.
UNSEEN = 0.5
LONGEST = 5
#: A worker remembers the scores of so many words, and at most so many numbers.
REMEMBERED, NUMBERS = 300_000, 4 << 20
WORD = re.compile(r"[^\W\d_]+")


def remainder(column: str, by: int) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % by


def learn(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Tables of scores (-log10 of relative frequency) from (doc_id, text, lang), of bounded size by SAMPLE."""
    rows = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    scratch = Scratch(docs.sparkSession, "language-id")
    # A row per language, written so that its size is known and the texts needn't be dealt by language to meet it.
    size = scratch.keep(rows.groupBy("lang").agg(F.count("*").alias("docs")), "languages")
    share = (F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31)) * F.col("docs") < sample
    rows = rows.join(size, "lang").where(share)
    words = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n")).select("lang", F.lit(0).alias("size"), "gram", "n")
    words = scratch.keep(words, "words")
    padded = F.concat(F.lit(" "), F.col("gram"), F.lit(" "))

    def cut(k: int) -> Column:
        at = F.sequence(F.lit(1), F.length(padded) - (k - 1))
        return F.when(F.length(padded) >= k, F.transform(at, lambda i: F.struct(F.lit(k).alias("size"), F.substring(padded, i, F.lit(k)).alias("gram"))))

    pieces = F.concat(*[F.coalesce(cut(k), F.array().cast("array<struct<size:int,gram:string>>")) for k in range(1, LONGEST + 1)])
    grams = words.select("lang", F.explode(pieces).alias("g"), "n").groupBy("lang", "g.size", "g.gram").agg(F.sum("n").alias("n"))
    table = words.union(grams)
    table = scratch.keep(table, "table")
    # A row per language and length: written, so its size is known, and broadcast, so no language's rows meet in one task.
    total = scratch.keep(table.groupBy("lang", "size").agg(F.sum("n").alias("total")), "totals")
    kept = table.join(F.broadcast(total), ["lang", "size"])
    most = total.where("size = 0").toPandas().sort_values(["total", "lang"], ascending=[False, True])
    if not (langs := sorted(most["lang"])):
        return {"langs": [], "common": None, "tables": []}
    largest = {r["size"]: r["total"] for r in total.groupBy("size").agg(F.max("total").alias("total")).collect()}  # a row for each length
    worst = F.element_at(F.array(*[F.lit(math.log10(largest.get(n, 1) / UNSEEN)) for n in range(LONGEST + 1)]), F.col("size") + 1)
    # A row per expression with its scores by language, which reach the driver as columns and stay so.
    by = kept.groupBy("size", "gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", -F.log10(F.col("n") / F.col("total"))))).alias("by"))
    scores = F.transform(F.array(*[F.lit(x) for x in langs]), lambda x: F.coalesce(F.try_element_at("by", x), worst))
    found = by.select("size", "gram", scores.alias("scores")).toArrow()
    tables = []
    for n in range(LONGEST + 1):
        own = found.filter(pc.equal(found["size"], n)).combine_chunks()
        flat = pc.list_flatten(own["scores"]).to_numpy()
        tables.append((own["gram"].combine_chunks(), flat.reshape(-1, len(langs))))
    return {"langs": langs, "common": langs.index(most["lang"].iloc[0]), "tables": tables}


class Scorer:
    def __init__(self, model: dict):
        self.langs, self.common = model["langs"], model["common"]
        self.tables = [({gram: i for i, gram in enumerate(grams.to_pylist())}, scores) for grams, scores in model["tables"]]
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.most = max(2, min(REMEMBERED, NUMBERS // (len(self.langs) + 1)))
        self.rows = np.zeros((self.most, len(self.langs) + 1))

    def word(self, word: str) -> np.ndarray | None:
        """Scores by language: of the word if any language has it, else the mean over its known n-grams of the longest length with any."""
        at, scores = self.tables[0]
        if (known := at.get(word)) is not None:
            return scores[known]
        padded = f" {word} "
        for n in range(LONGEST, 0, -1):
            at, scores = self.tables[n]
            if found := [j for i in range(len(padded) - n + 1) if (j := at.get(padded[i : i + n])) is not None]:
                return scores[found].mean(axis=0)
        return None

    def _miss(self, word: str) -> int:
        i = self.row[word] = len(self.row)
        letters = word if word.isalpha() else "".join(filter(str.isalpha, word))
        scores = self.word(letters) if letters else None
        self.rows[i] = 0 if scores is None else [*scores, 1]  # the last column counts scored words
        return i

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text else []
        if not self.langs or not any(w.isalpha() or any(map(str.isalpha, w)) for w in words):
            return "und", 0.0
        total = np.zeros(len(self.langs) + 1)
        for i in range(0, len(words), self.most // 2):
            part = words[i : i + self.most // 2]
            if len(self.row) + len(part) >= self.most:
                self.forget()
            get, miss = self.row.get, self._miss
            total += self.rows[[j if (j := get(w)) is not None else miss(w) for w in part]].sum(axis=0)
        if not total[-1]:
            return self.langs[self.common], 1 / len(self.langs)
        mean = total[:-1] / total[-1]
        best = int(mean.argmin())
        return self.langs[best], float(1 / np.exp(-(mean - mean[best]) * math.log(10)).sum())


_SCORERS: dict[str, Scorer] = {}


def _scorer(name: str, shared: Broadcast) -> Scorer:
    """A model's scorer, made once a worker; one model is held at a time."""
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(shared.value)
    return _SCORERS[name]


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Columns (doc_id, lang_pred, score) for every row of docs. No shuffle; the model is a bounded broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(name, shared)
        for batch in batches:
            found = [scorer.predict(x.as_py()) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learn from rows whose crc32(doc_id) mod `folds` is not 0, predict for all: doc_id, held_out, lang_pred, score."""
    model = learn(docs.where(remainder("doc_id", folds) != 0))
    return predict(docs, model).select("doc_id", (remainder("doc_id", folds) == 0).alias("held_out"), "lang_pred", "score")
