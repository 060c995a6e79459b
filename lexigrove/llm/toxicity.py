"""Toxicity by class-conditional Kneser-Ney bigram models over shared backoff counts.

Each class (toxic, ordinary) has discounted bigram counts and, below them, discounted continuation counts; what its own
discounts free goes to the next lower level, and below words to one distribution that both share: in how many of all
documents a word stands. Each distinct line of a class counts once, and an expression once in it, so neither copies of a
document nor a word said over and over weigh more than one.

An expression has counts of its own only where the classes are known to differ in it: where the rates of lines that have it
differ at least RATIO-fold, and the likelihood-ratio statistic of that difference is at least SURE and 2 ln(expressions), which
chance alone is unlikely to reach anywhere. Every rarer or less telling expression is smoothed to the shared counts
altogether, in both models alike, so it favours neither. Without that the models don't work on texts of mostly rare words;
README has figures. A document's evidence is the difference of its log-likelihoods divided by its number of words; a
logistic curve, fitted on labelled rows scored by models fitted without them, turns it into a score.

Defined results: a null text counts as empty; a text without words has evidence 0; a text of any length is read whole; without
labels of both classes the score is the curve's default, below one half, as it is for an empty table's rows, if any come
later. Repeated rows and null doc_ids each give a row; a document with several labels is toxic if one says so. Only doc_id
and text are read, and doc_id and toxic of the labels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.language_id import remainder
from lexigrove.llm.scratch import Scratch

#: The class models are fitted on about this many labelled rows of each class at most, by hash of doc_id.
SAMPLE = 5000
DISCOUNT = 0.75
#: How sure it must be that the classes differ in an expression, and how much.
SURE, RATIO = 12.0, 4.0
WORD = re.compile(r"[^\W\d_]+")
DEFAULT = (3.0, -2.0)
#: The curve is fitted on rows scored by models that never saw their part; "all" is the model that is used.
PARTS = 4
FOLDS = {str(k): tuple(" + ".join(f"{c}{i}" for i in range(PARTS) if i != k) for c in "to") for k in (*range(PARTS), "all")}


def _words() -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(r"(\p{L}+)"), 1)


def sample_of(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic, part, weight): a bounded sample of each class; weight restores the classes' shares."""
    each = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = {r["toxic"]: r["n"] for r in each.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, sample / max(size.get(1, 0), 1)))).otherwise(F.lit(min(1.0, sample / max(size.get(0, 0), 1))))
    u = F.xxhash64("doc_id", F.lit("sample")).bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31)
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS)).cast("int")
    return each.where(u < share).select("doc_id", "toxic", part.alias("part"), (1 / share).alias("weight"))


def _telling(a: Column, b: Column, n_a: float, n_b: float, kinds: int) -> Column:
    """Whether counts a of n_a and b of n_b differ by RATIO and SURE."""
    both = (a + b) / (n_a + n_b)
    part = lambda x, n: F.when(x > 0, x * F.log(x / (n * both))).otherwise(0.0)
    ratio = ((a + 0.5) / n_a) / ((b + 0.5) / n_b)
    return (2 * (part(a, n_a) + part(b, n_b)) >= max(SURE, 2 * math.log(max(kinds, 1)))) & ((ratio >= RATIO) | (ratio <= 1 / RATIO))


def _any(columns: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, columns)


def _tables(uni: pd.DataFrame, bi: pd.DataFrame, total: pd.Series, every: float, fold: str) -> dict:
    """Log-likelihood differences: of words, and of bigrams beyond their words'."""
    share = (uni["docs"].to_numpy(float) + 0.5) / (every + 1)
    n = {c: max(float(total[f"{c}_{fold}"]), 1.0) for c in "to"}
    count = {c: uni[f"{c}_{fold}"].to_numpy(float) for c in "to"}
    own = {c: np.maximum(count[c] - DISCOUNT, 0) / n[c] + DISCOUNT * float(total[f"{c}_types_{fold}"]) / n[c] * share for c in "to"}
    known = uni[f"tells_{fold}"].to_numpy(bool)
    p = {c: np.where(known, own[c], share) for c in "to"}
    words = {w: x for w, x in zip(uni["w"], np.log(p["t"] / p["o"]), strict=True) if x}
    at = {w: i for i, w in enumerate(uni["w"])}
    bi = bi[bi[f"tells_{fold}"].astype(bool)]
    i = bi["w"].map(at).to_numpy(int) if len(bi) else np.zeros(0, int)
    q = {}
    for c in "to":
        seen = bi[f"h{c}_{fold}"].to_numpy(float)
        held = np.maximum(bi[f"{c}_{fold}"].to_numpy(float) - DISCOUNT, 0) + DISCOUNT * bi[f"k{c}_{fold}"].to_numpy(float) * p[c][i]
        q[c] = np.where(seen > 0, held / np.maximum(seen, 1), p[c][i])
    more = np.log(q["t"] / q["o"]) - np.log(p["t"][i] / p["o"][i])
    return {"words": words, "pairs": {(h, w): x for h, w, x in zip(bi["h"], bi["w"], more, strict=True) if x}}


def evidence(text: str | None, tables: dict) -> float:
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return 0.0
    pairs = zip(["", *words[:-1]], words, strict=True)
    return (sum(map(tables["words"].get, words, repeat(0.0))) + sum(map(tables["pairs"].get, pairs, repeat(0.0)))) / len(words)


def _bent(x: np.ndarray) -> np.ndarray:
    """Evidence on a scale where a few extreme documents don't flatten the curve: linear up to about 0.01."""
    return np.sign(x) * np.log1p(100 * np.abs(x))


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic fit with a slight ridge; DEFAULT where a class is missing."""
    if len(np.unique(y)) < 2 or x.std() < 1e-12:
        return DEFAULT
    scale = x.std()
    design, beta = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(2)
    weight = weight / weight.mean()
    ridge = np.diag([1e-4, 1e-8]) * len(x)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, design.T @ (weight * (y - p)) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0] / scale), float(beta[1])


def learn(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, sample: int = SAMPLE) -> dict:
    """The model from labelled rows of docs; shared counts over all rows of `corpus` (docs where not given).

    Class counts are made in Spark, and only expressions that tell the classes apart come to the driver: what 2 * `sample`
    labelled texts can be sure of. The sample table is small by its parameter and so is broadcast, as are those words.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    chosen = scratch.keep(sample_of(labels, sample), "sample")
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = scratch.keep(rows, "rows")
    lines = rows.select("toxic", "part", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("text"))
    lines = scratch.keep(lines.groupBy("toxic", "text").agg(F.min("part").alias("part")).select("toxic", "part", _words().alias("words")), "lines")
    pairs = lines.select("toxic", "part", F.explode(F.array_distinct(F.arrays_zip(F.slice(F.concat(F.array(F.lit("")), "words"), 1, F.size("words")).alias("h"), F.col("words").alias("w")))).alias("p")).select("toxic", "part", "p.h", "p.w")
    counts = [F.count_if((F.col("toxic") == y) & (F.col("part") == k)).alias(f"{c}{k}") for y, c in ((1, "t"), (0, "o")) for k in range(PARTS)]
    pairs = scratch.keep(pairs.groupBy("h", "w").agg(*counts), "pairs")
    having = scratch.keep(lines.select("toxic", "part", F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(*counts), "having")
    size = lines.agg(*counts, F.count("*").alias("n")).select(*[F.expr(e).alias(f"{c}_{fold}") for fold, exprs in FOLDS.items() for c, e in zip("to", exprs, strict=True)]).toPandas().fillna(0).iloc[0]
    both = [(f"{c}_{fold}", expr) for fold, exprs in FOLDS.items() for c, expr in zip("to", exprs, strict=True)]
    kinds = having.count(), pairs.count()

    def tells(fold: str, n: int) -> Column:
        t, o = map(F.expr, FOLDS[fold])
        return _telling(t, o, max(float(size[f"t_{fold}"]), 1.0), max(float(size[f"o_{fold}"]), 1.0), n)

    each = [tells(fold, kinds[1]).alias(f"tells_{fold}") for fold in FOLDS]
    contexts = pairs.groupBy("h").agg(*[F.sum(F.expr(e)).alias(f"h{n}") for n, e in both], *[F.count_if(F.expr(f"({e}) > 0")).alias(f"k{n}") for n, e in both])
    telling = pairs.select("h", "w", *[F.expr(e).alias(n) for n, e in both], *each).where(_any([F.col(f"tells_{fold}") for fold in FOLDS]))
    telling = scratch.keep(telling, "telling pairs")
    uni = scratch.keep(pairs.groupBy("w").agg(*[F.count_if(F.expr(f"({e}) > 0")).alias(n) for n, e in both]), "words")
    total = uni.agg(*[F.sum(n).alias(n) for n, _ in both], *[F.count_if(F.col(n) > 0).alias(n.replace("_", "_types_")) for n, _ in both]).toPandas().fillna(0).iloc[0]
    told = having.select("w", *[tells(fold, kinds[0]).alias(f"tells_{fold}") for fold in FOLDS])
    told = told.join(telling.select("w").distinct().withColumn("in_pair", F.lit(True)), "w", "left").where(_any([F.col("in_pair").isNotNull(), *[F.col(f"tells_{fold}") for fold in FOLDS]])).drop("in_pair")
    vocabulary = scratch.keep(told.join(uni, "w"), "vocabulary")
    seen = (corpus if corpus is not None else docs).select(F.explode(F.array_distinct(_words())).alias("w"))
    known = F.broadcast(vocabulary.select("w", F.lit(True).alias("kept")))
    shared = seen.join(known, "w", "left").groupBy(F.when(F.col("kept"), F.col("w")).alias("w")).agg(F.count("*").alias("docs"))
    shared = scratch.keep(shared, "shared")
    every = float(shared.agg(F.sum("docs")).first()[0] or 1)
    uni_kept = vocabulary.join(shared, "w", "left").fillna(0, ["docs"]).toPandas()
    bi_kept = telling.join(contexts, "h").toPandas()
    models = {fold: _tables(uni_kept, bi_kept, total, every, fold) for fold in FOLDS}
    slope, intercept = DEFAULT
    if float(size["t_all"]) and float(size["o_all"]):
        other = docs.sparkSession.sparkContext.broadcast([models[str(k)] for k in range(PARTS)])

        def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = [evidence(t, other.value[h]) for t, h in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                yield pa.record_batch([batch.column(0), pa.array(x, pa.float64()), batch.column(3)], names=["toxic", "x", "weight"])

        fit = rows.select("toxic", "part", "text", "weight").mapInArrow(cross, "toxic int, x double, weight double").toPandas()
        slope, intercept = _curve(_bent(fit["x"].to_numpy()), fit["toxic"].to_numpy(float), fit["weight"].to_numpy())
    return models["all"] | {"slope": slope, "intercept": intercept}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Columns (doc_id, score) for every row of docs. No shuffle; the model is a bounded broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = np.array([evidence(t.as_py(), m) for t in batch.column(1)], float)
            s = 1 / (1 + np.exp(-np.clip(m["slope"] * _bent(x) + m["intercept"], -30, 30)))
            yield pa.record_batch([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, threshold: float = 0.7) -> DataFrame:
    """Learn from labelled rows whose crc32(doc_id) mod `folds` is not 1; (doc_id, held_out, score, predicted) for all."""
    model = learn(docs, labels.where(remainder("doc_id", folds) != 1))
    return score(docs, model).select("doc_id", (remainder("doc_id", folds) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, folds: int = 3, threshold: float = 0.7) -> DataFrame:
    """docs, all columns, without the rows that score `threshold` or more. No row is shuffled for it."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels.where(remainder("doc_id", folds) != 1)))

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        m = shared.value
        x = np.array([evidence(t, m) for t in texts], float)
        return pd.Series(1 / (1 + np.exp(-np.clip(m["slope"] * _bent(x) + m["intercept"], -30, 30))))

    return docs.where(toxic(docs["text"].cast("string")) < threshold)
