"""Text quality by random indexing and a two-layer network with calibrated probabilities.

A unit is a word, a run of marks or a line's end. Each unit has a fixed sparse ternary index vector, drawn by its hash; a unit's
context vector sums the index vectors of the units up to WINDOW places away, over all documents. Units with vectors of their
own are the UNITS that stand in most of the sampled labelled texts; any other is read as its shape (letter case and length, or a
run of marks), which has a vector like a unit. Context vectors lose their common direction and get length one. A document is
pooled to the mean of its units' vectors; of these features a network of one hidden layer of HIDDEN cells, fitted by numpy on the
sample, makes a logit. A temperature, fitted on a part of the sample that the weights never saw, divides it.

Bounds: the network sees about SAMPLE labelled rows of each class at most, weighted to restore the classes' shares; context
counts are over the whole corpus, and each task sends UNITS rows of sums at most. A worker holds UNITS^2 counts. No text is
shuffled.

Defined results: a null text counts as empty; a text without units has all features 0; a text of any length is read whole; with
labels of one class only, or none, the score is the share of label 1, or 0.5. Repeated rows and null doc_ids each give a row; a
document with several labels has quality 0 if one says so; labels that are neither 0 nor 1 are ignored. Only doc_id and text are
read, and doc_id and quality of the labels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.language_id import remainder
from lexigrove.llm.scratch import Scratch

#: The network is fitted on about this many labelled rows of each class at most, by hash of doc_id.
SAMPLE = 4000
UNITS, WINDOW = 1500, 2
WIDTH, NONZERO = 96, 6
HIDDEN, EPOCHS, RATE, DECAY = 24, 300, 0.02, 1e-2
#: One of so many parts of the sample fits the temperature.
PARTS = 5
#: Units that a worker remembers, and units whose neighbours are counted at once.
REMEMBERED, AT_ONCE = 200_000, 1 << 20
UNIT = re.compile(r"[^\W\d_]+|\d+|\n|(?:[^\w\s]|_)+")
LENGTHS = (1, 3, 6, 10, 20)


def shape(unit: str) -> str:
    """What is left of a unit without its letters: a name that holds a blank, so no unit has it."""
    size = sum(len(unit) > n for n in LENGTHS)
    if unit[0].isdigit():
        return f" digits {size}"
    if not unit[0].isalpha():
        return f" marks {size}"
    case = "upper" if unit.isupper() else "lower" if unit.islower() else "title" if unit.istitle() else "mixed"
    return f" {case} {size}"


#: All names that shape() gives.
SHAPES = tuple(f" {kind} {size}" for kind in ("digits", "marks", "upper", "lower", "title", "mixed") for size in range(len(LENGTHS) + 1))


class Numbers(dict):
    """The number of each unit: its own, or its shape's, found when first asked for."""

    def __init__(self, names: list[str]):
        super().__init__({name: i for i, name in enumerate(names)})

    def __missing__(self, unit: str) -> int:
        found = self[shape(unit)]
        if len(self) < REMEMBERED:
            self[unit] = found
        return found

    def of(self, text: str | None) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, UNIT.findall(text)), np.int32) if text else np.zeros(0, np.int32)


def index_vectors(names: list[str], width: int = WIDTH, nonzero: int = NONZERO) -> np.ndarray:
    """(names, width) of 0, 1 and -1, by hash alone: `nonzero` places each, one sign at each place."""
    out = np.zeros((len(names), width), np.int64)
    for i, name in enumerate(names):
        rng = np.random.default_rng(xxhash.xxh64_intdigest(name.encode(), seed=12))
        out[i, rng.permutation(width)[:nonzero]] = np.where(rng.random(nonzero) < 0.5, -1, 1)
    return out


def sample_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, quality, weight, held, text) of a bounded sample of each class; copies of a text are held back together."""
    each = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    size = {r["quality"]: r["n"] for r in each.groupBy("quality").agg(F.count("*").alias("n")).collect()}  # two rows
    share = F.when(F.col("quality") == 1, F.lit(min(1.0, sample / max(size.get(1, 0), 1)))).otherwise(F.lit(min(1.0, sample / max(size.get(0, 0), 1))))
    u = F.xxhash64("doc_id", F.lit("quality")).bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31)
    chosen = each.where(u < share).select("doc_id", "quality", (1 / share).alias("weight"))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.select("doc_id", "quality", "weight", (F.pmod(F.xxhash64("text"), F.lit(PARTS)) == 0).alias("held"), "text")


def units_of(sampled: DataFrame, units: int = UNITS) -> list[str]:
    """The units that stand in most of the sampled texts, after the shapes; ties in the units' order."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([list(set(UNIT.findall(t))) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))], names=["units"])

    rows = sampled.select("text").mapInArrow(distinct, "units array<string>").select(F.explode("units").alias("unit"))
    most = rows.groupBy("unit").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "unit").limit(units)
    return [*SHAPES, *sorted(r["unit"] for r in most.collect())]  # at most `units` rows


def context_vectors(corpus: DataFrame, names: list[str], window: int = WINDOW) -> np.ndarray:
    """(names, WIDTH): for each unit the index vectors of its neighbours in all texts, summed; exact integers."""
    shared = corpus.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, n = Numbers(shared.value), len(shared.value)
        counts = np.zeros(n * n, np.int64)
        waiting: list[np.ndarray] = []

        def count() -> None:
            # A gap between texts keeps units of one from being neighbours of another's.
            run = np.concatenate([x for ids in waiting for x in (ids, np.full(window, -1, np.int32))]).astype(np.int64)
            waiting.clear()
            for at in range(0, len(run), AT_ONCE):
                block = run[at : at + AT_ONCE + window]
                for apart in range(1, window + 1):
                    a = block[: min(AT_ONCE, len(block) - apart)]
                    b = block[apart : apart + len(a)]
                    both = (a >= 0) & (b >= 0)
                    counts[:] += np.bincount(a[both] * n + b[both], minlength=n * n)

        held = 0
        for batch in batches:
            for text in batch.column(0):
                ids = numbers.of(text.as_py())
                waiting.append(ids)
                held += len(ids)
                if held >= AT_ONCE:
                    count()
                    held = 0
        if waiting:
            count()
        table = counts.reshape(n, n)
        some = np.flatnonzero(table.any(axis=1) | table.any(axis=0))
        sums = (table + table.T)[some].astype(float) @ index_vectors(shared.value).astype(float)  # exact below 2^53
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(sums.astype(np.int64).tolist(), pa.list_(pa.int64()))], names=["unit", "sums"])

    sums = corpus.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "unit int, sums array<long>")
    total = sums.groupBy("unit").agg(*[F.sum(F.col("sums")[d]).alias(f"d{d}") for d in range(WIDTH)]).toPandas()  # a row for each name
    out = np.zeros((len(names), WIDTH))
    out[total["unit"].to_numpy(int)] = total.drop(columns="unit").to_numpy(float)
    return out


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    """Context vectors of length one, their common direction taken out, and of length one again; of no contexts 0."""
    size = lambda x: np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)
    unit = contexts / size(contexts)
    known = contexts.any(axis=1)
    if known.any():
        unit[known] -= unit[known].mean(axis=0)
    return unit / size(unit)


def pooled(text: str | None, numbers: Numbers, vectors: np.ndarray) -> np.ndarray:
    ids = numbers.of(text)
    return np.bincount(ids, minlength=len(vectors)) @ vectors / len(ids) if len(ids) else np.zeros(vectors.shape[1])


def logits(x: np.ndarray, net: dict) -> np.ndarray:
    return np.tanh((x - net["mean"]) / net["spread"] @ net["w1"] + net["b1"]) @ net["w2"] + net["b2"]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS) -> dict:
    """Two layers by Adam over all rows at once, weights decaying; the same input gives the same network."""
    rng = np.random.default_rng(7)
    spread = x.std(axis=0)
    net = {"mean": x.mean(axis=0), "spread": np.where(spread > 1e-9, spread, 1.0), "w1": rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, 1 / math.sqrt(hidden), hidden), "b2": 0.0}
    z, share = (x - net["mean"]) / net["spread"], weight / weight.sum()
    moved = {k: [np.zeros_like(net[k]), np.zeros_like(net[k])] for k in ("w1", "b1", "w2", "b2")}
    for step in range(1, epochs + 1):
        h = np.tanh(z @ net["w1"] + net["b1"])
        off = share * (1 / (1 + np.exp(-np.clip(h @ net["w2"] + net["b2"], -30, 30))) - y)
        back = off[:, None] * net["w2"] * (1 - h * h)
        slopes = {"w1": z.T @ back + DECAY * net["w1"], "b1": back.sum(axis=0), "w2": h.T @ off + DECAY * net["w2"], "b2": off.sum()}
        for k, g in slopes.items():
            m, v = moved[k]
            moved[k] = [0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g]
            net[k] = net[k] - RATE * (moved[k][0] / (1 - 0.9**step)) / (np.sqrt(moved[k][1] / (1 - 0.999**step)) + 1e-8)
    return net


def temperature(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """What the logits must be divided by for the least weighted log loss on rows that the network never saw; 1 without both
    classes among them. Labels count as (n + 1) / (n + 2) sure for n rows of their class, so a few rows that are all told apart
    don't make the scores certain. Golden-section search over the logarithm."""
    if len(np.unique(y)) < 2:
        return 1.0
    sure = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), ((1 - y).sum() + 1) / ((1 - y).sum() + 2))
    right = np.where(y > 0, z, -z)
    loss = lambda t: float((weight * (sure * np.logaddexp(0, -right / math.exp(t)) + (1 - sure) * np.logaddexp(0, right / math.exp(t)))).sum())
    low, high, g = math.log(0.05), math.log(20), (math.sqrt(5) - 1) / 2
    while high - low > 1e-4:
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def learn(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, sample: int = SAMPLE, units: int = UNITS) -> dict:
    """The model from labelled rows of docs; contexts from all rows of `corpus` (docs where not given)."""
    scratch = Scratch(docs.sparkSession, "quality")
    sampled = scratch.keep(sample_of(docs, labels, sample), "sample")
    share = sampled.agg(F.sum(F.col("quality") * F.col("weight")) / F.sum("weight"), F.count_distinct("quality")).first()
    if share[1] < 2:
        return {"names": list(SHAPES), "vectors": np.zeros((len(SHAPES), WIDTH)), "net": None, "share": 0.5 if share[0] is None else float(share[0])}
    names = units_of(sampled, units)
    vectors = word_vectors(context_vectors(corpus if corpus is not None else docs, names))
    model = {"names": names, "vectors": vectors}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, of = Numbers(shared.value["names"]), shared.value["vectors"]
        for batch in batches:
            x = [pooled(t.as_py(), numbers, of).tolist() for t in batch.column(4)]
            yield pa.record_batch([*[batch.column(i) for i in range(4)], pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "quality", "weight", "held", "x"])

    rows = sampled.mapInArrow(run, "doc_id long, quality int, weight double, held boolean, x array<double>").toPandas()
    rows = rows.assign(key=rows["x"].map(tuple)).sort_values(["doc_id", "key"])
    x, y, weight, held = np.array(rows["x"].tolist()), rows["quality"].to_numpy(float), rows["weight"].to_numpy(), rows["held"].to_numpy(bool)
    if len(np.unique(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    net = fit(x[~held], y[~held], weight[~held])
    net["temperature"] = temperature(logits(x[held], net), y[held], weight[held]) if held.any() else 1.0
    return model | {"net": net, "share": float(share[0])}


def probabilities(x: np.ndarray, model: dict) -> np.ndarray:
    if model["net"] is None:
        return np.full(len(x), model["share"])
    return 1 / (1 + np.exp(-np.clip(logits(x, model["net"]) / model["net"]["temperature"], -30, 30)))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) for every row of docs. No shuffle; the model is a broadcast of bounded size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        numbers = Numbers(m["names"])
        for batch in batches:
            x = np.array([pooled(t.as_py(), numbers, m["vectors"]) for t in batch.column(1)]).reshape(-1, m["vectors"].shape[1])
            yield pa.record_batch([batch.column(0), pa.array(probabilities(x, m), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """Learn from labelled rows whose crc32(doc_id) mod `folds` is not 0; (doc_id, held_out, score, predicted) for all."""
    model = learn(docs, labels.where(remainder("doc_id", folds) != 0))
    return score(docs, model).select("doc_id", (remainder("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
