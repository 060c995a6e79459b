"""Batches of boolean queries as rows: the plan is the same however many queries there are and however deep.

A query is parsed to a program, its leaves' numbers and operators in postfix order. Distinct leaves of the whole batch are
analysed as rows and looked up in the postings, one scan for each kind. What each document has of a query's leaves is one row,
on which the program is evaluated. Where the index is stored in blocks, a task does so for all documents of a block at once, from the
packed postings: neither postings nor what a document has are made rows. A document with none of them can only be an answer where the program holds with no leaf at
all, as under NOT; for such queries alone the universe is read, without the documents for which the program fails.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from lexigrove.functions.analysis import analyze, stemmed
from lexigrove.operators.boolean import FEW_ENTRIES, containing_rows, near_rows, phrase_rows
from lexigrove.operators.index import Index
from lexigrove.operators.packed import StoredIndex, _ranked, _starts
from lexigrove.plans.query_language import Leaf, Node, denotation, leaves
from lexigrove.sources import workspace

#: Operators in a program; leaves are numbers from 0.
CODES = {"AND": -1, "OR": -2, "NOT": -3}
#: So many distinct terms become a filter on the scan.
FILTERED = 1000
#: So many results of a block are sent on at once.
AT_ONCE = 100_000
PARSED = "qid string, program array<int>, base boolean, leaves array<struct<i:int,kind:string,texts:array<string>,distance:int>>"


def _program(node: Leaf | Node, number: dict[Leaf, int]) -> list[int]:
    if isinstance(node, Leaf):
        return [number[node]]
    return [code for part in node.parts for code in _program(part, number)] + [CODES[node.op]]


def _without_leaves(program: list[int]) -> bool:
    """Whether the program holds for a document that has no leaf."""
    stack: list[bool] = []
    for code in program:
        if code >= 0:
            stack.append(False)
        elif code == CODES["NOT"]:
            stack.append(not stack.pop())
        else:
            a, b = stack.pop(), stack.pop()
            stack.append(a and b if code == CODES["AND"] else a or b)
    return stack[0]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    leaf = pa.struct([("i", pa.int32()), ("kind", pa.string()), ("texts", pa.list_(pa.string())), ("distance", pa.int32())])
    schema = pa.schema([("qid", pa.string()), ("program", pa.list_(pa.int32())), ("base", pa.bool_()), ("leaves", pa.list_(leaf))])
    for batch in batches:
        out = []
        for qid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text and text.strip():
                node = denotation(text)
                number = {x: i for i, x in enumerate(leaves(node))}
                program = _program(node, number)
                out.append({"qid": qid, "program": program, "base": _without_leaves(program), "leaves": [{"i": i, "kind": x.kind, "texts": list(x.texts), "distance": x.distance} for x, i in number.items()]})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def holds(program: Column, has: Column) -> Column:
    """Whether a program holds for the leaves whose numbers are in `has`; the stack is an array, its top first."""
    rest = lambda s, n: F.slice(s, F.lit(n + 1), F.size(s))
    top = lambda s, i: F.get(s, F.lit(i))

    def step(s: Column, code: Column) -> Column:
        pushed = F.when(code >= 0, F.concat(F.array(F.array_contains(has, code)), s))
        negated = pushed.when(code == CODES["NOT"], F.concat(F.array(~top(s, 0)), rest(s, 1)))
        joined = F.when(code == CODES["AND"], top(s, 0) & top(s, 1)).otherwise(top(s, 0) | top(s, 1))
        return negated.otherwise(F.concat(F.array(joined), rest(s, 2)))

    return top(F.aggregate(program, F.array().cast("array<boolean>"), step), 0)


def _leaf_terms(index: Index, distinct: DataFrame) -> DataFrame:
    """What each leaf looks up, a row (leaf, kind, distance, side, i, term, n) for each of its n terms, from rows (leaf, kind, texts,
    distance). A leaf with an operand of no terms matches nothing."""
    texts = distinct.select("leaf", "kind", "distance", F.size("texts").alias("operands"), F.posexplode("texts").alias("side", "text"))
    tokens = texts.select("leaf", "kind", "distance", "operands", "side", F.posexplode(analyze(F.col("text"), index.profile)).alias("i", "token"))
    terms = stemmed(tokens, "token", index.profile).drop("token")
    size = terms.groupBy("leaf").agg(F.count_distinct("side").alias("sides"), F.count("*").alias("n"))
    path = workspace.fresh(distinct.sparkSession, "leaf-terms")
    terms.join(size, "leaf").where("sides = operands").write.parquet(path)
    return distinct.sparkSession.read.parquet(path)


def _entries(terms: DataFrame) -> dict[str, DataFrame]:
    """The leaves' terms by kind of leaf."""
    near = terms.where("kind = 'near'").groupBy("term", "leaf").agg(F.bool_or(F.col("side") == 0).alias("l"), F.bool_or(F.col("side") == 1).alias("r"), F.max("distance").alias("d"))
    return {
        "terms": terms.where("kind = 'terms' or (kind = 'phrase' and n = 1)").select("term", "leaf").distinct(),
        "phrase": terms.where("kind = 'phrase' and n > 1").select("term", "leaf", "i", F.col("n").cast("int").alias("n")),
        "near": near,
    }


def _any_of(size: int, held: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(size, bool)
    for docs in held:
        out[docs] = True
    return out


def _leaf_holds(kind: str, distance: int, entries: list[tuple[int, int, str]], size: int, docs: dict[str, np.ndarray], places: Callable[[str], np.ndarray]) -> np.ndarray | None:
    """Which of a block's `size` documents have a leaf of entries (side, i, term), given the documents of each of its terms and, as
    numbers document << 32 | position in order, where a term stands; None if none has."""
    present = [e for e in entries if e[2] in docs]
    if kind == "terms" or kind == "phrase" and len(entries) == 1:
        return _any_of(size, [docs[t] for *_, t in present]) if present else None
    if kind == "phrase":
        if len(present) < len(entries):
            return None
        starts = None
        for _, i, term in sorted(present, key=lambda e: len(docs[e[2]])):
            at = places(term) - i
            starts = at if starts is None else np.intersect1d(starts, at, assume_unique=True)
        return _any_of(size, [starts >> 32]) if len(starts) else None
    sides = [{t for side, _, t in present if side == k} for k in (0, 1)]
    if distance < 0 or not all(sides):
        return None
    if sides[0] == sides[1]:  # each term is 0 apart from itself, so no two need be compared
        return _any_of(size, [docs[t] for t in sides[0]])
    left, right = (np.unique(np.concatenate([places(t) for t in side])) for side in sides)
    after = np.searchsorted(right, left)
    near = (after < len(right)) & (right[np.minimum(after, len(right) - 1)] - left <= distance)
    near |= (after > 0) & (left - right[np.maximum(after - 1, 0)] <= distance)
    return _any_of(size, [left[near] >> 32])


def _holds_where(program: list[int], has: list[np.ndarray]) -> np.ndarray:
    """holds() for all documents of a block, given which have each of a program's leaves."""
    stack: list[np.ndarray] = []
    for code in program:
        if code >= 0:
            stack.append(has[code])
        elif code == CODES["NOT"]:
            stack.append(~stack.pop())
        else:
            a, b = stack.pop(), stack.pop()
            stack.append(a & b if code == CODES["AND"] else a | b)
    return stack[0]


def _judged_blocks(index: StoredIndex, terms: DataFrame, distinct: DataFrame, parsed: DataFrame) -> DataFrame:
    """(qid, doc_id, base) where a program differs from what it gives without leaves. A block's packed rows of the leaves' terms meet in
    one task, with the positions of those that stand in phrases and proximities; no document is in two blocks."""
    spark = index.documents.sparkSession
    looked_up: dict[int, tuple[str, int, list[tuple[int, int, str]]]] = {}
    for r in terms.select("leaf", "kind", "distance", "side", "i", "term").distinct().collect():
        looked_up.setdefault(r["leaf"], (r["kind"], r["distance"], []))[2].append((r["side"], r["i"], r["term"]))
    leaf_of: dict[str, dict[int, int]] = {}
    for r in distinct.select("leaf", F.inline("uses")).collect():
        leaf_of.setdefault(r["qid"], {})[r["i"]] = r["leaf"]
    programs = [(r["qid"], r["program"], r["base"], [leaf_of[r["qid"]][i] for i in range(len(leaf_of[r["qid"]]))]) for r in parsed.select("qid", "program", "base").collect()]
    shared = spark.sparkContext.broadcast((looked_up, programs))
    # A proximity of the same terms on both sides, or a phrase of one, needs no positions.
    placed = {t for kind, _, entries in looked_up.values() if kind != "terms" and len(entries) > 1 and (kind == "phrase" or {t for s, _, t in entries if s == 0} != {t for s, _, t in entries if s == 1}) for *_, t in entries}
    rows = spark.createDataFrame([(t, t in placed) for t in sorted({t for *_, entries in looked_up.values() for *_, t in entries})], "term string, placed boolean")
    few = [r["term"] for r in rows.select("term").limit(FILTERED + 1).collect()]
    blocks = index.blocks.where(F.col("term").isin(few)) if len(few) <= FILTERED else index.blocks
    held = blocks.join(F.broadcast(rows), "term").select("block", "term", "ids", F.when(F.col("placed"), F.col("positions")).alias("positions"))

    def judged(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves_, programs = shared.value
        term, ids, positions = (c.combine_chunks() for c in pa.Table.from_batches(held).select(["term", "ids", "positions"]).columns)
        at, ids_ = _ranked(ids.flatten())
        stops = np.cumsum(ids.value_lengths().to_numpy())
        docs = {t: at[b - n : b] for t, b, n in zip(term.to_pylist(), stops.tolist(), ids.value_lengths().to_numpy().tolist(), strict=True)}
        row = {t: i for i, t in enumerate(term.to_pylist())}

        @cache
        def places(t: str) -> np.ndarray:
            of = positions[row[t]].values
            return np.sort(np.repeat(docs[t], of.value_lengths().to_numpy()) << 32 | of.flatten().to_numpy().astype(np.int64))

        known: dict[int, np.ndarray | None] = {}
        none, numbers, found = np.zeros(len(ids_), bool), [], []
        for k, (_, program, base, leaves) in enumerate(programs):
            for leaf in leaves:
                if leaf not in known:
                    known[leaf] = _leaf_holds(*leaves_[leaf], len(ids_), docs, places) if leaf in leaves_ else None
            has = [known[leaf] for leaf in leaves]
            if all(x is None for x in has):
                continue
            hit = np.flatnonzero(_holds_where(program, [none if x is None else x for x in has]) != base)
            numbers.append(np.full(len(hit), k))
            found.append(hit)
        if numbers:
            number, hit = np.concatenate(numbers), np.concatenate(found)
            names, bases = pa.array([p[0] for p in programs], pa.string()), pa.array([p[2] for p in programs], pa.bool_())
            for a in range(0, len(hit), AT_ONCE):
                some = pa.array(number[a : a + AT_ONCE])
                yield pa.record_batch([names.take(some), ids_.take(pa.array(hit[a : a + AT_ONCE])), bases.take(some)], names=["qid", "doc_id", "base"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            starts = _starts(blocks)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(blocks)], strict=True):
                if held and int(blocks[a]) != now:
                    yield from judged(held)
                    held = []
                now = int(blocks[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from judged(held)

    schema = StructType([StructField("qid", StringType()), StructField("doc_id", index.documents.schema["doc_id"].dataType), StructField("base", BooleanType())])
    return held.repartition("block").sortWithinPartitions("block").mapInArrow(run, schema)


def _judged(index: Index, entries: dict[str, DataFrame], each: DataFrame, distinct: DataFrame, parsed: DataFrame) -> DataFrame:
    """_judged_blocks() of any index and of batches of any size."""
    asked = entries["terms"].select("term").union(entries["phrase"].select("term")).union(entries["near"].select("term")).distinct()
    few = [r["term"] for r in asked.limit(FILTERED + 1).collect()]
    postings = index.only(few) if len(few) <= FILTERED else index.postings
    hits = containing_rows(postings, entries["terms"]).union(phrase_rows(postings, entries["phrase"])).union(near_rows(postings, entries["near"]))
    programs = parsed.select("qid", "program", "base")
    near = F.broadcast if each.limit(FEW_ENTRIES + 1).count() <= FEW_ENTRIES else lambda rows: rows
    uses = distinct.select("leaf", F.inline("uses"))
    has = hits.join(near(uses), "leaf").groupBy("qid", "doc_id").agg(F.collect_set("i").alias("has"))
    judged = has.join(near(programs), "qid").select("qid", "doc_id", "base", holds(F.col("program"), F.col("has")).alias("holds"))
    # Where a program differs from what it gives without leaves.
    return judged.where(F.col("holds") != F.col("base")).select("qid", "doc_id", "base")


def search_batch(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, doc_id) of queries (qid, text) with distinct qids; a blank or null query matches nothing, as does an empty batch."""
    spark = index.documents.sparkSession
    parsed_at, leaves_at = workspace.fresh(spark, "programs"), workspace.fresh(spark, "leaves")
    queries.select(F.col("qid").cast("string").alias("qid"), "text").mapInArrow(_parse, PARSED).write.parquet(parsed_at)
    parsed = spark.read.parquet(parsed_at)
    each = parsed.select("qid", F.inline("leaves"))
    each.groupBy("kind", "texts", "distance").agg(F.collect_list(F.struct("qid", "i")).alias("uses")).withColumn("leaf", F.monotonically_increasing_id()).write.parquet(leaves_at)
    distinct = spark.read.parquet(leaves_at)
    terms = _leaf_terms(index, distinct.drop("uses"))
    few = all(rows.limit(FEW_ENTRIES + 1).count() <= FEW_ENTRIES for rows in (terms, each))
    if few and isinstance(index, StoredIndex) and not index.repeated:
        judged = _judged_blocks(index, terms, distinct, parsed)
    else:
        judged = _judged(index, _entries(terms), each, distinct, parsed)
    whole = parsed.where("base").select("qid")
    if whole.isEmpty():
        return judged.select("qid", "doc_id")
    judged_at = workspace.fresh(spark, "judged")  # written, as it is read twice
    judged.write.parquet(judged_at)
    judged = spark.read.parquet(judged_at)
    everywhere = index.documents.select("doc_id", F.explode(whole.agg(F.collect_list("qid").alias("qids")).scalar()).alias("qid")).select("qid", "doc_id")
    return judged.where(~F.col("base")).select("qid", "doc_id").union(everywhere.join(judged.where("base").select("qid", "doc_id"), ["qid", "doc_id"], "left_anti"))
