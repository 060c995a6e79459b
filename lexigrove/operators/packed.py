"""The stored index: postings packed by term and block of documents, and pruned BM25 over them.

A block is BLOCK consecutive rows that a task reads, so documents aren't shuffled to be numbered, nor tokens to be grouped. A row (term, block) holds the
sorted ids of the block's documents that have the term, each one's sorted positions, and what bounds a score: how often the term
stands in a document at most, and how short such a document is. Parquet's delta encodings store ids and positions as gaps. Rows
are range-partitioned by term and block, so a term's lookup reads few row groups.

    blocks     term, block, first, last, n, max_tf, min_dl, ids, positions
    terms      term, df                       documents  doc_id, doc_seq, dl                totals  documents, tokens, repeated
    pairs      as blocks, for two frequent terms that stand next to each other ("of the"), without where they end
    norms      doc_id, norm

The last two are written when they are first asked for, from the others: phrases alone read pairs, the cosine alone reads norms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StringType, StructField, StructType

from lexigrove.functions.analysis import Profile, analyze, stemmed_rows
from lexigrove.operators import ranking
from lexigrove.operators.index import Index
from lexigrove.sources.workspace import shuffles_deleted

BLOCK = 2048
#: A block has fewer rows where their tokens would be more than this.
TOKENS = 1 << 21
#: Gaps instead of numbers: the file format's own delta encodings.
DELTAS = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "compression": "zstd"}
#: The threshold comes from a query's rarest terms that stand in at least this many times k documents.
LEAD = 4
#: Terms in at least this share of the documents are frequent. A document's distinct terms over it bound how many there are.
FREQUENT = 0.05
#: So many distinct blocks become a filter on the scan.
FILTERED = 1000


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _lists(starts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), values)


def _ranked(ids: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(place of each id, the distinct ids in order)"""
    found = ids.dictionary_encode(null_encoding="encode")
    order = pc.array_sort_indices(found.dictionary, null_placement="at_start").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[found.indices.to_numpy()], found.dictionary.take(pa.array(order))


def _in_order(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows of columns of numbers from 0, sorted by the first, then the next; as one number each, where that holds them."""
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) > 63:
        order = np.lexsort(columns[::-1])
        return tuple(c[order] for c in columns)
    key, out = np.zeros(len(columns[0]), np.int64), []
    for c, width in zip(columns, bits, strict=True):
        key = key << width | c
    key.sort()
    for width in reversed(bits):
        out.append(key & ((1 << width) - 1))
        key = key >> width
    return tuple(reversed(out))


def _grouped(block: int, codes: np.ndarray, names: pa.Array, docs: np.ndarray, ids: pa.Array, lengths: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """The packed rows of a block's postings: names[codes] stand in documents ids[docs], lengths[docs] long, at pos."""
    codes, docs, pos = _in_order(codes, docs, pos)
    each = _starts(codes, docs)
    term, place = _starts(codes[each]), docs[each]
    tf = np.diff(np.append(each, len(codes)))
    held = ids.take(pa.array(place))
    least = lambda of, values: of.reduceat(values, term).astype(np.int32) if len(term) else term.astype(np.int32)
    columns = {
        "term": names.take(pa.array(codes[each][term])),
        "block": pa.array(np.full(len(term), block, np.int64)),
        "max_tf": pa.array(least(np.maximum, tf)),
        "min_dl": pa.array(least(np.minimum, lengths[place])),
        "ids": _lists(term, held),
        "positions": _lists(term, _lists(each, pa.array(pos.astype(np.int32)))),
    }
    return pa.record_batch(list(columns.values()), names=list(columns))


def _lengths(block: int, ids: pa.Array, lengths: np.ndarray) -> pa.RecordBatch:
    """A row like packed ones under the term null: the block's documents, and each one's length where positions are."""
    each = _lists(np.zeros(1, np.int64), _lists(np.arange(len(ids)), pa.array(lengths.astype(np.int32))))
    nothing, number = pa.array([0], pa.int32()), pa.array([block], pa.int64())
    return pa.record_batch([pa.nulls(1, pa.string()), number, nothing, nothing, _lists(np.zeros(1, np.int64), ids), each], names=["term", "block", "max_tf", "min_dl", "ids", "positions"])


def _in_blocks(block: int, measured: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from rows (row, doc_id, tokens) to packed rows of consecutive `block` of them, or of fewer with TOKENS tokens; a
    block is called by its first row. With `measured` its last row is that of _lengths()."""

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, ids, tokens = (c.combine_chunks() for c in pa.Table.from_batches(held).columns)
        docs, ids = _ranked(ids)
        size = pc.list_value_length(tokens).to_numpy()
        lengths = np.full(len(ids), np.iinfo(np.int32).max)
        np.minimum.at(lengths, docs, size)
        found = tokens.flatten().dictionary_encode()
        pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        yield _grouped(row[0].as_py(), found.indices.to_numpy().astype(np.int64), found.dictionary, np.repeat(docs, size), ids, lengths, pos)
        if measured:
            yield _lengths(row[0].as_py(), ids, np.bincount(docs, size, len(ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, tokens = [], 0, 0
        for batch in batches:
            sums, i = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy().astype(np.int64)), 0
            while i < batch.num_rows:
                before = sums[i - 1] if i else 0
                take = min(block - rows, int(np.searchsorted(sums, before + TOKENS - tokens, side="right")) - i)
                if take <= 0 and held:
                    yield from packed(held)
                    held, rows, tokens = [], 0, 0
                    continue
                take = min(max(take, 1), batch.num_rows - i)
                held.append(batch.slice(i, take))
                rows, tokens, i = rows + take, tokens + int(sums[i + take - 1] - before), i + take
        if held:
            yield from packed(held)

    return run


def _same(codes: np.ndarray, names: pa.Array, docs: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    return codes, names, docs, pos


def _adjacent(codes: np.ndarray, names: pa.Array, docs: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """The postings of "a b" where b follows a, at a's positions."""
    docs, pos, codes = _in_order(docs, pos, codes)
    at = np.flatnonzero((docs[1:] == docs[:-1]) & (pos[1:] == pos[:-1] + 1))
    pairs, found = np.unique(codes[at] * len(names) + codes[at + 1], return_inverse=True)
    left, right = (names.take(pa.array(x)) for x in np.divmod(pairs, max(len(names), 1)))
    return found.astype(np.int64), pc.binary_join_element_wise(left, right, " "), docs[at], pos[at]


def _regrouped(make: Callable, together: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from rows (term, block, min_dl, ids, positions), those of a block one after another, to the packed rows of what
    `make` makes of a block's postings, or of consecutive blocks' until they are `together`. A document is at least as long as the
    least one of any of its terms. The rows of _lengths() stay."""

    def packed(block: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held)
        for _, number, _, ids, positions in zip(*whole.filter(pc.is_null(whole.column(0))).columns, strict=True):
            yield _lengths(number.as_py(), ids.values, positions.values.flatten().to_numpy())
        term, _, least, ids, positions = (c.combine_chunks() for c in whole.filter(pc.is_valid(whole.column(0))).columns)
        found = term.dictionary_encode()
        n, tf = pc.list_value_length(ids).to_numpy(), pc.list_value_length(positions.flatten()).to_numpy()
        docs, ids = _ranked(ids.flatten())
        lengths = np.zeros(len(ids), np.int64)
        np.maximum.at(lengths, docs, np.repeat(least.to_numpy(), n))
        codes = np.repeat(np.repeat(found.indices.to_numpy().astype(np.int64), n), tf)
        codes, names, docs, pos = make(codes, found.dictionary, np.repeat(docs, tf), positions.flatten().flatten().to_numpy())
        yield _grouped(block, codes, names, docs, ids, lengths, pos)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, first, now = [], 0, None, None
        for batch in batches:
            blocks = batch.column(1).to_numpy()
            starts = _starts(blocks)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(blocks)], strict=True):
                if held and blocks[a] != now and size >= together:
                    yield from packed(first, held)
                    held, size = [], 0
                now = int(blocks[a])
                first = first if held else now
                held.append(batch.slice(a, b - a))
                size += len(held[-1].column(4).flatten().flatten())
        if held:
            yield from packed(first, held)

    return run


_PARTS = ["term", "block", "min_dl", "ids", "positions"]


def _schema(id_type: DataType) -> StructType:
    whole = ArrayType(ArrayType(IntegerType()))
    kinds = {"term": StringType(), "block": LongType(), "max_tf": IntegerType(), "min_dl": IntegerType(), "ids": ArrayType(id_type), "positions": whole}
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


def pack(documents: DataFrame, profile: Profile, id_col: str = "id", text_col: str = "full_text", block: int = BLOCK, measured: bool = False) -> DataFrame:
    """The packed postings, block by block, with `measured` the documents' lengths as well. The rows of a block are one task's, which
    packs them where it reads them: no exchange. A stem is found once for each token of a block."""
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), analyze(F.col(text_col), profile).alias("tokens"))
    schema = _schema(rows.schema["doc_id"].dataType)
    packed = rows.mapInArrow(_in_blocks(block, measured), schema)
    if profile.stems:
        packed = stemmed_rows(packed.withColumnRenamed("term", "token"), "token", profile).select(*_PARTS).mapInArrow(_regrouped(_same), schema)
    return packed


def unpacked(blocks: DataFrame) -> DataFrame:
    """(term, doc_id, pos)"""
    return blocks.select("term", F.inline(F.arrays_zip("ids", "positions"))).select("term", F.col("ids").alias("doc_id"), F.explode("positions").alias("pos"))


def frequencies(blocks: DataFrame, repeated: bool) -> DataFrame:
    """(term, doc_id, tf); summed over blocks only where some id has several rows."""
    each = blocks.select("term", F.inline(F.arrays_zip("ids", "positions"))).select("term", F.col("ids").alias("doc_id"), F.size("positions").cast("long").alias("tf"))
    return each.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf")) if repeated else each


def pack_pairs(blocks: DataFrame, terms: DataFrame, n_docs: int) -> DataFrame:
    """Packed postings of "a b" where b follows a and both are frequent, at a's positions. One exchange, of the frequent terms' packed
    rows by block; blocks of TOKENS postings are unpacked together, so that rare pairs make fewer rows."""
    frequent = terms.where(F.col("df") >= FREQUENT * n_docs).select("term")
    held = blocks.join(F.broadcast(frequent), "term", "left_semi").select(*_PARTS)
    return held.repartition("block").sortWithinPartitions("block").mapInArrow(_regrouped(_adjacent, TOKENS), _schema(blocks.schema["ids"].dataType.elementType))


def _norms(blocks: DataFrame, terms: DataFrame, n_docs: int) -> DataFrame:
    """(doc_id, norm) of documents with tokens, of blocks where an id has one row. Packed rows meet their df; a task's sums of a
    document travel, not its terms."""
    idf = F.log10(F.lit(float(n_docs)) / F.col("df"))
    held = blocks.select("term", "ids", F.transform("positions", F.size).alias("tf")).join(terms, "term").select(idf.alias("idf"), "ids", "tf")
    each = held.select("idf", F.inline(F.arrays_zip("ids", "tf"))).withColumn("w", (1 + F.log10("tf")) * F.col("idf"))
    sums = each.groupBy(F.col("ids").alias("doc_id")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return sums.select("doc_id", F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm")).alias("norm"))


def _write(blocks: DataFrame, path: str) -> None:
    rows = blocks.repartitionByRange("term", "block").sortWithinPartitions("term", "block")
    ends = F.get("ids", F.lit(0)).alias("first"), F.element_at("ids", -1).alias("last"), F.size("ids").alias("n")
    rows.select("term", "block", *ends, "max_tf", "min_dl", "ids", "positions").write.mode("overwrite").options(**DELTAS).parquet(path)


def store(documents: DataFrame, profile: Profile, path: str, id_col: str = "id", text_col: str = "full_text", seq_col: str = "doc_seq", block: int = BLOCK) -> None:
    """Write under `path` all that searches read, or that what they read is made of."""
    with shuffles_deleted(documents.sparkSession):
        _store(documents, profile, path, id_col, text_col, seq_col, block)


def _store(documents: DataFrame, profile: Profile, path: str, id_col: str, text_col: str, seq_col: str, block: int) -> None:
    spark = documents.sparkSession
    # Written once before they are ordered, as finding the ranges reads them twice.
    pack(documents, profile, id_col, text_col, block, measured=True).write.mode("overwrite").options(**DELTAS).parquet(f"{path}/packed")
    held = spark.read.parquet(f"{path}/packed")
    _write(held.where("term is not null"), f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    found = documents.groupBy(F.col(id_col).alias("doc_id")).agg(F.min(seq_col).alias("doc_seq"), F.count("*").alias("rows"))
    found.write.mode("overwrite").parquet(f"{path}/found")
    found = spark.read.parquet(f"{path}/found")
    n, repeated = found.agg(F.count("*"), F.coalesce(F.max("rows") > 1, F.lit(False))).first()
    terms = frequencies(blocks, repeated).groupBy("term").agg(F.count("*").alias("df")) if repeated else blocks.groupBy("term").agg(F.sum("n").cast("long").alias("df"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    sizes = held.where("term is null").select(F.inline(F.arrays_zip("ids", "positions"))).groupBy(F.col("ids").alias("of")).agg(F.sum(F.get("positions", F.lit(0))).alias("dl"))
    sizes = found.join(sizes, found["doc_id"].eqNullSafe(sizes["of"]), "left").select("doc_id", "doc_seq", F.coalesce("dl", F.lit(0)).alias("dl"))
    sizes.write.mode("overwrite").parquet(f"{path}/documents")
    totals = spark.read.parquet(f"{path}/documents").agg(F.count("*").alias("documents"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"), F.lit(repeated).alias("repeated"))
    totals.write.mode("overwrite").parquet(f"{path}/totals")
    for name in ("packed", "found"):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class StoredIndex(Index):
    """An index whose postings are unpacked from blocks as they are read: a filter on terms reaches the scan."""

    blocks: DataFrame
    repeated: bool
    path: str

    def _part(self, name: str, write: Callable[[str], None]) -> DataFrame:
        """A part of the index that is written when it is first asked for."""
        spark, path = self.documents.sparkSession, f"{self.path}/{name}"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            with shuffles_deleted(spark):
                write(path)
        return spark.read.parquet(path)

    @cached_property
    def pairs(self) -> DataFrame:
        # Rows of one id have positions of their own, which don't follow on each other.
        rows = lambda: self.blocks.where("false") if self.repeated else pack_pairs(self.blocks, self.term_stats, self.n_docs)
        return self._part("pairs", lambda path: _write(rows(), path))

    @cached_property
    def norms(self) -> DataFrame:
        """(doc_id, norm) as of any index."""
        rows = lambda: super(StoredIndex, self).norms if self.repeated else _norms(self.blocks, self.term_stats, self.n_docs)
        return self._part("norms", lambda path: rows().write.mode("overwrite").parquet(path))

    def complete(self) -> StoredIndex:
        """The index with every part written."""
        _ = self.pairs, self.norms
        return self

    def units(self, phrases: list[list[str]]) -> list[list[tuple[int, str]]]:
        """For each phrase what to look up and where it stands in it: two frequent terms side by side are one entry of `pairs`."""
        asked = sorted({t for terms in phrases for t in terms})
        known = self.term_stats.where(F.col("term").isin(asked) & (F.col("df") >= FREQUENT * self.n_docs)).select("term").collect() if asked and not self.repeated else []
        frequent = {r["term"] for r in known}  # of the phrases' own terms
        out = []
        for terms in phrases:
            units, i = [], 0
            while i < len(terms):
                both = i + 1 < len(terms) and terms[i] in frequent and terms[i + 1] in frequent
                units.append((i, f"{terms[i]} {terms[i + 1]}" if both else terms[i]))
                i += 2 if both else 1
            out.append(units)
        return out

    @cached_property
    def lists(self) -> DataFrame:
        """(term, doc_id, p) as the blocks hold them, unless an id's rows may be in several."""
        if self.repeated:
            return Index(self.documents, self.postings, self.profile).lists
        return self.blocks.select("term", F.inline(F.arrays_zip("ids", "positions"))).select("term", F.col("ids").alias("doc_id"), F.col("positions").alias("p"))

    def first_seen(self, terms: DataFrame) -> DataFrame:
        """As of any index, by the first positions of the terms' own blocks."""
        held = self.blocks.join(ranking.small(terms.select("term")), "term", "left_semi").select("term", "ids", F.transform("positions", lambda p: F.get(p, F.lit(0))).alias("pos"))
        places = held.select("term", F.inline(F.arrays_zip("ids", "pos"))).withColumnRenamed("ids", "doc_id").join(self.documents, "doc_id")
        return terms.join(places.groupBy("term").agg(F.min(F.struct("doc_seq", "pos")).alias("seen")), "term")

    def postings_of(self, units: list[str]) -> DataFrame:
        """(term, doc_id, pos) of terms and of pairs."""
        single, double = [u for u in units if " " not in u], [u for u in units if " " in u]
        rows = self.only(single)
        return rows.union(unpacked(self.pairs.where(F.col("term").isin(double)))) if double else rows


def load(spark: SparkSession, path: str, profile: Profile) -> StoredIndex:
    """The index that store() wrote; a missing one raises."""
    documents, blocks = spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/blocks")
    n, tokens, repeated = spark.read.parquet(f"{path}/totals").first()
    at = StoredIndex(documents.select("doc_id", "doc_seq"), unpacked(blocks), profile, stored=True)
    # What the dataclass would derive when first asked for is given here.
    vars(at).update(path=path, blocks=blocks, repeated=repeated, n_docs=n, n_tokens=tokens, tf=frequencies(blocks, repeated), term_stats=spark.read.parquet(f"{path}/terms"), doc_stats=documents)
    return at


def _gain(tf: Column, dl: Column, avgdl: float, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(avgdl)))


def pruned_blocks(index: StoredIndex, queries: DataFrame, k: int = 50, k1: float = 1.2, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(asked, bounded): the queries' terms (qid, term, qtf, df, idf), and (qid, block, bound, least): for each block that has a term
    of a query the most that a document in it can score, and a score that k documents are known to reach.

    That score is found on the documents of the query's rarest terms: the k best by those terms alone are scored in full, by the
    blocks that hold them, and the least of their scores is no more than the k-th best of all.
    """
    terms = ranking.small(ranking.query_terms(queries, index.profile))
    n, avgdl = float(index.n_docs), index.avgdl or 1.0
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    asked = index.term_stats.join(terms, "term").select("qid", "term", "qtf", "df", (F.col("qtf") * idf).alias("idf"))
    few = [r["term"] for r in terms.select("term").distinct().limit(FILTERED + 1).collect()]
    blocks = index.blocks.where(F.col("term").isin(few)) if len(few) <= FILTERED else index.blocks
    before = Window.partitionBy("qid").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    lead = asked.withColumn("before", F.coalesce(F.sum("df").over(before), F.lit(0))).where(F.col("before") < LEAD * k)
    rows = lambda blocks, asked: blocks.join(asked, "term").select("qid", "idf", "block", F.inline(F.arrays_zip("ids", "positions"))).select("qid", "block", F.col("ids").alias("doc_id"), "idf", F.size("positions").alias("tf"))
    scored = lambda rows: rows.join(index.doc_stats, "doc_id").groupBy("qid", "doc_id").agg(F.sum(F.col("idf") * _gain(F.col("tf"), F.col("dl"), avgdl, k1, b)).alias("score"), F.first("block").alias("block"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    leading = scored(rows(blocks, lead)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("qid", "doc_id", "block")
    # At most k rows of each query.
    whole = rows(blocks.join(leading.select("block").distinct(), "block", "left_semi"), asked).join(leading.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi")
    least = scored(whole).groupBy("qid").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).select("qid", "least")
    bounds = blocks.select("term", "block", "max_tf", "min_dl").join(asked, "term").groupBy("qid", "block").agg(F.sum(F.col("idf") * _gain(F.col("max_tf"), F.col("min_dl"), avgdl, k1, b)).alias("bound"))
    return asked, bounds.join(least, "qid", "left").select("qid", "block", "bound", F.coalesce("least", F.lit(0.0)).alias("least"))


def rank_bm25(index: StoredIndex, queries: DataFrame, k: int = 50, k1: float = 1.2, b: float = 0.75, key: Column | None = None) -> DataFrame:
    """ranking.rank_bm25(), but postings are unpacked and scored only in blocks that can hold one of a query's k best.

    Exact: the margin covers rounding, in bounds and in `key`, which orders results. An index where an id has several rows isn't
    pruned, as its blocks don't bound such a document.
    """
    if index.repeated:
        return ranking.top(ranking.bm25_scores(index, queries, k1, b), k, key)
    asked, bounded = pruned_blocks(index, queries, k, k1, b)
    kept = bounded.where(F.col("bound") * (1 + 1e-9) + 1e-6 >= F.col("least")).select("qid", "block")
    only = [r["block"] for r in kept.select("block").distinct().limit(FILTERED + 1).collect()]
    few = [r["term"] for r in asked.select("term").distinct().limit(FILTERED + 1).collect()]
    blocks = index.blocks.where(F.col("term").isin(few)) if len(few) <= FILTERED else index.blocks
    blocks = blocks.where(F.col("block").isin(only)) if len(only) <= FILTERED else blocks
    wanted = asked.join(kept, "qid").select("qid", "block", "term", "idf")
    rows = blocks.join(wanted, ["term", "block"]).select("qid", "idf", F.inline(F.arrays_zip("ids", "positions"))).select("qid", F.col("ids").alias("doc_id"), "idf", F.size("positions").alias("tf"))
    gain = _gain(F.col("tf"), F.col("dl"), index.avgdl or 1.0, k1, b)
    scores = rows.join(index.doc_stats, "doc_id").groupBy("qid", "doc_id", "doc_seq").agg(F.sum(F.col("idf") * gain).alias("score")).where("score > 0")
    return ranking.top(scores, k, key)
