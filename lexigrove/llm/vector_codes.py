"""Product codes of vectors, found by partial-distance search over integer components.

Each component x becomes floor(scale * x); a vector is cut into equal consecutive parts, and each part's place has a codebook.
A codebook starts as that part of the first kept vectors by id. A round gives every part the nearest entry of its codebook and
moves each entry to the floor of its parts' mean; an entry that nobody chose stays. All sums are of integers, so the result
doesn't depend on how rows are dealt.

The search goes through dimensions in descending variance of the codebook. The entry nearest on the first two is measured
whole; then each other entry's distance grows by a dimension at a time, and rows where it strictly exceeds the best complete
distance so far leave the entry's mask. Ties go to the lower index.

A round is one scan and one sum of parts * entries rows from each task; only the codebooks, of fixed size, reach the driver.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; repeated rows and repeated ids
each count and give a row each, those of one id seeding in order of their vectors; a null id sorts after all others; with fewer
kept rows than entries a codebook has as many entries as rows; no kept row gives no rows; an empty vector has code 0 and error
0 throughout. Vectors of several lengths, of a length that can't be cut into the parts, or with components too large for 64-bit
distances (beyond LARGEST) raise. Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexigrove.llm.scratch import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: The largest magnitude of an integer component: its distances over 2^8 dimensions, times an entry's index, fit in 64 bits.
LARGEST = 1 << 24
#: Rows that are compared at once.
ROWS = 4096
#: Totals of at most so many labels are broadcast; more are joined by shuffle.
FEW_LABELS = 100_000


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry of book (entries, width) that is nearest to each column of x (width, n)."""
    n, (entries, width) = x.shape[1], book.shape
    if not width or not n:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-book.astype(float).var(axis=0), kind="stable")
    lead, rest = order[:2], order[2:]
    begun = sum((x[d][None, :] - book[:, d][:, None]) ** 2 for d in lead)  # (entries, n)
    which = begun.argmin(axis=0)
    best = begun[which, np.arange(n)].copy()
    for d in rest:
        best += (x[d] - book[which, d]) ** 2
    first = which.copy()
    for entry in range(entries):
        alive = np.flatnonzero((begun[entry] <= best) & (first != entry))
        so_far = begun[entry, alive]
        for d in rest:
            if not len(alive):
                break
            so_far = so_far + (x[d, alive] - book[entry, d]) ** 2
            mask = so_far <= best[alive]
            alive, so_far = alive[mask], so_far[mask]
        wins = (so_far < best[alive]) | ((so_far == best[alive]) & (entry < which[alive]))
        best[alive[wins]], which[alive[wins]] = so_far[wins], entry
    return which, best


def _kept(vectors: pa.Array, scale: int, parts: int, length: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(mask of rows, integer components (rows kept, length))."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    offsets = vectors.offsets.to_numpy()
    sizes = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), -1)
    values = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become nan
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    mask = (sizes >= 0) & (bad[offsets[1:]] == bad[offsets[:-1]])
    found = np.unique(sizes[mask])
    if length is None and len(found):
        length = int(found[0])
    if len(found) > 1 or (len(found) and found[0] != length) or (length or 0) % parts:
        raise ValueError(f"vectors of lengths {found.tolist()}: all must have one length that {parts} divides")
    if not len(found) or not length:
        return mask, np.zeros((int(mask.sum()), length or 0), np.int64)
    x = np.floor(values[offsets[:-1][mask][:, None] + np.arange(length)] * float(scale))
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST / scale}")
    return mask, x.astype(np.int64)


def _by_part(x: np.ndarray, parts: int) -> Iterator[list[np.ndarray]]:
    """Blocks of rows; for each part an array (width, n)."""
    width = x.shape[1] // parts
    for at in range(0, len(x), ROWS):
        turned = np.ascontiguousarray(x[at : at + ROWS].T)
        yield [turned[p * width : (p + 1) * width] for p in range(parts)]


def _first(entries: int, scale: int, parts: int) -> Callable:
    """A function from batches (id, vector) to a task's first kept rows by id and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        for batch in batches:
            mask, x = _kept(batch.column(1), scale, parts)
            ids = batch.column(0).filter(pa.array(mask))
            order = ids.cast(pa.int64()).fill_null(2**63 - 1).to_numpy()
            if len(order) > entries:
                some = np.flatnonzero(order <= np.partition(order, entries - 1)[entries - 1])
            else:
                some = np.arange(len(order))
            if len(best) == entries and len(order):
                some = some[order[some] <= (2**63 - 1 if best[-1][0] else best[-1][1])]
            found = ((i is None, i or 0, row) for i, row in zip(ids.take(pa.array(some)).to_pylist(), x[some].tolist(), strict=True))
            best = sorted([*best, *found])[:entries]
        yield pa.record_batch([pa.array([None if null else i for null, i, _ in best], pa.int64()), pa.array([row for _, _, row in best], pa.list_(pa.int64()))], names=["id", "vector"])

    return run


def _sums(codebooks: np.ndarray, scale: int) -> Callable:
    """A function from batches (vector) to a task's sums by part and entry."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            _, x = _kept(batch.column(0), scale, parts, parts * width)
            for block in _by_part(x, parts):
                for p, part in enumerate(block):
                    which, _ = nearest(part, codebooks[p])
                    count[p] += np.bincount(which, minlength=entries)
                    for d in range(width):  # sums of a block fit in a double's integers
                        total[p, :, d] += np.bincount(which, weights=part[d], minlength=entries).astype(np.int64)
        p, e = np.nonzero(count)
        yield pa.record_batch([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    return run


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks (parts, entries, width) of integer components; no entries where no row is kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    seeds = rows.mapInArrow(_first(entries, scale, parts), "id long, vector array<long>").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    lengths = {len(r["vector"]) for r in seeds}
    if len(lengths) > 1:
        raise ValueError(f"vectors of lengths {sorted(lengths)}: all must have one length that {parts} divides")
    width = (lengths.pop() if lengths else 0) // parts
    codebooks = np.array([r["vector"] for r in seeds], np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2).copy()
    if not width or not seeds:
        return codebooks
    for _ in range(rounds):
        sums = rows.select("vector").mapInArrow(_sums(codebooks, scale), "part int, entry int, n long, total array<long>")
        each = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[d]).alias(f"d{d}") for d in range(width)])
        for r in each.collect():  # parts * entries rows
            codebooks[r["part"], r["entry"]] = [r[f"d{d}"] // r["n"] for d in range(width)]
    return codebooks


def assign(vectors: DataFrame, codebooks: np.ndarray, carried: tuple[str, ...] = ("vec_id",), vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The carried columns of kept rows with `code` (two hex digits a part) and `error` (squared distance)."""
    parts, entries, width = codebooks.shape
    fields = [vectors.schema[c] for c in carried]
    hexes = np.array([f"{e:02x}" for e in range(max(entries, 1))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, x = _kept(batch.column(batch.num_columns - 1), scale, parts, parts * width)
            codes, errors = [np.zeros(0, "U2")], [np.zeros(0, np.int64)]
            for block in _by_part(x, parts):
                found = [nearest(part, codebooks[p]) for p, part in enumerate(block)]
                text = hexes[found[0][0]]
                for which, _ in found[1:]:
                    text = np.char.add(text, hexes[which])
                codes.append(text)
                errors.append(sum(distance for _, distance in found))
            held = [batch.column(i).filter(pa.array(mask)) for i in range(batch.num_columns - 1)]
            yield pa.record_batch([*held, pa.array(np.concatenate(codes).tolist(), pa.string()), pa.array(np.concatenate(errors), pa.int64())], names=[f"c{i}" for i in range(len(held))] + ["code", "error"])

    schema = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)] + [StructField("code", StringType()), StructField("error", LongType())])
    if not entries:
        found = vectors.sparkSession.createDataFrame([], schema)
    else:
        found = vectors.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)], F.col(vector_col).alias("vector")).mapInArrow(run, schema)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)], "code", "error")


def decode(codes: DataFrame, codebooks: np.ndarray, scale: int = SCALE) -> DataFrame:
    """`codes` with `vector`: the entries that each code names, back on the vectors' scale; a null code gives null."""
    parts, entries, _ = codebooks.shape
    entry = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    books = [F.array(*[F.array(*[F.lit(float(v) / scale) for v in codebooks[p, e]]) for e in range(entries)]) for p in range(parts)]
    return codes.withColumn("vector", F.when(F.col("code").isNotNull(), F.concat(*[F.element_at(books[p], entry(p) + 1) for p in range(parts)])))


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each kept row; label_error sums error over rows of equal label,
    nulls together. The codes are written once; the sums by label are joined back on, so no label's rows meet in one task."""
    scratch = Scratch(vectors.sparkSession, "vector-codes")
    codebooks = train(vectors, id_col, vector_col, parts, entries, rounds, scale)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    coded = scratch.keep(assign(rows, codebooks, ("vec_id", "label"), "embedding", scale), "codes")
    totals = scratch.keep(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    few = totals.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    both = coded.join(F.broadcast(totals) if few else totals, F.col("label").eqNullSafe(F.col("of")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same for DuckDB, a step of the query for each half of a round."""
    apart = "CAST(list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) AS BIGINT)"
    steps = [
        f"""k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id, q) AS r FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
          FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))""",
        f"p AS MATERIALIZED (SELECT r, vec_id, label, part, q[part * (len(q) // {parts}) + 1:(part + 1) * (len(q) // {parts})] AS v FROM k, range({parts}) t(part))",
        f"c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v FROM p WHERE r <= {entries})",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, part, min({{'d': {apart}, 'e': c.entry}}) AS best FROM p JOIN c{n} c USING (part) GROUP BY ALL)")
        if n < rounds:
            steps.append(f"s{n} AS (SELECT part, best.e AS entry, i, sum(v[i]) AS s, count(*) AS n FROM a{n} JOIN p USING (r, part), range(1, len(v) + 1) t(i) GROUP BY ALL)")
            steps.append(f"m{n} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{n} GROUP BY ALL)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} USING (part, entry))")
    return f"""WITH {", ".join(steps)},
        books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}),
        coded AS (SELECT r, string_agg(format('{{:02x}}', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN k USING (r), books"""
