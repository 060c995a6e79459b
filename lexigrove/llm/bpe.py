"""Byte-level BPE encoding and decoding by a given rank file.

Defined results: a null text counts as empty and gives no ids; texts of any length are encoded whole (long ones in
runs of matches, so memory stays bounded by the text itself); repeated rows and null doc_ids each give their row.
Only doc_id and text are read. No shuffle: rows are independent, the vocabulary is one bounded broadcast.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces whose ids a task remembers; when full it starts anew, which changes speed only.
REMEMBERED = 400_000
#: Texts longer than this are matched piecewise, LONG matches at a time.
LONG = 1 << 20


def merge_ranks(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of one piece: a segment tree over its byte positions holds, at the start of each live token, the rank of
    the pair it begins, and at its root the least of (rank, position), that is the leftmost minimum. A merge changes
    three leaves: the merged token's, its left neighbour's and the swallowed one's; each is a logarithmic update."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    bits = n.bit_length()
    size, none, low = 1 << (n - 1).bit_length(), 1 << 62, (1 << bits) - 1
    tree = [none] * (2 * size)
    end, before = list(range(1, n + 1)), list(range(-1, n))
    get = ranks.get
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            tree[size + i] = r << bits | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = size + i
        if tree[k] == value:
            return
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            if other < value:
                value = other
            k >>= 1
            if tree[k] == value:
                return
            tree[k] = value

    def pair(i: int) -> int:
        """The leaf of the token at i and its right neighbour."""
        if (j := end[i]) >= n or (e := end[j]) - i > longest or (r := get(piece[i:e])) is None:
            return none
        return r << bits | i

    while (top := tree[1]) != none:
        i = top & low
        j = end[i]
        e = end[i] = end[j]
        if e < n:
            before[e] = i
        put(j, none)
        put(i, pair(i))
        if (p := before[i]) >= 0:
            put(p, pair(p))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Codec:
    """Encodes and decodes whole texts; ids are kept as decimal text joined by commas."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.tokens = {str(i): t for t, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks), default=0)
        # Of the pattern's classes only \s differs between libraries: here it is Unicode's White_Space.
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.known: dict[str, str] = {}

    def _miss(self, piece: str) -> str:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        out = self.known[piece] = ",".join(map(str, merge_ranks(piece.encode(), self.ranks, self.longest)))
        return out

    def encode(self, text: str | None) -> Iterator[str]:
        """The ids in runs of comma-joined decimals; a short text is one run, an empty one none."""
        get, miss = self.known.get, self._miss
        if not text:
            return
        if len(text) <= LONG:
            yield ",".join([get(p) or miss(p) for p in self.pattern.findall(text)])
            return
        matches = self.pattern.finditer(text)
        while run := [m[0] for m in islice(matches, LONG)]:
            yield ",".join([get(p) or miss(p) for p in run])

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.split(","))) if ids else b""


_CODECS: dict[tuple[bytes, str], Codec] = {}


@contextmanager
def _codec(vocabulary: bytes, pattern: str) -> Iterator[Codec]:
    """A worker's codec, for one task; the pieces that the task remembered go with it, as the worker may do other work next."""
    key = (hashlib.sha256(vocabulary).digest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(vocabulary, pattern)
    try:
        yield _CODECS[key]
    finally:
        _CODECS[key].known.clear()


def _load(df: DataFrame, path: str):
    """The rank file, read once on the driver; a vocabulary is a fixed file of about a megabyte."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Columns (doc_id, ids array<int>)."""
    shared = _load(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(shared.value, pattern) as codec:
            for batch in batches:
                for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                    ids = [np.fromstring(",".join(codec.encode(t)), np.int32, sep=",") for t in part.column(1).to_pylist()]
                    yield pa.record_batch([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Columns (doc_id, decoded binary) from (doc_id, ids); null ids count as none."""
    shared = _load(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(shared.value, pattern) as codec:
            for batch in batches:
                out = [codec.decode(",".join(map(str, ids or ()))) for ids in batch.column(1).to_pylist()]
                yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids, and digest both in the same pass.

    Columns (doc_id, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256 of the decoded bytes) and,
    if asked for, ids array<int>.
    """
    shared = _load(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(shared.value, pattern) as codec:
            for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
                n, ids_sha, text_sha, lists = [], [], [], []
                for text in (x.as_py() for x in batch.column(1)):
                    count, ids_hash, text_hash, runs = 0, hashlib.sha256(), hashlib.sha256(), []
                    for ids in codec.encode(text):
                        ids_hash.update((("," if count else "") + ids).encode())
                        count += ids.count(",") + 1
                        text_hash.update(codec.decode(ids))
                        if with_ids:
                            runs.append(np.fromstring(ids, np.int32, sep=","))
                    n.append(count)
                    ids_sha.append(ids_hash.hexdigest())
                    text_sha.append(text_hash.hexdigest())
                    lists.append(np.concatenate(runs) if runs else np.zeros(0, np.int32))
                columns = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
                yield pa.record_batch(columns | ({"ids": pa.array(lists, pa.list_(pa.int32()))} if with_ids else {}))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
