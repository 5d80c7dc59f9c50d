"""Packing of tokenized documents into sequences of a fixed length: bulk-synchronous best fit, longest pieces first.

A document is its token ids and one closing id. Only a document longer than a sequence is cut, into full sequences and one shorter piece,
which comes first.

* Pieces are sorted by length, and each gets its rank among the pieces of its length. Ranks come from counts of (length, bucket), so
  a length that a third of all pieces share is counted in many tasks.
* Gaps are kept sorted too. Sequences with equal gaps are alike, so they are held as runs (gap, first sequence, sequences).
* A sweep takes the longest pieces left and finds the successor of their length among the gaps: the smallest gap that holds them. Pieces
  and sequences of the run are matched by rank, so no two pieces meet in a place; each sequence takes as many as fit. The run's
  gap is updated, and the sweep repeats with what is left; pieces without a successor open new sequences, again by rank.
* Lengths run from 1 to the length of a sequence, so a sweep works on at most that many counts and on runs, whatever the number of
  documents: the table of sweeps is bounded by the length of a sequence, not by the data, and goes to every task. Each piece
  then finds its sequence and place in it by its length and rank. What is matched is what sweeps over the pieces themselves would match, one
  after the other, in one pass over the data.

Nulls: a text that is null or empty is one closing id. Rows that repeat a doc_id, or have none, are packed as documents of their own.
Other columns are neither read nor returned. A table without rows gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstile.llm.common import prepare, strings
from turnstile.llm.tokens import Pieces, cuts_at_spaces, encoding
from turnstile.session import materialise

LENGTH = 2048
REMEMBERED = 300_000  # chunks of text whose ids a Python worker keeps
PIECES_A_BUCKET = 100_000
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def text_ids(path: str, pattern: str, limit: int = REMEMBERED, added: dict[str, int] | None = None):
    """A function from a text to its ids, as little-endian unsigned 32-bit numbers. Tokens in `added` are found in the text first."""
    encode = encoding(path, pattern).encode_ordinary

    def one(chunk: str) -> bytes:
        return np.array(encode(chunk), "<u4").tobytes()

    plain = Pieces(one, limit).joined if cuts_at_spaces(pattern) else one
    if not added:
        return plain
    cuts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    ids = {token: np.array([i], "<u4").tobytes() for token, i in added.items()}

    def joined(text: str) -> bytes:
        first, *rest = cuts.split(text)
        if not rest:
            return plain(text)
        return b"".join([plain(first) if first else b"", *(ids[x] if k % 2 == 0 else plain(x) if x else b"" for k, x in enumerate(rest))])

    return joined


_encoders: dict[tuple, object] = {}  # of this worker: what it has seen serves its next partitions


def _pieces(path: str, pattern: str, length: int, closing: int, added: dict[str, int] | None):
    def run(batches):
        key = (path, pattern, *sorted((added or {}).items()))
        ids_of = _encoders.get(key) or _encoders.setdefault(key, text_ids(path, pattern, added=added))
        end = np.array([closing], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text")).to_pylist(), strict=True):
                ids = memoryview(ids_of(text) + end)
                total, start, number = len(ids) // 4, 0, 0
                while start < total:
                    size = (total - start) % length or length
                    out.append((doc_id, number, start, size, zlib.crc32(ids[4 * start:4 * (start + size)])))
                    start, number = start + size, number + 1
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, closing: int = 0, added: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of every document."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(path, pattern, length, closing, added), _PIECE)


def sweeps(counts: dict[int, int], length: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts of pieces by length: rows (length, first rank, pieces, first sequence, pieces a sequence, offset).

    Pieces of that length with ranks from the first on go to the sequences from the first on, so many to each, one behind the other.
    """
    gaps: list[int] = []  # sorted, without repeats
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, sequences)
    out, opened = [], 0

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not runs[gap]:
                insort(gaps, gap)
            runs[gap].append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect_left(gaps, size)
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    gaps.pop(at)
            else:
                gap, first, n = length, opened, -(-left // (length // size))
                opened += n
            fit = gap // size
            full, rest = min(n, left // fit), 0
            if full:
                out.append((size, rank, full * fit, first, fit, length - gap))
                add(gap - fit * size, first, full)
                rank, left = rank + full * fit, left - full * fit
            if left and full < n:
                rest = left
                out.append((size, rank, rest, first + full, rest, length - gap))
                add(gap - rest * size, first + full, 1)
                rank, left = rank + rest, 0
            add(gap, first + full + bool(rest), n - full - bool(rest))
    return out


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds `rank`, from 0, among the pieces of the same length, in an order that the rows alone decide."""
    rows = pieces.count()
    buckets = max(1, rows // PIECES_A_BUCKET)
    dealt = pieces.withColumn("_bucket", F.expr(f"cast(pmod(xxhash64(doc_id, piece), {buckets}) as int)"))
    counts = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (dealt.withColumn("_in", F.row_number().over(inside)).join(starts, ["length", "_bucket"])
            .withColumn("rank", F.expr("_before + _in - 1")).drop("_bucket", "_in", "_before"))


def _place(table: list[tuple], schema: pa.Schema):
    """Finds the sweep of each piece by length and rank, and from it the sequence and the offset."""
    size, first, _, sequence, each, offset = np.array(sorted(table), np.int64).reshape(-1, 6).T
    keys = (size << 40) + first

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 40) + rank, side="right") - 1
            within = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in schema.names[:-2]), pa.array(sequence[at] + within // each[at]),
                 pa.array(offset[at] + within % each[at] * length)], schema=schema)

    return run


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of `pieces`, whose lengths are 1 to `length`."""
    prepare(pieces.sparkSession)
    pieces = materialise(pieces, "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `length` rows
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32")),
                        ("sequence_id", pa.int64()), ("offset", pa.int64())])
    return ranked(pieces).mapInArrow(_place(sweeps(counts, length), schema), _PIECE + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, added: dict[str, int] | None = None) -> DataFrame:
    return pack(token_pieces(docs, path, pattern, length, added=added), length)
