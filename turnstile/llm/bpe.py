"""Byte-level BPE over a corpus: encoding by a global shuffle of distinct words, decoding by the token-byte table.

1. Explode. Documents are taken in blocks of bounded size. A block lists its distinct pre-tokens once, and each document keeps the
   positions: which word of the block's list stands where. So a word that stands in every text costs one entry a block, not a row an
   occurrence, and no word is hot.
2. Encode. The lists are dealt by a hash of the word, a bucket of words at a time, so equal words of all blocks meet in one task, which
   encodes each distinct word once.
3. Join back and reassemble. The ids return to their blocks, bucket by bucket, and the documents of a block put them together by position.
4. Decode. Every id is looked up in the token-byte table, which has one row a token (tens of thousands, whatever the corpus).

Lists and positions travel compressed, as binary columns. A block holds BLOCK characters of text or one document, if that is longer.

Nulls: a null text is encoded like an empty one, into no ids. Rows that repeat a doc_id, or have none, stay rows of their own. Other
columns are neither read nor returned. Very long texts and words are never cut.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import prepare, strings
from turnstile.llm.tokens import Pieces, cuts_at_spaces, encoding, ranks, splitter
from turnstile.session import materialise

BLOCK = 24_000_000  # characters
ROW = 32_000_000  # bytes of positions in a row before compression, of one document at least
LEVEL, WINDOW = 12, 24  # of zstd
_EXPLODED = "block long, bucket int, doc_ids array<string>, data binary"
_LARGE = 0xFFFF
_DOCUMENT = -1  # the bucket of rows that hold a document's positions


class _Block:
    """Distinct words of a block, numbered as they come, and documents as the numbers of their words."""

    def __init__(self, pattern: str):
        self.words: dict[str, int] = {}
        self.split = splitter(pattern)
        self.positions = Pieces(self.numbers, 400_000).joined if cuts_at_spaces(pattern) else self.numbers
        self.documents: list[tuple[str | None, bytes]] = []
        self.size = 0

    def numbers(self, chunk: str) -> bytes:
        words = self.words
        return np.array([words.setdefault(w, len(words)) for w in self.split(chunk)], "<u4").tobytes()

    def add(self, doc_id, text: str) -> None:
        self.documents.append((doc_id, self.positions(text)))
        self.size += len(text)

    def rows(self, block: int, buckets: int):
        """Words are numbered anew, frequent ones first. Those that stand once come last, in the order of their places: all of these are
        written as one number, and the n-th is known by its turn. Documents travel many a row, so that copies compress well."""
        counts = np.zeros(len(self.words), np.int64)
        for _, data in self.documents:
            counts += np.bincount(np.frombuffer(data, "<u4"), minlength=len(counts))
        once = int((counts > 1).sum())  # the number that stands for every word found once
        number = np.full(len(counts), once, np.uint32)
        number[np.argsort(-counts, kind="stable")[:once]] = np.arange(once, dtype=np.uint32)
        place, turn = number.copy(), once
        held, size = [], 0
        for doc_id, data in [*self.documents, (None, None)]:
            if held and (data is None or size > ROW):
                words = np.frombuffer(b"".join(d for _, d in held), "<u4")
                single = words[counts[words] == 1]
                place[single] = np.arange(turn, turn + len(single), dtype=np.uint32)
                head = np.array([once, turn, len(held), *(len(d) // 4 for _, d in held)], "<u4").tobytes()
                yield block, _DOCUMENT, [i for i, _ in held], head + _squeezed_numbers(number[words])
                held, size, turn = [], 0, turn + len(single)
            if data is not None:
                held.append((doc_id, data))
                size += len(data)
        lists: list[list[tuple[int, bytes]]] = [[] for _ in range(buckets)]
        for word, count, at in zip(self.words, counts.tolist(), place.tolist(), strict=True):
            if count:  # a text that is split a second time may leave words that stand nowhere
                data = word.encode()
                lists[zlib.crc32(data) % buckets].append((at, data))
        for bucket, found in enumerate(lists):
            if found:
                found.sort()
                yield block, bucket, None, _packed([n for n, _ in found], [len(w) for _, w in found], _squeezed(b"".join(w for _, w in found)))


def _squeezed(data: bytes) -> bytes:
    window = min(WINDOW, max(10, len(data).bit_length()))  # a short list needs no large tables
    settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=max(1, len(data)), window_log=window)
    return zstandard.ZstdCompressor(compression_params=settings).compress(data)


def _spread(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor(max_window_size=1 << WINDOW).decompress(data)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers under 2^32, compressed byte by byte: first all lowest bytes, then the next ones."""
    return _squeezed(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_spread(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _joined(first: bytes, second: bytes) -> bytes:
    return np.array([len(first)], "<u4").tobytes() + first + second


def _parted(data: bytes) -> tuple[bytes, bytes]:
    size = int(np.frombuffer(data, "<u4", 1)[0])
    return data[4:4 + size], data[4 + size:]


def _squeezed_numbers(numbers: np.ndarray) -> bytes:
    """Numbers of two bytes each; larger ones are marked and follow."""
    return _joined(_squeezed(np.minimum(numbers, _LARGE).astype("<u2").tobytes()), _planes(numbers[numbers >= _LARGE]))


def _spread_numbers(data: bytes) -> np.ndarray:
    small, large = _parted(data)
    numbers = np.frombuffer(_spread(small), "<u2").astype(np.uint32)
    numbers[numbers == _LARGE] = _from_planes(large)
    return numbers


def _packed(numbers: list[int], lengths: list[int], values: bytes) -> bytes:
    """Rising numbers as differences, lengths of the values, and the values, which come compressed."""
    return _joined(_planes(np.concatenate([np.diff(numbers, prepend=0), lengths])), values)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    head, values = _parted(data)
    steps, lengths = _from_planes(head).reshape(2, -1)
    return np.cumsum(steps, dtype=np.int64), lengths, values


def _cut(values: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    return [values[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    block, bucket, doc_ids, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), pa.array(doc_ids, pa.list_(pa.string())),
                                       pa.array(data, pa.binary())], ["block", "bucket", "doc_ids", "data"])


def _explode(pattern: str, buckets: int, size: int):
    def run(batches):
        from pyspark import TaskContext

        number, block = 0, _Block(pattern)
        part = TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text")).to_pylist(), strict=True):
                block.add(doc_id, text)
                if block.size >= size:
                    yield _batch(list(block.rows((part << 32) + number, buckets)))
                    number, block = number + 1, _Block(pattern)
        if block.documents:
            yield _batch(list(block.rows((part << 32) + number, buckets)))

    return run


def _encode(path: str, pattern: str):
    """Lists of words become lists of ids. A partition holds whole buckets, so it meets every list that has a word."""

    def run(batches):
        encode, known = encoding(path, pattern).encode_ordinary, {}

        def ids(word: bytes) -> bytes:
            found = known.get(word)
            if found is None:
                found = known[word] = np.array(encode(word.decode()), "<u4").tobytes()
            return found

        for batch in batches:
            out = []
            for block, bucket, data in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "data")), strict=True):
                numbers, lengths, words = _unpacked(data)
                made = [ids(w) for w in _cut(_spread(words), lengths)]
                out.append((block, bucket, None, _packed(numbers.tolist(), [len(x) for x in made], _planes(np.frombuffer(b"".join(made), "<u4")))))
            if out:
                yield _batch(out)

    return run


def _reassemble(finish):
    """Ids of each document of a block, from positions and the block's lists; `finish` makes the output row of (doc_id, ids)."""

    def run(documents: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        table: dict[int, bytes] = {}
        for data in lists.data:
            numbers, lengths, values = _unpacked(data)
            table.update(zip(numbers.tolist(), _cut(_from_planes(values).tobytes(), lengths), strict=True))
        lookup = [table[i] for i in range(len(table))]
        return finish(_documents(documents, lookup))

    return run


def _documents(rows: pd.DataFrame, lookup: list[bytes]):
    """(doc_id, ids) of the documents in the rows."""
    for doc_ids, data in zip(rows.doc_ids, rows.data, strict=True):
        once, turn, n = np.frombuffer(data, "<u4", 3).tolist()
        ends = np.cumsum(np.frombuffer(data, "<u4", n, 12), dtype=np.int64).tolist()
        numbers = _spread_numbers(data[12 + 4 * n:])
        single = numbers == once
        numbers[single] = np.arange(turn, turn + int(single.sum()), dtype=np.uint32)
        for doc_id, first, last in zip(doc_ids, [0, *ends], ends, strict=False):
            yield doc_id, b"".join(map(lookup.__getitem__, numbers[first:last].tolist()))


def _distributed(docs: DataFrame, path: str, pattern: str, finish, schema: str) -> DataFrame:
    spark = prepare(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # as text: pandas has no whole numbers with nulls
    exploded = materialise(docs.mapInArrow(_explode(pattern, parts, BLOCK), _EXPLODED), "exploded")
    lists = exploded.where(f"bucket <> {_DOCUMENT}").repartition(parts, "bucket").mapInArrow(_encode(path, pattern), _EXPLODED)
    documents = exploded.where(f"bucket = {_DOCUMENT}")
    return documents.groupBy("block").cogroup(lists.groupBy("block")).applyInPandas(_reassemble(finish), f"doc_id string, {schema}").withColumn(
        "doc_id", F.col("doc_id").cast("long"))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of every document's text, as little-endian unsigned 32-bit numbers in a binary column."""

    def finish(rows):
        return pd.DataFrame(list(rows), columns=["doc_id", "ids"])

    return _distributed(docs, path, pattern, finish, "ids binary")


def decoder(path: str):
    """A function from ids, as `encode` returns them, to bytes."""
    by_rank = {rank: token for token, rank in ranks(path).items()}
    table = [by_rank.get(i, b"") for i in range(max(by_rank) + 1)]

    def bytes_of(ids: bytes) -> bytes:
        return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    return bytes_of


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes) of (doc_id, ids). Null ids give null; an id that the table lacks is an error or empty."""
    prepare(encoded.sparkSession)

    def run(batches):
        bytes_of = decoder(path)
        for batch in batches:
            made = [None if ids is None else bytes_of(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(made, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes what came out, and keeps the digests of both."""

    def finish(rows):
        bytes_of = decoder(path)
        return pd.DataFrame(
            [(doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bytes_of(ids)).hexdigest()) for doc_id, ids in rows],
            columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _distributed(docs, path, pattern, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string")
