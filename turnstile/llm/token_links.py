"""Alignment of two tokenizers over a corpus: groups, links, and how often each linked pair of ids is found in all documents.

Tokenizer A reads a space and the text, tokenizer B (a sentencepiece model) the text, to which it adds the space. Where a token of A and
one of B end at the same byte they are linked, and there a group ends. A pair's count is its number of links in the corpus.

1. First pass: every task aligns its documents and writes how often it saw each pair.
2. A minimal perfect hash gives the distinct pairs the numbers 0 .. n - 1. It is built in shards, by hash and displace: keys are thrown into
   small buckets, and each bucket, largest first, takes the first displacement that puts its keys on free places; the last, single
   ones name their place. The key stands at its place, so that a pair that is not in the table is told from one that is.
3. The counts of a task become one dense vector by those numbers, and vectors are added up in a tree, FAN at a time.
4. Second pass: documents are aligned again, and each link looks its count up.

Everything that the driver or a broadcast holds is bounded by the two vocabularies and not by the corpus: tokens that end together
have the end of the shorter one in common, so that a pair needs a token that is a suffix of the other. `pair_bound` counts such pairs, and
the number of distinct pairs is checked against it.

Texts are cut into chunks, and the alignment of each distinct chunk is remembered. The cuts are before a space behind any other character
that is no white space, and before a line feed between two such characters. A always begins a token there, by its pattern, and B too,
as none of its pieces holds a space behind another character or a line feed, which is checked. So tokens, links and groups of a text are
those of its chunks. Long texts without spaces are chunks of their own, read whole.

Null and empty texts, and texts whose tokens in either tokenizer don't join to the space and the text, have no tokens: all numbers are 0 and the
digest is empty. They add to no count. Rows are told apart by nothing but themselves: repeated rows count each time, a null doc_id is kept.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from turnstile.llm.common import mix, prepare, strings
from turnstile.session import materialise

FAN = 16  # vectors added up by one task
SHARD = 16_384  # pairs hashed by one task, on average
REMEMBERED = 24_000_000  # characters of chunks that a worker remembers
_BUCKET = 2  # keys of a bucket, on average
_TRIES = 256
_TOGETHER = 16_384  # characters of chunks encoded at once
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_CUT = re.compile(r"(?<=\S)(?= (?!\Z)|\n\S)")


# --- tokens --------------------------------------------------------------------------------------------------------


def byte_level() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, or one of those from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


def entries_a(path: str) -> dict[int, bytes]:
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    byte = byte_level()
    return {i: bytes(byte[c] for c in token) for token, i in vocabulary.items() if all(c in byte for c in token)}


def entries_b(path: str) -> dict[int, bytes]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            out[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            out[i] = model.id_to_piece(i).replace("▁", " ").encode()
    return out


@lru_cache(maxsize=2)
def pair_bound(path_a: str, path_b: str) -> int:
    """How many pairs of tokens can end together: those of which one is a suffix of the other."""
    a, b = Counter(entries_a(path_a).values()), Counter(entries_b(path_b).values())

    def suffixes(x: Counter, y: Counter, least: int) -> int:
        return sum(n * y.get(token[i:], 0) for token, n in x.items() for i in range(least, len(token)))

    return suffixes(a, b, 0) + suffixes(b, a, 1)


@lru_cache(maxsize=2)
def _libraries(path_a: str, path_b: str) -> tuple:
    """Both tokenizers, the bytes of their tokens by id, and how many bytes they are; loaded once a worker."""
    import sentencepiece
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    entries = entries_a(path_a), entries_b(path_b)
    if any(x.lstrip(b" ").count(b" ") or b"\n" in x != b"\n" for x in entries[1].values()):
        raise ValueError("a piece of B holds a space behind another character, or a line feed: texts cannot be cut there")
    tables = [[x.get(i, b"") for i in range(max(x) + 1)] for x in entries]  # the other ids stand for no bytes: their texts don't join
    return a, b, *tables, *(np.array([len(token) for token in x]) for x in tables)


@dataclass(frozen=True)
class Aligned:
    """Chunks, one after the other: how many tokens and links each has, the pairs, and the ids with the number of their group."""

    chunks: list[str]
    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray
    pairs: np.ndarray
    ids: tuple[np.ndarray, np.ndarray]
    groups: tuple[np.ndarray, np.ndarray]

    def texts(self) -> list[bytes]:
        """The groups of each chunk as text, with a semicolon behind each."""
        (a, b), (in_a, in_b) = self.ids, self.groups
        table, size = _group_texts(int(max(a.max(initial=0), b.max(initial=0))).bit_length())
        # Three texts an id: with a comma, or at the end of a group's side with a bar (A) or a semicolon (B).
        which = np.concatenate([3 * a + _last(in_a), 3 * b + 2 * _last(in_b)])
        which = which[np.argsort(np.concatenate([2 * in_a, 2 * in_b + 1]), kind="stable")]
        joined = b"".join(map(table.__getitem__, which.tolist()))
        ends = np.cumsum(np.concatenate([[0], size[which]]))[np.cumsum(np.concatenate([[0], self.n_a + self.n_b]))].tolist()
        return [joined[i:j] for i, j in pairwise(ends)]


def _last(groups: np.ndarray) -> np.ndarray:
    """1 for the last token of each group, else 0."""
    return np.append(groups[1:] != groups[:-1], True)[:len(groups)].astype(np.int64)


@lru_cache(maxsize=1)
def _group_texts(bits: int) -> tuple[list[bytes], np.ndarray]:
    table = [b"%d%c" % (i, end) for i in range(1 << bits) for end in b",|;"]
    return table, np.array([len(x) for x in table])


class Aligner:
    """Numbers and alignments of chunks: `number` has those of the chunks read so far, which are aligned once, and `unfit` the chunks whose tokens
    don't join to them. `finish` is given what is aligned for each batch."""

    def __init__(self, path_a: str, path_b: str, finish: Callable[[Aligned], None], limit: int = REMEMBERED):
        self.a, self.b, self.bytes_a, self.bytes_b, self.size_a, self.size_b = _libraries(path_a, path_b)
        self.space = self.b.piece_to_id("▁")
        self.finish, self.limit = finish, limit
        self.forget()

    def forget(self) -> None:
        self.number, self.unfit, self.size = {}, set(), 0

    @property
    def full(self) -> bool:
        return self.size > self.limit

    @staticmethod
    def chunks(text: str | None) -> list[str]:
        return _CUT.split(" " + text) if text else []

    def numbers(self, documents: list[list[str]]) -> list[np.ndarray]:
        """The numbers of each document's chunks, none if one is unfit. When `full`, `forget` is to be called between batches."""
        new = list(set().union(*documents).difference(self.number, self.unfit))
        if new:
            self.size += sum(map(len, new))
            aligned = self.align(new)
            self.number.update(zip(aligned.chunks, range(len(self.number), len(self.number) + len(aligned.chunks))))
            self.finish(aligned)
        return [np.fromiter(map(self.number.__getitem__, x), np.int64, len(x)) if self.unfit.isdisjoint(x) else np.zeros(0, np.int64)
                for x in documents]

    def align(self, chunks: list[str]) -> Aligned:
        """Chunks behind which another may be read at once are encoded many together: the cut between them is one for both tokenizers."""
        parts, part, size = [], [], 0
        for chunk in chunks:
            part.append(chunk)
            size += len(chunk)
            if size > _TOGETHER or chunk[-1].isspace():
                parts.append(part)
                part, size = [], 0
        parts += [part] if part else []
        read = []
        for part, a, b in zip(parts, *self._encode(["".join(x) for x in parts])):
            if self._joins(part, a, b):
                read.append((part, a, b))
                continue
            for chunk, one_a, one_b in zip(part, *self._encode(part)):
                if self._joins([chunk], one_a, one_b):
                    read.append(([chunk], one_a, one_b))
                else:
                    self.unfit.add(chunk)
        good = [chunk for part, _, _ in read for chunk in part]
        a, b = (np.concatenate([np.zeros(0, np.int64), *(x[side] for x in read)]) for side in (1, 2))
        ends = np.cumsum([len(x.encode()) for x in good], dtype=np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        at = np.searchsorted(ends_b, ends_a).clip(max=max(len(b) - 1, 0))
        linked = np.flatnonzero(ends_b[at] == ends_a) if len(a) else np.zeros(0, np.int64)
        link_ends = ends_a[linked]
        n_a, n_b, n_links = (np.diff(np.searchsorted(x, ends, side="right"), prepend=0) for x in (ends_a, ends_b, link_ends))
        return Aligned(good, n_a, n_b, n_links, a[linked] << 32 | b[at[linked]], (a, b),
                       (np.searchsorted(link_ends, ends_a), np.searchsorted(link_ends, ends_b)))

    def _encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """B adds the space that leads a text. Before a line feed it adds one too many."""
        a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([x if x[0] == "\n" else x[1:] for x in texts], num_threads=1)
        return a, [x[1:] if text[0] == "\n" and x[:1] == [self.space] else x for text, x in zip(texts, b)]

    def _joins(self, chunks: list[str], a: list[int], b: list[int]) -> bool:
        whole = "".join(chunks).encode()
        return b"".join(map(self.bytes_a.__getitem__, a)) == whole and b"".join(map(self.bytes_b.__getitem__, b)) == whole


# --- first pass ----------------------------------------------------------------------------------------------------


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(pair, n): how often each task saw each pair; a task has more than one row for a pair if it had to forget chunks in between."""
    return docs.select("text").mapInArrow(lambda batches: count_pairs(batches, path_a, path_b), "pair long, n long")


def count_pairs(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    found: list[Aligned] = []
    aligner, seen = Aligner(path_a, path_b, found.append), np.zeros(0, np.int64)

    def summed() -> pa.RecordBatch:
        pairs, at = np.unique(np.concatenate([x.pairs for x in found]), return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, at, np.repeat(seen, np.concatenate([x.n_links for x in found])))
        some = counts > 0
        return pa.record_batch([pa.array(pairs[some]), pa.array(counts[some])], ["pair", "n"])

    for batch in batches:
        numbers = aligner.numbers([aligner.chunks(t) for t in strings(batch.column(0)).to_pylist()])
        seen = np.append(seen, np.zeros(len(aligner.number) - len(seen), np.int64))
        seen += np.bincount(np.concatenate([seen[:0], *numbers]), minlength=len(seen))
        if aligner.full:
            if found:
                yield summed()
            found.clear()
            seen = seen[:0]
            aligner.forget()
    if found:
        yield summed()


# --- the table of pairs --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class PairTable:
    """A minimal perfect hash of pairs: of each shard its seed, and where its buckets and its places begin; of each bucket its displacement
    (below 0: the place itself, counted from -1); of each place its pair."""

    seeds: np.ndarray
    buckets: np.ndarray
    places: np.ndarray
    displacements: np.ndarray
    pairs: np.ndarray

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """The numbers of the pairs, -1 for those not in the table."""
        if not len(self.pairs):
            return np.full(len(pairs), -1)
        with np.errstate(over="ignore"):
            shard = pairs % len(self.seeds)
            size = (self.places[1:] - self.places[:-1])[shard]
            mixed = mix(pairs.view(np.uint64) ^ self.seeds[shard])
            bucket = (mixed % (self.buckets[1:] - self.buckets[:-1])[shard].clip(1).astype(np.uint64)).astype(np.int64)
            moved = self.displacements[(self.buckets[shard] + bucket).clip(max=len(self.displacements) - 1)]
            place = np.where(moved < 0, -1 - moved, _place(mixed, moved, size.clip(1)))
            at = (self.places[shard] + place).clip(max=len(self.pairs) - 1)
        return np.where((self.pairs[at] == pairs) & (size > 0), at, -1)


def _place(mixed: np.ndarray, moved: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    return (mix(mixed + np.asarray(moved).astype(np.uint64) * _GOLDEN) % np.asarray(size).astype(np.uint64)).astype(np.int64)


def displace(pairs: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(seed, displacements, pairs by place) of distinct pairs."""
    size, n_buckets = len(pairs), -(-len(pairs) // _BUCKET)
    for seed in range(1, 1000):
        with np.errstate(over="ignore"):
            mixed = mix(pairs.view(np.uint64) ^ np.uint64(seed))
            bucket = (mixed % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            starts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            sizes = np.diff(starts)
            taken, moved, by_place = np.zeros(size, bool), np.zeros(n_buckets, np.int64), np.zeros(size, np.int64)
            tries = np.arange(_TRIES)
            done = True
            for k in np.argsort(-sizes, kind="stable")[:np.count_nonzero(sizes > 1)].tolist():
                keys = order[starts[k]:starts[k + 1]]
                for first in range(0, 1 << 20, _TRIES):
                    places = _place(mixed[keys][:, None], first + tries, size)
                    free = ~taken[places].any(axis=0)
                    for i in range(len(keys)):
                        free &= ~(places[:i] == places[i]).any(axis=0)
                    if free.any():
                        found = int(np.argmax(free))
                        moved[k], at = first + found, places[:, found]
                        taken[at], by_place[at] = True, pairs[keys]
                        break
                else:
                    done = False
                    break
        if done:
            single = np.flatnonzero(sizes == 1)
            left = np.flatnonzero(~taken)
            moved[single], by_place[left] = -1 - left, pairs[order[starts[single]]]
            return seed, moved, by_place
    raise RuntimeError("no seed places all pairs")


def pair_table(counted: DataFrame, bound: int) -> PairTable:
    """The table of the distinct pairs, at most `bound`. Shards are hashed by tasks; the driver only puts them side by side."""
    distinct = materialise(counted.select("pair").distinct(), "pairs")
    n = distinct.count()
    if n > bound:
        raise ValueError(f"{n} pairs of tokens end together, where the vocabularies allow {bound}")
    shards = n // SHARD * 2 + 1  # odd, as pairs end in the id of B

    def build(group: pd.DataFrame) -> pd.DataFrame:
        seed, moved, by_place = displace(np.sort(group["pair"].to_numpy(np.int64)))
        return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "seed": [seed], "moved": [moved.tobytes()], "pairs": [by_place.tobytes()]})

    built = {r.shard: r for r in distinct.selectExpr(f"cast(pair % {shards} as int) as shard", "pair").groupBy("shard").applyInPandas(
        build, "shard int, seed long, moved binary, pairs binary").collect()}
    moved, placed = ([np.frombuffer(getattr(built[k], name), np.int64) if k in built else np.zeros(0, np.int64) for k in range(shards)]
                     for name in ("moved", "pairs"))
    return PairTable(np.array([built[k].seed if k in built else 0 for k in range(shards)], np.uint64),
                     np.cumsum([0, *map(len, moved)]), np.cumsum([0, *map(len, placed)]), np.concatenate(moved), np.concatenate(placed))


def total_counts(counted: DataFrame, table: PairTable) -> np.ndarray:
    """The count of every pair, by its number: dense vectors of tasks, added up FAN at a time."""
    spark = counted.sparkSession
    shared = spark.sparkContext.broadcast(table)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.pairs), np.int64)
        for batch in batches:
            np.add.at(total, shared.value.find(batch.column(0).to_numpy()), batch.column(1).to_numpy())
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["node", "counts"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(np.frombuffer(group["counts"].iloc[0], np.int64)), np.int64)
        for x in group["counts"]:
            total += np.frombuffer(x, np.int64)
        return pd.DataFrame({"node": [int(group["node"].iloc[0])], "counts": [total.tobytes()]})

    vectors = materialise(counted.select("pair", "n").mapInArrow(dense, "node int, counts binary"), "vectors")
    nodes = (vectors.agg({"node": "max"}).first()[0] or 0) + 1
    while nodes > 1:
        vectors = materialise(vectors.selectExpr(f"node div {FAN} as node", "counts").selectExpr("cast(node as int) as node", "counts")
                              .groupBy("node").applyInPandas(add, "node int, counts binary"), "vectors")
        nodes = -(-nodes // FAN)
    found = vectors.first()
    return np.frombuffer(found.counts, np.int64) if found else np.zeros(len(table.pairs), np.int64)


# --- second pass ---------------------------------------------------------------------------------------------------


def links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    n_best are the links whose pair has the highest count of its B id in the corpus, count_sum is the sum of the links' counts. The digest is of
    the groups `a1,a2|b1;a3|b2,b3`, ids in order.
    """
    spark = prepare(docs.sparkSession)
    counted = materialise(pair_counts(docs, path_a, path_b), "pair_counts")
    table = pair_table(counted, pair_bound(path_a, path_b))
    counts = total_counts(counted, table)
    best = np.zeros(1 + int((table.pairs & 0xFFFFFFFF).max(initial=0)), np.int64)
    np.maximum.at(best, table.pairs & 0xFFFFFFFF, counts)
    shared = spark.sparkContext.broadcast((table, counts, best))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts, best = shared.value
        numbers_of, groups = [np.zeros((0, 5), np.int64)], []  # by chunk: n_a, n_b, links, links of the highest count, sum of counts

        def look_up(found: Aligned) -> None:
            at = table.find(found.pairs)
            if (at < 0).any():
                raise ValueError("the second pass found a pair that the first one didn't")
            n = counts[at]
            ends = np.cumsum(np.concatenate([[0], found.n_links]))
            sums, tops = (np.diff(np.cumsum(np.concatenate([[0], x]))[ends]) for x in (n, n == best[found.pairs & 0xFFFFFFFF]))
            numbers_of.append(np.stack([found.n_a, found.n_b, found.n_links, tops, sums], axis=1))
            groups.extend(found.texts())

        aligner = Aligner(path_a, path_b, look_up)
        for batch in batches:
            documents = aligner.numbers([aligner.chunks(t) for t in strings(batch.column(1)).to_pylist()])
            numbers_of[:] = [np.concatenate(numbers_of)]
            sums = np.stack([numbers_of[0][x].sum(axis=0) for x in documents]) if documents else np.zeros((0, 5), np.int64)
            digests = [hashlib.sha256(b"".join(map(groups.__getitem__, x.tolist()))[:-1]).hexdigest() if len(x) else "" for x in documents]
            if aligner.full:
                aligner.forget()
                numbers_of[:], groups[:] = [np.zeros((0, 5), np.int64)], []
            a, b, found, top, total = (pa.array(x, pa.int64()) for x in sums.T)
            yield pa.record_batch([batch.column(0), a, b, found, found, top, total, pa.array(digests, pa.string())],
                                  ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(
        describe, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
