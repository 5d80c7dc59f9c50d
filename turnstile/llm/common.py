"""Helpers shared by the operators: session settings, code for the executors, groups of copies, vectorised word hashes."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.session import materialise, tune

#: Rows of a batch handed to Python. Long texts make a batch of the usual 10,000 rows too large.
BATCH_ROWS = "1000"


def prepare(spark: SparkSession) -> SparkSession:
    """Settings of the library, smaller Python batches, and this package on the executors."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    context = spark.sparkContext
    if not getattr(context, "_turnstile_shipped", False):
        package = Path(__file__).resolve().parents[1]
        handle, name = tempfile.mkstemp(prefix="turnstile-", suffix=".zip")  # read by the driver's own file server only
        os.close(handle)
        with zipfile.ZipFile(name, "w") as archive:
            for source in sorted(package.rglob("*.py")):
                archive.write(source, str(source.relative_to(package.parent)))
        context.addPyFile(name)
        context._turnstile_shipped = True
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: str = "doc_id") -> str:
    """SQL text: true for the rows whose labels are kept away from every fit."""
    return f"coalesce(pmod(crc32(cast(cast({doc_id} as string) as binary)), 5) = 0, false)"


def labelled_sample(labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most `limit` rows (doc_id, label) of the labels that may be learned from, the same rows every time.

    Half of the bound goes to each class. They are the first in the order of a hash of doc_id. Rows without an id or a label, and ids
    that carry both labels, are left out. The result is bounded by `limit`, whatever the size of the table.
    """
    usable = (labels.where(f"doc_id is not null and {label} in (0, 1) and not {held_out()}")
              .groupBy("doc_id").agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo = hi")
              .selectExpr("doc_id", "cast(lo as int) as label"))
    first = [usable.where(f"label = {k}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit // 2) for k in (0, 1)]
    return first[0].unionAll(first[1])


def with_text(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(text, label) of the sampled documents, one row an id. The sample is bounded, so it is the side to broadcast.

    Of several texts of one id the smallest is taken, found a task at a time, so the result has no more rows than the sample.
    """
    return (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
            .select("text", "label"))


def strings(column: pa.Array) -> pa.StringArray:
    """One array with 32-bit offsets and no nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.string()).fill_null("")


# --- groups --------------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the links (a, b) reaches.

    Links are rewritten until every node points at the smallest one of its component, alternating two steps: larger neighbours of a
    node are linked to its smallest neighbour, then smaller ones are. The number of links never grows, a node's neighbours meet only
    in a partial minimum, and a step is a join that Spark may split where one node has very many links. Each round is written to the
    shared folder. A table of links without rows gives no rows.
    """
    spark = edges.sparkSession
    links = materialise(
        edges.selectExpr("cast(greatest(a, b) as long) as u", "cast(least(a, b) as long) as v").where("u > v").distinct(), "links")
    state = _state(links)
    while state[0]:
        both = links.unionAll(links.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = both.where("v > u").join(least, "u").selectExpr("v as u", "m as v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(smallest, "u").where("v <> m").selectExpr("v as u", "m as v")
                 .unionAll(smallest.selectExpr("u", "m as v")).distinct())
        links, before = materialise(small, "links"), state
        state = _state(links)
        if state == before:
            break
    ends = links.selectExpr("u as node", "v as component")
    return ends.unionAll(links.selectExpr("v as node", "v as component").distinct()) if state[0] else spark.createDataFrame(
        [], "node long, component long")


def _state(links: DataFrame) -> tuple:
    """A number of rows and a sum of hashes: equal for equal sets of links."""
    return tuple(links.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def forest(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix: the smallest index that each index reaches."""
    label = np.arange(len(linked), dtype=np.int32)
    reach = linked | np.eye(len(linked), dtype=bool)
    while True:
        least = np.where(reach, label[None, :], np.int32(len(linked))).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


# --- words ---------------------------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be inverted
_SEGMENT = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all others (wrap-around is meant)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words `[^\\x20\\x09-\\x0D]+` of the texts, A-Z lower-cased, and the bounds of each text's words.

    Words of text i are hashes[bounds[i]:bounds[i + 1]]. The hash of a word is a polynomial over its bytes, taken from running sums, so
    that a batch is hashed by a few array operations. It works in segments of about a megabyte that end between words.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]]
    edges = offsets - offsets[0]
    solid = ~_SPACE[data]
    ends_at = np.zeros(len(data), bool)  # the last byte of a word: a space or another text follows
    ends_at[:-1] = ~solid[1:]
    ends_at[edges[1:][edges[1:] > 0] - 1] = True
    ends_at &= solid
    ends = np.flatnonzero(ends_at) + 1
    starts_at = np.zeros(len(data), bool)
    starts_at[1:] = ~solid[:-1]
    starts_at[edges[:-1][edges[:-1] < len(data)]] = True
    starts = np.flatnonzero(starts_at & solid)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _SEGMENT, side="right")))
        part = data[base:ends[to - 1]]
        size = _SEGMENT if len(part) <= _SEGMENT else 1 << int(len(part)).bit_length()
        power, inverse = _powers(size)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * power[:len(part)], out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = to
    return out, np.searchsorted(starts, edges).astype(np.int64)


def shingle_sets(texts: pa.StringArray, size: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles of `size` words, as signed 64-bit hashes.

    A text with fewer words has one shingle, all of its words; one without words has none. Two different shingles of a corpus get the
    same hash with a chance of 2^-64 a pair.
    """
    words, bounds = word_hashes(texts)
    with np.errstate(over="ignore"):
        rolled = words[:max(0, len(words) - size + 1)].copy()
        for j in range(1, size):
            rolled = mix(rolled * np.uint64(_BASE) + words[j:j + len(rolled)])
        for i in range(len(texts)):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= size:
                yield np.unique(rolled[a:b - size + 1].view(np.int64))
            elif b > a:
                short = words[a:a + 1].copy()
                for j in range(a + 1, b):
                    short = mix(short * np.uint64(_BASE) + words[j:j + 1])
                yield mix(short + np.uint64(b - a)).view(np.int64)
            else:
                yield np.zeros(0, np.int64)


def fingerprint(data: bytes) -> tuple[int, int]:
    """128 bits as two signed numbers."""
    return tuple(np.frombuffer(hashlib.blake2b(data, digest_size=16).digest(), np.int64).tolist())


def list_column(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else [], kind))
