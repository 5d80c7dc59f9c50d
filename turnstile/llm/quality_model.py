"""A quality classifier: histogram gradient-boosted trees over statistics of a document's text.

Training. Features of a bounded sample of labelled documents (at most SAMPLE rows, the same ones every time, see `labelled_sample`) are cut
into at most BINS quantile bins. Each tree grows level by level: sums of gradients and Hessians by node, feature and bin give the best
split of every node. Trees are fitted to the gradients of the logistic loss.

Scoring. The trees are flattened into arrays (feature, threshold, left, right, value), and a batch of documents walks down all trees at
once, one level a step. Every document is scored from its whole text by the same arrays.

Nulls: a null text has the features of an empty one and gets a score too. Rows that repeat a doc_id are scored as rows. Without usable
labels every score is 0.5; with one class only, near that class. Other columns are not read: language, source and ids are no features.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import labelled_sample, prepare, strings, with_text

SAMPLE = 20_000  # labelled documents that are learned from, at most
BINS, TREES, DEPTH, RATE, RIDGE, LEAST = 64, 80, 4, 0.15, 1.0, 8
THRESHOLD = 0.3
_SYMBOLS = b"#*$%&|<>{}[]~^_=+\\@/`"
_STOPS = b".!?,;:"
_DIGITS = b"0123456789"
_UPPER = bytes(range(65, 91))
FEATURES = ("words", "characters", "word_length", "distinct_words", "repeated_next", "symbols", "bars", "stops", "exclamations", "digits",
            "upper", "capital_words", "short_words", "long_words", "lines", "line_words", "distinct_lines", "words_in_lines_once", "not_ascii",
            "ended_lines")


def features(text: str) -> list[float]:
    """The numbers named in FEATURES."""
    data, words = text.encode(), text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, size, many = max(1, len(words)), max(1, len(data)), max(1, len(lines))
    lengths = [len(w) for w in words]
    distinct = set(lines)

    def share(chars: bytes) -> float:
        return (size - len(data.translate(None, chars))) / size if data else 0.0

    return [
        np.log1p(len(words)), np.log1p(len(text)), sum(lengths) / n, len(set(words)) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, share(_SYMBOLS), data.count(b"|") / n, share(_STOPS),
        data.count(b"!") / n, share(_DIGITS), share(_UPPER), sum(w[0].isupper() for w in words) / n,
        sum(k <= 3 for k in lengths) / n, sum(k > 12 for k in lengths) / n, np.log1p(len(lines)), n / many, len(distinct) / many,
        sum(map(len, distinct)) / max(1, sum(map(len, lines))), 1 - len(data.translate(None, bytes(range(128, 256)))) / size if data else 0.0,
        sum(x.rstrip()[-1:] in ".!?" for x in lines) / many]


@dataclass
class Trees:
    """All trees in arrays of one row a tree; a leaf points at itself."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of features."""
        total = np.full(len(x), self.base)
        if len(self.feature):
            tree, row = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
            node = np.zeros((len(x), len(self.feature)), np.int32)
            for _ in range(DEPTH):
                lower = x[row, self.feature[tree, node]] <= self.threshold[tree, node]
                node = np.where(lower, self.left[tree, node], self.right[tree, node])
            total += self.value[tree, node].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for features x and labels y, 0 or 1."""
    nodes = 2 ** (DEPTH + 1) - 1
    mean = (y.sum() + 0.5) / (len(y) + 1)
    base, empty = float(np.log(mean / (1 - mean))), np.zeros((0, nodes))
    if not 0 < y.sum() < len(y):
        return Trees(base, empty.astype(int), empty, empty.astype(int), empty.astype(int), empty)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    total, made = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        made.append(_tree(binned, cuts, p - y, p * (1 - p), nodes))
        feature, threshold, left, right, value, where = made[-1]
        total += value[where]
    return Trees(base, *(np.stack([m[k] for m in made]) for k in range(5)))


def _tree(binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, nodes: int):
    """One tree in arrays, and the leaf of each row. Node k has the children 2k + 1 and 2k + 2."""
    feature, threshold = np.zeros(nodes, np.int32), np.zeros(nodes)
    left = right = np.arange(nodes, dtype=np.int32)
    left, right, value = left.copy(), right.copy(), np.zeros(nodes)
    where = np.zeros(len(g), np.int64)
    for level in range(DEPTH):
        first, width = 2**level - 1, 2**level
        best, chosen = np.zeros(width), np.full((width, 2), -1)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            slots = len(c) + 1
            at = (where - first) * slots + binned[:, f]
            active = where >= first
            gs, hs, ns = (np.bincount(at[active], None if v is None else v[active], width * slots).reshape(width, slots).cumsum(axis=1)
                          for v in (g, h, None))
            low_g, low_h, low_n = gs[:, :-1], hs[:, :-1], ns[:, :-1]
            all_g, all_h, all_n = gs[:, -1:], hs[:, -1:], ns[:, -1:]
            gain = low_g**2 / (low_h + RIDGE) + (all_g - low_g) ** 2 / (all_h - low_h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(low_n < LEAST) | (all_n - low_n < LEAST)] = 0
            top = gain.argmax(axis=1)
            better = gain[np.arange(width), top] > best + 1e-9
            best[better], chosen[better] = gain[np.arange(width), top][better], np.stack([np.full(width, f), top], axis=1)[better]
        for k in np.flatnonzero(chosen[:, 0] >= 0):
            node, (f, cut) = first + k, chosen[k]
            feature[node], threshold[node], left[node], right[node] = f, cuts[f][cut], 2 * node + 1, 2 * node + 2
            rows = where == node
            where[rows] = np.where(binned[rows, f] <= cut, 2 * node + 1, 2 * node + 2)
    sums_g, sums_h = np.bincount(where, g, nodes), np.bincount(where, h, nodes)
    value = np.where(left == np.arange(nodes), -RATE * sums_g / (sums_h + RIDGE), 0.0)
    return feature, threshold, left, right, value, where


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees fitted to at most `sample` labelled documents that are not held out."""
    prepare(docs.sparkSession)
    rows = with_text(docs, labelled_sample(labels, "quality", sample)).mapInArrow(_described, "label int, x array<double>")
    found = sorted((r.label, tuple(r.x)) for r in rows.collect())  # bounded by `sample`; sorted, as rows come in any order
    if not found:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.array([x for _, x in found]), np.array([y for y, _ in found], float))


def _described(batches):
    for batch in batches:
        made = [features(t) for t in strings(batch.column("text")).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.int32()), pa.array(made, pa.list_(pa.float64()))], ["label", "x"])


def _scores(trees: Trees, batch: pa.RecordBatch) -> np.ndarray:
    texts = strings(batch.column("text")).to_pylist()
    return trees.score(np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES)))


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            p = _scores(trees, batch)
            held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 0 for d in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(held, pa.bool_()), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, trees: Trees) -> DataFrame:
    """The rows of `docs` that are predicted to be good, with their columns."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(trees, batch) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
