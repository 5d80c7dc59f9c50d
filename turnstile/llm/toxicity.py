"""Toxicity: a lexicon learned from labels, met with Levenshtein automata, and scores that tell quotation from abuse.

* Lexicon. Of at most SAMPLE labelled documents, words are counted by the toxic and the clean documents they stand in, where
  documents of the same words in the same order, copies, count once, also among all documents of their label. Terms are words, or beginnings shared by several words, that are
  frequent in the first and rare in the second, with odds no chance gives in so many documents. A beginning matches every word that starts with it.
* Matching. The terms make a trie. The automaton that accepts words within one edit (insertion, deletion, substitution) of a term is
  intersected with it: a state is a set of (trie node, edits so far). The sets reachable are few, so they become the rows of a transition
  table, and a batch of words runs through it at once, a letter a step. Terms under FUZZY_LETTERS letters, and terms whose misspellings
  stand in clean documents, match exactly only.
* Context. A match with quotation marks within WINDOW characters on both sides counts QUOTED of a match, a misspelt one FUZZY.
* Score. A logistic model of the summed matches, and of their share among the words, fitted to the sample and corrected for
  the share of toxic labels among all.

Every document is scored from its whole text. The model is bounded by MAX_TERMS terms, whatever the corpus.

Nulls: a null text scores like an empty one, from no matches. Rows that repeat a doc_id are scored as rows. Without labels of both classes
every score is 0. Other columns are not read: language, source and ids are no features.
"""

from __future__ import annotations

import sys
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import fingerprint, held_out, labelled_sample, prepare, strings, with_text
from turnstile.session import materialise

SAMPLE = 8_000  # labelled documents that are learned from, at most
MAX_TERMS = 4_096
MIN_TOXIC, MIN_ODDS, STEM, KINDS = 4, 3.0, 4, 3  # a term stands in so many toxic documents
MIN_G2 = 24.0  # log-likelihood ratio of a term against the share of toxic documents, about one chance in a million
FUZZY_LETTERS = 5
CLEAN_FUZZY = 0.001  # share of clean documents that may hold a misspelling of a term
WINDOW, QUOTED, FUZZY = 40, 0.25, 0.7
THRESHOLD = 0.5
_QUOTES = "\"“”„«»‹›‟"
_SLICE = 4_000_000  # characters that run through the automaton at once


# --- lexicon -------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _word_table() -> np.ndarray:
    """By code point: whether it is part of a word."""
    return np.array([chr(i).isalnum() or chr(i) == "@" for i in range(sys.maxunicode + 1)])


def _words(text: str) -> list[str]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts, ends = _runs(_word_table()[codes])
    return [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    turns = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return turns[::2], turns[1::2]


def _bearers(batches):
    """(word, copies, label): each word of a document once, and an empty one for the document itself. Copies share the digest of all words."""
    for batch in batches:
        out = []
        for text, label in zip(strings(batch.column("text")).to_pylist(), batch.column("label").to_pylist(), strict=True):
            words = _words(text.lower())
            copies = fingerprint(" ".join(words).encode("utf-8", "surrogatepass"))[0]
            out += [(w, copies, label) for w in {"", *words}]
        columns = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32()), strict=True)],
                                         ["word", "copies", "label"])


def terms(sample: DataFrame) -> list[tuple[str, bool]]:
    """The lexicon: (text, whole word) of at most MAX_TERMS terms."""
    counted = materialise(
        sample.mapInArrow(_bearers, "word string, copies long, label int").distinct()
        .groupBy("word").agg(F.expr("count_if(label = 1)").alias("toxic"), F.expr("count_if(label = 0)").alias("clean")), "words")
    toxic, clean = counted.where("word = ''").select("toxic", "clean").first()  # documents, copies as one
    words = counted.where("word <> ''")
    ends = (f"transform(sequence(least({STEM}, length(word)), length(word)), k -> struct(substr(word, 1, k) as text, false as whole))")
    nodes = (words.withColumn("node", F.expr(f"explode(concat({ends}, array(struct(word as text, true as whole))))"))
             .groupBy("node").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.expr("count_if(toxic > 0)").alias("kinds"),
                                  F.expr("min(word) filter (where toxic > 0)").alias("low"), F.expr("max(word) filter (where toxic > 0)").alias("high")))
    odds = f"ln((toxic + 0.5) / {toxic + 1}) - ln((clean + 0.5) / {clean + 1})"
    share = toxic / max(1, toxic + clean)
    g2 = (f"2 * (toxic * ln(toxic / ((toxic + clean) * {share})) "
          f"+ case when clean > 0 then clean * ln(clean / ((toxic + clean) * {1 - share})) else 0 end)")
    good = (nodes.where(f"toxic >= {MIN_TOXIC} and {odds} >= {MIN_ODDS} and {g2} >= {MIN_G2} and length(node.text) >= least({STEM}, length(low)) "
                        f"and (node.whole or (kinds >= {KINDS} and length(node.text) >= {STEM}))")
            .orderBy(F.desc("toxic"), "node").limit(MAX_TERMS).select("node.text", "node.whole", "low", "high").collect())
    chosen: list[tuple[str, bool]] = []
    stems: set[str] = set()
    for row in sorted(good, key=lambda r: (r.whole, len(r.text), r.text)):
        if any(row.text[:k] in stems for k in range(1, len(row.text) + 1)):
            continue
        if row.whole:
            chosen.append((row.text, True))
        else:
            shared = len(row.text)
            while shared < min(len(row.low), len(row.high)) and row.low[shared] == row.high[shared]:
                shared += 1
            stems.add(row.text)
            chosen.append((row.low[:shared], False))
    return chosen


# --- automaton -----------------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _classes(letters: bytes) -> np.ndarray:
    """By code point: the class of a letter. Made in each worker, so that it does not travel with the model."""
    known = np.frombuffer(letters, np.uint32)
    table = np.zeros(sys.maxunicode + 1, np.int32)
    table[known] = np.arange(1, len(known) + 1)
    return table


@dataclass
class Automaton:
    """States of the trie intersected with Levenshtein automata. State 0 is dead, state 1 the start."""

    letters: np.ndarray  # code points of the terms, ascending; a letter's class is its place from 1, and 0 if no term has it
    step: np.ndarray  # by state and class: the next state
    term: np.ndarray  # by state: the term accepted if the word ends here, or -1
    edits: np.ndarray  # by state: its edits
    final: np.ndarray  # by state: a beginning is matched exactly, the rest of the word does not matter

    def run(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The state in which each word ends."""
        classes = _classes(self.letters.tobytes())
        state = np.ones(len(starts), np.int32)
        alive, at = np.arange(len(starts)), 0
        while len(alive):
            letters = classes[codes[starts[alive] + at]]
            reached = self.step[state[alive], letters]
            state[alive] = reached
            at += 1
            alive = alive[(reached != 0) & ~self.final[reached] & (starts[alive] + at < ends[alive])]
        return state


def automaton(lexicon: list[tuple[str, bool]], exact_only: frozenset[int] = frozenset()) -> Automaton:
    """The table for the terms. Those numbered in `exact_only`, and short ones, are accepted without edits only."""
    children: list[dict[str, int]] = [{}]
    whole: dict[int, int] = {}
    begun: dict[int, int] = {}
    for number, (text, is_whole) in enumerate(lexicon):
        node = 0
        for letter in text:
            if letter not in children[node]:
                children[node][letter] = len(children)
                children.append({})
            node = children[node][letter]
        (whole if is_whole else begun).setdefault(node, number)
    letters = sorted({c for text, _ in lexicon for c in text})

    def accepts(number: int, edits: int) -> bool:
        return not edits or (number not in exact_only and len(lexicon[number][0]) >= FUZZY_LETTERS)

    def made(nodes: set[tuple[int, int]], met: tuple[int, int] | None):
        """A state: nodes with their edits, skipped letters included, and the best beginning met so far as (edits, term)."""
        nodes = nodes | {(child, 1) for node, edits in nodes if not edits for child in children[node].values()}
        nodes = {(node, edits) for node, edits in nodes if not edits or (node, 0) not in nodes}
        for node, edits in sorted(nodes):
            if node in begun and accepts(begun[node], edits) and (met is None or (edits, begun[node]) < met):
                met = (edits, begun[node])
        return (frozenset(), met) if met and not met[0] else (frozenset(nodes), met)

    def after(nodes: frozenset, letter: str | None) -> set[tuple[int, int]]:
        out = set()
        for node, edits in nodes:
            if letter in children[node]:
                out.add((children[node][letter], edits))
            if not edits:
                out.add((node, 1))
                out |= {(child, 1) for child in children[node].values()}
        return out

    dead, start = (frozenset(), None), made({(0, 0)}, None)
    number, queue, step = {dead: 0, start: 1}, [start], {0: [0] * (len(letters) + 1)}
    while queue:
        state = queue.pop()
        nodes, met = state
        row = []
        for letter in [None, *letters]:
            following = made(after(nodes, letter), met) if nodes else state
            if following not in number:
                number[following] = len(number)
                queue.append(following)
            row.append(number[following])
        step[number[state]] = row
    term, edits, final = np.full(len(number), -1, np.int32), np.zeros(len(number), np.int32), np.zeros(len(number), bool)
    for (nodes, met), i in number.items():
        best = min([(e, whole[n]) for n, e in nodes if n in whole and accepts(whole[n], e)] + ([met] if met else []), default=None)
        if best:
            edits[i], term[i] = best
        final[i] = bool(met) and not nodes
    return Automaton(np.array([ord(c) for c in letters], np.uint32), np.array([step[i] for i in range(len(number))], np.int32), term, edits, final)


def matches(machine: Automaton, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (text, term, edits, quoted) of every match, and the number of words of each text."""
    found, words, first = [], np.zeros(len(texts), np.int64), 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= _SLICE):
            size += len(texts[last]) + 1
            last += 1
        lowered = [t.lower() for t in texts[first:last]]
        edges = np.cumsum([len(t) + 1 for t in lowered])
        codes = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, ends = _runs(_word_table()[codes])
        owner = np.searchsorted(edges, starts, side="right")
        words[first:last] = np.bincount(owner, minlength=last - first)
        state = machine.run(codes, starts, ends)
        hit = np.flatnonzero(machine.term[state] >= 0)
        marks = np.flatnonzero(np.isin(codes, [ord(q) for q in _QUOTES]))
        if len(marks):
            places = np.concatenate([[-1_000_000], marks, [len(codes) + 1_000_000]])
            before = places[np.searchsorted(places, starts[hit], side="left") - 1]
            behind = places[np.searchsorted(places, ends[hit], side="left")]
            text_from = np.concatenate([[0], edges])[owner[hit]]
            quoted = (starts[hit] - before <= WINDOW) & (before >= text_from) & (behind - ends[hit] < WINDOW) & (behind < edges[owner[hit]])
        else:
            quoted = np.zeros(len(hit), bool)
        found.append(np.stack([owner[hit] + first, machine.term[state[hit]], machine.edits[state[hit]], quoted.astype(np.int64)], axis=1))
        first = last
    return (np.concatenate(found) if found else np.zeros((0, 4), np.int64)).astype(np.int64), words


# --- model ---------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    machine: Automaton | None = None
    weights: np.ndarray = field(default_factory=lambda: np.zeros(5))
    lexicon: list[tuple[str, bool]] = field(default_factory=list)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.machine is None:
            return np.zeros(len(texts))
        found, words = matches(self.machine, texts)
        strength = np.bincount(found[:, 0], strengths(found), len(texts))
        return 1 / (1 + np.exp(-np.clip(described(strength, words) @ self.weights, -30, 30)))


def strengths(found: np.ndarray) -> np.ndarray:
    return np.where(found[:, 2] > 0, FUZZY, 1.0) * np.where(found[:, 3] > 0, QUOTED, 1.0)


def described(strength: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Features of the logistic model."""
    return np.stack([np.ones(len(strength)), np.minimum(strength, 1), np.clip(strength - 1, 0, 1), np.clip(strength - 2, 0, 2),
                     np.log1p(100 * strength / np.maximum(words, 1))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a logistic model by Newton's method; the first column of x is constant and not shrunk."""
    weights = np.zeros(x.shape[1])
    shrink = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink + 1e-9 * np.eye(len(weights)), x.T @ (y - p) - shrink @ weights)
        weights = weights + np.clip(change, -5, 5)
        if np.abs(change).max() < 1e-6:
            break
    return weights


def _found(machine: Automaton):
    def run(batches):
        for batch in batches:
            found, words = matches(machine, strings(batch.column("text")).to_pylist())
            rows = [found[found[:, 0] == i, 1:] for i in range(batch.num_rows)]
            counted = [np.unique(r, axis=0, return_counts=True) if len(r) else (r, np.zeros(0, np.int64)) for r in rows]
            flat = [np.concatenate([u, n[:, None]], axis=1).ravel().tolist() for u, n in counted]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").cast(pa.int32()), pa.array(words), pa.array(flat, pa.list_(pa.int64()))], ["label", "words", "found"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Lexicon, automaton and weights from at most `sample` labelled documents that are not held out."""
    prepare(docs.sparkSession)
    shares = {r.toxic: r.n for r in labels.where(f"doc_id is not null and toxic in (0, 1) and not {held_out()}")
              .groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = with_text(docs, labelled_sample(labels, "toxic", sample))
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model()
    lexicon = terms(rows)
    machine = automaton(lexicon)
    seen = [(r.label, r.words, np.array(r.found, np.int64).reshape(-1, 4))
            for r in rows.mapInArrow(_found(machine), "label int, words long, found array<long>").collect()]  # bounded by `sample`
    clean_fuzzy = np.zeros(len(lexicon))
    for label, _, found in seen:
        if not label:
            clean_fuzzy[np.unique(found[found[:, 1] > 0, 0])] += 1
    exact_only = frozenset(np.flatnonzero(clean_fuzzy > CLEAN_FUZZY * sizes[0]).tolist())
    strength = np.array([(strengths(np.insert(f[:, :3], 0, 0, axis=1)) * f[:, 3])[~((f[:, 1] > 0) & np.isin(f[:, 0], list(exact_only)))].sum()
                         for _, _, f in seen])
    y = np.array([label for label, _, _ in seen], float)
    weights = logistic(described(strength, np.array([n for _, n, _ in seen])), y)
    weights[0] += np.log(shares.get(1, 1) / max(1, shares.get(0, 1))) - np.log(sizes[1] / sizes[0])
    return Model(automaton(lexicon, exact_only), weights, lexicon)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            p = model.score(strings(batch.column("text")).to_pylist())
            held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 0 for d in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(held, pa.bool_()), pa.array(p, pa.float64()),
                 pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
