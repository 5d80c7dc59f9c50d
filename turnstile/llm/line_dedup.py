"""Removing passages that repeat across documents: shared rare line hashes, then patience diff of document pairs.

1. Every document becomes the hashes of its lines that are not blank (white space at both ends is left out of account). A line key is the
   hash of a line together with as many lines behind it as it takes to hold MIN_WORDS words: lines like that are rare, since so many words
   do not recur by chance, while a short line ("All rights reserved.") may stand in a third of all documents without tying them together.
2. Each document that holds a key meets the first document that holds it, in the order of (doc_id, hash of the text). So a passage that a third of all
   documents share makes one pair a document, not all pairs. Only hashes of lines travel, not texts.
3. The two are aligned by patience diff: lines that occur once in both, in the longest common order, are anchors, and the stretches
   between anchors are aligned the same way. A passage that stands in another order is looked up in what the alignment leaves over.
4. Common blocks of consecutive lines with MIN_WORDS words or more are deleted from the later document. A line goes only if an earlier
   document holds it, so the first copy of every line stays.

Nulls: a null text stays null, an empty one empty. Rows without a doc_id are not compared and stay as they are. Rows that repeat a
doc_id with another text are documents of their own, which come in the order of a hash of their texts; those with an equal text are
copies of one document, are not compared with each other and lose the same lines. Lines are parted by "\\n" only. Other columns are
kept by `remove_repeats` and not read. No document or line is skipped for its length.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import list_column, prepare, strings
from turnstile.session import materialise

MIN_WORDS = 20
_LINES = "place decimal(38,0), lines array<long>, words array<int>, numbers array<int>, keys array<long>"
_CUTS = "place decimal(38,0), first int, last int"
#: The order of documents as one number: doc_id, then 62 bits of a hash of the text.
_PLACE = "cast(cast(cast(doc_id as long) as decimal(38,0)) * 4611686018427387904 + (xxhash64(text) & 4611686018427387903) as decimal(38,0))"


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _read_lines(min_words: int):
    def run(batches):
        for batch in batches:
            out = [describe(text, min_words) for text in strings(batch.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("place"),
                 *(list_column([np.array(o[c], t) for o in out], pa.from_numpy_dtype(t))
                   for c, t in enumerate((np.int64, np.int32, np.int32, np.int64)))],
                ["place", "lines", "words", "numbers", "keys"])

    return run


def describe(text: str, min_words: int = MIN_WORDS) -> tuple[list[int], list[int], list[int], list[int]]:
    """Hash, words and number of each line that is not blank, and the document's line keys."""
    numbers, stripped = [], []
    for number, line in enumerate(text.split("\n")):
        line = line.strip()
        if line:
            numbers.append(number)
            stripped.append(line)
    words = [len(line.split()) for line in stripped]
    lines = [_signed(xxhash.xxh3_64_intdigest(line)) for line in stripped]
    keys, end, held = [], 0, 0
    for start in range(len(lines)):
        while end < len(lines) and held < min_words:
            held += words[end]
            end += 1
        if held < min_words:
            break
        keys.append(_signed(xxhash.xxh3_64_intdigest("\n".join(stripped[start:end]), seed=1)))
        held -= words[start]
    return lines, words, numbers, keys


def _rising(values: Sequence[int]) -> list[int]:
    """Places of a longest rising run of values, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for i, value in enumerate(values):
        at = bisect_left(tops, value)
        before.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(value)
            piles.append(i)
        else:
            tops[at], piles[at] = value, i
    out, at = [], piles[-1] if piles else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def patience(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Pairs of places (i, j) with a[i] == b[j], rising in both: the lines that patience diff aligns."""
    out: list[tuple[int, int]] = []
    open_ends = [(0, len(a), 0, len(b))]
    while open_ends:
        i, i_end, j, j_end = open_ends.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        left, right = a[i:i_end], b[j:j_end]
        anchors = _anchors(left, right, Counter(left), Counter(right))
        if not anchors:  # no line occurs once in both: the n-th occurrences of a line count as the same line
            left, right = _numbered(left), _numbered(right)
            anchors = _anchors(left, right, Counter(left), Counter(right))
        at = (i, j)
        for x, y in anchors:
            out.append((i + x, j + y))
            open_ends.append((at[0], i + x, at[1], j + y))
            at = (i + x + 1, j + y + 1)
        if anchors:
            open_ends.append((at[0], i_end, at[1], j_end))
    return sorted(out)


def _anchors(left: Sequence, right: Sequence, in_left: Counter, in_right: Counter) -> list[tuple[int, int]]:
    place = {x: i for i, x in enumerate(left) if in_left[x] == 1}
    both = [(place[y], j) for j, y in enumerate(right) if in_right[y] == 1 and y in place]
    return [both[k] for k in _rising([i for i, _ in both])]


def _numbered(lines: Sequence) -> list[tuple]:
    seen: Counter = Counter()
    out = []
    for line in lines:
        out.append((line, seen[line]))
        seen[line] += 1
    return out


def common_blocks(a: Sequence, b: Sequence, words: Sequence[int], min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Blocks (first, last) of lines of `b` that are aligned with consecutive lines of `a` and hold `min_words` words or more.

    Patience diff keeps the order of both, so a passage that moved is left over; such passages are then looked up by their line keys.
    """
    blocks: list[list[int]] = []
    for i, j in patience(a, b):
        if blocks and blocks[-1][1:] == [j - 1, i - 1]:
            blocks[-1][1:] = [j, i]
        else:
            blocks.append([j, j, i])
    found = [(first, last) for first, last, _ in blocks if sum(words[first:last + 1]) >= min_words]
    taken = {j for first, last in found for j in range(first, last + 1)}
    known = dict(zip(b, words, strict=True))
    places: dict[tuple, int] = {}
    for i, key in _windows(a, [known.get(line) for line in a], min_words):
        places.setdefault(key, i)
    free = [None if j in taken else n for j, n in enumerate(words)]
    done = 0
    for j, key in _windows(b, free, min_words):
        i = places.get(key)
        if j >= done and i is not None:
            done = j
            while done < len(b) and i < len(a) and free[done] is not None and a[i] == b[done]:
                i, done = i + 1, done + 1
            found.append((j, done - 1))
    return sorted(found)


def _windows(lines: Sequence, words: Sequence[int | None], min_words: int):
    """(place, lines) of the shortest stretch from each place that holds the words; a stretch has no line with words None."""
    end, held = 0, 0
    for start in range(len(lines)):
        if end <= start:
            end, held = start, 0
        while end < len(lines) and held < min_words and words[end] is not None:
            held += words[end]
            end += 1
        if held >= min_words:
            yield start, tuple(lines[start:end])
        if end > start:
            held -= words[start]


def _align(min_words: int):
    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for first, last in common_blocks(row["earlier_lines"], row["lines"], row["words"], min_words):
                    out.append((row["place"], row["numbers"][first], row["numbers"][last]))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.decimal128(38, 0), pa.int32(), pa.int32()), strict=True)],
                                             ["place", "first", "last"])

    return run


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(place, cuts): the stretches of lines, by first and last number from 0, that repeat an earlier document. Others have no row.

    `place` is the document's place in their order: its doc_id and a hash of its text in one number (_PLACE).
    """
    prepare(docs.sparkSession)
    lines = materialise(docs.where("doc_id is not null").selectExpr(f"{_PLACE} as place", "text")
                        .mapInArrow(_read_lines(min_words), _LINES), "lines")
    keys = lines.selectExpr("place", "explode(keys) as key")
    holders = keys.groupBy("key").agg(F.min("place").alias("earlier"), F.max("place").alias("latest")).where("earlier < latest")
    pairs = materialise(keys.join(holders, "key").where("place > earlier").select("place", "earlier").distinct(), "pairs")
    once = materialise(lines.drop("keys").dropDuplicates(["place"]), "once")  # written, so that Spark can split a hot document's join
    met = (pairs.join(once.selectExpr("place as earlier", "lines as earlier_lines"), "earlier")
           .join(once, "place").select("place", "earlier_lines", "lines", "words", "numbers"))
    cuts = materialise(met.mapInArrow(_align(min_words), _CUTS), "cuts")
    return cuts.groupBy("place").agg(F.collect_set(F.struct("first", "last")).alias("cuts"))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, drop_emptied: bool = False) -> DataFrame:
    """The rows of `docs` with repeated passages deleted from `text`. `drop_emptied`: leave out documents of which no word is left."""
    cut = _with_cuts(docs, min_words)
    text = F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(F.expr(_LEFT))
    out = cut.withColumn("text", text)
    if drop_emptied:
        out = out.where("_cuts is null or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return out.select(docs.columns)


#: The lines of a text outside its cuts.
_LEFT = ("array_join(filter(split(text, '\\n'), (line, n) -> not exists(_cuts, c -> n >= c.first and n <= c.last)), '\\n')")


def _with_cuts(docs: DataFrame, min_words: int) -> DataFrame:
    found = repeats(docs, min_words).selectExpr("place as _place", "cuts as _cuts")
    return docs.withColumn("_place", F.expr(_PLACE)).join(found.hint("merge"), "_place", "left")


def removed(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text, n_lines, n_removed, cuts) for every row: the text that is left, and what was deleted."""
    cut = _with_cuts(docs.select("doc_id", "text"), min_words)
    left = F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(F.expr(_LEFT))
    return (cut.withColumn("cuts", F.expr("array_sort(coalesce(_cuts, array()))"))
            .withColumn("n_lines", F.expr("coalesce(size(split(text, '\\n', -1)), 0)"))
            .withColumn("n_removed", F.expr("size(filter(sequence(0, n_lines), n -> n < n_lines and exists(cuts, c -> n >= c.first and n <= c.last)))"))
            .select("doc_id", left.alias("text"), "n_lines", "n_removed", "cuts"))
