"""Near-duplicates of texts: bottom-k sketches of one hash function, inverted lists, exact Jaccard.

Every document becomes the set of its word shingles, and its sketch is the k smallest hashes of that set.

1. Documents with equal sets form a class, which gets a number; from here on only one document of it, that with the smallest doc_id,
   takes part.
2. Inverted lists. Two sets with a similarity of 0.8 or more share at least `least_overlap` values of their sketches. So, with the
   values of all sketches put in one order, rarest first, each sketch needs to be listed only under its first
   (size - least_overlap + 1) values: two such sketches meet in a list. Values that one document holds alone come first and make no
   list, so most documents are listed nowhere. For sets smaller than the sketch the overlap is exact, else it fails for fewer than one
   pair in a million of those at exactly 0.8.
3. A list of at most LIST members gives its pairs. The k smallest values of the union of two sketches estimate the similarity; pairs
   that are clearly below the limit go. The rest are confirmed on the full sets, made again from the texts of those documents only.
4. A longer list (a large group of near copies, a very common passage) is dealt in blocks of bounded size, and each pair of blocks is a
   task of its own that compares full sets by one matrix product over the shingles that two documents share. It returns a link or two
   a document, which connect what is linked in the blocks, not all pairs. Nothing is capped or skipped.
5. Links become components (`common.components`).

Nulls: a text that is null, empty or has no words has no shingles and links with nothing. Rows without a doc_id take no part either, and
get a null component. Rows that repeat a doc_id with other texts are documents of their own
(classes are told apart by fingerprints of their sets, never by an id) and share the id in the result. Other columns are neither read nor returned.

Joins with texts, sketches or sets on one side are merge joins at every size, as the other side grows with the corpus too.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import components, fingerprint, forest, list_column, prepare, shingle_sets, strings
from turnstile.session import materialise

K = 64
LIST = 64  # members of a list whose pairs are written out
BLOCK_DOCS, BLOCK_VALUES = 1500, 1_000_000  # of one side of a block comparison
CHUNK = 4096  # columns of a matrix product
_ROW = "doc_id long, mark long, n_shingles long, fp_a long, fp_b long, sketch array<long>"
_MARK = "xxhash64(text)"  # tells the texts of one doc_id apart


def least_overlap(k: int, similarity: float, miss: float = 1e-6) -> int:
    """Fewest of k values that two sets of that similarity share, but for a chance of `miss`."""
    tail = 0.0
    for c in range(k + 1):
        tail += comb(k, c) * similarity**c * (1 - similarity) ** (k - c)
        if tail > miss:
            return max(1, c)
    return k


def _sketches(words: int, k: int):
    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(strings(batch.column("text")), words))
            marks = [fingerprint(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("mark"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()),
                 list_column([s[:k] for s in sets], pa.int64())], ["doc_id", "mark", "n_shingles", "fp_a", "fp_b", "sketch"])

    return run


def _full_sets(words: int):
    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(strings(batch.column("text")), words))
            marks = [fingerprint(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()),
                 list_column(sets, pa.int64())], ["doc_id", "fp_a", "fp_b", "full"])

    return run


def _block_links(percent: int):
    """Links inside a block, or between two, as a forest: (a, b) for every document that is linked, b being the first it reaches."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable").reset_index(drop=True)
        sizes = np.array([len(x) for x in pdf.full])
        values, at, held = np.unique(np.concatenate(pdf.full.to_numpy()), return_inverse=True, return_counts=True)
        shared = held > 1
        column = np.cumsum(shared) - 1
        row = np.repeat(np.arange(len(pdf)), sizes)
        keep = shared[at]
        row, column = row[keep], column[at[keep]]
        both = np.zeros((len(pdf), len(pdf)), np.float32)
        for first in range(0, int(shared.sum()), CHUNK):
            part = (column >= first) & (column < first + CHUNK)
            held_by = np.zeros((len(pdf), min(CHUNK, int(shared.sum()) - first)), np.float32)
            held_by[row[part], column[part] - first] = 1
            both += held_by @ held_by.T
        union = sizes[:, None] + sizes[None, :] - both
        linked = (100 * both >= percent * union) & (both > 0)
        if pdf.lo[0] != pdf.hi[0]:  # what links inside a block is found where the block meets itself
            linked &= pdf.block.to_numpy()[:, None] != pdf.block.to_numpy()[None, :]
        np.fill_diagonal(linked, False)
        root = forest(linked)
        moved = root != np.arange(len(pdf))
        reps = pdf.rep.to_numpy()
        return pd.DataFrame({"a": reps[moved], "b": reps[root[moved]]})

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`; see the module text.

    Linked are documents whose sets of `words`-word shingles have 100 * intersection >= percent * union. The component is the
    smallest doc_id reachable over links; kept is doc_id = component_id.
    """
    return _judged(docs, words, percent, k).selectExpr("doc_id", "n_shingles", "component_id", "coalesce(doc_id = component_id, true) as kept")


def _judged(docs: DataFrame, words: int, percent: int, k: int = K) -> DataFrame:
    """(doc_id, mark, n_shingles, fp_a, fp_b, component_id, first) for every row. `first`: the row is of the class that its component keeps,
    that with the smallest (doc_id, fp_a, fp_b), and has that doc_id."""
    prepare(docs.sparkSession)
    texts = docs.selectExpr("doc_id", "text", f"{_MARK} as mark")
    rows = materialise(texts.mapInArrow(_sketches(words, k), _ROW), "sketches")
    known = rows.where("doc_id is not null and n_shingles > 0")
    classes = materialise(known.groupBy("fp_a", "fp_b").agg(F.min("doc_id").alias("doc_id"))
                          .withColumn("rep", F.monotonically_increasing_id()), "numbered")  # written, so that the numbers stay
    links = materialise(_links(texts, known, classes, words, percent, k), "near_links")
    named = classes.join(components(links).withColumnRenamed("node", "rep"), "rep", "left")
    tops = (named.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "fp_a", "fp_b")).alias("top")))
    found = (named.join(tops, "component", "left").withColumn("top", F.expr("coalesce(top, struct(doc_id, fp_a, fp_b))"))
             .selectExpr("fp_a", "fp_b", "top.doc_id as reached", "top.fp_a = fp_a and top.fp_b = fp_b as chosen"))
    with_words, without = rows.where("n_shingles > 0"), rows.where("n_shingles = 0")
    return (with_words.join(found, ["fp_a", "fp_b"], "left")
            .selectExpr("doc_id", "mark", "n_shingles", "fp_a", "fp_b", "case when doc_id is not null then reached end as component_id",
                        "chosen and doc_id = reached as first")
            .unionAll(without.selectExpr("doc_id", "mark", "n_shingles", "fp_a", "fp_b", "doc_id as component_id", "true as first")))


def _links(texts: DataFrame, known: DataFrame, classes: DataFrame, words: int, percent: int, k: int) -> DataFrame:
    """Links (a, b) between representatives that join up all that are linked."""
    similarity = percent / 100
    overlap = least_overlap(k, similarity)
    sketches = materialise(
        known.join(classes.hint("merge"), ["doc_id", "fp_a", "fp_b"])
        .selectExpr("rep", "n_shingles as n", "sketch").dropDuplicates(["rep"]), "classes")
    values = sketches.selectExpr("rep", "n", "explode(sketch) as value")
    common = values.groupBy("value").agg(F.count("*").alias("held")).where("held > 1")
    exact = f"n < {similarity * k}"
    needed = f"case when {exact} then cast(ceil({percent} * n / 100) as int) else {overlap} end"
    listed = materialise(
        values.join(common, "value").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("held", "value"))).alias("rare"))
        .withColumn("first", F.expr(f"size(rare) - ({needed}) + 1"))  # values held by one document alone come before these
        .where("first > 0").selectExpr("rep", "n", "explode(slice(rare, 1, first)) as entry")
        .selectExpr("rep", "n", "entry.value as value"), "listed")
    lists = listed.groupBy("value").agg(F.count("*").alias("members"), F.sum("n").alias("total")).where("members > 1")
    members = listed.join(lists, "value")
    short = members.where(f"members <= {LIST}")
    pairs = (short.selectExpr("value", "rep as a", "n as na").join(short.selectExpr("value", "rep as b", "n as nb"), "value")
             .where(f"a < b and 100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b").distinct())
    side = sketches.selectExpr("rep", "sketch")
    close = materialise(
        pairs.hint("merge").join(side.selectExpr("rep as a", "sketch as sa"), "a")
        .hint("merge").join(side.selectExpr("rep as b", "sketch as sb"), "b")
        .withColumn("u", F.expr(f"slice(array_sort(array_union(sa, sb)), 1, {k})"))
        .withColumn("both", F.expr("size(array_intersect(array_intersect(u, sa), sb))"))
        .where(f"case when size(u) < {k} then 100 * both >= {percent} * size(u) else both >= {overlap} end").select("a", "b"), "close")
    blocks = f"greatest(1, cast(ceil(members / {BLOCK_DOCS}) as int), cast(ceil(total / {BLOCK_VALUES}) as int))"
    dealt = materialise(
        members.where(f"members > {LIST}").withColumn("blocks", F.expr(blocks))
        .withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
        .withColumn("other", F.expr("explode(sequence(0, blocks - 1))"))
        .selectExpr("value", "rep", "block", "least(block, other) as lo", "greatest(block, other) as hi"), "dealt")
    reps = close.selectExpr("a as rep").unionAll(close.selectExpr("b as rep")).unionAll(dealt.select("rep")).distinct()
    wanted = materialise(classes.join(reps, "rep", "left_semi"), "wanted")
    full = materialise(
        texts.select("doc_id", "text").join(wanted.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
        .mapInArrow(_full_sets(words), "doc_id long, fp_a long, fp_b long, full array<long>").dropDuplicates(["doc_id", "fp_a", "fp_b"])
        .join(wanted.hint("merge"), ["doc_id", "fp_a", "fp_b"]).select("rep", "full"), "full_sets")
    confirmed = (close.hint("merge").join(full.selectExpr("rep as a", "full as fa"), "a")
                 .hint("merge").join(full.selectExpr("rep as b", "full as fb"), "b")
                 .withColumn("both", F.expr("size(array_intersect(fa, fb))"))
                 .where(f"100 * both >= {percent} * (size(fa) + size(fb) - both)").select("a", "b"))
    in_blocks = dealt.join(full, "rep").groupBy("value", "lo", "hi").applyInPandas(_block_links(percent), "a long, b long")
    return confirmed.unionAll(in_blocks)


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay: one document of each component. Columns are those of `docs`.

    Of each component its class with the smallest (doc_id, fingerprint) stays. Rows of one doc_id with equal shingles are one document,
    of which the text with the smallest hash stays once; with other shingles they are documents of their own. Rows without a doc_id stay.
    """
    stays = (_judged(docs, words, percent).where("doc_id is not null and first")
             .groupBy("doc_id", "fp_a", "fp_b").agg(F.min("mark").alias("_mark")).select("doc_id", "_mark").distinct())
    named = docs.where("doc_id is not null").withColumn("_mark", F.expr(_MARK))
    return (named.join(stays.hint("merge"), ["doc_id", "_mark"], "left_semi").dropDuplicates(["doc_id", "_mark"]).select(docs.columns)
            .unionAll(docs.where("doc_id is null")))
