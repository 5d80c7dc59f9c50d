"""Near-duplicates of vectors: a pivot-permutation index.

A bounded sample of vectors serves as reference points. A vector is described by its NEAREST pivots in order of nearness, so vectors that
lie close together see the same pivots first.

* Reference points are at most `pivots_for(rows)` vectors, about twice the square root of their number, at most MAX_PIVOTS: the first
  ones by a hash of vec_id, without those closer than APART to one already taken (a group of copies would else supply them all). The
  sample bounds the pivots only; every vector is indexed. Vectors of a length that no reference point has share one list a label.
* Inverted lists, one for each label, dimension and pivot. Pairs are wanted that share at least SHARED of their nearest pivots, so a
  vector needs to be listed only under the first (NEAREST - SHARED + 1) of them by pivot number: such pairs meet in a list.
* A list is dealt in blocks of at most BLOCK vectors, and each pair of blocks is a task of its own. It counts shared pivots, and takes
  the cosine in double precision of the pairs that reach SHARED. A pair counts only in the list of its first common pivot, so links
  are counted once. A block returns sums and a link or two for each vector, never its pairs.
* Vectors that are equal, with equal labels, form a class, and only its smallest vec_id is indexed; the others count as links.

Nulls and odd values: a row with no label or vec_id, or a vector that is null, empty, zero or holds a null or non-finite number, links
with nothing. Vectors of different length link with nothing either. Other columns are neither read nor returned.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import components, fingerprint, forest, list_column, prepare
from turnstile.session import materialise

NEAREST, SHARED = 12, 4
MIN_PIVOTS, MAX_PIVOTS = 64, 4096
APART = 0.8
BLOCK = 1024
NO_PIVOT = -1  # stands for the pivots of vectors without any
_ROW = "vec_id long, label string, dim int, fp_a long, fp_b long, vector array<double>, pivots array<int>"


def pivots_for(rows: int) -> int:
    return int(min(MAX_PIVOTS, max(MIN_PIVOTS, 2 * sqrt(rows))))


def reference_points(vectors: DataFrame, limit: int) -> dict[int, np.ndarray]:
    """Unit vectors by dimension, at most `limit` in all."""
    sample = vectors.where("vec_id is not null and embedding is not null and label is not null") \
        .orderBy(F.xxhash64("vec_id"), "vec_id").limit(limit).select("embedding").toPandas()
    found: dict[int, list] = {}
    for raw in sample.embedding:
        v = _unit(raw)
        if v is not None and all(v @ other < APART for other in found.get(len(v), ())):
            found.setdefault(len(v), []).append(v)
    return {dim: np.array(points) for dim, points in found.items()}


def _unit(raw) -> np.ndarray | None:
    """The vector divided by its length, in double precision, or None if it has no direction."""
    if raw is None or not len(raw) or any(x is None for x in raw):
        return None
    v = np.asarray(raw, np.float64)
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if not top:
        return None
    v = v / top  # lengths of very large or small vectors stay finite
    return v / np.sqrt(v @ v)


def _describe(points: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            units = [_unit(x) for x in batch.column("embedding").to_pylist()]
            usable = [u is not None and i is not None and n is not None
                      for u, i, n in zip(units, batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), strict=True)]
            units = [u if ok else np.zeros(0) for u, ok in zip(units, usable, strict=True)]
            marks = [fingerprint(u.tobytes()) for u in units]
            nearest = [np.full(1, NO_PIVOT, np.int32)] * len(units)
            for dim, at in points.items():
                rows = [i for i, u in enumerate(units) if len(u) == dim]
                if rows:
                    order = np.argsort(-(np.array([units[i] for i in rows]) @ at.T), axis=1, kind="stable")[:, :NEAREST]
                    for i, o in zip(rows, order.astype(np.int32), strict=True):
                        nearest[i] = o
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").cast(pa.int64()), batch.column("label").cast(pa.string()), pa.array([len(u) for u in units], pa.int32()),
                 pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()),
                 list_column(units, pa.float64()), list_column(nearest, pa.int32())],
                ["vec_id", "label", "dim", "fp_a", "fp_b", "vector", "pivots"])

    return run


def _block_links(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable").reset_index(drop=True)
        here = int(pdf["pivot"].iloc[0])
        seen = np.stack(pdf.pivots.to_numpy())
        used, at = np.unique(seen, return_inverse=True)
        held = np.zeros((len(pdf), len(used)), np.float32)
        held[np.arange(len(pdf))[:, None], at.reshape(seen.shape)] = 1
        shared = held @ held.T
        earlier = np.zeros_like(held)
        listed = np.stack(pdf.listed.to_numpy())
        mine = np.repeat(np.arange(len(pdf)), listed.shape[1])
        before = listed.ravel() < here
        earlier[mine[before], np.searchsorted(used, listed.ravel()[before])] = 1
        first = (earlier @ earlier.T) == 0
        unit = np.stack(pdf.vector.to_numpy())
        linked = first & (shared >= min(SHARED, seen.shape[1])) & (unit @ unit.T >= cosine)
        if pdf.lo[0] != pdf.hi[0]:
            linked &= pdf.block.to_numpy()[:, None] != pdf.block.to_numpy()[None, :]
        np.fill_diagonal(linked, False)
        root = forest(linked)
        any_link = linked.any(axis=1)
        reps = pdf.rep.to_numpy()
        return pd.DataFrame({"rep": reps[any_link], "links": linked[any_link] @ pdf.copies.to_numpy(), "root": reps[root[any_link]]})

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label); see the module text."""
    spark = prepare(vectors.sparkSession)
    vectors = vectors.select("vec_id", "embedding", "label")
    points = reference_points(vectors, pivots_for(vectors.count()))
    rows = materialise(vectors.mapInArrow(_describe(points), _ROW), "described")
    key = ["label", "fp_a", "fp_b"]
    classes = materialise(rows.where("dim > 0").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    indexed = (rows.where("dim > 0").withColumnRenamed("vec_id", "rep").join(classes, [*key, "rep"])
               .select("label", "dim", "rep", "copies", "vector", "pivots").dropDuplicates(["rep"])
               .withColumn("listed", F.expr(f"slice(array_sort(pivots), 1, greatest(1, size(pivots) - {SHARED} + 1))")))
    entries = indexed.select("*", F.explode("listed").alias("pivot"))
    lists = entries.groupBy("label", "dim", "pivot").agg(F.count("*").alias("members")).where("members > 1")
    dealt = (entries.join(lists, ["label", "dim", "pivot"])
             .withColumn("blocks", F.expr(f"cast(ceil(members / {BLOCK}) as int)"))
             .withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
             .withColumn("other", F.expr("explode(sequence(0, blocks - 1))"))
             .withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
             .select("label", "dim", "pivot", "lo", "hi", "block", "rep", "copies", "vector", "pivots", "listed"))
    found = materialise(dealt.groupBy("label", "dim", "pivot", "lo", "hi")
                        .applyInPandas(_block_links(cosine), "rep long, links long, root long"), "vector_links")
    reached = components(found.selectExpr("rep as a", "root as b")).withColumnRenamed("node", "rep")
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    judged = (classes.join(totals, "rep", "left").join(reached, "rep", "left")
              .selectExpr(*key, "copies - 1 + coalesce(links, 0) as n_links", "coalesce(component, rep) as reached"))
    linked = rows.where("dim > 0").select("vec_id", *key).join(judged, key).selectExpr("vec_id", "n_links", "reached as component_id")
    alone = rows.where("dim = 0").selectExpr("vec_id", "0L as n_links", "vec_id as component_id")
    return linked.unionAll(alone).withColumn("kept", F.expr("coalesce(vec_id = component_id, true)"))
