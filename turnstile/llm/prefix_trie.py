"""Prefix trie of rebuilt conversations, from fingerprints that compose: texts are hashed once and never put together again.

A sequence of turns has the fingerprint (length, sum of turn_i * BASE^i mod PRIME) in four lanes. These form a monoid:

    (m, a) * (n, b) = (m + n, a + BASE^m * b)

so the fingerprint of every prefix of a rebuilt conversation, the head of its base and then a suffix of its own, follows from the prefix
fingerprints of the two: head(base) * (own prefix with its own head divided out). No text and no list of turns is built for it.

1. Turns get their place and prefix fingerprint by two running sums (`operators.scan`), so a conversation of any length spreads over tasks.
2. Each conversation meets the first turns of its base once (at most HEAD of them, and at most GROUP conversations share a base).
3. Nodes are the groups of equal (depth, fingerprint). A group is checked to be one: all its members' last turns, told by references to the
   stored turns, have one content, and all its members' parents are one node; by induction the sequences are equal. Turns count as of one
   content if two 64-bit hashes agree, and all contents of each pair of hashes are compared. If a check fails, other bases and hashes
   are taken, until none does.
4. A conversation is the smallest member of a run of nodes, its chain, which ends where the conversation does and hangs on a node of another
   chain. Sums over subtrees are sums over chains and what hangs on them: totals by pointer doubling over the tree of chains (as many
   rounds as the logarithm of its height), then a running sum from the end of each chain.
5. The ids that end in a node are put in order by ranges, written as text chunks, and digested chunk by chunk. SHA-256 takes its input in
   one order, so the chunks of one node go to one task, which keeps one of them at a time.

Order of turns: by turn, null first; equal turns by the first 32 characters of the role, the first 64 of the text, then by hash. Null roles
and texts are empty. Rows without conv_id belong to no conversation and are left out; rows that repeat are turns of their own. An
empty table has no nodes. Other columns are not read. A very common conversation, first turn or parent is a hot group only in counts that
combine before the shuffle, and in joins that Spark may split.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.operators.scan import running
from turnstile.session import materialise

PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)  # products of two residues fit 63 bits
GROUP, HEAD = 5, 8  # conversations c to c + 4 share a base; the most turns that are taken over
ATTEMPTS = 5
_LANES = range(len(PRIMES))
_NODE = ["depth", "f0", "f1"]


def trie(turns: DataFrame, group: int = GROUP, head: int = HEAD) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, text_conv_id, text_pos.

    Conversation c takes over h = crc32(c) % (head + 1) turns of conversation c - c % group, and goes on with its own turns after its first h.
    (text_conv_id, text_pos) is a place of the node's last turn among the stored turns, counted from 1.
    """
    for attempt in range(ATTEMPTS):
        rng = random.Random(attempt)
        bases = [rng.randrange(p // 2, p) for p in PRIMES]
        hashed = _hashed(turns, attempt)
        placed = materialise(_prefixes(hashed, bases), "prefixes")
        convs = materialise(_conversations(placed, group, head), "conversations")
        if convs.isEmpty():
            return _empty(turns)
        rebuilt = materialise(_rebuilt(placed, convs, bases, group, head), "rebuilt")
        nodes = materialise(_nodes(rebuilt, convs), "nodes")
        if nodes.where("not same").isEmpty() and _contents_differ(hashed).isEmpty():
            return _measured(nodes, rebuilt, convs)
    raise RuntimeError(f"fingerprints collided with {ATTEMPTS} sets of bases")


def _empty(turns: DataFrame) -> DataFrame:
    return turns.sparkSession.createDataFrame([], """conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long,
        saved_tokens long, ends_sha256 string, text_conv_id long, text_pos long""")


def _hashed(turns: DataFrame, attempt: int) -> DataFrame:
    """Turns with two hashes of their content (d0, d1)."""
    given = turns.where("conv_id is not null").selectExpr("cast(conv_id as long) as conv_id", "cast(turn as long) as turn",
                                                          "coalesce(role, '') as role", "coalesce(text, '') as text")
    return given.selectExpr("*", f"xxhash64({2 * attempt}, length(role), role, text) as d0", f"xxhash64({2 * attempt + 1}, length(role), role, text) as d1")


def _contents_differ(hashed: DataFrame) -> DataFrame:
    """Pairs of hashes that stand for several contents. Copies combine before the shuffle."""
    return hashed.select("d0", "d1", "role", "text").distinct().groupBy("d0", "d1").count().where("count > 1")


def _residues(d0: str, d1: str) -> list[str]:
    return [f"pmod(xxhash64({lane}, {d0}, {d1}), {p}L)" for lane, p in enumerate(PRIMES)]


def _prefixes(hashed: DataFrame, bases: list[int]) -> DataFrame:
    """(conv_id, pos, s0 .. s3, c0 .. c3, d0, d1, bytes): place, fingerprint of the turns up to it, its own term, its content and text size."""
    narrow = hashed.selectExpr("conv_id", "turn", "left(role, 32) as r", "left(text, 64) as t", "d0", "d1", "cast(octet_length(text) as long) as bytes")
    placed = running(narrow, ["conv_id"], ["turn", "r", "t", "d0", "d1"], {"pos": ("sum", "1L")}).selectExpr(
        "conv_id", "pos", "d0", "d1", "bytes", *(f"{x} as t{lane}" for lane, x in enumerate(_residues("d0", "d1"))))

    @F.pandas_udf("c0 long, c1 long, c2 long, c3 long")
    def terms(pos: pd.Series, t0: pd.Series, t1: pd.Series, t2: pd.Series, t3: pd.Series) -> pd.DataFrame:
        exponents = pos.to_numpy(np.int64) - 1
        return pd.DataFrame({f"c{lane}": t.to_numpy(np.int64) * _powers(bases[lane], exponents, PRIMES[lane]) % PRIMES[lane]
                             for lane, t in enumerate((t0, t1, t2, t3))})

    weighed = placed.select("conv_id", "pos", "d0", "d1", "bytes", terms("pos", "t0", "t1", "t2", "t3").alias("c")).select(
        "conv_id", "pos", "d0", "d1", "bytes", "c.*")
    summed = running(weighed, ["conv_id"], ["pos"], {f"s{lane}": ("sum", f"c{lane}") for lane in _LANES})
    return summed.select("conv_id", "pos", *(F.expr(f"s{lane} % {p}L").alias(f"s{lane}") for lane, p in enumerate(PRIMES)),
                         *(f"c{lane}" for lane in _LANES), "d0", "d1", "bytes")


def _powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    out, square, left = np.ones(len(exponents), np.int64), base, exponents.copy()
    while left.any():
        out = np.where(left & 1, out * square % prime, out)
        square, left = square * square % prime, left >> 1
    return out


def _conversations(placed: DataFrame, group: int, head: int) -> DataFrame:
    """(conv_id, h, taken, n_turns, base): what a conversation takes over. `base` holds the turns taken, b0 .. b3 and o0 .. o3 the
    fingerprints of the turns taken and of the own first h."""
    run = placed.sparkSession.sql
    fields = ", ".join(["pos", *(f"s{lane}" for lane in _LANES), *(f"c{lane}" for lane in _LANES), "d0", "d1", "bytes"])
    own = run(f"""select conv_id, max(pos) as n_own, sort_array(collect_list(if(pos <= {head}, struct({fields}), null))) as head
                  from {{placed}} group by conv_id""", placed=placed)
    # The list is built of at most `head` rows of a conversation, but all its rows are counted.
    heads = materialise(own.selectExpr("conv_id", "n_own", f"cast(crc32(cast(cast(conv_id as string) as binary)) % {head + 1} as int) as h", "head"), "heads")
    taken = run(f"""select /*+ merge(b) */ c.conv_id, c.h, c.n_own, c.head, slice(coalesce(b.head, array()), 1, c.h) as base
                    from {{heads}} c left join {{heads}} b on b.conv_id = c.conv_id - c.conv_id % {group}""", heads=heads)
    of = "coalesce(get({0}, {1} - 1).s{2}, 0L)"
    return taken.selectExpr("conv_id", "h", "size(base) as taken", "size(base) + greatest(n_own - h, 0) as n_turns", "base",
                            *(f"{of.format('base', 'size(base)', lane)} as b{lane}" for lane in _LANES),
                            *(f"{of.format('head', 'h', lane)} as o{lane}" for lane in _LANES))


def _packed(lanes: list[str]) -> list[str]:
    return [f"({lanes[0]}) * 2147483648L + ({lanes[1]})", f"({lanes[2]}) * 2147483648L + ({lanes[3]})"]


def _rebuilt(placed: DataFrame, convs: DataFrame, bases: list[int], group: int, head: int) -> DataFrame:
    """(conv_id, depth, f0, f1, p0, p1, d0, d1, bytes, ref_conv, ref_pos, is_end): every prefix of every rebuilt conversation that has turns."""
    run = placed.sparkSession.sql

    def row(now: list[str], before: list[str]) -> str:
        names = ("f0", "f1", "p0", "p1")
        return ", ".join(f"{x} as {name}" for x, name in zip(_packed(now) + _packed(before), names))

    taken = run(f"""
        select conv_id, b.pos as depth, {row([f'b.s{i}' for i in _LANES], [f'pmod(b.s{i} - b.c{i}, {p}L)' for i, p in enumerate(PRIMES)])},
               b.d0, b.d1, b.bytes, conv_id - conv_id % {group} as ref_conv, b.pos as ref_pos, b.pos = n_turns as is_end
        from (select conv_id, n_turns, explode(base) as b from {{convs}})""", convs=convs)

    def joined(lane: int, own: str) -> str:
        # The own part moves from place h to place `taken`: divided by BASE^(h - taken), which is at most `head` places.
        inverse = pow(bases[lane], -1, PRIMES[lane])
        shifts = ", ".join(f"{pow(inverse, k, PRIMES[lane])}L" for k in range(head + 1))
        return f"(b{lane} + pmod({own} - o{lane}, {PRIMES[lane]}L) * element_at(array({shifts}), h - taken + 1)) % {PRIMES[lane]}L"

    now = [joined(i, f"s{i}") for i in _LANES]
    before = [joined(i, f"s{i} - c{i}") for i in _LANES]
    ends = convs.drop("base")
    own = run(f"""
        select /*+ merge(c) */ p.conv_id, taken + pos - h as depth, {row(now, before)}, d0, d1, bytes, p.conv_id as ref_conv, pos as ref_pos,
               taken + pos - h = n_turns as is_end
        from {{placed}} p join {{ends}} c on p.conv_id = c.conv_id where pos > h""", placed=placed, ends=ends)
    return taken.unionByName(own)


def _nodes(rebuilt: DataFrame, convs: DataFrame) -> DataFrame:
    """Groups of equal (depth, fingerprint) and the root; `same` if all members have one last turn and one parent."""
    run = rebuilt.sparkSession.sql
    one = " and ".join(f"min({c}) = max({c})" for c in ("p0", "p1", "d0", "d1", "bytes"))
    return run(f"""
        select depth, f0, f1, min(conv_id) as conv_id, count(*) as n_convs, min(p0) as p0, min(p1) as p1, min(bytes) as bytes,
               min_by(ref_conv, conv_id) as text_conv_id, min_by(ref_pos, conv_id) as text_pos, {one} as same
        from {{rebuilt}} group by depth, f0, f1
        union all select 0L, 0L, 0L, min(conv_id), count(*), null, null, 0L, null, null, true from {{convs}}""", rebuilt=rebuilt, convs=convs)


def _measured(nodes: DataFrame, rebuilt: DataFrame, convs: DataFrame) -> DataFrame:
    run = nodes.sparkSession.sql
    root = nodes.where("depth = 0").first().conv_id
    # The children of the root know their parent, and may be very many: they are no part of the join.
    linked = materialise(run(f"""
        with kids as (select depth - 1 as depth, p0, p1, count(*) as n from {{nodes}} where depth > 0 group by depth - 1, p0, p1)
        select /*+ merge(k, p) */ n.*, coalesce(k.n, 0L) as n_children, (n.n_convs - 1) * n.bytes as saved,
               if(n.depth = 1, {root}L, p.conv_id) as parent_conv_id
        from {{nodes}} n left join kids k on n.depth = k.depth and n.f0 = k.p0 and n.f1 = k.p1
             left join {{nodes}} p on n.depth > 1 and p.depth = n.depth - 1 and p.f0 = n.p0 and p.f1 = n.p1""", nodes=nodes), "linked")
    hung = run("""select up, first - 1 as depth, sum(saved) as saved, sum(leaves) as leaves from {chains} where up is not null
                  group by up, first - 1""", chains=_chain_totals(linked, root))
    own = run("""select /*+ merge(h) */ n.*, -n.depth as upwards, n.saved + coalesce(h.saved, 0L) as all_saved,
                        if(n.n_children = 0, 1L, 0L) + coalesce(h.leaves, 0L) as all_leaves
                 from {linked} n left join {hung} h on n.conv_id = h.up and n.depth = h.depth""", linked=linked, hung=hung)
    summed = running(own, ["conv_id"], ["upwards"], {"saved_tokens": ("sum", "all_saved"), "n_leaves": ("sum", "all_leaves")})
    ends = rebuilt.where("is_end").select(*_NODE, "conv_id").union(convs.where("n_turns = 0").selectExpr("0L", "0L", "0L", "conv_id"))
    return run(f"""
        select /*+ merge(e) */ n.conv_id, n.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
               coalesce(e.sha256, '{hashlib.sha256().hexdigest()}') as ends_sha256, text_conv_id, text_pos
        from {{summed}} n left join {{ends}} e on n.depth = e.depth and n.f0 = e.f0 and n.f1 = e.f1""",
               summed=summed, ends=id_digests(ends))


def _chain_totals(linked: DataFrame, root: int) -> DataFrame:
    """(conv_id, up, first, saved, leaves): sums over each chain and all that hangs on it, directly or not.

    Round k has the sums over the chains fewer than 2^k steps below, and `far`, the chain 2^k steps above.
    """
    run = linked.sparkSession.sql
    top = "parent_conv_id <> conv_id"
    chains = materialise(run(f"""
        select conv_id, max(if({top}, parent_conv_id, null)) as up, max(if({top}, parent_conv_id, null)) as far, min(depth) as first,
               sum(saved) as saved, sum(if(n_children = 0, 1L, 0L)) as leaves
        from {{linked}} group by conv_id""", linked=linked), "chains")
    while not chains.where("far is not null").isEmpty():
        # Nothing is above the root's chain, on which a hot number of chains may hang: those rows are no part of the join.
        chains = materialise(run(f"""
            with below as (select far, sum(saved) as saved, sum(leaves) as leaves from {{chains}} where far is not null group by far)
            select /*+ merge(b, a) */ c.conv_id, c.up, a.far, c.first, c.saved + coalesce(b.saved, 0L) as saved, c.leaves + coalesce(b.leaves, 0L) as leaves
            from {{chains}} c left join below b on c.conv_id = b.far left join {{chains}} a on c.far <> {root} and c.far = a.conv_id""",
                                 chains=chains), "chains")
    return chains


def id_digests(rows: DataFrame) -> DataFrame:
    """(depth, f0, f1, sha256): of the decimal conv_ids of each node, in ascending order, with commas between."""
    ordered = rows.repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id").withColumn("slice", F.spark_partition_id())
    chunks = ordered.mapInArrow(_chunks, "depth long, f0 long, f1 long, slice int, nth long, ids string")
    return (chunks.repartition(*_NODE).sortWithinPartitions(*_NODE, "slice", "nth")
            .mapInArrow(_digests, "depth long, f0 long, f1 long, sha256 string"))


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal rows."""
    differ = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for x in columns:
        differ |= x[1:] != x[:-1]
    return list(pairwise([0, *(np.flatnonzero(differ) + 1).tolist(), len(columns[0])])) if len(columns[0]) else []


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nth = 0
    for batch in batches:
        depth, f0, f1, ids, slices = (batch.column(i).to_numpy() for i in range(5))
        bounds = _runs(depth, f0, f1)
        at = [a for a, _ in bounds]
        texts = [",".join(map(str, ids[a:b].tolist())) for a, b in bounds]
        yield pa.record_batch([pa.array(x, kind) for x, kind in (
            (depth[at], pa.int64()), (f0[at], pa.int64()), (f1[at], pa.int64()), (slices[at], pa.int32()),
            (range(nth, nth + len(at)), pa.int64()), (texts, pa.string()))], ["depth", "f0", "f1", "slice", "nth", "ids"])
        nth += len(at)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, digest = None, None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.string()) for i in range(4)], ["depth", "f0", "f1", "sha256"])

    for batch in batches:
        done = []
        for depth, f0, f1, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 5))):
            if (depth, f0, f1) == node:
                digest.update(b"," + ids.encode())
                continue
            if node:
                done.append((*node, digest.hexdigest()))
            node, digest = (depth, f0, f1), hashlib.sha256(ids.encode())
        yield out(done)
    if node:
        yield out([(*node, digest.hexdigest())])
