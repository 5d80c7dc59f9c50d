"""The trie of rebuilt conversations against one of Python tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from turnstile.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth string, f0 string, pos string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def order(row):
    return row[1] is not None, row[1] or 0, (row[2] or "").encode(), (row[3] or "").encode()


def brute(rows):
    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        own[r[0]].append((r[2] or "", r[3] or ""))
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = (*own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h], *turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    kids, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, m in members.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(m) - 1) * len(path[-1][1].encode()) if path else 0
            leaves[path[:d]] += path not in kids
    return {(min(m), len(p)): (min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                               hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()}


def check(spark, rows):
    got = P.trie(frame(spark, rows)).collect()
    assert len({(r.conv_id, r.depth) for r in got}) == len(got)
    assert {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got} == brute(rows)
    return got


def test_trie(spark):
    rng = random.Random(2)
    rows = []
    for conv in rng.sample(range(400), 150):
        turns = [(rng.choice(["user", "assistant"]), rng.choice(["a", "b", "é", ""])) for _ in range(rng.randint(1, 12))]
        if conv % 3 == 0:  # many copies
            turns = [("system", "the same"), ("user", "hello"), ("assistant", "hi"), *turns[:2]]
        rows += [(conv, i, *t) for i, t in enumerate(turns)]
    got = check(spark, rows)
    stored = {(c, i): t for c, turns in {c: sorted((r for r in rows if r[0] == c), key=order) for c in {r[0] for r in rows}}.items()
              for i, t in enumerate(turns, 1)}
    assert all((r.text_conv_id, r.text_pos) in stored for r in got if r.depth)


def test_odd_rows_and_a_long_conversation(spark):
    rows = [(None, 1, "user", "no id"), (-7, 0, "u", "a"), (-5, 0, "u", "a"), (-5, 1, "u", "b"), (3, None, None, None), (3, 0, "b", "x"), (3, 0, "a", "y"),
            (3, 0, "a", "y"), (0, 5, "u", None), (0, 5, "u", ""), (11, 0, "u", "12"), (12, 0, "u1", "2"), (16, 2, "u", "x" * 50_000)]
    check(spark, rows + [(25, i, "user", "again" if i % 2 else "x") for i in range(1200)] + [(26, i, "user", "again" if i % 2 else "x") for i in range(1300)])
    assert P.trie(frame(spark, [])).collect() == []
    assert P.trie(frame(spark, rows[:1])).collect() == []


def test_collisions_are_found(spark, monkeypatch):
    monkeypatch.setattr(P, "PRIMES", (2, 3, 2, 3))
    monkeypatch.setattr(P, "ATTEMPTS", 1)
    with pytest.raises(RuntimeError, match="collided"):
        P.trie(frame(spark, [(c, i, "user", f"{c} {i}") for c in range(0, 60, 5) for i in range(4)]))


def test_fingerprints_compose():
    rng = random.Random(4)
    base, prime = rng.randrange(1 << 20, P.PRIMES[0]), P.PRIMES[0]
    terms = [rng.randrange(prime) for _ in range(40)]

    def of(part):
        return sum(t * pow(base, i, prime) for i, t in enumerate(part)) % prime

    for cut in (0, 1, 17, 40):
        assert of(terms) == (of(terms[:cut]) + pow(base, cut, prime) * of(terms[cut:])) % prime
    exponents = np.array([0, 1, 2, 63, 10**6, 2**40])
    assert P._powers(base, exponents, prime).tolist() == [pow(base, int(e), prime) for e in exponents]


def test_ids_of_one_node_over_many_chunks(spark):
    ids = random.Random(6).sample(range(-500, 10**6), 5000)
    rows = spark.createDataFrame([(3, 1, 2, c) for c in ids] + [(3, 1, 3, 9)], "depth long, f0 long, f1 long, conv_id long").repartition(7)
    got = {r.f1: r.sha256 for r in P.id_digests(rows).collect()}
    assert got == {2: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), 3: hashlib.sha256(b"9").hexdigest()}
