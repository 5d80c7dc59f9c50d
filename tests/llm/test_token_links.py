"""Alignment of two tokenizers against whole texts read by the libraries, and the table of pairs."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from turnstile.llm import token_links as L

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a string, pair string"
MADE = ["a", "word", "Ünï", " ", "  ", "\n", "\n\n", "\t", "'s", ".", "!!", "12", "日本", "▁", " ", "\x1c", "é", "<|endoftext|>", "<s>", "<0x41>", "\r\n", "ß", "�", "\0", "𝄞"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), L.entries_a(A), L.entries_b(B)


def aligned(text, libraries):
    """Ids, links and groups of a whole text, or None."""
    a, b, bytes_a, bytes_b = libraries
    if not text:
        return None
    left, right = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    sides = [[entries.get(i, b"?") for i in ids] for ids, entries in ((left, bytes_a), (right, bytes_b))]
    if any(b"".join(x) != (" " + text).encode() for x in sides):
        return None
    ends_a, ends_b = (np.cumsum([len(x) for x in side]).tolist() for side in sides)
    common = set(ends_a) & set(ends_b)
    pairs = [(i, j) for i, x in zip(left, ends_a) for j in [right[ends_b.index(x)] if x in common else None] if j is not None]
    groups, i, j = [], 0, 0
    for end in sorted(common):
        k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append(f"{','.join(map(str, left[i:k]))}|{','.join(map(str, right[j:m]))}")
        i, j = k, m
    return left, right, pairs, ";".join(groups)


def brute(texts, libraries):
    found = [aligned(t, libraries) for t in texts]
    counts = Counter(p for f in found if f for p in f[2])
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    for f in found:
        if f is None:
            yield 0, 0, 0, 0, 0, 0, ""
            continue
        a, b, pairs, groups = f
        yield (len(a), len(b), groups.count(";") + 1, len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs),
               hashlib.sha256(groups.encode()).hexdigest())


def check(spark, texts, libraries):
    rows = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in L.links(rows, A, B).collect()}
    for i, want in enumerate(brute(texts, libraries)):
        assert got[i] == want, repr(texts[i])[:200]


def test_links(spark, libraries):
    rng = random.Random(8)
    texts = ["".join(rng.choices(MADE, k=rng.randint(1, 15))) for _ in range(400)]
    texts += ["the same copy of a text, many times"] * 60 + [None, "", " ", "\n", "  x", "x ", "\nx", " \n x\n", "a\n b", "x" * 30_000, "日本語" * 2000, "a b\nc d"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(40).collect()]
    check(spark, texts, libraries)


def test_rows_without_tokens(spark, libraries):
    check(spark, [None, "", "a▁b"], libraries)
    rows = spark.createDataFrame([(None, "no id", "", ""), (3, "again", "", ""), (3, "again", "", "")], SCHEMA)
    got = sorted(((r.doc_id or -1, r.n_links, r.count_sum) for r in L.links(rows, A, B).collect()))
    assert [g[0] for g in got] == [-1, 3, 3] and got[1] == got[2]
    assert L.links(rows.limit(0), A, B).count() == 0


def test_chunks_that_are_forgotten_count_the_same(spark, libraries, monkeypatch):
    texts = [f"{'abc def ' * 3}{i}{tail}" for i in range(40) for tail in ("", "\ny z", " ", "▁")]
    want = Counter(i << 32 | j for t in texts if (found := aligned(t, libraries)) for i, j in found[2])
    for limit in (0, 10**9):
        monkeypatch.setattr(L.Aligner.__init__, "__defaults__", (limit,))
        rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
        seen = Counter()
        for batch in L.count_pairs((pa.record_batch([pa.array(texts[i:i + 7])], ["text"]) for i in range(0, len(texts), 7)), A, B):
            seen.update(dict(zip(*(c.to_pylist() for c in batch.columns))))
        assert seen == want
        got = Counter()
        for r in L.pair_counts(rows, A, B).collect():
            got[r.pair] += r.n
        assert got == want


@pytest.mark.parametrize("n", [1, 2, 3, 50, 5000])
def test_minimal_perfect_hash(n):
    rng = np.random.default_rng(n)
    pairs = np.unique(rng.integers(0, 50_000, 2 * n) << 32 | rng.integers(0, 32_000, 2 * n))[:n]
    seed, moved, by_place = L.displace(pairs)
    assert sorted(by_place) == sorted(pairs)
    table = L.PairTable(np.array([seed], np.uint64), np.array([0, len(moved)]), np.array([0, len(pairs)]), moved, by_place)
    assert sorted(table.find(pairs)) == list(range(len(pairs)))
    assert (table.pairs[table.find(pairs)] == pairs).all()
    assert (table.find(pairs + (1 << 50)) == -1).all()


def test_pair_table_in_shards(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD", 100)
    monkeypatch.setattr(L, "FAN", 2)
    rng = random.Random(9)
    rows = [(rng.randrange(3000) << 32 | rng.randrange(7), rng.randrange(1, 9)) for _ in range(4000)]
    counted = spark.createDataFrame(rows, "pair long, n long").repartition(9)
    want = Counter()
    for pair, n in rows:
        want[pair] += n
    table = L.pair_table(counted, len(want))
    assert dict(zip(table.pairs.tolist(), L.total_counts(counted, table).tolist())) == want
    with pytest.raises(ValueError, match="allow"):
        L.pair_table(counted, len(want) - 1)


def test_bound_on_pairs():
    a, b = L.entries_a(A), L.entries_b(B)
    some = random.Random(1).sample(sorted(b), 60)
    want = sum(x.endswith(b[j]) or b[j].endswith(x) for j in some for x in a.values())
    kept = {j: b[j] for j in some}
    L.pair_bound.cache_clear()
    original = L.entries_b
    try:
        L.entries_b = lambda _: kept
        assert L.pair_bound(A, B) == want
    finally:
        L.entries_b = original
        L.pair_bound.cache_clear()
    assert L.pair_bound(A, B) < 1_000_000
