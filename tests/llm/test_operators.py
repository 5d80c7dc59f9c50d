"""Every operator against a brute-force version, an exact round trip or held-out labels, and on odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnstile.llm import bottomk, bpe, line_dedup, packing, pivots, quality_model, quality_rules, sharding, tokens, toxicity, warc
from turnstile.llm import common as C
from turnstile.session import scratch_path

SF = "/root/testdata/sf0.001"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, kept string, score string"
ODD = ["", None, " ", "one", "  two  spaces ", "a\n\n b\tc \r\n", "ünï  çødé x y", "x" * 5000, "it's 'S they'll don't\x1cx", "ends \n", "日本語 テキスト。"]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame([(*r, *["extra"] * (len(schema.split(",")) - len(r))) for r in rows], schema)


def odd_docs(spark):
    return frame(spark, [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "one"), (3, "one")])


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def words(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


# 1 ---------------------------------------------------------------------------------------------------------------


def test_warc(spark):
    big, small = "<p>" + "x" * 200, "tiny"
    rows = [(5, "u5", big), (2, "u2", big), (9, None, small), (1, "a\r\nb", small), (3, "u", None), (4, "u", ""), (2, "u2", big), (None, "u", big),
            (7, "u", "é" * 50 + "\r\n\r\n")]
    out = warc.round_trip(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")).collect()
    assert len(out) == len(rows)
    for r in out:
        html = next((h or "") for i, _, h in rows if i == r.page_id).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha256(html).hexdigest())
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in out}
    assert kinds[5] == kinds[None] == ("revisit", 2)
    assert all(kinds[i] == ("response", None) for i in (1, 2, 3, 4, 7, 9))
    assert warc.round_trip(empty(spark, "page_id long, url string, html string")).count() == 0


def test_warc_members(spark):
    pages = C.read(spark, SF, "pages")
    folder, archives = warc.write_pages(pages, size=40_000)
    store, base = warc._place(folder)
    name = archives.first().file
    raw = store.open_input_stream(f"{base}/{name}", compression=None).read()
    whole = zlib.decompressobj(31)
    whole.decompress(raw)
    assert whole.eof and not whole.unused_data  # one stream from end to end
    target, members = warc.normalise(folder, archives)
    read = warc.read_records(target, members)
    assert read.count() == pages.count() == archives.selectExpr("sum(records)").first()[0]
    html = {r.page_id: r.html for r in pages.collect()}
    assert all(bytes(r.payload).decode() == html[r.page_id] for r in read.where("record_type = 'response'").collect())
    with pytest.raises(ValueError):
        list(warc.inflate(__import__("io").BytesIO(raw[:-20])))


# 2 and 5 ---------------------------------------------------------------------------------------------------------


def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=tokens.ranks(RANKS), special_tokens={})


def all_texts(spark):
    return [r.text for r in C.read(spark, SF, "documents").select("text").collect()] + [t or "" for t in ODD]


def test_ids_are_those_of_both_libraries(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    ids, encode = packing.text_ids(RANKS, PATTERN, limit=500), reference().encode_ordinary
    assert tokens.cuts_at_spaces(PATTERN)
    rng = random.Random(3)
    made = ["".join(rng.choice(["a", "B1", " ", "\n", "'s", ".", "é", "\t", "!!", " ", "ß", "12", "\x1d"]) for _ in range(30)) for _ in range(800)]
    for text in all_texts(spark) + made + ["<|endoftext|> x"]:
        got = np.frombuffer(ids(text), "<u4").tolist()
        assert got == encode(text)
        assert got == library.encode(text, add_special_tokens=False).ids


def test_packed_ids_are_those_of_the_unchanged_tokenizer(spark, tmp_path):
    from turnstile.llm import queries

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n y", "<|endoftext|", "plain text", "  <|endoftext|>  z\n"]
    rng = random.Random(21)
    texts += ["".join(rng.choice(["a", "B1", " ", "\n", "'s", "<|endoftext|>", "<|", "|>", "é"]) for _ in range(25)) for _ in range(100)]
    frame(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op2_packing(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        assert (got[i].length, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text


def naive_best_fit(sizes, length):
    gaps = []
    for size in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= size]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - size)
        else:
            gaps.append(length - size)
    return len(gaps)


def test_sweeps_are_best_fit():
    rng = random.Random(1)
    for _ in range(150):
        length = rng.choice([10, 50, 200])
        sizes = [rng.randint(1, rng.choice([length, length // 3])) for _ in range(rng.randint(1, 300))]
        rows = packing.sweeps(Counter(sizes), length)
        used = defaultdict(list)
        for size, _, n, first, each, offset in rows:
            for k in range(n):
                used[first + k // each].append((offset + k % each * size, size))
        assert Counter(s for v in used.values() for _, s in v) == Counter(sizes)
        for places in used.values():
            places.sort()
            assert places[0][0] == 0 and all(a + s == b for (a, s), (b, _) in pairwise(places)) and sum(places[-1]) <= length
        assert len(used) == naive_best_fit(sizes, length)
    assert packing.sweeps({}, 10) == []


def test_packing(spark):
    docs = C.read(spark, SF, "documents").select("doc_id", "text").unionAll(frame(spark, [(-1, None), (-2, "")]).select("doc_id", "text"))
    out = packing.pack_documents(docs, RANKS, PATTERN, 256).collect()
    encode, by_doc, by_sequence = reference().encode_ordinary, defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for d in docs.collect():
        ids, at = [*encode(d.text or ""), 0], 0
        for k, r in enumerate(sorted(by_doc[d.doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            assert r.length == 256 or k == 0
            at += r.length
        assert at == len(ids) and len(by_doc[d.doc_id]) == -(-len(ids) // 256)
    for places in by_sequence.values():
        places.sort()
        assert places[0][0] == 0 and all(a + s == b for (a, s), (b, _) in pairwise(places)) and sum(places[-1]) <= 256
    assert len(by_sequence) == naive_best_fit([r.length for r in out], 256)
    assert packing.pack_documents(odd_docs(spark), RANKS, PATTERN).count() == odd_docs(spark).count()
    assert packing.pack_documents(empty(spark), RANKS, PATTERN).count() == 0


def test_bpe(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 100_000)
    encode = reference().encode_ordinary
    for docs in (C.read(spark, SF, "documents"), odd_docs(spark)):
        out = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, RANKS, PATTERN).collect())
        want = []
        for d in docs.collect():
            ids = encode(d.text or "")
            want.append((str(d.doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256((d.text or "").encode()).hexdigest()))
        assert out == sorted(want)
    back = bpe.decode(bpe.encode(odd_docs(spark), RANKS, PATTERN), RANKS).collect()
    assert Counter(bytes(r.bytes).decode() for r in back) == Counter((r.text or "") for r in odd_docs(spark).collect())
    assert bpe.digests(empty(spark), RANKS, PATTERN).count() == 0


# 3 ---------------------------------------------------------------------------------------------------------------


def test_quality_model(spark):
    docs, labels = C.read(spark, "/root/testdata/sf0.01", "documents"), C.read(spark, "/root/testdata/sf0.01", "labels")
    trees = quality_model.train(docs, labels)
    rows = quality_model.score(docs, trees).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out and (r.score >= 0.3) == r.predicted for r in rows)
    x = np.array([quality_model.features(t) for t in all_texts(spark)[:50]])
    walked = []
    for row in x:
        total = trees.base
        for t in range(len(trees.feature)):
            node = 0
            while trees.left[t, node] != node:
                node = (trees.left if row[trees.feature[t, node]] <= trees.threshold[t, node] else trees.right)[t, node]
            total += trees.value[t, node]
        walked.append(1 / (1 + np.exp(-total)))
    assert np.allclose(trees.score(x), walked)
    assert quality_model.score(odd_docs(spark), trees).count() == odd_docs(spark).count()
    assert quality_model.keep_good(odd_docs(spark), trees).columns == odd_docs(spark).columns
    none = quality_model.train(docs, labels.where("false"))
    assert {r.score for r in quality_model.score(docs.limit(5), none).collect()} == {0.5}


# 4 ---------------------------------------------------------------------------------------------------------------


def test_pivots(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 40)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    rows = [(i, (rng.normal(size=16) if i % 3 else centre + 0.12 * rng.normal(size=16)).astype(np.float32).tolist(), i % 2) for i in range(240)]
    rows += [(240, rows[3][1], rows[3][2]), (241, rows[3][1], rows[3][2]), (242, [2 * x for x in rows[6][1]], rows[6][2]), (243, None, 1),
             (244, [0.0] * 16, 1), (245, [float("nan")] * 16, 1), (246, rows[3][1], None), (247, [None, *rows[3][1][1:]], 1), (248, [], 1),
             (249, [1.0, 2.0], 1), (250, [1e38] * 16, 0), (None, rows[3][1], 1)]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, rep int")
    unit = {}
    for i, v, label in rows:
        u = pivots._unit(None if v is None else [None if x is None else np.float32(x) for x in v])
        if i is not None and label is not None and u is not None:
            unit[i] = (label, u)
    links = defaultdict(set)
    for a in unit:
        for b in unit:
            if a != b and unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= 0.93:
                links[a].add(b)
    reach = reachable(links)
    out = pivots.near_vectors(table).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_links, r.component_id) == (len(links[r.vec_id]) if r.vec_id is not None else 0, reach.get(r.vec_id, r.vec_id)), r
        assert r.kept == (r.vec_id == r.component_id)
    assert pivots.near_vectors(table.where("false")).count() == 0


def test_vectors_of_a_length_without_reference_points_are_linked(spark, monkeypatch):
    monkeypatch.setattr(pivots, "reference_points", lambda vectors, limit: {4: np.eye(4)})
    rows = [(1, [1.0, 0.0], "x"), (2, [1.0, 0.1], "x"), (3, [0.0, 1.0], "x"), (4, [1.0, 0.1], "y"), (5, [1.0, 0.0, 0.0], "x"), (6, [1.0, 0.0, 0.1], "x"),
            (7, [0.0, 0.0], "x"), (8, None, "x")]
    out = {r.vec_id: (r.n_links, r.component_id) for r in
           pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()}
    assert out == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8)}


def reachable(links):
    out = {}
    for start in sorted(links):
        if start not in out:
            todo = [start]
            while todo:
                at = todo.pop()
                if at not in out:
                    out[at] = start
                    todo += links[at]
    return out


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(90)]
    links = defaultdict(set)
    for a, b in edges:
        links[a].add(b)
        links[b].add(a)
    got = {r.node: r.component for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = reachable(links)
    assert got == {n: c for n, c in want.items() if links[n] - {n}}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 6 ---------------------------------------------------------------------------------------------------------------


def test_sharding(spark):
    table = sharding.fill()
    sizes = Counter(table)
    assert len(sizes) == 64 and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.fill(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 63)
    assert moved < 0.1 * len(table)
    for r in sharding.place(odd_docs(spark)).collect():
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:8], 16) % sharding.SIZE
        assert (r.slot, r.shard) == (slot, sharding.SHARDS[table[slot]])
    assert sharding.place(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        sharding.fill(("a", "b"), 9)


# 7 ---------------------------------------------------------------------------------------------------------------


def line(rng, n=12):
    return words(rng, n, 10**6)


def test_patience():
    assert line_dedup.patience("abcdef", "abxdef") == [(0, 0), (1, 1), (3, 3), (4, 4), (5, 5)]
    assert line_dedup.patience("aaab", "aab") == [(0, 0), (1, 1), (3, 2)]
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(15))] for _ in range(2))
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(i < k and j < m for (i, j), (k, m) in pairwise(pairs))


def test_line_dedup(spark):
    rng = random.Random(6)
    passage, moved, short = [line(rng, 9) for _ in range(4)], [line(rng, 30), line(rng, 30)], "All rights reserved."
    docs = {1: [line(rng), *passage, line(rng), short, *moved], 2: [*moved, line(rng), *passage, "", line(rng), short], 3: [line(rng), short, line(rng)],
            4: passage[:2], 5: [], 7: [f"  {passage[0]} ", passage[1], passage[2], line(rng)]}
    docs[6] = docs[1]
    rows = [(i, "\n".join(x)) for i, x in docs.items()] + [(8, None), (None, "\n".join(docs[1]))]
    table = frame(spark, rows, "doc_id long, text string, cuts string, first string")
    out = {r.doc_id: r for r in line_dedup.removed(table).collect()}
    text = {i: t for i, t in rows}
    assert all(out[i].text == text[i] and out[i].n_removed == 0 for i in (1, 3, 5, 8, None))
    assert out[2].text == "\n".join([docs[2][2], "", docs[2][8], short]) and out[2].n_removed == 6
    assert out[4].text == "\n".join(docs[4]) or out[4].n_removed == 2  # 18 words alone are no passage
    assert out[6].text.strip() == "" and out[6].n_removed == len(docs[6])
    assert out[7].text == docs[7][3]
    stays = line_dedup.remove_repeats(table, drop_emptied=True)
    assert stays.columns == table.columns and sorted(str(r.doc_id) for r in stays.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 7, 8, None]))
    assert line_dedup.removed(empty(spark)).count() == 0
    assert line_dedup.removed(odd_docs(spark)).count() == odd_docs(spark).count()


def test_line_dedup_of_one_id_with_two_texts(spark):
    rng = random.Random(5)
    shared, own, other = (words(rng, 25, 10**6) for _ in range(3))
    texts = [(1, f"{shared}\nfirst"), (2, f"{own}\n{shared}\nsecond"), (2, f"{other}\n{other} x\nthird"), (2, f"{other}\n{other} x\nthird")]
    left = sorted((r.doc_id, r.text) for r in line_dedup.removed(frame(spark, texts)).collect())
    assert left == sorted([texts[0], (2, f"{own}\nsecond"), *texts[2:]])  # the lines of the third text are its own, equal rows stay equal
    copies = [(7, f"{shared}\n{'abc'[i]}") for i in range(3)]  # one document a text: all but the first lose the passage
    left = [r.text for r in line_dedup.removed(frame(spark, copies)).collect()]
    assert sorted(len(t.split()) for t in left) == [1, 1, 26] and sorted(t[-1] for t in left) == ["a", "b", "c"]


def test_line_dedup_removes_every_repeated_passage(spark):
    docs = C.read(spark, SF, "documents")
    left = [(r.doc_id, r.text) for r in line_dedup.removed(docs).orderBy("doc_id").collect()]
    first, all_lines = {}, set()
    for doc_id, text in left:
        for key in line_dedup.describe(text)[3]:
            assert first.setdefault(key, doc_id) == doc_id  # no passage stands in two documents
        all_lines |= {x.strip() for x in text.split("\n")}
    assert all(x.strip() in all_lines for r in docs.collect() for x in r.text.split("\n"))  # and none is lost


# 8 ---------------------------------------------------------------------------------------------------------------


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def grams(text):
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]

    def both(a, b):
        first = xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)
        return xxhash.xxh64_intdigest(b.to_bytes(8, "little"), first)

    return [signed(h) for h in [*hashes, *(both(a, b) for a, b in pairwise(hashes))]]


def base(text):
    found = WORD.findall(text or "")
    windows = Counter(tuple(found[i:i + 8]) for i in range(len(found) - 7))
    covered = {j for i in range(len(found) - 7) if windows[tuple(found[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def brute_rules(rows, quality):
    """Scores of all rows and their verdicts: weights of each row's n-grams without its own, cut between the means of both classes."""
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if quality.get(i) == 1:
            target.update(grams(t))
    share, scores = target.total() / raw.total(), []
    for i, t in rows:
        own, total = Counter(grams(t)), 0
        for g, n in own.items():
            others = target[g] - (n if quality.get(i) == 1 else 0)
            if raw[g] > n:
                total += n * round(quality_rules.UNIT * np.log((others + 1) / ((raw[g] - n) * share + 1)))
        scores.append(total / own.total() / quality_rules.UNIT if own else None)
    passed = [base(t)[0] >= 20 and 100 * base(t)[4] <= 30 * base(t)[0] for _, t in rows]
    means = [np.mean([round(x * quality_rules.UNIT) for (i, _), x, p in zip(rows, scores, passed) if p and quality.get(i) == k]) for k in (0, 1)]
    return scores, [p and x * quality_rules.UNIT >= sum(means) / 2 for x, p in zip(scores, passed)]


def test_copies_are_scored_like_single_texts(spark):
    rng = random.Random(28)
    rows = [(i, words(rng, 40, 60) if i % 3 else words(rng, 20, 60) + " " + words(rng, 20, 60).replace("w", "v")) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int")
    for copies in (1, 2, 5):
        many = rows + [(100 + k, rows[1][1]) for k in range(copies - 1)] + [(200 + k, rows[2][1]) for k in range(copies - 1)]
        got = {r.doc_id: (r.score, r.kept) for r in quality_rules.judge(frame(spark, many), labels).collect()}
        scores, kept = brute_rules(many, {i: int(i % 3 > 0) for i in range(0, 60, 2)})
        assert {i: k for (i, _), k in zip(many, kept)} == {i: k for i, (_, k) in got.items()}
        assert [got[i][0] for i, _ in many] == pytest.approx(scores, abs=1e-9)


def test_quality_rules(spark):
    rng = random.Random(8)
    loop = words(rng, 9)
    rows = [(i, words(rng, 60)) for i in range(40)] + [(i, " ".join(f"w{rng.randrange(400)}%%% |" for _ in range(40))) for i in range(40, 50)]
    rows += [(50, f"{loop} x {loop} y {loop}"), (51, "a b c d e f g h " * 6), (52, "same line\nsame line\n\n \nother"), (53, "x " * 50)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (7, "repeated row")]
    docs = frame(spark, rows, "doc_id long, text string, kept string, weights string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(41, 0, 0), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    rows += [(60, rows[3][1]), (61, rows[3][1]), (62, rows[45][1])]  # copies, of a labelled text and of another
    docs = frame(spark, rows, "doc_id long, text string, kept string, weights string")
    scores, kept = brute_rules(rows, {i: int(i < 40) for i in [*range(40), 41]})
    got = quality_rules.judge(docs, labels).collect()
    assert len(got) == len(rows)
    told = sorted((str(r.doc_id), r.n_words, -1e9 if r.score is None else round(r.score, 6)) for r in got)
    assert told == sorted((str(i), base(t)[0], -1e9 if x is None else round(x, 6)) for (i, t), x in zip(rows, scores))
    want = Counter((i, *base(t), base(t)[0] < 20 or 100 * base(t)[4] > 30 * base(t)[0], k) for (i, t), k in zip(rows, kept))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == want
    assert {r.doc_id for r in got if r.kept} >= set(range(40)) - {7} and not {r.doc_id for r in got if r.kept} & set(range(40, 50))
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert all(r.kept == (not r.base_failed) for r in quality_rules.judge(docs, labels.where("false")).collect())
    assert quality_rules.judge(docs.where("false"), labels).count() == 0


@pytest.mark.parametrize("common", [1, 20, 10**9])
def test_quality_rules_work_in_passes(spark, monkeypatch, tmp_path, common):
    """Several passes and ranges of texts, common n-grams or none: the sums of one pass, and no hashes of words left on disk."""
    rng = random.Random(31)
    rows = [(i, words(rng, 30, 40) if i % 3 else words(rng, 10, 40) + " " + words(rng, 20, 40).replace("w", "v")) for i in range(60)]
    rows += [(70 + i, "a b a b a b " + rows[i][1]) for i in range(8)] + [(90, rows[4][1]), (91, rows[4][1]), (92, None), (93, "one"), (94, " ")]
    quality = {i: int(i % 3 > 0) for i in range(0, 60, 2)} | {91: 1}
    labels = spark.createDataFrame([(i, k, 0) for i, k in quality.items()], "doc_id long, quality int, toxic int")
    for name, value in (("PASSES", 3), ("PASS_GRAMS", 1), ("RANGES", 2), ("RANGE_ROWS", 1), ("SAMPLE", 16), ("COMMON", common)):
        monkeypatch.setattr(quality_rules, name, value)
    monkeypatch.setattr("turnstile.session.shared_dir", lambda spark: str(tmp_path))
    got = {r.doc_id: (r.score, r.kept) for r in quality_rules.judge(frame(spark, rows), labels).collect()}
    scores, kept = brute_rules(rows, quality)
    assert {i: k for (i, _), k in zip(rows, kept)} == {i: bool(k) for i, (_, k) in got.items()}
    assert [-1e9 if got[i][0] is None else got[i][0] for i, _ in rows] == pytest.approx([-1e9 if x is None else x for x in scores], abs=1e-9)
    assert {x.name.split("-")[0] for x in (tmp_path / "turnstile").iterdir()} == {"sums", "scored"}


def test_quality_rules_weigh_common_grams_where_a_text_lies(spark, monkeypatch, tmp_path):
    """Runs of every length are told without a shuffle, in long texts too, and the list of common n-grams is bounded."""
    monkeypatch.setattr("turnstile.session.shared_dir", lambda spark: str(tmp_path))
    rng = random.Random(44)
    lists = [[], [5], [7] * 300, [rng.randrange(-3, 3) for _ in range(5000)], list(range(40)) * 3]
    texts = spark.createDataFrame([(i, i, 1, i % 2, x) for i, x in enumerate(lists)], "_id long, _key long, copies long, trusted long, hashes array<long>")
    runs = quality_rules._runs(texts)
    assert "Exchange" not in runs._jdf.queryExecution().executedPlan().toString()
    rows = quality_rules._grams(texts).groupBy("_id", "trusted", "gram").agg(F.count("*").alias("n"))
    assert Counter(map(tuple, runs.collect())) == Counter(map(tuple, rows.collect()))
    monkeypatch.setattr(quality_rules, "COMMON", 1)
    monkeypatch.setattr(quality_rules, "LISTED", 8)
    totals = quality_rules.common(texts, len(lists)).collect()
    raw = {r.gram: (r.raw, r.target) for r in quality_rules._grams(texts).groupBy("gram").agg(
        F.sum("copies").alias("raw"), F.sum("trusted").alias("target")).collect()}
    assert 0 < len(totals) <= 8 and all(raw[r.gram] == (r.all_raw, r.all_target) for r in totals)


def test_quality_rules_judge_alike_at_every_size(spark):
    rng = random.Random(18)
    junk = [f"buy{k}" for k in range(40)]
    rows = []
    for i in range(800):  # every fourth is low quality, every third has a label; the first 80 are the small table
        text = words(rng, 120, 500).split(" ")
        rows.append((i, " ".join(rng.choice(junk) if i % 4 == 0 and rng.random() < 0.4 else w for w in text)))
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 800, 3)], "doc_id long, quality int, toxic int")
    verdicts = [{r.doc_id: r.kept for r in quality_rules.judge(frame(spark, rows[:n]), labels.where(f"doc_id < {n}")).collect()} for n in (80, 800)]
    for got in verdicts:
        assert got == {i: i % 4 != 0 for i in got}, Counter((i % 4 != 0, i % 3 == 0, k) for i, k in got.items())
    assert all(verdicts[1][i] == k for i, k in verdicts[0].items())


# 9 ---------------------------------------------------------------------------------------------------------------


def brute_components(rows, size, percent=80):
    sets = {}
    for i, t in rows:
        found = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(found[k:k + size]) for k in range(len(found) - size + 1)} or ({tuple(found)} if found else set())
    links, holders = defaultdict(set), defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    shared = Counter((a, b) for h in holders.values() for a in h for b in h if a < b)
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            links[a].add(b)
            links[b].add(a)
    reach = reachable(links)
    return {i: (len(s), reach.get(i, i)) for i, s in sets.items()}


@pytest.mark.parametrize("limits", [(64, 1500), (3, 20)])
def test_bottomk(spark, monkeypatch, limits):
    monkeypatch.setattr(bottomk, "LIST", limits[0])
    monkeypatch.setattr(bottomk, "BLOCK_DOCS", limits[1])
    rng = random.Random(9)
    rows = [(r.doc_id, r.text) for r in C.read(spark, SF, "documents").collect()]
    for n, copies, edits in ((150, 60, 12), (400, 20, 20), (30, 20, 2), (6, 10, 1)):
        source = words(rng, n, 5000).split(" ")
        for _ in range(copies):
            copy = list(source)
            for _ in range(rng.randrange(edits + 1)):
                copy[rng.randrange(n)] = f"e{rng.randrange(10**6)}"
            rows.append((10_000 + len(rows), " ".join(copy).title() if rng.random() < 0.1 else " ".join(copy)))
    rows += [(20_000 + i, t) for i, t in enumerate(ODD)]
    docs = frame(spark, rows)
    for size in (2, 5):
        want = brute_components(rows, size)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in bottomk.near_duplicates(docs, words=size).collect()}
        assert got == want


@pytest.mark.parametrize("limit", [1, 64])
def test_bottomk_of_one_id_with_two_texts(spark, monkeypatch, limit):
    monkeypatch.setattr(bottomk, "LIST", limit)
    rng = random.Random(6)
    a, b, alone = (words(rng, 60, 10**6) for _ in range(3))
    rows = [(1, a), (2, a + " x"), (2, alone), (2, b), (5, b + " y"), (5, a + " z"), (5, a + " z"), (5, a.upper() + "  z")]
    out = sorted((r.doc_id, r.component_id, r.kept) for r in bottomk.near_duplicates(frame(spark, rows), words=2).collect())
    assert out == sorted([(1, 1, True), (2, 1, False), (2, 2, True), (2, 2, True), (5, 2, False), *[(5, 1, False)] * 3])
    assert sorted((r.doc_id, r.text) for r in bottomk.keep_one(frame(spark, rows), words=2).collect()) == sorted([(1, a), (2, alone), (2, b)])
    both = bottomk.keep_one(frame(spark, [(3, a), (3, a + " x"), (3, a), (3, a.upper())]), words=2).collect()
    assert len(both) == 1 and both[0].text.lower().startswith(a)


def test_training_rows_are_bounded_by_ids(spark):
    docs = spark.range(5_000).selectExpr("7L as doc_id", "concat('text ', id) as text").unionAll(spark.range(3).selectExpr("id", "'other'"))
    sample = spark.createDataFrame([(7, 1), (1, 0)], "doc_id long, label int")
    assert sorted(map(tuple, C.with_text(docs, sample).collect())) == [("other", 0), ("text 0", 1)]


def test_bottomk_odd_rows(spark):
    out = bottomk.near_duplicates(odd_docs(spark), words=2).collect()
    assert len(out) == odd_docs(spark).count() and all(r.kept for r in out)
    assert [r.component_id for r in out if r.doc_id is None] == [None]
    stays = bottomk.keep_one(frame(spark, [(2, "a b c d e f g"), (1, "A b c d e f g"), (1, "A b c d e f g"), (None, "x"), (3, None), (4, "")]))
    assert stays.columns == odd_docs(spark).columns and sorted(str(r.doc_id) for r in stays.collect()) == ["1", "3", "4", "None"]
    assert bottomk.near_duplicates(empty(spark)).count() == 0


# 10 --------------------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton():
    lexicon = [("idiot", True), ("abba", True), ("abbab", True), ("stem", False), ("longer", False)]
    machine = toxicity.automaton(lexicon, frozenset())
    rng = random.Random(10)
    tried = {"".join(rng.choice("abdiotsemlngrx") for _ in range(rng.randrange(1, 9))) for _ in range(3000)}
    for term, _ in lexicon:
        for k in range(len(term) + 1):
            tried |= {term[:k] + term[k + 1:], term[:k] + "x" + term[k:], term[:k] + "x" + term[k + 1:], term + "xyz", term[:k] + "x" + term[k + 1:] + "yz"}
    tried -= {""}
    for word in sorted(tried):
        best = None
        for number, (term, whole) in enumerate(lexicon):
            away = distance(word, term) if whole else min(distance(word[:k], term) for k in range(len(word) + 1))
            if away == 0 or (away == 1 and len(term) >= toxicity.FUZZY_LETTERS):
                best = min(best or (9, 9), (away, number))
        found, _ = toxicity.matches(machine, [word])
        assert (tuple(found[0, [2, 1]]) if len(found) else None) == best, word


def test_quotation():
    beyond = "\U0001E922\U0001E923\U0001E924\U0001E925\U0001E926"  # letters beyond the first 65,536 code points, and their capitals
    found, count = toxicity.matches(toxicity.automaton([(beyond, True)]), [f"{beyond.swapcase()} {beyond[:3]}", f"a {beyond}b c", "\U0001F600"])
    assert found.tolist() == [[0, 0, 0, 0], [1, 0, 1, 0]] and count.tolist() == [2, 3, 0]
    machine = toxicity.automaton([("idiot", True)])
    found, count = toxicity.matches(machine, ["You IDIOT, go", 'he said "idiot" twice', "", "idoit iddiot", 'a " far' + " x" * 60 + " idiot"])
    assert found.tolist() == [[0, 0, 0, 0], [1, 0, 0, 1], [3, 0, 1, 0], [4, 0, 0, 0]] and count.tolist() == [3, 4, 0, 2, 63]


def test_toxicity(spark):
    docs, labels = C.read(spark, "/root/testdata/sf0.01", "documents"), C.read(spark, "/root/testdata/sf0.01", "labels")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) >= 0.93
    assert toxicity.score(odd_docs(spark), model).where("predicted = 1").count() == 0
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.score(docs.limit(3), none).collect()} == {0.0}
    assert toxicity.score(empty(spark), model).count() == 0


def test_toxicity_tells_copies_by_the_whole_text(spark):
    rng = random.Random(20)
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5]

    def lexicon(texts):
        docs = frame(spark, [(i, t) for i, (t, _) in zip(ids, texts, strict=False)])
        labels = spark.createDataFrame([(i, 1, toxic) for i, (_, toxic) in zip(ids, texts, strict=False)], "doc_id long, quality int, toxic int")
        return {text for text, _ in toxicity.train(docs, labels).lexicon}

    alike = [("Re: your post " + words(rng, 30) + " grobble" * (k % 2), k % 2) for k in range(120)]
    assert "grobble" in lexicon(alike)  # one opening, many documents
    clean = [(words(rng, 30), 0) for _ in range(110)]
    own = [(words(rng, 30) + " grobble", 1) for _ in range(8)]
    found = lexicon([*clean, *own, *[(words(rng, 30) + " florp", 1)] * 100])
    assert "grobble" in found and "florp" not in found  # copies are one document, also among all


# pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    docs = C.read(spark, SF, "documents").withColumn("extra", C.F.lit("x"))
    left = docs
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, path = left, scratch_path(spark, "stage")
        stage(spark, left, SF).write.parquet(path)
        left = spark.read.parquet(path)
        if number < 4:
            assert left.columns == docs.columns and 0 < left.count() <= before.count()
            assert left.join(before, "doc_id", "left_anti").count() == 0
    labelled = left.select("doc_id").distinct().join(C.read(spark, SF, "labels"), "doc_id")
    assert labelled.where("quality = 1").count() > 5 * labelled.where("quality = 0").count()
    run = corpus_pipeline.run(spark, SF)
    assert run.columns == left.columns and run.count() == left.count()
