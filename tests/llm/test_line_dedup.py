"""Line dedup against a plain comparison of every pair of documents, on texts instead of hashes."""

import random

import pytest

from turnstile.llm import line_dedup

MIN_WORDS = line_dedup.MIN_WORDS


def stretches(lines):
    """From each line on, the fewest lines that hold MIN_WORDS words."""
    for start in range(len(lines)):
        held = 0
        for end in range(start, len(lines)):
            held += len(lines[end].split())
            if held >= MIN_WORDS:
                yield tuple(lines[start:end + 1])
                break


def brute(docs):
    """What is left of each text, where no document holds a line twice: every longest common run of lines with MIN_WORDS words goes,
    and the blank lines inside it."""
    full = {i: [(n, x.strip()) for n, x in enumerate(text.split("\n")) if x.strip()] for i, text in docs}
    first = {}
    for i in sorted(full):
        for key in stretches([x for _, x in full[i]]):
            first.setdefault(key, i)
    left = {}
    for i, text in docs:
        b, gone = [x for _, x in full[i]], set()
        for earlier in {first[key] for key in stretches(b)} - {i}:
            a = [x for _, x in full[earlier]]
            for x in range(len(a)):
                for y in range(len(b)):
                    if a[x] == b[y] and not (x and y and a[x - 1] == b[y - 1]):
                        n = 0
                        while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                            n += 1
                        if sum(len(line.split()) for line in b[y:y + n]) >= MIN_WORDS:
                            gone.update(range(full[i][y][0], full[i][y + n - 1][0] + 1))
        left[i] = "\n".join(line for n, line in enumerate(text.split("\n")) if n not in gone)
    return left


def corpus(seed, n):
    """Documents of lines of their own and shared passages in any order, some cut short, with blank lines and short common ones."""
    rng = random.Random(seed)

    def line(words):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(words))

    passages = [[line(rng.choice((2, 7, 13, 24))) for _ in range(rng.randrange(1, 7))] for _ in range(12)]
    common = ["All rights reserved.", "Share this page", "Read more"]
    docs = []
    for number in rng.sample(range(10 * n), n):
        parts = [[line(rng.randrange(1, 12))] for _ in range(rng.randrange(0, 5))] + [[x] for x in common if rng.random() < 0.5]
        for passage in rng.sample(passages, rng.randrange(0, 4)):
            at = rng.randrange(len(passage))
            parts.append(passage if rng.random() < 0.6 else passage[at:])
        rng.shuffle(parts)
        lines = [x if rng.random() < 0.8 else f"  {x}\t" for part in parts for x in part]
        docs.append((number, "\n".join(x for line in lines for x in ((line, "") if rng.random() < 0.1 else (line,)))))
    return docs


def test_a_line_stands_once_in_each_document():
    """The plain version and the operator agree only there: with repeats, the alignment chooses among equal lines."""
    for _, text in corpus(1, 60):
        held = [x.strip() for x in text.split("\n") if x.strip()]
        assert len(held) == len(set(held))


@pytest.mark.parametrize("seed", [1, 2])
def test_what_is_left_is_that_of_the_plain_comparison(spark, seed):
    docs = corpus(seed, 150)
    want = brute(docs)
    assert sum(text != want[i] for i, text in docs) > 40  # there is something to delete
    got = line_dedup.removed(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == want
