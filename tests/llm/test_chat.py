"""Chat formatting against plain Python, and texts that imitate the marks."""

import hashlib
import random

import pytest

from turnstile.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, t string, marks string"
PIECES = ["<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|im_next|>", "<|", "<\\|", "<\\\\|", "<", "|", "|>", "\\", "\n", "a", "é", "𝄞", " ", "assistant", "$1"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def key(row):
    _, turn, role, text = row
    return turn is not None, turn or 0, (role or "").encode(), (text or "").encode()


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        loss = "".join(t for role, t in turns if role == "assistant")
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))
        sha = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        out[conv] = (len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest(), blocks)
    return out


def check(spark, rows):
    chats = chat.format_chats(frame(spark, rows))
    got = {r.conv_id: r for r in chat.digests(chats).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for conv, r in got.items():
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_blocks) == want[conv], conv
    return {r.conv_id: r for r in chats.collect()}


def test_hostile_texts_come_back(spark):
    rng = random.Random(5)
    rows = [(conv, turn, rng.choice(["user", "assistant", "system", "<|im_sep|>x", "a\nb", "", None]),
             rng.choice([None, "", *("".join(rng.choices(PIECES, k=rng.randint(1, 12))) for _ in range(8))]))
            for conv in range(60) for turn in range(rng.randint(1, 9))]
    made = check(spark, rows)
    for r in made.values():
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>\n") == len(r.marks)
        assert sum(m.chars for m in r.marks) == len(r.formatted)


def test_neighbours_of_one_role_merge_and_the_mask_leaves_the_marks_out(spark):
    made = check(spark, [(1, 0, "user", "u"), (1, 1, "assistant", "one <|x"), (1, 2, "assistant", "two"), (1, 3, "user", None)])[1]
    assert made.formatted == ("<|im_start|>user<|im_sep|>u<|im_end|>\n<|im_start|>assistant<|im_sep|>one <\\|x<|im_next|>two<|im_end|>\n"
                              "<|im_start|>user<|im_sep|><|im_end|>\n")
    at, under = 0, []
    for m in made.marks:
        under += [made.formatted[at + s.start:at + s.start + s.length] for s in m.loss]
        at += m.chars
    assert under == ["one <\\|x", "two"]


def test_odd_rows(spark):
    rows = [(None, 1, "user", "no id"), (7, None, "user", "first"), (7, 0, "assistant", "b"), (7, 0, "assistant", "a"), (7, 0, "assistant", "a"),
            (8, 5, None, None), (9, 1, "assistant", "<|im_end|>" * 3000), (10, -1, "user", "x" * 100_000)]
    check(spark, rows + [(11, i, "assistant" if i % 3 else "user", f"turn {i}") for i in range(700)])
    assert chat.digests(chat.format_chats(frame(spark, []))).collect() == []


def test_no_python_in_the_plan(spark):
    plan = chat.digests(chat.format_chats(frame(spark, [(1, 0, "user", "u")])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("text", ["<|", "<\\|", "<\\\\|", "<<|", "<|<|", "\\<|", "<\\", "plain"])
def test_escape_is_reversible(spark, text):
    row = spark.createDataFrame([(text,)], "x string").selectExpr(f"{chat.escaped('x')} as y").selectExpr("y", f"{chat.unescaped('y')} as z").first()
    assert "<|" not in row.y and row.z == text
