r"""Chat formatting with Spark expressions only: turns sorted in an array, neighbours of one role merged, texts joined under a loss mask.

Template, a block for each run of neighbouring turns of one role:

    <|im_start|>role<|im_sep|>text<|im_next|>text of the next turn of this role<|im_end|>\n

Every mark begins with `<|`, which no escaped text holds: a backslash goes between `<` and `|`, and where backslashes stand there already, one
more. `unescaped` takes one away again, so any text comes back as it was, also one that looks like an escape. Roles are escaped alike.

The loss mask covers the texts of assistant turns, no marks: `marks` holds for each block its length and its spans (start, length) in code
points, starts counted from the block's own beginning. `read_back` takes the turns from the marks in the formatted text alone, and the loss
text from the spans alone, so that each checks the other.

Order: by turn, null first, then by role and by text in bytes. Rows that repeat are turns of their own. A null role or text is empty, a null
conv_id is a conversation like others, an empty table gives no rows; other columns are not read. A conversation becomes one value, as Spark
holds one: at most 2 GB. Rows of one conversation meet once, in its array; copies of a conversation under other ids are conversations of
their own, so none of them makes a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>"
LEARNED = "assistant"  # the role under the loss mask

_SPANS = "array<struct<start:int,length:int>>"
_BLOCKS = "split(formatted, r'<\\|im_start\\|>')"


def escaped(text: str) -> str:
    """SQL text: no `<|` is left in the value."""
    return rf"regexp_replace({text}, r'<(\\*)\|', r'<\\$1|')"


def unescaped(text: str) -> str:
    return rf"regexp_replace({text}, r'<\\(\\*)\|', r'<$1|')"


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, marks) of every conversation; marks: array of (chars, loss: spans), one for each block."""
    sorted_turns = turns.select("conv_id", F.struct("turn", F.expr("coalesce(role, '') as role"), F.expr("coalesce(text, '') as text")).alias("t")).groupBy(
        "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    starts = sorted_turns.selectExpr("conv_id", "t", "filter(sequence(0, size(t) - 1), i -> i = 0 or t[i].role <> t[greatest(i - 1, 0)].role) as starts")
    merged = starts.selectExpr("conv_id", f"""zip_with(starts, concat(slice(starts, 2, size(starts)), array(size(t))), (a, b) -> struct(
        t[a].role = '{LEARNED}' as learned, concat('{START}', {escaped('t[a].role')}, '{SEP}') as head,
        transform(slice(t, a + 1, b - a), x -> {escaped('x.text')}) as texts)) as blocks""")
    spans = f"""aggregate(b.texts, cast(array() as {_SPANS}), (s, x) -> concat(s, array(struct(
        if(size(s) = 0, length(b.head), s[greatest(size(s) - 1, 0)].start + s[greatest(size(s) - 1, 0)].length + {len(NEXT)}) as start,
        length(x) as length))))"""
    return merged.selectExpr("conv_id", f"""transform(blocks, b -> struct(
        concat(b.head, array_join(b.texts, '{NEXT}'), '{END}\\n') as text,
        if(b.learned, {spans}, cast(array() as {_SPANS})) as loss)) as blocks""").selectExpr(
            "conv_id", "array_join(blocks.text, '') as formatted", "transform(blocks, b -> struct(length(b.text) as chars, b.loss as loss)) as marks")


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns: array of (role, text), loss: array of texts) out of formatted texts and their marks."""
    parts = chats.selectExpr("conv_id", "formatted", "marks", f"slice({_BLOCKS}, 2, size({_BLOCKS})) as blocks")
    fields = parts.selectExpr("conv_id", "formatted", f"""flatten(zip_with(blocks, marks, (b, m) -> transform(m.loss,
        s -> {unescaped(f"substring(concat('{START}', b), s.start + 1, s.length)")}))) as loss""",
                              r"transform(blocks, b -> split(b, r'<\|im_(sep|end)\|>')) as fields")
    return fields.selectExpr("conv_id", "formatted", f"""flatten(transform(fields, f -> transform(split(f[1], r'<\\|im_next\\|>'),
        x -> struct({unescaped('f[0]')} as role, {unescaped('x')} as text)))) as turns""", "loss")


def digests(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_blocks), read back from the formatted texts."""
    joined = read_back(chats).selectExpr("conv_id", "formatted", "size(turns) as n_turns", "array_join(loss, '') as loss",
                                         "array_join(transform(turns, x -> concat(x.role, '\\n', x.text, '\\n')), '') as said")
    return joined.selectExpr("conv_id", "cast(n_turns as long) as n_turns", "sha2(said, 256) as turns_sha256",
                             "cast(length(loss) as long) as loss_chars", "sha2(loss, 256) as loss_sha256",
                             "cast(length(formatted) as long) as formatted_chars", f"cast(size({_BLOCKS}) - 1 as long) as n_blocks")
