"""Quality rules, in built-in functions only: base counts, and a hashed n-gram log-likelihood ratio of each document.

n-grams (words and pairs of words, as they stand) are told by a 64-bit hash, so their table grows with the corpus. Each is counted over all
rows: in the raw corpus, all documents, and in the trusted target, the documents whose label says good. For a document, its own n-grams are
taken out of both counts, so that labelled and unlabelled ones are judged alike. With e the count that the target would have if it were
drawn from the raw corpus, an n-gram weighs log((target + SMOOTHING) / (e + SMOOTHING)), rounded to whole units of 1 / UNIT, so that sums do
not depend on their order. One that no other document holds weighs 0, and a larger corpus brings the weights nearer to the true ratio. A
document's score is the mean weight of its n-grams.

The cut comes from the scores of all documents that pass the base rules: it is the middle between the mean of the trusted ones and the mean of
those labelled as not good. If none is, or those score no lower, it is SPREAD standard deviations below the trusted mean. Nothing is sampled.

Equal texts, told by a 64-bit hash, are brought together first, with the number of their rows: each distinct text is kept as the hashes of its
words and its base counts, its n-grams count as often as it has rows, and its sum is taken once and holds for all of them.

A sample of the texts, bounded like the list, shows which n-grams are common. Their totals are counted over all rows, with partial sums, and go to every task, so that
a text's common n-grams are weighed where it lies. The others, many times the input, are shuffled in up to PASSES passes, each over the n-grams
of one residue of their hash: every n-gram is in one pass with all its texts, sums of whole units add up over the passes, and what a pass
shuffled is deleted before the next. Either way totals are exact; the sample only chooses the way.

Nulls: a null text counts like one without words. Such a text fails the base rules. Rows that repeat a doc_id are judged as rows; labels
that repeat count once, as good if any says so. With no trusted document no ratio can be taken, all weights are 0 and the base rules
alone decide. Other columns are neither read nor, in `judge`, returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import prepare
from turnstile.session import materialise, materialise_parts, scratch_scope

SMOOTHING = 1.0
UNIT = 10_000
SPREAD = 3  # standard deviations below the trusted mean, where no lower class is labelled
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30  # per cent of the words
PASSES = 8  # over the n-grams that are not common
PASS_GRAMS = 4_000_000  # a corpus with fewer n-grams than this a pass takes fewer passes
RANGES = 4  # parts of the texts, by their hash, in which copies are brought together
RANGE_ROWS = 10_000  # and rows below which there are fewer parts
SAMPLE = 8_192  # texts, about, in which common n-grams are looked for
COMMON = 4  # of these hold a common one, or more
LISTED = 1 << 18  # common n-grams at most
DICTIONARY = 16 << 20  # bytes of the distinct word hashes of a file, below which it holds their numbers

_SPACE = "\\\\x20\\\\x09-\\\\x0D"
_BLANKS = " \\t\\n\\u000B\\u000C\\r"
_KEY = "xxhash64(coalesce(text, ''))"


def _shifted(column: str, by: int) -> str:
    """SQL text: the hashes of every element with the one `by` places on; the last ones stay alone."""
    return f"zip_with({column}, slice({column}, {by + 1}, size({column})), (a, b) -> xxhash64(a, b))"


#: Of two equal windows the later one has WINDOW - 3 runs of four words that were there before. With fewer no window is hashed.
_WINDOWS = f"case when size(_fours) - size(array_distinct(_fours)) >= {WINDOW - 3} then {_shifted('_fours', 4)} else array() end"
#: Windows with their places, sorted, so that equal ones stand side by side.
_SORTED = ("case when size(array_distinct(_windows)) < size(_windows) then array_sort(transform(_windows, (w, i) -> struct(w as w, i as i))) "
           "else array() end")
#: Places of the windows that are found twice or more, in order.
_TWICE = ("array_sort(transform(filter(_sorted, (x, k) -> (k > 0 and x.w = _sorted[greatest(k - 1, 0)].w) or "
          "(k < size(_sorted) - 1 and x.w = _sorted[least(k + 1, size(_sorted) - 1)].w)), x -> x.i))")
#: Each of those windows covers WINDOW words, or those up to the next one.
_COVERED = (f"cast(aggregate(zip_with(_twice, slice(_twice, 2, greatest(size(_twice) - 1, 0)), (a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))), "
            f"0, (s, n) -> s + n) as long)")
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measured(texts: DataFrame, *kept: str) -> DataFrame:
    """`kept`, the hashes of a text's words and its base counts. Each step carries only what later ones need, as it is copied in every step."""
    counts = [*kept, "hashes", *_BASE[:-1]]
    return (texts.selectExpr(*kept, "text", f"trim(BOTH '{_BLANKS}' FROM text) as _trimmed",
                             f"filter(split(text, '\\n'), x -> trim(BOTH '{_BLANKS}' FROM x) <> '') as _lines")
            .selectExpr(*kept, "text", "_lines", f"if(_trimmed = '', array(), split(_trimmed, '[{_SPACE}]+')) as _words")
            .selectExpr(*kept, "transform(_words, w -> xxhash64(w)) as hashes", "cast(size(_words) as long) as n_words",
                        "cast(length(concat_ws('', _words)) as long) as word_chars",
                        "cast(length(regexp_replace(text, '[^#*$%&|<>]+', '')) as long) as n_symbols",
                        "cast(size(_lines) - size(array_distinct(_lines)) as long) as n_dup_lines")
            .selectExpr(*counts, f"if(n_words < {WINDOW + 1}, array(), {_shifted('hashes', 1)}) as _pairs")
            .selectExpr(*counts, f"{_shifted('_pairs', 2)} as _fours")
            .selectExpr(*counts, f"{_WINDOWS} as _windows").selectExpr(*counts, f"{_SORTED} as _sorted")
            .selectExpr(*counts, f"{_TWICE} as _twice").selectExpr(*counts, f"{_COVERED} as n_repeat_words"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(trusted_id): the documents of the trusted target, those labelled as good."""
    return labels.where("quality = 1 and doc_id is not null").selectExpr("cast(doc_id as long) as trusted_id").distinct()


def distinct_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(_id, _key, copies, trusted, hashes, base counts): every text once, the number of its rows, of those in the trusted target, and its words.

    _id is a number of the text: shorter than its hash when compressed.
    """
    # The labels grow with the corpus: one plan at every size. Texts stay where they are, only ids and keys meet the labels.
    known = docs.selectExpr("cast(doc_id as long) as _id", f"{_KEY} as _known").join(trusted_ids(labels).hint("merge"), F.expr("_id = trusted_id"))
    trusted = materialise(known.groupBy("_known").agg(F.count("*").alias("_n")), "trusted")
    ranges = min(RANGES, 1 + docs.count() // RANGE_ROWS)

    def part(k: int) -> DataFrame:
        texts = (docs.select(F.expr(_KEY).alias("_key"), F.expr("coalesce(text, '') as text")).where(f"pmod(_key, {ranges}) = {k}")
                 .groupBy("_key").agg(F.first("text").alias("text"), F.count("*").alias("copies")))
        joined = texts.join(trusted.where(f"pmod(_known, {ranges}) = {k}").hint("merge"), F.expr("_key = _known"), "left")
        return _measured(joined.selectExpr("_key", "copies", "coalesce(_n, 0L) as trusted", "text"), "_key", "copies", "trusted").selectExpr(
            f"monotonically_increasing_id() * {ranges} + {k} as _id", "*")

    return materialise_parts((part(k) for k in range(ranges)), "texts", **{"parquet.dictionary.page.size": DICTIONARY})


def _grams(texts: DataFrame, kept: str = "true") -> DataFrame:
    """(_id, copies, trusted, gram): the words and pairs of words of every text, in a row each, where `kept` says so of `gram`."""
    either = " or ".join(f"coalesce({re.sub(r'\bgram\b', name, kept)}, false)" for name in ("word", "pair"))
    return (texts.selectExpr("_id", "copies", "trusted", "hashes", "posexplode(hashes) as (at, word)")
            .selectExpr("_id", "copies", "trusted", "word", "get(hashes, at + 1) as next")
            .selectExpr("_id", "copies", "trusted", "word", "if(next is null, null, xxhash64(word, next)) as pair").where(either)
            .selectExpr("_id", "copies", "trusted", "explode(array(word, pair)) as gram").where(f"gram is not null and {kept}"))


def _runs(texts: DataFrame) -> DataFrame:
    """(_id, trusted, gram, n): every n-gram of a text once, and how often the text holds it: the length of its run in sorted order.

    An outer explode, as an inner one would have the array made twice: once to see whether it is empty.
    """
    pairs = texts.where("size(hashes) > 1").selectExpr("_id", "trusted", f"slice({_shifted('hashes', 1)}, 1, greatest(size(hashes) - 1, 0)) as grams")

    def runs(rows: DataFrame) -> DataFrame:
        ends = "filter(sequence(1, greatest(size(grams), 1)), i -> i = size(grams) or get(grams, i) <> get(grams, i - 1)) as ends"
        return (rows.selectExpr("_id", "trusted", "sort_array(grams) as grams").selectExpr("_id", "trusted", "grams", ends)
                .selectExpr("_id", "trusted", "grams", "ends", "posexplode_outer(ends) as (at, end)").where("end is not null")
                .selectExpr("_id", "trusted", "get(grams, end - 1) as gram", "cast(end - coalesce(get(ends, at - 1), 0) as long) as n"))

    return runs(texts.where("size(hashes) > 0").selectExpr("_id", "trusted", "hashes as grams")).unionAll(runs(pairs))


def common(texts: DataFrame, n_texts: int) -> DataFrame:
    """(gram, all_raw, all_target): the totals of n-grams that COMMON of about SAMPLE sampled texts hold, or more; the LISTED most frequent.

    Bounded by LISTED, whatever the corpus.
    """
    sample = texts.where(f"pmod(_key, {max(1, n_texts // SAMPLE)}) = 0")
    held = (sample.selectExpr("explode_outer(array_distinct(hashes)) as gram")
            .unionAll(sample.where("size(hashes) > 1").selectExpr(f"slice({_shifted('hashes', 1)}, 1, greatest(size(hashes) - 1, 0)) as grams")
                      .selectExpr("explode_outer(array_distinct(grams)) as gram")).where("gram is not null"))
    counts = materialise(held.groupBy("gram").agg(F.count("*").alias("n")).where(f"n >= {COMMON}"), "counts")
    least, listed = COMMON, 0
    for r in sorted(counts.groupBy(F.expr("least(n, 1000)").alias("n")).agg(F.count("*").alias("grams")).collect(), key=lambda r: -r.n):
        listed += r.grams
        if listed > LISTED:
            least = r.n + 1
            break
    chosen = materialise(counts.where(f"n >= {least}").select("gram"), "common")
    return materialise(_grams(texts).join(F.broadcast(chosen), "gram", "left_semi").groupBy("gram")
                       .agg(F.sum("copies").alias("all_raw"), F.sum("trusted").alias("all_target")), "totals")


def sums(texts: DataFrame) -> DataFrame:
    """(_id, _plain, _own): by text, the summed weights as of an unlabelled and, if one of its rows is trusted, as of a trusted document.

    N-grams that no other document holds have no weight. A text without any other has no row.
    """
    length = "cast(greatest(2 * size(hashes) - 1, 0) as long)"  # words and pairs of them
    raws, targets, n_texts = texts.agg(F.expr(f"sum({length} * copies)"), F.expr(f"sum({length} * trusted)"), F.count("*")).first()
    if not targets:
        return texts.sparkSession.createDataFrame([], "_id long, _plain long, _own long")
    share = targets / raws
    passes = min(PASSES, 1 + raws // PASS_GRAMS)
    totals = common(texts, n_texts)

    def weight(target: str) -> str:
        return f"cast(rint({UNIT} * ln(({target} + {SMOOTHING}D) / ((raw - n) * {share!r}D + {SMOOTHING}D))) as long)"

    def summed(rows: DataFrame, times: str) -> DataFrame:
        return (rows.where("raw > n").selectExpr("_id", f"{times} * {weight('target')} as plain",
                                                 f"if(trusted > 0, {times} * {weight('greatest(target - n, 0)')}, null) as own")
                .groupBy("_id").agg(F.sum("plain").alias("_plain"), F.sum("own").alias("_own")))

    def part(k: int) -> DataFrame:
        """A row for every place of an n-gram in a text, so each counts once."""
        own = F.broadcast(totals.where(f"pmod(gram, {passes}) = {k}").select("gram"))
        return summed(_grams(texts, f"pmod(gram, {passes}) = {k}").join(own, "gram", "left_anti")
                      .selectExpr("*", "sum(copies) over (partition by gram) as raw", "sum(trusted) over (partition by gram) as target").where("raw > 1").selectExpr("*", "count(*) over (partition by gram, _id) as n"), "1L")

    def parts() -> Iterator[DataFrame]:
        yield summed(_runs(texts).join(F.broadcast(totals), "gram").withColumnsRenamed({"all_raw": "raw", "all_target": "target"}), "n")
        yield from (part(k) for k in range(passes))

    return (materialise_parts(parts(), "sums", outlives=True)
            .groupBy("_id").agg(F.sum("_plain").alias("_plain"), F.sum("_own").alias("_own")))


def judge(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept) for every row of `docs`.

    score is the mean weight of the document's n-grams in natural logarithms, null without words. The other columns are as named in the
    module: characters are code points, repeated words are those in windows of WINDOW words found twice or more, the first included.
    A row is kept if its score is at least `threshold`, or the cut that the scores give.
    """
    return _judged(docs.select("doc_id", "text"), labels, threshold).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept")


def _judged(docs: DataFrame, labels: DataFrame, threshold: float | None) -> DataFrame:
    """The columns of `judge` and _key, the hash of the text."""
    prepare(docs.sparkSession)
    scored = _scored(docs, labels)
    cut = _cut(scored) if threshold is None else round(threshold * UNIT)
    return (scored.withColumn("score", F.expr(f"case when _n > 0 then _sum / _n / {UNIT} end"))
            .withColumn("kept", F.expr(f"not base_failed and _sum >= {cut!r} * _n")))


def _cut(scored: DataFrame) -> float:
    """The least mean weight of a kept document, in units of 1 / UNIT."""
    unit = "cast(round(_sum / _n) as decimal(19, 0))"  # whole numbers, whose sums do not depend on their order
    said = {r.quality: r for r in scored.where("not base_failed and _n > 0 and quality is not null").groupBy("quality").agg(
        F.expr(f"sum({unit})").alias("total"), F.expr(f"sum({unit} * {unit})").alias("squares"), F.count("*").alias("n")).collect()}
    if 1 not in said:
        return 0
    means = {k: float(r.total) / r.n for k, r in said.items()}
    if 0 in means and means[0] < means[1]:
        return (means[0] + means[1]) / 2
    return means[1] - SPREAD * max(0.0, float(said[1].squares) / said[1].n - means[1] ** 2) ** 0.5


def _scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, _key, base columns, quality, _n, _sum): what holds for a text holds for all of its rows."""
    with scratch_scope(docs.sparkSession):  # the hashes of all words are as large as the input
        texts = distinct_texts(docs, labels)
        judged = texts.select("_id", "_key", *_BASE).join(sums(texts).hint("merge"), "_id", "left").drop("_id")
        said = (labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.expr("cast(doc_id as long)").alias("_id"))
                .agg(F.max(F.expr("cast(quality as int)")).alias("quality")))
        rows = (docs.select("doc_id", F.expr(_KEY).alias("_key")).join(said.hint("merge"), F.expr("cast(doc_id as long) = _id"), "left").drop("_id")
                .join(judged.hint("merge"), "_key")
                .withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words"))
                .withColumn("_n", F.expr("n_words + greatest(n_words - 1, 0)"))
                .withColumn("_sum", F.expr("coalesce(case when quality = 1 then _own else _plain end, 0L)")).drop("_plain", "_own"))
        return materialise_parts([rows], "scored", outlives=True)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """The rows of `docs` that are kept, with their columns."""
    kept = _judged(docs.select("doc_id", "text"), labels, threshold).where("kept").selectExpr("doc_id as _id", "_key").distinct()
    return (docs.withColumn("_hash", F.expr(_KEY)).join(kept.hint("merge"), F.expr("_hash = _key and doc_id <=> _id"), "left_semi")
            .select(*docs.columns))
