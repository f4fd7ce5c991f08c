"""Quality rules by weak supervision, with DataFrame functions only.

Each rule looks at counts of a text and votes good (1), bad (-1) or abstains (0). A text's votes are one of at most
3 ** len(RULES) patterns; their counts, gathered in one row, are all that expectation-maximisation reads. It
estimates the share of good texts and each rule's accuracy: how often it votes good, and bad, on texts of either kind.
A vote counts by the ratio of its two rates, and only for what it says: rules are taken to be no worse than chance,
and abstaining says nothing. With these limits the rounds are not a pure likelihood ascent; their number is fixed. A
pattern's posterior probability of good comes back to the texts by a broadcast join of that bounded table.

Null and blank texts have no words. Very long texts are counted whole; repeated windows are told by their words. Ties
and repeated rows do not matter: all is per row. An empty table is empty. Other columns pass through, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_key, whole_rows

BLANKS = " \t\n\x0b\f\r"
ROUNDS = 40
#: A text is kept from this posterior probability of good quality on.
KEEP = 0.5
LEAST_WORDS = 50
#: Start of the estimates: share of good texts; rates of good votes and of bad votes on good texts; the same on bad texts.
START = (0.8, 0.9, 0.02, 0.6, 0.3)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts"]


def votes(bad: Column, good: Column | None = None) -> Column:
    return F.when(bad, -1).when(F.lit(False) if good is None else good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    n, c = F.col("n_words"), F.col
    some = n > 0
    return {
        "length": votes(n < LEAST_WORDS),
        "repeated_windows": votes(some & (100 * c("n_repeat_words") > 50 * n)),
        "symbols": votes(some & (10 * c("n_symbols") > n)),
        "repeated_lines": votes((c("n_lines") > 1) & (10 * c("n_dup_lines") > 3 * c("n_lines"))),
        "word_length": votes(~some | (c("word_chars") < 2 * n) | (c("word_chars") > 12 * n)),
        "capitals": votes(10 * c("n_upper") > 3 * c("word_chars")),
        "shouting": votes(some & (10 * c("n_shouts") > 3 * n)),
        "prose": votes(F.lit(False), (n >= LEAST_WORDS) & (50 * c("n_symbols") <= n) & (100 * c("n_repeat_words") <= 25 * n) & (10 * c("n_upper") <= 2 * c("word_chars")) & (20 * c("n_shouts") <= n)),
    }


def without(text: str, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def counts(rows: DataFrame, *keep: str) -> DataFrame:
    """rows with `text` -> the columns `keep` and those of COUNTS."""
    n, windows = F.col("w_n"), F.col("w_hashes")
    out = rows.select(*[F.col(k).alias(f"k_{i}") for i, k in enumerate(keep)], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("w_text"))
    trimmed = F.btrim(F.col("w_text"), F.lit(BLANKS))
    out = out.withColumn("w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+")))
    # the few characters that rules count, found in one pass
    out = out.withColumn("w_marks", F.regexp_replace("w_text", "[^\\p{Lu}!#*$%&|<>]+", ""))
    out = out.withColumn("w_lines", F.filter(F.split("w_text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")).withColumn("w_n", F.size("w"))
    # the words of a window are looked up in place: zipping three shifted arrays would copy every word three times
    out = out.withColumn("w_hashes", F.expr("transform(slice(w, 1, greatest(w_n - 2, 0)), (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2)))"))
    # windows sorted by the high bits of their hash, with their place in the low ones: those that may be repeated
    out = out.withColumn("w_again", F.size(F.array_distinct(windows)) < F.size(windows)).withColumn("w_low", F.expr("shiftleft(1L, length(bin(w_n))) - 1"))
    out = out.withColumn("w_ranked", F.expr("CASE WHEN w_again THEN sort_array(transform(w_hashes, (h, i) -> (h & ~w_low) | CAST(i AS BIGINT))) END"))
    out = out.withColumn("w_maybe", F.expr("filter(transform(w_ranked, (v, i) -> IF(((v ^ get(w_ranked, i - 1)) & ~w_low) = 0 OR ((v ^ get(w_ranked, i + 1)) & ~w_low) = 0, v & w_low, -1L)), x -> x >= 0)"))
    # of those, equal ones side by side, told by their words
    out = out.withColumn("w_sorted", F.expr("sort_array(transform(w_maybe, x -> named_struct('h', get(w_hashes, int(x)), 'w', array(get(w, int(x)), get(w, int(x) + 1), get(w, int(x) + 2)), 'i', x)))"))
    out = out.withColumn("w_starts", F.expr("filter(transform(w_sorted, (v, i) -> IF((v.h = get(w_sorted, i - 1).h AND v.w = get(w_sorted, i - 1).w) OR (v.h = get(w_sorted, i + 1).h AND v.w = get(w_sorted, i + 1).w), v.i, -1L)), x -> x >= 0)"))
    covered = F.expr("aggregate(sort_array(w_starts), named_struct('n', 0L, 'last', -3L), (a, x) -> named_struct('n', a.n + least(3L, x - a.last), 'last', x), a -> a.n)")
    return out.select(
        *[F.col(f"k_{i}").alias(k) for i, k in enumerate(keep)],
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        without("w_marks", "[#*$%&|<>]").cast("bigint").alias("n_symbols"),
        (F.size("w_lines") - F.size(F.array_distinct("w_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("w_again"), covered).otherwise(F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size("w_lines").cast("bigint").alias("n_lines"),
        without("w_marks", "\\p{Lu}").cast("bigint").alias("n_upper"),
        without("w_marks", "!").cast("bigint").alias("n_shouts"),
    )


def pattern(cols: dict[str, Column]) -> Column:
    """The votes as one number, base 3."""
    return sum((v + 1) * 3**i for i, v in enumerate(cols.values())).cast("int")


def posteriors(patterns: DataFrame) -> DataFrame:
    """(pattern int) of all texts -> (pattern, quality): one row for each pattern that occurs."""
    k = len(rules())
    tally = patterns.groupBy("pattern").agg(F.count(F.lit(1)).cast("double").alias("n"))
    tally = tally.withColumn("v", F.array(*[(F.floor(F.col("pattern") / 3**i) % 3).cast("int") - 1 for i in range(k)]))
    one = tally.agg(F.array_sort(F.collect_list(F.struct("pattern", "n", "v"))).alias("p")).withColumn("k", F.sequence(F.lit(0), F.lit(k - 1)))
    # rules are taken to be no worse than chance, so a bad vote never speaks for a text, nor a good one against it
    # a, b: rates of good and bad votes on good texts; c, d: on bad texts
    odds = "aggregate(k, ln({m}.share / (1 - {m}.share)), (o, j) -> o + CASE get({v}, j) WHEN 1 THEN greatest(0D, ln(get({m}.a, j) / get({m}.c, j))) WHEN -1 THEN least(0D, ln(get({m}.b, j) / get({m}.d, j))) ELSE 0D END)"
    belief = "1 / (1 + exp(-" + odds + "))"
    start = "named_struct('share', {}D, 'a', array_repeat({}D, {k}), 'b', array_repeat({}D, {k}), 'c', array_repeat({}D, {k}), 'd', array_repeat({}D, {k}))".format(*START, k=k)
    soft = f"transform(p, x -> named_struct('v', x.v, 'n', x.n, 'g', {belief.format(m='m', v='x.v')}))"
    weight = {"g": "x.n * x.g", "b": "x.n * (1 - x.g)"}

    def rate(vote: int, of: str) -> str:  # add-one smoothing keeps every estimate inside (0, 1)
        return f"transform(k, j -> (1D + aggregate(s, 0D, (t, x) -> t + IF(get(x.v, j) = {vote}, {weight[of]}, 0D))) / (2D + aggregate(s, 0D, (t, x) -> t + {weight[of]})))"

    share = "(1D + aggregate(s, 0D, (t, x) -> t + x.n * x.g)) / (2D + aggregate(s, 0D, (t, x) -> t + x.n))"
    step = f"transform(array({soft}), s -> named_struct('share', {share}, 'a', {rate(1, 'g')}, 'b', {rate(-1, 'g')}, 'c', {rate(1, 'b')}, 'd', {rate(-1, 'b')}))[0]"
    fitted = one.withColumn("m", F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (m, i) -> {step})"))
    return fitted.select("k", "m", F.explode("p").alias("x")).select("x.pattern", F.expr(belief.format(m="m", v="x.v")).alias("quality"))


def judged(rows: DataFrame, scratch: Scratch, *keep: str) -> DataFrame:
    """rows with `text` -> the columns `keep`, COUNTS, base_failed, quality (posterior probability of good) and kept.

    The counts, narrow, are written between their two readers, so that texts are counted once.
    """
    seen = scratch.write("quality-counts", counts(rows, *keep).withColumn("pattern", pattern(rules())))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = seen.join(F.broadcast(posteriors(seen.select("pattern"))), "pattern").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP)).drop("pattern")


def kept(docs: DataFrame) -> DataFrame:
    """`docs` without the texts that the verdict rejects; their keys, not the texts, are written on the way."""
    scratch, rows = Scratch(docs.sparkSession), whole_rows(docs)
    rejected = scratch.write("quality-rejected", judged(rows, scratch, "d", "t").where(~F.col("kept")).select("d", "t").distinct())
    scratch.keep("quality-rejected")
    return rows.join(by_key(rejected), ["d", "t"], "left_anti").select("row.*")


def op9(docs: DataFrame) -> DataFrame:
    out = judged(docs.select("doc_id", "text"), Scratch(docs.sparkSession), "doc_id")
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept", "quality")
