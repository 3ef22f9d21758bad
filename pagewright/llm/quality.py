"""Quality rules: a decision list learned by sequential covering.

The statistics of every text are Spark expressions.  On a bounded sample of labelled texts, rules
against the bad class are learned one after the other: a conjunction of threshold conditions is
grown on two thirds of the rows by information gain, its last conditions are pruned as long as that
helps on the other third, and the rows it covers are set aside.  The list is emitted as an ordered
Spark conditional expression; texts that no rule meets are kept.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_CHARS, words

#: Labelled rows that are learned from at most, those first by a hash of their id.
TRAIN_ROWS = 8000
SYMBOLS = "#*$%&|<>"

#: The statistics that rules may test: name, expression over the columns of ``statistics``.
FEATURES: dict[str, str] = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "mean_word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_word_share": "n_distinct / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "exclaims_per_word": "n_exclaims / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def _without(text: Column, chars: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), chars, text)


def statistics(docs: DataFrame) -> DataFrame:
    """Adds the statistics of whole texts to ``docs`` (text, ...); columns with their names are replaced.

    n_words, word_chars (code points in words), n_symbols, n_lines (\\n-split lines with a word),
    n_dup_lines (those equal to an earlier one), n_repeat_words (words in three-word windows found
    twice or more in the text), n_distinct (different words), n_upper, n_digits, n_exclaims: long.  A null text counts as empty.

    Repeated windows are found by sorting the windows of a text by their 64-bit hash, so the work
    grows as n log n with the length of a text, however often it repeats itself; two windows of a text of n words
    are taken for equal by chance with a probability of about n * n / 2 ** 65.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_digits", "n_exclaims"]
    keep = [f"`{c}`" for c in docs.columns if c not in own]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = lambda c: F.size(c).cast("long")
    dense = docs.select(*keep, text.alias("__text"), words(text).alias("__words"))
    lines = F.filter(F.split("__text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    dense = dense.select(
        *keep, "__words", lines.alias("__lines"), _without(F.col("__text"), WHITE_CHARS).alias("__chars"),
        F.expr("CASE WHEN size(__words) >= 3 THEN sort_array(transform(sequence(1, size(__words) - 2), i -> struct(xxhash64(__words[i - 1], __words[i], __words[i + 1]) AS h, i AS p))) ELSE array() END").alias("__windows"),
    )
    dense = dense.withColumn(
        "__at",
        F.expr(
            "sort_array(transform(filter(__windows, (x, i) -> (i > 0 AND __windows[greatest(i - 1, 0)].h = x.h) OR (i < size(__windows) - 1 AND __windows[least(i + 1, size(__windows) - 1)].h = x.h)), x -> x.p))"
        ),
    )
    chars = F.col("__chars")
    count = lambda drop: (F.length(chars) - F.length(drop)).cast("long")
    covered = "CASE WHEN size(__at) = 0 THEN 0 WHEN size(__at) = 1 THEN 3 ELSE aggregate(sequence(1, size(__at) - 1), 3, (n, j) -> n + least(3, __at[j] - __at[j - 1])) END"
    return dense.select(
        *keep,
        size("__words").alias("n_words"),
        F.length(chars).cast("long").alias("word_chars"),
        count(_without(chars, SYMBOLS)).alias("n_symbols"),
        size("__lines").alias("n_lines"),
        (size("__lines") - size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        F.expr(covered).cast("long").alias("n_repeat_words"),
        size(F.array_distinct("__words")).alias("n_distinct"),
        count(F.regexp_replace(chars, r"\p{Lu}", "")).alias("n_upper"),
        count(_without(chars, "0123456789")).alias("n_digits"),
        count(_without(chars, "!")).alias("n_exclaims"),
    )


def base_failed() -> Column:
    """The base rule: fewer than 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: A condition: feature, whether values above the threshold meet it (else those up to it), threshold.
Condition = tuple[str, bool, float]


def learn(rows: list[dict[str, float]], bad: list[bool], cuts: int = 48, least: int = 5, precision: float = 0.9, most_conditions: int = 4, most_rules: int = 24) -> list[list[Condition]]:
    """Rules against the bad rows, in order, each a conjunction of conditions.

    A rule stands if, on the rows set apart for pruning, at least ``precision`` of what it covers is
    bad, and if it covers ``least`` bad rows of all.  Sets of rows are the bits of integers.
    """
    if not rows:
        return []
    n = len(rows)
    everyone = (1 << n) - 1
    wrong = sum(1 << i for i, b in enumerate(bad) if b)
    meets: dict[Condition, int] = {}
    for f in rows[0]:
        values = sorted(r[f] for r in rows)
        for t in sorted({values[min(n - 1, (n * k) // cuts)] for k in range(cuts)}):
            above = sum(1 << i for i, r in enumerate(rows) if r[f] > t)
            if above and above != everyone:
                meets[f, True, t], meets[f, False, t] = above, everyone & ~above
    grow_part = sum(1 << i for i in range(n) if i % 3)
    left, rules = everyone, []
    while len(rules) < most_rules and (left & wrong).bit_count() >= least:
        rule: list[Condition] = []
        covered = left & grow_part
        while len(rule) < most_conditions:
            p0, n0 = (covered & wrong).bit_count(), covered.bit_count()
            if not p0 or p0 == n0:
                break
            base = math.log2(p0 / n0)
            best, gain = None, 1e-9
            for condition, met in meets.items():
                now = covered & met
                p1 = (now & wrong).bit_count()
                if p1 >= least and (g := p1 * (math.log2(p1 / now.bit_count()) - base)) > gain:
                    best, gain = condition, g
            if best is None:
                break
            rule.append(best)
            covered &= meets[best]

        def worth(conditions: list[Condition]) -> float:
            now = reduce(lambda s, c: s & meets[c], conditions, left & ~grow_part)
            p, m = (now & wrong).bit_count(), now.bit_count()
            return (2 * p - m) / m if m else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        if not rule:
            break
        now = reduce(lambda s, c: s & meets[c], rule, left)
        apart = now & ~grow_part
        if (now & wrong).bit_count() < least or (apart & wrong).bit_count() < precision * max(1, apart.bit_count()) or (now & wrong).bit_count() < precision * now.bit_count():
            break
        rules.append(rule)
        left &= ~now
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as an ordered conditional expression over the columns of ``statistics``: false where a rule is met."""
    met = [reduce(lambda a, b: a & b, (F.expr(FEATURES[f]) > t if above else F.expr(FEATURES[f]) <= t for f, above, t in rule)) for rule in rules]
    if not met:
        return F.lit(True)
    return reduce(lambda case, m: case.when(m, F.lit(False)), met[1:], F.when(met[0], F.lit(False))).otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, **options) -> list[list[Condition]]:
    """Learn rules from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality 0 or 1), at most ``train_rows`` labelled rows.

    A row labelled twice counts as good if one label says so; rows without label or id aren't learned from, and of
    rows with one id the text first in order is.
    """
    sample = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("__quality"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # The sample is bounded by train_rows, so it can be broadcast.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    once = docs.select("doc_id", text.alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("__quality").alias("__quality"))
    known = statistics(once)
    rows = known.select("doc_id", "__quality", *(F.expr(e).alias(f) for f, e in FEATURES.items())).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return learn([{f: float(r[f]) for f in FEATURES} for r in rows], [r["__quality"] == 0 for r in rows], **options)


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """Adds the statistics, ``base_failed`` and ``kept`` to ``docs`` (text, ...)."""
    known = statistics(docs).withColumn("base_failed", base_failed())
    return known.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules)))
