"""Quality rules: one projection of counts, ratios and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.llm.common import let, unused, words

#: Very common short words of English, German, French and Spanish. Fixed values.
STOP_WORDS = (
    "the of and to in a is that it for with as was on be by this are from at "
    "der die und das zu den von mit ist im für auf ein eine nicht des als auch "
    "le la les de des et un une du est que qui dans pour par sur pas au avec "
    "el los las y en que del se por con no una su para es al lo como"
).split()

#: name: (numerator, denominator, least or None, most or None). A rule fails outside its bounds; a zero denominator fails none.
RULES = {
    "mean_word_chars": ("word_chars", "n_words", 1.5, 15.0),
    "symbols_per_word": ("n_symbols", "n_words", None, 0.2),
    "stop_word_share": ("n_stop_words", "n_words", 0.04, None),
    "dup_line_share": ("n_dup_lines", "n_lines", None, 0.75),
    "upper_share": ("n_upper", "word_chars", None, 0.4),
    "loud_share": ("n_loud", "n_words", None, 0.2),
}


def _repeat_words(w: Column) -> Column:
    """Words in windows of three that occur twice or more in the text: hashes sorted, neighbours compared."""
    hashes = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def found(s: Column) -> Column:
            twice = F.filter(s, lambda e, j: e["h"].eqNullSafe(F.get(s, j - 1)["h"]) | e["h"].eqNullSafe(F.get(s, j + 1)["h"]))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, found))

    return let(hashes, covered)


def quality_counts(docs: DataFrame) -> DataFrame:
    """Adds the counts that the rules divide; null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    length = lambda pattern: F.char_length(F.regexp_replace(text, pattern, "")).cast("long")
    both = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter(w, lambda x: x.endswith("!!"))).cast("long").alias("n_loud"),
    )
    count = F.struct(let(words(F.col("text")), both).alias("w"), let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"))
    (made,) = unused(docs, "counts")
    return docs.withColumn(made, count).select(
        *[F.col(c) for c in docs.columns],
        *[F.col(f"{made}.w.{c}").alias(c) for c in ("n_words", "word_chars", "n_repeat_words", "n_stop_words", "n_loud")],
        F.col(f"{made}.l.n").alias("n_lines"),
        F.col(f"{made}.l.dup").alias("n_dup_lines"),
        length(r"[^#*$%&|<>]+").alias("n_symbols"),
        length(r"[^A-Z]+").alias("n_upper"),
    )


def quality_rules(docs: DataFrame, rules: dict = RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Every row of docs with its counts, base_failed, failed_rules and kept.

    The table ``rules`` becomes one projection; no user function runs. base_failed: fewer
    words than ``min_words``, or over ``max_repeat_percent`` of them in repeated windows.
    Columns of docs that are named like an added one are replaced; rows are never merged.
    """
    added = {"n_words", "word_chars", "n_repeat_words", "n_stop_words", "n_loud", "n_lines", "n_dup_lines", "n_symbols", "n_upper", "base_failed", "failed_rules", "kept"}
    own = docs.select(*[F.col(c) for c in docs.columns if c not in added])

    def failed(top: str, bottom: str, least: float | None, most: float | None) -> Column:
        out = F.lit(False)
        for bound, worse in ((least, F.col(top) < F.lit(least) * F.col(bottom)), (most, F.col(top) > F.lit(most) * F.col(bottom))):
            out = out if bound is None else out | worse
        return (F.col(bottom) > 0) & out

    names = F.array(*[F.when(failed(*rule), F.lit(name)) for name, rule in rules.items()]) if rules else F.array().cast("array<string>")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return (
        quality_counts(own)
        .withColumn("base_failed", base)
        .withColumn("failed_rules", F.array_compact(names))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )


def keep_quality(docs: DataFrame, **given) -> DataFrame:
    """The rows of docs that quality_rules keeps, with docs' own columns.

    The row number is there for the optimizer: it doesn't move a filter below a projection
    with one, and so doesn't copy the counts into the filter once for each rule.
    """
    names = dict(zip(docs.columns, unused(docs, *[f"own_{c}" for c in docs.columns]), strict=True))
    apart = docs.select("text", *[F.col(c).alias(n) for c, n in names.items()])  # whatever they are named, no added column replaces them
    kept = quality_rules(apart, **given)
    (row,) = unused(kept, "row")
    kept = kept.select("*", F.monotonically_increasing_id().alias(row)).where(F.col("kept") & (F.col(row) >= 0))
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
