"""Heuristic quality of documents: seven statistics, cutoffs and a verdict, without leaving the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text_rules import SPACE, lines, runs, strip, tokens


@dataclass(frozen=True)
class Cutoffs:
    """Fixed values of the default verdict; every one can be set."""

    min_chars: int = 200
    min_words: int = 40
    min_alpha_ratio: float = 0.6
    max_symbol_ratio: float = 0.15
    max_mean_word_length: float = 12.0
    max_short_line_ratio: float = 0.6
    max_top_ngram_repetition_ratio: float = 0.3


STATISTICS = ("char_count", "word_count", "alpha_ratio", "symbol_ratio", "mean_word_length", "short_line_ratio", "top_ngram_repetition_ratio")
#: Characters of ordinary prose (fixed value), as the inside of a character class.
ORDINARY = r".,;:!?'\"()\-–—/\n\t "


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def top_share(grams: Column) -> Column:
    """Share of the most frequent element.  Arrays without repeats, nearly all, are told by one hash pass."""
    sorted_ = F.array_sort(grams)
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["last"] == x, a["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["most"], run).alias("most"))

    most = F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(1)).otherwise(F.aggregate(sorted_, start, step, lambda a: a["most"]))
    return F.when(F.size(grams) > 0, most / F.size(grams)).otherwise(F.lit(0.0))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the seven statistics.  Null texts count as empty."""
    d = docs.withColumn("_s", strip(F.coalesce(F.col(text), F.lit("")))).withColumn("_w", tokens(F.col("_s")))
    d = d.withColumn("_l", F.filter(lines(F.col("_s")), lambda x: strip(x) != "")).withColumn("_lw", F.transform("_w", lambda x: F.lower(x)))
    s, w, ln = F.col("_s"), F.col("_w"), F.col("_l")
    solid = F.length(F.regexp_replace(s, f"[{SPACE}]", ""))
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    symbols = F.length(F.regexp_replace(s, rf"[\p{{L}}\p{{N}}{ORDINARY}]", ""))
    short = F.aggregate(F.filter(ln, lambda x: F.size(tokens(x)) < 3), F.lit(0), lambda a, x: a + F.length(x))
    all_chars = F.aggregate(ln, F.lit(0), lambda a, x: a + F.length(x))
    grams = F.transform(runs(F.col("_lw"), 3), lambda z: F.concat_ws(" ", z["r0"], z["r1"], z["r2"]))
    out = d.select(
        *docs.columns,
        F.length(s).cast("double").alias("char_count"),
        F.size(w).cast("double").alias("word_count"),
        ratio(letters, solid).alias("alpha_ratio"),
        ratio(symbols, F.length(s)).alias("symbol_ratio"),
        ratio(F.length(F.array_join(w, "")), F.size(w)).alias("mean_word_length"),
        F.when(F.size(ln) >= 5, ratio(short, all_chars)).otherwise(0.0).alias("short_line_ratio"),
        top_share(grams).alias("top_ngram_repetition_ratio"),
    )
    return out


def with_verdict(scored: DataFrame, c: Cutoffs = Cutoffs()) -> DataFrame:
    """Adds `reasons` (an array of messages) and `is_kept` to rows with the statistics."""
    x = F.col
    rules = [
        (x("char_count") < c.min_chars, F.format_string(f"only %.0f chars (min {c.min_chars})", "char_count")),
        (x("word_count") < c.min_words, F.format_string(f"only %.0f words (min {c.min_words})", "word_count")),
        ((x("char_count") > 0) & (x("alpha_ratio") < c.min_alpha_ratio), F.format_string(f"alpha ratio %.2f below min {c.min_alpha_ratio}", "alpha_ratio")),
        (x("symbol_ratio") > c.max_symbol_ratio, F.format_string(f"symbol ratio %.2f above max {c.max_symbol_ratio}", "symbol_ratio")),
        (x("mean_word_length") > c.max_mean_word_length, F.format_string(f"mean word length %.1f above max {c.max_mean_word_length}", "mean_word_length")),
        (x("short_line_ratio") > c.max_short_line_ratio, F.format_string(f"short-line ratio %.2f above max {c.max_short_line_ratio}", "short_line_ratio")),
        (x("top_ngram_repetition_ratio") > c.max_top_ngram_repetition_ratio, F.format_string(f"top 3-gram repetition ratio %.2f above max {c.max_top_ngram_repetition_ratio}", "top_ngram_repetition_ratio")),
    ]
    reasons = F.array_compact(F.array(*[F.when(bad, message) for bad, message in rules]))
    return scored.withColumn("reasons", reasons).withColumn("is_kept", F.size("reasons") == 0)


def quality_reports(docs: DataFrame, c: Cutoffs = Cutoffs(), text: str = "text") -> DataFrame:
    """One report per document: the statistics, the reasons against it and the verdict."""
    return with_verdict(with_statistics(docs, text), c)


def kept_documents(docs: DataFrame, c: Cutoffs = Cutoffs(), text: str = "text") -> DataFrame:
    """The documents with a good verdict.

    The fence column keeps the optimizer from moving the filter, and with it every statistic several times over, below
    the projection that computes the statistics once.
    """
    fenced = with_statistics(docs, text).withColumn("_fence", F.monotonically_increasing_id())
    return with_verdict(fenced, c).filter(F.col("is_kept") & (F.col("_fence") >= 0)).select(*docs.columns)
