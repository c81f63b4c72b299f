"""Measures of retrieval and answers, of losses, and their noise."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens of answers: numbers with sign, decimals or fraction, and words with inner apostrophes (fixed value).
ANSWER_TOKEN = r"[+-]?\d+(?:[./]\d+)?|[a-z]+(?:'[a-z]+)*"
LONGEST_WINDOW = 512
_answer_token = re.compile(ANSWER_TOKEN)


def answer_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({ANSWER_TOKEN})"), F.lit(1))


def keyword_recall(prediction: Column, keywords: Column) -> Column:
    """Share of the keywords in the prediction, case aside; 1 where there are none."""
    low = F.lower(F.coalesce(prediction, F.lit("")))
    met = F.size(F.filter(keywords, lambda k: low.contains(F.lower(k))))
    return F.when(F.coalesce(F.size(keywords), F.lit(0)) <= 0, 1.0).otherwise(met / F.size(keywords))


def hit(passages: Column, keywords: Column) -> Column:
    """Whether all keywords stand in the joined passages, case aside."""
    joined = F.lower(F.array_join(passages, " "))
    return F.forall(keywords, lambda k: joined.contains(F.lower(k)))


def hit_rate(results: DataFrame, items: DataFrame) -> DataFrame:
    """(n, hits, hit_rate) over items(query_id, keywords) and results(query_id, passage); no keywords, no item."""
    got = results.groupBy("query_id").agg(F.collect_list("passage").alias("passages"))  # top-k passages of a query
    judged = items.filter(F.size("keywords") > 0).join(got, "query_id", "left").withColumn("hit", hit(F.coalesce("passages", F.array().cast("array<string>")), F.col("keywords")))
    n, hits = F.count("*"), F.count_if("hit")
    return judged.agg(n.alias("n"), hits.alias("hits"), F.when(n > 0, F.round(hits / n, 4)).otherwise(F.lit(float("nan"))).alias("hit_rate"))


def window_f1(prediction: list[str], reference: list[str]) -> float:
    """The best token F1 of any run of the prediction, up to 512 tokens long, against the whole reference.

    Only runs that start and end on a reference token can be best, so only those are tried.
    """
    want = Counter(reference)
    places = [i for i, t in enumerate(prediction) if t in want]
    best = 0.0
    for a, start in enumerate(places):
        left, common = dict(want), 0
        for i in places[a:]:
            length = i - start + 1
            if length > LONGEST_WINDOW:
                break
            t = prediction[i]
            if left[t] > 0:
                left[t] -= 1
                common += 1
                best = max(best, 2 * common / (length + len(reference)))
    return best


def answer_f1(prediction: str | None, reference: str | None, question: str | None) -> float:
    """Best-window F1 without the question's own tokens, unless a side would be left with none."""
    p, r = _answer_token.findall((prediction or "").lower()), _answer_token.findall((reference or "").lower())
    asked = set(_answer_token.findall((question or "").lower()))
    own_p, own_r = [t for t in p if t not in asked], [t for t in r if t not in asked]
    return window_f1(own_p, own_r) if own_p and own_r else window_f1(p, r)


@F.pandas_udf(T.DoubleType())
def best_window_f1(prediction: pd.Series, reference: pd.Series, question: pd.Series) -> pd.Series:
    return pd.Series([answer_f1(*x) for x in zip(prediction, reference, question)], dtype="float64")


def loss_summary(losses: DataFrame) -> DataFrame:
    """(perplexity, bits_per_token, mean_loss, n_tokens) of losses(loss_sum, n_tokens); NaN without tokens."""
    total = losses.agg(F.coalesce(F.sum("loss_sum"), F.lit(0.0)).alias("l"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    mean = F.when(F.col("n_tokens") > 0, F.col("l") / F.col("n_tokens")).otherwise(F.lit(float("nan")))
    return total.select(F.round(F.exp(mean), 4).alias("perplexity"), F.round(mean / F.log(F.lit(2.0)), 4).alias("bits_per_token"), F.round(mean, 4).alias("mean_loss"), "n_tokens")


def tier_losses(losses: DataFrame, tier: str, loss: str, n: str) -> DataFrame:
    """Mean loss of each tier, weighted by its windows, beside the mean over all."""
    by = losses.groupBy(tier).agg(F.sum(n).alias("n"), (F.sum(F.col(loss) * F.col(n)) / F.sum(n)).alias("mean_loss"))
    whole = losses.agg((F.sum(F.col(loss) * F.col(n)) / F.sum(n)).alias("overall_loss"))
    return by.join(F.broadcast(whole))  # one row


def weight_histogram(rows: DataFrame, weight: str) -> DataFrame:
    """Count and percentage of each weight."""
    n = F.count("*")
    counts = rows.groupBy(weight).agg(n.alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(weight, "n", (F.lit(100.0) * F.col("n") / F.col("total")).alias("percent"))  # one row


def length_summary(rows: DataFrame, length: str, limit: int) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.min(length).alias("shortest"), F.max(length).alias("longest"), F.avg(length).alias("mean"), F.count_if(F.col(length) > limit).alias("truncated"))


def bootstrap_halfwidth(losses: Sequence[float], draws: int = 1000, alpha: float = 0.05, seed: int = 0) -> float:
    """Half the width of the central interval of resampled means; 0 for fewer than two losses."""
    x = np.asarray(list(losses), dtype=np.float64)
    if len(x) < 2:
        return 0.0
    means = x[np.random.default_rng(seed).integers(0, len(x), size=(draws, len(x)))].mean(axis=1)
    low, high = np.percentile(means, [50 * alpha, 100 - 50 * alpha])
    return float(high - low) / 2


def stopping_point(evaluations: Iterator[Sequence[float]], patience: int = 3, seed: int = 0) -> int | None:
    """Number of the evaluation at which loss has, `patience` times in a row, not improved beyond its noise."""
    best, bad = float("inf"), 0
    for i, losses in enumerate(x for x in evaluations if len(x)):
        mean = float(np.mean(losses))
        if mean < best - bootstrap_halfwidth(losses, seed=seed + i):
            best, bad = mean, 0
        else:
            bad += 1
        if bad >= patience:
            return i
    return None


def smoothed(runs: DataFrame, run: str, step: str, loss: str, beta: float = 0.9) -> DataFrame:
    """`runs` with `smooth`: exponentially weighted losses, corrected for their start, in each run's step order.

    A run's steps are gathered in one row and folded in one pass; runs are short (hundreds of steps).
    """

    @F.pandas_udf("array<double>")
    def fold(losses: pd.Series) -> pd.Series:
        out = []
        for xs in losses:
            held, got = 0.0, []
            for i, x in enumerate(xs, 1):
                held = beta * held + (1 - beta) * x
                got.append(held / (1 - beta**i))
            out.append(got)
        return pd.Series(out)

    rest = [c for c in runs.columns if c not in (run, step)]
    gathered = runs.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(step, *rest))).alias("_steps"))
    folded = gathered.withColumn("_smooth", fold(F.transform("_steps", lambda x: x[loss].cast("double"))))
    each = folded.select(run, F.explode(F.arrays_zip("_steps", "_smooth")).alias("_e"))
    return each.select(*[F.col(run) if c == run else F.col(f"_e._steps.{c}").alias(c) for c in runs.columns], F.col("_e._smooth").alias("smooth"))


def suggested_rate(rates: Sequence[float], losses: Sequence[float]) -> tuple[float, float] | None:
    """The rate of steepest decrease of loss over log10 rate, and a tenth of it; None for fewer than three points."""
    if len(rates) < 3:
        return None
    steepest = float(rates[int(np.argmin(np.gradient(np.asarray(losses, dtype=float), np.log10(np.asarray(rates, dtype=float)))))])
    return steepest, steepest / 10
