"""After the first search: reranking, tiers of confidence, a wider second try, thresholds and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores from which a passage counts as correct, and under which it is dropped (fixed values).
UPPER, LOWER = 0.7, 0.3
#: How much wider the second try looks (fixed value).
WIDER = 3


def rerank(results: DataFrame, score: Column) -> DataFrame:
    """Results of each query by a new score; equal scores keep their old order."""
    order = Window.partitionBy("query_id").orderBy(F.desc("new_score"), "rank")
    scored = results.withColumn("new_score", score)
    return scored.withColumn("new_rank", F.row_number().over(order)).drop("score", "rank").withColumnsRenamed({"new_score": "score", "new_rank": "rank"})


def tier(score: Column, upper: float = UPPER, lower: float = LOWER) -> Column:
    if lower > upper:
        raise ValueError(f"lower cutoff {lower} lies over the upper one {upper}")
    return F.when(score >= upper, "correct").when(score >= lower, "ambiguous").otherwise("incorrect")


def filter_tiers(results: DataFrame, upper: float = UPPER, lower: float = LOWER) -> DataFrame:
    """Correct passages first, then ambiguous ones, each in their order; incorrect ones are dropped.  Adds `tier`."""
    kept = results.withColumn("tier", tier(F.col("score"), upper, lower)).filter("tier <> 'incorrect'")
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("tier") == "correct", 0).otherwise(1), "rank")
    return kept.withColumn("_r", F.row_number().over(order)).drop("rank").withColumnRenamed("_r", "rank")


def confident(results: DataFrame, upper: float = UPPER) -> DataFrame:
    """(query_id, is_confident): whether any passage of the query is correct."""
    return results.groupBy("query_id").agg((F.max("score") >= upper).alias("is_confident"))


def retrieve(wide: DataFrame, top_k: int, upper: float = UPPER, lower: float = LOWER, threshold: float | None = None) -> DataFrame:
    """The whole second stage over results that already hold the `WIDER * top_k` best of each query.

    The first try sees the top_k best.  Where none of them is correct, the wider try takes its place if that one has a
    correct passage.  A query whose first passage is under `threshold` keeps none.
    """
    narrow = filter_tiers(wide.filter(F.col("rank") <= top_k), upper, lower)
    wider = filter_tiers(wide.filter(F.col("rank") <= WIDER * top_k), upper, lower)
    sure = confident(narrow, upper).select("query_id", F.col("is_confident").alias("first_sure"))
    sure_wide = confident(wider, upper).select("query_id", F.col("is_confident").alias("wide_sure"))
    switch = sure_wide.join(sure, "query_id", "left").select("query_id", (~F.coalesce("first_sure", F.lit(False)) & F.col("wide_sure")).alias("switch"))
    first = narrow.join(switch.filter("switch").select("query_id"), "query_id", "left_anti")
    second = wider.join(switch.filter("switch").select("query_id"), "query_id", "left_semi")
    got = first.unionByName(second)
    if threshold is not None:
        good = got.filter((F.col("rank") == 1) & (F.col("score") >= threshold)).select("query_id")
        got = got.join(good, "query_id", "left_semi")
    return got.filter(F.col("rank") <= top_k)


#: Least number of passages that are reranked (fixed value).
RERANKED = 20


def search(found: DataFrame, top_k: int, new_score: Column | None = None, upper: float = UPPER, lower: float = LOWER, threshold: float | None = None) -> DataFrame:
    """The whole retrieval over found(query_id, rank, score, ..), which holds `WIDER` times as many as are reranked.

    With `new_score` the first try takes the best `RERANKED`, or top_k if that is more, and reranks them; without it
    the top_k best.  The second try takes `WIDER` times as many, is reranked likewise, and takes the place of the first
    where only it has a correct passage.  What is left is cut to top_k.
    """
    wide = max(top_k, RERANKED) if new_score is not None else top_k

    def attempt(n: int) -> DataFrame:
        best = found.filter(F.col("rank") <= n)
        return filter_tiers(best if new_score is None else rerank(best, new_score), upper, lower)

    first, second = attempt(wide), attempt(WIDER * wide)
    sure = confident(first, upper).filter("is_confident").select("query_id")
    switch = confident(second, upper).filter("is_confident").select("query_id").join(sure, "query_id", "left_anti")
    got = first.join(switch, "query_id", "left_anti").unionByName(second.join(switch, "query_id", "left_semi"))
    if threshold is not None:
        got = got.join(got.filter((F.col("rank") == 1) & (F.col("score") >= threshold)).select("query_id"), "query_id", "left_semi")
    return got.filter(F.col("rank") <= top_k)


def route(best: DataFrame, agents: list[str], default: str, threshold: float = 0.05) -> DataFrame:
    """(query_id, agent, score): the agent with the best top score of best(query_id, agent, score).

    Equal scores go to the agent that is registered first; a best score not over the threshold goes to the default.
    """
    place = F.create_map(*[x for i, a in enumerate(agents) for x in (F.lit(a), F.lit(-i))])
    won = best.groupBy("query_id").agg(F.max(F.struct("score", place[F.col("agent")].alias("place"), "agent")).alias("b"))
    return won.select("query_id", F.when(F.col("b.score") > threshold, F.col("b.agent")).otherwise(default).alias("agent"), F.col("b.score").alias("score"))


def neighbours(results: DataFrame, windows: DataFrame, passages: DataFrame, n: int) -> DataFrame:
    """(query_id, slot, id): the first n passages of each window that aren't part of its own text.

    Needs results(query_id, rank, id), windows(query_id, text), passages(id, passage); search n + 3 to have spares.
    """
    known = results.join(passages, "id").join(windows, "query_id").filter(~F.col("text").contains(F.col("passage")))
    order = Window.partitionBy("query_id").orderBy("rank")
    return known.withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= n).select("query_id", "slot", "id")


def fixed_length(ids: Column, length: int, pad: int = 0) -> Column:
    """An array cut or padded on the right to `length`."""
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.lit(length) - F.size(cut)))
