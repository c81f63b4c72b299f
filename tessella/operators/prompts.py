"""Prompts and conversations: packing of history and context into token budgets, roles, hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.training import AST, BOS, SEP, USR

#: Special tokens around a context and a query (fixed value); turns that a conversation remembers (fixed value).
OVERHEAD, MOST_TURNS = 5, 20


def single_prompt(query: Column, context: Column, budget: int) -> Column:
    """BOS [SEP context SEP] USR query AST of id arrays; the context is cut to what the budget leaves."""
    room = F.greatest(F.lit(budget) - F.size(query) - OVERHEAD, F.lit(0))
    cut = F.slice(F.coalesce(context, F.array().cast("array<int>")), F.lit(1), room)
    framed = F.concat(F.array(F.lit(BOS), F.lit(SEP)), cut, F.array(F.lit(SEP), F.lit(USR)), query, F.array(F.lit(AST)))
    return F.when(F.size(cut) > 0, framed).otherwise(F.concat(F.array(F.lit(BOS), F.lit(USR)), query, F.array(F.lit(AST))))


def pack_newest(lengths: Column, budget: Column) -> Column:
    """Indexes of the segments kept: from the newest (last) on, each that still fits; one that doesn't is skipped."""
    start = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(0).alias("used"))
    order = F.reverse(F.transform(lengths, lambda x, i: F.struct(i.alias("i"), x.cast("int").alias("n"))))

    def step(a: Column, x: Column) -> Column:
        fits = a["used"] + x["n"] <= budget
        return F.struct(F.when(fits, F.concat(F.array(x["i"]), a["kept"])).otherwise(a["kept"]).alias("kept"), (a["used"] + F.when(fits, x["n"]).otherwise(0)).alias("used"))

    return F.aggregate(order, start, step, lambda a: a["kept"])


def conversation_prompt(turns: Column, query: Column, context: Column, max_len: int) -> Column:
    """Ids of a prompt from turns (an array of struct(user, assistant) id arrays), a query and an optional context."""
    some = F.coalesce(F.size(context) > 0, F.lit(False))
    overhead = F.size(query) + 3
    budget = F.lit(max_len) - overhead - F.when(some, 2).otherwise(0)
    segments = F.transform(turns, lambda t: F.concat(F.array(F.lit(USR)), t["user"], F.array(F.lit(AST)), t["assistant"]))
    kept = pack_newest(F.transform(segments, lambda s: F.size(s)), budget)
    history = F.flatten(F.transform(kept, lambda i: F.get(segments, i)))
    room = F.greatest(F.lit(max_len) - overhead - 2 - F.size(history), F.lit(0))
    cut = F.when(some, F.slice(context, F.lit(1), room)).otherwise(F.array().cast("array<int>"))
    head = F.when(F.size(cut) > 0, F.concat(F.array(F.lit(BOS), F.lit(SEP)), cut, F.array(F.lit(SEP)))).otherwise(F.array(F.lit(BOS)))
    return F.concat(head, history, F.array(F.lit(USR)), query, F.array(F.lit(AST)))


def last_turns(turns: DataFrame, key: str, order: list[str], most: int = MOST_TURNS) -> DataFrame:
    """The newest `most` turns of each conversation, numbered by `turn` from the oldest kept."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    oldest = Window.partitionBy(key).orderBy(*order)
    kept = turns.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= most).drop("_r")
    return kept.withColumn("turn", F.row_number().over(oldest))


def role_messages(turns: DataFrame, *keys: str) -> DataFrame:
    """Two rows of each turn(user, assistant): role and content, in order."""
    both = F.array(F.struct(F.lit(0).alias("part"), F.lit("user").alias("role"), F.col("user").alias("content")), F.struct(F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.col("assistant").alias("content")))
    return turns.select(*keys, F.explode(both).alias("m")).select(*keys, "m.part", "m.role", "m.content")


# Openers of factual and of creative requests.
FACTUAL = ("what", "how many", "list", "when", "define")
CREATIVE = ("write", "create", "design", "imagine")



def generation_hints(query: Column, temperature: Column, tokens: Column) -> tuple[Column, Column]:
    """(temperature, token budget) after the opener and the length of a query."""
    q = F.lower(F.trim(F.coalesce(query, F.lit(""))))
    starts = lambda words: q.rlike("^(" + "|".join(words) + r")\b")
    n = F.size(F.filter(F.split(q, r"\s+"), lambda x: x != ""))
    warm = F.when(starts(FACTUAL), F.least(temperature, F.lit(0.5))).when(starts(CREATIVE), F.greatest(temperature, F.lit(0.9))).otherwise(temperature)
    room = F.when(n < 10, F.greatest(tokens, F.lit(256))).when(n > 50, F.least(tokens, F.lit(128))).otherwise(tokens)
    return warm, room
