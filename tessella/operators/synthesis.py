"""Seeded template texts, validation of examples, and collation of retrieved neighbours."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators.training import IGNORE, PAD, hash_order


def pick(values: list[str], *keys: Column, seed: int = 0) -> Column:
    """One of the values by a hash of the keys; any engine with MD5 picks the same."""
    place = F.conv(F.substring(hash_order(*keys, seed=seed), 1, 8), 16, 10).cast("bigint") % len(values)
    return F.get(F.array(*[F.lit(v) for v in values]), place.cast("int"))


def template_texts(spark: SparkSession, n: int, templates: list[str], words: dict[str, list[str]], seed: int = 0) -> DataFrame:
    """(id, text): n texts, the templates in turn, each `{slot}` filled by a seeded pick of the slot's words."""
    unknown = {s for t in templates for s in re.findall(r"\{(\w+)\}", t)} - set(words)
    if not templates or unknown:
        raise ValueError(f"no words for {sorted(unknown)}" if unknown else "no templates")
    text = F.get(F.array(*[F.lit(t) for t in templates]), (F.col("id") % len(templates)).cast("int"))
    for slot, values in words.items():
        text = F.replace(text, F.lit("{" + slot + "}"), pick(values, F.col("id"), F.lit(slot), seed=seed))
    return spark.range(n).select("id", text.alias("text"))


def validation_summary(examples: DataFrame, length: Column, limit: int) -> DataFrame:
    """One row about examples(user, assistant, error): valid and invalid lines, lengths, and how many exceed the limit."""
    fine = F.col("error").isNull()
    size = F.when(fine, length)
    return examples.agg(
        F.count_if(fine).alias("n_valid"),
        F.count_if(F.col("error") == "not JSON").alias("n_not_json"),
        F.count_if(~fine & (F.col("error") != "not JSON")).alias("n_incomplete"),
        F.min(size).alias("shortest"),
        F.max(size).alias("longest"),
        F.avg(size).alias("mean"),
        F.count_if(size > limit).alias("n_truncated"),
    )


def collate_neighbours(neighbours: DataFrame, n: int, length: int) -> DataFrame:
    """(query_id, neighbours): n id arrays of a fixed length per window, in slot order; missing ones hold padding.

    Needs neighbours(query_id, slot, ids) with at most n slots per window.
    """
    empty = F.array_repeat(F.lit(PAD), length)
    held = neighbours.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "ids"))).alias("by"))  # n entries
    fixed = lambda ids: F.concat(F.slice(ids, 1, length), F.array_repeat(F.lit(PAD), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))
    return held.select("query_id", F.array(*[F.coalesce(fixed(F.col("by")[i]), empty) for i in range(1, n + 1)]).alias("neighbours"))


def ignored_share(labels: Column) -> Column:
    """Share of a label array that losses ignore."""
    return F.when(F.size(labels) > 0, F.size(F.filter(labels, lambda x: x == IGNORE)) / F.size(labels)).otherwise(0.0)


def _part(c: Column, before: str, after: str) -> Column:
    """The value framed by two texts; nothing where there is none."""
    text = c.cast("string")
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(before), text, F.lit(after))).otherwise("")


def _said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _there(*cs: Column) -> Column:
    there = F.lit(True)
    for c in cs:
        there = there & (F.coalesce(c.cast("string"), F.lit("")) != "")
    return there


# The sentences of the next two functions are fixed values: formats that must be equal.
def monster_templates(r: dict[str, Column]) -> list[tuple[Column, Column, Column]]:
    """(condition, question, answer) of a creature: rating, hit points, armor, kind, speed.

    `r` has the columns name, rating (as text), xp, hp, dice, ac, armor, size, kind, alignment, speed.
    """
    n, named = F.trim(r["name"]), F.trim(F.coalesce(r["name"], F.lit(""))) != ""
    xp = F.when(r["xp"] > 0, _said(" (", F.format_number(r["xp"], 0), " XP)")).otherwise("")
    speed = F.regexp_replace(r["speed"].cast("string"), r"\.+$", "")
    return [
        (named & _there(r["rating"]), _said("What is the challenge rating of the ", n, "?"), _said("The ", n, " is challenge rating ", r["rating"], xp, ".")),
        (named & _there(r["hp"]), _said("How many hit points does a ", n, " have?"), _said("A ", n, " has ", r["hp"], " hit points", _part(r["dice"], " (", ")"), ".")),
        (named & _there(r["ac"]), _said("What is the armor class of a ", n, "?"), _said("A ", n, " has an armor class of ", r["ac"], _part(r["armor"], " (", ")"), ".")),
        (named & _there(r["size"], r["kind"]), _said("What type of creature is a ", n, "?"), _said("A ", n, " is a ", F.lower(r["size"]), " ", r["kind"], _part(r["alignment"], ", ", ""), ".")),
        (named & _there(r["speed"]), _said("How fast can a ", n, " move?"), _said("A ", n, "'s speed is ", speed, ".")),
    ]


def spell_templates(r: dict[str, Column]) -> list[tuple[Column, Column, Column]]:
    """(condition, question, answer) of a spell: level and school, casting time, range, duration, first sentence.

    `r` has the columns name, level, school, time, range, duration, concentration (boolean), text.
    """
    n, named = F.trim(r["name"]), F.trim(F.coalesce(r["name"], F.lit(""))) != ""
    level = F.when(r["level"].cast("string") == "0", "cantrip").otherwise(_said("level ", r["level"]))
    first = F.concat(F.regexp_replace(F.element_at(F.split(F.trim(r["text"]), r"\. "), 1), r"\.+$", ""), F.lit("."))
    held = F.when(F.coalesce(r["concentration"], F.lit(False)), " It requires concentration.").otherwise("")
    return [
        (named & r["level"].isNotNull() & _there(r["school"]), _said("What level and school is the spell ", n, "?"), _said(n, " is a ", level, " ", r["school"], " spell.")),
        (named & _there(r["time"]), _said("How long does it take to cast ", n, "?"), _said(n, " has a casting time of ", r["time"], ".")),
        (named & _there(r["range"]), _said("What is the range of the spell ", n, "?"), _said(n, " has a range of ", r["range"], ".")),
        (named & _there(r["duration"]), _said("How long does ", n, " last?"), _said(n, "'s duration is ", r["duration"], ".", held)),
        (named & _there(r["text"]) & (F.length(first) > 15), _said("What does the spell ", n, " do?"), first),
    ]


def capped(rows: DataFrame, category: str, n: int, *keys: str, seed: int = 0) -> DataFrame:
    """At most n rows of every category, in a hash order of the keys.

    Rows beyond the n first of each cell of the order can't be among the n first of a category; so cells are cut first,
    and only what is left of a category, however large it is, is ranked as a whole.
    """
    key = hash_order(*[F.col(k) for k in keys], seed=seed)
    d = rows.withColumn("_key", key).withColumn("_cell", F.substring("_key", 1, 2))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("_key", *keys))
    few = d.withColumn("_i", rank(category, "_cell")).filter(F.col("_i") <= n)
    return few.withColumn("_i", rank(category)).filter(F.col("_i") <= n).select(rows.columns)
