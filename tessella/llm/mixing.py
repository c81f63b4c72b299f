"""Mixing sources to target shares by token size, with weighted sampling without replacement.

A source's goal is its share of T, the token size of all documents whose source has a target; it can give at most
`max_repeats` times its own size.  Complete epochs come first; the rest is a fraction of one epoch, drawn after
Efraimidis and Spirakis: each document gets the key -ln(u)/weight with u from a hash of its id and the seed, and the
documents of smallest key whose running token sum stays within the rest are taken.

The running sum is taken on three levels so that no source is ever sorted in one task: token sums over a fixed
logarithmic grid of keys, then over a fine grid inside the one cell where the rest runs out, and only the documents
of that last fine cell are ordered.  A source with a third of all documents spreads like any other.

Sources match up to case and outer white space; documents of null or untargeted sources are left out.  Null and empty
texts have size 0 and are taken with every epoch.  Repeated rows of one id count once.  Equal keys are ordered by id.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.runtime import broadcast_if_small, materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public split pattern of the byte-level BPE vocabularies.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OCTAVE, FINE = 16, 4096


@dataclass(frozen=True)
class Mixing:
    seed: int = 17
    tokenizer: str = TOKENIZER


def source_key(source: Column) -> Column:
    """Source names up to case and outer white space."""
    return F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def with_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, text: str = "text") -> DataFrame:
    """`docs` with its `text` column replaced by `tokens`, the number of tokens of the whole text.

    The vocabulary file (under 1 MB) is read by the driver and sent along, so executors need no copy of it.
    """
    with open(tokenizer, "rb") as f:
        vocabulary = f.read()
    state: dict = {}

    def encoder():
        if not state:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
            state["encode"] = tiktoken.Encoding("bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        return state["encode"]

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for batch in batches:
            yield pd.Series([0 if t is None else len(encode(t, allowed_special=set(), disallowed_special=())) for t in batch], dtype="int64")

    return docs.withColumn("tokens", count(F.col(text))).drop(text)


def current_targets(targets: DataFrame) -> DataFrame:
    """(key, source, target_share, max_repeats): of each source the row with the latest `updated_at`."""
    row = F.struct("updated_at", "target_share", "max_repeats", "source")
    latest = targets.filter(F.col("source").isNotNull()).groupBy(source_key(F.col("source")).alias("key")).agg(F.max(row).alias("r"))
    return latest.select("key", "r.source", F.coalesce("r.target_share", F.lit(0.0)).alias("target_share"), F.coalesce("r.max_repeats", F.lit(0)).alias("max_repeats"))


@dataclass
class Mixture:
    """`selection`: (id, source, copies, tokens) of every document taken; `report`: one row per target source."""

    selection: DataFrame
    report: DataFrame


def mix(docs: DataFrame, targets: DataFrame, weights: DataFrame | None = None, p: Mixing = Mixing()) -> Mixture:
    """Needs docs(id, source, text) and targets(source, target_share, max_repeats, updated_at).

    `weights`(id, weight) are the documents' quality weights; a document without one weighs 1.
    """
    goal = materialize(current_targets(targets), "targets")
    keys = broadcast_if_small(goal.select("key"), goal.count(), 64)
    unit = (F.pmod(F.xxhash64("id", F.lit(p.seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    weight = F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(1e-6))
    wanted = (
        docs.filter(F.col("id").isNotNull())
        .select("id", source_key(F.col("source")).alias("key"), "text")
        .join(keys, "key", "left_semi")
    )
    sized = with_tokens(wanted, p.tokenizer).groupBy("id", "key").agg(F.max("tokens").alias("tokens"))
    if weights is None:
        sized = sized.withColumn("weight", F.lit(1.0))
    else:
        sized = sized.join(weights.groupBy("id").agg(F.max("weight").alias("weight")), "id", "left")
    sized = sized.select("id", "key", "tokens", (-F.log(unit) / weight).alias("rank"))
    sized = materialize(sized.withColumn("cell", F.floor(F.log2("rank") * OCTAVE)), "sized")

    sizes = sized.groupBy("key").agg(F.sum("tokens").alias("size"), F.count("*").alias("n_docs"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    plan = goal.join(sizes, "key", "left").na.fill(0, ["size", "n_docs"]).join(F.broadcast(total))  # one row
    plan = (
        plan.withColumn("wanted", F.col("target_share") * F.col("total"))
        .withColumn("capacity", F.col("max_repeats") * F.col("size"))
        .withColumn("goal", F.floor(F.least("wanted", "capacity")))
        .withColumn("epochs", F.when(F.col("size") > 0, F.floor(F.col("goal") / F.col("size"))).otherwise(0))
        .withColumn("rest", F.col("goal") - F.col("epochs") * F.col("size"))
    )
    plan = materialize(plan, "plan")  # as many rows as targets

    rest = plan.select("key", "rest", "epochs")
    order = Window.partitionBy("key").orderBy("cell")
    cells = sized.groupBy("key", "cell").agg(F.sum("tokens").alias("t")).withColumn("upto", F.sum("t").over(order))
    cut = (
        cells.join(rest, "key")
        .groupBy("key")
        .agg(
            F.min(F.when(F.col("upto") > F.col("rest"), F.col("cell"))).alias("cut"),
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))), F.lit(0)).alias("before"),
        )
    )
    low, high = F.pow(F.lit(2.0), F.col("cell") / OCTAVE), F.pow(F.lit(2.0), (F.col("cell") + 1) / OCTAVE)
    fine = F.floor((F.col("rank") - low) / (high - low) * FINE)
    edge = sized.join(cut, "key").filter(F.col("cell") == F.col("cut")).withColumn("fine", fine)
    fines = edge.groupBy("key", "fine").agg(F.sum("tokens").alias("t"), F.first("before").alias("before")).withColumn("upto", F.col("before") + F.sum("t").over(Window.partitionBy("key").orderBy("fine")))
    cut2 = (
        fines.join(rest, "key")
        .groupBy("key")
        .agg(
            F.min(F.when(F.col("upto") > F.col("rest"), F.col("fine"))).alias("cut_fine"),
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))), F.first("before")).alias("before_fine"),
        )
    )
    last = edge.join(cut2, "key").filter(F.col("fine") == F.col("cut_fine"))
    last = last.withColumn("upto", F.col("before_fine") + F.sum("tokens").over(Window.partitionBy("key").orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, 0)))
    taken_last = last.join(rest, "key").filter(F.col("upto") <= F.col("rest")).select("id", "key", F.lit(1).alias("taken"))
    limits = plan.select("key", "source", "epochs", "rest").join(cut, "key", "left").join(cut2, "key", "left")
    chosen = (
        sized.withColumn("fine", fine)
        .join(limits, "key")
        .join(taken_last, ["id", "key"], "left")
        .withColumn(
            "extra",
            F.when(F.col("rest") <= 0, 0)
            .when(F.col("cut").isNull() | (F.col("cell") < F.col("cut")), 1)
            .when((F.col("cell") == F.col("cut")) & (F.col("cut_fine").isNull() | (F.col("fine") < F.col("cut_fine"))), 1)
            .otherwise(F.coalesce("taken", F.lit(0))),
        )
        .select("id", "source", "key", (F.col("epochs") + F.col("extra")).cast("int").alias("copies"), "tokens")
        .filter("copies > 0")
    )
    used = chosen.groupBy("key").agg(F.sum(F.col("copies") * F.col("tokens")).alias("used"))
    report = plan.join(used, "key", "left").na.fill(0, ["used"])
    whole = report.agg(F.sum("used").alias("mixed"))
    report = report.join(F.broadcast(whole)).select(  # one row
        "source",
        "target_share",
        F.when(F.col("mixed") > 0, F.col("used") / F.col("mixed")).alias("actual_share"),
        F.col("size").alias("source_tokens"),
        F.col("used").alias("mixed_tokens"),
        F.when(F.col("size") > 0, F.col("used") / F.col("size")).otherwise(0.0).alias("repeats"),
        "max_repeats",
        (F.col("capacity") < F.col("wanted")).alias("short"),
    )
    return Mixture(chosen.drop("key"), report)


def quality_weights(reports: DataFrame) -> DataFrame:
    """(id, weight) from the latest run of each document's quality reports: kept 1, without a verdict 0.5, not kept 0.25."""
    latest = reports.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.struct("run_no", "scored_at", "is_kept")).alias("r"))
    kept = F.col("r.is_kept")
    return latest.select(F.col("doc_id").alias("id"), F.when(kept, 1.0).when(~kept, 0.25).otherwise(0.5).alias("weight"))
