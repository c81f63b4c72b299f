"""Layout of training data: offsets, windows, weights, splits, padding, sampling and schedules."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.runtime import broadcast_if_small, materialize

# Ids of the special tokens, and the label that losses ignore.
PAD, BOS, EOS, SEP, USR, AST = range(6)
IGNORE = -100
BLOCKS, SPLIT_SEED = 500, 0


def with_offsets(docs: DataFrame, size: str, order: str, part_rows: int = 50_000) -> DataFrame:
    """`docs` with `start_off` and `end_off`: running sums of `size` in the given order.

    Two levels: the rows are range-partitioned by `order`, about `part_rows` to a part, and written out with the number
    of their part; only the sums of the parts, one row each, meet in one task.  The plan is the same for any number of
    rows beyond the first part.
    """
    docs = materialize(docs, "sized-docs")
    parts = max(1, -(-docs.count() // part_rows))
    if parts == 1:
        return docs.withColumn("end_off", F.sum(size).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("start_off", F.col("end_off") - F.col(size))
    d = materialize(docs.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "ranged-docs")
    sums = d.groupBy("_part").agg(F.sum(size).alias("_sum"))
    base = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_base")
    inside = F.sum(size).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = d.join(broadcast_if_small(base, parts, 16), "_part").withColumn("end_off", F.col("_base") + inside)
    return out.withColumn("start_off", F.col("end_off") - F.col(size)).drop("_part", "_base")


def windows(regions: DataFrame, seq_len: int, stride: int | None = None) -> DataFrame:
    """(region_id, offset): window starts in regions(region_id, start, end), never across a region's end.

    A window takes seq_len + 1 tokens: input and target are shifted by one.
    """
    stride = stride or seq_len // 2
    fits = F.col("end") - F.col("start") > seq_len
    return regions.filter(fits).select("region_id", F.explode(F.sequence(F.col("start"), F.col("end") - seq_len - 1, F.lit(stride).cast("bigint"))).alias("offset"))


def containing_document(points: DataFrame, docs: DataFrame, bin_size: int) -> DataFrame:
    """`points`(offset, ..) joined with the document whose [start_off, end_off) holds the offset.

    Offsets and documents meet in bins of `bin_size` tokens, an equality; a long document lies in several bins.
    """
    spread = docs.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_off") / bin_size), F.floor((F.greatest(F.col("end_off") - 1, F.col("start_off"))) / bin_size))))
    placed = points.withColumn("_bin", F.floor(F.col("offset") / bin_size))
    return placed.join(spread, "_bin").filter((F.col("offset") >= F.col("start_off")) & (F.col("offset") < F.col("end_off"))).drop("_bin")


def block_split(n_tokens: int, val_split: float, seq_len: int, n_blocks: int = BLOCKS, seed: int = SPLIT_SEED) -> list[tuple[int, int, bool]]:
    """(start, end, is_val) of contiguous blocks, a random share of them held out.  Scalars only; no data is read."""
    n_blocks = max(2, min(n_blocks, n_tokens // max(seq_len + 1, 1)))
    edges = np.linspace(0, n_tokens, n_blocks + 1).astype(np.int64).tolist()
    held = min(n_blocks - 1, max(1, round(n_blocks * val_split)))
    chosen = set(np.random.RandomState(seed).choice(n_blocks, size=held, replace=False).tolist())
    return [(a, b, i in chosen) for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def hash_order(*parts: Column, seed: int = 0) -> Column:
    """A reproducible shuffle key that any engine can recompute."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed))))


def tier_split(docs: DataFrame, val_split: float, seq_len: int, seed: int = SPLIT_SEED) -> DataFrame:
    """`docs`(doc_id, weight, n_tokens) with `is_val`: of each weight tier about `val_split` of the tokens are held out.

    Documents of a tier are taken in a hash order until the share is reached.  A tier of one document, or one that is
    shorter than a window, stays in training, and one document always does.
    """
    key = hash_order(F.col("doc_id"), seed=seed)
    d = docs.withColumn("_key", key).withColumn("_cell", F.substring("_key", 1, 3))
    # sums of 4,096 cells of the hash order in each tier, so that no tier is ordered in one task
    cells = d.groupBy("weight", "_cell").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c"))
    before = Window.partitionBy("weight").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("weight")
    zero = F.lit(0)
    base = cells.select("weight", "_cell", F.coalesce(F.sum("t").over(before), zero).alias("_t0"), F.coalesce(F.sum("c").over(before), zero).alias("_c0"), F.sum("t").over(whole).alias("_total"), F.sum("c").over(whole).alias("_n"))
    order = Window.partitionBy("weight", "_cell").orderBy("_key", "doc_id")
    d = d.join(base, ["weight", "_cell"])
    d = d.withColumn("_before", F.col("_t0") + F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), zero)).withColumn("_i", F.col("_c0") + F.row_number().over(order))
    takes = (F.col("_total") >= seq_len + 1) & (F.col("_n") > 1) & (F.col("_before") < F.col("_total") * F.lit(val_split)) & (F.col("_i") < F.col("_n"))
    return d.select(*docs.columns, takes.alias("is_val"))


def _first_by_hash(df: DataFrame, n: int, keys: tuple[str, ...], seed: int) -> tuple[DataFrame, DataFrame]:
    """The first n rows in a hash order of the keys, and the others.

    The order is cut into 65,536 cells; their counts tell in which cell the n-th row lies, and only that cell is sorted.
    """
    d = df.withColumn("_key", hash_order(*[F.col(k) for k in keys], seed=seed)).withColumn("_cell", F.substring("_key", 1, 4))
    cells = d.groupBy("_cell").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(Window.orderBy("_cell")))  # 65,536 rows at most
    edge = cells.filter(F.col("upto") >= n).orderBy("_cell").select("_cell", (F.col("upto") - F.col("c")).alias("before")).first()
    if n <= 0 or edge is None:
        return (df, df.limit(0)) if n > 0 else (df.limit(0), df)
    ranked = d.filter(F.col("_cell") == edge["_cell"]).withColumn("_i", F.row_number().over(Window.partitionBy("_cell").orderBy("_key", *keys)))
    cut, own = n - edge["before"], df.columns
    first = d.filter(F.col("_cell") < edge["_cell"]).select(own).unionByName(ranked.filter(F.col("_i") <= cut).select(own))
    return first, d.filter(F.col("_cell") > edge["_cell"]).select(own).unionByName(ranked.filter(F.col("_i") > cut).select(own))


def exact_sample(df: DataFrame, n: int, *keys: str, seed: int = 0) -> DataFrame:
    """n rows in a hash order of the keys; all rows if there are no more."""
    return _first_by_hash(df, n, keys, seed)[0]


def example_split(df: DataFrame, val_fraction: float, *keys: str, seed: int = 0) -> DataFrame:
    """`df` with `is_val`: a hash-ordered share, at least one row and at most all but one."""
    n = df.count()
    held, rest = _first_by_hash(df, min(max(1, round(n * val_fraction)), max(n - 1, 0)), keys, seed)
    return held.withColumn("is_val", F.lit(True)).unionByName(rest.withColumn("is_val", F.lit(False)))


def choose_split(docs: DataFrame, seq_len: int, val_split: float, held: DataFrame | None = None, tiers: bool = True) -> DataFrame:
    """`docs`(doc_id, weight, n_tokens) with `is_val`, by the first way that applies.

    Documents of a separate validation table `held` are the held-out ones, and all of `docs` is trained on; else a share
    of every weight tier; else, with `tiers` off, documents that begin in a held-out block; else, with no share
    asked for, none.
    """
    if held is not None:
        return docs.withColumn("is_val", F.lit(False)).unionByName(held.select(docs.columns).withColumn("is_val", F.lit(True)))
    if val_split <= 0:
        return docs.withColumn("is_val", F.lit(False))
    if tiers:
        return tier_split(docs, val_split, seq_len)
    laid = with_offsets(docs, "n_tokens", "doc_id")
    total = laid.agg(F.max("end_off")).first()[0] or 0
    blocks = docs.sparkSession.createDataFrame(block_split(total, val_split, seq_len) if total else [], "b_start long, b_end long, is_val boolean")
    return laid.join(F.broadcast(blocks), (F.col("start_off") >= F.col("b_start")) & (F.col("start_off") < F.col("b_end")), "left").select(*docs.columns, F.coalesce("is_val", F.lit(False)).alias("is_val"))  # at most BLOCKS rows


def pad_left(ids: Column, length: Column | int, pad: int = PAD) -> Column:
    size = F.lit(length) if isinstance(length, int) else length
    return F.concat(F.array_repeat(F.lit(pad), F.greatest(size - F.size(ids), F.lit(0))), ids)


def padded_batches(examples: DataFrame, batch: str) -> DataFrame:
    """`examples`(.., ids, labels) of each batch padded on the left to its longest, with an attention mask."""
    longest = F.max(F.size("ids")).over(Window.partitionBy(batch))
    d = examples.withColumn("_len", longest)
    return d.select(
        *[c for c in examples.columns if c not in ("ids", "labels")],
        pad_left(F.col("ids"), F.col("_len")).alias("ids"),
        pad_left(F.col("labels"), F.col("_len"), IGNORE).alias("labels"),
        F.concat(F.array_repeat(F.lit(0), F.col("_len") - F.size("ids")), F.array_repeat(F.lit(1), F.size("ids"))).alias("mask"),
    )


def pad_right(ids: Column, length: int, bos: int = BOS, pad: int = PAD) -> Column:
    """BOS and the ids, cut or padded on the right to `length`."""
    cut = F.slice(F.concat(F.array(F.lit(bos)), ids), 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.lit(length) - F.size(cut)))


def chat_example(user: Column, assistant: Column, context: Column, max_len: int) -> Column:
    """struct(ids, labels) of one exchange of id arrays; null if either side is empty or no reply survives the cut.

    Layout: BOS [SEP context SEP] USR user AST assistant EOS; a cut keeps the EOS; prompt labels are ignored.
    """
    some = F.coalesce(F.size(context) > 0, F.lit(False))
    head = F.when(some, F.concat(F.array(F.lit(BOS), F.lit(SEP)), context, F.array(F.lit(SEP), F.lit(USR)))).otherwise(F.array(F.lit(BOS), F.lit(USR)))
    prompt = F.concat(head, user, F.array(F.lit(AST)))
    full = F.concat(prompt, assistant, F.array(F.lit(EOS)))
    full = F.when(F.size(full) > max_len, F.concat(F.slice(full, 1, max_len - 1), F.array(F.lit(EOS)))).otherwise(full)
    masked = F.least(F.size(prompt), F.size(full)) - 1
    target = F.slice(full, 2, F.size(full) - 1)
    labels = F.concat(F.array_repeat(F.lit(IGNORE), masked), F.slice(target, masked + 1, F.greatest(F.size(target) - masked, F.lit(0))))
    made = F.struct(F.slice(full, 1, F.size(full) - 1).alias("ids"), labels.alias("labels"))
    return F.when((F.size(user) > 0) & (F.size(assistant) > 0) & (masked < F.size(target)), made)


def shifted_targets(ids: Column, seq_len: int, ahead: int) -> Column:
    """Targets `ahead` positions on, of a window of seq_len + 1 ids; positions without one are ignored."""
    got = F.slice(ids, ahead + 1, seq_len)
    return F.concat(got, F.array_repeat(F.lit(IGNORE), F.lit(seq_len) - F.size(got)))


def difficulty_weights(losses: DataFrame, alpha: float = 1.0, floor: float = 0.05) -> DataFrame:
    """`losses`(.., loss) with `weight`: loss to the power alpha, not under the floor, scaled to mean 1."""
    raw = losses.withColumn("_w", F.greatest(F.pow(F.greatest("loss", F.lit(0.0)), F.lit(alpha)), F.lit(floor)))
    mean = raw.agg(F.avg("_w").alias("_m"))
    return raw.join(F.broadcast(mean)).withColumn("weight", F.col("_w") / F.col("_m")).drop("_w", "_m")  # one row


def weighted_draws(rows: DataFrame, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """(draw, key): n draws with replacement, each row in proportion to its weight.

    Weights are laid end to end by two-level running sums; a draw is a point on that line, and points meet the rows
    in bins of the mean length.  Weights that are negative, not finite or all zero are an error.
    """
    check = rows.agg(F.count("*").alias("n"), F.sum(weight).alias("s"), F.coalesce(F.bool_or((F.col(weight) < 0) | F.isnan(F.col(weight).cast("double")) | (F.abs(F.col(weight)) == float("inf")) | F.col(weight).isNull()), F.lit(False)).alias("bad")).first()
    if check.bad or not check.s or check.s <= 0:
        raise ValueError("weights must be finite and not negative, and not all zero")
    line = with_offsets(rows.select(key, F.col(weight).cast("double").alias("_len")), "_len", key)
    step = float(check.s) / max(1, check.n)
    part = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed)))), 1, 12), 16, 10).cast("double") / float(16**12)
    points = rows.sparkSession.range(n).select(F.col("id").alias("draw"), (part * float(check.s)).alias("at"))
    bins = line.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_off") / step), F.floor(F.col("end_off") / step))))
    met = points.withColumn("_b", F.floor(F.col("at") / step)).join(bins, "_b").filter((F.col("at") >= F.col("start_off")) & (F.col("at") < F.col("end_off")))
    return met.select("draw", key)


def grouped_batches(passages: DataFrame, per_doc: int, docs_per_batch: int, batches: int, seed: int = 0) -> DataFrame:
    """(batch, doc_id, passage_id): batches of several passages of each of several documents.

    Documents are dealt to batches in a hash order, a new order once all have been dealt; the passages of a document
    are taken in a hash order of their own.  Documents with fewer than `per_doc` passages are left out; without any
    other the result is empty.
    """
    if per_doc < 2:
        raise ValueError("a batch needs two passages or more of a document")
    rich = materialize(passages.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") >= per_doc).select("doc_id"), "rich-docs")
    n = rich.count()
    rounds = -(-batches * docs_per_batch // n) if n else 0
    dealt = rich.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(max(rounds - 1, 0))))) if rounds > 1 else rich.withColumn("round", F.lit(0))
    key = F.conv(F.substring(hash_order(F.col("doc_id"), F.col("round"), seed=seed), 1, 12), 16, 10).cast("double") / float(16**12) + F.col("round")
    ranked = with_offsets(dealt.withColumn("_key", key).withColumn("_one", F.lit(1)), "_one", "_key")
    chosen = ranked.withColumn("batch", F.floor(F.col("start_off") / docs_per_batch)).filter(F.col("batch") < batches).select("batch", "doc_id")
    inner = Window.partitionBy("batch", "doc_id").orderBy(hash_order(F.col("passage_id"), F.col("batch"), seed=seed), "passage_id")
    return chosen.join(passages, "doc_id").withColumn("_i", F.row_number().over(inner)).filter(F.col("_i") <= per_doc).select("batch", "doc_id", "passage_id")


def learning_rate(step: Column, peak: float, low: float, warmup: int, total: int) -> Column:
    """Linear warm-up to the peak, then a cosine down to the low rate."""
    progress = (step - warmup) / F.lit(float(max(total - warmup, 1)))
    ratio = low / peak
    factor = F.when(step < warmup, step / F.lit(float(max(warmup, 1)))).otherwise(F.lit(ratio) + F.lit(1 - ratio) * F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * progress)))
    return factor * F.lit(peak)


def model_preset(n_tokens: Column) -> Column:
    """The model size that fits a corpus of so many tokens (fixed cutoffs)."""
    return F.when(n_tokens < 100_000_000, "small-25M").when(n_tokens < 500_000_000, "medium-85M").otherwise("large-250M")


def optimal_steps(n_params: Column, batch: int, accumulate: int, seq_len: int = 1024) -> Column:
    """Steps for twenty tokens per parameter."""
    return F.round(F.lit(20.0) * n_params / float(batch * accumulate * seq_len)).cast("long")


# Epochs by number of examples, for full tuning and for adapters.
FULL_EPOCHS = [(20, 2), (100, 3), (500, 4), (None, 6)]
ADAPTER_EPOCHS = [(20, 4), (100, 6), (500, 8), (None, 12)]


def tuning_epochs(n_examples: Column, adapter: bool = False) -> Column:
    epochs = F.lit(None).cast("int")
    for limit, n in reversed(ADAPTER_EPOCHS if adapter else FULL_EPOCHS):
        epochs = F.lit(n) if limit is None else F.when(n_examples <= limit, F.lit(n)).otherwise(epochs)
    return epochs


def tuning_steps(n_examples: Column, batch: int, accumulate: int, adapter: bool = False) -> Column:
    """Optimizer steps for the epochs that so many examples call for, at least one."""
    return F.greatest(F.round(n_examples * tuning_epochs(n_examples, adapter) / float(batch * accumulate)), F.lit(1.0)).cast("long")
