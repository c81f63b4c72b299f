"""Whole plans: from documents to weighted token windows, and from texts to an evaluated index."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.cleaning import weight_by_glob
from tessella.functions.text_rules import tokens as split_tokens
from tessella.operators import bpe, minhash, quality, training
from tessella.runtime import materialize


@dataclass(frozen=True)
class CorpusPlan:
    """What to do with the documents; None leaves a step out."""

    cutoffs: quality.Cutoffs | None = quality.Cutoffs()
    duplicates: minhash.MinHash | None = minhash.MinHash()
    vocabulary: bpe.Vocabulary | None = None
    weights: list[tuple[str, float]] = field(default_factory=list)


@dataclass
class Corpus:
    """`tokens`: doc_id, source, weight, n_tokens, start_off, end_off (and ids with a vocabulary); `dropped`: the audit."""

    tokens: DataFrame
    dropped: DataFrame | None


def prepare(docs: DataFrame, plan: CorpusPlan = CorpusPlan()) -> Corpus:
    """Filter, deduplicate, tokenize and lay out docs(doc_id, text, source, ..).

    The quality filter comes first, so that junk can't win over its duplicates by length.  Without a vocabulary tokens
    are white-space words.  Every document ends with one end token.
    """
    dropped = None
    kept = docs.select("doc_id", "text", "source")
    if plan.cutoffs is not None:
        judged = materialize(quality.quality_reports(kept, plan.cutoffs), "judged")
        dropped = judged.filter("not is_kept").drop("text")
        kept = judged.filter("is_kept").select("doc_id", "text", "source")
    if plan.duplicates is not None:
        kept = kept if plan.cutoffs is not None else materialize(kept, "documents")
        ids = minhash.kept_ids(kept.select(F.col("doc_id").alias("id"), "text"), plan.duplicates)
        kept = kept.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    if plan.vocabulary is None:
        sized = kept.select("doc_id", "source", (F.size(split_tokens(F.coalesce("text", F.lit("")))) + 1).cast("long").alias("n_tokens"))
    else:
        sized = kept.select("doc_id", "source", bpe.encode(F.coalesce("text", F.lit("")), plan.vocabulary, end=True).alias("ids")).withColumn("n_tokens", F.size("ids").cast("long"))
    weighed = sized.withColumn("weight", weight_by_glob(F.coalesce("source", F.lit("")), plan.weights))
    return Corpus(training.with_offsets(weighed, "n_tokens", "doc_id"), dropped)


def weighted_windows(tokens: DataFrame, seq_len: int, stride: int | None = None, regions: DataFrame | None = None) -> DataFrame:
    """(region_id, offset, doc_id, weight) of training windows; a window has the weight of the document it starts in."""
    if regions is None:
        regions = tokens.agg(F.lit(0).alias("region_id"), F.lit(0).cast("bigint").alias("start"), F.max("end_off").alias("end"))
    starts = training.windows(regions, seq_len, stride)
    return training.containing_document(starts, tokens.select("doc_id", "weight", "start_off", "end_off"), bin_size=max(seq_len * 8, 1024)).select("region_id", "offset", "doc_id", "weight")
