"""The test tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.runtime import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def reposted(spark: SparkSession, folder: str) -> DataFrame:
    """(tbl, id, text) of the three fields whose records are reposted."""
    parts = [("qa_pairs", "pair_id", "answer"), ("finetune_examples", "example_id", "context"), ("ngram_index", "entry_id", "excerpt")]
    shaped = [table(spark, folder, t).select(F.lit(t).alias("tbl"), F.col(i).alias("id"), F.col(x).alias("text")) for t, i, x in parts]
    return shaped[0].unionByName(shaped[1]).unionByName(shaped[2])


def question_replies(spark: SparkSession, folder: str) -> DataFrame:
    """(tbl, id, question, reply) of both kinds of pairs; the old export's aliases are resolved."""
    qa = table(spark, folder, "qa_pairs").select(F.lit("qa_pairs").alias("tbl"), F.col("pair_id").alias("id"), "question", F.col("answer").alias("reply"))
    ft = table(spark, folder, "finetune_examples").select(
        F.lit("finetune_examples").alias("tbl"),
        F.col("example_id").alias("id"),
        F.coalesce("user_text", "prompt").alias("question"),
        F.when(F.col("user_text").isNull(), F.col("response")).otherwise(F.col("assistant")).alias("reply"),
    )
    return qa.unionByName(ft)


def judged_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(tbl, id, text) of excerpts and documents."""
    a = table(spark, folder, "ngram_index").select(F.lit("ngram_index").alias("tbl"), F.col("entry_id").alias("id"), F.col("excerpt").alias("text"))
    b = table(spark, folder, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("id"), "text")
    return a.unionByName(b)
