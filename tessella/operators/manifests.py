"""Manifests of sources: content hashes, what changed between two states, and what has to be done again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_manifest(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(name, stamp, hash) of the files of a folder; the stamp is modification time and length."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), F.concat_ws(":", F.col("modificationTime").cast("double"), "length").alias("stamp"), F.md5("content").alias("hash"))


def table_manifest(docs: DataFrame, name: str, text: str, order: str) -> DataFrame:
    """(name, hash): the content hash of the latest text of each name."""
    known = docs.filter(F.col(name).isNotNull()).groupBy(name).agg(F.max_by(F.md5(F.coalesce(F.col(text), F.lit(""))), F.col(order)).alias("hash"))
    return known.select(F.col(name).alias("name"), "hash")


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, status): added, removed, changed or same."""
    both = old.select("name", F.col("hash").alias("was")).join(new.select("name", F.col("hash").alias("is")), "name", "full")
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed").otherwise("same")
    return both.select("name", status.alias("status"))


def is_stale(old: DataFrame, new: DataFrame) -> bool:
    """Whether anything differs; the comparison stops at the first difference."""
    return not compare(old, new).filter("status <> 'same'").isEmpty()
