"""Sinks: token tables, audits, chunked texts, JSON lines, indexes with a manifest, and reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators.training import with_offsets
from tessella.runtime import arrow_path, broadcast_if_small, materialize, qualified


def write_tokens(tokens: DataFrame, path: str) -> None:
    """Token rows with offsets and weights as columns; a job either commits whole or not at all."""
    tokens.write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The token table; rows that haven't as many weights as tokens are an error."""
    got = spark.read.parquet(path)
    if "weights" in got.columns:
        bad = got.filter(F.coalesce(F.size("ids"), F.lit(-1)) != F.coalesce(F.size("weights"), F.lit(-1))).limit(1).count()
        if bad:
            raise ValueError(f"tokens and weights of {path} differ in length")
    return got


def write_dropped(reports: DataFrame, path: str) -> None:
    """The documents that failed, with reasons and statistics, as JSON lines."""
    reports.filter("not is_kept").write.mode("overwrite").json(path)


def chunked(records: DataFrame, per_file: int, order: str, within: str | None = None) -> DataFrame:
    """`records` with `file_no`: N consecutive records to a file by a numeric order, or within each value of `within`."""
    if within is None:
        numbered = with_offsets(records.withColumn("_one", F.lit(1)), "_one", order).withColumn("_i", F.col("start_off"))
    else:
        numbered = records.withColumn("_i", F.row_number().over(Window.partitionBy(within).orderBy(order)) - 1)
    return numbered.select(*records.columns, F.floor(F.col("_i") / per_file).cast("int").alias("file_no"))


def write_chunks(records: DataFrame, text: str, per_file: int, order: str, path: str, prefix: str) -> None:
    """Text files of N records each, named by prefix and number."""
    files = chunked(records, per_file, order).groupBy("file_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n\n").alias("value"))  # N records to a file
    named = files.select(F.format_string(f"{prefix}_%04d", "file_no").alias("name"), "value")
    named.write.mode("overwrite").partitionBy("name").text(path)


def write_text_files(records: DataFrame, key: str, text: str, path: str) -> None:
    """A text file for every row, `path`/`key`=value-number.txt; the numbers tell rows of one key apart.

    Tasks write through Arrow's file systems: Spark's writer needs a folder for each value, and starts a program for the
    rights of each folder and file where Hadoop's native library is missing.  A task that is run again writes the
    same files.  Texts are shuffled only where several rows have one key.
    """
    spark = records.sparkSession
    root = qualified(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = arrow_path(root)
        last, n = object(), 0
        for batch in batches:
            for value, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                last, n = value, n + 1 if value == last else 0
                with system.open_output_stream(f"{base}/{key}={'null' if value is None else value}-{n:05d}.txt") as out:
                    out.write(f"{content or ''}\n".encode())
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    def write(rows: DataFrame) -> None:
        rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()

    system, base = arrow_path(root)
    system.create_dir(base)
    rows = records.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    again = materialize(rows.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k"), "repeated-keys")
    n = again.count()
    if n:
        again = broadcast_if_small(again, n, 64)
        same = rows.alias("r").join(again.alias("a"), F.expr("r.k <=> a.k"), "left_semi")
        write(same.repartition("k").sortWithinPartitions("k", "t"))
        rows = rows.alias("r").join(again.alias("a"), F.expr("r.k <=> a.k"), "left_anti")
    write(rows)


def write_jsonl(examples: DataFrame, path: str, append: bool = False) -> None:
    examples.write.mode("append" if append else "overwrite").json(path)


def save_index(index: DataFrame, manifest: DataFrame, path: str, **facts: object) -> None:
    """An index table, its source hashes, and one row of facts about it; the facts are written last and mark it whole."""
    index.write.mode("overwrite").parquet(f"{path}/index")
    manifest.write.mode("overwrite").parquet(f"{path}/sources")
    spark = index.sparkSession
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "facts string").coalesce(1).write.mode("overwrite").json(f"{path}/facts")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    facts = json.loads(spark.read.schema("facts string").json(f"{path}/facts").first().facts)
    return spark.read.parquet(f"{path}/index"), spark.read.parquet(f"{path}/sources"), facts


def write_report(parts: dict[str, DataFrame], path: str, earlier: dict | None = None) -> dict:
    """One-row results: the report as one JSON file under `path`/report, its numbers with their change against an
    `earlier` report, as JSON lines under `path`/values.  Returns the report.
    """
    report = {name: df.first().asDict(recursive=True) for name, df in parts.items()}
    spark = next(iter(parts.values())).sparkSession
    spark.createDataFrame([(json.dumps(report, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")
    rows = []
    for part, values in report.items():
        for name, value in values.items():
            if isinstance(value, (int, float)) and not isinstance(value, bool):
                was = (earlier or {}).get(part, {}).get(name)
                rows.append((part, name, float(value), None if was is None else float(value - was)))
    spark.createDataFrame(rows, "part string, name string, value double, delta double").coalesce(1).write.mode("overwrite").json(f"{path}/values")
    return report
