"""Cutting lineage with tables in the shared folder, and size-checked broadcasts.

A long lineage is recomputed when an executor is lost.  `materialize` writes an
intermediate result as Parquet under the folder that the cluster names in
`spark.checkpoint.dir`, so that every executor can read it again.  Where that
setting is missing (local tests) a temporary folder is used instead.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterable
from functools import cache

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or a local one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    local = getattr(spark, "_tessella_folder", None)
    if local is None:
        local = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark._tessella_folder = local
    return local


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; whatever lies there is removed when the program ends."""
    path = f"{shared_folder(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """`path` with the scheme of its file system, as Hadoop has it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


@cache
def _system(start: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(start)


def arrow_path(place: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a qualified path, and the path within it."""
    if place.startswith("file:"):
        return fs.LocalFileSystem(), "/" + place.removeprefix("file:").lstrip("/")
    scheme, _, rest = place.partition("://")
    host, _, path = rest.partition("/")
    system, base = _system(f"{scheme}://{host}/")
    return system, f"{base.rstrip('/')}/{path}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: the lineage ends at the files."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessella_path = path
    return out


def materialize_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """`parts`, of like columns, written one after the other to one table of the shared folder, and read back.

    The shuffle files of a part go before the next one is made, so that the disk holds those of one part at a time.
    """
    path, schema = None, None
    for part in parts:
        spark, schema = part.sparkSession, part.schema
        path = path or scratch(spark, name)
        part.write.mode("append").parquet(path)
        release(spark)
    out = spark.read.schema(schema).parquet(path)
    out._tessella_path = path
    return out


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished writes removed: Spark does so once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Remove the files of a table that `materialize` or `materialize_parts` wrote and nothing reads any more."""
    path = getattr(df, "_tessella_path", None)
    if path is not None:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before; the folder belongs to the job and goes with it
            return


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, bound: int = 64 << 20) -> DataFrame:
    """`df` with a broadcast hint when `rows * row_bytes` is within `bound`; unchanged otherwise.

    `rows` must have been counted, not guessed.  Beyond the bound the planner shuffles.
    """
    return F.broadcast(df) if rows * row_bytes <= bound else df


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt out over the cores where its scan would occupy less than half of them; unchanged otherwise.

    A few unsplittable files would leave all later work on a few tasks.  Data large enough to fill the cluster has
    more splits than cores and is never shuffled by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() <= cores else df
