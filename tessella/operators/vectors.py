"""Passage vectors: hashing embeddings, exact cosine search in blocks, and incremental indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.passages import chunk_documents


def unit(v: Column) -> Column:
    """A vector scaled to length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hashing_embedder(dim: int = 64):
    """A deterministic stand-in for a sentence encoder: signed counts of hashed words, scaled to length 1."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                h = xxhash.xxh64_intdigest(w)
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32))
        return pd.Series(out)

    return embed


def index_passages(docs: DataFrame, embed, known_sources: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, chunk_no, passage, embedding) of documents whose source isn't indexed yet.

    Passages of like length go through the encoder together, which keeps its padding small.
    """
    new = docs if known_sources is None else docs.join(known_sources.select("source").distinct(), "source", "left_anti")
    return chunk_documents(new).sortWithinPartitions(F.length("passage")).withColumn("embedding", embed("passage"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, queries_per_block: int = 2000, skip_self: bool = False) -> DataFrame:
    """(query_id, rank, id, score): the k rows of highest dot product with each query, exactly.

    Needs vectors(id, embedding) and queries(query_id, embedding); with unit vectors the product is the cosine.  Queries
    are a stated set: they come to the driver in blocks of `queries_per_block` vectors and each block meets all rows
    by matrix products; every task keeps its k best per query, so that at most tasks * queries * k rows are shuffled.
    Null vectors match nothing; equal scores go by id.
    """
    wanted = queries.filter("embedding is not null and query_id is not null").select("query_id", "embedding")
    n = wanted.count()
    blocks = max(1, -(-n // queries_per_block))
    best = None
    for b in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        ids = np.array([r.query_id for r in rows], dtype=np.int64)
        matrix = np.array([r.embedding for r in rows], dtype=np.float64)

        def run(batches: Iterator[pa.RecordBatch], ids=ids, matrix=matrix) -> Iterator[pa.RecordBatch]:
            held_id = np.zeros((len(ids), 0), dtype=np.int64)
            held_score = np.zeros((len(ids), 0))
            for batch in batches:
                column = batch.column("embedding")
                there = np.flatnonzero(~np.array(column.is_null()))
                if not len(there):
                    continue
                own = batch.column("id").to_numpy(zero_copy_only=False)[there]
                rows_ = np.array(column.take(pa.array(there)).to_pylist(), dtype=np.float64)
                score = matrix @ rows_.T
                if skip_self:
                    score[ids[:, None] == own[None, :]] = -np.inf
                ids_ = np.concatenate([held_id, np.broadcast_to(own, score.shape)], axis=1)
                score = np.concatenate([held_score, score], axis=1)
                order = np.lexsort((ids_, -score), axis=1)[:, :k]
                held_id, held_score = np.take_along_axis(ids_, order, 1), np.take_along_axis(score, order, 1)
            keep = np.isfinite(held_score)
            who = np.broadcast_to(ids[:, None], held_id.shape)
            yield pa.record_batch([pa.array(who[keep]), pa.array(held_id[keep]), pa.array(held_score[keep])], names=["query_id", "id", "score"])

        part = vectors.select("id", "embedding").mapInArrow(run, "query_id long, id long, score double")
        best = part if best is None else best.unionByName(part)
    if best is None:
        return vectors.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), F.col("id").cast("long").alias("id"), F.lit(0.0).alias("score")).limit(0)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
