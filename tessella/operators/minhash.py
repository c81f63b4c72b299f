"""Near-duplicate documents by MinHash signatures, bands and connected groups.

Signatures are made in Arrow batches (hashing dominates); banding, confirmation and grouping are joins.  Bands whose
bucket holds many documents are handled by star links: the documents of one bucket that have the same whole signature
are one node, so that a bucket of copies costs a row per copy and not a pair per two.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.graphs import components
from tessella.runtime import broadcast_if_small, materialize


@dataclass(frozen=True)
class MinHash:
    """Fixed values of the default comparison."""

    k: int = 5
    permutations: int = 128
    bands: int = 32
    threshold: float = 0.8
    seed: int = 0

    def __post_init__(self) -> None:
        if self.permutations % self.bands:
            raise ValueError(f"{self.permutations} permutations don't divide into {self.bands} bands")

    @property
    def rows(self) -> int:
        return self.permutations // self.bands

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        """Odd multipliers and offsets, drawn in a fixed order from one generator."""
        rng = np.random.default_rng(self.seed)
        a = rng.integers(0, 1 << 32, size=self.permutations, dtype=np.uint64) | np.uint64(1)
        return a, rng.integers(0, 1 << 32, size=self.permutations, dtype=np.uint64)


_WORD = re.compile(r"\w+")
NOTHING = (1 << 32) - 1


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Distinct hashes of the runs of k words: the first four SHA-1 bytes, little end first.  A short text is one run."""
    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    runs = ["\x00".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    digests = b"".join(hashlib.sha1(r.encode()).digest()[:4] for r in set(runs))
    return np.unique(np.frombuffer(digests, dtype="<u4")).astype(np.uint64)


def shingles(c: Column, k: int = 5) -> Column:
    """The distinct shingle hashes of a text as an array of longs."""

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingle_hashes(t, k).astype(np.int64))

    return hashes(c)


def signature(c: Column, p: MinHash = MinHash()) -> Column:
    """The signature of a text as an array of longs; an empty text has none (null) and matches nothing."""
    a, b = p.coefficients()

    @F.pandas_udf("array<long>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts:
                h = shingle_hashes(text, p.k)
                out.append(None if not len(h) else ((np.outer(a, h) + b[:, None]) & np.uint64(NOTHING)).min(axis=1).astype(np.int64))
            yield pd.Series(out)

    return sign(c)


def agreement(x: Column, y: Column, p: MinHash) -> Column:
    return F.size(F.filter(F.zip_with(x, y, lambda u, v: u == v), lambda e: e)) / F.lit(float(p.permutations))


def band_keys(signatures: DataFrame, p: MinHash) -> DataFrame:
    """(node, band, key): the bands of each signature.  Needs node, signature."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(p.bands - 1)), lambda i: F.struct(i.alias("band"), F.array_join(F.slice("signature", i * p.rows + 1, p.rows), "-").alias("key")))
    return signatures.select("node", F.explode(keys).alias("e")).select("node", "e.band", "e.key")


def bucket_pairs(rows: DataFrame, block: int = 512) -> DataFrame:
    """(a, b): the pairs of nodes of each bucket, once a bucket.  Needs node, bucket.

    Buckets of over `block` nodes are cut into blocks, and every two blocks are joined by themselves, so that no task
    holds a whole large bucket.
    """
    rows = materialize(rows, "buckets")
    large = materialize(rows.groupBy("bucket").agg(F.count("*").alias("c")).filter(F.col("c") > block).select("bucket", F.ceil(F.col("c") / block).cast("int").alias("blocks")), "large-buckets")
    n = large.count()
    if not n:
        x, y, on = rows.alias("x"), rows.alias("y"), ["bucket"]
    else:
        cut = rows.join(broadcast_if_small(large, n, 16), "bucket", "left").withColumn("block", F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
        cell = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
        # an entry meets the blocks from its own on as left side, and those up to its own as right side; of its own both
        sent = cut.select("bucket", "node", "block", cell.alias("other"))
        left = sent.filter("other >= block").select("bucket", F.col("block").alias("i"), F.col("other").alias("j"), "node")
        right = sent.filter("other <= block").select("bucket", F.col("other").alias("i"), F.col("block").alias("j"), "node")
        x, y, on = left.alias("x"), right.alias("y"), ["bucket", "i", "j"]
        met = x.join(y, on).filter((F.col("i") != F.col("j")) | (F.col("x.node") < F.col("y.node")))
        return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    return x.join(y, on).filter("x.node < y.node").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def similar_pairs(docs: DataFrame, p: MinHash = MinHash()) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (id, node) with one node per distinct signature, and confirmed (a, b) pairs of nodes.

    Needs docs(id, text).  Every pair of nodes that meets in a band is confirmed on the whole signature.
    """
    signed = materialize(docs.select("id", signature(F.col("text"), p).alias("signature")).filter("signature is not null"), "signatures")
    members = signed.select("id", F.xxhash64("signature").alias("node"))
    nodes = signed.select(F.xxhash64("signature").alias("node"), "signature").dropDuplicates(["node"])
    pairs = bucket_pairs(band_keys(nodes, p).select("node", F.xxhash64("band", "key").alias("bucket"))).distinct()
    sides = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa")), nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    confirmed = pairs.join(sides[0], "a").join(sides[1], "b").filter(agreement(F.col("sa"), F.col("sb"), p) >= p.threshold).select("a", "b")
    return members, confirmed


def clusters(docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """(id, cluster_id): documents in groups of two or more; the cluster is named by its least id."""
    members, pairs = similar_pairs(docs, p)
    roots = components(pairs)
    placed = members.join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("root"))
    sizes = placed.groupBy("root").agg(F.count("*").alias("n"), F.min("id").alias("cluster_id")).filter("n > 1")
    return placed.join(sizes, "root").select("id", "cluster_id")


def kept_ids(docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """(id): documents in no cluster, and of each cluster the longest, of equals the one of least id."""
    grouped = clusters(docs, p).join(docs.select("id", F.length(F.coalesce("text", F.lit(""))).alias("n")), "id")
    best = grouped.groupBy("cluster_id").agg(F.max_by("id", F.struct("n", -F.col("id"))).alias("id"))
    return docs.select("id").join(grouped.select("id"), "id", "left_anti").unionByName(best.select("id"))


def matches_of_new(new: DataFrame, everything: DataFrame, p: MinHash) -> DataFrame:
    """(a, b, similarity): pairs of a new document and any other, each pair once, similarity as signature agreement.

    Signatures that agree on enough positions differ on few, so of one more group of positions than may differ at
    least one group is equal as a whole.  Documents meet on whole groups, which loses no pair and keeps the keys rare;
    pairs are then confirmed on the signatures.
    """
    n_groups = p.permutations - max(1, math.ceil(p.threshold * p.permutations - 1e-9)) + 1
    cuts = [round(i * p.permutations / n_groups) for i in range(n_groups + 1)]

    def signed(docs: DataFrame, name: str) -> DataFrame:
        return materialize(docs.select("id", signature(F.col("text"), p).alias("signature")).filter("signature is not null"), name)

    def keys(docs: DataFrame, side: str) -> DataFrame:
        groups = F.array(*[F.struct(F.lit(g).alias("g"), F.xxhash64(F.slice("signature", cuts[g] + 1, cuts[g + 1] - cuts[g])).alias("key")) for g in range(n_groups)])
        return docs.select(F.col("id").alias(side), F.explode(groups).alias("e")).select(side, "e.g", "e.key")

    left, right = signed(new, "new-signatures"), signed(everything, "signatures")
    met = keys(left, "x").join(keys(right, "y"), ["g", "key"]).filter("x <> y").select("x", "y").distinct()
    sides = left.select(F.col("id").alias("x"), F.col("signature").alias("sx")), right.select(F.col("id").alias("y"), F.col("signature").alias("sy"))
    scored = met.join(sides[0], "x").join(sides[1], "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), agreement(F.col("sx"), F.col("sy"), p).alias("similarity"))
    return scored.filter(F.col("similarity") >= p.threshold).distinct()
