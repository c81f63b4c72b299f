"""Held-out passages inside a corpus: a prefix-filtered set join with positional bounds and an exact check.

Items are a small stated query set; the corpus is only scanned, never shuffled.

1. Count, over the whole corpus, in how many texts each item shingle occurs; this orders shingles by rarity.
2. A leak holds a piece of at least `m` words of an item with at most `e` errors.  An error breaks at most n shingles,
   so of the m-n+1 shingles of a piece at least all but e*n are intact, and one of its e*n+1 rarest must be there.
   The necessary prefix of an item is the union of those over all its pieces.
3. Texts that meet a prefix shingle are candidates for that item.  Length bound: the text must have m-e words.
   Positional bound: the piece can only lie in the item-sized window around the meeting point.
4. Each window is aligned with the item word by word; the leak stands if a piece of m words has at most e errors.

Words are maximal runs of letters or digits, lower-cased, so case, punctuation, spacing, line breaks, quote and
emphasis marks don't matter.  Null or short texts and items hold no leak.  Repeated texts under different ids are
reported each; repeated rows of one id once.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import hash_words, shingle_hashes, split_words


@dataclass(frozen=True)
class Leaks:
    """`share` of an item's words in one piece, `errors` per word of it; items under `min_words` words are passed over.

    `items_per_block` and `chars_per_block` bound what is sent to the tasks: a longer list of items, or one of longer
    passages, is worked through in blocks of about that size.
    """

    share: float = 0.5
    errors: float = 0.1
    shingle: int = 3
    min_words: int = 8
    items_per_block: int = 20_000
    chars_per_block: int = 20_000_000
    texts_per_block: int = 1000


def piece_bounds(n_words: int, p: Leaks) -> tuple[int, int]:
    """Words m that a piece must have and errors e that it may have."""
    m = math.ceil(n_words * p.share)
    return m, math.ceil(m * p.errors)


def necessary_prefix(hashes: list[int], m: int, e: int, n: int, rarity: dict[int, int]) -> set[int]:
    """Shingles of which every piece of m words with at most e errors has one.  `hashes`: the item's, in order."""
    need, width = e * n + 1, max(1, m - n + 1)
    if need > width:  # so short a piece may have no intact shingle; all are taken
        return set(hashes)
    got: set[int] = set()
    for start in range(len(hashes) - width + 1):
        got.update(sorted(set(hashes[start : start + width]), key=lambda h: (rarity.get(h, 0), h))[:need])
    return got


def _counter(known: np.ndarray, p: Leaks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for s in range(0, len(texts), p.texts_per_block):
                flat, offsets = hash_words([split_words(t) for t in texts[s : s + p.texts_per_block]])
                value, owner, _ = shingle_hashes(flat, offsets, p.shingle)
                at = np.searchsorted(known, value)
                at[at == len(known)] = 0
                hit = known[at] == value
                pairs = np.unique(owner[hit] * len(known) + at[hit])
                total += np.bincount(pairs % len(known), minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(known[some].view(np.int64)), pa.array(total[some])], names=["h", "n"])

    return run


def best_piece(item: np.ndarray, window: np.ndarray, m: int, rate: float) -> bool:
    """Whether a run of at least m item words aligns to a run of the window with errors within `rate` of its words.

    Local alignment: a match gains 1, a changed, added or left-out word costs 2; on the best path, the longest stretch
    within the rate is sought.
    """
    gain = np.where(item[:, None] == window[None, :], 1, -2)
    rows, cols = gain.shape
    score = np.zeros((rows + 1, cols + 1), dtype=np.int32)
    steps = 2 * np.arange(cols + 1, dtype=np.int32)
    for i in range(1, rows + 1):
        up = np.maximum(score[i - 1, :-1] + gain[i - 1], score[i - 1, 1:] - 2)
        up = np.maximum(up, 0)
        # a left gap carries on from any earlier column: running maximum of score + 2 * column
        run = np.maximum.accumulate(np.concatenate([[0], up + steps[1:]]))
        score[i, 1:] = np.maximum(run[1:] - steps[1:], 0)
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    path: list[tuple[int, int]] = []  # (item words used, errors) of each step, from the end
    while score[i, j] > 0:
        here = score[i, j]
        if i and j and here == score[i - 1, j - 1] + gain[i - 1, j - 1]:
            path.append((1, int(gain[i - 1, j - 1] < 0)))
            i, j = i - 1, j - 1
        elif i and here == score[i - 1, j] - 2:
            path.append((1, 1))
            i -= 1
        elif j and here == score[i, j - 1] - 2:
            path.append((0, 1))
            j -= 1
        else:
            break
    used = np.concatenate([[0], np.cumsum([u for u, _ in path])])
    wrong = np.concatenate([[0], np.cumsum([w for _, w in path])])
    if used[-1] < m:
        return False
    for a in range(len(used)):
        b = np.flatnonzero((used - used[a] >= m) & (wrong - wrong[a] <= np.ceil((used - used[a]) * rate)))
        if len(b):
            return True
    return False


def _finder(items: list[tuple[int, np.ndarray]], prefixes: dict[int, list[tuple[int, int]]], p: Leaks):
    """Rows (id, text) to (id, item): prefix shingles met, bounds, alignment of item-sized windows."""
    known = np.array(sorted(prefixes), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            got_id, got_item = [], []
            for s in range(0, len(texts), p.texts_per_block):
                flat, offsets = hash_words([split_words(t) for t in texts[s : s + p.texts_per_block]])
                value, owner, first = shingle_hashes(flat, offsets, p.shingle)
                at = np.searchsorted(known, value)
                at[at == len(known)] = 0
                hits = np.flatnonzero(known[at] == value)
                places: dict[tuple[int, int], list[int]] = defaultdict(list)
                for h in hits.tolist():
                    for item, where in prefixes[int(value[h])]:
                        places[int(owner[h]), item].append(int(first[h]) - where)
                for (t, item), starts in places.items():
                    words = items[item][1]
                    m, e = piece_bounds(len(words), p)
                    text = flat[offsets[t] : offsets[t + 1]]
                    if len(text) < m - e:
                        continue
                    slack, covered = e + 1, -(10**9)
                    for start in sorted(set(starts)):
                        if start <= covered:
                            continue
                        low, high = max(0, start - slack), min(len(text), start + len(words) + 2 * slack)
                        covered = start + slack // 2
                        window = text[low:high]
                        if np.isin(window, words).sum() < m - e:
                            continue
                        if best_piece(words, window, m, p.errors):
                            got_id.append(ids[s + t])
                            got_item.append(items[item][0])
                            break
            yield pa.record_batch([pa.array(got_id, pa.int64()), pa.array(got_item, pa.int64())], names=["id", "item"])

    return run


def find_leaks(texts: DataFrame, items: DataFrame, p: Leaks = Leaks()) -> DataFrame:
    """(id, item): texts that hold a piece of an item.  Needs texts(id, text) and items(item, passage).

    The items come to the driver in blocks; of the corpus only counts of item shingles do.
    """
    plain = texts.filter(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "text")
    shaped = items.filter(F.col("item").isNotNull() & F.col("passage").isNotNull()).select("item", "passage").distinct()
    size = shaped.agg(F.count("*").alias("n"), F.sum(F.length("passage")).alias("chars")).first()
    blocks = max(1, -(-size["n"] // p.items_per_block), -(-(size["chars"] or 0) // p.chars_per_block))
    found = None
    for b in range(blocks):
        rows = shaped.filter(F.pmod(F.xxhash64("item", "passage"), F.lit(blocks)) == b).orderBy("item", "passage").collect()
        flat, offsets = hash_words([split_words(r.passage) for r in rows])
        block = [(r.item, flat[offsets[i] : offsets[i + 1]]) for i, r in enumerate(rows)]
        block = [x for x in block if len(x[1]) >= p.min_words]
        if not block:
            continue
        shingles = [[int(h) for h in shingle_hashes(w, np.array([0, len(w)]), p.shingle)[0]] for _, w in block]
        known = np.array(sorted({h for s in shingles for h in s}), dtype=np.uint64)
        counts = plain.select("text").mapInArrow(_counter(known, p), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        rarity = {r.h & 0xFFFFFFFFFFFFFFFF: r.n for r in counts.collect()}  # at most the shingles of one block of items
        prefixes: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, words) in enumerate(block):
            m, e = piece_bounds(len(words), p)
            prefix = necessary_prefix(shingles[k], m, e, p.shingle, rarity)
            for where, h in enumerate(shingles[k]):
                if h in prefix:
                    prefixes[h].append((k, where))
        got = plain.mapInArrow(_finder(block, dict(prefixes), p), "id long, item long")
        found = got if found is None else found.unionByName(got)
    if found is None:
        return plain.select(F.col("id").cast("long").alias("id"), F.lit(None).cast("long").alias("item")).limit(0)
    return found.distinct()
