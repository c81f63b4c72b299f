"""Byte-pair encoding: training on distributed word counts, encoding in Arrow batches, and streaming decoding."""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.runtime import materialize

from tessella.functions.text_rules import runs

# Special tokens by id, the split pattern, and the layout of ids.
SPECIAL = ["<PAD>", "<BOS>", "<EOS>", "<SEP>", "<USR>", "<AST>"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\w+| ?[^\s\w]+|\s+(?!\S)|\s"
FIRST_BYTE = len(SPECIAL)
FIRST_MERGE = FIRST_BYTE + 256
_split = re.compile(SPLIT)
_special = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where it is one, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


_symbols = byte_symbols()
_bytes = {s: b for b, s in enumerate(_symbols)}


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): pre-tokens and their counts; Java's classes are spelled out to split as the encoder does."""
    java = SPLIT.replace(r"[^\s\w]", r"[^\s\p{Z}\x1c-\x1f\x85\p{L}\p{N}_]").replace(r"\w", r"[\p{L}\p{N}_]").replace(r"(?!\S)", r"(?![^\s\p{Z}\x1c-\x1f\x85])")
    java = re.sub(r"\\s\+\(|\|\\s$", lambda m: m.group().replace(r"\s", r"[\s\p{Z}\x1c-\x1f\x85]"), java)
    words = F.regexp_extract_all(F.col(text), F.lit(f"({java})"), F.lit(1))
    return texts.filter(F.col(text).isNotNull()).select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def pair_counts(words: DataFrame) -> DataFrame:
    """(left, right, n): neighbouring symbols of words(symbols, n), weighted by the words' counts."""
    return words.select(F.explode(runs(F.col("symbols"), 2)).alias("p"), "n").groupBy(F.col("p.r0").alias("left"), F.col("p.r1").alias("right")).agg(F.sum("n").alias("n"))


class Vocabulary:
    """Merge rules in rank order and the ids they give."""

    def __init__(self, merges: list[tuple[str, str]]):
        self.merges = [tuple(m) for m in merges]
        self.ids = {s: i for i, s in enumerate(SPECIAL)} | {s: FIRST_BYTE + b for b, s in enumerate(_symbols)}
        for a, b in self.merges:
            self.ids[a + b] = len(self.ids)
        self.rank = {m: r for r, m in enumerate(self.merges)}
        self.text = {i: s for s, i in self.ids.items()}
        self.known: dict[str, list[int]] = {}

    def __len__(self) -> int:
        return len(self.ids)

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps({"vocab_size": len(self), "vocab": self.ids, "merges": [list(m) for m in self.merges]}, ensure_ascii=False), encoding="utf-8")

    @staticmethod
    def load(path: str) -> Vocabulary:
        return Vocabulary([tuple(m) for m in json.loads(Path(path).read_text(encoding="utf-8"))["merges"]])

    def _word(self, word: str) -> list[int]:
        got = self.known.get(word)
        if got is None:
            parts = [_symbols[b] for b in word.encode("utf-8")]
            while len(parts) > 1:
                r, at = min(((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(parts, parts[1:]))))
                if r == len(self.rank):
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(self.known) > 300_000:
                self.known.clear()
            got = self.known[word] = [self.ids[p] for p in parts]
        return got

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in filter(None, _special.split(text)):
            if part in SPECIAL:
                out.append(SPECIAL.index(part))
            else:
                for word in _split.findall(part):
                    out += self._word(word)
        return out

    def decoder(self) -> Decoder:
        return Decoder(self)

    def decode(self, ids: list[int]) -> str:
        d = self.decoder()
        return "".join(map(d.push, ids)) + d.finish()


class Decoder:
    """Text of ids as they come; the bytes of an unfinished character are held back."""

    def __init__(self, vocabulary: Vocabulary):
        self.text, self.held = vocabulary.text, b""

    def push(self, i: int) -> str:
        symbol = self.text.get(i)
        if symbol is None:
            return ""
        if i < FIRST_BYTE:
            return self.finish() + symbol
        return self._extend([symbol])

    def push_all(self, ids: Iterable[int]) -> str:
        """What pushing the ids one after the other gives; their bytes are put together before they are decoded."""
        out, waiting = [], []
        for i in ids:
            symbol = self.text.get(i)
            if symbol is not None and i < FIRST_BYTE:
                out += [self._extend(waiting), self.finish(), symbol]
                waiting = []
            elif symbol is not None:
                waiting.append(symbol)
        return "".join([*out, self._extend(waiting)])

    def _extend(self, symbols: list[str]) -> str:
        self.held += bytes(map(_bytes.__getitem__, "".join(symbols)))
        try:
            whole = len(self.held)
            text = self.held.decode("utf-8")
        except UnicodeDecodeError as e:
            whole = e.start
            text = self.held[:whole].decode("utf-8")
        self.held = self.held[whole:]
        return text

    def finish(self) -> str:
        text, self.held = self.held.decode("utf-8", errors="replace"), b""
        return text

    def preview(self) -> str:
        return self.held.decode("utf-8", errors="replace")


def learn(counts: dict[str, int], size: int, start: Vocabulary | None = None) -> Vocabulary:
    """Merge rules from counts of distinct words, until the vocabulary has `size` entries or no pair is left.

    Pair counts are kept up to date and the most frequent pair comes from a heap, so a merge costs only the words that
    hold its pair.  Equal counts go to the alphabetically first pair.  No merge may spell a special token.  `start`
    keeps its rules and ids; more are added.
    """
    if size < FIRST_MERGE:
        raise ValueError(f"a vocabulary has at least {FIRST_MERGE} entries")
    if start is not None and size <= len(start):
        raise ValueError("an extended vocabulary must grow")
    words = [([_symbols[b] for b in w.encode("utf-8")], n) for w, n in sorted(counts.items())]
    pairs: Counter = Counter()
    where: dict[tuple[str, str], set[int]] = defaultdict(set)
    for k, (parts, n) in enumerate(words):
        for p in zip(parts, parts[1:]):
            pairs[p] += n
            where[p].add(k)
    heap = [(-n, p) for p, n in pairs.items()]
    heapq.heapify(heap)
    merges: list[tuple[str, str]] = []

    def apply(pair: tuple[str, str]) -> None:
        changed: set[tuple[str, str]] = set()
        for k in where.pop(pair, ()):
            parts, n = words[k]
            for p in zip(parts, parts[1:]):
                pairs[p] -= n
                changed.add(p)
            new, i = [], 0
            while i < len(parts):
                hit = i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair
                new.append(parts[i] + parts[i + 1] if hit else parts[i])
                i += 2 if hit else 1
            words[k] = (new, n)
            for p in zip(new, new[1:]):
                pairs[p] += n
                where[p].add(k)
                changed.add(p)
        for p in changed:
            if pairs[p] > 0:
                heapq.heappush(heap, (-pairs[p], p))

    for pair in start.merges if start else []:
        merges.append(pair)
        apply(pair)
    made = {a + b for a, b in merges}
    while len(merges) < size - FIRST_MERGE and heap:
        n, pair = heapq.heappop(heap)
        if pairs[pair] != -n or n == 0:
            continue
        if pair[0] + pair[1] in SPECIAL or pair[0] + pair[1] in made:
            pairs[pair] = 0
            continue
        merges.append(pair)
        made.add(pair[0] + pair[1])
        apply(pair)
    return Vocabulary(merges)


def train(texts: DataFrame, size: int, text: str = "text", most_words: int = 2_000_000, start: Vocabulary | None = None) -> Vocabulary:
    """A vocabulary from all texts: counting is distributed; the distinct words come to the driver.

    More than `most_words` of them are an error, never a shorter list: raise the bound, and the driver's memory with it
    (some 300 bytes a word), or train on fewer texts.
    """
    counts = materialize(word_counts(texts, text), "word-counts")
    n = counts.count()
    if n > most_words:
        raise ValueError(f"{n} distinct words are more than the driver may hold ({most_words})")
    return learn({r.word: r.n for r in counts.toLocalIterator()}, size, start)


def encode(c: Column, vocabulary: Vocabulary, end: bool = False) -> Column:
    """Ids of a text; with `end` the end-of-document id follows."""
    merges = vocabulary.merges
    state: dict = {}

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = state.setdefault("v", Vocabulary(merges))
        for batch in batches:
            yield batch.map(lambda t: None if t is None else v.encode(t) + ([2] if end else []))

    return ids(c)


def decode(c: Column, vocabulary: Vocabulary) -> Column:
    merges = vocabulary.merges
    state: dict = {}

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = state.setdefault("v", Vocabulary(merges))
        for batch in batches:
            yield batch.map(lambda x: None if x is None else v.decode([int(i) for i in x]))

    return text(c)
