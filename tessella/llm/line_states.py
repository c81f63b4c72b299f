"""Text statistics and the nature of texts: a hidden Markov model labels lines prose, list, table or junk.

Each line (long ones in pieces of `piece` words) becomes a symbol of binned statistics.  The four-state model emits
the statistics independently given the state and tends to stay in its state.  It starts from hints, beliefs about the
bins flattened to nearly equal chances, which only tell which state is which, and learns its emissions by
expectation-maximization on all lines of all texts; every step has the tasks sum up the expected counts of their texts
and takes them at weight `learn` and the hints for the rest, as smoothing.  Posteriors of all lines of all texts are
then summed, weighted by words, into shares per text.

A text isn't natural prose when less than half of its words are expected in prose lines.  Null and empty texts have
no lines and zero statistics and are never flagged, nor are texts under `min_words` words.  Repeated ids give one row.
`spam_share` is reported for every text and decides nothing; that words of offers and of repeated pairs fill a line is
one of the model's own statistics.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.language import ALL_FUNCTION_WORDS, COMMERCE
from tessella.llm.spam_pages import spam_units
from tessella.runtime import materialize

STATES = ("prose", "list", "table", "junk")
#: Upper ends of the bins of the graded statistics; the other three are categories.
BINS = {
    "function words": (0.001, 0.12, 0.22, 0.32),
    "words": (2.5, 5.5, 10.5),
    "number tokens": (0.001, 0.2, 0.45),
    "symbols": (0.04, 0.10, 0.25),
    "odd words": (0.08, 0.25, 0.5),
    "offers": (0.1, 0.35, 0.6),
}
#: Values of the symbols' fields: function words by line length, number tokens, symbols, odd words, marks, separators, repeats, offers.
SIZES = (20, 4, 4, 4, 4, 3, 3, 4)
SHIFTS = (0, 5, 7, 9, 11, 13, 15, 17)
MASKS = (31, 3, 3, 3, 3, 3, 3, 3)


@dataclass(frozen=True)
class LineStates:
    piece: int = 18
    train_texts: int = 8000  # bounds nothing any more, as all texts are learned from; callers still name it
    rounds: int = 12
    learn: float = 0.8
    hint: float = 0.4
    stay: float = 0.85
    min_words: int = 8


_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile(r"\s*(?:[-*+•·–]\s|#{1,6}\s|\(?\d{1,4}[.):,–-]|\[[ xX]?\]|[|>]|[a-zA-Z][.)]\s)")
_END = re.compile(r"[.!?…][\"”“’'»)\]*_]*$")
_TABLE = re.compile(r"\||\t|\S {2,}\S|\s·\s|\.{4,}|_{4,}|={3,}|-{4,}|\*{4,}|~{4,}|\w=\S|\S / \S|\d–\d")
_VOWEL = re.compile(r"[aeiouyàáâäãåèéêëìíîïòóôöõùúûüýœæ]")
_SYMBOLS = re.compile(r"[^\w\s]|_")
_NUMBERED = re.compile(r"\S*\d\S*")
_SINGLE = re.compile(r"(?<![\w'’])[^\W\d_](?![\w'’])")
_ODD_JOIN = re.compile(r"[^\W\d_][^\w\s'’\-.,/&|]+[^\W\d_]|[^\W\d_]\d+[^\W\d_]|[{}<>\\^~|]{1,}\w")


#: Function words that tell sentences; "of" and its like also join the names of lists.
_TOLD = ALL_FUNCTION_WORDS - {"of", "de", "del", "du", "des", "von"}


class _Kinds(dict):
    """Of a word: 1 function word, with 2 one that tells sentences; 4 of shops and offers; 8 odd; 0 any other."""

    def __missing__(self, w: str) -> int:
        if len(self) > 300_000:
            self.clear()
        if w in ALL_FUNCTION_WORDS:
            k = 3 if w in _TOLD else 1
        elif w in COMMERCE:
            k = 4
        else:
            k = 8 if len(w) > 15 or (len(w) > 3 and not _VOWEL.search(w) and not w.isdigit()) else 0
        self[w] = k
        return k


_kinds = _Kinds()
_DIGIT = re.compile(r"\d")


def pieces(text: str, piece: int) -> Iterator[str]:
    for line in text.splitlines():
        line = line.strip()
        if not line:
            continue
        if len(line) < 4 * piece:
            yield line
            continue
        tokens = line.split(" ")
        if len(tokens) <= piece + piece // 2:
            yield line
            continue
        n = max(1, round(len(tokens) / piece))
        step = -(-len(tokens) // n)
        for s in range(0, len(tokens), step):
            part = " ".join(tokens[s : s + step]).strip()
            if part:
                yield part


def _bin(x: float, ends: tuple[float, ...]) -> int:
    return bisect_right(ends, x)


_JOIN_SIGNS = re.compile(r"[\d{}<>\\^~|]")


def _is_table(line: str) -> bool:
    # a line without any of these holds no table; they are looked for before the pattern, one by one, as that is faster
    signs = (
        "  " in line or "|" in line or "\t" in line or "=" in line or "·" in line or "–" in line or " / " in line
        or "...." in line or "----" in line or "____" in line or "****" in line or "~~~~" in line
    )
    return signs and _TABLE.search(line) is not None


def symbol(line: str, units: frozenset[str] = frozenset(), words: list[str] | None = None) -> tuple[int, int, int, int, int]:
    """The line's packed bins; its words, their letters, its marks, and its function words.

    `units` are the words of repeated pairs of the whole text, `words` the lower-cased words of the line, if known.
    """
    words = _WORD.findall(line.lower()) if words is None else words
    n = len(words)
    tokens = line.split()
    sizes = list(map(len, words))
    letters = sum(sizes)
    marks = max(0, sum(map(len, tokens)) - letters)
    known = 0
    if not n:
        bins = (0, 0, 3, 0, 0, 2 if _is_table(line) else 0, 0, 0)
    else:
        kinds = list(map(_kinds.__getitem__, words))
        telling = kinds.count(3)
        known = telling + kinds.count(1)
        short = sizes.count(1)
        digit = _DIGIT.search(line) is not None
        # without digits and brackets, and with a word a token, nothing joins letters
        joins = len(_ODD_JOIN.findall(line)) if (n != len(tokens) or digit or _JOIN_SIGNS.search(line)) and (marks or digit or not line.isascii()) else 0
        # letters torn apart: many stand alone, and hardly a word is longer than three, or signs stand inside of words
        spelled = short > 0.12 * n + 1 and (short + sizes.count(2) + sizes.count(3) > 0.62 * n or joins > 0.1 * n) and len(_SINGLE.findall(line)) > 0.12 * n + 1
        if spelled:
            fw = sum(k >> 1 & 1 for k, w in zip(kinds, words) if len(w) > 3)
            odd = sum(k == 8 or (len(w) < 3 and not w.isdigit()) for k, w in zip(kinds, words))
        else:
            fw = telling
            odd = kinds.count(8)
        wares = kinds.count(4)
        odd += joins + (wares if wares >= 3 else 0)
        digits = len(_NUMBERED.findall(line)) if digit else 0
        commas = line.count(",") + line.count(";") + line.count("#") + line.count("·")
        distinct = len(set(words))
        offers = sum(w in units or k == 4 for w, k in zip(words, kinds)) if units else wares
        bins = (
            4 * _bin(fw / n, BINS["function words"]) + _bin(n, BINS["words"]),
            _bin(digits / (line.count(" ") + 1), BINS["number tokens"]),
            _bin(marks / len(line), BINS["symbols"]),
            _bin(odd / n, BINS["odd words"]),
            (1 if _MARK.match(line) else 0) + (2 if _END.search(line[-12:]) else 0),
            2 if _is_table(line) else 1 if commas * 3.5 >= n and commas > 1 else 0,
            0 if distinct >= 0.8 * n else 1 if distinct >= 0.55 * n else 2,
            _bin(offers / n, BINS["offers"]) if offers else 0,
        )
    code = 0
    for b, s in zip(bins, SHIFTS):
        code |= b << s
    return code, n, letters, marks, known


def beliefs() -> list[np.ndarray]:
    """P(bin | state) of each statistic before any text is seen; rows are STATES."""
    # function words (none to many) in lines of 1-2, 3-5, 6-10 and more words
    by_length = {
        "prose": ([0.50, 0.02, 0.03, 0.10, 0.35], [0.08, 0.05, 0.12, 0.30, 0.45], [0.004, 0.02, 0.08, 0.25, 0.646], [0.0003, 0.002, 0.02, 0.15, 0.8277]),
        "list": ([0.90, 0.02, 0.02, 0.03, 0.03], [0.85, 0.05, 0.04, 0.04, 0.02], [0.80, 0.12, 0.05, 0.02, 0.01], [0.70, 0.24, 0.04, 0.015, 0.005]),
        "table": ([0.94, 0.02, 0.02, 0.01, 0.01], [0.93, 0.03, 0.02, 0.01, 0.01], [0.92, 0.05, 0.02, 0.005, 0.005], [0.90, 0.08, 0.015, 0.0025, 0.0025]),
        "junk": ([0.90, 0.03, 0.03, 0.02, 0.02], [0.86, 0.06, 0.04, 0.02, 0.02], [0.80, 0.12, 0.05, 0.02, 0.01], [0.65, 0.29, 0.045, 0.01, 0.005]),
    }
    lengths = {"prose": [0.02, 0.06, 0.32, 0.60], "list": [0.30, 0.35, 0.15, 0.20], "table": [0.15, 0.30, 0.30, 0.25], "junk": [0.20, 0.20, 0.25, 0.35]}
    joint = [[by_length[s][w][f] * lengths[s][w] for f in range(5) for w in range(4)] for s in STATES]
    rows = [
        joint,
        [[0.84, 0.13, 0.02, 0.01], [0.60, 0.15, 0.20, 0.05], [0.05, 0.10, 0.35, 0.50], [0.40, 0.25, 0.20, 0.15]],
        [[0.55, 0.35, 0.08, 0.02], [0.40, 0.30, 0.25, 0.05], [0.15, 0.25, 0.40, 0.20], [0.15, 0.20, 0.30, 0.35]],
        [[0.90, 0.08, 0.01, 0.01], [0.85, 0.10, 0.03, 0.02], [0.70, 0.20, 0.07, 0.03], [0.25, 0.25, 0.25, 0.25]],
        [[0.40, 0.05, 0.50, 0.05], [0.40, 0.50, 0.05, 0.05], [0.50, 0.40, 0.05, 0.05], [0.70, 0.10, 0.18, 0.02]],
        [[0.93, 0.05, 0.02], [0.50, 0.35, 0.15], [0.15, 0.25, 0.60], [0.40, 0.15, 0.45]],
        [[0.80, 0.19, 0.01], [0.85, 0.10, 0.05], [0.80, 0.15, 0.05], [0.40, 0.25, 0.35]],
        [[0.93, 0.05, 0.01, 0.01], [0.70, 0.15, 0.10, 0.05], [0.70, 0.15, 0.10, 0.05], [0.40, 0.20, 0.20, 0.20]],
    ]
    return [np.array(r) for r in rows]


def hints(strength: float) -> list[np.ndarray]:
    """The beliefs at a low strength: 0 makes all bins equally likely, 1 leaves them as they are."""
    flat = [t**strength for t in beliefs()]
    return [t / t.sum(axis=1, keepdims=True) for t in flat]


#: Numbers that the expected counts of texts come to, and the lines that go through the recursions together.
COUNTS = 4 * sum(SIZES) + 20
BLOCK = 1 << 19


def _parts(offsets: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Runs of whole texts with some BLOCK lines each: their lines, and where in these each text begins."""
    n = max(1, round(int(offsets[-1]) / BLOCK))
    cuts = np.unique(np.searchsorted(offsets, offsets[-1] * np.arange(n) // n, side="left"))
    for a, b in zip(cuts, [*cuts[1:], len(offsets) - 1]):
        yield slice(offsets[a], offsets[b]), offsets[a : b + 1] - offsets[a]


class LineModel:
    """Emission tables (one per statistic), transitions and start of the four states."""

    def __init__(self, p: LineStates):
        self.p = p
        self.tables = hints(p.hint)
        off = (1 - p.stay) / 3
        self.move = np.full((4, 4), off) + np.eye(4) * (p.stay - off)
        self.start = np.array([0.55, 0.15, 0.15, 0.15])

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """log P(symbol | state), tempered: the statistics of one line aren't independent."""
        total = np.zeros((len(codes), 4))
        for table, shift, mask in zip(self.tables, SHIFTS, MASKS):
            total += np.log(table[:, (codes >> shift) & mask].T) * (1.0 if shift == 0 else 0.6)
        return total

    def posteriors(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """State posteriors of all lines."""
        out = np.zeros((len(codes), 4))
        for here, part in _parts(offsets):
            lines, _, _, post, _ = self._passes(codes[here], part)
            out[here][lines] = post.T
        return out

    def expected(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Expected counts of the texts, which add up over any parts: bins of each statistic, moves and starts."""
        total = np.zeros(COUNTS)
        for here, part in _parts(offsets):
            _, kinds, which, post, moves = self._passes(codes[here], part)
            of_kinds = [np.bincount(which, weights=post[s], minlength=len(kinds)) for s in range(4)]
            bins = [np.bincount((kinds >> shift) & mask, weights=k, minlength=size)[:size] for shift, mask, size in zip(SHIFTS, MASKS, SIZES) for k in of_kinds]
            starts = post[:, : np.count_nonzero(np.diff(part))].sum(axis=1)
            total += np.concatenate([*bins, moves.ravel(), starts])
        return total

    def _passes(self, codes: np.ndarray, offsets: np.ndarray):
        """Forward and backward recursions of all texts together, place by place.

        Lines are taken in the order of their place in the text, longest texts first, so that the texts that go on
        from one place to the next are the first ones there.  Gives that order, the distinct symbols and which of them
        each line has, the posteriors, and the expected moves.
        """
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        first, lengths = offsets[order], lengths[order]
        live = np.searchsorted(-lengths, -np.arange(lengths.max(initial=0)), side="left")
        at = np.concatenate([[0], np.cumsum(live)])
        lines = np.concatenate([np.zeros(0, dtype=np.int64), *(first[:n] + t for t, n in enumerate(live))])
        kinds = np.flatnonzero(np.bincount(codes))
        rank = np.zeros(kinds.max(initial=0) + 1, dtype=np.int32)
        rank[kinds] = np.arange(len(kinds))
        which = rank[codes[lines]]
        logs = self.emissions(kinds).T
        emit = np.maximum(np.exp(logs - logs.max(axis=0, keepdims=True, initial=-1e9)), 1e-12)[:, which]
        alpha, beta, scale = np.empty_like(emit), np.ones_like(emit), np.empty(len(lines))
        for t, n in enumerate(live):
            here = slice(at[t], at[t + 1])
            a = emit[:, here] * (self.move.T @ alpha[:, at[t - 1] : at[t - 1] + n] if t else self.start[:, None])
            scale[here] = a.sum(axis=0)
            np.divide(a, scale[here], out=alpha[:, here])
        emit /= scale
        moves = np.zeros((4, 4))
        for t in range(len(live) - 1, 0, -1):
            before = slice(at[t - 1], at[t - 1] + live[t])
            back = emit[:, at[t] : at[t + 1]] * beta[:, at[t] : at[t + 1]]
            moves += alpha[:, before] @ back.T
            np.matmul(self.move, back, out=beta[:, before])
        alpha *= beta
        alpha /= alpha.sum(axis=0)
        return lines, kinds, which, alpha, self.move * moves

    def fit(self, counted: Callable[[LineModel], np.ndarray]) -> LineModel:
        """`counted` gives the expected counts of all texts under a model."""
        prior, p = hints(self.p.hint), self.p
        move, start = self.move.copy(), self.start.copy()
        ends = np.cumsum([4 * size for size in SIZES])
        for _ in range(p.rounds):
            *bins, rest = np.split(counted(self), ends)
            moves, starts = rest[:16].reshape(4, 4), rest[16:]
            if not starts.sum():
                break
            for f, got in enumerate(x.reshape(4, -1) for x in bins):
                self.tables[f] = (1 - p.learn) * prior[f] + p.learn * got / np.maximum(got.sum(axis=1, keepdims=True), 1e-9)
                self.tables[f] /= self.tables[f].sum(axis=1, keepdims=True)
            self.move = 0.5 * move + 0.5 * moves / np.maximum(moves.sum(axis=1, keepdims=True), 1e-9)
            self.move /= self.move.sum(axis=1, keepdims=True)
            self.start = 0.5 * start + 0.5 * starts / max(starts.sum(), 1e-9)
            self.start /= self.start.sum()
        return self


STAT_FIELDS = ("n_chars", "n_words", "mean_word_length", "symbol_ratio", "punctuated_line_share", "common_word_share", "spam_share")


def _reader(p: LineStates):
    """Rows (tbl, id, text) to statistics, packed line symbols and words per line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes_out, words_out, stats = [], [], [[] for _ in STAT_FIELDS]
            for text in batch.column("text").to_pylist():
                text = (text or "").replace("﻿", "")
                parts = list(pieces(text, p.piece))
                words = [_WORD.findall(x.lower()) for x in parts]
                offered, units = spam_units(text, list(chain.from_iterable(words)))
                got = np.array([symbol(x, units, w) for x, w in zip(parts, words)], dtype=np.int64).reshape(-1, 5)
                codes_out.append(got[:, 0].astype(np.int32).tobytes())
                words_out.append(got[:, 1].astype(np.int32).tobytes())
                _, n, letters, marks, known = got.sum(axis=0).tolist()
                lines = [x for x in text.splitlines() if x and not x.isspace()]
                chars = len(text)
                row = (
                    chars,
                    n,
                    letters / n if n else 0.0,
                    marks / chars if chars else 0.0,
                    sum(_END.search(x, max(0, len(x) - 12)) is not None for x in map(str.rstrip, lines)) / len(lines) if lines else 0.0,
                    known / n if n else 0.0,
                    offered,
                )
                for col, x in zip(stats, row):
                    col.append(x)
            yield pa.record_batch(
                [batch.column("tbl"), batch.column("id"), pa.array(codes_out, pa.binary()), pa.array(words_out, pa.binary()), *(pa.array(c, pa.int64() if i < 2 else pa.float64()) for i, c in enumerate(stats))],
                names=["tbl", "id", "codes", "line_words", *STAT_FIELDS],
            )

    return run


def _unpack(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all cells, and where each cell's begin; no cell is null."""
    if not len(cells):
        return np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
    _, ends, data = cells.buffers()
    wide = np.int64 if pa.types.is_large_binary(cells.type) else np.int32
    offsets = np.frombuffer(ends, dtype=wide)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64) // 4
    numbers = np.frombuffer(data, dtype=np.int32, count=offsets[-1])[offsets[0] :] if offsets[-1] else np.zeros(0, dtype=np.int32)
    return numbers, offsets - offsets[0]


def _counter(model: LineModel):
    """All symbols of a task's texts to one row: the sums of their expected counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, codes, lengths = np.zeros(COUNTS), [], []

        def count() -> np.ndarray:
            offsets = np.cumsum(np.concatenate([np.zeros(1, dtype=np.int64), *lengths]))
            got = model.expected(np.concatenate([np.zeros(0, dtype=np.int32), *codes]), offsets)
            codes.clear(), lengths.clear()
            return got

        for batch in batches:
            numbers, offsets = _unpack(batch.column(0))
            codes.append(numbers)
            lengths.append(np.diff(offsets))
            if sum(map(len, codes)) >= BLOCK:
                total += count()
        yield pa.record_batch([pa.array([(total + count()).tobytes()], pa.binary())], names=["sums"])

    return run


def _labeller(model: LineModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, offsets = _unpack(batch.column("codes"))
            words, _ = _unpack(batch.column("line_words"))
            weighted = model.posteriors(codes, offsets) * words[:, None]
            upto = np.concatenate([np.zeros((1, 4)), np.cumsum(weighted, axis=0)])
            sums = upto[offsets[1:]] - upto[offsets[:-1]]
            total = sums.sum(axis=1, keepdims=True)
            shares = np.divide(sums, total, out=np.zeros_like(sums), where=total > 0)
            keep = [batch.column(c) for c in ("tbl", "id", *STAT_FIELDS)]
            yield pa.record_batch([*keep, *(pa.array(shares[:, s]) for s in range(4))], names=["tbl", "id", *STAT_FIELDS, *(f"{s}_share" for s in STATES)])

    return run


def text_statistics(texts: DataFrame, p: LineStates = LineStates()) -> DataFrame:
    """(tbl, id, statistics, prose/list/table/junk share, is_prose): one row per id.  Needs texts(tbl, id, text)."""
    source = texts.filter(F.col("id").isNotNull()).select("tbl", F.col("id").cast("long").alias("id"), "text")
    numbers = ", ".join(f"{c} {'long' if i < 2 else 'double'}" for i, c in enumerate(STAT_FIELDS))
    read = materialize(source.mapInArrow(_reader(p), f"tbl string, id long, codes binary, line_words binary, {numbers}"), "line-symbols")
    codes = read.select("codes")

    def counted(model: LineModel) -> np.ndarray:
        return sum((np.frombuffer(r.sums) for r in codes.mapInArrow(_counter(model), "sums binary").collect()), np.zeros(COUNTS))

    model = LineModel(p).fit(counted)
    labelled = read.mapInArrow(_labeller(model), f"tbl string, id long, {numbers}, " + ", ".join(f"{s}_share double" for s in STATES))
    cells = [c for c in labelled.columns if c not in ("tbl", "id")]
    once = labelled.groupBy("tbl", "id").agg(F.max(F.struct(*cells)).alias("r")).select("tbl", "id", "r.*")
    return once.withColumn("is_prose", (F.col("n_words") < p.min_words) | (F.col("prose_share") >= 0.5))
