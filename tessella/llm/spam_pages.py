"""Pages of stuffed keywords, link collections and product tags: robust outliers in spam-directed directions.

Seven features per page: shares of words in bare link entries, in hashtags, of shops and offers (labels and prices
included), in pairs of plain words that come again and again, of numbers, of function words; and word entropy.  Per
language, a robust centre and scatter are found by concentration steps: start from medians and median deviations,
then repeatedly take mean and covariance of the three quarters of the pages that lie nearest.  All pages take part;
only quantiles, means and sums of products, a row per language, come to the driver.  Languages with less than
`own_share` of the pages, and pages whose language isn't told, take the pooled shape.

A page is flagged when it is an outlier in a spam-directed direction: of the DIRECTIONS, the one that the whitened
displacement is closest to must be met with a cosine of `cosine` or more, and the displacement must reach `distance`
robust deviations along it.  No share decides by itself: half a page of repeated words is a table of values where
numbers come with them, and a page of offers full of function words is spam with a third of its words in offers.

Null and empty texts and pages under `min_words` words are never flagged.  Repeated ids give one row, that of the
greatest reach.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.language import ALL_FUNCTION_WORDS, COMMERCE, FUNCTION_WORDS, detect
from tessella.runtime import materialize

FEATURES = ("links", "tags", "wares", "repeated", "numbers", "function_words", "entropy")
#: Directions towards spam, in units of LEAST_SPREAD.
DIRECTIONS = {
    "links": (1.0, 0.0, 0.0, 0.0, 0.0, -0.3, 0.0),
    "tags": (0.0, 1.0, 0.0, 0.0, 0.0, -0.3, 0.0),
    "keywords": (0.0, 0.0, 1.0, 1.0, 0.0, -0.3, -0.5),
    "phrases": (0.0, 0.0, 0.0, 1.0, -0.6, -0.5, -0.3),
    "wares": (0.0, 0.0, 1.0, 0.3, 0.0, -0.3, -0.3),
    "labels": (0.6, 0.8, 1.0, 0.5, 0.5, -0.3, 0.0),
}
#: Least spreads, so that a feature that is the same on nearly all pages can't blow up distances.
LEAST_SPREAD = np.array([0.05, 0.05, 0.05, 0.06, 0.08, 0.06, 0.04])


@dataclass(frozen=True)
class SpamPages:
    min_words: int = 8
    distance: float = 7.0
    cosine: float = 0.65
    steps: int = 3
    core: float = 0.75
    own_share: float = 0.01


_WORD = re.compile(r"[^\W_]+")
_URL = re.compile(r"https?://\S+|\bwww\.\S+")
_LINK = re.compile(r"<a\s[^<>]*href[^<>]*>[^<>]{0,200}</a>|\[url=[^\[\]]*\][^\[\]]{0,200}\[/url\]|\[([^\[\]\n]{0,200})\]\(\s*(?:https?:|www\.)[^)\s]*\)?|https?://[^\s)\]]+|\bwww\.[^\s)\]]+")
_HASHTAG = re.compile(r"(?<![\w#&])#[^\W\d_][\w-]*")
_PRICE = re.compile(r"[$€£]\s?\d+(?:[.,]\d\d)?|\b\d+(?:[.,]\d\d)\s?(?:€|£|EUR|USD)")
_LABEL = re.compile(r"\b(?:SKU|add to (?:cart|basket)|in stock|out of stock|on sale|sale|buy now|in den warenkorb|ajouter au panier|añadir al carrito|en stock|auf lager)\b", re.I)
#: Every label holds one of these.
_LABEL_PARTS = ("sku", "cart", "basket", "stock", "sale", "buy now", "warenkorb", "panier", "carrito", "lager")
#: Signs of links, hashtags and prices.
_PLACED = ("#", "http", "www.", "<a", "[url=", "$", "€", "£", "EUR", "USD")
_STOP = re.compile(r"[.!?…]")


def _link_spans(text: str) -> list[tuple[int, int]]:
    """Spans of link entries that have no sentence of their own.

    An entry runs from a link to the next one or, where links stand on lines, to the end of its line.
    """
    links = list(_LINK.finditer(text))
    spans = []
    for k, m in enumerate(links):
        end = links[k + 1].start() if k + 1 < len(links) else len(text)
        cut = text.find("\n", m.end(), end)
        if cut >= 0:
            end = cut
        rest = _WORD.findall(text[m.end() : end].lower())
        told = sum(w in ALL_FUNCTION_WORDS for w in rest)
        start = text.rfind("\n", 0, m.start()) + 1 if k == 0 or text.find("\n", links[k - 1].end(), m.start()) >= 0 else m.start()
        lead = _WORD.findall(text[start : m.start()].lower())
        if len(lead) > 3:
            start = m.start()
            if sum(w in ALL_FUNCTION_WORDS for w in lead) >= 2:  # a link inside running text
                continue
        if len(rest) < 5 or told < 2 and len(rest) < 12 and not _STOP.search(text[m.end() : end]):
            spans.append((start, end if len(rest) < 5 else m.end()))
    return spans


def _units(text: str, found: list[re.Match], words: list[str], counts: Counter) -> tuple[np.ndarray, ...]:
    """Which words stand in bare link entries, in hashtags, are of offers, and stand in pairs that come again and again."""
    n = len(words)
    starts = np.array([m.start() for m in found])

    def marked(spans: list[tuple[int, int]]) -> np.ndarray:
        flag = np.zeros(n, dtype=bool)
        for x, y in spans:
            flag[np.searchsorted(starts, x) : np.searchsorted(starts, y)] = True
        return flag

    links = marked(_link_spans(text) if any(x in text for x in ("http", "www.", "<a", "[url=")) else [])
    tags = marked([m.span() for m in _HASHTAG.finditer(text)] if "#" in text else [])
    labels = _labels(text, text.lower())
    if any(x in text for x in ("$", "€", "£", "EUR", "USD")):
        labels += [m.span() for m in _PRICE.finditer(text)]
    wares = marked(labels)
    if not COMMERCE.isdisjoint(counts):
        wares |= np.array([w in COMMERCE for w in words])
    # neighbouring plain words, a space apart
    least = max(3, n // 60)
    often = {w for w, c in counts.items() if c >= least and len(w) > 1 and w.isalpha() and w not in ALL_FUNCTION_WORDS}
    repeated = np.zeros(n, dtype=bool)
    at = [i for i in range(n - 1) if words[i] in often and words[i + 1] in often and found[i + 1].start() - found[i].end() == 1 and text[found[i].end()] == " "] if often else []
    again = Counter([(words[i], words[i + 1]) for i in at])
    for i in at:
        if again[words[i], words[i + 1]] >= least:
            repeated[i] = repeated[i + 1] = True
    return links, tags, wares, repeated


def may_hold_units(text: str) -> bool:
    """False only where no word can stand in a unit that hangs on its place: no link, hashtag, label, price or pair of words often enough."""
    if any(x in text for x in _PLACED) or _LABEL.search(text):
        return True
    words = _WORD.findall(text.lower())
    if not COMMERCE.isdisjoint(words):
        return True
    least = max(3, len(words) // 60)
    often = {w for w, c in Counter(words).items() if c >= least and w not in ALL_FUNCTION_WORDS}
    return any(x in often and y in often for x, y in zip(words, words[1:])) if often else False


def _labels(text: str, lowered: str) -> list[tuple[int, int]]:
    return [m.span() for m in _LABEL.finditer(text)] if any(x in lowered for x in _LABEL_PARTS) else []


def spam_units(text: str, words: list[str] | None = None) -> tuple[float, frozenset[str]]:
    """Share of the words that stand in any unit of spam, and the words of pairs that come again and again.

    Where no unit can hang on its place, the words of offers are counted without looking for places.  `words` are the
    lower-cased words, if known.
    """
    lowered = text.lower()
    words = _WORD.findall(lowered) if words is None else words
    if not words:
        return 0.0, frozenset()
    counts = Counter(words)
    least = max(3, len(words) // 60)
    often = {w for w, c in counts.items() if c >= least} - ALL_FUNCTION_WORDS
    again = Counter([x for x in zip(words, words[1:]) if x[0] in often and x[1] in often]) if often else {}
    pairs = frozenset(w for x, c in again.items() if c >= least for w in x if len(w) > 1 and w.isalpha())
    if not pairs and not any(x in text for x in _PLACED) and not _labels(text, lowered):
        return sum(counts[w] for w in COMMERCE & counts.keys()) / len(words), pairs
    found = list(_WORD.finditer(text))
    words = [m.group().lower() for m in found]
    return float(np.logical_or.reduce(_units(text, found, words, Counter(words))).mean()), pairs


def spam_share(text: str) -> float:
    """Share of the words that stand in any unit of spam; a plain statistic that decides nothing."""
    return spam_units(text)[0]


def page_features(text: str | None) -> tuple[int, str | None, tuple[float, ...]]:
    """Number of words, language told by the words, and FEATURES."""
    text = (text or "").replace("\ufeff", "")
    found = list(_WORD.finditer(text))
    n = len(found)
    if not n:
        return 0, None, (0.0,) * len(FEATURES)
    words = [m.group().lower() for m in found]
    counts = Counter(words)
    shares = [float(u.mean()) for u in _units(text, found, words, counts)]
    numbers = sum(c for w, c in counts.items() if not w.isalpha() and any(x.isdigit() for x in w)) / n
    told = sum(c for w, c in counts.items() if w in ALL_FUNCTION_WORDS) / n
    entropy = -sum(c / n * math.log(c / n) for c in counts.values()) / math.log(n) if n > 1 else 1.0
    return n, detect(words, least=2.0), (*shares, numbers, told, entropy)


COLS = ", ".join(f"{f} double" for f in FEATURES)


def _measurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [page_features(t) for t in batch.column("text").to_pylist()]
        tags = batch.column("lang").to_pylist()
        lang = [told or (tag if tag in FUNCTION_WORDS else None) or "other" for (_, told, _), tag in zip(rows, tags)]
        cols = [pa.array([r[2][k] for r in rows], pa.float64()) for k in range(len(FEATURES))]
        yield pa.record_batch([batch.column("id"), pa.array([r[0] for r in rows], pa.int32()), pa.array(lang, pa.string()), *cols], names=["id", "n_words", "lang", *FEATURES])


def chi_square(k: int, z: float) -> float:
    """Quantile of the chi-square distribution at the normal deviate z (Wilson and Hilferty)."""
    return k * (1 - 2 / (9 * k) + z * math.sqrt(2 / (9 * k))) ** 3


@dataclass
class Shape:
    centre: np.ndarray
    scatter: np.ndarray

    def prepared(self) -> tuple[np.ndarray, np.ndarray]:
        """Centre and whitening matrix."""
        values, vectors = np.linalg.eigh(self.scatter)
        return self.centre, (vectors / np.sqrt(np.maximum(values, 1e-8))) @ vectors.T


def _sum(terms: list) -> Column:
    return reduce(lambda x, y: x + y, terms)


def _placed(pages: DataFrame, shapes: dict[str, Shape], aimed: bool = True) -> DataFrame:
    """`pages` with the squared distance `d2` and, if `aimed`, by direction the deviations `r_...` along it; rows of no shape are left out.

    The shapes are sent along: a row per language of FUNCTION_WORDS, and one for the pooled shape.
    """
    k = len(FEATURES)
    rows = []
    for key, shape in shapes.items():
        centre, white = shape.prepared()
        aims = [white @ (np.array(t) * LEAST_SPREAD) for t in DIRECTIONS.values()]
        along = [white @ (u / np.linalg.norm(u)) for u in aims]
        rows.append((key, centre.tolist(), (white @ white).ravel().tolist(), [a.tolist() for a in along]))
    table = pages.sparkSession.createDataFrame(rows, "lang string, c array<double>, q array<double>, u array<array<double>>")
    directions = list(enumerate(DIRECTIONS)) if aimed else []
    table = table.select("lang", *[F.col("c")[i].alias(f"c{i}") for i in range(k)], *[F.col("q")[i * k + j].alias(f"q{i}_{j}") for i in range(k) for j in range(i, k)], *[F.col("u")[d][i].alias(f"u{d}_{i}") for d, _ in directions for i in range(k)])
    off = pages.join(F.broadcast(table), "lang").withColumns({f"x{i}": F.col(f) - F.col(f"c{i}") for i, f in enumerate(FEATURES)})
    d2 = _sum([F.col(f"x{i}") * F.col(f"x{j}") * F.col(f"q{i}_{j}") * (1 if i == j else 2) for i in range(k) for j in range(i, k)])
    reach = {f"r_{t}": _sum([F.col(f"x{i}") * F.col(f"u{d}_{i}") for i in range(k)]) for d, t in directions}
    return off.withColumns({"d2": d2} | reach).select(*pages.columns, "d2", *reach)


POOLED = "pooled"


def robust_shapes(pages: DataFrame, p: SpamPages) -> dict[str, Shape]:
    """Centre and scatter of each value of `lang`, and the pooled ones.  Any language but POOLED must have pages enough."""
    k = len(FEATURES)
    rows = pages.groupBy("lang").agg(*[F.percentile_approx(f, 0.5, 2000).alias(f) for f in FEATURES]).collect()  # a row per language
    shapes = {r.lang: Shape(np.array([r[f] for f in FEATURES]), np.diag(LEAST_SPREAD**2)) for r in rows}
    if not shapes:
        return {}
    at = F.create_map(*[x for lang, m in shapes.items() for x in (F.lit(lang), F.array(*[F.lit(float(v)) for v in m.centre]))])
    off = [F.percentile_approx(F.abs(F.col(f) - at[F.col("lang")][i]), 0.5, 2000).alias(f) for i, f in enumerate(FEATURES)]
    for r in pages.groupBy("lang").agg(*off).collect():
        shapes[r.lang].scatter = np.diag(np.maximum(1.4826 * np.array([r[f] for f in FEATURES]), LEAST_SPREAD) ** 2)
    products = [(i, j) for i in range(k) for j in range(i, k)]
    own = [x for x in shapes if x != POOLED]
    for _ in range(p.steps):
        near = _placed(pages, shapes, aimed=False)
        edge = {r.lang: r.q for r in near.groupBy("lang").agg(F.percentile_approx("d2", p.core, 2000).alias("q")).collect()}
        limit = F.create_map(*[x for lang, q in edge.items() for x in (F.lit(lang), F.lit(float(q)))])
        sums = (
            near.filter(F.col("d2") <= limit[F.col("lang")])
            .groupBy("lang")
            .agg(F.count("*").alias("n"), *[F.sum(f).alias(f) for f in FEATURES], *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s{i}_{j}") for i, j in products])
            .collect()
        )
        numbers = {}
        for r in sums:
            mean = np.array([r[f] for f in FEATURES]) / r.n
            cross = np.zeros((k, k))
            for i, j in products:
                cross[i, j] = cross[j, i] = r[f"s{i}_{j}"]
            # trimming to the core narrows the scatter; the factor restores it for a normal core
            scatter = (cross / r.n - np.outer(mean, mean)) * chi_square(k, 0.6745) / chi_square(k, 0.0) + np.diag(LEAST_SPREAD**2) * 0.5
            shapes[r.lang], numbers[r.lang] = Shape(mean, scatter), r.n
        if own:  # else no language has pages enough, and the pooled shape is that of all pages
            weights = np.array([numbers[x] for x in own]) / sum(numbers[x] for x in own)
            shapes[POOLED] = Shape(sum(w * shapes[x].centre for w, x in zip(weights, own)), sum(w * shapes[x].scatter for w, x in zip(weights, own)))
    return shapes


def score_pages(docs: DataFrame, p: SpamPages = SpamPages()) -> DataFrame:
    """(id, n_words, lang, FEATURES, d2, direction, reach, cosine, is_spam): one row per id.  Needs docs(id, text, lang)."""
    source = docs.filter(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), "text", F.lower(F.trim("lang")).alias("lang"))
    pages = materialize(source.mapInArrow(_measurer, f"id long, n_words int, lang string, {COLS}"), "page-features")
    full = pages.filter(F.col("n_words") >= p.min_words)
    counted = {r["lang"]: r["count"] for r in full.groupBy("lang").count().collect()}  # a row per language of FUNCTION_WORDS and "other"
    own = [x for x, c in counted.items() if x != "other" and c >= p.own_share * sum(counted.values())]
    shaped = full.withColumn("told", F.col("lang")).withColumn("lang", F.when(F.col("lang").isin(own), F.col("lang")).otherwise(F.lit(POOLED)))
    placed = _placed(shaped, robust_shapes(shaped, p))
    best = F.greatest(*[F.struct(F.col(f"r_{t}").alias("reach"), F.lit(t).alias("direction")) for t in DIRECTIONS])
    cells = ["reach", "n_words", F.col("told").alias("lang"), *FEATURES, "d2", "direction"]
    once = placed.withColumn("best", best).select("*", "best.*").groupBy("id").agg(F.max(F.struct(*cells)).alias("r")).select("id", "r.*")
    cosine = F.col("reach") / F.sqrt(F.greatest(F.col("d2"), F.lit(1e-18)))
    scored = once.withColumn("cosine", cosine).select("id", "n_words", "lang", *FEATURES, "d2", "direction", "reach", "cosine")
    return scored.withColumn("is_spam", (F.col("reach") >= p.distance) & (F.col("cosine") >= p.cosine))
