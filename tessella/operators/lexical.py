"""The lexical index: stemmed n-grams with their counts, and retrieval by the overlap of word sets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.stemming import stems, token_array
from tessella.functions.text_rules import runs
from tessella.runtime import broadcast_if_small, materialize


def ngrams(tokens: Column, n: int = 4) -> Column:
    """All runs of n tokens, in order; none for a shorter array."""
    return F.transform(runs(tokens, n), lambda z: F.array(*[z[f"r{k}"] for k in range(n)]))


def words_of(text: Column, stemmed: bool = True) -> Column:
    """The index's tokens of a text: stems, or lower-case tokens, which need no Python."""
    return stems(text) if stemmed else F.transform(token_array(text), lambda w: F.lower(w))


def build_index(docs: DataFrame, n: int = 4, stemmed: bool = True, excerpts_wanted: bool = False) -> DataFrame:
    """(ngram, next_token, frequency, source[, excerpt]) of docs(doc_id, text, source).

    `frequency` counts occurrences; the other columns are those of the first occurrence by (doc_id, position).
    Counting is combined on the map side, so a frequent n-gram costs one row per task.
    """
    d = docs.filter(F.col("text").isNotNull()).withColumn("tokens", words_of(F.col("text"), stemmed))
    # one element more than the n-gram, filled up at the end, holds the token that follows
    padded = F.concat("tokens", F.array(F.lit(None).cast("string")))
    each = d.select("doc_id", "source", F.posexplode(ngrams(padded, n + 1)).alias("pos", "run"))
    each = each.withColumn("ngram", F.slice("run", 1, n))
    first = [F.get("run", F.lit(n)).alias("next_token"), F.col("source")]
    grouped = each.select("ngram", F.struct(F.col("doc_id"), F.col("pos"), *first).alias("at")).groupBy("ngram").agg(F.count("*").alias("frequency"), F.min("at").alias("at"))
    if not excerpts_wanted:
        return grouped.select("ngram", "at.next_token", "frequency", "at.source")
    # texts don't ride along with every n-gram: excerpts are cut once it is known which are wanted of which text
    entry = F.struct(F.col("at.pos").alias("pos"), "ngram", "at.next_token", "frequency", "at.source")
    wanted = grouped.groupBy("at.doc_id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))  # no more than a text has n-grams
    texts = d.groupBy("doc_id").agg(F.min("text").alias("text"))
    cut = wanted.join(texts, "doc_id").withColumn("cuts", excerpts(F.col("text"), n, F.col("entries.pos")))
    return cut.select(F.explode(F.arrays_zip("entries", "cuts")).alias("z")).select("z.entries.ngram", "z.entries.next_token", "z.entries.frequency", "z.entries.source", F.col("z.cuts").alias("excerpt"))


#: Characters of an excerpt beyond its n-gram, both sides together (fixed value).
EXCERPT_WINDOW = 200
_WORD = re.compile(r"\S+")


def text_excerpts(text: str, n: int, count: int) -> list[str | None]:
    """The text around the n white-space words from number 0, 1, .. count - 1, widened to both sides, snapped to spaces.

    Words are counted by white space here and by tokens in the index, as single characters are no tokens; the window
    may therefore drift within a text.  None where there is no such word.
    """
    spans = [m.span() for m in _WORD.finditer(text)]
    out: list[str | None] = []
    for i in range(count):
        if i >= len(spans):
            out.append(None)
            continue
        low = max(0, spans[i][0] - EXCERPT_WINDOW // 2)
        high = min(len(text), spans[min(i + n, len(spans)) - 1][1] + EXCERPT_WINDOW // 2)
        left = text.rfind(" ", 0, low + 1) if low else -1
        right = text.find(" ", high - 1) if high < len(text) else -1
        out.append(text[left + 1 if left >= 0 else low : right if right >= 0 else high].strip())
    return out


def excerpts(text: Column, n: int, places: Column) -> Column:
    """The excerpts at the given numbers of words, in the order of the numbers."""

    @F.pandas_udf("array<string>")
    def around(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        out = []
        for t, at in zip(texts, wanted):
            every = text_excerpts(t or "", n, int(max(at)) + 1) if len(at) else []
            out.append([every[i] for i in at])
        return pd.Series(out)

    return around(text, places)


def lookup(index: DataFrame, ngrams: DataFrame) -> DataFrame:
    """The entries of the given n-grams, by equality of whole n-grams."""
    return index.join(ngrams.select("ngram").distinct(), "ngram", "left_semi")


def postings(index: DataFrame) -> DataFrame:
    """(word, key) for every distinct word of every n-gram.  Needs key, ngram."""
    return index.select("key", F.explode(F.array_distinct("ngram")).alias("word"))


def query_words(queries: DataFrame, n: int = 4, stemmed: bool = True) -> DataFrame:
    """(query_id, words): the distinct tokens of each query's text; every token is in some n-gram, or the query is short."""
    return queries.select("query_id", F.array_distinct(words_of(F.coalesce(F.col("text"), F.lit("")), stemmed)).alias("words")).filter(F.size("words") > 0)


def retrieve(index: DataFrame, queries: DataFrame, top_k: int = 5, stemmed: bool = True) -> DataFrame:
    """(query_id, rank, key, score): the entries of highest Jaccard overlap with each query.

    Needs index(key, ngram, frequency) and queries(query_id, text).  Only entries that share a word are met, over the
    postings; the overlap is counted by an aggregation that combines on the map side.  Equal scores go by higher
    frequency, then by key.
    """
    asked = query_words(queries, stemmed=stemmed)
    sizes = index.select("key", "frequency", F.size(F.array_distinct("ngram")).alias("n_words"))
    words = materialize(asked.select("query_id", F.size("words").alias("n_query"), F.explode("words").alias("word")), "query-words")
    # where the queries' words fit, postings stay in place: no word is a shuffle key, and counts are combined as they arise
    met = postings(index).join(broadcast_if_small(words, words.count(), 64), "word").groupBy("query_id", "key").agg(F.count("*").alias("both"), F.first("n_query").alias("n_query"))
    scored = met.join(sizes, "key").withColumn("score", F.col("both") / (F.col("n_words") + F.col("n_query") - F.col("both")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("frequency"), "key")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).select("query_id", "rank", "key", "score")
