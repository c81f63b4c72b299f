"""Passages and units of texts: chunks for embedding, sentences, and packing them into budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text_rules import SPACE, strip

#: Characters of a packed chunk, and of a paragraph that is kept whole (fixed values).
CHUNK, WHOLE = 400, 600
SENTENCE_END = rf"(?<=[.!?])[{SPACE}]+"
# Fixed value: forum framing in a sentence.
FRAMING = (
    r"(?i)\b(i\s+(think|believe|guess)|in\s+my\s+opinion|as\s+far\s+as\s+i\s+know|correct\s+me\s+if|i'?m\s+not\s+sure|"
    r"edit\s*:|update\s*:|related\s*:|see\s+also|possible\s+duplicate|welcome\s+to|thanks?\s+for|"
    r"[a-z][a-z0-9_.-]{2,20}\s+(mentioned|said|wrote|noted|pointed\s+out|answered)|as\s+\S+\s+(mentioned|noted|said)|"
    r"\b(the|this|your)\s+question\b|you\s+(asked|mean)\b|\bOP\b)"
)


def sentences(c: Column) -> Column:
    """Sentences, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, SENTENCE_END), lambda x: strip(x)), lambda x: x != "")


def pack(units: Column, budget: int) -> Column:
    """Chunks of units joined by spaces, a new one wherever the next unit would exceed the budget."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a: Column, x: Column) -> Column:
        full = (a["open"] != "") & (F.length(a["open"]) + 1 + F.length(x) > budget)
        done = F.when(full, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])
        grown = F.when(full | (a["open"] == ""), x).otherwise(F.concat_ws(" ", a["open"], x))
        return F.struct(done.alias("done"), grown.alias("open"))

    return F.aggregate(units, empty, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))


def chunks(c: Column, budget: int = CHUNK, whole: int = WHOLE) -> Column:
    """Passages of a text: paragraphs up to `whole` characters as they are, longer ones packed by sentence."""
    paragraphs = F.filter(F.transform(F.split(c, rf"\n[{SPACE}]*\n"), lambda x: strip(x)), lambda x: x != "")
    return F.flatten(F.transform(paragraphs, lambda x: F.when(F.length(x) <= whole, F.array(x)).otherwise(pack(sentences(x), budget))))


def chunk_documents(docs: DataFrame, budget: int = CHUNK) -> DataFrame:
    """(doc_id, source, chunk_no, passage) of docs(doc_id, source, text)."""
    return docs.filter("text is not null").select("doc_id", "source", F.posexplode(chunks(F.col("text"), budget)).alias("chunk_no", "passage"))


def units(c: Column) -> Column:
    """Lines, and the sentences within them."""
    lines = F.filter(F.transform(F.split(strip(c), "\n"), lambda x: strip(x)), lambda x: x != "")
    return F.flatten(F.transform(lines, lambda x: sentences(x)))


def is_framing(unit: Column) -> Column:
    """Hedges, quotes of other users, talk about the question, and questions back at the reader."""
    return unit.rlike(FRAMING) | F.regexp_replace(unit, f"[{SPACE}]+$", "").endswith("?")


def lead(units_: Column, budget: int) -> Column:
    """The units from the start that fit the budget, joined by spaces; the first is always taken, the first miss ends it."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(a: Column, x: Column) -> Column:
        fits = a["open"] & ((a["n"] == 0) | (F.length(a["text"]) + 1 + F.length(x) <= budget))
        text = F.when(~fits, a["text"]).when(a["n"] == 0, x).otherwise(F.concat_ws(" ", a["text"], x))
        return F.struct(text.alias("text"), (a["n"] + F.when(fits, 1).otherwise(0)).alias("n"), fits.alias("open"))

    return F.aggregate(units_, start, step, lambda a: a["text"])
