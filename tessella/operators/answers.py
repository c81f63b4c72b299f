"""Questions and answers: parsing of dumps, ranking of answers, and synthesis of fine-tuning examples."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.passages import is_framing, lead, units

# The headings of a question dump.
QUESTION = re.compile(r"^#\s+(?P<title>.+?)\s*$")
ANSWER = re.compile(r"^##\s+Answer\s*(?P<accepted>\(accepted\))?\s*\(score:\s*(?P<score>-?\d+)\)\s*$")
QUESTION_SCORE = re.compile(r"^Score:\s*-?\d+\s*$")
RULE = "---"
CONTEXT_CHARS, ANSWER_CHARS, LEAST_CONTEXT, LEAST_ANSWER = 600, 350, 20, 10


def dump_answers(text: str) -> Iterator[tuple[str, str, int, bool]]:
    """(question, answer, score, accepted) of one dump, in order; blank answers are left out."""
    title, head, body = None, None, []
    for line in [*text.splitlines(), RULE]:
        answer = ANSWER.match(line)
        heading = None if answer or line.startswith("##") else QUESTION.match(line)
        if answer or heading or line.strip() == RULE:
            whole = "\n".join(body).strip()
            if head and title and title.strip() and whole:
                yield title.strip(), whole, int(head["score"]), head["accepted"] is not None
            head, body = answer, []
            if heading:
                title = heading["title"]
        elif head:
            body.append(line)


def parse_dumps(docs: DataFrame) -> DataFrame:
    """(doc_id, answer_no, question, answer, answer_score, accepted) of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, *pair) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) if t for k, pair in enumerate(dump_answers(t))]
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.bool_())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "answer_no", "question", "answer", "answer_score", "accepted"])

    marked = docs.select("doc_id", "text").filter(F.col("text").rlike(r"##\s+Answer"))
    return marked.mapInArrow(run, "doc_id long, answer_no int, question string, answer string, answer_score long, accepted boolean")


def filter_answers(pairs: DataFrame, min_score: int = 1, accepted_only: bool = False) -> DataFrame:
    """Answers of at least `min_score` (null counts as 0), or only the accepted ones whatever their score."""
    return pairs.filter(F.coalesce("accepted", F.lit(False)) if accepted_only else F.coalesce("answer_score", F.lit(0)) >= min_score)


def rank_answers(pairs: DataFrame, limit: int, key: str = "question_id", tie: str = "pair_id") -> DataFrame:
    """The first `limit` answers of each question, accepted first, then by score; negative ones drop out after the cut."""
    order = Window.partitionBy(key).orderBy(F.desc(F.coalesce("accepted", F.lit(False))), F.desc_nulls_last("answer_score"), tie)
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).filter(F.coalesce("answer_score", F.lit(0)) >= 0)


def context_choice(pairs: DataFrame, key: str = "question_id", order: str = "pair_id") -> DataFrame:
    """`pairs` with `context_id` and `context_answer`: the best other answer to the same question, null if there is none.

    The first accepted one wins, else the best scored, else the first.  The best and the second best of a question
    suffice to know the best other one of each of its answers, so a question with very many answers isn't joined with
    itself.
    """
    # A first accepted answer wins by order alone; scored ones by score, then order; the rest by order.
    value = F.struct(
        F.when(F.coalesce("accepted", F.lit(False)), 2).when(F.col("answer_score").isNotNull(), 1).otherwise(0).alias("kind"),
        F.when(F.coalesce("accepted", F.lit(False)), 0).otherwise(F.coalesce("answer_score", F.lit(0))).alias("score"),
        (-F.col(order)).alias("order"),
    )
    ranked = pairs.select(key, F.col(order).alias("context_id"), F.col("answer").alias("context_answer"), F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value))).alias("place")).filter("place <= 2")
    best = ranked.filter("place = 1").select(key, F.col("context_id").alias("id1"), F.col("context_answer").alias("text1"))
    second = ranked.filter("place = 2").select(key, F.col("context_id").alias("id2"), F.col("context_answer").alias("text2"))
    joined = pairs.join(best, key, "left").join(second, key, "left")
    own = F.col(order) == F.col("id1")
    return joined.select(*pairs.columns, F.when(own, F.col("id2")).otherwise(F.col("id1")).alias("context_id"), F.when(own, F.col("text2")).otherwise(F.col("text1")).alias("context_answer"))


def finetune_examples(pairs: DataFrame, key: str = "question_id", order: str = "pair_id") -> DataFrame:
    """(order, user_text, assistant, context): the plain start of another answer as context, the factual start of this one.

    A question with one answer gives both from it.  Too short examples are left out.
    """
    chosen = context_choice(pairs.filter("question is not null and answer is not null"), key, order)
    context = lead(units(F.coalesce("context_answer", "answer")), CONTEXT_CHARS)
    answer = lead(F.filter(units(F.col("answer")), lambda u: ~is_framing(u)), ANSWER_CHARS)
    made = chosen.select(order, F.col("question").alias("user_text"), answer.alias("assistant"), context.alias("context"))
    return made.filter((F.length("context") >= LEAST_CONTEXT) & (F.length("assistant") >= LEAST_ANSWER))


def format_dump(pairs: DataFrame, limit: int, key: str = "question_id", tie: str = "pair_id") -> DataFrame:
    """(key, block): one question with its ranked answers in the layout of a dump.

    Of a question at most `limit` answers are gathered, whatever it has.
    """
    ranked = rank_answers(pairs, limit, key, tie)
    label = F.when(F.coalesce("accepted", F.lit(False)), "Answer (accepted)").otherwise("Answer")
    part = F.concat(F.lit("\n## "), label, F.lit("  (score: "), F.coalesce("answer_score", F.lit(0)).cast("string"), F.lit(")\n\n"), F.coalesce("answer", F.lit("")))
    heads = pairs.groupBy(key).agg(F.min("question").alias("title"))
    bodies = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("parts"))
    block = F.concat(F.lit("# "), F.trim("title"), F.lit("\n"), F.coalesce(F.array_join(F.col("parts.part"), "\n"), F.lit("")), F.lit("\n\n---"))
    return heads.join(bodies, key, "left").select(key, block.alias("block"))


def template_examples(records: DataFrame, templates: list[tuple[Column, Column, Column]]) -> DataFrame:
    """(user_text, assistant): every template (condition, question, answer) that a record fulfils."""
    made = F.array_compact(F.array(*[F.when(when, F.struct(q.alias("user_text"), a.alias("assistant"))) for when, q, a in templates]))
    return records.select(F.explode(made).alias("e")).select("e.*")


def entity_pairs(left: DataFrame, right: DataFrame, on: list[Column] | Column, passage: Column) -> DataFrame:
    """(passage): a text for every related pair of records; an equality in `on` keeps it from comparing all with all."""
    return left.join(right, on).select(passage.alias("passage")).filter("passage is not null")
