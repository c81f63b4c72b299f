"""Queries of training-data layout, questions and answers, prompts, evaluation, guards, arithmetic and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.arithmetic import answer_arithmetic, replace_tool_tags
from tessella.functions.cleaning import weight_by_glob
from tessella.functions.text_rules import tokens
from tessella.operators import answers, bpe, evaluation, guards, prompts, synthesis, training
from tessella.operators.vectors import unit
from tessella.plans import corpus
from tessella.queries import corpora, texts
from tessella.queries.base import WS, r6, sql_lines, sql_strip, sql_tokens, table
from tessella.queries.texts import WEIGHTS
from tessella.runtime import scratch
from tessella.streaming import conversations

SEQ, STRIDE = 256, 128


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    n = (F.size(tokens(F.coalesce("text", F.lit("")))) + 1).cast("long")
    return d.select("doc_id", "source", n.alias("n_tokens"), weight_by_glob(F.coalesce("source", F.lit("")), WEIGHTS).alias("weight"))


def _laid_out(spark: SparkSession, folder: str) -> DataFrame:
    return training.with_offsets(_sized(spark, folder), "n_tokens", "doc_id")


def doc_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return _laid_out(spark, folder).select("doc_id", "start_off", "end_off")


def window_offsets(spark: SparkSession, folder: str) -> DataFrame:
    d = _laid_out(spark, folder)
    regions = d.groupBy("weight").agg(F.min("start_off").alias("start"), F.max("end_off").alias("end")).select(F.col("weight").alias("region_id"), "start", "end")
    return training.windows(regions, SEQ, STRIDE).groupBy("region_id").agg(F.count("*").alias("n_windows"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))


def window_weights(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.weighted_windows(_laid_out(spark, folder), SEQ, STRIDE).select(F.col("offset").alias("window_off"), "doc_id", "weight")


def block_split(spark: SparkSession, folder: str) -> DataFrame:
    n = _sized(spark, folder).agg(F.sum("n_tokens")).first()[0] or 0
    return spark.createDataFrame(training.block_split(n, 0.1, SEQ), "block_start long, block_end long, is_val boolean")


def tier_split(spark: SparkSession, folder: str) -> DataFrame:
    return training.tier_split(_sized(spark, folder), 0.05, SEQ).select("doc_id", "weight", "is_val")


def exact_sample(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "finetune_examples").select("example_id").distinct()
    return training.exact_sample(ids, 200, "example_id", seed=3)


def example_split(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "finetune_examples").select("example_id").distinct()
    return training.example_split(ids, 0.1, "example_id", seed=3)


def weighted_draws(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("double").alias("w"))
    return training.weighted_draws(part, "p_partkey", "w", 1000, seed=5)


def padded_batches(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("int"))).alias("ids"))
    out = training.padded_batches(lines.select("l_orderkey", (F.col("l_orderkey") % 500).alias("batch"), "ids", F.col("ids").alias("labels")), "batch")
    return out.select("l_orderkey", *[F.array_join(c, " ").alias(c) for c in ("ids", "labels", "mask")])


def right_padded(spark: SparkSession, folder: str) -> DataFrame:
    ids = F.transform(tokens(F.coalesce("excerpt", F.lit(""))), lambda w: F.length(w) + 5)
    return table(spark, folder, "ngram_index").select("entry_id", F.array_join(training.pad_right(ids, 40), " ").alias("ids")).distinct()


def shifted_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Targets of all windows of all excerpts, sixteen positions to a window; the last one is filled up."""
    d = table(spark, folder, "ngram_index").select("entry_id", F.transform(tokens(F.coalesce("excerpt", F.lit(""))), lambda w: F.length(w)).alias("ids")).distinct()
    starts = F.sequence(F.lit(0), F.floor((F.size("ids") - 2) / 16).cast("int"))
    w = d.filter("size(ids) >= 2").select("entry_id", "ids", F.explode(starts).alias("win_no")).select("entry_id", "win_no", F.slice("ids", F.col("win_no") * 16 + 1, 17).alias("ids"))
    return w.select("entry_id", "win_no", F.array_join(training.shifted_targets(F.col("ids"), 16, 1), " ").alias("next"), F.array_join(training.shifted_targets(F.col("ids"), 16, 3), " ").alias("third"))


def chat_examples(spark: SparkSession, folder: str) -> DataFrame:
    ids = lambda c: F.transform(tokens(F.coalesce(c, F.lit(""))), lambda w: F.length(w) + 5)
    d = table(spark, folder, "finetune_examples").select("example_id", ids(F.coalesce("user_text", "prompt")).alias("u"), ids(F.when(F.col("user_text").isNull(), F.col("response")).otherwise(F.col("assistant"))).alias("a"), ids(F.col("context")).alias("c")).distinct()
    made = d.select("example_id", training.chat_example(F.col("u"), F.col("a"), F.col("c"), 96).alias("e")).filter("e is not null")
    return made.select("example_id", F.array_join("e.ids", " ").alias("ids"), F.array_join("e.labels", " ").alias("labels"))


def difficulty_weights(spark: SparkSession, folder: str) -> DataFrame:
    loss = F.col("l_extendedprice") / 20000 - 0.5
    d = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", loss.alias("loss"))
    return training.difficulty_weights(d, 1.5, 0.1).select("l_orderkey", "l_linenumber", F.round("weight", 4).alias("weight"))


def schedules(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "orders").select("o_orderkey").withColumn("n", F.col("o_orderkey").cast("long"))
    rate = training.learning_rate((F.col("n") % 10000).cast("double"), 3e-4, 3e-5, 500, 10000)
    return d.select("o_orderkey", F.round(rate * 1e6, 4).alias("rate"), training.model_preset(F.col("n") * 100_000).alias("preset"), training.optimal_steps(F.col("n") * 1000, 8, 4).alias("steps"), training.tuning_steps(F.col("n") % 1000, 8, 2).alias("tuning_steps"), training.tuning_epochs(F.col("n") % 1000, adapter=True).alias("adapter_epochs"))


def grouped_batches(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "qa_pairs").select(F.col("question_id").alias("doc_id"), F.col("pair_id").alias("passage_id")).distinct()
    return training.grouped_batches(p, 2, 4, 25, seed=1)


def weight_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.weight_histogram(_sized(spark, folder), "weight").select("weight", "n", r6("percent").alias("percent"))


def length_summary(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.length_summary(_sized(spark, folder), "n_tokens", 512).select("n", "shortest", "longest", r6("mean").alias("mean"), "truncated")


def tier_losses(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "lineitem").select("l_returnflag", (F.col("l_tax") + F.col("l_discount")).alias("loss"), "l_quantity")
    return evaluation.tier_losses(d, "l_returnflag", "loss", "l_quantity").select("l_returnflag", "n", r6("mean_loss").alias("mean_loss"), r6("overall_loss").alias("overall_loss"))


def loss_summary(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "lineitem").select((F.col("l_quantity") * F.col("l_tax")).alias("loss_sum"), F.lit(1).alias("n_tokens"))
    return evaluation.loss_summary(d)


def smoothed_losses(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    return evaluation.smoothed(d, "l_orderkey", "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber", r6("smooth").alias("smooth"))


def keyword_recall(spark: SparkSession, folder: str) -> DataFrame:
    recall = evaluation.keyword_recall(F.col("assistant"), F.col("keywords"))
    return table(spark, folder, "eval_items").select("item_id", r6(recall).alias("recall"), (recall >= 0.5).alias("passed"))


def hit_rate(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), "keywords")
    found = table(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), F.coalesce("assistant", "user_text").alias("passage"))
    return evaluation.hit_rate(found, items)


def window_f1(spark: SparkSession, folder: str) -> DataFrame:
    qa = table(spark, folder, "qa_pairs").filter("answer is not null").groupBy("pair_id").agg(F.min("question").alias("q"), F.min("answer").alias("a"), F.min("question_id").alias("question_id"))
    best = qa.groupBy("question_id").agg(F.min_by("a", "pair_id").alias("reference"))
    return qa.join(best, "question_id").select("pair_id", r6(evaluation.best_window_f1("a", "reference", "q")).alias("f1"))


def qa_parsed(spark: SparkSession, folder: str) -> DataFrame:
    return answers.parse_dumps(table(spark, folder, "documents"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "qa_pairs").filter("pair_id is not null")
    return q.groupBy("pair_id").agg(*[F.max_by(c, F.struct("ingested_at", "answer_score")).alias(c) for c in ("question_id", "question", "answer", "answer_score", "accepted")])


def qa_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return answers.filter_answers(_pairs(spark, folder), 2).select("pair_id").withColumn("kind", F.lit("score")).unionByName(answers.filter_answers(_pairs(spark, folder), accepted_only=True).select("pair_id").withColumn("kind", F.lit("accepted")))


def qa_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return answers.rank_answers(_pairs(spark, folder), 3).select("question_id", "pair_id", "rank")


def qa_context(spark: SparkSession, folder: str) -> DataFrame:
    return answers.context_choice(_pairs(spark, folder)).select("pair_id", "context_id")


def qa_finetune(spark: SparkSession, folder: str) -> DataFrame:
    return answers.finetune_examples(_pairs(spark, folder)).select("pair_id", "user_text", "assistant", "context")


def qa_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return answers.format_dump(_pairs(spark, folder), 2)


def template_examples(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    made = answers.template_examples(p, [
        (F.col("p_size") > 25, F.concat(F.lit("How big is "), "p_name", F.lit("?")), F.concat("p_name", F.lit(" has size "), F.col("p_size").cast("string"), F.lit("."))),
        (F.col("p_brand").isNotNull(), F.concat(F.lit("Who makes "), "p_name", F.lit("?")), F.concat(F.lit("It is made by "), "p_brand", F.lit("."))),
    ])
    return made.groupBy("user_text", "assistant").agg(F.count("*").alias("n"))


def entity_pairs(spark: SparkSession, folder: str) -> DataFrame:
    s, n = table(spark, folder, "supplier"), table(spark, folder, "nation")
    return answers.entity_pairs(s, n, [s.s_nationkey == n.n_nationkey, s.s_acctbal > 0], F.concat("s_name", F.lit(" trades in "), "n_name", F.lit(".")))


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    q = _pairs(spark, folder)
    return q.select(F.col("question_id").alias("conv_id"), "pair_id", F.coalesce("question", F.lit("")).alias("user"), F.coalesce("answer", F.lit("")).alias("assistant"))


def history_pack(spark: SparkSession, folder: str) -> DataFrame:
    size = lambda c: F.size(tokens(F.col(c)))
    kept = prompts.last_turns(_turns(spark, folder), "conv_id", ["pair_id"])
    conv = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pair_id", (size("user") + size("assistant") + 2).alias("n")))).alias("t"))
    return conv.select("conv_id", F.array_join(prompts.pack_newest(F.col("t.n"), F.lit(200)), " ").alias("kept"))


def role_messages(spark: SparkSession, folder: str) -> DataFrame:
    return prompts.role_messages(prompts.last_turns(_turns(spark, folder), "conv_id", ["pair_id"]), "conv_id", "turn")


def conversation_prompts(spark: SparkSession, folder: str) -> DataFrame:
    ids = lambda c: F.transform(tokens(F.col(c)), lambda w: F.length(w) + 5)
    kept = prompts.last_turns(_turns(spark, folder), "conv_id", ["pair_id"])
    conv = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pair_id", ids("user").alias("user"), ids("assistant").alias("assistant")))).alias("t"), F.max_by(ids("user"), "pair_id").alias("q"))
    made = prompts.conversation_prompt(F.transform("t", lambda x: F.struct(x["user"].alias("user"), x["assistant"].alias("assistant"))), F.col("q"), F.array(F.lit(7), F.lit(8)), 256)
    return conv.select("conv_id", F.size(made).alias("n_ids"), F.array_join(made, " ").alias("ids"))


def generation_hints(spark: SparkSession, folder: str) -> DataFrame:
    t, n = prompts.generation_hints(F.col("question"), F.lit(0.7), F.lit(200))
    return _pairs(spark, folder).select("pair_id", t.alias("temperature"), n.alias("budget"))


def loop_guards(spark: SparkSession, folder: str) -> DataFrame:
    ids = F.transform(tokens(F.coalesce("excerpt", F.lit(""))), lambda w: F.length(w) % 3)
    return table(spark, folder, "ngram_index").select("entry_id", F.array_join(guards.loop_guard(ids), " ").alias("banned")).distinct()


def value_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    v = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.col("p_size").cast("string"), F.lit("/8"))).when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_partkey").cast("string"))
    p = table(spark, folder, "part").select("p_partkey", v.alias("v"))
    return p.select("p_partkey", guards.integer_prefix(F.col("v"), 300).alias("bounded"), guards.integer_prefix(F.col("v"), commas=True).alias("grouped"), guards.rating_prefix(F.col("v")).alias("rating"))


def logit_filters(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 10).alias("x"))
    kept = lambda c: F.size(F.filter(c, lambda v: v > float("-inf")))
    return e.select("vec_id", kept(guards.keep_top_k(F.col("x"), 5)).alias("top_k"), kept(guards.keep_top_p(F.col("x"), 0.9)).alias("top_p"), F.round(guards.entropy_temperature(F.col("x")), 4).alias("temperature"))


def arithmetic(spark: SparkSession, folder: str) -> DataFrame:
    ask = F.concat(F.lit("What is "), F.col("p_size").cast("string"), F.lit(" * ("), F.col("p_partkey").cast("string"), F.lit(" + 2)?"))
    return table(spark, folder, "part").select("p_partkey", answer_arithmetic(ask).alias("answer"))


def tool_tags(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).filter(F.col("answer").contains("<TOOL:")).select("pair_id", replace_tool_tags("answer").alias("reply"))


def bpe_tokens(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    v = bpe.train(d, 600)
    ids = bpe.encode(F.coalesce("text", F.lit("")), v)
    coded = d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), ids.alias("ids"))
    return coded.select("doc_id", F.size("ids").alias("n_ids"), (bpe.decode(F.col("ids"), v) == F.col("text")).alias("round_trip"))


def pair_counts(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "documents").select(F.explode(tokens(F.lower(F.coalesce("text", F.lit(""))))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return bpe.pair_counts(words.select(F.split("w", "").alias("symbols"), "n")).withColumnsRenamed({"left": "left_symbol", "right": "right_symbol"})


def prepared_corpus(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return corpus.prepare(d, corpus.CorpusPlan(weights=WEIGHTS)).tokens.select("doc_id", "source", "weight", "n_tokens", "start_off", "end_off")


SYNTHETIC = (["The {who} guards the {what}.", "A {what} was lost by the {who}.", "No {who} fears a {what}."], {"who": ["keeper", "smith", "pilot"], "what": ["gate", "lamp", "map", "coin"]})


def synthetic_texts(spark: SparkSession, folder: str) -> DataFrame:
    return synthesis.template_texts(spark, 3000, *SYNTHETIC, seed=4)


def validated_examples(spark: SparkSession, folder: str) -> DataFrame:
    user, reply = F.coalesce("user_text", "prompt"), F.when(F.col("user_text").isNull(), F.col("response")).otherwise(F.col("assistant"))
    error = F.when(F.coalesce(user, F.lit("")) == "", "no user").when(F.coalesce(reply, F.lit("")) == "", "no assistant")
    d = table(spark, folder, "finetune_examples").select(user.alias("user"), reply.alias("assistant"), error.alias("error"))
    got = synthesis.validation_summary(d, F.length("user") + F.length("assistant"), 400)
    return got.withColumn("mean", r6("mean"))


def window_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "ngram_index").filter("excerpt is not null").groupBy("entry_id").agg(F.min("excerpt").alias("excerpt"))
    slot = F.row_number().over(Window.partitionBy("query_id").orderBy("entry_id"))
    d = e.select((F.col("entry_id") / 3).cast("bigint").alias("query_id"), "entry_id", F.transform(tokens(F.col("excerpt")), lambda w: F.length(w)).alias("ids")).withColumn("slot", slot).filter("slot <= 2")
    return synthesis.collate_neighbours(d, 2, 12).select("query_id", F.array_join(F.flatten("neighbours"), " ").alias("ids"))


def unit_vectors(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id", unit(F.transform("embedding", lambda x: x * 3)).alias("u"))
    return e.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 6).alias("length"))


def streamed_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and sums by hour and type as a stream brings them up to date; the last state of each is in the table."""
    path, target = scratch(spark, "events"), scratch(spark, "activity")
    events = table(spark, folder, "events")
    events.write.parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(path)
    conversations.run_to_end(conversations.activity(stream.withColumn("ts", F.col("ts").cast("timestamp"))), target, "update")
    state = spark.read.parquet(target).groupBy("window", "event_type").agg(F.max_by(F.struct("n", "total"), "_batch").alias("s"))
    return state.select(F.col("window.start").cast("string").alias("hour"), "event_type", "s.n", F.round("s.total", 4).alias("total"))


QUERIES = [doc_offsets, window_offsets, window_weights, block_split, tier_split, exact_sample, example_split, weighted_draws, padded_batches, right_padded, shifted_targets, chat_examples, difficulty_weights, schedules, grouped_batches, weight_histogram, length_summary, tier_losses, loss_summary, smoothed_losses, keyword_recall, hit_rate, window_f1, qa_parsed, qa_filtered, qa_ranked, qa_context, qa_finetune, qa_blocks, template_examples, entity_pairs, history_pack, role_messages, conversation_prompts, generation_hints, loop_guards, value_prefixes, logit_filters, arithmetic, tool_tags, bpe_tokens, pair_counts, prepared_corpus, unit_vectors, synthetic_texts, validated_examples, window_neighbours, streamed_activity]

_N = f"len({sql_tokens("coalesce(text, '')")}) + 1"
_W = "CAST(CASE WHEN starts_with(s, 'rules_') THEN 1.75 WHEN ends_with(s, '_qa') THEN 0.5 WHEN regexp_matches(s, '^home.rew_') THEN 1.25 WHEN regexp_matches(s, '^[mp]') THEN 0.75 ELSE 1.0 END AS DOUBLE)"
_SIZED = f"z AS (SELECT doc_id, source, CAST(n AS BIGINT) AS n_tokens, {_W} AS weight FROM (SELECT doc_id, source, {_N} AS n, coalesce(source, '') AS s FROM documents)), o AS (SELECT *, CAST(sum(n_tokens) OVER (ORDER BY doc_id) AS BIGINT) AS end_off FROM z), l AS (SELECT *, end_off - n_tokens AS start_off FROM o)"
_PAIRS = "p AS (SELECT pair_id, " + ", ".join(f"arg_max({{'v': {c}}}, (ingested_at, answer_score)).v AS {c}" for c in ("question_id", "question", "answer", "answer_score", "accepted")) + " FROM qa_pairs WHERE pair_id IS NOT NULL GROUP BY pair_id)"
_LEN = lambda x, add=5: f"list_transform({sql_tokens(x)}, lambda w: length(w) + {add})"
_JOIN = lambda x: f"array_to_string({x}, ' ')"
#: The held-out ones of 500 blocks, a tenth of them: the first of the seeded generator's permutation, without the
#: operator.  A corpus of 128,500 tokens or more has so many blocks.
_HELD = ", ".join(map(str, sorted(np.random.RandomState(0).permutation(500)[:50])))
_U = f"list_filter(list_transform(string_split(regexp_replace(u, '([.!?])[{WS}]+', '\\1' || chr(2), 'g'), chr(2)), lambda x: regexp_replace(x, '^[{WS}]+|[{WS}]+$', '', 'g')), lambda x: x <> '')"


def _units_sql(x: str) -> str:
    lines = f"list_filter(list_transform(string_split(regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g'), chr(10)), lambda y: regexp_replace(y, '^[{WS}]+|[{WS}]+$', '', 'g')), lambda y: y <> '')"
    return f"flatten(list_transform({lines}, lambda u: {_U}))"


def _lead_sql(x: str, n: int) -> str:
    return f"(CASE WHEN len({x}) = 0 THEN '' ELSE replace(list_reduce({x}, lambda a, y: CASE WHEN contains(a, chr(1)) OR length(a) + 1 + length(y) > {n} THEN rtrim(a, chr(1)) || chr(1) ELSE a || ' ' || y END), chr(1), '') END)"


_FRAMING = r"(?i)\b(i\s+(think|believe|guess)|in\s+my\s+opinion|as\s+far\s+as\s+i\s+know|correct\s+me\s+if|i''?m\s+not\s+sure|edit\s*:|update\s*:|related\s*:|see\s+also|possible\s+duplicate|welcome\s+to|thanks?\s+for|[a-z][a-z0-9_.-]{2,20}\s+(mentioned|said|wrote|noted|pointed\s+out|answered)|as\s+\S+\s+(mentioned|noted|said)|\b(the|this|your)\s+question\b|you\s+(asked|mean)\b|\bOP\b)"
_CTX = "k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN coalesce(accepted, false) THEN 2 WHEN answer_score IS NOT NULL THEN 1 ELSE 0 END DESC, CASE WHEN coalesce(accepted, false) THEN 0 ELSE coalesce(answer_score, 0) END DESC, pair_id) AS place FROM p), c AS (SELECT a.*, x.pair_id AS context_id, x.answer AS context_answer FROM k a LEFT JOIN k x ON x.question_id = a.question_id AND x.place = CASE WHEN a.place = 1 THEN 2 ELSE 1 END)"
_PYLINES = sql_lines("text")
_ANS = r"^##\s+Answer\s*(\(accepted\))?\s*\(score:\s*-?[0-9]+\)\s*$"

SQL = {
    "doc_offsets": f"WITH {_SIZED} SELECT doc_id, start_off, end_off FROM l",
    "window_offsets": f"WITH {_SIZED}, r AS (SELECT weight, min(start_off) AS s, max(end_off) AS e FROM l GROUP BY weight), w AS (SELECT weight, unnest(range(s, e - {SEQ}, {STRIDE})) AS o FROM r WHERE e - s > {SEQ}) SELECT weight AS region_id, count(*) AS n_windows, CAST(min(o) AS BIGINT) AS first_offset, CAST(max(o) AS BIGINT) AS last_offset FROM w GROUP BY weight",
    "window_weights": f'WITH {_SIZED}, w AS (SELECT CAST(unnest(range(0, (SELECT max(end_off) FROM l) - {SEQ}, {STRIDE})) AS BIGINT) AS window_off) SELECT window_off, doc_id, weight FROM w JOIN l ON window_off >= start_off AND window_off < end_off',
    "block_split": f"WITH {_SIZED}, n AS (SELECT CAST(sum(n_tokens) AS DOUBLE) AS n FROM z) SELECT CAST(trunc(i * (n / 500.0)) AS BIGINT) AS block_start, CASE WHEN i = 499 THEN CAST(n AS BIGINT) ELSE CAST(trunc((i + 1) * (n / 500.0)) AS BIGINT) END AS block_end, i IN ({_HELD}) AS is_val FROM n, range(500) t(i)",
    "tier_split": f"""WITH {_SIZED}, k AS (SELECT *, md5(doc_id || '|0') AS k FROM z), t AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY weight ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n_tokens) OVER (PARTITION BY weight) AS t, count(*) OVER (PARTITION BY weight) AS n, row_number() OVER (PARTITION BY weight ORDER BY k, doc_id) AS i FROM k)
      SELECT doc_id, weight, t >= {SEQ + 1} AND n > 1 AND b < t * CAST(0.05 AS DOUBLE) AND i < n AS is_val FROM t""",
    "exact_sample": "SELECT example_id FROM (SELECT DISTINCT example_id FROM finetune_examples) ORDER BY md5(example_id || '|3'), example_id LIMIT 200",
    "example_split": "WITH d AS (SELECT DISTINCT example_id FROM finetune_examples), r AS (SELECT *, row_number() OVER (ORDER BY md5(example_id || '|3'), example_id) AS r, count(*) OVER () AS n FROM d) SELECT example_id, r <= least(greatest(1, round_even(n * CAST(0.1 AS DOUBLE), 0)), greatest(n - 1, 0)) AS is_val FROM r",
    "weighted_draws": """WITH l AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS w, CAST(sum(p_size) OVER (ORDER BY p_partkey) AS DOUBLE) AS e FROM part), t AS (SELECT CAST(sum(p_size) AS DOUBLE) AS s FROM part),
      d AS (SELECT i AS draw, CAST('0x' || substr(md5(i || '|5'), 1, 12) AS BIGINT) / 281474976710656.0 * s AS pt FROM range(1000) r(i), t) SELECT draw, p_partkey FROM d JOIN l ON pt >= e - w AND pt < e""",
    "padded_batches": """WITH l AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS ids FROM lineitem GROUP BY l_orderkey), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY l_orderkey % 500) AS n FROM l)
      SELECT l_orderkey, repeat('0 ', n - len(ids)) || array_to_string(ids, ' ') AS ids, repeat('-100 ', n - len(ids)) || array_to_string(ids, ' ') AS labels, rtrim(repeat('0 ', n - len(ids)) || repeat('1 ', len(ids))) AS mask FROM m""",
    "right_padded": f"WITH d AS (SELECT DISTINCT entry_id, list_concat([1], {_LEN("coalesce(excerpt, '')")})[1:40] AS ids FROM ngram_index) SELECT DISTINCT entry_id, {_JOIN('ids')} || repeat(' 0', 40 - len(ids)) AS ids FROM d",
    "shifted_targets": f"""WITH d AS (SELECT DISTINCT entry_id, {_LEN("coalesce(excerpt, '')", 0)} AS ids FROM ngram_index), w AS (SELECT entry_id, CAST(unnest(range(0, (len(ids) - 2) // 16 + 1)) AS INT) AS k, ids FROM d WHERE len(ids) >= 2), s AS (SELECT entry_id, k AS win_no, ids[16 * k + 1:16 * k + 17] AS ids FROM w)
      SELECT entry_id, win_no, {_JOIN("ids[2:] || list_transform(range(17 - len(ids)), lambda i: -100)")} AS next, {_JOIN("ids[4:] || list_transform(range(least(19 - len(ids), 16)), lambda i: -100)")} AS third FROM s""",
    "chat_examples": f"""WITH d AS (SELECT DISTINCT example_id, {_LEN("coalesce(user_text, prompt, '')")} AS u, {_LEN("coalesce(CASE WHEN user_text IS NULL THEN response ELSE assistant END, '')")} AS a, {_LEN("coalesce(context, '')")} AS c FROM finetune_examples),
      p AS (SELECT example_id, list_concat(CASE WHEN len(c) > 0 THEN list_concat(list_concat([1, 3], c), [3, 4]) ELSE [1, 4] END, list_concat(u, [5])) AS p, list_concat(a, [2]) AS r FROM d WHERE len(u) > 0 AND len(a) > 0),
      f AS (SELECT example_id, len(p) AS np, CASE WHEN len(p) + len(r) > 96 THEN list_concat(list_concat(p, r)[1:95], [2]) ELSE list_concat(p, r) END AS f FROM p), m AS (SELECT *, least(np, len(f)) - 1 AS m FROM f)
      SELECT example_id, {_JOIN('f[1:len(f) - 1]')} AS ids, repeat('-100 ', m) || {_JOIN('f[m + 2:len(f)]')} AS labels FROM m WHERE m < len(f) - 1""",
    "difficulty_weights": "WITH w AS (SELECT l_orderkey, l_linenumber, greatest(pow(greatest(l_extendedprice / 20000 - 0.5, 0.0), 1.5), 0.1) AS w FROM lineitem) SELECT l_orderkey, l_linenumber, round(w / (SELECT avg(w) FROM w), 4) AS weight FROM w",
    "schedules": """WITH d AS (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) AS n, CAST(o_orderkey % 10000 AS DOUBLE) AS s, o_orderkey % 1000 AS k FROM orders)
      SELECT o_orderkey, round(CASE WHEN s < 500 THEN s / 500.0 ELSE 0.1 + 0.9 * 0.5 * (1.0 + cos(pi() * ((s - 500) / 9500.0))) END * 3e-4 * 1e6, 4) AS rate, CASE WHEN n * 100000 < 100000000 THEN 'small-25M' WHEN n * 100000 < 500000000 THEN 'medium-85M' ELSE 'large-250M' END AS preset,
      CAST(round(20.0 * n * 1000 / 32768.0) AS BIGINT) AS steps, CAST(greatest(round(k * CASE WHEN k <= 20 THEN 2 WHEN k <= 100 THEN 3 WHEN k <= 500 THEN 4 ELSE 6 END / 16.0), 1.0) AS BIGINT) AS tuning_steps, CAST(CASE WHEN k <= 20 THEN 4 WHEN k <= 100 THEN 6 WHEN k <= 500 THEN 8 ELSE 12 END AS INT) AS adapter_epochs FROM d""",
    "grouped_batches": """WITH p AS (SELECT DISTINCT question_id AS doc_id, pair_id AS passage_id FROM qa_pairs), r AS (SELECT doc_id, count(*) OVER () AS n FROM p GROUP BY doc_id HAVING count(*) >= 2),
      k AS (SELECT doc_id, i, CAST('0x' || substr(md5(doc_id || '|' || i || '|1'), 1, 12) AS BIGINT) / 281474976710656.0 + i AS key FROM r, range(100) t(i) WHERE i < ceil(100.0 / n)), b AS (SELECT doc_id, (row_number() OVER (ORDER BY key) - 1) // 4 AS batch FROM k),
      q AS (SELECT batch, doc_id, passage_id, row_number() OVER (PARTITION BY batch, doc_id ORDER BY md5(passage_id || '|' || batch || '|1'), passage_id) AS k FROM b JOIN p USING (doc_id) WHERE batch < 25) SELECT CAST(batch AS BIGINT) AS batch, doc_id, passage_id FROM q WHERE k <= 2""",
    "weight_histogram": f"WITH {_SIZED} SELECT weight, count(*) AS n, round(100.0 * count(*) / CAST((SELECT count(*) FROM z) AS DOUBLE), 6) AS percent FROM z GROUP BY weight",
    "length_summary": f"WITH {_SIZED} SELECT count(*) AS n, min(n_tokens) AS shortest, max(n_tokens) AS longest, round(avg(n_tokens), 6) AS mean, count(*) FILTER (n_tokens > 512) AS truncated FROM z",
    "tier_losses": "WITH d AS (SELECT l_returnflag, l_tax + l_discount AS l, l_quantity AS q FROM lineitem) SELECT l_returnflag, sum(q) AS n, round(sum(l * q) / sum(q), 6) AS mean_loss, round((SELECT sum(l * q) / sum(q) FROM d), 6) AS overall_loss FROM d GROUP BY l_returnflag",
    "loss_summary": "WITH m AS (SELECT sum(l_quantity * l_tax) / count(*) AS m, count(*) AS n FROM lineitem) SELECT round(exp(m), 4) AS perplexity, round(m / ln(2.0), 4) AS bits_per_token, round(m, 4) AS mean_loss, n AS n_tokens FROM m",
    "smoothed_losses": "WITH d AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT a.l_orderkey, a.l_linenumber, round(sum(b.q * 0.1 * pow(0.9, a.i - b.i)) / (1 - pow(0.9, a.i)), 6) AS smooth FROM d a JOIN d b ON a.l_orderkey = b.l_orderkey AND b.i <= a.i GROUP BY a.l_orderkey, a.l_linenumber, a.i",
    "keyword_recall": "WITH r AS (SELECT item_id, CASE WHEN coalesce(len(keywords), 0) = 0 THEN 1.0 ELSE CAST(len(list_filter(keywords, lambda k: contains(lower(coalesce(assistant, '')), lower(k)))) AS DOUBLE) / len(keywords) END AS r FROM eval_items) SELECT item_id, round(r, 6) AS recall, r >= 0.5 AS passed FROM r",
    "hit_rate": "WITH h AS (SELECT len(list_filter(keywords, lambda k: NOT contains(lower(coalesce(assistant, user_text)), lower(k)))) = 0 AS h FROM eval_items WHERE len(keywords) > 0) SELECT count(*) AS n, count(*) FILTER (h) AS hits, round(count(*) FILTER (h) / CAST(count(*) AS DOUBLE), 4) AS hit_rate FROM h",
    "qa_filtered": f"WITH {_PAIRS} SELECT pair_id, 'score' AS kind FROM p WHERE coalesce(answer_score, 0) >= 2 UNION ALL SELECT pair_id, 'accepted' FROM p WHERE coalesce(accepted, false)",
    "qa_ranked": f"WITH {_PAIRS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY coalesce(accepted, false) DESC, answer_score DESC NULLS LAST, pair_id) AS INT) AS rank FROM p) SELECT question_id, pair_id, rank FROM r WHERE rank <= 3 AND coalesce(answer_score, 0) >= 0",
    "qa_context": f"WITH {_PAIRS}, {_CTX} SELECT pair_id, context_id FROM c",
    "qa_finetune": f"""WITH {_PAIRS.replace('GROUP BY pair_id)', 'GROUP BY pair_id HAVING question IS NOT NULL AND answer IS NOT NULL)')}, {_CTX}, u AS (SELECT pair_id, question AS user_text, {_units_sql('coalesce(context_answer, answer)')} AS cu, list_filter({_units_sql('answer')}, lambda q: NOT regexp_matches(q, '{_FRAMING}') AND NOT ends_with(regexp_replace(q, '[{WS}]+$', ''), '?')) AS au FROM c),
      t AS (SELECT pair_id, user_text, {_lead_sql('au', 350)} AS assistant, {_lead_sql('cu', 600)} AS context FROM u) SELECT * FROM t WHERE length(context) >= 20 AND length(assistant) >= 10""",
    "qa_blocks": f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY coalesce(accepted, false) DESC, answer_score DESC NULLS LAST, pair_id) AS rank FROM p),
      b AS (SELECT question_id, string_agg(chr(10) || '## ' || CASE WHEN coalesce(accepted, false) THEN 'Answer (accepted)' ELSE 'Answer' END || '  (score: ' || coalesce(answer_score, 0) || ')' || chr(10) || chr(10) || coalesce(answer, ''), chr(10) ORDER BY rank) AS b FROM r WHERE rank <= 2 AND coalesce(answer_score, 0) >= 0 GROUP BY question_id)
      SELECT question_id, '# ' || trim(min(question), ' ') || chr(10) || coalesce(any_value(b), '') || chr(10) || chr(10) || '---' AS block FROM p LEFT JOIN b USING (question_id) GROUP BY question_id""",
    "template_examples": "WITH e AS (SELECT 'How big is ' || p_name || '?' AS user_text, p_name || ' has size ' || p_size || '.' AS assistant FROM part WHERE p_size > 25 UNION ALL SELECT 'Who makes ' || p_name || '?', 'It is made by ' || p_brand || '.' FROM part WHERE p_brand IS NOT NULL) SELECT user_text, assistant, count(*) AS n FROM e GROUP BY ALL",
    "entity_pairs": "SELECT s_name || ' trades in ' || n_name || '.' AS passage FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0",
    "history_pack": f"""WITH RECURSIVE {_PAIRS}, t AS (SELECT question_id AS conv_id, pair_id, len({sql_tokens("coalesce(question, '')")}) + len({sql_tokens("coalesce(answer, '')")}) + 2 AS n, row_number() OVER (PARTITION BY question_id ORDER BY pair_id DESC) AS r FROM p),
      k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pair_id) - 1 AS i FROM t WHERE r <= 20),
      f(conv_id, r, used, kept) AS (SELECT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM (SELECT DISTINCT conv_id FROM k) UNION ALL SELECT f.conv_id, k.r, CASE WHEN f.used + n <= 200 THEN f.used + n ELSE f.used END, CASE WHEN f.used + n <= 200 THEN list_concat([i], f.kept) ELSE f.kept END FROM f JOIN k ON k.conv_id = f.conv_id AND k.r = f.r + 1)
      SELECT conv_id, array_to_string(arg_max(kept, r), ' ') AS kept FROM f GROUP BY conv_id""",
    "role_messages": f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pair_id DESC) AS r FROM p), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY pair_id) AS INT) AS turn FROM r WHERE r <= 20)
      SELECT question_id AS conv_id, turn, 0 AS part, 'user' AS role, coalesce(question, '') AS content FROM k UNION ALL SELECT question_id, turn, 1, 'assistant', coalesce(answer, '') FROM k""",
    "generation_hints": f"""WITH {_PAIRS}, q AS (SELECT pair_id, lower(trim(coalesce(question, ''), ' ')) AS q, len(list_filter(regexp_split_to_array(lower(trim(coalesce(question, ''), ' ')), '\\s+'), lambda x: x <> '')) AS n FROM p)
      SELECT pair_id, CAST(CASE WHEN regexp_matches(q, '^(what|how many|list|when|define)\\b') THEN 0.5 WHEN regexp_matches(q, '^(write|create|design|imagine)\\b') THEN 0.9 ELSE 0.7 END AS DOUBLE) AS temperature, CAST(CASE WHEN n < 10 THEN 256 WHEN n > 50 THEN 128 ELSE 200 END AS INT) AS budget FROM q""",
    "loop_guards": f"""WITH d AS (SELECT DISTINCT entry_id, list_transform({sql_tokens("coalesce(excerpt, '')")}, lambda w: length(w) % 3) AS i FROM ngram_index), c AS (SELECT entry_id, list_filter(list_transform(range(1, 5), lambda p: CASE WHEN len(i) >= 2 * p AND i[len(i) - p + 1:len(i)] = i[len(i) - 2 * p + 1:len(i) - p] THEN i[len(i) - p + 1] END), lambda x: x IS NOT NULL) AS b FROM d)
      SELECT DISTINCT entry_id, array_to_string(list_sort(list_distinct(b)), ' ') AS banned FROM c""",
    "conversation_prompts": f"""WITH RECURSIVE {_PAIRS}, t AS (SELECT question_id AS conv_id, pair_id, {_LEN("coalesce(question, '')")} AS u, {_LEN("coalesce(answer, '')")} AS a, row_number() OVER (PARTITION BY question_id ORDER BY pair_id DESC) AS r FROM p),
      k AS (SELECT *, list_concat(list_concat([4], u), list_concat([5], a)) AS seg, first_value(u) OVER (PARTITION BY conv_id ORDER BY r) AS q FROM t WHERE r <= 20),
      f(conv_id, r, q, hist) AS (SELECT conv_id, CAST(0 AS BIGINT), q, CAST([] AS BIGINT[]) FROM k WHERE r = 1 UNION ALL SELECT f.conv_id, k.r, f.q, CASE WHEN len(f.hist) + len(seg) <= 256 - len(f.q) - 3 - 2 THEN list_concat(seg, f.hist) ELSE f.hist END FROM f JOIN k ON k.conv_id IS NOT DISTINCT FROM f.conv_id AND k.r = f.r + 1),
      l AS (SELECT conv_id, arg_max(q, r) AS q, arg_max(hist, r) AS h FROM f GROUP BY conv_id), c AS (SELECT *, [7, 8][1:greatest(256 - len(q) - 3 - 2 - len(h), 0)] AS c FROM l),
      m AS (SELECT conv_id, list_concat(list_concat(CASE WHEN len(c) > 0 THEN list_concat(list_concat([1, 3], c), [3]) ELSE [1] END, h), list_concat(list_concat([4], q), [5])) AS m FROM c) SELECT conv_id, CAST(len(m) AS INT) AS n_ids, {_JOIN('m')} AS ids FROM m""",
    "value_prefixes": """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_size || '/8' WHEN p_partkey % 5 = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS v FROM part)
      SELECT p_partkey, v = '' OR (regexp_matches(v, '^[0-9]+$') AND length(v) <= 3 AND coalesce(TRY_CAST(v AS BIGINT) <= 300, true)) AS bounded, v = '' OR regexp_matches(v, '^[0-9]{1,3}(,[0-9]{0,3})*$') AS grouped,
      len(list_filter(list_concat(['0', '1/8', '1/4', '1/2'], list_transform(range(1, 31), lambda i: CAST(i AS VARCHAR))), lambda x: starts_with(x, v))) > 0 AS rating FROM p""",
    "pair_counts": f"""WITH w AS (SELECT w, count(*) AS n FROM (SELECT unnest({sql_tokens("lower(coalesce(text, ''))")}) AS w FROM documents) GROUP BY w), p AS (SELECT unnest(range(1, length(w))) AS i, w, n FROM w) SELECT substr(w, i, 1) AS left_symbol, substr(w, i + 1, 1) AS right_symbol, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY ALL""",
    "synthetic_texts": f"""WITH d AS (SELECT CAST(i AS BIGINT) AS id, {SYNTHETIC[0]}[i % 3 + 1] AS t, {SYNTHETIC[1]["who"]}[CAST('0x' || substr(md5(i || '|who|4'), 1, 8) AS BIGINT) % 3 + 1] AS who, {SYNTHETIC[1]["what"]}[CAST('0x' || substr(md5(i || '|what|4'), 1, 8) AS BIGINT) % 4 + 1] AS what FROM range(3000) r(i))
      SELECT id, replace(replace(t, '{{who}}', who), '{{what}}', what) AS text FROM d""",
    "validated_examples": """WITH d AS (SELECT coalesce(user_text, prompt, '') AS u, coalesce(CASE WHEN user_text IS NULL THEN response ELSE assistant END, '') AS a FROM finetune_examples), n AS (SELECT u, a, CASE WHEN u <> '' AND a <> '' THEN length(u) + length(a) END AS n FROM d)
      SELECT count(n) AS n_valid, CAST(0 AS BIGINT) AS n_not_json, count(*) - count(n) AS n_incomplete, CAST(min(n) AS INT) AS shortest, CAST(max(n) AS INT) AS longest, round(avg(n), 6) AS mean, count(*) FILTER (n > 400) AS n_truncated FROM n""",
    "window_neighbours": f"""WITH e AS (SELECT entry_id, min(excerpt) AS x FROM ngram_index WHERE excerpt IS NOT NULL GROUP BY entry_id), s AS (SELECT entry_id // 3 AS query_id, {_LEN("x", 0)} AS ids, row_number() OVER (PARTITION BY entry_id // 3 ORDER BY entry_id) AS k FROM e),
      f AS (SELECT query_id, k, array_to_string(ids[1:12], ' ') || repeat(' 0', greatest(12 - len(ids), 0)) AS t FROM s WHERE k <= 2) SELECT query_id, string_agg(t, ' ' ORDER BY k) || CASE WHEN count(*) = 1 THEN repeat(' 0', 12) ELSE '' END AS ids FROM f GROUP BY query_id""",
    "qa_parsed": f"""WITH l AS (SELECT doc_id, unnest({_PYLINES}) AS x, generate_subscripts({_PYLINES}, 1) AS i FROM documents WHERE contains(text, '## Answer')),
      k AS (SELECT *, regexp_matches(x, '{_ANS}') AS ans, NOT starts_with(x, '##') AND regexp_matches(x, '^#[{WS}]+[^\n]') AND NOT regexp_matches(x, '{_ANS}') AS head, {sql_strip('x')} = '---' AS rule FROM l),
      b AS (SELECT *, sum(CAST(ans OR head OR rule AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS part, last_value(CASE WHEN head THEN {sql_strip("x[2:]")} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS title FROM k),
      g AS (SELECT doc_id, part, any_value(title) AS title, bool_or(ans) AS is_answer, any_value(CASE WHEN ans THEN x END) AS h, string_agg(CASE WHEN NOT ans THEN x END, chr(10) ORDER BY i) AS body FROM b GROUP BY doc_id, part),
      f AS (SELECT *, {sql_strip("coalesce(body, '')")} AS answer FROM g WHERE is_answer AND title <> '')
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INT) AS answer_no, title AS question, answer, CAST(regexp_extract(h, 'score:\\s*(-?[0-9]+)', 1) AS BIGINT) AS answer_score, contains(h, '(accepted)') AS accepted FROM f WHERE answer <> ''""",
    "streamed_activity": "SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "arithmetic": "SELECT p_partkey, p_size || ' * (' || p_partkey || ' + 2) = ' || (p_size * (p_partkey + 2)) AS answer FROM part",
    "logit_filters": """WITH x AS (SELECT vec_id, unnest(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 10)) AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT *, max(x) OVER (PARTITION BY vec_id) AS m, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM x),
      q AS (SELECT *, exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY vec_id) AS q FROM m), c AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY vec_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before, max(CASE WHEN r = 5 THEN x END) OVER (PARTITION BY vec_id) AS fifth FROM q)
      SELECT vec_id, CAST(count(*) FILTER (x >= fifth) AS INT) AS top_k, CAST(count(*) FILTER (before <= 0.9) AS INT) AS top_p, round(0.5 + 0.8 * (1.0 - least(greatest(-sum(q * ln(q + 1e-12)) / ln(CAST(count(*) AS DOUBLE)), 0.0), 1.0)), 4) AS temperature FROM c GROUP BY vec_id""",
    "prepared_corpus": f"""WITH RECURSIVE kd AS (WITH {texts._QUALITY} SELECT doc_id, coalesce(text, '') AS text, source FROM documents WHERE doc_id IN (SELECT doc_id FROM v WHERE n_reasons = 0)),
      {corpora.clusters_sql('kd')}, k AS (SELECT cl.id, row_number() OVER (PARTITION BY cluster_id ORDER BY length(text) DESC, cl.id) AS r FROM cl JOIN kd ON kd.doc_id = cl.id),
      z AS (SELECT doc_id, source, CAST({_N.replace("coalesce(text, '')", 'text')} AS BIGINT) AS n_tokens, {_W.replace('(s,', "(coalesce(source, ''),")} AS weight FROM kd WHERE doc_id NOT IN (SELECT id FROM k WHERE r > 1)), o AS (SELECT *, CAST(sum(n_tokens) OVER (ORDER BY doc_id) AS BIGINT) AS end_off FROM z)
      SELECT doc_id, source, weight, n_tokens, end_off - n_tokens AS start_off, end_off FROM o""",
    "unit_vectors": "SELECT vec_id, CAST(1.0 AS DOUBLE) AS length FROM embeddings",
}
