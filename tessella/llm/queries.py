"""Registered queries of the training-data problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import tables
from tessella.llm.leaks import Leaks, find_leaks
from tessella.llm.line_states import LineStates, text_statistics
from tessella.llm.mixing import Mixing, Mixture, mix, quality_weights
from tessella.llm.near_duplicates import NearDuplicates, groups, record_pairs
from tessella.llm.reply_defects import defects, labels
from tessella.llm.spam_pages import SpamPages, score_pages

#: Candidate shingles of ten words: shorter ones of formulaic sentences are held by too many texts.  Two shared values
#: of 48 make a candidate; pairs with a single one are found over a common neighbour.
VERSIONS = NearDuplicates(shingle=10, check_shingle=2, measure="dice", threshold=0.6, k=48, floor=0.04, min_words=30)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    got = record_pairs(tables.reposted(spark, folder), VERSIONS)
    return got.select(F.col("tbl").alias("rec_table"), "id_a", "id_b")


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    got = groups(tables.reposted(spark, folder), VERSIONS)
    return got.select(F.col("tbl").alias("rec_table"), F.col("id").alias("rec_id"), "class_id", "n_links")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    got = defects(tables.question_replies(spark, folder))
    return got.select(F.col("tbl").alias("rec_table"), F.col("id").alias("rec_id"), "defect")


def p2_labels(spark: SparkSession, folder: str) -> DataFrame:
    got = labels(tables.question_replies(spark, folder))
    return got.select(F.col("tbl").alias("rec_table"), F.col("id").alias("rec_id"), "defect", F.round("posterior", 6).alias("posterior"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    got = text_statistics(tables.judged_texts(spark, folder), LineStates()).filter("not is_prose")
    return got.select(F.col("tbl").alias("rec_table"), F.col("id").alias("rec_id"))


def p3_statistics(spark: SparkSession, folder: str) -> DataFrame:
    got = text_statistics(tables.judged_texts(spark, folder), LineStates())
    return got.withColumnsRenamed({"tbl": "rec_table", "id": "rec_id"})


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics that any engine can count."""
    got = text_statistics(tables.judged_texts(spark, folder), LineStates())
    return got.select(F.col("tbl").alias("rec_table"), F.col("id").alias("rec_id"), "n_chars", "n_words", F.round("mean_word_length", 6).alias("mean_word_length"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    texts = tables.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    items = tables.table(spark, folder, "eval_items").select(F.col("item_id").alias("item"), F.col("assistant").alias("passage"))
    return find_leaks(texts, items, Leaks()).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"))


def _mixture(spark: SparkSession, folder: str) -> Mixture:
    docs = tables.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    weights = quality_weights(tables.table(spark, folder, "quality_reports"))
    return mix(docs, tables.table(spark, folder, "mix_targets"), weights, Mixing())


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).report.filter("short").select("source")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).report


def p5_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).selection.withColumnRenamed("id", "doc_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return score_pages(docs, SpamPages()).filter("is_spam").select(F.col("id").alias("doc_id"))


def p6_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return score_pages(docs, SpamPages()).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_labels, p3_found, p3_statistics, p3_counts, p4_found, p5_found, p5_report, p5_mix, p6_found, p6_scores)}


_WORDS = "regexp_extract_all(lower(x), '[\\p{L}\\p{N}]+')"


def _pairs_sql(tbl: str, key: str, text: str) -> str:
    """All pairs of one field by exact counting of shared neighbouring words; quadratic in frequent pairs of words."""
    return f"""SELECT '{tbl}' AS rec_table, a AS id_a, b AS id_b FROM (
      WITH r AS (SELECT DISTINCT {key} AS id, {text} AS x FROM {tbl} WHERE {key} IS NOT NULL AND {text} IS NOT NULL), w AS (SELECT id, {_WORDS} AS w FROM r), l AS (SELECT * FROM w WHERE len(w) >= 30),
      g AS (SELECT id, g, count(*) AS c FROM (SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM l) GROUP BY ALL),
      n AS (SELECT id, sum(c) AS n FROM g GROUP BY id), s AS (SELECT u.id AS a, v.id AS b, sum(least(u.c, v.c)) AS m FROM g u JOIN g v ON u.g = v.g AND u.id < v.id GROUP BY ALL)
      SELECT a, b FROM s JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 2 * m >= 0.6 * (x.n + y.n))"""


_FIELDS = (("qa_pairs", "pair_id", "answer"), ("finetune_examples", "example_id", "context"), ("ngram_index", "entry_id", "excerpt"))


def _groups_sql() -> str:
    """Classes by spreading the least id over the pairs; links to texts other than one's own."""
    records = " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, {i} AS id, {x} AS x FROM {t} WHERE {i} IS NOT NULL AND {x} IS NOT NULL" for t, i, x in _FIELDS)
    pairs = " UNION ALL ".join(_pairs_sql(*f) for f in _FIELDS)
    return f"""WITH RECURSIVE rec AS ({records}), one AS (SELECT rec_table AS t, id_a AS a, id_b AS b FROM ({pairs})), way AS (SELECT t, a, b FROM one UNION SELECT t, b, a FROM one),
      met(t, id, root) AS (SELECT DISTINCT t, id, id FROM rec UNION SELECT m.t, w.b, m.root FROM met m JOIN way w ON w.t = m.t AND w.a = m.id WHERE m.root < w.b),
      cls AS (SELECT t, id, min(root) AS class_id FROM met GROUP BY ALL), lnk AS (SELECT w.t, w.a AS id, count(DISTINCT y.x) AS n FROM way w JOIN rec x ON x.t = w.t AND x.id = w.a JOIN rec y ON y.t = w.t AND y.id = w.b WHERE x.x <> y.x GROUP BY ALL)
      SELECT cls.t AS rec_table, cls.id AS rec_id, class_id, coalesce(n, 0) AS n_links FROM cls LEFT JOIN lnk ON lnk.t = cls.t AND lnk.id = cls.id"""


def oracle_sql() -> dict[str, str]:
    """Exact counting for the pairs; sizes in characters stand in for tokens, as any tokenizer gives the same list."""
    return {
        "p1_groups": _groups_sql(),
        "p3_counts": f"""WITH r AS (SELECT DISTINCT 'ngram_index' AS t, entry_id AS id, excerpt AS x FROM ngram_index WHERE entry_id IS NOT NULL UNION ALL SELECT DISTINCT 'documents', doc_id, text FROM documents WHERE doc_id IS NOT NULL),
          p AS (SELECT t, id, replace(coalesce(x, ''), chr(65279), '') AS x FROM r), w AS (SELECT t, id, length(x) AS n_chars, {_WORDS} AS w FROM p)
          SELECT t AS rec_table, id AS rec_id, n_chars, len(w) AS n_words, round(CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda y: length(y))) / len(w) ELSE 0.0 END, 6) AS mean_word_length FROM w""",
        "p1_found": " UNION ALL ".join(_pairs_sql(*x) for x in _FIELDS),
        "p5_found": """WITH t AS (SELECT lower(trim(source)) AS k, arg_max(source, updated_at) AS source, arg_max(target_share, updated_at) AS share, arg_max(max_repeats, updated_at) AS most FROM mix_targets WHERE source IS NOT NULL GROUP BY 1),
          d AS (SELECT lower(trim(source)) AS k, sum(length(text)) AS n FROM documents WHERE lower(trim(source)) IN (SELECT k FROM t) GROUP BY 1)
          SELECT source FROM t LEFT JOIN d USING (k) WHERE most * coalesce(n, 0) < share * (SELECT sum(n) FROM d)""",
    }
