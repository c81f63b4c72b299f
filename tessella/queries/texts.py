"""Queries of cleaning, markup, names and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import cleaning as C
from tessella.functions.game_text import generic_text, labelled, monster_text, resolve_tags, spell_meta
from tessella.functions.html_text import body_text, main_text
from tessella.functions.text_rules import strip
from tessella.operators import quality
from tessella.queries.base import WS, r6, sql_chain, sql_lines, sql_nfkc, sql_strip, sql_tokens, table

WEIGHTS = [("rules_*", 1.75), ("*_qa", 0.5), ("home?rew_*", 1.25), ("[mp]*", 0.75)]


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", "file_name")


def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.quality_reports(_docs(spark, folder))
    return judged.select("doc_id", *[r6(c).alias(c) for c in quality.STATISTICS], F.size("reasons").alias("n_reasons"), "is_kept")


def quality_kept(spark: SparkSession, folder: str) -> DataFrame:
    return quality.kept_documents(_docs(spark, folder)).select("doc_id", "source")


def clean_standard(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", C.clean(F.col("text"), C.Cleaning.STANDARD, normalize=False).alias("clean"))


def clean_thorough(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", C.clean(F.col("text"), C.Cleaning.THOROUGH, normalize=False).alias("clean"))


def clean_nfkc(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", C.clean(F.col("text"), C.Cleaning.STANDARD).alias("clean"))


def _unix(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).withColumn("text", C.unix_lines(F.col("text")))


def markdown_strip(spark: SparkSession, folder: str) -> DataFrame:
    return _unix(spark, folder).select("doc_id", C.strip_markdown(F.col("text")).alias("plain"))


def wikitext_strip(spark: SparkSession, folder: str) -> DataFrame:
    return _unix(spark, folder).select("doc_id", C.strip_wikitext(F.col("text")).alias("plain"), C.strip_wiki_remnants(F.col("text")).alias("tidy"))


def qa_scaffold_strip(spark: SparkSession, folder: str) -> DataFrame:
    plain = C.strip_qa_scaffold(F.col("text"))
    return _unix(spark, folder).select("doc_id", plain.alias("plain"), (F.length("text") - F.length(plain)).cast("long").alias("removed"))


def scanned_pages_clean(spark: SparkSession, folder: str) -> DataFrame:
    return _unix(spark, folder).select("doc_id", C.clean_scanned_pages(F.col("text")).alias("plain"))


def book_frame_strip(spark: SparkSession, folder: str) -> DataFrame:
    framed = F.concat(F.lit("Produced by volunteers\n*** START OF THE PROJECT GUTENBERG EBOOK "), F.col("doc_id").cast("string"), F.lit(" ***\n\n\n\n\n"), "text", F.lit("\n*** END OF THE PROJECT GUTENBERG EBOOK ***\nLicence"))
    return _unix(spark, folder).select("doc_id", C.strip_book_frame(framed).alias("plain"))


def wiki_navigation_strip(spark: SparkSession, folder: str) -> DataFrame:
    lined = F.concat(F.lit("Previous: "), F.coalesce("source", F.lit("")), F.lit("\n"), "text", F.lit("\nNext : page"))
    return _unix(spark, folder).select("doc_id", C.strip_wiki_navigation(lined).alias("plain"))


URL = r"(https?://[A-Za-z0-9./_?=&-]+)"


def _urls(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(URL), F.lit(1))).alias("url")).distinct()


def url_names(spark: SparkSession, folder: str) -> DataFrame:
    return _urls(spark, folder).select("doc_id", "url", C.url_file_name(F.col("url")).alias("file_stem"), C.url_is_markdown(F.concat("url", F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(""))).alias("is_markdown"))


def tag_strings(spark: SparkSession, folder: str) -> DataFrame:
    tags = F.concat(F.lit("<"), F.regexp_replace(F.coalesce("source", F.lit("none")), "_", "><"), F.lit(">"))
    return _docs(spark, folder).select("doc_id", C.tag_words(tags).alias("tags"))


def source_weights(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", C.weight_by_glob(F.coalesce("source", F.lit("")), WEIGHTS).alias("weight"))


def small_formats(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    rating = F.when(F.col("p_size") % 4 == 0, F.col("p_size") / 8.0).otherwise(F.col("p_size").cast("double"))
    return part.select("p_partkey", C.ordinal(F.col("p_partkey")).alias("ordinal"), C.challenge_rating(rating).alias("rating"), C.slug(F.col("p_name")).alias("slug"))


def rename_plan(spark: SparkSession, folder: str) -> DataFrame:
    names = _docs(spark, folder).filter("file_name is not null").select(F.element_at(F.split("file_name", "/"), -1).alias("name")).distinct()
    target = F.concat(F.lit("corpus_"), C.slug(F.regexp_replace("name", r"[0-9]*\.txt$", "")), F.lit(".txt"))
    return names.filter(~F.col("name").rlike("^[A-Za-z]+$")).groupBy(target.alias("target")).agg(F.min("name").alias("name"), F.count("*").alias("n_claims"))


def table_markdown(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    cells = F.concat(F.array(F.array(F.lit("key"), F.lit("name"), F.lit("note"))), F.transform("r", lambda x: F.when(x["n_nationkey"] % 2 == 0, F.array(x["n_nationkey"].cast("string"), x["n_name"])).otherwise(F.array(x["n_nationkey"].cast("string"), F.lit(""), F.lit("odd")))))
    return rows.select("n_regionkey", C.pipe_table(cells).alias("md"))


def html_text(spark: SparkSession, folder: str) -> DataFrame:
    page = F.concat(F.lit("<html><head><style>p{}</style></head><body><nav>menu</nav><article><p>"), "text", F.lit("</p></article><footer>end</footer></body></html>"))
    return _docs(spark, folder).select("doc_id", main_text(page).alias("main"), body_text(F.concat(F.lit("<p>"), "text", F.lit("</p>"))).alias("body"))


def game_tags(spark: SparkSession, folder: str) -> DataFrame:
    tagged = F.concat(F.lit("{@atk mw,rw} {@hit "), (F.col("doc_id") % 12).cast("string"), F.lit("} {@scaledamage 1d6|2|3d6} {@creature "), F.coalesce("source", F.lit("")), F.lit("|mm} "), "text")
    return _docs(spark, folder).select("doc_id", resolve_tags(tagged).alias("plain"))


def record_formats(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    text = monster_text(
        F.col("p_name"),
        [("Type", F.col("p_type")), ("Size", F.col("p_size")), ("Brand", F.col("p_brand"))],
        [("HP", F.col("p_size") * 3), ("AC", F.col("p_size") % 20)],
        [("Senses", F.when(F.col("p_size") % 3 == 0, F.col("p_brand"))), ("Languages", F.when(F.col("p_size") % 2 == 0, "Common"))],
    )
    return p.select("p_partkey", text.alias("record"), spell_meta(F.col("p_size") % 10, F.col("p_brand")).alias("meta"))


def generic_records(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    record = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("item_type"), F.split("p_name", " ").alias("word_list"), F.lit("x").alias("document__url")))
    return p.select("p_partkey", generic_text(record).alias("record"))


QUERIES = [quality_report, quality_kept, clean_standard, clean_thorough, clean_nfkc, markdown_strip, wikitext_strip, qa_scaffold_strip, scanned_pages_clean, book_frame_strip, wiki_navigation_strip, url_names, tag_strings, source_weights, small_formats, rename_plan, table_markdown, html_text, game_tags, record_formats, generic_records]

_T = "coalesce(text, '')"
_U = f"regexp_replace({_T}, '\\r\\n?', chr(10), 'g')"
_STANDARD = f"regexp_replace(regexp_replace(s, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')"
_QUALITY = f"""
d AS (SELECT doc_id, source, {sql_strip(_T)} AS s FROM documents),
w AS (SELECT doc_id, source, s, {sql_tokens('s')} AS w, list_filter({sql_lines('s')}, lambda x: {sql_strip('x')} <> '') AS ln FROM d),
g AS (SELECT doc_id, max(c) AS top, sum(c) AS n FROM (
        SELECT doc_id, gram, count(*) AS c FROM (
          SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: lower(w[i]) || ' ' || lower(w[i + 1]) || ' ' || lower(w[i + 2]))) AS gram FROM w WHERE len(w) >= 3)
        GROUP BY ALL) GROUP BY doc_id),
q AS (SELECT w.doc_id, source, CAST(length(s) AS DOUBLE) AS char_count, CAST(len(w) AS DOUBLE) AS word_count,
   CASE WHEN length(regexp_replace(s, '[{WS}]', '', 'g')) > 0 THEN length(regexp_replace(s, '[^\\p{{L}}]', '', 'g')) / length(regexp_replace(s, '[{WS}]', '', 'g')) ELSE 0.0 END AS alpha_ratio,
   CASE WHEN length(s) > 0 THEN length(regexp_replace(s, '[\\p{{L}}\\p{{N}}.,;:!?''"()\\-–—/\\n\\t ]', '', 'g')) / length(s) ELSE 0.0 END AS symbol_ratio,
   CASE WHEN len(w) > 0 THEN length(array_to_string(w, '')) / len(w) ELSE 0.0 END AS mean_word_length,
   CASE WHEN len(ln) >= 5 THEN coalesce(list_sum(list_transform(list_filter(ln, lambda x: len({sql_tokens('x')}) < 3), lambda x: length(x))), 0) / list_sum(list_transform(ln, lambda x: length(x))) ELSE 0.0 END AS short_line_ratio,
   coalesce(top / n, 0.0) AS top_ngram_repetition_ratio FROM w LEFT JOIN g ON g.doc_id = w.doc_id),
v AS (SELECT *, CAST(char_count < 200 AS INT) + CAST(word_count < 40 AS INT) + CAST(char_count > 0 AND alpha_ratio < 0.6 AS INT) + CAST(symbol_ratio > 0.15 AS INT)
   + CAST(mean_word_length > 12 AS INT) + CAST(short_line_ratio > 0.6 AS INT) + CAST(top_ngram_repetition_ratio > 0.3 AS INT) AS n_reasons FROM q)
"""
_STATS = ", ".join(f"round({c}, 6) AS {c}" for c in quality.STATISTICS)
_BOOK = f"'Produced by volunteers' || chr(10) || '*** START OF THE PROJECT GUTENBERG EBOOK ' || doc_id || ' ***' || repeat(chr(10), 5) || {_U} || chr(10) || '*** END OF THE PROJECT GUTENBERG EBOOK ***' || chr(10) || 'Licence'"

SQL = {
    "quality_report": f"WITH {_QUALITY} SELECT doc_id, {_STATS}, CAST(n_reasons AS INT) AS n_reasons, n_reasons = 0 AS is_kept FROM v",
    "quality_kept": f"WITH {_QUALITY} SELECT doc_id, source FROM v WHERE n_reasons = 0",
    "clean_standard": f"WITH d AS (SELECT doc_id, {sql_strip(_T)} AS s FROM documents) SELECT doc_id, {sql_strip(_STANDARD)} AS clean FROM d",
    "clean_nfkc": f"WITH {sql_nfkc(f'(SELECT doc_id, {_T} AS t FROM documents)')}, d AS (SELECT doc_id, {sql_strip('t')} AS s FROM c) SELECT doc_id, {sql_strip(_STANDARD)} AS clean FROM d",
    "clean_thorough": f"""WITH d AS (SELECT doc_id, {sql_strip(_T)} AS s FROM documents), e AS (SELECT doc_id, {_STANDARD} AS s FROM d),
      l AS (SELECT doc_id, array_to_string(list_filter({sql_lines('s')}, lambda x: len({sql_tokens('x')}) >= 4 OR {sql_strip('x')} = ''), chr(10)) AS s FROM e),
      p AS (SELECT doc_id, string_split(s, chr(10) || chr(10)) AS p FROM l),
      k AS (SELECT doc_id, array_to_string(list_filter(p, lambda x, i: i = 1 OR {sql_strip('x')} <> {sql_strip('p[i - 1]')}), chr(10) || chr(10)) AS s FROM p)
      SELECT doc_id, {sql_strip("regexp_replace(s, '\\n{3,}', chr(10) || chr(10), 'g')")} AS clean FROM k""",
    "markdown_strip": f"SELECT doc_id, {sql_chain(_U, C.MARKDOWN)} AS plain FROM documents",
    "wikitext_strip": f"SELECT doc_id, {sql_strip(sql_chain(_U, C.WIKITEXT))} AS plain, {sql_strip(sql_chain(_U, C.WIKI_REMNANTS))} AS tidy FROM documents",
    "qa_scaffold_strip": f"WITH d AS (SELECT doc_id, {_U} AS t FROM documents), e AS (SELECT doc_id, t, {sql_strip(sql_chain('t', C.QA_SCAFFOLD))} || chr(10) AS plain FROM d) SELECT doc_id, plain, CAST(length(t) - length(plain) AS BIGINT) AS removed FROM e",
    "scanned_pages_clean": f"SELECT doc_id, {sql_strip(sql_chain(_U, C.SCANNED_PAGES))} AS plain FROM documents",
    "book_frame_strip": f"WITH d AS (SELECT doc_id, {_BOOK} AS t FROM documents) SELECT doc_id, {sql_strip(sql_chain('t', [(C.BOOK_START, ''), (C.BOOK_END, ''), (r'\n{4,}', chr(10) * 3)]))} AS plain FROM d",
    "wiki_navigation_strip": f"WITH d AS (SELECT doc_id, 'Previous: ' || coalesce(source, '') || chr(10) || {_U} || chr(10) || 'Next : page' AS t FROM documents) SELECT doc_id, {sql_chain('t', C.WIKI_NAVIGATION)} AS plain FROM d",
    "url_names": f"""WITH u AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all({_T}, '{URL}', 1)) AS url FROM documents),
      p AS (SELECT *, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g') AS path, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM u)
      SELECT doc_id, url, substr(regexp_replace(CASE WHEN path <> '' THEN replace(path, '/', '_') WHEN host <> '' THEN host ELSE 'page' END, '[^\\p{{L}}\\p{{N}}_\\-.]', '_', 'g'), 1, 128) AS file_stem,
      regexp_matches(lower(regexp_extract(url || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '' END, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '\\.(md|markdown)$') AS is_markdown FROM p""",
    "tag_strings": "SELECT doc_id, array_to_string(regexp_extract_all('<' || replace(coalesce(source, 'none'), '_', '><') || '>', '<([^>]+)>', 1), ' ') AS tags FROM documents",
    "source_weights": "SELECT doc_id, CAST(CASE WHEN starts_with(s, 'rules_') THEN 1.75 WHEN ends_with(s, '_qa') THEN 0.5 WHEN regexp_matches(s, '^home.rew_') THEN 1.25 WHEN regexp_matches(s, '^[mp]') THEN 0.75 ELSE 1.0 END AS DOUBLE) AS weight FROM (SELECT doc_id, coalesce(source, '') AS s FROM documents)",
    "small_formats": """WITH p AS (SELECT *, CASE WHEN p_size % 4 = 0 THEN p_size / 8.0 ELSE CAST(p_size AS DOUBLE) END AS r FROM part)
      SELECT p_partkey, p_partkey || CASE WHEN p_partkey % 100 BETWEEN 10 AND 20 THEN 'th' WHEN p_partkey % 10 = 1 THEN 'st' WHEN p_partkey % 10 = 2 THEN 'nd' WHEN p_partkey % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal,
      CASE WHEN r = 0.125 THEN '1/8' WHEN r = 0.25 THEN '1/4' WHEN r = 0.5 THEN '1/2' WHEN r = floor(r) THEN CAST(CAST(r AS BIGINT) AS VARCHAR) ELSE CAST(r AS VARCHAR) END AS rating,
      regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM p""",
    "rename_plan": """WITH n AS (SELECT DISTINCT string_split(file_name, '/')[-1] AS name FROM documents WHERE file_name IS NOT NULL)
      SELECT 'corpus_' || regexp_replace(regexp_replace(lower(regexp_replace(name, '[0-9]*\\.txt$', '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '.txt' AS target, min(name) AS name, count(*) AS n_claims
      FROM n WHERE NOT regexp_matches(name, '^[A-Za-z]+$') GROUP BY 1""",
    "table_markdown": """SELECT n_regionkey, '| key | name | note |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(CASE WHEN n_nationkey % 2 = 0 THEN '| ' || n_nationkey || ' | ' || n_name || ' |   |' ELSE '| ' || n_nationkey || ' |   | odd |' END, chr(10) ORDER BY n_nationkey) AS md FROM nation GROUP BY n_regionkey""",
    "record_formats": """SELECT p_partkey, '# ' || p_name || chr(10) || 'Type: ' || p_type || ' | Size: ' || p_size || ' | Brand: ' || p_brand || chr(10) || 'HP: ' || (p_size * 3) || ' | AC: ' || (p_size % 20)
      || CASE WHEN p_size % 3 = 0 THEN chr(10) || 'Senses: ' || p_brand ELSE '' END || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'Languages: Common' ELSE '' END AS record,
      'Category: spell' || chr(10) || 'Level: ' || CASE p_size % 10 WHEN 0 THEN 'Cantrip' WHEN 1 THEN '1st-level' WHEN 2 THEN '2nd-level' WHEN 3 THEN '3rd-level' ELSE (p_size % 10) || 'th-level' END || chr(10) || 'School: ' || p_brand AS meta FROM part""",
    "generic_records": """SELECT p_partkey, '# ' || p_name || chr(10) || 'Item type: ' || p_type || chr(10) || 'Word list: ' || replace(p_name, ' ', ', ') AS record FROM part""",
}
