"""Queries that write tables in a foreign form, read them back with the sources, and run streams over them.

What is written lies in the shared folder.  Every statement says what must come back from the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.cleaning import Cleaning
from tessella.functions.text_rules import upper
from tessella.operators import graphs, guards, lexical, manifests, prompts, quality, retrieval
from tessella.queries.base import r6, sql_nfkc, sql_strip, table
from tessella.queries.corpora import SQL as INDEX_SQL
from tessella.queries.texts import _QUALITY
from tessella.runtime import scratch
from tessella.sources import files, records, sinks
from tessella.streaming import conversations

TEXTS = "coalesce(text, '')"


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").withColumn("text", F.coalesce("text", F.lit("")))


def _as_files(spark: SparkSession, folder: str) -> str:
    """A file for every document, in one new folder."""
    path = scratch(spark, "text-files")
    sinks.write_text_files(_docs(spark, folder), "doc_id", "text", path)
    return path


def _id() -> Column:
    return F.regexp_extract("path", r"doc_id=(-?\d+)", 1).try_cast("long").alias("doc_id")


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    got = files.read_texts(spark, [_as_files(spark, folder)])
    return got.select(_id(), "text", F.col("doc_idx").cast("long").alias("doc_idx"))


def ingested_files(spark: SparkSession, folder: str) -> DataFrame:
    """All files read, told by their endings, cleaned and written to another folder; what is there in the end."""
    target = scratch(spark, "ingested")
    files.ingest(spark, _as_files(spark, folder), target, recursive=True, level=Cleaning.MINIMAL)
    return spark.read.parquet(target).select(_id(), F.col("ending"), F.length("text").cast("long").alias("n_chars"), F.col("error").isNull().alias("is_read"))


def chat_lines(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "chat-lines")
    d = table(spark, folder, "finetune_examples").select(F.col("user_text").alias("user"), "assistant", "context", "prompt", "response")
    sinks.write_jsonl(d, path)
    got = records.read_chat_jsonl(spark, path)
    return got.groupBy("user", "assistant", "context", "error").agg(F.count("*").alias("n"))


def qa_shards(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "qa-shards")
    q = table(spark, folder, "qa_pairs").filter("pair_id is not null")
    shards = q.select(
        F.col("pair_id").alias("QId"), F.col("question").alias("Title"), F.lit("body").alias("Body"), F.coalesce("answer_score", F.lit(0)).alias("Score"), F.col("question_id").alias("AcceptedAnswerId"), F.array(F.col("site")).alias("Tags"),
        F.array(F.struct(F.col("answer").alias("Body")), F.struct(upper(F.col("answer")).alias("Body"))).alias("Answers"), F.lit("unread").alias("Other"),
    )
    shards.write.parquet(path)
    got = records.read_qa_shards(spark, path, 5)
    return got.select("question_id", "title", "score", "accepted_id", F.col("answer.Body").alias("answer")).distinct()


def post_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Questions and answers as posts of an XML archive, joined again."""
    path = scratch(spark, "posts")
    once = table(spark, folder, "qa_pairs").filter("pair_id is not null and question_id is not null")
    asked = once.groupBy("question_id").agg(F.max("answer_score").alias("s"), F.min("pair_id").alias("first")).select(F.concat(F.lit("q"), "question_id").alias("_Id"), F.lit("1").alias("_PostTypeId"), F.lit(None).cast("string").alias("_ParentId"), F.concat(F.lit("a"), "first").alias("_AcceptedAnswerId"), F.col("s").alias("_Score"), F.concat(F.lit("T & <b> "), "question_id").alias("_Title"), F.lit("<one><two-x>").alias("_Tags"))
    replies = once.groupBy("pair_id").agg(F.min("question_id").alias("q"), F.min("answer_score").alias("s")).select(F.concat(F.lit("a"), "pair_id").alias("_Id"), F.lit("2").alias("_PostTypeId"), F.concat(F.lit("q"), "q").alias("_ParentId"), F.lit(None).cast("string").alias("_AcceptedAnswerId"), F.col("s").alias("_Score"), F.lit(None).cast("string").alias("_Title"), F.lit(None).cast("string").alias("_Tags"))
    asked.unionByName(replies).write.format("xml").option("rootTag", "posts").option("rowTag", "row").save(path)
    got = records.answered_questions(records.read_post_archive(spark, path), 3)
    return got.select("question_id", "title", "score", "accepted_id", "tags", "answer_id", "answer_score")


KEYWORDS = ["Brass", "steel", "PROMO"]


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "catalogue")
    p = table(spark, folder, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "Sound").otherwise("Text")
    p.select(F.col("p_partkey").alias("Text#"), kind.alias("Type"), F.concat(F.lit('A "book", '), F.col("p_name")).alias("Title"), F.when(F.col("p_size") % 5 == 0, "fr").otherwise("en").alias("Language"), F.col("p_type").alias("Subjects"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("Bookshelves")).write.option("header", "true").option("escape", '"').csv(path)
    return records.read_catalogue(spark, path, KEYWORDS).select(F.col("Text#").cast("int").alias("number"), F.col("Title").alias("title"))


def papers(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "feed")
    s = table(spark, folder, "supplier")
    names = F.transform(F.sequence(F.lit(1), F.col("s_suppkey") % 9 + 1), lambda i: F.struct(F.concat(F.lit("Author "), i.cast("string")).alias("name")))
    kinds = F.array(F.struct(F.lit("cs.DB").alias("_term")), F.struct(F.concat(F.lit("x."), F.col("s_nationkey")).alias("_term")))
    s.select(F.concat(F.lit("http://papers.example/abs/cs/"), "s_suppkey").alias("id"), F.concat(F.lit("On \n  the "), "s_name").alias("title"), F.concat(F.lit("  We  study "), F.col("s_nationkey"), F.lit(" \n things. ")).alias("summary"), F.lit("2020-02-03T04:05:06Z").alias("published"), names.alias("author"), kinds.alias("category")).write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(path)
    return records.paper_text(records.read_feed(spark, path))


def fresh_texts(spark: SparkSession, folder: str) -> DataFrame:
    header = F.concat(F.lit("Source: "), F.coalesce("source", F.lit("none")))
    got = records.new_texts(_docs(spark, folder), table(spark, folder, "quality_reports").select("doc_id"), "doc_id", 300, header)
    return got.select("doc_id", "text")


#: Least lengths by kind of source (fixed values); a text of any other is kept.
LEAST_CHARS = {"crawl": 200, "wiki": 100}


def source_minimums(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "crawl").when(F.col("doc_id") % 3 == 1, "wiki")
    return records.long_enough(_docs(spark, folder).withColumn("kind", kind), "kind", LEAST_CHARS).select("doc_id")


def preferred_files(spark: SparkSession, folder: str) -> DataFrame:
    """Of each item its scanned text, or any text; items that may not be lent out are skipped."""
    p = table(spark, folder, "part")
    name = F.concat(F.col("p_name"), F.when(F.col("p_size") % 4 == 0, "_djvu.txt").when(F.col("p_size") % 4 == 1, ".txt").when(F.col("p_size") % 4 == 2, ".pdf").otherwise("_meta.xml"))
    d = p.select((F.col("p_partkey") % 500).alias("item"), name.alias("file"), (F.col("p_partkey") % 500 % 7 == 0).alias("is_restricted"))
    return records.preferred_file(records.open_items(d, "is_restricted"), "item", "file").select("item", "file")


def relevance_gate(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).filter(records.count_of(F.col("text"), ["dice", "Spell", "tower", "armor", "level", "guard", "harbor"]) >= 2).select("doc_id")


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    flat = F.regexp_replace(F.regexp_replace("text", r"[\r\n]+", " "), r"[#=\[\]{}|'<>&*]", "")
    return _docs(spark, folder).select("doc_id", flat.alias("t"))


def srd_sections(spark: SparkSession, folder: str) -> DataFrame:
    d = _marked(spark, folder).select("doc_id", F.concat(F.lit("lead\n# Magic Items\n"), "t", F.lit("\nMonster List\n============\nx"), "t", F.lit("\n# Legal\nno")).alias("text"))
    return records.kept_sections(records.sections(d), ["magic", "monster"]).select("doc_id", "slug", F.length("content").cast("long").alias("n_chars"))


def wiki_parts(spark: SparkSession, folder: str) -> DataFrame:
    d = _marked(spark, folder).select("doc_id", F.concat(F.lit("Lead here.\n== Lore ==\nword"), "doc_id", F.lit("\n=== Deep Lore ===\nmore\n== Lore ==\nlast"), "doc_id", F.lit("\n== Empty ==\n")).alias("text"))
    return records.wiki_sections(d)


def dropped_audit(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "dropped")
    sinks.write_dropped(quality.quality_reports(table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))), path)
    return spark.read.json(path).select("doc_id", F.size("reasons").alias("n_reasons"))


def chunk_files(spark: SparkSession, folder: str) -> DataFrame:
    """Texts in files of 40 each, read back by name."""
    path = scratch(spark, "chunks")
    sinks.write_chunks(_docs(spark, folder).select("doc_id", F.regexp_replace("text", r"[\r\n]+", " ").alias("text")), "text", 40, "doc_id", path, "corpus")
    lines = spark.read.text(path, wholetext=True)
    return lines.select(F.col("name").alias("file_name"), F.length("value").cast("long").alias("n_chars"), F.md5("value").alias("hash"))


def saved_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index, the hashes of its sources and its facts, as they come back; and what has changed since."""
    path = scratch(spark, "index")
    docs = _docs(spark, folder)
    index = lexical.build_index(docs.select("doc_id", "text", "source"), stemmed=False)
    manifest = manifests.table_manifest(docs, "source", "text", "doc_id")
    sinks.save_index(index, manifest, path, n=4, stemmed=False)
    held, sources, facts = sinks.load_index(spark, path)
    later = docs.withColumn("text", F.when(F.col("source").startswith("rules"), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    states = manifests.compare(sources, manifests.table_manifest(later, "source", "text", "doc_id")).groupBy("status").agg(F.count("*").alias("n"))
    size = held.agg(F.lit("entries").alias("status"), F.count("*").alias("n"))
    return states.unionByName(size).unionByName(spark.createDataFrame([("n-gram", int(facts["n"]))], "status string, n long"))


def ngram_points(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of given n-grams, by equality."""
    index = table(spark, folder, "ngram_index").select("entry_id", "ngram", "frequency").distinct()
    asked = index.filter(F.col("entry_id") % 50 == 0).select("ngram").distinct()
    return lexical.lookup(index, asked).select("entry_id", F.array_join("ngram", " ").alias("ngram"), "frequency")


def token_table(spark: SparkSession, folder: str) -> DataFrame:
    """Token rows with weights, written and read with the check that they have as many weights as tokens."""
    path = scratch(spark, "tokens")
    d = _docs(spark, folder).select("doc_id", F.transform(F.filter(F.split(F.regexp_replace("text", r"[^A-Za-z]+", " "), " "), lambda w: w != ""), lambda w: F.length(w)).alias("ids"))
    sinks.write_tokens(d.withColumn("weights", F.transform("ids", lambda x: F.when(x > 3, F.lit(1.5)).otherwise(F.lit(0.5)))), path)
    got = sinks.read_tokens(spark, path)
    return got.select("doc_id", F.size("ids").alias("n_tokens"), r6(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)).alias("weight"))


def report_file(spark: SparkSession, folder: str) -> DataFrame:
    """A report with a summary, and its change against an earlier one."""
    docs, pairs = _docs(spark, folder), table(spark, folder, "qa_pairs")
    path = scratch(spark, "report")
    earlier = {"texts": {"n": 100, "longest": 1}}
    sinks.write_report({"texts": docs.agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest")), "pairs": pairs.agg(F.count("*").alias("n"), F.max("answer_score").alias("best"))}, path, earlier=earlier)
    return spark.read.schema("part string, name string, value double, delta double").json(f"{path}/values")


def listed_once(spark: SparkSession, folder: str) -> DataFrame:
    """File names in the order in which each was first met."""
    d = table(spark, folder, "documents").filter("file_name is not null").select("file_name", "doc_id")
    return graphs.first_seen(d, "file_name", "doc_id").select("file_name", F.col("doc_id").alias("first_at"))


def _words(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z]+", " "), " "), lambda w: w != ""), lambda w: F.length(w))


def single_prompts(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "qa_pairs").select("pair_id", _words(F.col("question")).alias("q"), _words(F.col("answer")).alias("a")).distinct()
    return d.select("pair_id", F.array_join(prompts.single_prompt(F.col("q"), F.col("a"), 48), " ").alias("ids"))


def open_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The field that a record is being written into."""
    p = table(spark, folder, "part")
    text = F.concat(F.col("p_name"), F.lit("\nArmor Class: 12\nChallenge Rating: "), F.when(F.col("p_size") % 2 == 0, (F.col("p_size") % 9 + 1).cast("string")).otherwise(F.lit("")))
    f = guards.active_field(text)
    return p.select("p_partkey", F.col("p_size"), f.alias("f")).select("p_partkey", F.col("f.value").alias("value"))


def neighbour_texts(spark: SparkSession, folder: str) -> DataFrame:
    """For every window the two best ranked passages that aren't part of it."""
    e = table(spark, folder, "ngram_index").filter("excerpt is not null").groupBy("entry_id").agg(F.min("excerpt").alias("passage"))
    results = e.select(F.floor(F.col("entry_id") / 6).cast("long").alias("query_id"), (F.col("entry_id") % 6 + 1).cast("int").alias("rank"), F.col("entry_id").alias("id"))
    windows = e.filter(F.col("entry_id") % 6 == 0).select(F.floor(F.col("entry_id") / 6).cast("long").alias("query_id"), F.concat(F.lit("so "), "passage", F.lit(" on")).alias("text"))
    return retrieval.neighbours(results, windows, e.select(F.col("entry_id").alias("id"), "passage"), 2).select("query_id", F.col("slot").cast("long").alias("slot"), "id")


def wide_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    """Search widened to twenty before reranking, a second try three times as wide, and the cut to three."""
    q = table(spark, folder, "qa_pairs").filter("question_id is not null").groupBy("pair_id").agg(F.min("question_id").alias("query_id"), F.min(F.coalesce("answer_score", F.lit(0))).alias("s"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("pair_id"))
    found = q.select("query_id", F.col("pair_id").alias("id"), (F.lit(1.0) / (F.lit(1.0) + rank)).alias("score"), rank.alias("rank"), "s")
    got = retrieval.search(found, 3, new_score=F.least(F.greatest(F.col("s") / 20.0, F.lit(0.0)), F.lit(1.0)))
    return got.select("query_id", "id", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"), "tier")


def streamed_history(spark: SparkSession, folder: str) -> DataFrame:
    """The capped history of every conversation after a stream of its turns."""
    path, target = scratch(spark, "turns"), scratch(spark, "histories")
    q = table(spark, folder, "qa_pairs").filter("pair_id is not null").groupBy("pair_id").agg(F.min("question_id").alias("conv_id")).filter("conv_id is not null")
    turns = q.select("conv_id", F.col("pair_id").alias("turn"), F.concat(F.lit("u"), "pair_id").alias("user"), F.concat(F.lit("a"), "pair_id").alias("assistant"))
    turns.repartition(3).write.parquet(path)
    stream = conversations.rolling_history(spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(path), most=4)
    conversations.run_to_end(stream, target, "update")
    last = spark.read.parquet(target).groupBy("conv_id").agg(F.max_by("history", "_batch").alias("history"), F.max_by("n_turns", "_batch").alias("n_turns"))
    return last.select("conv_id", "n_turns", F.replace("history", F.lit("\t"), F.lit(" ")).alias("history"))


def refreshed_table(spark: SparkSession, folder: str) -> DataFrame:
    """A table kept up with the new files of a folder; each file counts once, over two runs."""
    path, target, state = scratch(spark, "incoming"), scratch(spark, "kept-up"), scratch(spark, "state")
    o = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    for part in (0, 1):
        o.filter(F.col("o_orderkey") % 2 == part).repartition(2).write.mode("append").parquet(path)
        conversations.refresh_stream(spark, path, o.schema.simpleString()[7:-1].replace(":", " "), lambda b: b.filter("o_totalprice > 1000"), target, state).awaitTermination()
    return spark.read.parquet(target)


QUERIES = [text_files, ingested_files, chat_lines, qa_shards, post_archive, catalogue, papers, fresh_texts, source_minimums, preferred_files, relevance_gate, srd_sections, wiki_parts, dropped_audit, chunk_files, saved_index, ngram_points, token_table, report_file, listed_once, single_prompts, open_fields, neighbour_texts, wide_retrieval, streamed_history, refreshed_table]

_LETTERS = lambda x: f"list_transform(list_filter(string_split(regexp_replace(coalesce({x}, ''), '[^A-Za-z]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: length(w))"
_FILES = f"(SELECT doc_id, {TEXTS} || chr(10) AS t FROM documents)"
_FLAT = "regexp_replace(regexp_replace(coalesce(text, ''), '[\\r\\n]+', ' ', 'g'), '[#=\\[\\]{}|''<>&*]', '', 'g')"

SQL = {
    "text_files": f"SELECT doc_id, {TEXTS} || chr(10) AS text, row_number() OVER (ORDER BY 'doc_id=' || doc_id || '/') - 1 AS doc_idx FROM documents",
    "ingested_files": f"WITH {sql_nfkc(_FILES)}, d AS (SELECT doc_id, {sql_strip('t')} AS t FROM c) SELECT doc_id, 'txt' AS ending, length(t) AS n_chars, true AS is_read FROM d",
    "chat_lines": """WITH e AS (SELECT coalesce(nullif(user_text, ''), prompt) AS u, coalesce(nullif(assistant, ''), response) AS a, context FROM finetune_examples)
      SELECT u AS "user", a AS assistant, context, CASE WHEN coalesce(u, '') = '' THEN 'no user' WHEN coalesce(a, '') = '' THEN 'no assistant' END AS error, count(*) AS n FROM e GROUP BY ALL""",
    "qa_shards": """WITH q AS (SELECT pair_id AS question_id, question AS title, answer_score AS score, question_id AS accepted_id, answer FROM qa_pairs WHERE pair_id IS NOT NULL AND answer_score >= 5)
      SELECT * FROM q UNION SELECT question_id, title, score, accepted_id, upper(answer) FROM q""",
    "post_archive": """WITH o AS (SELECT * FROM qa_pairs WHERE pair_id IS NOT NULL AND question_id IS NOT NULL), q AS (SELECT question_id, max(answer_score) AS s, min(pair_id) AS f FROM o GROUP BY 1), a AS (SELECT pair_id, min(question_id) AS question_id, min(answer_score) AS s FROM o GROUP BY 1)
      SELECT 'q' || question_id AS question_id, 'T & <b> ' || question_id AS title, q.s AS score, 'a' || f AS accepted_id, 'one two-x' AS tags, 'a' || pair_id AS answer_id, coalesce(a.s, 0) AS answer_score FROM q JOIN a USING (question_id) WHERE coalesce(q.s, 0) >= 3""",
    "catalogue": "SELECT CAST(p_partkey AS INT) AS number, 'A \"book\", ' || p_name AS title FROM part WHERE p_size % 3 <> 0 AND p_size % 5 <> 0 AND regexp_matches(lower(p_type || ' ' || CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END), 'brass|steel|promo')",
    "papers": """SELECT 'cs_' || s_suppkey AS id, '# On the ' || s_name || chr(10) || 'Authors: ' || array_to_string(list_transform(range(1, least(s_suppkey % 9 + 1, 6) + 1), lambda i: 'Author ' || i), '; ') || CASE WHEN s_suppkey % 9 + 1 > 6 THEN ' et al. (' || (s_suppkey % 9 + 1) || ' authors)' ELSE '' END
      || chr(10) || 'Categories: cs.DB, x.' || s_nationkey || chr(10) || 'Published: 2020-02-03' || chr(10) || 'Source: arXiv (cs_' || s_suppkey || ')' || chr(10) || chr(10) || 'We study ' || s_nationkey || ' things.' || chr(10) AS text FROM supplier""",
    "fresh_texts": f"SELECT doc_id, 'Source: ' || coalesce(source, 'none') || chr(10) || chr(10) || {TEXTS} AS text FROM documents d WHERE length({TEXTS}) >= 300 AND NOT EXISTS (SELECT 1 FROM quality_reports q WHERE q.doc_id = d.doc_id)",
    "source_minimums": f"SELECT doc_id FROM documents WHERE length({TEXTS}) >= CASE doc_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 100 ELSE 0 END",
    "preferred_files": """WITH f AS (SELECT p_partkey % 500 AS item, p_name || CASE p_size % 4 WHEN 0 THEN '_djvu.txt' WHEN 1 THEN '.txt' WHEN 2 THEN '.pdf' ELSE '_meta.xml' END AS file FROM part WHERE p_partkey % 500 % 7 <> 0)
      SELECT item, arg_min(file, (CASE WHEN file LIKE '%\\_djvu.txt' ESCAPE '\\' THEN 0 ELSE 1 END, file)) AS file FROM f WHERE file LIKE '%.txt' GROUP BY item""",
    "relevance_gate": "SELECT doc_id FROM documents WHERE " + " + ".join(f"CAST(contains(lower(coalesce(text, '')), '{w}') AS INT)" for w in ("dice", "spell", "tower", "armor", "level", "guard", "harbor")) + " >= 2",
    "srd_sections": f"WITH d AS (SELECT doc_id, {_FLAT} AS t FROM documents) SELECT doc_id, 'magic_items' AS slug, length('# Magic Items' || chr(10) || t || chr(10)) AS n_chars FROM d UNION ALL SELECT doc_id, 'monster_list', length('Monster List' || chr(10) || '============' || chr(10) || 'x' || t || chr(10)) FROM d",
    "wiki_parts": "SELECT doc_id, unnest(['Lead_Introduction', 'Lore', 'Deep Lore']) AS title, unnest(['Lead here.', 'last' || doc_id, 'more']) AS content FROM documents",
    "dropped_audit": f"WITH {_QUALITY} SELECT doc_id, CAST(n_reasons AS INT) AS n_reasons FROM v WHERE n_reasons > 0",
    "chunk_files": """WITH d AS (SELECT regexp_replace(coalesce(text, ''), '[\\r\\n]+', ' ', 'g') AS t, doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 40 AS k FROM documents), f AS (SELECT k, string_agg(t, chr(10) || chr(10) ORDER BY doc_id) || chr(10) AS v FROM d GROUP BY k)
      SELECT 'corpus_' || lpad(CAST(k AS VARCHAR), 4, '0') AS file_name, length(v) AS n_chars, md5(v) AS hash FROM f""",
    "saved_index": f"""WITH h AS (SELECT source, arg_max({TEXTS}, doc_id) AS t FROM documents WHERE source IS NOT NULL GROUP BY 1)
      SELECT CASE WHEN source LIKE 'rules%' THEN 'changed' ELSE 'same' END AS status, count(*) AS n FROM h GROUP BY 1 UNION ALL SELECT 'entries', count(*) FROM ({INDEX_SQL["ngram_table"]}) UNION ALL SELECT 'n-gram', 4""",
    "ngram_points": """WITH e AS (SELECT DISTINCT entry_id, ngram, frequency FROM ngram_index) SELECT entry_id, array_to_string(ngram, ' ') AS ngram, frequency FROM e WHERE ngram IN (SELECT ngram FROM e WHERE entry_id % 50 = 0)""",
    "token_table": f"WITH d AS (SELECT doc_id, {_LETTERS('text')} AS i FROM documents) SELECT doc_id, CAST(len(i) AS INT) AS n_tokens, round(coalesce(list_sum(list_transform(i, lambda x: CASE WHEN x > 3 THEN 1.5 ELSE 0.5 END)), 0), 6)::DOUBLE AS weight FROM d",
    "report_file": f"""WITH v AS (SELECT 'texts' AS part, 'n' AS name, CAST(count(*) AS DOUBLE) AS value, CAST(count(*) - 100 AS DOUBLE) AS delta FROM documents UNION ALL SELECT 'texts', 'longest', max(length({TEXTS})), max(length({TEXTS})) - 1 FROM documents
      UNION ALL SELECT 'pairs', 'n', count(*), NULL FROM qa_pairs UNION ALL SELECT 'pairs', 'best', max(answer_score), NULL FROM qa_pairs) SELECT part, name, CAST(value AS DOUBLE) AS value, CAST(delta AS DOUBLE) AS delta FROM v""",
    "listed_once": "SELECT file_name, min(doc_id) AS first_at FROM documents WHERE file_name IS NOT NULL GROUP BY file_name",
    "single_prompts": f"""WITH d AS (SELECT DISTINCT pair_id, {_LETTERS('question')} AS q, {_LETTERS('answer')} AS a FROM qa_pairs), c AS (SELECT *, a[1:greatest(48 - len(q) - 5, 0)] AS c FROM d)
      SELECT pair_id, array_to_string(CASE WHEN len(c) > 0 THEN [1, 3] || c || [3, 4] || q || [5] ELSE [1, 4] || q || [5] END, ' ') AS ids FROM c""",
    "open_fields": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size % 9 + 1 AS VARCHAR) ELSE '' END AS value FROM part",
    "neighbour_texts": """WITH e AS (SELECT entry_id, min(excerpt) AS p FROM ngram_index WHERE excerpt IS NOT NULL GROUP BY 1), w AS (SELECT entry_id // 6 AS query_id, 'so ' || p || ' on' AS t FROM e WHERE entry_id % 6 = 0),
      k AS (SELECT query_id, entry_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY entry_id % 6) AS slot FROM e JOIN w ON w.query_id = entry_id // 6 WHERE NOT contains(t, p)) SELECT query_id, slot, id FROM k WHERE slot <= 2""",
    "wide_retrieval": """WITH q AS (SELECT pair_id AS id, min(question_id) AS query_id, min(coalesce(answer_score, 0)) AS s FROM qa_pairs WHERE question_id IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank, least(greatest(s / 20.0, 0.0), 1.0) AS score FROM q),
      n AS (SELECT *, 1 AS try, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS nr FROM r WHERE rank <= 20), w AS (SELECT *, 2 AS try, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS nr FROM r WHERE rank <= 60),
      b AS (SELECT * FROM n UNION ALL SELECT * FROM w), t AS (SELECT *, CASE WHEN score >= 0.7 THEN 'correct' WHEN score >= 0.3 THEN 'ambiguous' ELSE 'incorrect' END AS tier FROM b),
      c AS (SELECT query_id, CASE WHEN max(score) FILTER (try = 1) < 0.7 AND max(score) FILTER (try = 2) >= 0.7 THEN 2 ELSE 1 END AS try FROM t GROUP BY 1),
      k AS (SELECT t.query_id, id, row_number() OVER (PARTITION BY t.query_id ORDER BY CASE tier WHEN 'correct' THEN 0 ELSE 1 END, nr) AS rank, score, tier FROM t JOIN c ON c.query_id = t.query_id AND c.try = t.try WHERE tier <> 'incorrect')
      SELECT query_id, id, rank, round(CAST(score AS DOUBLE), 6) AS score, tier FROM k WHERE rank <= 3""",
    "streamed_history": """WITH t AS (SELECT pair_id, min(question_id) AS conv_id FROM qa_pairs WHERE pair_id IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pair_id DESC) AS k FROM t WHERE conv_id IS NOT NULL)
      SELECT conv_id, CAST(count(*) AS INT) AS n_turns, string_agg('u' || pair_id || ' a' || pair_id, chr(10) ORDER BY pair_id) AS history FROM r WHERE k <= 4 GROUP BY 1""",
    "refreshed_table": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000",
}
