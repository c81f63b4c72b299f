"""Record sources: JSON lines, question dumps, post archives, catalogues, feeds, and lists of what is there already."""

from __future__ import annotations

import fnmatch
import io
import json
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.cleaning import slug, tag_words
from tessella.functions.text_rules import strip

CHAT_SCHEMA = "user string, assistant string, context string, prompt string, response string, keywords array<string>, _corrupt_record string"


def read_chat_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(user, assistant, context, keywords, error): examples of JSON lines, aliases resolved; blank lines are skipped.

    Lines that aren't JSON, or lack a side, keep their place with `error` set.
    """
    raw = spark.read.schema(CHAT_SCHEMA).option("mode", "PERMISSIVE").json(path)
    user, assistant = F.coalesce(F.nullif("user", F.lit("")), "prompt"), F.coalesce(F.nullif("assistant", F.lit("")), "response")
    error = F.when(F.col("_corrupt_record").isNotNull(), "not JSON").when(F.coalesce(user, F.lit("")) == "", "no user").when(F.coalesce(assistant, F.lit("")) == "", "no assistant")
    return raw.select(user.alias("user"), assistant.alias("assistant"), "context", "keywords", error.alias("error"))


def read_qa_shards(spark: SparkSession, path: str | list[str], min_score: int) -> DataFrame:
    """(question_id, title, body, score, accepted_id, tags, answer) of Parquet shards, one row per answer.

    Only the needed columns are read, and the score filter reaches the scan.
    """
    cols = ["QId", "Title", "Body", "Score", "AcceptedAnswerId", "Tags", "Answers"]
    d = spark.read.parquet(*([path] if isinstance(path, str) else path)).select(*cols).filter(F.col("Score") >= min_score)
    return d.select(F.col("QId").alias("question_id"), F.col("Title").alias("title"), F.col("Body").alias("body"), F.col("Score").alias("score"), F.col("AcceptedAnswerId").alias("accepted_id"), F.col("Tags").alias("tags"), F.explode("Answers").alias("answer"))


POST_SCHEMA = "_Id string, _PostTypeId string, _ParentId string, _AcceptedAnswerId string, _Score int, _Title string, _Body string, _Tags string"


def read_post_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an XML archive of posts, one per post."""
    return spark.read.format("xml").option("rowTag", "row").schema(POST_SCHEMA).load(path)


def answered_questions(posts: DataFrame, min_score: int) -> DataFrame:
    """Questions of at least `min_score` with each of their answers; questions without one are left out."""
    q = posts.filter((F.col("_PostTypeId") == "1") & (F.coalesce("_Score", F.lit(0)) >= min_score)).select(F.col("_Id").alias("question_id"), F.col("_Title").alias("title"), F.col("_Body").alias("body"), F.col("_Score").alias("score"), F.col("_AcceptedAnswerId").alias("accepted_id"), tag_words(F.coalesce("_Tags", F.lit(""))).alias("tags"))
    a = posts.filter((F.col("_PostTypeId") == "2") & F.col("_ParentId").isNotNull()).select(F.col("_ParentId").alias("question_id"), F.col("_Id").alias("answer_id"), F.col("_Body").alias("answer"), F.coalesce("_Score", F.lit(0)).alias("answer_score"))
    return q.join(a, "question_id")


def contains_any(c: Column, words: list[str]) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    found = F.lit(False)
    for w in words:
        found = found | low.contains(w.lower())
    return found


def count_of(c: Column, words: list[str]) -> Column:
    """How many of the words a text contains."""
    low = F.lower(F.coalesce(c, F.lit("")))
    n = F.lit(0)
    for w in words:
        n = n + low.contains(w.lower()).cast("int")
    return n


def read_catalogue(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """English texts of a book catalogue (CSV) whose subjects or shelves hold any of the words."""
    d = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    shelf = F.concat_ws(" ", F.coalesce("Subjects", F.lit("")), F.coalesce("Bookshelves", F.lit("")))
    return d.filter((F.col("Type") == "Text") & (F.col("Language") == "en") & contains_any(shelf, words))


FEED_SCHEMA = "id string, title string, summary string, published string, author array<struct<name:string>>, category array<struct<_term:string>>"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, abstract, published, authors, categories) of an Atom feed, white space collapsed."""
    d = spark.read.format("xml").option("rowTag", "entry").schema(FEED_SCHEMA).load(path)
    flat = lambda c: strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return d.select(
        F.regexp_replace(F.element_at(F.split("id", "/abs/"), -1), "/", "_").alias("id"),
        flat(F.col("title")).alias("title"),
        flat(F.col("summary")).alias("abstract"),
        F.substring("published", 1, 10).alias("published"),
        F.coalesce(F.col("author.name"), F.array().cast("array<string>")).alias("authors"),
        F.coalesce(F.col("category._term"), F.array().cast("array<string>")).alias("categories"),
    )


def paper_text(papers: DataFrame) -> DataFrame:
    """(id, text): heading, authors (six at most by name), categories, date, source, abstract."""
    named = F.array_join(F.slice("authors", 1, 6), "; ")
    more = F.when(F.size("authors") > 6, F.concat(F.lit(" et al. ("), F.size("authors").cast("string"), F.lit(" authors)"))).otherwise("")
    text = F.concat(F.lit("# "), "title", F.lit("\nAuthors: "), named, more, F.lit("\nCategories: "), F.array_join("categories", ", "), F.lit("\nPublished: "), "published", F.lit("\nSource: arXiv ("), "id", F.lit(")\n\n"), "abstract", F.lit("\n"))
    return papers.select("id", text.alias("text"))


def new_texts(found: DataFrame, known: DataFrame, key: str, least: int = 500, header: Column | None = None) -> DataFrame:
    """Found texts of at least `least` characters whose key isn't known yet, with an optional header put before."""
    fresh = found.join(known.select(key).distinct(), key, "left_anti").filter(F.length("text") >= least)
    return fresh if header is None else fresh.withColumn("text", F.concat(header, F.lit("\n\n"), "text"))


def long_enough(texts: DataFrame, kind: str, least: dict[str, int]) -> DataFrame:
    """Texts that have the least number of characters of their kind; kinds that aren't named keep all."""
    bound = F.coalesce(*[F.when(F.col(kind) == k, n) for k, n in least.items()], F.lit(0))
    return texts.filter(F.length(F.coalesce("text", F.lit(""))) >= bound)


def open_items(files: DataFrame, restricted: str) -> DataFrame:
    """Files of items that aren't restricted; an item of which nothing is known counts as open."""
    return files.filter(~F.coalesce(F.col(restricted), F.lit(False)))


def preferred_file(files: DataFrame, key: str, name: str) -> DataFrame:
    """Of each item the scanned text file, or else any text file."""
    rank = F.when(F.col(name).endswith("_djvu.txt"), 0).when(F.col(name).endswith(".txt"), 1)
    order = Window.partitionBy(key).orderBy(rank, name)
    return files.filter(rank.isNotNull()).withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def sections(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, section_no, slug, content): the parts of markdown texts that open with a first-level heading of either kind.

    Text before the first heading is no section.
    """
    text = F.regexp_replace(F.col("text"), "\r\n", "\n")
    # a mark before every heading, then a split at the marks: no lines are shuffled or numbered
    marked = F.regexp_replace(text, r"(?m)^(?=# .+$|.+\n=+[ \t]*$)", "\u0001")
    parts = F.slice(F.split(marked, "\u0001"), 2, 1 << 20)
    d = docs.select(key, F.posexplode(parts).alias("section_no", "content"))
    heading = F.regexp_replace(strip(F.element_at(F.split("content", "\n"), 1)), "^[# ]+", "")
    return d.select(key, "section_no", slug(heading).alias("slug"), "content")


def wiki_sections(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, title, content): wikitext sections of any level; the lead gets a name of its own; empty ones are left out.

    A title that occurs twice in a text keeps its last section.
    """
    from tessella.functions.cleaning import strip_wikitext

    marked = F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), r"(?m)^(?=={1,6}[^=\n].*?={1,6}[ \t]*$)", "\u0001")
    d = docs.select(key, F.posexplode(F.split(marked, "\u0001")).alias("n", "part"))
    title = F.when(F.col("part").rlike("^={1,6}[^=]"), strip(F.regexp_replace(F.element_at(F.split("part", "\n"), 1), "^=+|=+[ \t]*$", ""))).otherwise("Lead_Introduction")
    body = strip_wikitext(F.when(F.col("part").rlike("^={1,6}[^=]"), F.regexp_replace("part", r"^[^\n]*\n?", "")).otherwise(F.col("part")))
    made = d.select(key, "n", title.alias("title"), body.alias("content")).filter("content <> ''")
    return made.groupBy(key, "title").agg(F.max_by("content", "n").alias("content"))


def kept_sections(parts: DataFrame, openings: list[str]) -> DataFrame:
    """Sections whose slug, read as words, opens with any of the given texts."""
    words = F.replace("slug", F.lit("_"), F.lit(" "))
    keep = F.lit(False)
    for o in openings:
        keep = keep | words.startswith(o)
    return parts.filter(keep)


def read_zipped_json(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(archive, member, entry): the entries of JSON members of zip archives whose name fits the glob, as JSON texts.

    A member is a list of entries, or an object whose lists hold them.  Broken archives and members give no entries.
    """

    @F.pandas_udf("array<struct<member:string,entry:string>>")
    def entries(contents: pd.Series) -> pd.Series:
        out = []
        for data in contents:
            rows = []
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for name in sorted(z.namelist()):
                        if fnmatch.fnmatchcase(name, pattern):
                            try:
                                held = json.loads(z.read(name))
                            except ValueError:
                                continue
                            lists = [held] if isinstance(held, list) else [v for v in held.values() if isinstance(v, list)] if isinstance(held, dict) else []
                            rows += [{"member": name, "entry": json.dumps(e, ensure_ascii=False)} for many in lists for e in many]
            except zipfile.BadZipFile:
                pass
            out.append(rows)
        return pd.Series(out)

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), F.explode(entries("content")).alias("e")).select("archive", "e.member", "e.entry")
