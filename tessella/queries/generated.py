"""Queries of generated examples, agents, splits and forms of records, each with a statement of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.cleaning import challenge_rating
from tessella.functions.game_text import render_blocks, resolve_tags
from tessella.functions.html_text import main_text
from tessella.operators import agents, answers, bpe, synthesis, training
from tessella.queries.base import table
from tessella.queries.learning import _sized
from tessella.runtime import materialize, scratch
from tessella.streaming import conversations


def monster_questions(spark: SparkSession, folder: str) -> DataFrame:
    p, c = table(spark, folder, "part"), F.col
    even = lambda k, x: F.when(c("p_size") % k == 0, x)
    r = {
        "name": c("p_name"), "rating": even(2, challenge_rating(c("p_size").cast("double"))), "xp": c("p_size") * 450 - 900, "hp": c("p_size") * 3, "dice": even(3, F.concat(c("p_size").cast("string"), F.lit("d8"))),
        "ac": even(4, c("p_size")), "armor": even(8, F.lit("hide")), "size": F.lit("Large"), "kind": c("p_type"), "alignment": even(5, F.lit("neutral")), "speed": even(7, F.lit("30 ft.")),
    }
    return answers.template_examples(p, synthesis.monster_templates(r)).groupBy("user_text", "assistant").agg(F.count("*").alias("n"))


def spell_questions(spark: SparkSession, folder: str) -> DataFrame:
    p, c = table(spark, folder, "part"), F.col
    even = lambda k, x: F.when(c("p_size") % k == 0, x)
    r = {
        "name": c("p_name"), "level": c("p_size") % 10, "school": even(2, c("p_brand")), "time": F.lit("1 action"), "range": even(3, F.lit("60 feet")), "duration": even(5, F.lit("1 minute")), "concentration": c("p_size") % 4 == 0,
        "text": F.concat(c("p_type"), F.lit(" glows. It fades..")),
    }
    return answers.template_examples(p, synthesis.spell_templates(r)).groupBy("user_text", "assistant").agg(F.count("*").alias("n"))


def capped_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """At most five passages of each category."""
    s, n = table(spark, folder, "supplier"), table(spark, folder, "nation")
    made = s.join(n, s.s_nationkey == n.n_nationkey).select("n_regionkey", "s_suppkey", F.concat("s_name", F.lit(" trades in "), "n_name", F.lit(".")).alias("passage"))
    return synthesis.capped(made, "n_regionkey", 5, "s_suppkey", seed=2)


#: A registry with sound and broken entries.
REGISTRY = """{"lore": {"display_name": "Lore", "checkpoint": "a.pt", "vocab": "v.json", "corpus_dirs": ["x", "y"], "crag": true, "corrective_retry": true},
 "bare": {"display_name": "Bare", "checkpoint": "b.pt", "vocab": "v.json"}, "lost": {"display_name": "Lost", "vocab": "v.json"}, "odd": {"display_name": "Odd", "checkpoint": "c.pt", "vocab": "v.json", "corrective_retry": true}, "none": 3}"""


def agent_registry(spark: SparkSession, folder: str) -> DataFrame:
    got = agents.registry_table(spark, REGISTRY)
    return got.select("place", "agent", "display_name", F.array_join("corpus_dirs", ",").alias("dirs"), "crag", "corrective_retry", "error")


def chosen_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The split by a table of its own, by blocks, and none."""
    d = _sized(spark, folder).select("doc_id", "weight", "n_tokens")
    apart = training.choose_split(d.filter("doc_id % 7 <> 0"), 256, 0.1, held=d.filter("doc_id % 7 = 0"))
    none = training.choose_split(d, 256, 0.0)
    return apart.withColumn("way", F.lit("table")).unionByName(none.withColumn("way", F.lit("none"))).select("way", "doc_id", "is_val")


def tag_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Tags before and behind the whole text; the text itself has its braces taken out."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[{}]", "")
    tagged = F.concat(F.lit("{@atk mw,rw} {@hit "), (F.col("doc_id") % 12).cast("string"), F.lit("} "), text, F.lit(" {@scaledamage 1d6|2|3d6} {@creature Owl|mm}"))
    return table(spark, folder, "documents").select("doc_id", resolve_tags(tagged).alias("plain"))


def rendered_blocks(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    listed = F.struct(F.lit("list").alias("type"), F.array(F.col("p_brand"), F.lit("{@item rope}")).alias("items"))
    nested = F.struct(F.lit("entries").alias("type"), F.col("p_name").alias("name"), F.array(F.col("p_type")).alias("entries"))
    tabled = F.struct(F.lit("table").alias("type"), F.array(F.lit("size"), F.lit("key")).alias("colLabels"), F.array(F.array(F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))).alias("rows"))
    blocks = F.concat(F.lit("["), F.to_json(listed), F.lit(","), F.to_json(nested), F.lit(","), F.to_json(tabled), F.lit("]"))
    return p.select("p_partkey", render_blocks(blocks).alias("lines"))


def html_articles(spark: SparkSession, folder: str) -> DataFrame:
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[<>&\r]", "")
    page = F.concat(F.lit("<html><head><style>p{}</style></head><body><nav>menu</nav><p>outside</p><article><p>"), text, F.lit("</p><aside>ad</aside><b>bold</b></article><footer>end</footer></body></html>"))
    return table(spark, folder, "documents").select("doc_id", main_text(page).alias("main"))


def _coded(spark: SparkSession, folder: str) -> tuple[DataFrame, bpe.Vocabulary, bool]:
    """The documents' ids by a vocabulary that was learned and then extended, and whether the old ids stayed."""
    d = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    first = bpe.train(d, 400)
    v = bpe.train(d, 450, start=first)
    return d.select("doc_id", "text", bpe.encode(F.col("text"), v).alias("ids")), v, v.merges[: len(first.merges)] == first.merges and len(v) > len(first)


def bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    coded, v, kept = _coded(spark, folder)
    return coded.select("doc_id", bpe.decode(F.col("ids"), v).alias("text"), F.lit(kept).alias("ids_kept"))


def decoded_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Texts put together again from a stream of ids that comes in two parts."""
    coded, v, _ = _coded(spark, folder)
    path, target = scratch(spark, "ids"), scratch(spark, "decoded")
    coded = materialize(coded.select(F.col("doc_id").alias("reply_id"), "ids"), "coded")  # else every part would encode all texts again
    for first, run in ((0, F.slice("ids", 1, 350)), (350, F.slice("ids", F.lit(351), F.greatest(F.size("ids") - 350, F.lit(0))))):
        ids = coded.select("reply_id", F.lit(first).cast("long").alias("pos"), run.alias("ids")).filter(F.size("ids") > 0)
        ids.write.mode("append").parquet(path)
        # the second run goes on from the state of the first
        conversations.run_to_end(conversations.decode_stream(spark.readStream.schema(ids.schema).parquet(path), v), target, "update")
    parts = spark.read.parquet(target).groupBy("reply_id").agg(F.array_sort(F.collect_list(F.struct("_batch", "text"))).alias("p"))  # two parts at most
    return parts.select(F.col("reply_id").alias("doc_id"), F.array_join(F.col("p.text"), "").alias("text"))


QUERIES = [bpe_round_trip, decoded_stream, monster_questions, spell_questions, capped_pairs, agent_registry, chosen_splits, tag_forms, rendered_blocks, html_articles]

_RATING = "CAST(CAST(p_size AS BIGINT) AS VARCHAR)"

SQL = {
    "bpe_round_trip": "SELECT doc_id, coalesce(text, '') AS text, true AS ids_kept FROM documents",
    "decoded_stream": "SELECT doc_id, text FROM documents WHERE text <> ''",
    "monster_questions": f"""WITH e AS (SELECT 'What is the challenge rating of the ' || p_name || '?' AS user_text, 'The ' || p_name || ' is challenge rating ' || {_RATING} || CASE WHEN p_size * 450 - 900 > 0 THEN ' (' || format('{{:,}}', p_size * 450 - 900) || ' XP)' ELSE '' END || '.' AS assistant FROM part WHERE p_size % 2 = 0
      UNION ALL SELECT 'How many hit points does a ' || p_name || ' have?', 'A ' || p_name || ' has ' || (p_size * 3) || ' hit points' || CASE WHEN p_size % 3 = 0 THEN ' (' || p_size || 'd8)' ELSE '' END || '.' FROM part
      UNION ALL SELECT 'What is the armor class of a ' || p_name || '?', 'A ' || p_name || ' has an armor class of ' || p_size || CASE WHEN p_size % 8 = 0 THEN ' (hide)' ELSE '' END || '.' FROM part WHERE p_size % 4 = 0
      UNION ALL SELECT 'What type of creature is a ' || p_name || '?', 'A ' || p_name || ' is a large ' || p_type || CASE WHEN p_size % 5 = 0 THEN ', neutral' ELSE '' END || '.' FROM part
      UNION ALL SELECT 'How fast can a ' || p_name || ' move?', 'A ' || p_name || '''s speed is 30 ft.' FROM part WHERE p_size % 7 = 0) SELECT user_text, assistant, count(*) AS n FROM e GROUP BY ALL""",
    "spell_questions": """WITH e AS (SELECT 'What level and school is the spell ' || p_name || '?' AS user_text, p_name || ' is a ' || CASE WHEN p_size % 10 = 0 THEN 'cantrip' ELSE 'level ' || (p_size % 10) END || ' ' || p_brand || ' spell.' AS assistant FROM part WHERE p_size % 2 = 0
      UNION ALL SELECT 'How long does it take to cast ' || p_name || '?', p_name || ' has a casting time of 1 action.' FROM part UNION ALL SELECT 'What is the range of the spell ' || p_name || '?', p_name || ' has a range of 60 feet.' FROM part WHERE p_size % 3 = 0
      UNION ALL SELECT 'How long does ' || p_name || ' last?', p_name || '''s duration is 1 minute.' || CASE WHEN p_size % 4 = 0 THEN ' It requires concentration.' ELSE '' END FROM part WHERE p_size % 5 = 0
      UNION ALL SELECT 'What does the spell ' || p_name || ' do?', p_type || ' glows.' FROM part WHERE length(p_type || ' glows.') > 15) SELECT user_text, assistant, count(*) AS n FROM e GROUP BY ALL""",
    "capped_pairs": """WITH m AS (SELECT n_regionkey, s_suppkey, s_name || ' trades in ' || n_name || '.' AS passage, row_number() OVER (PARTITION BY n_regionkey ORDER BY md5(s_suppkey || '|2'), s_suppkey) AS i FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT n_regionkey, s_suppkey, passage FROM m WHERE i <= 5""",
    "agent_registry": """SELECT * FROM (VALUES (0, 'lore', 'Lore', 'x,y', true, true, NULL), (1, 'bare', 'Bare', '', false, false, NULL), (2, 'lost', 'Lost', '', false, false, 'no checkpoint'), (3, 'odd', 'Odd', '', false, true, 'corrective_retry needs crag'), (4, 'none', NULL, '', false, false, 'not an object')) t(place, agent, display_name, dirs, crag, corrective_retry, error)""",
    "chosen_splits": "SELECT 'table' AS way, doc_id, doc_id % 7 = 0 AS is_val FROM documents UNION ALL SELECT 'none', doc_id, false FROM documents",
    "tag_forms": "SELECT doc_id, 'Melee Weapon Attack: or Ranged Weapon Attack: +' || (doc_id % 12) || ' ' || regexp_replace(coalesce(text, ''), '[{}]', '', 'g') || ' 3d6 Owl' AS plain FROM documents",
    "rendered_blocks": "SELECT p_partkey, '- ' || p_brand || chr(10) || '- rope' || chr(10) || p_name || chr(10) || p_type || chr(10) || 'size | key' || chr(10) || p_size || ' | ' || p_partkey AS lines FROM part",
    "html_articles": "SELECT doc_id, CASE WHEN t = '' THEN 'bold' ELSE t || chr(10) || 'bold' END AS main FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[<>&\\r]', '', 'g') AS t FROM documents)",
}
