"""Queries of deduplication, the lexical index, passages, vectors and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import lexical, manifests, minhash, passages, retrieval, vectors
from tessella.operators.graphs import walk
from tessella.queries.base import WS, r6, table

DUPLICATES = minhash.MinHash()
REPORT = minhash.MinHash(k=8, permutations=64, bands=16, threshold=0.4)


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", "source")


def dedup_shingles(spark: SparkSession, folder: str) -> DataFrame:
    h = minhash.shingles(F.col("text"))
    d = _texts(spark, folder).select("id", h.alias("h"))
    total = F.aggregate("h", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return d.select(F.col("id").alias("doc_id"), F.size("h").cast("bigint").alias("n_shingles"), total.alias("hash_sum"), F.array_min("h").alias("least"))


def dedup_bands(spark: SparkSession, folder: str) -> DataFrame:
    signed = _texts(spark, folder).select(F.col("id").alias("node"), minhash.signature(F.col("text"), DUPLICATES).alias("signature")).filter("signature is not null")
    return minhash.band_keys(signed, DUPLICATES).select(F.col("node").alias("doc_id"), "band", "key")


def dedup_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.clusters(_texts(spark, folder), DUPLICATES).select(F.col("id").alias("doc_id"), "cluster_id")


def dedup_kept(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.kept_ids(_texts(spark, folder), DUPLICATES).select(F.col("id").alias("doc_id"))


def near_dup_report(spark: SparkSession, folder: str) -> DataFrame:
    docs = _texts(spark, folder)
    got = minhash.matches_of_new(docs.filter("source = 'rpg_qa'"), docs, REPORT)
    return got.select("a", "b", r6("similarity").alias("similarity"))


def ngram_table(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    index = lexical.build_index(docs, stemmed=False)
    return index.select(F.array_join("ngram", " ").alias("ngram"), "next_token", "frequency", "source")


def stemmed_table(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return lexical.build_index(docs).select(F.array_join("ngram", " ").alias("ngram"), "next_token", "frequency", "source")


def index_excerpts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "ngram_index").select(F.col("entry_id").alias("doc_id"), F.col("excerpt").alias("text"), "source")
    index = lexical.build_index(docs, stemmed=False, excerpts_wanted=True)
    return index.select(F.array_join("ngram", " ").alias("ngram"), "frequency", "excerpt")


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "ngram_index").filter("ngram is not null")
    return d.groupBy(F.col("entry_id").alias("key")).agg(F.max("frequency").alias("frequency"), F.max("ngram").alias("ngram"))


def postings_lookup(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "eval_items").filter("keywords is not null").select(F.explode("keywords").alias("word")).distinct()
    met = lexical.postings(_entries(spark, folder)).join(words, "word", "left_semi")
    return met.groupBy("word").agg(F.countDistinct("key").alias("n_entries"), F.min("key").alias("first_entry"))


def jaccard_topk(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), F.col("user_text").alias("text"))
    return lexical.retrieve(_entries(spark, folder), asked, top_k=5, stemmed=False).select("query_id", "rank", F.col("key").alias("entry_id"), r6("score").alias("score"))


def chunk_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.chunk_documents(table(spark, folder, "documents")).select("doc_id", "chunk_no", "passage")


def leading_units(spark: SparkSession, folder: str) -> DataFrame:
    qa = table(spark, folder, "qa_pairs").filter("answer is not null").select("pair_id", "answer").distinct()
    u = passages.units(F.col("answer"))
    return qa.select("pair_id", F.size(u).cast("bigint").alias("n_units"), passages.lead(u, 350).alias("lead"))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _nearest(spark: SparkSession, folder: str, k: int) -> DataFrame:
    v = _vectors(spark, folder)
    return vectors.top_k(v, v.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding"), k, skip_self=True)


def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _nearest(spark, folder, 10).select("query_id", "rank", "id", r6("score").alias("score"))


def tier_filter(spark: SparkSession, folder: str) -> DataFrame:
    got = retrieval.filter_tiers(_nearest(spark, folder, 10), 0.35, 0.28)
    return got.select("query_id", "rank", "id", "tier")


def second_try(spark: SparkSession, folder: str) -> DataFrame:
    got = retrieval.retrieve(_nearest(spark, folder, 15), 5, 0.40, 0.25, threshold=0.3)
    return got.select("query_id", "rank", "id", "tier")


def reranked(spark: SparkSession, folder: str) -> DataFrame:
    near = _nearest(spark, folder, 10).join(_vectors(spark, folder).select("id", "label"), "id")
    return retrieval.rerank(near, (F.col("label") % 3).cast("double")).select("query_id", "rank", "id", r6("score").alias("score"))


def route_agents(spark: SparkSession, folder: str) -> DataFrame:
    best = _nearest(spark, folder, 10).join(_vectors(spark, folder).select("id", F.concat(F.lit("agent"), F.col("label").cast("string")).alias("agent")), "id").groupBy("query_id", "agent").agg(F.max("score").alias("score"))
    return retrieval.route(best, [f"agent{i}" for i in range(10)], "general", 0.3).select("query_id", "agent", r6("score").alias("score"))


def embedded_passages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    index = vectors.index_passages(docs, vectors.hashing_embedder(32), docs.filter("source = 'rpg_qa'"))
    return index.select("doc_id", "chunk_no", F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm"))


def manifest_changes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").filter("fetched_at is not null and file_name is not null")
    old = manifests.table_manifest(docs.filter("fetched_at < timestamp_ntz'2024-06-01 00:00:00'"), "file_name", "text", "fetched_at")
    new = manifests.table_manifest(docs.filter("doc_id % 7 <> 0"), "file_name", "text", "fetched_at")
    return manifests.compare(old, new)


def category_walk(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "part").select(F.col("p_partkey").alias("k"))
    edges = n.select((F.col("k") / 3).cast("bigint").alias("parent"), F.col("k").alias("child")).filter("parent <> child")
    return walk(edges, spark.sql("select 1L as node"), 4)


QUERIES = [dedup_shingles, dedup_bands, dedup_clusters, dedup_kept, near_dup_report, ngram_table, stemmed_table, index_excerpts, postings_lookup, jaccard_topk, chunk_passages, leading_units, cosine_topk, tier_filter, second_try, reranked, route_agents, embedded_passages, manifest_changes, category_walk]


def _shingle_sql(k: int, rows: str = "documents") -> str:
    """(id, h): distinct shingle hashes; the four first digest bytes are read little end first."""
    word = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"
    hexed = "substr(d, 7, 2) || substr(d, 5, 2) || substr(d, 3, 2) || substr(d, 1, 2)"
    return f"""w AS (SELECT doc_id AS id, {word} AS w FROM {rows}),
      s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) < {k} THEN [array_to_string(w, chr(0))] ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], chr(0))) END) AS g FROM w WHERE len(w) > 0),
      x AS (SELECT id, sha1(g) AS d FROM s), h AS (SELECT DISTINCT id, CAST('0x' || {hexed} AS BIGINT) AS h FROM x)"""


def _signature_sql(p: minhash.MinHash, source: str = "documents") -> str:
    a, b = p.coefficients()
    rows = ", ".join(f"({i}, {int(x)}, {int(y)})" for i, (x, y) in enumerate(zip(a, b)))
    return f"""{_shingle_sql(p.k, source)}, c(pos, a, b) AS (VALUES {rows}),
      m AS (SELECT id, pos, min((CAST(a AS HUGEINT) * h + b) % 4294967296) AS v FROM h, c GROUP BY ALL)"""


def bands_sql(source: str = "documents") -> str:
    return f"""{_signature_sql(DUPLICATES, source)},
  bands AS (SELECT id, pos // {DUPLICATES.rows} AS band, string_agg(CAST(v AS VARCHAR), '-' ORDER BY pos) AS key FROM m GROUP BY ALL)"""


def clusters_sql(source: str = "documents") -> str:
    return f"""{bands_sql(source)},
  pairs AS (SELECT DISTINCT x.id AS a, y.id AS b FROM bands x JOIN bands y ON x.band = y.band AND x.key = y.key AND x.id < y.id),
  good AS (SELECT a, b FROM pairs JOIN m u ON u.id = a JOIN m v ON v.id = b AND v.pos = u.pos GROUP BY a, b HAVING count(*) FILTER (u.v = v.v) / {DUPLICATES.permutations}.0 >= {DUPLICATES.threshold}),
  e AS (SELECT a, b FROM good UNION ALL SELECT b, a FROM good),
  r(id, other) AS (SELECT a, b FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
  cl AS (SELECT id, least(id, min(other)) AS cluster_id FROM r GROUP BY id)"""


_BANDS, _CLUSTERS = bands_sql(), clusters_sql()
_TOKENS = "list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9&\\-'']*'), lambda w: length(w) > 1), lambda w: lower(w))"
_ENTRIES = "e AS (SELECT entry_id AS key, max(frequency) AS frequency, max(ngram) AS ngram FROM ngram_index WHERE ngram IS NOT NULL GROUP BY entry_id)"
_NEAR = """n AS (SELECT q.vec_id AS query_id, v.vec_id AS id, v.label, list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(v.embedding[i] AS DOUBLE))) AS score
   FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
   t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM n)"""


def _tier_sql(k: int, name: str, upper: float, lower: float) -> str:
    return f"""{name} AS (SELECT query_id, id, score, tier, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier <> 'correct', rank) AS INT) AS rank
      FROM (SELECT *, CASE WHEN score >= {upper} THEN 'correct' WHEN score >= {lower} THEN 'ambiguous' END AS tier FROM t WHERE rank <= {k}) WHERE tier IS NOT NULL)"""


_SENT = f"list_filter(list_transform(string_split(regexp_replace(u, '([.!?])[{WS}]+', '\\1' || chr(2), 'g'), chr(2)), lambda x: regexp_replace(x, '^[{WS}]+|[{WS}]+$', '', 'g')), lambda x: x <> '')"
_PARA = f"list_filter(list_transform(regexp_split_to_array(text, '\\n[{WS}]*\\n'), lambda x: regexp_replace(x, '^[{WS}]+|[{WS}]+$', '', 'g')), lambda x: x <> '')"

_CHUNKS = f"""WITH p AS (SELECT doc_id, unnest({_PARA}) AS u, generate_subscripts({_PARA}, 1) AS i FROM documents WHERE text IS NOT NULL),
  k AS (SELECT doc_id, i, CASE WHEN length(u) <= 600 THEN [u] ELSE string_split(list_reduce({_SENT}, lambda a, x: CASE WHEN length(string_split(a, chr(1))[-1]) + 1 + length(x) > 400 THEN a || chr(1) || x ELSE a || ' ' || x END), chr(1)) END AS c FROM p),
  f AS (SELECT doc_id, flatten(list(c ORDER BY i)) AS c FROM k GROUP BY doc_id)
  SELECT doc_id, CAST(unnest(range(0, len(c))) AS INT) AS chunk_no, unnest(c) AS passage FROM f"""

SQL = {
    "dedup_shingles": f"WITH {_shingle_sql(5)} SELECT d.doc_id, count(h) AS n_shingles, CAST(coalesce(sum(h), 0) AS BIGINT) AS hash_sum, min(h) AS least FROM documents d LEFT JOIN h ON h.id = d.doc_id GROUP BY d.doc_id",
    "dedup_bands": f"WITH {_BANDS} SELECT id AS doc_id, CAST(band AS INT) AS band, key FROM bands",
    "dedup_clusters": f"WITH RECURSIVE {_CLUSTERS} SELECT id AS doc_id, cluster_id FROM cl",
    "dedup_kept": f"""WITH RECURSIVE {_CLUSTERS}, k AS (SELECT cl.id, row_number() OVER (PARTITION BY cluster_id ORDER BY length(coalesce(text, '')) DESC, cl.id) AS r FROM cl JOIN documents d ON d.doc_id = cl.id)
      SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT id FROM k WHERE r > 1)""",
    "near_dup_report": f"""WITH {_signature_sql(REPORT)}, p AS (SELECT x.id AS x, y.id AS y, count(*) / 64.0 AS s FROM m x JOIN m y ON x.pos = y.pos AND x.v = y.v AND x.id <> y.id WHERE x.id IN (SELECT doc_id FROM documents WHERE source = 'rpg_qa') GROUP BY ALL)
      SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b, CAST(round(s, 6) AS DOUBLE) AS similarity FROM p WHERE s >= 0.4""",
    "ngram_table": f"""WITH w AS (SELECT doc_id, source, {_TOKENS} AS w FROM documents WHERE text IS NOT NULL),
      g AS (SELECT doc_id, source, w, unnest(range(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 4),
      n AS (SELECT doc_id, i, array_to_string(w[i:i + 3], ' ') AS ngram, w[i + 4] AS next_token, source FROM g)
      SELECT ngram, arg_min({{'t': next_token}}, (doc_id, i)).t AS next_token, count(*) AS frequency, arg_min({{'s': source}}, (doc_id, i)).s AS source FROM n GROUP BY ngram""",
    "postings_lookup": f"""WITH {_ENTRIES}, k AS (SELECT DISTINCT unnest(keywords) AS word FROM eval_items), p AS (SELECT DISTINCT key, unnest(ngram) AS word FROM e)
      SELECT word, count(DISTINCT key) AS n_entries, min(key) AS first_entry FROM p SEMI JOIN k USING (word) GROUP BY word""",
    "jaccard_topk": f"""WITH {_ENTRIES}, q AS (SELECT item_id AS query_id, list_distinct({_TOKENS.replace('text,', 'user_text,')}) AS words FROM eval_items WHERE user_text IS NOT NULL),
      p AS (SELECT key, unnest(list_distinct(ngram)) AS word, len(list_distinct(ngram)) AS nw, frequency FROM e), u AS (SELECT query_id, unnest(words) AS word, len(words) AS nq FROM q),
      s AS (SELECT query_id, key, frequency, count(*) / CAST(nw + nq - count(*) AS DOUBLE) AS score FROM p JOIN u USING (word) GROUP BY query_id, key, frequency, nw, nq),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frequency DESC, key) AS INT) AS rank FROM s)
      SELECT query_id, rank, key AS entry_id, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "chunk_passages": _CHUNKS,
    "embedded_passages": f"SELECT c.doc_id, chunk_no, CAST(1.0 AS DOUBLE) AS norm FROM ({_CHUNKS}) c JOIN documents d ON d.doc_id = c.doc_id WHERE coalesce(source, '') <> 'rpg_qa'",
    "leading_units": f"""WITH a AS (SELECT DISTINCT pair_id, answer FROM qa_pairs WHERE answer IS NOT NULL),
      l AS (SELECT pair_id, list_filter(list_transform(string_split(regexp_replace(answer, '^[{WS}]+|[{WS}]+$', '', 'g'), chr(10)), lambda x: regexp_replace(x, '^[{WS}]+|[{WS}]+$', '', 'g')), lambda x: x <> '') AS l FROM a),
      s AS (SELECT pair_id, flatten(list_transform(l, lambda u: {_SENT})) AS s FROM l)
      SELECT pair_id, CAST(len(s) AS BIGINT) AS n_units, CASE WHEN len(s) = 0 THEN '' ELSE replace(list_reduce(s, lambda a, x: CASE WHEN contains(a, chr(1)) OR length(a) + 1 + length(x) > 350 THEN rtrim(a, chr(1)) || chr(1) ELSE a || ' ' || x END), chr(1), '') END AS lead FROM s""",
    "cosine_topk": f"WITH {_NEAR} SELECT query_id, rank, id, round(score, 6) AS score FROM t WHERE rank <= 10",
    "tier_filter": f"WITH {_NEAR}, {_tier_sql(10, 'f', 0.35, 0.28)} SELECT query_id, rank, id, tier FROM f",
    "second_try": f"""WITH {_NEAR}, {_tier_sql(5, 'a', 0.40, 0.25)}, {_tier_sql(15, 'b', 0.40, 0.25)},
      sw AS (SELECT query_id FROM b GROUP BY query_id HAVING max(score) >= 0.40 AND query_id NOT IN (SELECT query_id FROM a WHERE score >= 0.40)),
      g AS (SELECT * FROM a WHERE query_id NOT IN (SELECT query_id FROM sw) UNION ALL SELECT * FROM b WHERE query_id IN (SELECT query_id FROM sw))
      SELECT query_id, rank, id, tier FROM g WHERE rank <= 5 AND query_id IN (SELECT query_id FROM g WHERE rank = 1 AND score >= 0.3)""",
    "reranked": f"WITH {_NEAR} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY label % 3 DESC, rank) AS INT) AS rank, id, CAST(label % 3 AS DOUBLE) AS score FROM t WHERE rank <= 10",
    "route_agents": f"""WITH {_NEAR}, b AS (SELECT query_id, label, max(score) AS score FROM t WHERE rank <= 10 GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS r FROM b)
      SELECT query_id, CASE WHEN score > 0.3 THEN 'agent' || label ELSE 'general' END AS agent, round(score, 6) AS score FROM o WHERE r = 1""",
    "manifest_changes": """WITH d AS (SELECT * FROM documents WHERE fetched_at IS NOT NULL AND file_name IS NOT NULL),
      o AS (SELECT file_name AS name, arg_max(md5(coalesce(text, '')), fetched_at) AS was FROM d WHERE fetched_at < TIMESTAMP '2024-06-01' GROUP BY 1), n AS (SELECT file_name AS name, arg_max(md5(coalesce(text, '')), fetched_at) AS now FROM d WHERE doc_id % 7 <> 0 GROUP BY 1)
      SELECT name, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' WHEN was <> now THEN 'changed' ELSE 'same' END AS status FROM o FULL JOIN n USING (name)""",
    "category_walk": """WITH RECURSIVE e AS (SELECT p_partkey // 3 AS parent, p_partkey AS child FROM part), r(node, level) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT child, level + 1 FROM r JOIN e ON e.parent = r.node WHERE level < 4 AND parent <> child)
      SELECT node, min(level) AS level FROM r GROUP BY node""",
}
