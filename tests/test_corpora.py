import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import bpe, lexical, manifests, minhash, passages, retrieval, vectors
from tessella.operators.graphs import components, walk
from tests.help import one, rows, sets

A = "the quick brown fox jumps over the lazy dog near the river bank at dawn"
DOCS = [(0, A), (1, "an entirely different sentence about towers and gates in the north of the land"), (2, A), (3, (A + " ") * 2 + "and once more"), (4, ""), (5, None), (6, "short"), (7, "Short!")]


def docs(spark, data=DOCS):
    return spark.createDataFrame([(i, t, "s", "x") for i, t in data], "id long, text string, source string, node string").drop("node")


def test_minhash_clusters_and_survivors(spark):
    got = {r.id: r.cluster_id for r in rows(minhash.clusters(docs(spark)))}
    assert got[0] == got[2] == 0 and got[6] == got[7] == 6 and not {1, 4, 5} & set(got)
    kept = {r.id for r in rows(minhash.kept_ids(docs(spark)))}
    assert {1, 4, 5, 7} <= kept and 2 not in kept and 6 not in kept  # of 6 and 7 the longer one stays
    assert rows(minhash.clusters(docs(spark).limit(0))) == []
    with pytest.raises(ValueError):
        minhash.MinHash(permutations=10, bands=3)


def test_many_copies_make_one_node(spark):
    many = docs(spark, [(i, A) for i in range(400)])
    assert one(minhash.similar_pairs(many)[1].agg(F.count("*"))) == 0
    assert one(minhash.clusters(many).agg(F.count("*"))) == 400 and [r.id for r in rows(minhash.kept_ids(many))] == [0]


def test_matches_of_new(spark):
    d = docs(spark)
    got = sets(minhash.matches_of_new(d.filter("id = 2"), d, minhash.MinHash(k=5, permutations=64, bands=16, threshold=0.9)).select("a", "b"))
    assert got == {(0, 2)}


def test_ngrams_and_index(spark):
    d = spark.createDataFrame([(1, "one two three four five", "a"), (2, "two three four five two three four five", "b"), (3, "x y", "c"), (4, None, "d")], "doc_id long, text string, source string")
    got = {" ".join(r.ngram): (r.frequency, r.next_token, r.source) for r in rows(lexical.build_index(d, stemmed=False))}
    assert got["two three four five"] == (3, None, "a") and got["one two three four"] == (1, "five", "a") and got["five two three four"] == (1, "five", "b")
    assert len(got) == 5
    assert one(lexical.build_index(d).agg(F.count("*"))) == 5  # stemmed
    e = {" ".join(r.ngram): r.excerpt for r in rows(lexical.build_index(d, stemmed=False, excerpts_wanted=True))}
    assert e["one two three four"] == "one two three four five"


def test_excerpts_snap_to_spaces():
    text = " ".join(f"word{i}" for i in range(200))
    got = lexical.text_excerpts(text, 4, 201)
    assert got[0].startswith("word0 ") and got[100].split()[0].startswith("word") and " word100 " in got[100] and got[200] is None
    assert all(w in text.split() for w in got[100].split())


def test_retrieval_by_overlap(spark):
    index = spark.createDataFrame([(1, ["a1", "b1"], 5), (2, ["a1", "c1"], 9), (3, ["d1", "e1"], 1), (4, ["a1", "c1"], 9)], "key long, ngram array<string>, frequency long")
    asked = spark.createDataFrame([(7, "A1 c1"), (8, "zz yy"), (9, None), (10, "")], "query_id long, text string")
    got = [(r.query_id, r.rank, r.key, round(r.score, 3)) for r in rows(lexical.retrieve(index, asked, 3, stemmed=False).orderBy("query_id", "rank"))]
    assert got == [(7, 1, 2, 1.0), (7, 2, 4, 1.0), (7, 3, 1, 0.333)]


def test_chunks(spark):
    long = " ".join(f"Sentence number {i} is here." for i in range(60))
    d = spark.createDataFrame([(1, "s", "short para\n\n  \n\n" + long), (2, "s", ""), (3, "s", None), (4, "s", "x" * 5000)], "doc_id long, source string, text string")
    got = rows(passages.chunk_documents(d).orderBy("doc_id", "chunk_no"))
    mine = [r.passage for r in got if r.doc_id == 1]
    assert mine[0] == "short para" and " ".join(mine[1:]) == long and all(len(x) <= 400 for x in mine)
    assert [r.passage for r in got if r.doc_id == 4] == ["x" * 5000] and not [r for r in got if r.doc_id in (2, 3)]


def test_units(spark):
    d = spark.createDataFrame([("One. Two is longer!\n\n Three\nI think so. Is it? Four.",)], "t string")
    u = passages.units(F.col("t"))
    assert d.select(u).first()[0] == ["One.", "Two is longer!", "Three", "I think so.", "Is it?", "Four."]
    assert d.select(passages.lead(u, 12)).first()[0] == "One." and d.select(passages.lead(F.filter(u, lambda x: ~passages.is_framing(x)), 99)).first()[0] == "One. Two is longer! Three Four."


def test_vectors_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    v = spark.createDataFrame([(i, x[i].tolist()) for i in range(300)] + [(900, None)], "id long, embedding array<float>")
    q = v.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    for block in (2000, 2):
        got = {}
        for r in rows(vectors.top_k(v.repartition(5), q, 4, queries_per_block=block, skip_self=True).orderBy("query_id", "rank")):
            got.setdefault(r.query_id, []).append(r.id)
        s = x.astype(float) @ x.astype(float).T
        np.fill_diagonal(s, -np.inf)
        assert got == {i: np.argsort(-s[i], kind="stable")[:4].tolist() for i in range(0, 300, 50)}
    assert rows(vectors.top_k(v, q.limit(0), 4)) == [] and rows(vectors.top_k(v.limit(0), q, 4)) == []
    assert abs(one(v.filter("id = 3").select(vectors.dot(vectors.unit(F.col("embedding")), vectors.unit(F.col("embedding"))))) - 1) < 1e-9


def test_index_is_incremental(spark):
    d = spark.createDataFrame([(1, "a", "text one"), (2, "b", "text two")], "doc_id long, source string, text string")
    first = vectors.index_passages(d.filter("doc_id = 1"), vectors.hashing_embedder(8))
    assert [r.doc_id for r in rows(vectors.index_passages(d, vectors.hashing_embedder(8), first))] == [2]


RESULTS = [(1, 1, 10, 0.9), (1, 2, 11, 0.5), (1, 3, 12, 0.7), (1, 4, 13, 0.29), (2, 1, 20, 0.31), (2, 2, 21, 0.1), (2, 3, 22, 0.8)]


def results(spark):
    return spark.createDataFrame(RESULTS, "query_id long, rank int, id long, score double")


def test_tiers_and_second_try(spark):
    got = [(r.query_id, r.rank, r.id, r.tier) for r in rows(retrieval.filter_tiers(results(spark)).orderBy("query_id", "rank"))]
    assert got == [(1, 1, 10, "correct"), (1, 2, 12, "correct"), (1, 3, 11, "ambiguous"), (2, 1, 22, "correct"), (2, 2, 20, "ambiguous")]
    got = [(r.query_id, r.rank, r.id) for r in rows(retrieval.retrieve(results(spark), 1).orderBy("query_id", "rank"))]
    assert got == [(1, 1, 10), (2, 1, 22)]
    assert {r.query_id for r in rows(retrieval.retrieve(results(spark), 1, threshold=0.85))} == {1}
    with pytest.raises(ValueError):
        retrieval.tier(F.lit(1.0), 0.2, 0.3)


def test_rerank_and_route(spark):
    got = [(r.query_id, r.rank, r.id) for r in rows(retrieval.rerank(results(spark), (F.col("id") % 2).cast("double")).orderBy("query_id", "rank"))]
    assert got[:4] == [(1, 1, 11), (1, 2, 13), (1, 3, 10), (1, 4, 12)]
    best = spark.createDataFrame([(1, "b", 0.4), (1, "a", 0.4), (2, "b", 0.05)], "query_id long, agent string, score double")
    assert sets(retrieval.route(best, ["b", "a"], "general").select("query_id", "agent")) == {(1, "b"), (2, "general")}


def test_neighbours(spark):
    r = results(spark).filter("query_id = 1")
    w = spark.createDataFrame([(1, "holds passage 10 inside")], "query_id long, text string")
    p = spark.createDataFrame([(i, f"passage {i}") for i in (10, 11, 12, 13)], "id long, passage string")
    assert sets(retrieval.neighbours(r, w, p, 2)) == {(1, 1, 11), (1, 2, 12)}
    assert one(spark.range(1).select(retrieval.fixed_length(F.array(F.lit(5)), 3))) == [5, 0, 0]


TEXTS = ["low lower lowest newer wider", "Héllo wörld ∇f(x) = 0", "", "  spaces\n\n and\ttabs  ", "it's we'll <SEP> end", "🙂🙂"]


def test_bpe_round_trip_and_prefixes(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS * 3 + [None]], "text string")
    v = bpe.train(df, 330)
    assert len(v) <= 330 and v.decode([*v.encode("low lower")]) == "low lower"
    for t in TEXTS:
        ids = v.encode(t)
        assert v.decode(ids) == t
        d = v.decoder()
        parts = [d.push(i) for i in ids] + [d.finish()]
        assert "".join(parts) == t and "�" not in "".join(parts)
    assert [r[0] for r in rows(df.limit(6).select(bpe.decode(bpe.encode(F.col("text"), v), v)))] == TEXTS
    assert v.encode("<SEP>") == [3] and v.decode([999_999]) == ""


def test_bpe_learns_the_most_frequent_pairs(spark, tmp_path):
    v = bpe.learn({"aab": 3, "aac": 2, "b": 9}, 264)
    assert v.merges == [("a", "a"), ("aa", "b")]
    w = bpe.learn({"aab": 3, "aac": 2, "b": 9}, 265, start=v)
    assert w.merges[:2] == v.merges and w.ids["aab"] == v.ids["aab"] and len(w) == 265
    w.save(str(tmp_path / "v.json"))
    assert bpe.Vocabulary.load(str(tmp_path / "v.json")).ids == w.ids
    with pytest.raises(ValueError):
        bpe.learn({}, 100)
    with pytest.raises(ValueError):
        bpe.learn({"ab": 1}, 264, start=v)


def test_word_counts_equal_the_encoder(spark):
    from collections import Counter

    want = Counter(w for t in TEXTS for w in bpe._split.findall(t))
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    assert {r.word: r.n for r in rows(bpe.word_counts(df))} == want


def test_manifests(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    old = spark.createDataFrame([tuple(r) for r in rows(manifests.file_manifest(spark, str(tmp_path)))], "name string, stamp string, hash string")
    assert not manifests.is_stale(old, manifests.file_manifest(spark, str(tmp_path)))
    (tmp_path / "b.txt").write_text("2")
    (tmp_path / "c.txt").write_text("three")
    new = manifests.file_manifest(spark, str(tmp_path))
    assert sets(manifests.compare(old, new)) == {("a.txt", "same"), ("b.txt", "changed"), ("c.txt", "added")} and manifests.is_stale(old, new)


@pytest.mark.parametrize("seed", range(3))
def test_components_and_walks(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(50), rng.randrange(50)) for _ in range(35)]
    parent = list(range(50))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.root for r in rows(components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}
    cycle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "parent long, child long")
    assert sets(walk(cycle, spark.createDataFrame([(1,)], "node long"), 2)) == {(1, 0), (2, 1), (3, 2)}
