"""Sources and sinks by themselves, range sums, hash cuts, blocks of buckets, agents and quantiles."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessella.functions.arithmetic import evaluate
from tessella.operators import agents, lexical, minhash, retrieval, synthesis, training
from tessella.runtime import scratch
from tessella.sources import files, records, sinks


def test_ranges_of_any_number_give_the_same_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(0, 9), "x") for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, n long, _sum string")
    want, at = {}, 0
    for i, n, _ in sorted(rows):
        want[i] = (at, at + n)
        at += n
    for part_rows in (7, 100, 10_000):
        got = training.with_offsets(df, "n", "id", part_rows)
        assert {r.id: (r.start_off, r.end_off) for r in got.collect()} == want and set(got.columns) == {"id", "n", "_sum", "start_off", "end_off"}
    assert training.with_offsets(df.limit(0), "n", "id").collect() == []


def test_plan_of_sums_does_not_grow_with_the_rows(spark):
    df = spark.range(3000).select("id", F.lit(1).alias("n"))
    size = lambda d: len(d._jdf.queryExecution().analyzed().toString())
    assert size(training.with_offsets(df, "n", "id", 10)) < 1.1 * size(training.with_offsets(df, "n", "id", 1000)) + 200


@pytest.mark.parametrize("n", [0, 1, 37, 299, 300, 500])
def test_samples_are_the_first_by_hash(spark, n):
    ids = [*range(250), *range(50)]  # some twice
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    want = [r.id for r in df.orderBy(training.hash_order(F.col("id"), seed=4), "id").limit(n).collect()]
    assert sorted(r.id for r in training.exact_sample(df, n, "id", seed=4).collect()) == sorted(want)


@pytest.mark.parametrize("n,held", [(0, 0), (1, 0), (2, 1), (40, 4)])
def test_example_split_holds_out_a_share(spark, n, held):
    got = training.example_split(spark.range(n), 0.1, "id").collect()
    assert len(got) == n and sum(r.is_val for r in got) == held


def test_chosen_splits(spark):
    docs = spark.createDataFrame([(i, 1.0 + i % 2, 300) for i in range(200)], "doc_id long, weight double, n_tokens long")
    apart = training.choose_split(docs, 256, 0.1, held=docs.filter("doc_id < 5").withColumn("doc_id", F.col("doc_id") + 1000))
    assert {r.doc_id for r in apart.filter("is_val").collect()} == {1000, 1001, 1002, 1003, 1004} and apart.count() == 205
    assert training.choose_split(docs, 256, 0.0).filter("is_val").count() == 0
    tiers = training.choose_split(docs, 256, 0.1)
    assert {(r.doc_id, r.is_val) for r in tiers.collect()} == {(r.doc_id, r.is_val) for r in training.tier_split(docs, 0.1, 256).collect()}
    blocks = training.choose_split(docs, 256, 0.1, tiers=False)
    assert blocks.count() == 200 and 0 < blocks.filter("is_val").count() < 60


@pytest.mark.parametrize("block", [3, 512])
def test_bucket_pairs_in_blocks(spark, block):
    rows = [(n, b) for b, ns in {1: range(20), 2: [5, 6], 3: [9], 4: range(30, 37)}.items() for n in ns]
    got = minhash.bucket_pairs(spark.createDataFrame(rows, "node long, bucket long"), block).collect()
    want = [p for b in (1, 2, 3, 4) for p in combinations(sorted(n for n, x in rows if x == b), 2)]
    assert sorted((r.a, r.b) for r in got) == sorted(want)


def test_new_against_all_equals_all_comparisons(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(12)]
    texts = [(i, base[i % 12] + (" more words" * (i // 12) if i % 3 else "")) for i in range(48)] + [(90, ""), (91, None)]
    everything = spark.createDataFrame(texts, "id long, text string")
    p = minhash.MinHash()
    signed = {r.id: r.s for r in everything.select("id", minhash.signature(F.col("text"), p).alias("s")).collect() if r.s}
    same = lambda x, y: sum(a == b for a, b in zip(signed[x], signed[y])) / p.permutations
    want = {(a, b, same(a, b)) for a, b in combinations(sorted(signed), 2) if (a < 10 or b < 10) and same(a, b) >= p.threshold}
    got = {(r.a, r.b, r.similarity) for r in minhash.matches_of_new(everything.filter("id < 10"), everything, p).collect()}
    assert got == want != set()


def test_category_caps(spark):
    rows = [("a", i) for i in range(300)] + [("b", i) for i in range(3)] + [(None, 1)]
    got = synthesis.capped(spark.createDataFrame(rows, "kind string, id long"), "kind", 5, "id", seed=1).collect()
    assert sorted((r.kind or "", sum(x.kind == r.kind for x in got)) for r in got) == [("", 1)] + [("a", 5)] * 5 + [("b", 3)] * 3


def test_registry():
    assert list(agents.parse_registry('{"a": {"display_name": "A", "checkpoint": "c", "vocab": "v"}}')) == ["a"]
    for text, part in (("{", "JSON"), ("[]", "object"), ('{"a": {"display_name": "A", "vocab": "v"}}', "'a': no checkpoint"), ('{"a": {"display_name": "A", "checkpoint": "c", "vocab": "v", "corrective_retry": true}}', "needs crag")):
        with pytest.raises(ValueError, match=part):
            agents.parse_registry(text)


def test_wider_second_try(spark):
    found = spark.createDataFrame([(1, k, 0.5 if k < 50 else 0.9, k) for k in range(1, 70)] + [(2, k, 0.8 if k == 20 else 0.4, k) for k in range(1, 30)] + [(3, 1, 0.1, 1)], "query_id long, rank int, score double, id long")
    got = retrieval.search(found, 2, new_score=F.col("score"))
    assert [(r.query_id, r.id, r.rank) for r in got.orderBy("query_id", "rank").collect()] == [(1, 50, 1), (1, 51, 2), (2, 20, 1), (2, 1, 2)]
    plain = retrieval.search(found, 2)
    assert [(r.query_id, r.id) for r in plain.orderBy("query_id", "rank").collect()] == [(1, 1), (1, 2), (2, 1), (2, 2)]


@pytest.mark.parametrize("expression,want", [("t_ppf(0.975, 10)", 2.228139), ("t_ppf(0.05, 3)", -2.353363), ("chi2_ppf(0.95, 5)", 11.0705), ("chi2_ppf(0.01, 40)", 22.1643), ("t_ppf(0.5, 7)", 0)])
def test_quantiles(expression, want):
    assert float(evaluate(expression)[0]) == pytest.approx(want, rel=1e-5)


def test_ingest(spark):
    path = scratch(spark, "mixed")
    spark.createDataFrame([("# Head\n\nsome   *text*",)], "t string").coalesce(1).write.text(path)
    target = scratch(spark, "ingested")
    assert files.ingest(spark, path, target) == 0
    assert [r.text for r in spark.read.parquet(target).collect()] == ["# Head\n\nsome *text*"]
    with pytest.raises(ValueError, match="fetch"):
        files.ingest(spark, "https://example.org/a.html", scratch(spark, "web"))


def test_tokens_with_weights(spark):
    path = scratch(spark, "bad-tokens")
    sinks.write_tokens(spark.createDataFrame([(1, [1, 2], [0.5])], "doc_id long, ids array<int>, weights array<double>"), path)
    with pytest.raises(ValueError, match="differ in length"):
        sinks.read_tokens(spark, path)


def test_records_by_kind(spark):
    d = spark.createDataFrame([("wiki", "x" * 99), ("wiki", "x" * 100), ("other", ""), (None, None)], "kind string, text string")
    assert records.long_enough(d, "kind", {"wiki": 100}).count() == 3
    f = spark.createDataFrame([(1, True), (2, None), (3, False)], "id long, closed boolean")
    assert {r.id for r in records.open_items(f, "closed").collect()} == {2, 3}
    i = spark.createDataFrame([(["a", "b"], 1), (["a"], 2)], "ngram array<string>, n int")
    assert [r.n for r in lexical.lookup(i, i.filter("n = 2")).collect()] == [2]


def test_shards_hold_capitals_as_sql_has_them(spark, tmp_path):
    import duckdb

    from tessella.queries import transfers

    answers = ["straße Öl", "ŉ ǰ ﬁ ﬀ ᾳ ᾲ ᾼ ῼ և", "plain", "élan 𐐨 ǆ ǅ ı", "", None, "".join(chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x20000)))]
    rows = [(i, f"q{i}", 5 + i, i, a, "s") for i, a in enumerate(answers)]
    spark.createDataFrame(rows, "pair_id long, question string, answer_score int, question_id long, answer string, site string").write.parquet(f"{tmp_path}/qa_pairs.parquet")
    got = transfers.qa_shards(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view qa_pairs as select * from read_parquet('{tmp_path}/qa_pairs.parquet/*.parquet')")
    want = con.sql(f"select {', '.join(got.columns)} from ({transfers.SQL['qa_shards']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_decoder_takes_ids_at_once():
    from tessella.operators.bpe import FIRST_BYTE, Vocabulary

    v, rng = Vocabulary([]), random.Random(3)
    for _ in range(300):
        ids = [rng.choice([*range(6), 9999, *(FIRST_BYTE + b for b in "é€𐐨a".encode()), FIRST_BYTE + 255]) for _ in range(rng.randrange(30))]
        cut = rng.randrange(31)
        one, many = v.decoder(), v.decoder()
        assert "".join(map(one.push, ids)) == many.push_all(ids[:cut]) + many.push_all(ids[cut:]) and one.held == many.held and one.finish() == many.finish()


def test_decoded_stream_encodes_in_all_tasks(spark, tmp_path, monkeypatch):
    from tessella.queries import generated

    written = []
    monkeypatch.setattr(generated, "scratch", lambda s, name: written.append((name, scratch(s, name))) or written[-1][1])
    rows = [(i, f"Der Wächter öffnet das Tor {i}. " * (i % 40)) for i in range(200)]
    spark.createDataFrame([*rows, (900, None)], "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in generated.decoded_stream(spark, str(tmp_path)).collect()} == {r for r in rows if r[1]}
    assert len(spark.read.parquet(dict(written)["ids"]).inputFiles()) > 2  # a file a part came of one task that encoded all texts


def test_many_small_files_are_read_once_by_few_tasks(spark, tmp_path, monkeypatch):
    for i in range(150):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "x.txt").write_text(f"text {i}")
    tasks, write = [], files.materialize
    monkeypatch.setattr(files, "materialize", lambda df, name: tasks.append((name, df.rdd.getNumPartitions())) or write(df, name))
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    want = {(f"d{i}", f"text {i}") for i in range(150)}
    short = F.element_at(F.split("path", "/"), -2)
    assert {tuple(r) for r in files.read_texts(spark, [str(tmp_path)]).select(short, "text").collect()} == want
    assert {tuple(r) for r in files.read_files(spark, str(tmp_path), recursive=True).select(short, "text").collect()} == want
    assert [n for name, n in tasks if name == "contents" and n <= 8] == [n for name, n in tasks if name == "contents"] and sum(name == "contents" for name, _ in tasks) == 2
    assert spark.conf.get("spark.sql.files.openCostInBytes") == cost


def test_files_of_equal_negative_and_missing_ids(spark, tmp_path):
    import duckdb

    from tessella.queries import transfers

    rows = [(i, f"text {i}\nnext") for i in (1, 2, 10, 12, 100)] + [(-5, "below"), (7, "first"), (7, "second"), (None, "no id"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    by = lambda rows: sorted(rows, key=str)
    for name, cols in (("text_files", "doc_id, text"), ("text_files", "doc_id, doc_idx"), ("ingested_files", "doc_id, ending, n_chars, is_read")):
        got = getattr(transfers, name)(spark, str(tmp_path)).select(*cols.split(", "))
        assert by(map(tuple, got.collect())) == by(con.sql(f"select {cols} from ({transfers.SQL[name]})").fetchall())


def test_files_are_listed_in_tasks(spark, tmp_path, monkeypatch):
    for name in ("a/x.txt", "a/b/y.txt", "a/b=1/z.TXT", "top.txt", "_no/x.txt", "a/.no.txt", "a/_no.txt", "_b=2/k.txt", "wörter 1%/m n.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    sources, write = [], files.materialize
    monkeypatch.setattr(files, "materialize", lambda df, name: sources.extend(df.inputFiles()) or write(df, name))
    paths = lambda df: {r.path.split(tmp_path.name + "/")[1] for r in df.collect()}
    every = {"a/x.txt", "a/b/y.txt", "a/b=1/z.TXT", "top.txt", "_b=2/k.txt", "wörter 1%/m n.txt"}
    assert paths(files.read_files(spark, str(tmp_path), recursive=True)) == every == {r.text for r in files.read_files(spark, str(tmp_path), recursive=True).collect()}
    assert paths(files.read_texts(spark, [str(tmp_path)])) == every - {"a/b=1/z.TXT"}
    assert paths(files.read_files(spark, str(tmp_path))) == {"top.txt"} == paths(files.read_files(spark, f"{tmp_path}/t*.txt"))
    assert paths(files.read_files(spark, f"{tmp_path}/top.txt")) == {"top.txt"}
    assert not [x for x in sources if x.lower().endswith(".txt")]  # else the driver held a list of them
    with pytest.raises(FileNotFoundError):
        files.read_files(spark, str(tmp_path / "nowhere"))
