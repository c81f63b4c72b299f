import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.operators import synthesis, training
from tessella.sources import records, sinks
from tests.help import one, rows, sets


def test_template_texts(spark):
    words = {"who": ["a", "b"], "what": ["x", "y", "z"]}
    got = [r.text for r in rows(synthesis.template_texts(spark, 60, ["{who} sees {what}", "no {what}"], words, seed=1).orderBy("id"))]
    assert len(got) == 60 and all(("sees" in t) == (i % 2 == 0) and "{" not in t for i, t in enumerate(got)) and len(set(got)) == 9
    assert got == [r.text for r in rows(synthesis.template_texts(spark, 60, ["{who} sees {what}", "no {what}"], words, seed=1).orderBy("id"))]
    for bad in (["{other}"], []):
        with pytest.raises(ValueError):
            synthesis.template_texts(spark, 1, bad, words)


def test_validation(spark):
    d = spark.createDataFrame([("q", "answer", None), (None, None, "not JSON"), ("q", None, "no assistant"), ("qq", "a", None)], "user string, assistant string, error string")
    got = synthesis.validation_summary(d, F.length("user") + F.length("assistant"), 5).first()
    assert tuple(got) == (2, 1, 1, 3, 7, 5.0, 1)
    assert tuple(synthesis.validation_summary(d.limit(0), F.length("user"), 5).first())[:3] == (0, 0, 0)


def test_collation(spark):
    d = spark.createDataFrame([(1, 1, [5, 6, 7]), (1, 2, [8]), (2, 2, [9])], "query_id long, slot int, ids array<int>")
    assert {r.query_id: r.neighbours for r in rows(synthesis.collate_neighbours(d, 2, 2))} == {1: [[5, 6], [8, 0]], 2: [[0, 0], [9, 0]]}
    assert one(spark.range(1).select(synthesis.ignored_share(F.array(F.lit(-100), F.lit(3))))) == 0.5


def test_zipped_json(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("data/spells-1.json", json.dumps({"spell": [{"name": "A", "srd": True}, {"name": "B"}]}))
        z.writestr("data/spells-2.json", json.dumps([{"name": "C"}]))
        z.writestr("data/spells-3.json", "broken")
        z.writestr("data/items.json", json.dumps([{"name": "D"}]))
    (tmp_path / "broken.zip").write_text("no zip")
    got = rows(records.read_zipped_json(spark, str(tmp_path), "data/spells-*.json"))
    assert sorted(json.loads(r.entry)["name"] for r in got) == ["A", "B", "C"] and {r.archive for r in got} == {"d.zip"}


def test_grouped_batches_deal_all_documents(spark):
    p = spark.createDataFrame([(d, 10 * d + k) for d in range(8) for k in range(3)], "doc_id long, passage_id long")
    got = rows(training.grouped_batches(p, 2, 4, 6))
    by = {}
    for r in got:
        by.setdefault(r.batch, set()).add(r.doc_id)
    assert len(got) == 6 * 4 * 2 and all(by[2 * i] | by[2 * i + 1] == set(range(8)) for i in range(3))
    assert rows(training.grouped_batches(p.limit(0), 2, 4, 6)) == []


def test_chunk_numbers_need_no_single_task(spark):
    d = spark.range(1000).select((F.col("id") * 7 % 1000).alias("n"))
    assert sets(sinks.chunked(d, 30, "n").select("n", "file_no")) == {(i, i // 30) for i in range(1000)}
    both = sets(sinks.chunked(d.withColumn("g", F.col("n") % 2), 100, "n", within="g").select("n", "file_no"))
    assert both == {(i, i // 2 // 100) for i in range(1000)}
