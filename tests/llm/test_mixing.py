import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessella.llm.mixing import Mixing, current_targets, mix, quality_weights, with_tokens

DOC = "id long, source string, text string, weight string, key string"
TARGET = "source string, target_share double, max_repeats int, updated_at timestamp, size int"
D = datetime


@pytest.fixture(scope="module")
def case(spark):
    docs = [(i, "Big " if i % 3 else " BIG", f"word {i} " * (i % 40), None, None) for i in range(600)]
    docs += [(1000 + i, "small", "tiny text here", None, None) for i in range(20)]
    docs += [(2000 + i, None, "left out", None, None) for i in range(5)] + [(3000, "other", "left out", None, None), (3001, "small", None, None, None), (3002, "small", "", None, None)]
    docs += docs[:10] + [(None, "big", "no id", None, None)]
    targets = [("big", 0.6, 4, D(2024, 5, 1), 1), ("Small", 0.3, 3, D(2024, 5, 1), 1), ("small", 0.9, 900, D(2023, 1, 1), 1), ("absent", 0.1, 5, D(2024, 1, 1), 1), (None, 0.5, 1, D(2024, 1, 1), 1)]
    return spark.createDataFrame(docs, DOC), spark.createDataFrame(targets, TARGET)


def test_selection_equals_sorted_prefix(case):
    docs, targets = case
    weights = docs.filter("id is not null").select("id", F.when(F.col("id") % 2 == 0, 0.25).otherwise(1.0).alias("weight"))
    m = mix(docs, targets, weights, Mixing(seed=3))
    report = {r.source: r for r in m.report.collect()}
    got = {r.id: r.copies for r in m.selection.collect()}
    big = report["big"]
    goal = math.floor(min(0.6 * sum(r.source_tokens for r in report.values()), 4 * big.source_tokens))
    sized = with_tokens(docs.filter("id < 600").select("id", "text").distinct()).withColumn("w", F.when(F.col("id") % 2 == 0, 0.25).otherwise(1.0))
    unit = (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    order = sorted((r.k, r.id, r.tokens) for r in sized.select("id", "tokens", (-F.log(unit) / F.col("w")).alias("k")).collect())
    epochs, rest = divmod(goal, big.source_tokens)
    want, used = {}, 0
    for _, i, t in order:
        if used + t > rest:
            break
        used += t
        want[i] = 1
    want = {i: want.get(i, 0) + epochs for _, i, _ in order if want.get(i, 0) + epochs}
    assert {i: c for i, c in got.items() if i < 600} == want
    assert big.mixed_tokens == used + epochs * big.source_tokens


def test_report(case):
    docs, targets = case
    report = {r.source: r for r in mix(docs, targets).report.collect()}
    assert set(report) == {"big", "Small", "absent"}
    assert [report[s].short for s in ("big", "Small", "absent")] == [False, True, True]
    assert report["Small"].repeats == 3 and report["absent"].mixed_tokens == 0
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)


def test_repeats_are_capped_and_rows_counted_once(case):
    docs, targets = case
    rows = mix(docs, targets).selection.collect()
    assert len({r.id for r in rows}) == len(rows)
    assert {r.copies for r in rows if 1000 <= r.id < 1020} == {3} and all(r.copies <= 4 for r in rows)
    assert {3001, 3002} <= {r.id for r in rows}


def test_latest_target_holds(case):
    got = {r.key: (r.source, r.target_share) for r in current_targets(case[1]).collect()}
    assert got == {"big": ("big", 0.6), "small": ("Small", 0.3), "absent": ("absent", 0.1)}


def test_empty_tables(case):
    docs, targets = case
    m = mix(docs.limit(0), targets)
    assert m.selection.collect() == [] and all(r.mixed_tokens == 0 for r in m.report.collect())
    assert mix(docs, targets.limit(0)).report.collect() == []


def test_tokens_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "<|endoftext|>"), (4, "héllo wörld"), (5, "a" * 20_000)]
    got = {r.id: r.tokens for r in with_tokens(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got[1] == got[2] == 0 and got[3] > 1 and got[4] > 1 and got[5] > 100


def test_quality_weights(spark):
    rows = [(1, 1, True, D(2024, 1, 1)), (1, 2, False, D(2024, 1, 2)), (2, 1, None, D(2024, 1, 1)), (3, 1, True, None), (None, 1, True, None)]
    got = {r.id: r.weight for r in quality_weights(spark.createDataFrame(rows, "doc_id long, run_no int, is_kept boolean, scored_at timestamp")).collect()}
    assert got == {1: 0.25, 2: 0.5, 3: 1.0}
