import random

import pytest

from tessella.llm.leaks import Leaks, best_piece, find_leaks, necessary_prefix

WORDS = [f"w{i}" for i in range(400)]


def passage(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def dressed(rng, words):
    return "  \n".join(rng.choice([w, w.upper(), f"**{w}**", f"“{w},”"]) for w in words)


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(3)
    items = {i: passage(rng, rng.randrange(20, 80)) for i in range(40)}
    docs, want = [], set()
    for d in range(200):
        body = passage(rng, rng.randrange(0, 120))
        if d % 4 == 0:
            i = rng.randrange(40)
            n = len(items[i])
            share = rng.choice([0.3, 0.6, 0.75, 1.0])
            m = round(n * share)
            start = rng.randrange(0, n - m + 1)
            piece = list(items[i][start : start + m])
            for k in range(0, max(0, m // 12)):
                at = 6 + 11 * k
                if k % 2:
                    piece.insert(at, "added")
                else:
                    piece[at] = "changed"
            at = rng.randrange(0, len(body) + 1)
            body = body[:at] + piece + body[at:]
            if share > 0.5:
                want.add((d, i))
        docs.append((d, dressed(rng, body), "s", 1))
    docs += [(900, None, None, 1), (901, "", None, 1), (None, " ".join(items[0]), None, 1), docs[0], docs[4]]
    rows = [(i, " ".join(w), "k") for i, w in items.items()] + [(50, None, "k"), (51, "", "k"), (52, "only four words here", "k"), (0, " ".join(items[0]), "other")]
    return spark.createDataFrame(docs, "id long, text string, source string, item long"), spark.createDataFrame(rows, "item long, passage string, id string"), want


def test_finds_the_planted_pieces(case):
    docs, items, want = case
    got = find_leaks(docs, items).collect()
    assert {(r.id, r.item) for r in got} == want and len(got) == len(want)


def test_blocks_of_items_give_the_same(case):
    docs, items, want = case
    assert {(r.id, r.item) for r in find_leaks(docs, items, Leaks(items_per_block=7)).collect()} == want


def test_blocks_of_long_passages_give_the_same(case):
    docs, items, want = case
    assert {(r.id, r.item) for r in find_leaks(docs, items, Leaks(chars_per_block=900)).collect()} == want


def test_empty_tables(spark, case):
    docs, items, _ = case
    assert find_leaks(docs.limit(0), items).collect() == [] and find_leaks(docs, items.limit(0)).collect() == []


def test_prefix_meets_every_damaged_piece():
    rng = random.Random(1)
    for _ in range(300):
        n, m, e = 3, rng.randrange(10, 25), rng.randrange(0, 3)
        words = passage(rng, rng.randrange(m, 50))
        grams = [hash(tuple(words[i : i + n])) for i in range(len(words) - n + 1)]
        prefix = necessary_prefix(grams, m, e, n, {g: rng.randrange(50) for g in grams})
        start = rng.randrange(0, len(words) - m + 1)
        piece = words[start : start + m]
        for at in rng.sample(range(m), e):
            piece[at] = "damaged"
        assert {hash(tuple(piece[i : i + n])) for i in range(m - n + 1)} & prefix


def test_piece_at_the_start_of_a_text(spark):
    item = " ".join(f"a{i}" for i in range(40))
    docs = spark.createDataFrame([(1, " ".join(item.split()[15:]) + " and more"), (2, " ".join(item.split()[25:]))], "id long, text string")
    got = find_leaks(docs, spark.createDataFrame([(7, item)], "item long, passage string")).collect()
    assert [(r.id, r.item) for r in got] == [(1, 7)]


def test_alignment_counts_errors():
    import numpy as np

    item = np.arange(30)
    damaged = np.array([0, 1, 99, 3, 98, 5, 97, 7, 96, 9, 95, 11, 94, 13, 93, 15])
    assert best_piece(item, np.arange(5, 25), 15, 0.1) and not best_piece(item, damaged, 15, 0.1)
    assert best_piece(item, np.concatenate([np.arange(0, 10), [99], np.arange(10, 20)]), 18, 0.1)
