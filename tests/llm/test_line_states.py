import numpy as np
import pytest

from tessella.llm.line_states import LineModel, LineStates, pieces, symbol, text_statistics
from tessella.llm.spam_pages import may_hold_units, spam_share

PROSE = "The keeper of the old tower watched the harbor while the rain fell on every roof. She had no lamp, but the moon was bright enough for both of them.\n"
KINDS = {
    "prose": (True, PROSE * 3),
    "plain": (True, (PROSE * 3).lower().replace(".", "").replace(",", "")),
    "german": (True, "Der Wächter öffnet das Tor, und die Mauer ist hoch. Das Tor ist nicht offen, denn der Schmied hat keine Zeit.\n" * 3),
    "short": (True, "lamp rope oil salt"),
    "list": (False, "\n".join(f"* {w} of Merin" for w in "lamp rope oil salt bread tower gate coin ring map".split())),
    "table": (False, "\n".join(f"| {i} | {i * 7} gp | {i}d6 | +{i} |" for i in range(20))),
    "index": (False, "\n".join(f"Silver gate {'.' * 12} {i}" for i in range(20))),
    "code": (False, "\n".join(f'<div class="x-{i}"> var a{i} = {{}};' for i in range(20))),
    "letters": (False, "Qzx wvlkj rtpq zxcv mnbv qwrt plkj hgfd zxcv bnmk. " * 6),
    "torn": (False, "T h e k e ep er o f t he o l d t ow er w a t c he d " * 4),
    "opened": (False, PROSE + "\n".join(f"{i:06x} a4f1 09cc 7d21 bb03" for i in range(60))),
}


@pytest.fixture(scope="module")
def result(spark):
    rows = [("t", i, x, "c", 1.0) for i, (_, x) in enumerate(KINDS.values())]
    rows += [("t", 100, None, None, None), ("t", 101, "", None, None), ("t", 102, "﻿\r\n \r\n", None, None), ("t", None, PROSE, None, None), rows[0]]
    rows += [("u", i, PROSE * (1 + i % 3), None, None) for i in range(100)]
    df = spark.createDataFrame(rows, "tbl string, id long, text string, codes string, n_words double")
    return {(r.tbl, r.id): r for r in text_statistics(df).collect()}


def test_verdicts(result):
    assert {k: result["t", i].is_prose for i, k in enumerate(KINDS)} == {k: v for k, (v, _) in KINDS.items()}


def test_empty_and_null_texts(result):
    for i in (100, 101, 102):
        r = result["t", i]
        assert r.is_prose and r.n_words == 0 and r.prose_share == 0 and r.mean_word_length == 0
    assert len(result) == len(KINDS) + 3 + 100


def test_statistics(result):
    r = result["t", 0]
    text = PROSE * 3
    words = text.replace(".", "").replace(",", "").split()
    assert r.n_words == len(words) and r.n_chars == len(text) and r.punctuated_line_share == 1
    assert r.mean_word_length == pytest.approx(sum(map(len, words)) / len(words))
    assert r.symbol_ratio == pytest.approx(sum(c in ".," for c in text) / len(text))
    assert abs(sum([r.prose_share, r.list_share, r.table_share, r.junk_share]) - 1) < 1e-9


def test_no_rows(spark):
    assert text_statistics(spark.createDataFrame([], "tbl string, id long, text string")).collect() == []


def test_posteriors_equal_the_sum_over_paths():
    model = LineModel(LineStates())
    codes = np.array([symbol(x)[0] for x in pieces(PROSE + "| 1 | 2 | 3 |\n* lamp\n", 18)])
    from itertools import product

    emit = np.exp(model.emissions(codes))
    want = np.zeros((len(codes), 4))
    for path in product(range(4), repeat=len(codes)):
        p = model.start[path[0]] * emit[0, path[0]]
        for t in range(1, len(codes)):
            p *= model.move[path[t - 1], path[t]] * emit[t, path[t]]
        for t, s in enumerate(path):
            want[t, s] += p
    want /= want.sum(axis=1, keepdims=True)
    got = model.posteriors(np.concatenate([codes, codes[:1]]), np.array([0, len(codes), len(codes), len(codes) + 1]))
    assert np.allclose(got[:-1], want, atol=1e-6)


def test_one_very_long_line():
    assert sum(1 for _ in pieces("word " * 200_000, 18)) > 10_000
    assert symbol("x" * 100_000)[1] == 1


SPAM = {
    "keywords": "cheap silver lamp buy silver lamp best silver lamp price silver lamp shop " * 6,  # no function words
    "sentences": "You can get the silver lamp and the silver lamp is here. " * 12,  # 0.30 of function words and more
    "links": "\n".join(f"https://site{i}.example/lamp{i}" for i in range(20)),
    "tags": " ".join(f"#lamp{'abcdefgh'[i % 8]}tag" for i in range(20)),
    "prices": "Lamp $4.50 rope $3.20 oil €7.10 bread 2.30 EUR, each of them in the old harbor. ",
    "prose": PROSE,
    "letters": KINDS["letters"][1],
    "code": KINDS["code"][1],
}


def test_spam_share_is_computed_outside_of_any_band_of_function_words(spark):
    rows = [("t", i, x) for i, x in enumerate(SPAM.values())]
    got = {r.id: r for r in text_statistics(spark.createDataFrame(rows, "tbl string, id long, text string")).collect()}
    for i, (kind, x) in enumerate(SPAM.items()):
        assert got[i].spam_share == pytest.approx(spam_share(x)), kind
        assert may_hold_units(x) or spam_share(x) == 0, kind
    assert got[0].common_word_share < 0.08 and got[0].spam_share > 0.9
    assert got[1].common_word_share >= 0.30 and got[1].spam_share > 0.3 and got[2].spam_share == 1 and got[5].spam_share == 0


def planted():
    """(is_prose, text): prose of four kinds, and garbled sentences in which short words of languages turn up by chance."""
    import random

    rng = random.Random(4)
    nouns, verbs = "keeper tower harbor river mason lamp gate guard smith market".split(), "watched opened found carried lit kept closed crossed sold built".split()
    sentence = lambda: f"The {rng.choice(nouns)} of the {rng.choice(nouns)} {rng.choice(verbs)} a {rng.choice(nouns)} near {rng.choice(['her', 'his', 'our'])} {rng.choice(nouns)}"
    letters = lambda n: "".join(rng.choice("etaoinsrhldcumfpgwybvkxjqz"[: rng.randrange(12, 26)]) for _ in range(n))
    chance = lambda: rng.choice("de ja on ne el to si os um".split()) if rng.random() < 0.16 else letters(rng.randrange(2, 10))
    rows = []
    for i in range(360):
        end = "." if i % 3 else ""
        rows.append((True, "\n".join((sentence() + ", and " + sentence().lower() + end) if i % 2 else sentence() + end for _ in range(rng.randrange(2, 7)))))
    for _ in range(120):
        rows.append((False, "\n".join(". ".join(" ".join(chance() for _ in range(10)).capitalize() for _ in range(2)) + "." for _ in range(rng.randrange(2, 6)))))
    for _ in range(60):
        rows.append((False, "\n".join(f"* {rng.choice(nouns)} of {rng.choice(nouns)}" for _ in range(12))))
    return rows


def wrong(spark, texts, p):
    df = spark.createDataFrame([("t", i, x) for i, (_, x) in enumerate(texts)], "tbl string, id long, text string")
    got = {r.id: r.is_prose for r in text_statistics(df, p).select("id", "is_prose").collect()}
    return sum(got[i] != w for i, (w, _) in enumerate(texts))


def test_learned_emissions_beat_the_hints(spark):
    texts = planted()
    hinted, learned = wrong(spark, texts, LineStates(rounds=0)), wrong(spark, texts, LineStates())
    assert learned <= 0.03 * len(texts) and hinted >= 3 * max(1, learned)


def test_the_sample_is_the_same_in_any_parts(spark):
    df = spark.createDataFrame([("t", i, x) for i, (_, x) in enumerate(planted())], "tbl string, id long, text string")
    p = LineStates(train_texts=100)
    got = [sorted(map(tuple, text_statistics(df.repartition(n), p).select("id", "prose_share").collect())) for n in (1, 9)]
    assert np.allclose(got[0], got[1], atol=1e-9)


def test_the_model_is_learned_from_all_texts(spark):
    df = spark.createDataFrame([("t", i, x) for i, (_, x) in enumerate(planted())], "tbl string, id long, text string")
    few, most = [sorted(map(tuple, text_statistics(df, LineStates(train_texts=n)).select("id", "prose_share").collect())) for n in (60, 8000)]
    assert np.allclose(few, most, atol=1e-9)


def test_expected_counts_add_up_over_parts_and_equal_the_sum_over_paths():
    from itertools import product

    texts = [PROSE + "| 1 | 2 | 3 |\n* lamp\n", "", "* lamp\n* rope\n", PROSE, "Qzx wvlkj rtpq\n| 4 | 5 |\n* lamp of Merin\n"]
    model = LineModel(LineStates())
    codes = [np.array([symbol(x)[0] for x in pieces(t, 18)], dtype=np.int32) for t in texts]
    moves, starts, marks = np.zeros((4, 4)), np.zeros(4), np.zeros((4, 4))
    for c in codes:
        emit = np.exp(model.emissions(c))
        paths = list(product(range(4), repeat=len(c))) if len(c) else []
        weights = [model.start[p[0]] * np.prod([model.move[a, b] for a, b in zip(p, p[1:])]) * np.prod([emit[t, s] for t, s in enumerate(p)]) for p in paths]
        for path, w in zip(paths, np.array(weights) / sum(weights)):
            starts[path[0]] += w
            for a, b in zip(path, path[1:]):
                moves[a, b] += w
            for t, s in enumerate(path):
                marks[s, (c[t] >> 11) & 3] += w
    sums = lambda cs: model.expected(np.concatenate(cs), np.cumsum([0, *map(len, cs)]))
    got = sums(codes)
    assert np.allclose(got[-4:], starts, atol=1e-6) and np.allclose(got[-20:-4].reshape(4, 4), moves, atol=1e-6)
    assert np.allclose(got[4 * 32 : 4 * 36].reshape(4, 4), marks, atol=1e-6)
    assert np.allclose(got, sum(sums([c]) for c in codes)) and np.allclose(got, sums(codes[:2]) + sums(codes[2:]))
