import random

import numpy as np
import pytest

from tessella.llm.spam_pages import Shape, SpamPages, chi_square, page_features, score_pages, spam_share

PROSE = "The keeper of the old tower watched the harbor while the rain fell on every roof near {}. She had no lamp, but the moon was bright enough for both of them, and nobody at the shop had a better one. "
rng = random.Random(1)
NAMES = [f"Mer{a}{b}" for a in "aeiou" for b in ("din", "loch", "wick", "vane", "gard")]
SPAM = {
    "keywords": "buy cheap dice tray online dice tray sale best dice tray shop order dice tray discount dice tray " * 4,
    "commas": ", ".join(f"silver rule book {n}" for n in NAMES),
    "tags": " ".join(f"#{n.lower()}rulebook" for n in NAMES),
    "links": "\n".join(f"* [{n} lamp](http://shop.{n.lower()}.example/item?id={i})" for i, n in enumerate(NAMES)),
    "anchors": " ".join(f'<a href="https://{n.lower()}.test/x">silver rule book store</a>' for n in NAMES),
    "labels": "\n".join(f"{n} Dice Tray SKU {rng.randrange(10**5)} ${rng.randrange(9)}.99 Add to cart" for n in NAMES),
    "german": "Rabatt kaufen Preis günstig bestellen Versand kostenlos Angebot " * 6,
    "opened": PROSE.format("Merin") + "token set online, cheap token set, token set shop, best token set, token set price, " * 6,
}
FINE = {
    "prose": PROSE * 4,
    "product": (PROSE + "Our table used the Merin rule book once, and the dice tray was on sale. ") * 3,
    "closing tags": PROSE * 3 + "\n\nTags: lamp, rope #harbor #tower",
    "annotated": "\n".join(f"* [{n} lamp](http://www.{n.lower()}.example/x): The keeper of this tower watched the harbor while it was raining on all of the roofs of the town." for n in NAMES[:8]),
    "index": "\n".join(f"{n} gate {'.' * 10} {i}" for i, n in enumerate(NAMES)),
    "inventory": "Inventory: " + ", ".join(f"{i} lamps of {n}" for i, n in enumerate(NAMES)),
    "prices": "\n".join(f"| {n} | {rng.randrange(90)} gp | {i}d6 |" for i, n in enumerate(NAMES)),
    "menu": "Home | Blog | Wiki | Search | Cart | Login | " + " | ".join(NAMES),
    "garbled": " ".join("".join(rng.choice("qzxwvrtplkjhmnb") for _ in range(rng.randrange(3, 9))) for _ in range(80)),
}


@pytest.fixture(scope="module")
def scored(spark):
    cases = [*SPAM.values(), *FINE.values()]
    rows = [(i, t, "en", 1.0) for i, t in enumerate(cases)]
    rows += [(1000 + i, PROSE.format(rng.choice(NAMES)) * (1 + i % 4), rng.choice(["en", None, "de"]), None) for i in range(400)]
    rows += [(5000, None, None, None), (5001, "", None, None), (5002, "buy now", None, None), (None, SPAM["tags"], None, None), rows[0]]
    df = spark.createDataFrame(rows, "id long, text string, lang string, density double")
    return {r.id: r for r in score_pages(df).collect()}


def test_spam_is_flagged_and_others_are_not(scored):
    names = [*SPAM, *FINE]
    got = {n: scored[i].is_spam for i, n in enumerate(names)}
    assert got == {n: n in SPAM for n in names}
    assert not any(r.is_spam for i, r in scored.items() if i >= 1000)


def test_short_empty_and_null_pages(scored):
    assert not {5000, 5001, 5002, None} & set(scored)


def test_empty_table(spark):
    assert score_pages(spark.createDataFrame([], "id long, text string, lang string")).collect() == []


def test_features_of_odd_texts():
    assert page_features(None)[0] == 0 and page_features("   ")[0] == 0
    assert 0 <= spam_share("x" * 100_000) <= 1 and 0 <= spam_share("buy now " * 20_000) <= 1
    for odd in ("#" * 500, "[](" * 500, "http://" * 300, "$1 " * 400):
        page_features(odd)


def test_whitening_gives_the_squared_distance():
    x = np.random.default_rng(1).normal(size=(500, 5)) @ np.diag([1, 2, 3, 4, 5.0])
    shape = Shape(x.mean(axis=0), np.cov(x.T))
    centre, white = shape.prepared()
    y = (x - centre) @ white
    want = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(shape.scatter), x - centre)
    assert np.allclose((y * y).sum(axis=1), want)
    assert abs(chi_square(5, 3.0902) - 20.515) < 0.3


FRENCH = "La gardienne de la tour regardait le port sous la pluie, et nous ne savions pas où elle avait posé la lampe de {}. "
#: Under half of the words are of offers or repeated, yet the page is far out in a direction of spam.
STUFFED = FRENCH.format("Merin") + ", ".join(f"{n} {'en prix' if i % 3 else 'pas cher'}, {n} promo en" for i, n in enumerate(NAMES)) + ". "
#: Most words stand in pairs that come again, but with a value each: a table.
VALUES = "\n".join(f"armor class {rng.randrange(10, 20)} hit points {rng.randrange(9, 90)} saving throw {rng.randrange(1, 9)}, {rng.randrange(1, 9)}" for _ in range(24))


def test_distance_and_direction_decide_and_not_a_share(spark):
    rows = [(i, t, "fr") for i, t in enumerate([STUFFED, VALUES, *FINE.values()])]
    rows += [(1000 + i, PROSE.format(rng.choice(NAMES)) * (1 + i % 4), "en") for i in range(300)]
    rows += [(2000 + i, FRENCH.format(rng.choice(NAMES)) * (1 + i % 4), "fr") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    got = {r.id: r for r in score_pages(df).collect()}
    assert got[0].is_spam and spam_share(STUFFED) < 0.5
    assert not got[1].is_spam and spam_share(VALUES) > 0.5
    spam = {i for i, r in got.items() if r.is_spam}
    assert spam == {0}
    without = {name: {r.id for r in score_pages(df, p).collect() if r.is_spam} - spam for name, p in (("direction", SpamPages(cosine=-1.0)), ("distance", SpamPages(distance=0.5)))}
    assert all(without.values())


def test_parts_change_nothing(spark):
    rows = [(i, t, None) for i, t in enumerate([*SPAM.values(), *FINE.values()])] + [(100 + i, PROSE.format(n) * (1 + i % 3), None) for i, n in enumerate(NAMES)]
    got = [{(r.id, r.is_spam) for r in score_pages(spark.createDataFrame(rows, "id long, text string, lang string").repartition(n)).collect()} for n in (1, 16)]
    assert got[0] == got[1]
