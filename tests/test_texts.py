import pytest
from pyspark.sql import functions as F

from tessella.functions import arithmetic, cleaning, game_text, html_text, stemming, text_rules
from tessella.operators import quality
from tests.help import one, rows


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


ODD = ["", " ", "Éa x² _a1 ½ éx", "a\r\nb\rc\x0bd\x85e f\n", " x　", "\n\n", "a\n", "\x1cz\x1f", "tab\tnew\nline"]


def test_text_rules_equal_python(spark):
    assert col(spark, ODD, text_rules.strip) == [x.strip() for x in ODD]
    assert col(spark, ODD, text_rules.lines) == [x.splitlines() for x in ODD]
    assert col(spark, ODD, text_rules.tokens) == [x.split() for x in ODD]
    assert col(spark, [None], text_rules.strip) == [None]


def test_runs(spark):
    got = col(spark, [["a", "b", "c"], ["a"], []], lambda c: F.transform(text_rules.runs(c, 2), lambda z: F.concat(z["r0"], z["r1"])), "array<string>")
    assert got == [["ab", "bc"], [], []]


@pytest.mark.parametrize("level, text, want", [
    ("standard", "a\n\n\n\nb", "a\n\nb"), ("standard", "a  \t b", "a b"), ("standard", "  ab \n", "ab"), ("minimal", "a\n\n\n\nb  c", "a\n\n\n\nb  c"), ("minimal", "ﬁ ½", "fi 1⁄2"),
    ("thorough", "Short line\nThis line has enough words here\n\nok", "This line has enough words here"), ("thorough", "One two three four\n\nOne two three four\n\nfive six seven eight", "One two three four\n\nfive six seven eight"), ("standard", "", ""),
])
def test_cleaning(spark, level, text, want):
    assert col(spark, [text, None], lambda c: cleaning.clean(c, cleaning.Cleaning(level))) == [want, None]


def test_markup(spark):
    md = "# Head\n**bold** and *it* [link](http://x) ![img](y.png) `code`\n> quote\n---\nend"
    assert col(spark, [md], cleaning.strip_markdown) == ["Head\nbold and it link img code\nquote\n\nend"]
    wiki = "{{box|a}}== Gate ==\n[[File:x.png]]The [[tower|old tower]] and [http://x site]<ref>no</ref>\n{| table\n|-\n''end''"
    assert col(spark, [wiki], cleaning.strip_wikitext) == ["Gate\nThe old tower and siteno\n\nend"]
    dump = "# Title\nTags: a b\nScore: -3\n\nBody\n\n## Answer (accepted)  (score: 4)\n\nYes.\n\n---\n"
    assert col(spark, [dump], cleaning.strip_qa_scaffold) == ["Title\n\nBody\n\nYes.\n"]
    assert col(spark, ["A\x0cDRAGON 12\nkeep\n 33 \n-----x\x01"], cleaning.clean_scanned_pages) == ["A\n\nkeep\n\nx"]
    book = "intro\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n\nText\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\nmore"
    assert col(spark, [book, "plain"], cleaning.strip_book_frame) == ["Text", "plain"]
    assert col(spark, ["Next: b\nkeep\nHome : a"], cleaning.strip_wiki_navigation) == ["\nkeep\n"]
    assert col(spark, ["Some [ edit ] {{x}} [[a|b]]"], cleaning.strip_wiki_remnants) == ["Some   b"]


def test_names_and_formats(spark):
    urls = ["https://host.com/a/b c.html?q=1#f", "http://HOST.com/", "https://x.org/read.MD", "nonsense"]
    assert col(spark, urls, cleaning.url_file_name) == ["a_b_c.html", "host.com", "read.MD", "page"]
    assert col(spark, urls, cleaning.url_is_markdown) == [False, False, True, False]
    assert col(spark, [1, 2, 3, 4, 11, 12, 13, 20, 21, 101, 111], cleaning.ordinal, "int") == "1st 2nd 3rd 4th 11th 12th 13th 20th 21st 101st 111th".split()
    assert col(spark, [0.125, 0.25, 0.5, 3.0, 2.75], cleaning.challenge_rating, "double") == ["1/8", "1/4", "1/2", "3", "2.75"]
    assert col(spark, ["Monster Manual (2025)", "Baldur's Gate_ X"], cleaning.slug) == ["monster_manual_2025", "baldur_s_gate_x"]
    assert col(spark, ["<a><b-c>", ""], cleaning.tag_words) == ["a b-c", ""]
    table = [[["h", "i"], ["", "x\ny"], [None, None], ["z"]], [[""]], []]
    assert col(spark, table, cleaning.pipe_table, "array<array<string>>") == ["| h | i |\n| --- | --- |\n|   | x y |\n| z |   |", "", ""]


def test_weights(spark):
    rules = cleaning.parse_weight_rules("# c\n\nrules_*:1.5\na[bc]?.txt:0.5\n*x:2")
    assert rules == [("rules_*", 1.5), ("a[bc]?.txt", 0.5), ("*x", 2.0)]
    assert col(spark, ["rules_x", "abz.txt", "adz.txt", "box", ""], lambda c: cleaning.weight_by_glob(c, rules)) == [1.5, 0.5, 1.0, 2.0, 1.0]
    with pytest.raises(ValueError):
        cleaning.parse_weight_rules("no weight")


def test_html():
    page = "<html><head><script>x</script></head><body>out<nav>menu</nav><main>A&amp;B<br>c<style>s</style></main><article>art</article></body></html>"
    assert html_text.page_text(page) == "A&B\nc"
    assert html_text.page_text("<body>one<article>two</article><article>three</article></body>") == "two"
    assert html_text.page_text("<p>no body") == "no body" and html_text.page_text(None) == ""
    assert html_text.fragment_text("<p>a</p>\n\n\n\n<p>b") == "a\n\nb"


def test_game_text():
    assert game_text.resolve("{@atk mw,rw} {@hit 5} {@h}{@dice 1d6|x} {@scaledamage 1|2|3} {@dc 12} {@recharge} {@recharge 5} {@chance 30} {@b bold}") == "Melee Weapon Attack: or Ranged Weapon Attack: +5 Hit: 1d6 3 DC 12 (Recharge 6-6) (Recharge 5-6) 30% bold"
    blocks = [{"type": "list", "items": ["a", {"name": "N", "entry": "e"}, {"name": "M", "entries": ["s"]}]}, {"type": "table", "caption": "C", "colLabels": ["x", "y"], "rows": [["1", "2"]]}, {"name": "Sec", "entries": ["t"]}, 5]
    assert [x for b in blocks for x in game_text.block_lines(b)] == ["- a", "- N: e", "- M", "s", "C", "x | y", "1 | 2", "Sec", "t"]


@pytest.mark.parametrize("word, want", [("grappling", "grappl"), ("D&D", "d&d"), ("AC", "ac"), ("creature", "creatur"), ("loses", "lose"), ("its", "it"), ("speed", "speed"), ("ponies", "poni"), ("ties", "tie"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("happy", "happi"), ("skies", "sky"), ("dying", "die"), ("generalization", "gener"), ("oscillators", "oscil"), ("agreed", "agre"), ("filing", "file"), ("enjoy", "enjoy"), ("controll", "control"), ("rational", "ration"), ("adoption", "adopt")])
def test_stems(word, want):
    assert stemming.stem(word) == want


def test_stems_of_texts(spark):
    assert col(spark, ["A grappled creature loses its speed.", "", None], stemming.stems) == [["grappl", "creatur", "lose", "it", "speed"], [], None]


@pytest.mark.parametrize("expression, want", [("2 + 3 * 4", "14"), ("2 ^ 10", "1024"), ("7 // 2", "3"), ("-7 % 3", "2"), ("sqrt(144)", "12"), ("1/3", "0.333333"), ("factorial(5)", "120"), ("pi", "3.14159"), ("max(1, 5, 3)", "5"), ("norm_cdf(0)", "0.5"), ("inf", "inf"), ("6 × 7 ÷ 2", "21")])
def test_arithmetic(expression, want):
    assert arithmetic.evaluate(expression) == (want, None)


@pytest.mark.parametrize("expression", ["__import__('os')", "1/0", "x + 1", "'a'", "(lambda: 1)()", "9**9**9**9", "sqrt(-1)", "1 +", "True", "[1]", "abs.__class__", "round(1, ndigits=2)"])
def test_refused_arithmetic(expression):
    result, error = arithmetic.evaluate(expression)
    assert result is None and error


def test_questions_and_tags():
    assert arithmetic.answered("What is 25% of 1200?") == "25 % of 1200 = 300"
    assert arithmetic.answered("roll 2d6 + 3") is None and arithmetic.answered("tell me about 5") is None and arithmetic.answered(None) is None
    assert arithmetic.answered("12 * 4") == "12 * 4 = 48"
    assert arithmetic.with_results("so <TOOL:python>2 + 7</TOOL>, <TOOL:python>1/0</TOOL>") == "so 2 + 7 = 9, 1/0 [error: division by zero]"


PROSE = "The keeper of the old tower watched the harbor while the rain fell on every roof and the lamps went out one by one. " * 4
CASES = [
    (PROSE, True, ""), ("too short", False, "only 9 chars"), ("12345 67890 " * 60, False, "alpha ratio"), ("§§ ¶¶ word " * 60, False, "symbol ratio"), ("abcdefghij" * 4 + " " + ("abcdefghijklmnopqrstuvwxyz" * 2 + " ") * 60, False, "mean word length"),
    ("\n".join(["Home"] * 90 + ["About us"] * 60), False, "short-line ratio"), ("does does does " * 60, False, "3-gram"), (None, False, "only 0 chars"), ("", False, "only 0 chars"),
]


def test_quality(spark):
    df = spark.createDataFrame([(i, t, "e") for i, (t, _, _) in enumerate(CASES)], "doc_id int, text string, reasons_old string")
    got = rows(quality.quality_reports(df).orderBy("doc_id"))
    for r, (_, keep, reason) in zip(got, CASES):
        assert r.is_kept == keep and (not reason or any(reason in x for x in r.reasons)), (r.reasons, reason)
    assert got[0].top_ngram_repetition_ratio == pytest.approx(4 / 94)
    assert [r.doc_id for r in rows(quality.kept_documents(df))] == [0]
    assert one(quality.quality_reports(df.limit(0)).agg(F.count("*"))) == 0


def test_game_tags_takes_whole_texts(spark, tmp_path):
    from tessella.queries.texts import game_tags

    texts = ["word " * 400 + "{@dc 15} and {@item rope|phb}", "{@h}" + "x" * 5000 + "{@chance 30}\nend {@damage 2d6}", "no tag", None]
    spark.createDataFrame([(i, x, "s", "f") for i, x in enumerate(texts)], "doc_id long, text string, source string, file_name string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.plain for r in game_tags(spark, str(tmp_path)).collect()}
    plain = ["word " * 400 + "DC 15 and rope", "Hit: " + "x" * 5000 + "30%\nend 2d6", "no tag", ""]
    assert got == {i: f"Melee Weapon Attack: or Ranged Weapon Attack: +{i} 3d6 s {x}" for i, x in enumerate(plain)}
