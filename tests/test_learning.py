import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.cleaning import Cleaning
from tessella.operators import answers, bpe, evaluation, guards, prompts, training
from tessella.plans import corpus
from tessella.sources import files, records, sinks
from tessella.streaming import conversations
from tests.help import one, rows, sets


def arr(spark, values, f, kind="array<int>"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_offsets_in_parts(spark):
    d = spark.createDataFrame([(i, (i * 7) % 13) for i in range(200)], "doc_id long, n long")
    got = {r.doc_id: (r.start_off, r.end_off) for r in rows(training.with_offsets(d, "n", "doc_id", part_rows=30))}
    end = 0
    for i in range(200):
        assert got[i] == (end, end := end + (i * 7) % 13)


def test_windows_stay_in_their_regions(spark):
    r = spark.createDataFrame([(1, 0, 20), (2, 20, 27), (3, 30, 36)], "region_id int, start long, end long")
    assert sets(training.windows(r, 6, 3)) == {(1, o) for o in range(0, 14, 3)} | {(2, 20)}
    docs = spark.createDataFrame([(1, 0, 9), (2, 9, 9), (3, 9, 40)], "doc_id int, start_off long, end_off long")
    at = training.windows(r, 6, 3).select("offset")
    assert sets(training.containing_document(at, docs, 8).select("offset", "doc_id")) == {(o, 1 if o < 9 else 3) for o in [*range(0, 14, 3), 20]}


@pytest.mark.parametrize("n, split", [(100_000, 0.1), (5000, 0.3), (300, 0.5)])
def test_block_split(n, split):
    b = training.block_split(n, split, 64)
    assert b[0][0] == 0 and b[-1][1] == n and all(x[1] == y[0] for x, y in zip(b, b[1:]))
    assert 0 < sum(v for *_, v in b) < len(b) and b == training.block_split(n, split, 64)


def test_tier_split(spark):
    d = spark.createDataFrame([(i, 1.0 if i < 100 else 2.0, 50) for i in range(140)] + [(500, 3.0, 900), (600, 4.0, 2), (601, 4.0, 2)], "doc_id long, weight double, n_tokens long")
    got = rows(training.tier_split(d, 0.1, 64))
    held = {w: sum(r.n_tokens for r in got if r.is_val and r.weight == w) for w in (1.0, 2.0, 3.0, 4.0)}
    assert held == {1.0: 500, 2.0: 200, 3.0: 0, 4.0: 0} and len(got) == 143


def test_samples(spark):
    d = spark.range(100)
    a, b = sets(training.exact_sample(d, 10, "id", seed=1)), sets(training.exact_sample(d, 10, "id", seed=2))
    assert len(a) == len(b) == 10 and a != b and a == sets(training.exact_sample(d, 10, "id", seed=1))
    assert one(training.exact_sample(d, 500, "id").agg(F.count("*"))) == 100
    assert one(training.example_split(d, 0.2, "id").agg(F.count_if("is_val"))) == 20 and one(training.example_split(d.limit(2), 0.99, "id").agg(F.count_if("is_val"))) == 1


def test_weighted_draws(spark):
    d = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 3.0)], "k long, w double")
    got = [r.k for r in rows(training.weighted_draws(d, "k", "w", 2000))]
    assert len(got) == 2000 and 1 not in got and 0.7 < got.count(3) / 2000 < 0.8
    for bad in ([(1, -1.0)], [(1, 0.0)], [(1, float("nan"))], [(1, None)], []):
        with pytest.raises(ValueError):
            training.weighted_draws(spark.createDataFrame(bad, "k long, w double"), "k", "w", 5)


def test_padding(spark):
    d = spark.createDataFrame([(1, [7, 8], [7, -100]), (1, [9], [9])], "batch int, ids array<int>, labels array<int>")
    assert {(tuple(r.ids), tuple(r.labels), tuple(r["mask"])) for r in rows(training.padded_batches(d, "batch"))} == {((7, 8), (7, -100), (1, 1)), ((0, 9), (-100, 9), (0, 1))}
    assert arr(spark, [[5, 6], [], [5, 6, 7, 8]], lambda c: training.pad_right(c, 4)) == [[1, 5, 6, 0], [1, 0, 0, 0], [1, 5, 6, 7]]
    assert arr(spark, [[1, 2, 3, 4, 5]], lambda c: training.shifted_targets(c, 4, 3)) == [[4, 5, -100, -100]]


def test_chat_examples(spark):
    f = lambda n: lambda c: training.chat_example(F.slice(c, 1, 2), F.slice(c, 3, 9), F.array().cast("array<int>"), n)
    (e,) = arr(spark, [[10, 11, 20, 21]], f(50))
    assert e.ids == [1, 4, 10, 11, 5, 20, 21] and e.labels == [-100] * 4 + [20, 21, 2]
    (e,) = arr(spark, [[10, 11, 20, 21, 22]], f(7))
    assert e.ids == [1, 4, 10, 11, 5, 20] and e.labels[-1] == 2
    assert arr(spark, [[10, 11], [10, 11, 20]], f(5))[0] is None
    g = lambda c: training.chat_example(F.slice(c, 1, 1), F.slice(c, 2, 1), F.array(F.lit(30)), 50)
    assert arr(spark, [[10, 20]], g)[0].ids == [1, 3, 30, 3, 4, 10, 5, 20]


def test_weights_and_schedules(spark):
    d = spark.createDataFrame([(0.5,), (-1.0,), (2.0,)], "loss double")
    w = [r.weight for r in rows(training.difficulty_weights(d, 1.0, 0.1))]
    assert sorted(w) == pytest.approx(sorted(x / (2.6 / 3) for x in (0.5, 0.1, 2.0)))
    rate = lambda s: one(spark.range(1).select(training.learning_rate(F.lit(s), 1.0, 0.1, 10, 110)))
    assert rate(0) == 0 and rate(5) == 0.5 and rate(10) == 1 and rate(60) == pytest.approx(0.55) and rate(110) == pytest.approx(0.1)
    assert [one(spark.range(1).select(training.model_preset(F.lit(n)))) for n in (1, 10**8, 5 * 10**8)] == ["small-25M", "medium-85M", "large-250M"]
    assert one(spark.range(1).select(training.tuning_steps(F.lit(111), 8, 2, adapter=True))) == round(111 * 8 / 16)


def test_grouped_batches(spark):
    p = spark.createDataFrame([(d, 10 * d + k) for d in range(6) for k in range(d)], "doc_id long, passage_id long")
    got = rows(training.grouped_batches(p, 2, 3, 5))
    assert len(got) == 5 * 3 * 2 and all(r.passage_id // 10 == r.doc_id and r.doc_id >= 2 for r in got)
    with pytest.raises(ValueError):
        training.grouped_batches(p, 1, 3, 5)


DUMP = """# How does the gate open?
Score: 12

Body

## Answer (accepted)  (score: 215)

With a key.
Second line.

## Answer  (score: -3)

It doesn't.

---

# Second question
Score: 1

## Answer  (score: 7)

Yes.

## Answer  (score: 2)

---
## Answer  (score: 5)
trailing"""


def test_dumps(spark):
    got = list(answers.dump_answers(DUMP))
    assert got == [("How does the gate open?", "With a key.\nSecond line.", 215, True), ("How does the gate open?", "It doesn't.", -3, False), ("Second question", "Yes.", 7, False), ("Second question", "trailing", 5, False)]
    d = spark.createDataFrame([(1, DUMP), (2, None), (3, "plain"), (4, "## Answer  (score: 5)\nno title")], "doc_id long, text string")
    assert {(r.doc_id, r.answer_no) for r in rows(answers.parse_dumps(d))} == {(1, k) for k in range(4)}


def pairs(spark):
    data = [(1, 1, "Q1?", "First answer that is long enough to keep.", 5, False), (2, 1, "Q1?", "Accepted answer that is long enough to keep.", 1, True), (3, 1, "Q1?", "Third answer that is long enough to keep.", None, None), (4, 2, "Q2?", "I think so. The gate opens toward the old tower.", -4, False), (5, 3, "Q3?", None, 9, True)]
    return spark.createDataFrame(data, "pair_id long, question_id long, question string, answer string, answer_score int, accepted boolean")


def test_answers(spark):
    assert {r.pair_id for r in rows(answers.filter_answers(pairs(spark)))} == {1, 2, 5} and {r.pair_id for r in rows(answers.filter_answers(pairs(spark), accepted_only=True))} == {2, 5}
    assert sets(answers.rank_answers(pairs(spark), 2).select("pair_id", "rank")) == {(2, 1), (1, 2), (5, 1)}
    assert sets(answers.context_choice(pairs(spark)).select("pair_id", "context_id")) == {(1, 2), (2, 1), (3, 2), (4, None), (5, None)}
    ft = {r.pair_id: (r.assistant, r.context) for r in rows(answers.finetune_examples(pairs(spark)))}
    assert ft[1] == ("First answer that is long enough to keep.", "Accepted answer that is long enough to keep.") and ft[4] == ("The gate opens toward the old tower.", "I think so. The gate opens toward the old tower.") and 5 not in ft
    blocks = {r.question_id: r.block for r in rows(answers.format_dump(pairs(spark), 1))}
    assert blocks[1] == "# Q1?\n\n## Answer (accepted)  (score: 1)\n\nAccepted answer that is long enough to keep.\n\n---" and blocks[2] == "# Q2?\n\n\n---"


def test_prompts(spark):
    assert arr(spark, [[5, 9, 3], [20], []], lambda c: prompts.pack_newest(c, F.lit(9))) == [[0, 2], [], []]
    assert arr(spark, [[7, 8, 9]], lambda c: prompts.single_prompt(F.slice(c, 1, 1), F.slice(c, 2, 2), 7)) == [[1, 3, 8, 3, 4, 7, 5]]
    assert arr(spark, [[7, 8, 9]], lambda c: prompts.single_prompt(F.slice(c, 1, 1), F.slice(c, 2, 2), 6)) == [[1, 4, 7, 5]]
    d = spark.createDataFrame([([([10], [11]), ([12, 12], [13])], [7], [8, 9])], "t array<struct<user:array<int>,assistant:array<int>>>, q array<int>, c array<int>")
    made = lambda n: one(d.select(prompts.conversation_prompt(F.col("t"), F.col("q"), F.col("c"), n)))
    assert made(50) == [1, 3, 8, 9, 3, 4, 10, 5, 11, 4, 12, 12, 5, 13, 4, 7, 5] and made(11) == [1, 4, 12, 12, 5, 13, 4, 7, 5] and made(4) == [1, 4, 7, 5]
    turns = spark.createDataFrame([(1, i, f"u{i}", f"a{i}") for i in range(30)], "conv long, at int, user string, assistant string")
    last = prompts.last_turns(turns, "conv", ["at"])
    assert sets(last.select("turn", "user")) == {(i - 9, f"u{i}") for i in range(10, 30)} and one(prompts.role_messages(last, "turn").agg(F.count("*"))) == 40
    hint = lambda q: tuple(spark.createDataFrame([(q,)], "q string").select(*prompts.generation_hints(F.col("q"), F.lit(0.7), F.lit(200))).first())
    assert hint("What is it") == (0.5, 256) and hint("listen to " + "x " * 10) == (0.7, 200) and hint("design " + "x " * 60) == (0.9, 128)


def test_guards(spark):
    assert guards.looping_tokens([1, 2, 1, 2]) == {1} and guards.looping_tokens([5, 5]) == {5} and guards.looping_tokens([1, 2, 3]) == set() and guards.looping_tokens([]) == set()
    assert guards.looping_tokens([1, 9, 1, 8], match=0.5) == {1} and guards.looping_tokens([9, 1, 8, 1], match=0.5) == set()
    bounded = arr(spark, ["", "3", "31", "30", "300", "x"], lambda c: guards.integer_prefix(c, 30), "string")
    assert bounded == [True, True, False, True, False, False]
    assert arr(spark, ["6,4", "6400", "1,", ",1"], lambda c: guards.integer_prefix(c, commas=True), "string") == [True, False, True, False]
    assert arr(spark, ["", "1/", "31", "3"], guards.rating_prefix, "string") == [True, True, False, True]
    got = [tuple(r) for r in arr(spark, ["AC: 1", "CR 1/", "AC 18 HP: 45", "AC: 99", "none", None], guards.active_field, "string")]
    assert got == [("armor", "1"), ("rating", "1/"), ("hit_points", "45"), (None, None), (None, None), (None, None)]
    x = [2.0, -1.0, 0.5, 2.0]
    assert arr(spark, [x], lambda c: guards.keep_top_k(c, 1), "array<double>")[0] == [2.0, -math.inf, -math.inf, 2.0]
    assert arr(spark, [x], lambda c: guards.repetition_penalty(c, F.array(F.lit(0), F.lit(1)), 2.0), "array<double>")[0] == [1.0, -2.0, 0.5, 2.0]
    assert arr(spark, [[3.0, 0.0, 2.0]], lambda c: guards.keep_top_p(c, 0.6), "array<double>")[0] == [3.0, -math.inf, -math.inf]
    assert arr(spark, [[1.0, 1.0], [50.0, 0.0]], lambda c: guards.entropy_temperature(c), "array<double>") == pytest.approx([0.5, 1.3])


def test_evaluation(spark):
    e = spark.createDataFrame([(1, "The Gate and tower", ["gate", "TOWER", "lamp"]), (2, None, []), (3, "x", None)], "query_id long, passage string, keywords array<string>")
    assert [round(r[0], 3) for r in rows(e.orderBy("query_id").select(evaluation.keyword_recall(F.col("passage"), F.col("keywords"))))] == [0.667, 1.0, 1.0]
    items = spark.createDataFrame([(1, ["gate"]), (2, ["lamp"]), (3, ["gate", "tower"]), (4, [])], "query_id long, keywords array<string>")
    found = spark.createDataFrame([(1, "gate"), (3, "The Gate"), (3, "tower")], "query_id long, passage string")
    assert tuple(evaluation.hit_rate(found, items).first()) == (3, 2, 0.6667)
    assert math.isnan(evaluation.hit_rate(found, items.limit(0)).first().hit_rate)
    assert evaluation.window_f1("a b c d".split(), "b c".split()) == 1 and evaluation.window_f1([], ["a"]) == 0
    assert evaluation.answer_f1("the answer is +3 gold", "gold +3", "what is the answer") == 1 and evaluation.answer_f1("1/4", "1/8", "q") == 0 and evaluation.answer_f1("gate", "gate", "gate") == 1
    rng = np.random.default_rng(1)
    for _ in range(50):  # against all windows
        from collections import Counter

        p, r = ([str(x) for x in rng.integers(0, 6, n)] for n in (12, 5))
        want = max((2 * sum((Counter(p[i:j]) & Counter(r)).values()) / (j - i + len(r)) for i in range(12) for j in range(i + 1, 13)), default=0)
        assert evaluation.window_f1(p, r) == pytest.approx(want)
    assert evaluation.bootstrap_halfwidth([1.0]) == 0 and 0 < evaluation.bootstrap_halfwidth([1.0, 2.0, 3.0]) < 2
    assert evaluation.stopping_point([[3.0] * 5, [2.0] * 5, [2.0] * 5, [], [2.0] * 5, [2.0] * 5]) == 4 and evaluation.stopping_point([[3.0], [2.0]]) is None
    assert evaluation.suggested_rate([1e-4, 1e-3, 1e-2, 1e-1], [5, 4.9, 2, 1.5])[0] == 1e-2 and evaluation.suggested_rate([1], [1]) is None
    losses = spark.createDataFrame([(math.log(2.0) * 4, 4)], "loss_sum double, n_tokens long")
    assert tuple(evaluation.loss_summary(losses).first()) == (2.0, 1.0, 0.6931, 4) and math.isnan(evaluation.loss_summary(losses.limit(0)).first().mean_loss)


def test_plan(spark):
    prose = "The keeper of the old tower watched the harbor while the rain fell on every roof and the lamps went out {}. " * 4
    d = spark.createDataFrame([(1, prose.format(*"abcd"), "rules"), (2, prose.format(*"abcd") + "and a longer end", "x"), (3, "junk", "x"), (4, None, "x")], "doc_id long, text string, source string")
    made = corpus.prepare(d, corpus.CorpusPlan(weights=[("x", 2.0)]))
    got = rows(made.tokens)
    assert [(r.doc_id, r.weight, r.start_off) for r in got] == [(2, 2.0, 0)] and {r.doc_id for r in rows(made.dropped)} == {3, 4}
    coded = corpus.prepare(d, corpus.CorpusPlan(None, None, bpe.learn({"the": 3}, 263))).tokens
    assert {r.doc_id: r.ids[-1] for r in rows(coded)} == {i: 2 for i in (1, 2, 3, 4)}
    w = rows(corpus.weighted_windows(made.tokens, 16, 8))
    assert w and all(r.doc_id == 2 and r.weight == 2.0 for r in w)


def _docx(path, paragraphs):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')


def _xlsx(path):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Loot" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><t>lamp</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>gp</t></is></c></row><row r="2"/><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><v>7</v></c></row></sheetData></worksheet>')


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"plain  text \xff")
    (tmp_path / "a.md").write_text("# Head\n**bold**")
    (tmp_path / "page.html").write_text("<body><nav>n</nav><p>body</p></body>")
    (tmp_path / "skip.bin").write_text("x")
    (tmp_path / "broken.docx").write_text("no zip")
    _docx(tmp_path / "d.docx", ["one", " ", "two"])
    _xlsx(tmp_path / "x.xlsx")
    got = {r.path.rpartition("/")[2]: r for r in rows(files.read_files(spark, str(tmp_path), level=Cleaning.STANDARD))}
    assert set(got) == {"a.txt", "a.md", "page.html", "broken.docx", "d.docx", "x.xlsx"}
    assert got["a.txt"].text == "plain text �" and got["a.md"].text == "Head\nbold" and got["page.html"].text == "body" and got["d.docx"].text == "one\n\ntwo"
    assert got["x.xlsx"].text == "## Loot\n\n| name | | gp |\n| --- | --- | --- |\n| lamp | | 7 |" and got["broken.docx"].error and got["broken.docx"].text is None
    assert {got["a.txt"].stem, got["a.md"].stem} == {"a", "a_txt"}
    assert [r.doc_idx for r in rows(files.read_texts(spark, [str(tmp_path)]))] == [0]
    with pytest.raises(FileNotFoundError):
        (tmp_path / "empty").mkdir()
        files.read_texts(spark, [str(tmp_path / "empty")])
    with pytest.raises(ValueError):
        files.ending("x.pdf")


def test_records(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"user": "q", "assistant": "a"}\n\n{"prompt": "p", "response": "r", "context": "c"}\nnot json\n{"user": "q"}\n')
    got = [(r.user, r.assistant, r.error) for r in rows(records.read_chat_jsonl(spark, str(tmp_path / "c.jsonl")))]
    assert got == [("q", "a", None), ("p", "r", None), (None, None, "not JSON"), ("q", None, "no assistant")]
    (tmp_path / "p.xml").write_text('<posts><row Id="1" PostTypeId="1" Score="5" Title="T" Body="b" Tags="&lt;x&gt;&lt;y&gt;" AcceptedAnswerId="3"/><row Id="2" PostTypeId="2" ParentId="1" Score="2" Body="a"/><row Id="3" PostTypeId="2" ParentId="1" Body="c"/><row Id="4" PostTypeId="1" Score="0" Title="U"/></posts>')
    q = rows(records.answered_questions(records.read_post_archive(spark, str(tmp_path / "p.xml")), 1))
    assert {(r.title, r.tags, r.answer_id, r.answer_score) for r in q} == {("T", "x y", "2", 2), ("T", "x y", "3", 0)}
    (tmp_path / "cat.csv").write_text("Text#,Type,Language,Subjects,Bookshelves\n1,Text,en,Myths; Gods,\n2,Sound,en,Myths,\n3,Text,de,Myths,\n4,Text,en,Cooking,Fantasy shelf\n")
    assert {r["Text#"] for r in rows(records.read_catalogue(spark, str(tmp_path / "cat.csv"), ["MYTH", "fantasy"]))} == {"1", "4"}
    authors = "".join(f"<author><name>N{i}</name></author>" for i in range(7))
    (tmp_path / "f.xml").write_text(f'<feed><entry><id>http://x/abs/cs/01</id><title>A\n  B</title><summary>s  t</summary><published>2024-05-06T00:00:00Z</published>{authors}<category term="cs.X"/></entry></feed>')
    assert one(records.paper_text(records.read_feed(spark, str(tmp_path / "f.xml"))).select("text")) == "# A B\nAuthors: N0; N1; N2; N3; N4; N5 et al. (7 authors)\nCategories: cs.X\nPublished: 2024-05-06\nSource: arXiv (cs_01)\n\ns t\n"
    md = spark.createDataFrame([(1, "lead\n# One Two\r\ntext\nThree\n=====\nmore\n## sub")], "doc_id long, text string")
    parts = records.sections(md)
    assert [(r.section_no, r.slug, r.content) for r in rows(parts.orderBy("section_no"))] == [(0, "one_two", "# One Two\ntext\n"), (1, "three", "Three\n=====\nmore\n## sub")]
    assert [r.slug for r in rows(records.kept_sections(parts, ["one t"]))] == ["one_two"]
    wiki = spark.createDataFrame([(1, "Lead text\n== A ==\nbody\n=== B ===\n\n== C ==\nc")], "doc_id long, text string")
    assert sets(records.wiki_sections(wiki).select("title", "content")) == {("Lead_Introduction", "Lead text"), ("A", "body"), ("C", "c")}
    f = spark.createDataFrame([("i", "a.txt"), ("i", "b_djvu.txt"), ("j", "x.pdf"), ("j", "y.txt")], "item string, name string")
    assert sets(records.preferred_file(f, "item", "name")) == {("i", "b_djvu.txt"), ("j", "y.txt")}
    new = spark.createDataFrame([("k1", "x" * 600), ("k2", "x"), ("k3", "x" * 600)], "k string, text string")
    assert [r.k for r in rows(records.new_texts(new, spark.createDataFrame([("k3",)], "k string"), "k", header=F.col("k")))] == ["k1"]
    assert one(spark.range(1).select(records.count_of(F.lit("Dice and dragons"), ["dice", "dragon", "x"]))) == 2


def test_shards_prune_columns(spark, tmp_path):
    spark.sql("select 1L QId, 'T' Title, 'B' Body, 5 Score, 2L AcceptedAnswerId, 'x' Tags, array(named_struct('Id', 2L, 'Body', 'a', 'Score', 1)) Answers, 'big' Extra").write.parquet(str(tmp_path / "s"))
    df = records.read_qa_shards(spark, str(tmp_path / "s"), 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Extra" not in plan and "GreaterThanOrEqual(Score,3)" in plan and one(df.select("answer.Body")) == "a"


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "n int, text string")
    assert sets(sinks.chunked(d, 2, "n").select("n", "file_no")) == {(i, i // 2) for i in range(5)}
    sinks.write_chunks(d, "text", 2, "n", str(tmp_path / "c"), "part")
    assert {p.name for p in (tmp_path / "c").iterdir() if p.is_dir()} == {"name=part_0000", "name=part_0001", "name=part_0002"}
    sinks.write_jsonl(d, str(tmp_path / "j"))
    sinks.write_jsonl(d, str(tmp_path / "j"), append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 10
    sinks.save_index(d, d.select("text"), str(tmp_path / "i"), version=2)
    index, sources, facts = sinks.load_index(spark, str(tmp_path / "i"))
    assert index.count() == sources.count() == 5 and facts == {"version": 2}
    assert sinks.write_report({"a": d.agg(F.count("*").alias("n"))}, str(tmp_path / "r")) == {"a": {"n": 5}}


def _stream(spark, path, schema, f, mode, name):
    q = f(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return rows(spark.table(name))


def test_streams(spark, tmp_path):
    turns = spark.createDataFrame([(c, t, f"u{t}", f"a{t}") for c in (1, 2) for t in range(30)], "conv_id long, turn long, user string, assistant string")
    turns.repartition(3).write.parquet(str(tmp_path / "t"))
    got = _stream(spark, str(tmp_path / "t"), turns.schema, conversations.rolling_history, "update", "turns")
    last = {c: max((r for r in got if r.conv_id == c), key=lambda r: (r.n_turns, r.history.split("\n")[0][1:].split("\t")[0].zfill(3))) for c in (1, 2)}
    assert all(r.n_turns == 20 and r.history.split("\n")[0] == "u10\ta10" and r.history.split("\n")[-1] == "u29\ta29" for r in last.values())
    v = bpe.learn({"é": 1}, 262)
    ids = v.encode("aé🙂b")
    spark.createDataFrame([(1, k, i) for k, i in enumerate(ids)], "reply_id long, pos long, id int").coalesce(1).write.option("maxRecordsPerFile", 2).parquet(str(tmp_path / "d"))
    parts = _stream(spark, str(tmp_path / "d"), "reply_id long, pos long, id int", lambda s: conversations.decode_stream(s, v), "update", "decoded")
    assert "�" not in "".join(r.text for r in parts) and sorted("".join(r.text for r in parts)) == sorted("aé🙂b")
    spark.createDataFrame([(1, "x")], "id long, text string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        conversations.refresh_stream(spark, str(tmp_path / "in"), "id long, text string", lambda b: b.filter("id > 0"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
