"""Known values of single functions."""

import math

import pytest
from pyspark.sql import functions as F

from evidentia.functions import parse, text
from evidentia.operators import calibration, confidence, retrieval, scoring, training
from evidentia.operators.aggregate import bucket, tool_needed
from evidentia.operators.chunking import windows
from evidentia.operators.retrieval import Bm25Index


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def strings(*xs):
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


def test_forms(spark):
    assert value(spark, text.trivia_form(F.lit("The Great Gatsby."))) == "great gatsby"
    assert value(spark, text.trivia_form(F.lit("A bird in HAND"))) == "bird in hand"
    assert value(spark, text.compatible_form(F.lit("Ｔｈｅ Ⅱ"))) == "ii"
    assert value(spark, text.compatible_form(F.lit(None).cast("string"))) == ""
    assert value(spark, text.reward_form(F.lit("A_b, the C!"))) == "a_b the c"
    assert value(spark, text.dedupe_key(F.lit("Answer: U.S.A.\nmore"))) == "usa"
    assert value(spark, text.split_aliases(F.lit("Washington, D.C.|Washington DC"))) == ["Washington, D.C.", "Washington DC"]
    assert value(spark, text.slug(F.lit(" a b//c "))) == "a-b-c" and value(spark, text.slug(F.lit("!!"))) == "unnamed"


@pytest.mark.parametrize("p, golds, em", [("paris.", ["Paris"], 1), ("rome", ["Paris"], 0)])
def test_exact_any(spark, p, golds, em):
    assert value(spark, scoring.exact_any(F.lit(p), strings(*golds))) == em


@pytest.mark.parametrize(
    "p, golds, f1",
    [("Paris", ["Paris"], 1.0), ("apple", ["orange"], 0.0), ("the Eiffel Tower in Paris", ["Eiffel Tower"], 2 / 3), ("apple pie", ["banana", "apple"], 2 / 3), ("", [], 1.0), ("", ["a b"], 0.0)],
)
def test_f1_any(spark, p, golds, f1):
    assert value(spark, scoring.f1_any(F.lit(p), strings(*golds))) == pytest.approx(f1)


def test_other_scores(spark):
    assert value(spark, scoring.f1_reward(F.lit("no"), F.lit("no it is not"))) == 0.0
    assert value(spark, scoring.f1_reward(F.lit("no"), F.lit("no it is not"), floor=False)) == pytest.approx(0.4)
    assert value(spark, scoring.exact_alias(F.lit("the obama"), F.lit("Barack Obama|Obama"))) == 1.0
    assert value(spark, scoring.exact_alias(F.lit("Biden"), F.lit("Barack Obama|Obama"))) == 0.0
    assert value(spark, scoring.exact_alias(F.lit(""), F.lit("x"))) == 0.0


@pytest.mark.parametrize("n, name", [("0", "1-9"), ("7", "1-9"), ("49", "10-49"), ("50", "50-99"), ("9999", "5000+"), ("x", "1-9"), (None, "1-9")])
def test_buckets(spark, n, name):
    assert value(spark, bucket(F.lit(n).cast("string"))) == name


def test_tool_needed(spark):
    assert value(spark, tool_needed(F.lit(7))) and not value(spark, tool_needed(F.lit(150))) and value(spark, tool_needed(F.lit("x")))


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "q1", "The Eiffel Tower is in Paris."), (1, "q1", "Notre Dame is also in Paris."), (2, "q2", "The Great Wall is in China.")], "doc int, q string, t string")
    ask = spark.createDataFrame([("q1", "q1", "Eiffel Tower Paris")], "query string, q string, t string")
    got = [(r.doc, round(r.score, 6)) for r in Bm25Index(docs, "doc", "t", "q").search(ask, "query", "t", 2, "q").orderBy("rank").collect()]
    assert got == [(0, 2.431662), (1, 0.470004)]
    two = spark.createDataFrame([(0, "q1", "alpha bravo charlie"), (1, "q2", "alpha bravo charlie delta echo")], "doc int, q string, t string")
    ask = spark.createDataFrame([("q1", "q1", "delta echo")], "query string, q string, t string")
    assert [(r.doc, r.score) for r in Bm25Index(two, "doc", "t", "q").search(ask, "query", "t", 5, "q").collect()] == [(0, 0.0)]


def test_bm25_index_is_saved_and_pruned(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a b"), (1, "a c"), (2, "a"), (3, None), (4, "")], "doc int, t string")
    index = Bm25Index(docs, "doc", "t", max_df=0.5)
    assert {r.term for r in index.terms.collect()} == {"b", "c"}
    index.save(str(tmp_path / "ix"))
    again = Bm25Index.load(spark, str(tmp_path / "ix"))
    assert again.summary().first().n_docs == 5 and again.postings.count() == 2


def test_windows(spark):
    tokens = F.array_repeat(F.lit("w"), 250)
    assert [(w.start_word, w.end_word) for w in value(spark, windows(tokens))] == [(0, 120), (80, 200), (160, 250)]


ROWS = list(zip(range(8), [0, 0, 1, 1, 0, 1, 1, 1], [0.1, 0.4, 0.35, 0.8, 0.8, 0.9, 0.95, 1.0], strict=True))


def test_calibration(spark):
    rows = calibration.usable(spark.createDataFrame(ROWS, "id int, s int, p double").withColumnRenamed("s", "score").withColumnRenamed("p", "prob"), "score", "prob", "id")
    assert calibration.ece(rows, [], "id", 3).first().ece == pytest.approx(0.1125)
    assert calibration.ece(rows, [], "id", 15).first().ece == pytest.approx(0.2875)
    assert rows.agg(calibration.brier()).first()[0] == pytest.approx(0.160625)
    assert calibration.auroc(rows, []).first().auroc == pytest.approx(0.833333, abs=1e-6)
    assert rows.agg(calibration.saturation("p")).first()[0] == 0.25
    got = rows.agg(*calibration.separation()).first()
    assert (got.mean_correct, got.n_correct, got.n_incorrect) == (pytest.approx(0.8), 5, 3) and got.gap == pytest.approx(0.366667, abs=1e-6)
    one = rows.where("s = 1")
    assert calibration.auroc(one, []).first().auroc is None


def test_nvc(spark):
    c = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.5), (1, 2, 0.4), (2, 0, 0.3), (2, 1, 0.2), (2, 2, 0.1), (3, 0, 0.7)], "ex int, j int, ptrue double")
    nli = {(0, 1): (0.1, 0.8), (1, 0): (0.2, 0.6), (0, 2): (0.05, 0.9), (2, 0): (0.1, 0.7), (1, 2): (0.6, 0.1), (2, 1): (0.5, 0.2)}
    pairs = spark.createDataFrame([(ex, i, j, e, k) for ex in (1, 2) for (i, j), (e, k) in nli.items()], "ex int, i int, j int, entail double, contra double")
    got = {r.ex: r.nvc for r in confidence.nvc(c, pairs, 1e-6).collect()}
    assert got[1] == pytest.approx(0.675000142, abs=1e-8) and got[2] == pytest.approx(0.3) and got[3] == pytest.approx(0.7)
    assert {r.ex: r.nvc for r in confidence.nvc(c, pairs).collect()}[1] == pytest.approx(0.675, abs=1e-8)


def test_nvc_stops_at_padding(spark):
    c = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.5), (1, 2, -1.0), (1, 3, 0.4)], "ex int, j int, ptrue double")
    pairs = spark.createDataFrame([(1, i, j, 0.0, 1.0) for i in range(4) for j in range(4) if i != j], "ex int, i int, j int, entail double, contra double")
    assert confidence.nvc(c, pairs, 0.0, sentinel=True).first().nvc == pytest.approx(0.9 / 1.4)  # what follows the padding does not count
    assert confidence.nvc(c, pairs, 0.0).first().nvc == pytest.approx(0.9 / 1.8)


def test_vector_cosine(spark):
    side = lambda *ws: strings(*ws)
    one = math.log(1.5) + 1
    assert value(spark, retrieval.vector_cosine(side("a", "a", "b"), side("a", "c"))) == pytest.approx(2 / math.sqrt((4 + one**2) * (1 + one**2)))
    assert value(spark, retrieval.vector_cosine(side("a"), side("a", "a"))) == pytest.approx(1.0)
    assert value(spark, retrieval.vector_cosine(side("a"), side())) == 0.0 and value(spark, retrieval.vector_cosine(side("a"), side("b"))) == 0.0


def test_confidence_parts(spark):
    assert value(spark, confidence.self_consistency(F.array(*map(F.lit, [1.0, 0.95, 0.9, 0.2, 0.0])))) == 0.5
    logs = lambda *ps: F.array(*[F.lit(math.log(p)) for p in ps])
    assert value(spark, confidence.ptrue(logs(0.6), logs(0.2))) == pytest.approx(0.75)
    assert value(spark, confidence.ptrue(logs(0.3), logs(0.1))) is None
    assert value(spark, confidence.ptrue_or_half(logs(0.3), logs(0.1))) == 0.5
    assert value(spark, confidence.ptrue_of_logits(F.lit(1.0), F.lit(1.0))) == 0.5


@pytest.mark.parametrize("f1, calls, reward", [("x", 1, 1.983333), ("none", 9, -0.15)])
def test_reward(spark, f1, calls, reward):
    assert value(spark, training.reward(F.lit("x"), F.lit(f1), F.lit(calls))) == pytest.approx(reward, abs=1e-6)


def test_advantages(spark):
    rows = spark.createDataFrame([(i, "p", float(r)) for i, r in enumerate([1, 2, 3, 6])], "i int, prompt string, r double")
    assert [r.advantage for r in training.advantages(rows, "prompt", "r").orderBy("i").collect()] == [-2, -1, 0, 3]


GOOD = '{"action": "commit", "analysis": "twenty characters long", "reason": "ten chars at least", "answer": "x"}'


@pytest.mark.parametrize(
    "action, ok",
    [
        (GOOD, True),
        (GOOD.replace('"commit"', '"retrieve"'), False),
        (GOOD.replace('"commit"', '"retrieve"').replace('"answer": "x"', '"query": "what is"'), True),
        (GOOD.replace(', "answer": "x"', ""), False),
        (GOOD.replace('"commit"', '"dance"'), False),
        (GOOD.replace("}", ', "more": 1}'), False),
        ("[]", False),
        ("", False),
        (None, False),
    ],
)
def test_strict_action(spark, action, ok):
    assert value(spark, parse.strict_action(F.lit(action).cast("string"))) is ok


def test_parsers(spark):
    assert value(spark, parse.final_answer(F.lit('<think>{"action":"commit","answer":"no"}</think>{"action": "commit", "answer": "a"} {"action":"commit","answer": "b"}'))) == "b"
    assert value(spark, parse.final_answer(F.lit("Final answer: Rome\nx"))) == "Rome" and value(spark, parse.final_answer(F.lit("nothing"))) == ""
    assert value(spark, parse.committed_action(F.lit("nothing"))).asDict() == {"action": "commit", "answer": "", "query": None, "parse_error": True}
    assert value(spark, parse.agent_action(F.lit("nothing"))) == "retrieve"
    got = value(spark, parse.react_action(F.lit("Thought: so\nAction: Finish[Paris]")))
    assert (got.thought, got.action, got.argument) == ("so", "commit", "Paris")
    assert value(spark, parse.boxed_answer(F.lit("x \\boxed{7}"))) == "7"
    assert value(spark, parse.lm_calls(F.lit('{"tool_metrics": {"total_lm_calls": 3}, "num_turns": 5}'))) == 3 and value(spark, parse.lm_calls(F.lit("x"))) == 9
    assert value(spark, parse.claims_of(F.lit('["a", {"claim": "b"}]'))) == ["a", "b"] and value(spark, parse.claims_of(F.lit("- a\n2. b\n"))) == ["a", "b"]
    assert value(spark, parse.verbal_confidence(F.lit("about 0.85"))) == 0.85 and value(spark, parse.verbal_confidence(F.lit(None).cast("string"))) == 0.5
    assert value(spark, parse.short_answer(F.lit("<think>no</think>Answer: 'Paris'.\nmore"))) == "Paris"
    assert value(spark, parse.binary_label(F.lit("Yes, it"))) == 1 and value(spark, parse.binary_label(F.lit("?"))) is None


def test_answer_shapes(spark):
    assert value(spark, text.shortened(F.lit("Is it?"), F.lit("They are not the same."))) == "no"
    assert value(spark, text.shortened(F.lit("What?"), F.lit("The Animorphs series of books"))) == "Animorphs"
    assert value(spark, text.shortened(F.lit("Who?"), F.lit("Ann Lee was born in Rome. More."))) == "Ann Lee"
    assert value(spark, text.shortened(F.lit("Who?"), F.lit(None).cast("string"))) == "insufficient evidence"
    assert value(spark, text.expected_kind(F.lit("Which role did she have?"))) == "role_title"
    assert value(spark, text.answer_kind(F.lit("Ann Lee"))) == "person_name" and value(spark, text.answer_kind(F.lit("12.5"))) != "date"
    assert value(spark, text.mentions(F.lit("the old mill of Ann Lee"), F.lit("Ann Lee")))
