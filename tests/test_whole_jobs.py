"""Queries that must see the whole of their input, on small tables that a shortened one would get wrong."""

import math
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq

from evidentia.operators.retrieval import STOP_WORDS
from evidentia.plans import ORACLES, QUERIES
from tests.compare import both
from tests.conftest import DATA


def tables(folder, **columns):
    for name, data in columns.items():
        pq.write_table(data if isinstance(data, pa.Table) else pa.table(data), f"{folder}/{name}.parquet")
    return str(folder)


def test_hybrid_search_asks_for_the_whole_text(spark, tmp_path):
    texts = ["= Title =\nthe rare quokka", "nothing of it", "a quokka, far down the text", "title page"]
    vectors = pa.table({"vec_id": [0, 1, 2, 3], "embedding": pa.array([[1.0, 0.0], [0.0, 1.0], [0.1, 1.0], [0.2, 1.0]], pa.list_(pa.float32()))})
    folder = tables(tmp_path, documents={"doc_id": [0, 1, 2, 3], "text": texts}, embeddings=vectors)
    # both a word of the heading and one of the body find documents; the body's two words find more
    hits = {r.doc: r.score for r in QUERIES["R8_hybrid_whole_text"](spark, folder).collect()}
    assert hits[2] == round(1 / 61 + 1 / 62, 6)  # first of the words, second of the vectors
    assert hits[3] == round(1 / 62 + 1 / 61, 6) and hits[1] == round(1 / 63, 6)


def test_safe_casts_read_every_line(spark, tmp_path):
    cells = ["7", "", "?", "n/a", "1e3", "0x1F", "twelve", '"1"', "١٢", "99999999999", "2147483647", "2147483648", "-2147483648", "-15", "+5", " 8 ", "0000000000012", "260.5", "5.", "9,460", "1_000", "5L", "-", "1 2", None]
    lines = [None if c is None else "\t".join([*"abcdefg", c, "1"]) for c in cells] + ["too short"]
    folder = tables(tmp_path, witqa_raw={"raw_id": list(range(len(lines))), "raw_line": pa.array(lines, pa.string())})

    def cast(c):
        c = (c or "").strip()
        return int(c) if re.fullmatch(r"[+-]?[0-9]+", c) and -(2**31) <= int(c) < 2**31 else 0

    got, want = both(spark, folder, QUERIES["P22_safe_casts"], ORACLES["P22_safe_casts"])
    assert got == want
    assert {r.raw_id: r.n for r in QUERIES["P22_safe_casts"](spark, folder).collect()} == {i: cast(c) for i, c in enumerate([*cells, None])}


def test_tfidf_reads_titles_and_words_of_any_alphabet_without_stop_words(spark, tmp_path):
    docs = {"evid_id": [1, 2, 3], "question_id": ["q"] * 3, "title": ["São Tomé", None, "Other"], "context_text": ["an island", "which of the what is it", "nothing at all"]}
    asked = {"example_id": [1], "question_id": ["q"], "question": ["Which of the islands is São Tomé?"]}
    runs = {"result_id": [1, 2, 3], "question": ["what is the São", "which of the", "São"], "pred_answer_raw": ["são", "which of the", "So"]}
    folder = tables(tmp_path, evidence_docs=docs, examples=asked, trajectories=runs)
    for name in ("R10_tfidf_ranking", "R11_tfidf_topk", "R12_pair_cosine"):
        got, want = both(spark, folder, QUERIES[name], ORACLES[name])
        assert got == want
    # 'islands', 'são', 'tomé' are asked; of five terms in four texts, two are in two
    two, one = math.log(5 / 3) + 1, math.log(5 / 2) + 1
    score = {r.evid_id: r.score for r in QUERIES["R10_tfidf_ranking"](spark, folder).collect()}
    assert score == {1: round(2 * two * two / (2 * two * two + one * one), 6), 2: 0.0, 3: 0.0}
    assert {r.result_id: r.cosine for r in QUERIES["R12_pair_cosine"](spark, folder).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_stop_words():
    assert len(set(STOP_WORDS)) == len(STOP_WORDS) == 318


def test_contexts_of_unequal_lists_go_as_far_as_the_shorter(spark, tmp_path):
    rows = [
        {"example_id": 1, "question": "q", "answer": "a", "context": {"title": ["T", "U"], "sentences": [["s1", "s2"]]}, "supporting_facts": {"title": ["T"], "sent_id": [0]}},
        {"example_id": 2, "question": "q", "answer": "a", "context": {"title": ["V"], "sentences": [["x"], ["y"]]}, "supporting_facts": None},
        {"example_id": 3, "question": "q", "answer": "a", "context": None, "supporting_facts": None},
        {"example_id": 4, "question": "q", "answer": "a", "context": {"title": [], "sentences": [["z"]]}, "supporting_facts": None},
    ]
    folder = tables(tmp_path, examples=pa.Table.from_pylist(rows))
    for name in ("P2_from_pairs", "P3_from_paragraphs"):
        got, want = both(spark, folder, QUERIES[name], ORACLES[name])
        assert got == want
        assert sorted(map(tuple, QUERIES[name](spark, folder).collect())) == [(1, 0, "T", "s1 s2"), (2, 0, "V", "x")]


def test_agent_loop_asks_every_question_of_the_examples(spark, tmp_path):
    folder = tables(tmp_path, examples={"question_id": ["a", "b", None, "a"]})
    got = sorted((r.question_id, r.turn, r.action) for r in QUERIES["L9_agent_loop"](spark, folder).collect())
    assert got == [(q, t, a) for q in "ab" for t, a in enumerate(("retrieve", "retrieve", "commit"))]


def test_yes_no_questions_of_the_examples(spark, tmp_path):
    folder = tables(tmp_path, examples={"example_id": [1, 2, 3, 4], "question": ["  Is it so?", "Which is it?", None, ""]})
    got, want = both(spark, folder, QUERIES["A17_yes_no_question"], ORACLES["A17_yes_no_question"])
    assert got == want
    assert {r.example_id: r.out for r in QUERIES["A17_yes_no_question"](spark, folder).collect()} == {1: True, 2: False, 3: None, 4: False}


def test_accepted_children_of_planned_nodes(spark):
    rows = QUERIES["Q7_accepted_children"](spark, DATA).collect()
    assert rows and {r.depth for r in rows} == {1} and all(r.q.strip() for r in rows)
    assert len({(r.plan, r.q) for r in rows}) == len(rows) and max(Counter(r.plan for r in rows).values()) < 12
