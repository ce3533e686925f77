import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.operators.packed_values import BETWEEN_QUOTED, ONLY_IF_ALONE, WITQA_POLICIES, split_values, unpack


@pytest.mark.parametrize(
    "cell, policy, values",
    [
        (None, ONLY_IF_ALONE, []),
        ("  ", ONLY_IF_ALONE, []),
        ("[]", ONLY_IF_ALONE, []),
        ("a, b; c", ONLY_IF_ALONE, ["a, b", "c"]),
        ("a, b", ONLY_IF_ALONE, ["a", "b"]),
        ("a, b", BETWEEN_QUOTED, ["a, b"]),
        ('"a","b, c"', BETWEEN_QUOTED, ["a", "b, c"]),
        ('"a, b"; c', BETWEEN_QUOTED, ["a, b", "c"]),
        ("a||b||", BETWEEN_QUOTED, ["a", "b"]),
        ("a • b | c", BETWEEN_QUOTED, ["a", "b", "c"]),
        ("a/b / c // d-e", BETWEEN_QUOTED, ["a/b", "c", "d-e"]),
        ("a\tb\r\nc\n", BETWEEN_QUOTED, ["a", "b", "c"]),
        ('x "y" | z (w)', BETWEEN_QUOTED, ['x "y"', "z (w)"]),
        ("[a, 'b, c', \"d \\\"e\\\"\"]", ONLY_IF_ALONE, ["a", "b, c", 'd "e"']),
        ('["Ismérol \\u00e9", "b"]', ONLY_IF_ALONE, ["Ismérol é", "b"]),
        ('a, "b, c", d', ONLY_IF_ALONE, ["a", "b, c", "d"]),
        ('"abc; def', BETWEEN_QUOTED, ['"abc', "def"]),
        ("[a; b]; c", BETWEEN_QUOTED, ["a; b", "c"]),
        ("O'Hara; 'x; y'", BETWEEN_QUOTED, ["O'Hara", "x; y"]),
    ],
)
def test_values(cell, policy, values):
    assert [v for v, _ in split_values(cell, policy)] == values


def test_malformed_quotes_are_flagged():
    assert split_values('"a; b', BETWEEN_QUOTED)[0] == ('"a', "malformed_quote")


ENTRIES = st.lists(st.text(alphabet="ab ,;|'\"\\é", min_size=1, max_size=8).map(str.strip).filter(bool), min_size=1, max_size=5)


@settings(max_examples=200, deadline=None)
@given(ENTRIES)
def test_json_lists_round_trip(entries):
    assert [v for v, _ in split_values(json.dumps(entries, ensure_ascii=False), ONLY_IF_ALONE)] == entries


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab ,;|'\"\\[]\n/", max_size=24), st.sampled_from([ONLY_IF_ALONE, BETWEEN_QUOTED]))
def test_any_cell_is_read(cell, policy):
    for value, _ in split_values(cell, policy):
        assert value and value == value.strip()


def test_very_long_cells_take_linear_time():
    began = time.time()
    assert len(split_values("; ".join(["ab"] * 100_000), BETWEEN_QUOTED)) == 100_000
    assert time.time() - began < 10


@pytest.mark.parametrize("value", ["'a; ", "[a; ", '"a; ', "a, ", "“a; ", '"a" ', "[[", '""', '"a", ', "'a', "])
@pytest.mark.parametrize("policy", [ONLY_IF_ALONE, BETWEEN_QUOTED])
def test_values_given_up_cost_no_second_reading(value, policy):
    took = []
    for n in (4_000, 16_000):
        began = time.process_time()
        assert split_values(value * n, policy)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.2  # four times the values, not sixteen times the work


@pytest.mark.parametrize(
    "cell, values",
    [
        ('["a",\n  "b; c"\n]', ["a", "b; c"]),
        ("['a', \"b's\",]", ["a", "b's"]),
        ('["\\ud83d\\ude00", "\\ud83d"]', ["😀", "�"]),
        ('["", " ", "a\\/b"]', ["a/b"]),
        ('["a" "b"]', ['"a" "b"']),
        ("[1, 2]", ["1", "2"]),
    ],
)
def test_lists(cell, values):
    assert [v for v, _ in split_values(cell, ONLY_IF_ALONE)] == values


def test_table(spark):
    rows = [(1, "a|b", None, 9), (1, "a|b", None, 8), (2, None, "[x, y]", 1), (None, "a|b", "c;d", 1), (3, "one", "", 0)]
    df = spark.createDataFrame(rows, "row_id bigint, gold_answer string, expanded_object_label string, pos int")
    got = sorted(tuple(r) for r in unpack(df, "row_id", WITQA_POLICIES, at_least=2).select("row_id", "src_field", "pos", "entry").collect())
    assert got == [(1, "gold_answer", 0, "a"), (1, "gold_answer", 1, "b"), (2, "expanded_object_label", 0, "x"), (2, "expanded_object_label", 1, "y")]
    assert unpack(df.limit(0), "row_id", WITQA_POLICIES).count() == 0
