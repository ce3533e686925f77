import csv
import io
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.operators.error_parse import WITQA_LINE, _of_any_cost, cheapest_reading, loaded_rows, parse_lines, read_lines, rejected_rows

GOOD = ["Who is it?", "A", "", '["A", \'B\']', "S", "p", 'said "no"', " 7 ", "9"]


def line(**changed):
    cells = dict(zip(WITQA_LINE.fields, GOOD, strict=True)) | changed
    return "\t".join(cells[f] for f in WITQA_LINE.fields)


@pytest.mark.parametrize(
    "text, reason",
    [
        (line(), None),
        (line() + "\r\n", None),
        (line(output_question='"a ""b"" c\td\n"'), None),
        (line(output_question='"open'), "quoting"),
        (line(output_question='"a" b'), "quoting"),
        (line() + "\tx", "column_count"),
        ("", "column_count"),
        (None, "column_count"),
        (line(sub_pred_count="٧"), "sub_pred_count"),
        (line(sub_pred_count="2147483648"), "sub_pred_count"),
        (line(sub_pred_count="2147483647", expanded_object_label=""), None),
        (line(sub_pred_count="-1", expanded_object_label="nan"), "sub_pred_count"),
        (line(expanded_object_label="[A]"), "expanded_object_label"),
        (line(expanded_object_label="[ ]"), None),
        (line(expanded_object_label='["A" "B"]'), "expanded_object_label"),
        (line(expanded_object_label='["A", "B"'), "expanded_object_label"),
        (line(output_question="12?"), "output_question"),
        (line(output_question="<TBD>"), "output_question"),
        (line(output_question="a\x00b c"), "output_question"),
        (line(output_question="a\ufffdb c"), "output_question"),
    ],
)
def test_reasons(text, reason):
    assert read_lines([text], WITQA_LINE)[0]["reason"] == reason


CELLS = st.text(alphabet='ab "\t\n', max_size=5)


def free_reading(text):
    """Fields of the reading without edits, whatever their number, by brute force; None where quoting breaks."""
    fields, at = [], 0
    while True:
        if text[at : at + 1] == '"':
            stop = next((k for k in range(at + 1, len(text)) if text[k] == '"' and (text[at + 1 : k + 1].count('"') % 2) and text[k + 1 : k + 2] != '"'), None)
            if stop is None or text[stop + 1 : stop + 2] not in ("", "\t"):
                return None
            fields.append(text[at + 1 : stop].replace('""', '"'))
            stop += 1
        else:
            stop = (text + "\t").index("\t", at)
            fields.append(text[at:stop])
        if stop >= len(text):
            return fields
        at = stop + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(CELLS, min_size=1, max_size=5))
def test_reading_equals_csv_writer(cells):
    out = io.StringIO()
    csv.writer(out, delimiter="\t", lineterminator="", quoting=csv.QUOTE_ALL).writerow(cells)
    got = cheapest_reading(out.getvalue(), len(cells))
    assert got.edits == () and list(got.fields) == cells


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet='ab"\t', max_size=10), st.integers(1, 4))
def test_cost_decides_as_the_rules_say(text, n):
    fields = free_reading(text)
    got = cheapest_reading(text, n)
    assert got == _of_any_cost(text, n)  # the pass within cost 0 is the programme's own
    assert (got.edits == ()) == (fields is not None and len(fields) == n)
    if fields is not None and len(fields) == n:
        assert list(got.fields) == fields
    assert any("quote" in e for e in got.edits) == (fields is None)
    if fields is not None:
        assert len(got.edits) == abs(len(fields) - n)  # delimiters alone, and no more than needed


def test_edits_state_the_repair():
    assert cheapest_reading('"a" b\tc', 2).edits == ("delete quote at 0",)
    assert cheapest_reading("a\tb\tc", 2).edits == ("delete delimiter at 3",)
    assert [e.rpartition(" at ")[0] for e in cheapest_reading("a", 3).edits] == ["insert delimiter"] * 2
    assert len(cheapest_reading('"a\tb', 2).edits) == 1


def test_long_lines():
    began = time.time()
    assert cheapest_reading('"' + '""\t' * 30_000 + '"', 1).edits == ()
    assert len(cheapest_reading("a\t" * 5_000, 9).edits) == 4_992
    assert cheapest_reading('\t"x' * 2_000, 9).edits
    assert time.time() - began < 20


def test_tables(spark):
    rows = [(1, line(), "x"), (2, None, "x"), (3, line(sub_pred_count="x" * 200_000), None), (3, line(sub_pred_count=""), None), (None, line(), "y")]
    df = spark.createDataFrame(rows, "raw_id bigint, raw_line string, reason string")
    parsed = parse_lines(df, "raw_id", "raw_line")
    assert sorted((r.raw_id, r.reason) for r in rejected_rows(parsed, "raw_id").collect()) == [(2, "column_count"), (3, "sub_pred_count")]
    good = loaded_rows(parsed, "raw_id").orderBy("raw_id").collect()
    assert [(r.raw_id, r.sub_pred_count, r.entity_count) for r in good] == [(None, 7, 9), (1, 7, 9), (3, None, 9)]
    assert parse_lines(df.limit(0), "raw_id", "raw_line").count() == 0
