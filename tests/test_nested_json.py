import json
import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from evidentia.operators import nested_json
from evidentia.operators.nested_json import PLANNING, StructuralIndex, portions, shred_array, shred_texts, trajectory_tables

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-99, 99) | st.floats(allow_nan=False, allow_infinity=False, width=32) | st.text(max_size=6),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(max_size=4), inner, max_size=4),
    max_leaves=12,
)


def rebuilt(ix, slot):
    kind = chr(ix.kind[slot])
    if kind == "[":
        return [rebuilt(ix, m) for m in ix.members(slot)]
    if kind == "{":
        return {json.loads(ix.data[ix.k_from[m] : ix.k_to[m]]): rebuilt(ix, m) for m in ix.members(slot)}
    return json.loads(ix.raw(slot))


@settings(max_examples=150, deadline=None)
@given(st.lists(VALUES, min_size=1, max_size=4), st.sampled_from([None, 1]), st.booleans())
def test_index_round_trip(values, indent, ascii_only):
    ix = StructuralIndex([json.dumps(v, indent=indent, ensure_ascii=ascii_only) for v in values])
    assert ix.valid.all()
    assert [rebuilt(ix, t) for t in range(len(values))] == values


@settings(max_examples=200, deadline=None)
@given(VALUES, st.data())
def test_index_tells_complete_json(value, data):
    text = json.dumps(value)
    cut = data.draw(st.integers(0, len(text)))
    broken = text[:cut] + data.draw(st.sampled_from(["", ",", "]", "}", '"', ":", "\\", "[", "nul", " "])) + text[cut + data.draw(st.integers(0, 2)) :]
    try:
        json.loads(broken)
        whole = True
    except ValueError:
        whole = False
    ix = StructuralIndex(["[1]", broken, "", '{"a": {}}'])
    assert list(ix.valid) == [True, whole, False, True]


@pytest.mark.parametrize(
    "text, rows",
    [
        (None, []),
        ("", []),
        ("  ", []),
        ("[", []),
        ("null", []),
        ("no json", []),
        ('[null, {"event": "x"}]', [("planning_trace", "", 1)]),
        ('{"event": "x", "hits": {"a": 1}}', [("planning_trace", "", 0), ("planning_trace.hits", "0", 0)]),
        ('{"events": [{"event": "x"}]}', [("planning_trace", "", 0)]),
        ('"[{\\"nodes\\": [null, {\\"depends_on\\": \\"sg1\\"}]}]"', [("planning_trace", "", 0), ("planning_trace.nodes", "0", 1), ("planning_trace.nodes.depends_on", "0/1", 0)]),
        ('[{"telemetry_snapshot": "{\\"claim_supports\\": \\"[0.5, null]\\"}"}]', [("planning_trace", "", 0), ("planning_trace.claim_supports", "0", 0)]),
        ('[{"telemetry_snapshot": {"claim_supports": 0.5}}]', [("planning_trace", "", 0), ("planning_trace.claim_supports", "0", 0)]),
        ('[{"hits": "[{"}]', [("planning_trace", "", 0)]),
    ],
)
def test_forms(text, rows):
    got = shred_texts(["[7]", text], PLANNING, with_values=False)[1]
    assert [r[:3] for r in got] == rows


def test_deep_and_long_texts():
    deep = "[" * 3000 + "]" * 3000
    long = json.dumps([{"event": "x" * 2_000_000, "hits": [1] * 5000}])
    got = shred_texts([deep, long], PLANNING, False)
    assert len(got[0]) == 1 and len(got[1]) == 5001


def test_index_holds_marks_only():
    event = {"event": "x" * 40, "nodes": [{"id": f"sg{j}", "subquestion": "Who is it?", "depends_on": ["sg1"]} for j in range(3)], "hits": [1, 2]}
    for text in (json.dumps([event] * 2000), json.dumps([event] * 2000, indent=2)):
        tracemalloc.start()
        ix = StructuralIndex([text])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert ix.valid.all() and peak < 20 * len(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=12), st.integers(1, 12))
def test_portions_are_bounded(sizes, most):
    got = list(portions(sizes, most))
    assert [i for a, b in got for i in range(a, b)] == list(range(len(sizes)))
    assert all(sum(sizes[a:b]) <= most or b - a == 1 for a, b in got)


def test_portions_change_nothing(monkeypatch):
    texts = [None, "[1, 2]", '[{"hits": [1]}]', "[", " ", '"[{\\"hits\\": [3, 4]}]"'] * 5
    want = shred_array(pa.array(texts), PLANNING).to_pylist()
    monkeypatch.setattr(nested_json, "PORTION", 3)
    assert shred_array(pa.array(texts), PLANNING).to_pylist() == want
    assert [len(x) for x in want[:6]] == [0, 2, 2, 0, 0, 3]
    assert shred_array(pa.array([], pa.string()), PLANNING).to_pylist() == []


SCHEMA = (
    "result_id bigint, policy_trace array<struct<step:int,action:string,details:struct<telemetry_snapshot:struct<claim_supports:array<double>>>>>,"
    "planning_trace string, support struct<claim_supports:array<double>,passage_support_matrix:array<array<double>>>, pos int, child_table string, _rows string"
)


def test_tables_with_awkward_rows(spark):
    nan = float("nan")
    event = Row(step=1, action="a", details=Row(telemetry_snapshot=Row(claim_supports=[0.1, None, nan])))
    full = (1, [None, event], '[{"event": "x"}]', Row(claim_supports=[None, 0.2], passage_support_matrix=[[0.1], None, [None, 0.3]]), 5, "z", "q")
    rows = [full, full, (None, [event], "[1]", None, 1, "", ""), (2, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in trajectory_tables(df, with_values=False).select("result_id", "child_table", "parent_pos", "pos").collect())
    assert got == sorted(
        [
            (1, "planning_trace", "", 0),
            (1, "policy_trace", "", 1),
            (1, "policy_trace.claim_supports", "1", 0),
            (1, "policy_trace.claim_supports", "1", 2),
            (1, "support.claim_supports", "", 1),
            (1, "support.passage_support_matrix", "0", 0),
            (1, "support.passage_support_matrix", "2", 1),
        ]
    )
    values = {r.value for r in trajectory_tables(df).where("child_table LIKE 'support.c%' OR child_table = 'planning_trace'").collect()}
    assert values == {"0.2", '{"event": "x"}'}
    assert trajectory_tables(df.limit(0)).count() == 0
