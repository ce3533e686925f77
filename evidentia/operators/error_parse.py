"""Loading delimited lines, and parting those that fail, by minimum-cost error parsing.

A line is read as a string of three symbols (delimiter, quote, run of other characters) by an
automaton with the modes *start of field*, *bare*, *quoted* and *after the closing quote*, times
the number of fields seen. Ordinary steps cost nothing, edits cost: inserting or deleting a quote,
a missing delimiter (an empty field) inserted, a surplus delimiter deleted (what follows it is read
for itself and joined to the last field). No edit of delimiters can make a broken quote good, and
a quote's edit costs more than all delimiters of the line together. Dynamic programming over
(symbol, field, mode) finds the cheapest reading with the wanted number of fields, and that reading
alone decides: at cost 0 with fields of valid types the line loads; else an edited quote means
``quoting``, edited delimiters alone mean ``column_count``, and otherwise the first type rule that
does not hold is the reason.

The programme is run within cost 0 first: there only one state is left at each symbol, so that
good lines take one pass. Where that pass ends without a reading, the whole programme is run, with
up to 4 states a field.

Defined results: a null line fails with ``column_count``; an empty or blank line is one field;
a line break that ends the line is no part of it; repeated lines are read each for itself; an
empty table gives an empty result; further columns are carried only where named.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.session import ship_package, spread

START, BARE, QUOTED, CLOSED = range(4)
_SYMBOL = re.compile(r'[\t"]|[^\t"]+')
_MARK = re.compile(r'[\t"]')
_LINE_END = re.compile(r"(?:\r\n|\n|\r)\Z")
_PARSED = T.StructType(
    [
        T.StructField("fields", T.ArrayType(T.StringType())),
        T.StructField("reason", T.StringType()),
        T.StructField("edits", T.StringType()),
    ]
)


def _step(mode: int, symbol: str) -> tuple[int, bool] | None:
    """Next mode, and whether a field ended; None where the symbol cannot stand."""
    if symbol == "\t":
        return (QUOTED, False) if mode == QUOTED else (START, True)
    if symbol == '"':
        return {START: QUOTED, BARE: BARE, QUOTED: CLOSED, CLOSED: QUOTED}[mode], False
    if mode == CLOSED:
        return None
    return (QUOTED if mode == QUOTED else BARE), False


_FREE_STEPS = {(mode, symbol): _step(mode, symbol) for mode in range(4) for symbol in '\t"'}


@dataclass(frozen=True)
class Reading:
    """The cheapest reading of a line: its edits in order of place, and the raw fields where there are none."""

    edits: tuple[str, ...]
    fields: tuple[str, ...] | None


def cheapest_reading(line: str, n_fields: int) -> Reading:
    """The cheapest reading of a line as ``n_fields`` fields."""
    return _within_zero(line, n_fields) or _of_any_cost(line, n_fields)


def _fields(line: str, bounds: Sequence[int]) -> tuple[str, ...]:
    """The fields between delimiters, without the quotes that wrap them."""
    raw = (line[a:b] for a, b in zip((0, *(b + 1 for b in bounds)), (*bounds, len(line)), strict=True))
    return tuple(t[1:-1].replace('""', '"') if t.startswith('"') else t for t in raw)


def _within_zero(line: str, n_fields: int) -> Reading | None:
    """The programme's states of cost 0: one at each symbol, or none."""
    mode, at, bounds = START, 0, []
    for m in _MARK.finditer(line):
        place = m.start()
        if place > at:  # a run of other characters
            if mode == CLOSED:
                return None
            mode = QUOTED if mode == QUOTED else BARE
        got = _FREE_STEPS[mode, m.group()]
        if got[1]:
            bounds.append(place)
        mode, at = got[0], place + 1
    if mode == QUOTED or (mode == CLOSED and at < len(line)) or len(bounds) != n_fields - 1:
        return None
    return Reading((), _fields(line, bounds))


def _of_any_cost(line: str, n_fields: int) -> Reading:
    """The whole programme over symbols and states (field * 4 + mode)."""
    symbols = [(m.group()[0] if m.group()[0] in '\t"' else "x", m.start()) for m in _SYMBOL.finditer(line)]
    last = n_fields - 1
    quote = len(symbols) + n_fields + 1  # more than all delimiters of a repaired line
    cost = {START: 0}
    trace: list[dict[int, tuple[int, int, str | None]]] = [{}]

    def reach(costs: dict, at: dict, to: int, c: int, step: tuple[int, int, str | None]) -> bool:
        if c >= costs.get(to, c + 1):
            return False
        costs[to] = c
        at[to] = step
        return True

    def insert(i: int, place: int) -> None:
        """Insertions before symbol i, until nothing gets cheaper."""
        queue = list(cost)
        while queue:
            s = queue.pop()
            f, mode = divmod(s, 4)
            if mode != BARE and reach(cost, trace[i], f * 4 + _step(mode, '"')[0], cost[s] + quote, (i, s, f"insert quote at {place}")):
                queue.append(f * 4 + _step(mode, '"')[0])
            if f < last and (mode == START or (i == len(symbols) and mode != QUOTED)):
                if reach(cost, trace[i], (f + 1) * 4, cost[s] + 1, (i, s, f"insert delimiter at {place}")):
                    queue.append((f + 1) * 4)

    for i, (symbol, place) in enumerate(symbols):
        insert(i, place)
        after: dict[int, int] = {}
        trace.append({})
        for s, c in cost.items():
            f, mode = divmod(s, 4)
            got = _step(mode, symbol)
            if got is not None and got[1] and f == last:
                reach(after, trace[i + 1], f * 4, c + 1, (i, s, f"delete delimiter at {place}"))
            elif got is not None:
                reach(after, trace[i + 1], (f + got[1]) * 4 + got[0], c, (i, s, None))
            if symbol == '"':
                reach(after, trace[i + 1], s, c + quote, (i, s, f"delete quote at {place}"))
        cost = after
    insert(len(symbols), len(line))
    ends = [last * 4 + m for m in (START, BARE, CLOSED) if last * 4 + m in cost]
    here: tuple[int, int] = (len(symbols), min(ends, key=cost.__getitem__))
    edits: list[str] = []
    bounds: list[int] = []
    while here[1] in trace[here[0]]:
        i, s, edit = trace[here[0]][here[1]]
        if edit:
            edits.append(edit)
        elif here[1] // 4 != s // 4:
            bounds.append(symbols[i][1])
        here = (i, s)
    return Reading(tuple(edits[::-1]), None if edits else _fields(line, bounds[::-1]))


@dataclass(frozen=True)
class LineFormat:
    """Field names in order, and for typed fields the rule that a value must pass."""

    fields: tuple[str, ...]
    rules: tuple[tuple[str, Callable[[str], bool]], ...] = ()

    def read(self, line: str | None) -> tuple[tuple[str, ...] | None, str | None, tuple[str, ...]]:
        """The fields of a line, the reason why it fails, and the edits that would mend it."""
        if line is None:
            return None, "column_count", ()
        reading = cheapest_reading(_LINE_END.sub("", line), len(self.fields))
        if reading.edits:
            return None, "quoting" if any("quote" in e for e in reading.edits) else "column_count", reading.edits
        for name, holds in self.rules:
            if not holds(reading.fields[self.fields.index(name)]):
                return None, name, (f"replace value of {name}",)
        return reading.fields, None, ()


def valid_count(value: str) -> bool:
    text = value.strip()
    return not text or (re.fullmatch(r"[0-9]+", text) is not None and int(text) < 2**31)


_LIST = re.compile(
    r"""\[\s*(?:(?:"(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*')
        (?:\s*,\s*(?:"(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*'))*\s*(?:,\s*)?)?\]""",
    re.X,
)


def valid_text_list(value: str) -> bool:
    text = value.strip()
    return not text or _LIST.fullmatch(text) is not None


_PLACEHOLDERS = frozenset(
    "null none nan na n/a n.a. n.a nil undefined unknown missing tbd tba todo empty void blank placeholder not available".split()
) | {"not available", "no question", "to be determined", "#n/a"}


def valid_question(value: str) -> bool:
    text = value.strip()
    if not any(c.isalpha() for c in text):
        return False
    if any(c == "�" or (unicodedata.category(c) in ("Cc", "Cs") and c not in "\t\n\r") for c in text):
        return False
    bare = text.strip("<>[](){}\"'*_-.:!?  ").lower()
    return text.lower() not in _PLACEHOLDERS and bare not in _PLACEHOLDERS


#: Nine tab-separated fields of a question set about single relations.
WITQA_LINE = LineFormat(
    (
        "output_question",
        "object_label",
        "object_surfaceform",
        "expanded_object_label",
        "subject_label",
        "predicate_label",
        "extracted_text",
        "sub_pred_count",
        "entity_count",
    ),
    (
        ("sub_pred_count", valid_count),
        ("expanded_object_label", valid_text_list),
        ("output_question", valid_question),
    ),
)


def read_lines(lines: Sequence[str | None], form: LineFormat) -> list[dict]:
    out = []
    for line in lines:
        fields, reason, edits = form.read(line)
        out.append({"fields": fields, "reason": reason, "edits": "; ".join(edits) or None})
    return out


def parse_lines(df: DataFrame, key: str, line: str, form: LineFormat = WITQA_LINE) -> DataFrame:
    """``key, parsed{fields, reason, edits}``: fields where the line is good, else why it fails."""
    ship_package(df.sparkSession)

    @F.arrow_udf(_PARSED)
    def parse(lines: pa.Array) -> pa.Array:
        return pa.array(read_lines(lines.to_pylist(), form), pa.struct([("fields", pa.list_(pa.string())), ("reason", pa.string()), ("edits", pa.string())]))

    # Filters on the result must not be pushed below it, where each would parse the lines once more.
    return spread(df.select(key, line)).select(key, parse.asNondeterministic()(F.col(line)).alias("parsed"))


def loaded_rows(parsed: DataFrame, key: str, form: LineFormat = WITQA_LINE, integers: Sequence[str] = ("sub_pred_count", "entity_count")) -> DataFrame:
    """The good lines as typed rows."""
    cells = []
    for i, name in enumerate(form.fields):
        cell = F.col("parsed.fields")[i]
        if name in integers:
            cell = F.trim(cell).try_cast("int")
        cells.append(cell.alias(name))
    return parsed.where("parsed.reason IS NULL").select(key, *cells)


def rejected_rows(parsed: DataFrame, key: str) -> DataFrame:
    """The lines that fail, with the reason and the edits that would mend them."""
    return parsed.where("parsed.reason IS NOT NULL").select(key, F.col("parsed.reason").alias("reason"), F.col("parsed.edits").alias("edits"))
