"""Several values packed in one field, one value a row.

A parsing expression grammar reads a cell; its alternatives are tried in order and a failed one
is given up for the next::

    cell     <- literal / list / sequence
    literal  <- '[' (string (',' string)* ','?)? ']' end          (as in JSON and Python; blanks between)
    list     <- '[' sequence ']' end
    sequence <- value (separator value)*
    value    <- quoted &(separator / end) / bracketed &(separator / end) / bare
    quoted   <- '"' (escape / '""' / !'"' .)* '"'         (also ' and typographic quotes)
    bare     <- (!separator .)*

Separators are ``;``, ``|``, bullets, tabs, line breaks, and slashes with blanks on both sides;
the comma is one only as its policy says. A quote that does not close before a separator makes
the parser go back and read the value as bare, with the flag ``malformed_quote``.

What a rule finds does not depend on where it was tried from: the places where a quote can close, a
bracket's partner and the next separator are found once for a cell and kept, so that a value that
is tried and given up costs no second reading of the rest.

Defined results: null and blank cells hold no value; empty values do not count (they take no
place); entries lose the blanks, quotes or brackets that wrap them, and escapes, nothing else;
round brackets, inner quotes, and slashes or hyphens without blanks belong to the value; records
delivered repeatedly count once and records without key not at all; very long cells are read
whole, in linear time.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.session import first_of_each, ship_package, spread

#: Where a bare comma divides.
ONLY_IF_ALONE, BETWEEN_QUOTED = "only_if_alone", "between_quoted"

_STRONG = re.compile(r"[;|•·；｜\t\n\r  ]|(?<=\s)/{1,2}(?=\s)")
_BLANK = re.compile(r"\s*")
_BRACKET = re.compile(r"[\[\]]")
_PAIRS = {'"': '"', "'": "'", "“": "”", "„": "“", "«": "»", "‘": "’"}
_STRING = re.compile(r'"(?:[^"\\]|\\.)*+"|\'(?:[^\'\\]|\\.)*+\'', re.S)
_QUOTES = re.compile(r'\\.|"+|[\'“”»’]', re.S)
_ESCAPE = re.compile(r'\\(u[0-9a-fA-F]{4}|.)', re.S)
_ENTRY = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("entry", T.StringType()), T.StructField("flag", T.StringType())]))
_ENTRY_ARROW = pa.list_(pa.struct([("pos", pa.int32()), ("entry", pa.string()), ("flag", pa.string())]))


def _unescape(text: str, quote: str) -> str:
    def one(m: re.Match) -> str:
        c = m.group(1)
        if c[0] == "u" and len(c) == 5:
            return chr(int(c[1:], 16))
        return {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(c, c)

    if quote == '"':
        text = text.replace('""', '"')
    if "\\" not in text:
        return text
    text = _ESCAPE.sub(one, text)
    # Escaped halves of one character belong together; a lone half is no character.
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class _Cell:
    """One parse of a cell; ``comma`` tells whether commas divide at this level."""

    def __init__(self, text: str, policy: str, comma_divides: bool = False):
        self.text, self.policy, self.comma_divides = text, policy, comma_divides
        self._closers: dict[str, tuple[list[int], list[int]]] | None = None
        self._partners: dict[int, int] | None = None
        self._strong = (0, -1)  # no strong separator begins between the two places

    def separator(self, at: int) -> int | None:
        """The place after the separator at this place, if there is one."""
        m = _STRONG.match(self.text, at)
        if m:
            return m.end()
        if self.comma_divides and self.text.startswith(",", at):
            return at + 1
        return None

    def _stop_after(self, i: int) -> int | None:
        """Where a value ends whose closing quote is at this place; None where it cannot close there."""
        n = len(self.text)
        after = _BLANK.match(self.text, i + 1).end()
        # Line breaks and tabs are blanks and separators at once.
        for stop in (i + 1, after):
            if stop == n or self.separator(stop) is not None or (self.text[stop] == "," and self._comma_after_quoted(stop)):
                return stop
        return next((k for k in range(i + 1, after) if self.separator(k) is not None), None)

    def _closing_quotes(self, close: str) -> tuple[list[int], list[int]]:
        """Places of closing quotes and of the ends of their values. Of double quotes each run of odd
        length closes or not, with its last one (end -1: it does not); of others those that can."""
        if self._closers is None:
            self._closers = {c: ([], []) for c in "\"'“”»’"}
            for m in _QUOTES.finditer(self.text):
                c, i = m.group()[0], m.end() - 1
                if c == "\\" or (c == '"' and len(m.group()) % 2 == 0):
                    continue
                stop = self._stop_after(i)
                if stop is not None or c == '"':
                    self._closers[c][0].append(i)
                    self._closers[c][1].append(-1 if stop is None else stop)
        return self._closers[close]

    def quoted(self, at: int) -> tuple[str, int] | None:
        opener = self.text[at : at + 1]
        close = _PAIRS.get(opener)
        if close is None:
            return None
        places, stops = self._closing_quotes(close)
        run = at
        while close == '"' and self.text.startswith('"', run + 1):
            run += 1
        if close == '"' and (run - at) % 2:  # the opening quote is part of the run that closes
            i, stop = run, self._stop_after(run)
        else:
            k = bisect_right(places, run)
            if k == len(places):
                return None
            i, stop = places[k], stops[k]
        return None if stop is None or stop < 0 else (_unescape(self.text[at + 1 : i], opener), stop)

    def _comma_after_quoted(self, at: int) -> bool:
        """Does the comma after a quoted value divide? Between two quoted values it always does."""
        if self.comma_divides:
            return True
        if self.policy != BETWEEN_QUOTED:
            return False
        following = _BLANK.match(self.text, at + 1).end()
        return self.text[following : following + 1] in _PAIRS

    def bracketed(self, at: int) -> tuple[str, int] | None:
        if self.text[at : at + 1] != "[":
            return None
        end = self._closing(at)
        if end is None:
            return None
        after = _BLANK.match(self.text, end + 1).end()
        for stop in (end + 1, after):
            if stop == len(self.text) or self.separator(stop) is not None:
                return self.text[at + 1 : end], stop
        return None

    def _closing(self, at: int) -> int | None:
        """The partner of an opening bracket."""
        if self._partners is None:
            self._partners, open_ones = {}, []
            for m in _BRACKET.finditer(self.text):
                if m.group() == "[":
                    open_ones.append(m.start())
                elif open_ones:
                    self._partners[open_ones.pop()] = m.start()
        return self._partners.get(at)

    def _next_strong(self, at: int) -> int:
        """Where the next separator other than the comma begins, or the cell's end."""
        known_from, known = self._strong
        if not known_from <= at <= known:
            m = _STRONG.search(self.text, at)
            self._strong = (at, m.start() if m else len(self.text))
        return self._strong[1]

    def bare(self, at: int) -> tuple[str, int]:
        end = self._next_strong(at)
        if self.comma_divides:
            i = self.text.find(",", at, end)
            end = i if i >= 0 else end
        return self.text[at:end], end

    def literal(self) -> list[tuple[str, str | None]] | None:
        """A complete list of quoted texts."""
        text, n = self.text, len(self.text)
        if text[:1] != "[" or text[-1] != "]":
            return None
        out: list[tuple[str, str | None]] = []
        at = _BLANK.match(text, 1).end()
        while at < n - 1:
            m = _STRING.match(text, at, n - 1)
            if m is None:
                return None
            entry = _unescape(m.group()[1:-1], "'").strip()
            if entry:
                out.append((entry, None))
            at = _BLANK.match(text, m.end()).end()
            if at < n - 1:
                if text[at] != ",":
                    return None
                at = _BLANK.match(text, at + 1).end()
        return out

    def sequence(self) -> list[tuple[str, str | None]]:
        out: list[tuple[str, str | None]] = []
        at, n = 0, len(self.text)
        while at <= n:
            start = _BLANK.match(self.text, at).end()
            jump = next((k for k in range(at, start) if self.separator(k) is not None), None)
            if jump is not None:  # an empty value before a tab or line break
                at = self.separator(jump)
                continue
            flag, got = None, self.quoted(start) or self.bracketed(start)
            wrapped = got is not None
            if got is None:
                if self.text[start : start + 1] == '"':
                    flag = "malformed_quote"
                elif self.text[start : start + 1] == "[":
                    flag = "unclosed_bracket"
                got = self.bare(start)
            entry, stop = got
            entry = entry.strip()
            if entry:
                out.append((entry, flag))
            if stop >= n:
                break
            after = self.separator(stop)
            if after is None:
                after = stop + 1 if wrapped and self.text[stop] == "," else stop
            at = after
        return out


def _strong_divides(text: str) -> bool:
    """Is there a separator other than the comma outside wrapped values?"""
    cell = _Cell(text, ONLY_IF_ALONE, comma_divides=True)
    at, n = 0, len(text)
    while at < n:
        start = _BLANK.match(text, at).end()
        if any(_STRONG.match(text, k) for k in range(at, start)):
            return True
        got = cell.quoted(start) or cell.bracketed(start) or cell.bare(start)
        stop = got[1]
        if stop >= n:
            return False
        if _STRONG.match(text, stop):
            return True
        at = stop + 1
    return False


def split_values(text: str | None, policy: str) -> list[tuple[str, str | None]]:
    """The values of a cell in order, each with an error flag or None."""
    if text is None or not (body := text.strip()):
        return []
    cell = _Cell(body, policy)
    if (values := cell.literal()) is not None:
        return values
    if body[0] == "[" and cell._closing(0) == len(body) - 1:
        return _sequence(body[1:-1], ONLY_IF_ALONE)
    return _sequence(body, policy)


def _sequence(body: str, policy: str) -> list[tuple[str, str | None]]:
    return _Cell(body, policy, policy == ONLY_IF_ALONE and not _strong_divides(body)).sequence()


def values_of(texts: Sequence[str | None], policy: str) -> list[list[dict]]:
    return [[{"pos": i, "entry": e, "flag": f} for i, (e, f) in enumerate(split_values(t, policy))] for t in texts]


def values_udf(policy: str):
    @F.arrow_udf(_ENTRY)
    def split(cells: pa.Array) -> pa.Array:
        return pa.array(values_of(cells.to_pylist(), policy), _ENTRY_ARROW)

    return split


def unpack(df: DataFrame, key: str, policies: dict[str, str], at_least: int = 1) -> DataFrame:
    """``key, src_field, pos, entry, flag``: the values of the named columns, cells of fewer left out."""
    ship_package(df.sparkSession)

    source = spread(df.select(key, *policies))
    for column, policy in policies.items():
        source = source.withColumn(f"_{column}", values_udf(policy)(F.col(column)))

    def rows(column: str) -> Column:
        cells = F.col(f"_{column}")
        kept = F.when(F.size(cells) >= at_least, cells).otherwise(F.slice(cells, 1, 0))
        return F.transform(
            kept,
            lambda v: F.struct(F.lit(column).alias("src_field"), v["pos"].alias("pos"), v["entry"].alias("entry"), v["flag"].alias("flag")),
        )

    packed = source.select(key, F.concat(*[rows(c) for c in policies]).alias("_rows"))
    return first_of_each(packed, key).select(key, F.inline("_rows"))


#: The comma policies of the two packed columns.
WITQA_POLICIES = {"gold_answer": BETWEEN_QUOTED, "expanded_object_label": ONLY_IF_ALONE}
