"""Oversized texts to overlapping pieces, cut at natural boundaries.

The separators form a hierarchy: section, paragraph, sentence, word, character. Pieces are packed
greedily: among the places where a piece may end, the last one of the highest rank is taken, and
the next piece begins ``overlap`` words before that end. Words beyond ``max_word_chars`` are cut
by characters first (off by default), so that even a text without blanks obeys a limit.

Each text is handled in one pass over its words with running "last boundary so far" arrays, in
linear time; the stage is map-only, and the one shuffle, which drops re-delivered rows, carries
spans and no texts.

Defined results: null, empty and blank texts have no piece; a text within the limit is one piece
(left out with ``oversized_only``); rows without key are no records; ties cannot arise, as a
place has one rank; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.session import first_of_each, ship_package, spread

CHARACTER, WORD, SENTENCE, PARAGRAPH, SECTION = range(5)

_WORD = re.compile(r"[^ \t\r\n]+")
_BLANK_LINE = re.compile(r"(?:\r\n|\n|\r(?!\n))[ \t]*[\r\n]")
_HEADING = re.compile(r"(?:#{1,6} |={2,} ?\S|\S[^\r\n]*[\r\n]+[=-]{3,}[ \t]*(?:[\r\n]|$))")
_CLOSERS = "\"')]»”"


@dataclass(frozen=True)
class SplitPolicy:
    limit: int = 120
    overlap: int = 40
    least: int = 60
    #: Ranks tried in order; a rank also takes the boundaries above it.
    ranks: tuple[int, ...] = (PARAGRAPH, SENTENCE)
    max_word_chars: int | None = None

    def __post_init__(self):
        if not 0 <= self.overlap < self.least <= self.limit:
            raise ValueError("needs 0 <= overlap < least <= limit")


def words_of(text: str, max_word_chars: int | None = None) -> list[tuple[int, int]]:
    spans = [m.span() for m in _WORD.finditer(text)]
    if max_word_chars:
        spans = [(i, min(i + max_word_chars, b)) for a, b in spans for i in range(a, b, max_word_chars)]
    return spans


def ranks_of(text: str, spans: Sequence[tuple[int, int]]) -> np.ndarray:
    """Rank of the boundary after each word."""
    out = np.full(len(spans), WORD, np.int8)
    for i, (a, b) in enumerate(spans):
        follows = spans[i + 1][0] if i + 1 < len(spans) else len(text)
        if follows - b > 1 and _BLANK_LINE.search(text, b, follows):
            out[i] = SECTION if _HEADING.match(text, follows) else PARAGRAPH
        elif follows == b and i + 1 < len(spans):
            out[i] = CHARACTER
        else:
            j = b
            while j > a and text[j - 1] in _CLOSERS:
                j -= 1
            if j > a and text[j - 1] in ".!?":
                out[i] = SENTENCE
    return out


def pieces(n: int, ranks: np.ndarray, policy: SplitPolicy) -> Iterator[tuple[int, int]]:
    """Word spans [start, end) of the pieces of a text of n words."""
    if n == 0:
        return
    ends = np.arange(1, n + 1)
    last = [np.concatenate(([0], np.maximum.accumulate(np.where(ranks >= r, ends, 0)))) for r in policy.ranks]
    start = 0
    while n - start > policy.limit:
        top = start + policy.limit
        end = next((int(x[top]) for x in last if x[top] >= start + policy.least), top)
        yield start, end
        start = end - policy.overlap
    yield start, n


def split_text(text: str | None, policy: SplitPolicy, oversized_only: bool = False, with_text: bool = True) -> list[dict]:
    spans = words_of(text or "", policy.max_word_chars)
    if oversized_only and len(spans) <= policy.limit:
        return []
    ranks = ranks_of(text or "", spans)
    return [
        {"chunk_index": i, "start_word": s, "end_word": e, "piece": text[spans[s][0] : spans[e - 1][1]] if with_text else None}
        for i, (s, e) in enumerate(pieces(len(spans), ranks, policy))
    ]


_PIECE = T.ArrayType(
    T.StructType(
        [
            T.StructField("chunk_index", T.IntegerType()),
            T.StructField("start_word", T.IntegerType()),
            T.StructField("end_word", T.IntegerType()),
            T.StructField("piece", T.StringType()),
        ]
    )
)
_PIECE_ARROW = pa.list_(pa.struct([("chunk_index", pa.int32()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("piece", pa.string())]))


def split_oversized(
    df: DataFrame, key: str, text: str, policy: SplitPolicy = SplitPolicy(), oversized_only: bool = True, with_text: bool = False
) -> DataFrame:
    """``key, chunk_index, start_word, end_word, piece`` for every text (over the limit)."""
    ship_package(df.sparkSession)

    @F.arrow_udf(_PIECE)
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([split_text(t, policy, oversized_only, with_text) for t in texts.to_pylist()], _PIECE_ARROW)

    rows = df.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    if oversized_only and policy.max_word_chars is None:
        rows = rows.where(F.length(text) > 2 * policy.limit)  # a word and its blank take two characters at least
    # The filter must not be pushed below the cut, where it would cut each text once more.
    cut_rows = spread(rows).select(key, cut.asNondeterministic()(F.col(text)).alias("_pieces")).where(F.size("_pieces") > 0)
    return first_of_each(cut_rows, key).select(key, F.inline("_pieces"))
