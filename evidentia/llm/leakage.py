"""Held-out passages inside a training corpus, found by one Aho-Corasick scan.

The held-out texts are reduced to their words (runs of letters and digits, case folded). A text in
common has at least ``window`` words in a row. Such a stretch holds one of the blocks of
``(window + 1) // 2`` words into which a held-out text is laid out, from its start, without overlap;
these blocks, or the whole text where it has fewer words than the window, are the keys of one
automaton over word numbers, so that it has about one node for each held-out word. A corpus text is
read once: its words are mapped to the numbers of the held-out vocabulary, all other words to one
number that no key holds; where the automaton reports a block, the words beside it tell exactly
which windows around it are in common. Each window is counted at the first block that it holds. The
words keep their offsets, so a match is given as a stretch of the original text.

The held-out side is fixed and goes to every worker, where one automaton is kept for all tasks. Its
size is counted first: up to ``shard_words`` words (about 120 bytes each in a worker) there is one
automaton and one scan; a larger side is dealt into portions of that size, each with a scan of its
own, so that no worker ever holds more. The corpus side is map-only: no shuffle, whatever its size.

Defined results: null, empty and wordless texts on either side match nothing; a pair is reported
once however often it matches; equal held-out texts are each reported; repeated corpus rows are
each reported; keys may have any type; an empty table on either side gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidentia.session import ship_package, spread

_WORD = re.compile(r"[^\W_]+")
WINDOW = 13
SHARD_WORDS = 2_000_000


def words(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().casefold(), m.start(), m.end()) for m in _WORD.finditer(text)]


class Matcher:
    """The automaton of some held-out texts."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        import ahocorasick

        self.window, self.block = window, (window + 1) // 2
        self.numbers: dict[str, int] = {}
        self.items = [item for item, _ in items]
        self.texts = [tuple(self.numbers.setdefault(m.casefold(), len(self.numbers) + 1) for m in _WORD.findall(text)) for _, text in items]
        keys: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for t, ids in enumerate(self.texts):
            if len(ids) < window:
                if ids:
                    keys.setdefault(ids, []).append((t, -1))  # only as a whole
                continue
            for p in range(0, len(ids) - self.block + 1, self.block):
                keys.setdefault(ids[p : p + self.block], []).append((t, p))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, places in keys.items():
            self.automaton.add_word(key, (len(key), places))
        self.empty = not keys
        if keys:
            self.automaton.make_automaton()

    def _around(self, line: tuple[int, ...], s: int, ids: tuple[int, ...], p: int) -> tuple[int, int] | None:
        """The first and the last start in the line of the common windows whose first block is the one at s."""
        most = self.block - 1
        left = right = 0
        while left < most and left < s and left < p and line[s - left - 1] == ids[p - left - 1]:
            left += 1
        e, q = s + self.block, p + self.block
        need = self.window - self.block
        while right < need and e + right < len(line) and q + right < len(ids) and line[e + right] == ids[q + right]:
            right += 1
        return (s - left, s + right - need) if left + right >= need else None

    def scan(self, text: str | None) -> dict[object, tuple[int, int, int]]:
        """Item to (first offset, last offset, windows) of its matches in the text."""
        out: dict[object, tuple[int, int, int]] = {}
        if self.empty or not text:
            return out
        numbers = self.numbers
        line = tuple([numbers.get(w, 0) for w in _WORD.findall(text.casefold())] if text.isascii() else [numbers.get(w.casefold(), 0) for w in _WORD.findall(text)])
        tokens = None
        for end, (size, places) in self.automaton.iter(line) if line else ():
            s = end - size + 1
            for t, p in places:
                if p < 0:
                    first, last, length = s, s, size
                else:
                    got = self._around(line, s, self.texts[t], p)
                    if got is None:
                        continue
                    (first, last), length = got, self.window
                tokens = tokens or [m.span() for m in _WORD.finditer(text)]
                begin, stop = tokens[first][0], tokens[last + length - 1][1]
                a, b, n = out.get(self.items[t], (begin, stop, 0))
                out[self.items[t]] = (min(a, begin), max(b, stop), n + last - first + 1)
        return out


#: The automaton that this Python worker used last, by the name of its held-out texts.
_KEPT: dict[str, Matcher] = {}


def _matcher(name: str, held_out, window: int) -> Matcher:
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Matcher(held_out.value, window)
    return _KEPT[name]


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    doc_key: str = "doc_id",
    doc_text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``doc key, item key, first_offset, last_offset, windows``: every pair with a common window."""
    spark = documents.sparkSession
    ship_package(spark)
    held = items.select(item_key, item_text).where(F.col(item_text).isNotNull() & F.col(item_key).isNotNull())
    size = held.agg(F.sum(F.size(F.split(item_text, r"[^\p{L}\p{N}]+")))).first()[0] or 0
    portions = max(1, -(-int(size) // shard_words))
    doc_type = documents.schema[doc_key].dataType.simpleString()
    item_type = items.schema[item_key].dataType
    arrow_type = to_arrow_type(item_type)
    schema = f"`_doc` {doc_type}, `_item` {item_type.simpleString()}, first_offset int, last_offset int, windows int"
    corpus = spread(documents.select(doc_key, doc_text).where(F.col(doc_text).isNotNull()))
    out = None
    for number in range(portions):
        part = held if portions == 1 else held.where(F.pmod(F.xxhash64(item_key), F.lit(portions)) == number)
        texts = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.collect()])
        name = uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch], texts=texts, name=name) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(name, texts, window)
            for batch in batches:
                rows: list[tuple] = []
                at: list[int] = []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    found = matcher.scan(text)
                    rows += [(item, *where) for item, where in found.items()]
                    at += [i] * len(found)
                item, first, last, n = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at, pa.int32())),
                        pa.array(item, arrow_type),
                        pa.array(first, pa.int32()),
                        pa.array(last, pa.int32()),
                        pa.array(n, pa.int32()),
                    ],
                    names=["_doc", "_item", "first_offset", "last_offset", "windows"],
                )

        found = corpus.mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("_doc").alias(doc_key), F.col("_item").alias(item_key), "first_offset", "last_offset", "windows")
