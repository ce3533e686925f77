"""Token ids of a whole corpus by a public tokenizer, as a monoid tree reduction.

A text is halved until its parts are small; a leaf is encoded as it stands, and neighbours are
joined by encoding a window around their seam anew. The window reaches to the nearest place on
either side where the pre-tokenizer provably parts the text whatever stands around it: a blank
that follows a character other than a blank. No match of the byte-level pattern can cross such a
place (runs of letters, of digits and of marks end before a blank, and a blank joins only what
follows it), so ids outside the window are final. Where a side has no such place within the
window, the window doubles, at last to the whole side. Joining is associative with the empty
text as unit; decoding concatenates up the tree.

A text longer than ``segment_chars`` is not left to one task: its segments are encoded in
parallel and joined by the same operation, which reads only their seams.

Defined results: empty and null texts have the empty list; blank texts are encoded as they stand;
strings that look like special tokens are ordinary text; rows without key are no records; every
row yields a row, copies included; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.session import ship_package, spread

#: Folder of the vocabulary files; see the README there.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pre-tokenizer's pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SEAM = re.compile(r"(?<=\S)[ \t\n\r]")
LEAF_CHARS = 512
WINDOW_CHARS = 48
SEGMENT_CHARS = 1 << 20


@lru_cache(4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int32)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def vocabulary_file(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


class TreeEncoder:
    """Encodes texts by halving and joining; ``path`` names a vocabulary of ranks."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, window_chars: int = WINDOW_CHARS):
        self.encoding, self.sizes = _encoding(path)
        self.leaf, self.window = max(leaf_chars, 1), max(window_chars, 1)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf:
            return np.array(self.encoding.encode_ordinary(text), np.int32)
        middle = len(text) // 2
        return self.join(text, middle, self.encode(text[:middle]), self.encode(text[middle:]))

    def join(self, text: str, middle: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of a text from those of text[:middle] and text[middle:]."""
        if not len(left) or not len(right):
            return left if len(left) else right
        start, kept = self._stable_left(text[:middle], left)
        stop, rest = self._stable_right(text[middle:], right)
        seam = self.encoding.encode_ordinary(text[start : middle + stop])
        return np.concatenate((kept, np.array(seam, np.int32), rest))

    def _stable_left(self, text: str, ids: np.ndarray) -> tuple[int, np.ndarray]:
        """Where the window begins in the left text, and the ids before it."""
        width = self.window
        while True:
            begin = max(0, len(text) - width)
            at = -1
            for m in _SEAM.finditer(text, begin + 1 if begin else 0):
                at = m.start()
            if at > 0:
                tail = len(text[at:].encode("utf-8", "surrogatepass"))
                return at, ids[: len(ids) - self._count(ids[::-1], tail)]
            if begin == 0:
                return 0, ids[:0]
            width *= 2

    def _stable_right(self, text: str, ids: np.ndarray) -> tuple[int, np.ndarray]:
        """Where the window ends in the right text, and the ids after it."""
        width = self.window
        while True:
            m = _SEAM.search(text, 0, width)
            if m:
                head = len(text[: m.start()].encode("utf-8", "surrogatepass"))
                return m.start(), ids[self._count(ids, head) :]
            if width >= len(text):
                return len(text), ids[:0]
            width *= 2

    def _count(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many ids from the start make up so many bytes."""
        step = max(16, n_bytes)
        return int(np.searchsorted(np.cumsum(self.sizes[ids[:step]]), n_bytes)) + 1 if n_bytes else 0


def token_ids(
    df: DataFrame,
    key: str,
    text: str,
    vocabulary: str | None = None,
    leaf_chars: int = LEAF_CHARS,
    segment_chars: int = SEGMENT_CHARS,
) -> DataFrame:
    """``key, ids`` for every row with a key."""
    ship_package(df.sparkSession)
    path = vocabulary or vocabulary_file()

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = TreeEncoder(path, leaf_chars)
        for texts in batches:
            yield _lists([coder.encode(t) if t else _NONE for t in texts.to_pylist()])

    rows = spread(df.select(key, text).where(F.col(key).isNotNull()))
    long = F.coalesce(F.length(text) > segment_chars, F.lit(False))
    short = rows.where(~long).select(key, encode(F.col(text)).alias("ids"))

    # Long texts: segments in parallel, then one join of neighbours, which reads only their seams.
    # The row number tells apart rows of the same key, so that repeated rows stay rows.
    segments = (
        rows.where(long)
        .withColumn("_row", F.monotonically_increasing_id())
        .select(key, "_row", text, F.explode(F.sequence(F.lit(0), F.expr(f"CAST((length(`{text}`) - 1) DIV {segment_chars} AS INT)"))).alias("_part"))
        .select(key, "_row", "_part", F.expr(f"substring(`{text}`, _part * {segment_chars} + 1, {segment_chars})").alias("_text"))
        .repartition(F.col("_row"), F.col("_part"))
        .select(key, "_row", "_part", "_text", encode(F.col("_text")).alias("_ids"))
    )
    kind = df.schema[key].dataType.simpleString()

    def whole(parts: Iterator[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(list(parts)).sort_by("_part")
        coder = TreeEncoder(path, leaf_chars)
        texts = table.column("_text").to_pylist()
        ids = [np.asarray(x.values, np.int32) for x in table.column("_ids")]
        while len(texts) > 1:
            nexts, joined = [], []
            for i in range(0, len(texts) - 1, 2):
                both = texts[i] + texts[i + 1]
                joined.append(coder.join(both, len(texts[i]), ids[i], ids[i + 1]))
                nexts.append(both)
            if len(texts) % 2:
                nexts.append(texts[-1])
                joined.append(ids[-1])
            texts, ids = nexts, joined
        return pa.table({key: table.column(key).slice(0, 1), "ids": _lists(ids)})

    joined = segments.groupBy("_row").applyInArrow(lambda t: whole(iter(t.to_batches())), f"`{key}` {kind}, ids array<int>")
    return short.unionByName(joined)


_NONE = np.zeros(0, np.int32)


def _lists(ids: Sequence[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64))).astype(np.int32)
    flat = np.concatenate(ids) if ids else _NONE
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32, copy=False)))
