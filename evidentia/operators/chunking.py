"""Paragraphs and sliding windows of words, in closed form and without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import col, words


def paragraphs(text: Column | str) -> Column:
    """Parts between blank lines; with one part only, its lines; else the whole text."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(col(text), F.lit("")), "\r\n", "\n"), r"^\s+|\s+$", "")
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    cut = lambda pattern: F.filter(F.transform(F.split(t, pattern), trim), lambda p: p != "")
    parts, lines = cut(r"\n\s*\n+"), cut("\n")
    return F.when(t == "", F.array().cast("array<string>")).when(F.size(parts) > 1, parts).when(F.size(lines) > 1, lines).otherwise(F.array(t))


def windows(tokens: Column, most: int = 120, shared: int = 40) -> Column:
    """Windows of up to ``most`` words that share ``shared`` with the one before, as structs."""
    if most <= 0:
        raise ValueError("windows need a positive size")
    step = max(1, most - max(0, shared))
    n = F.size(tokens)
    count = F.when(n <= most, F.lit(1)).otherwise(F.ceil((n - most) / step).cast("int") + 1)
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts,
        lambda s: F.struct(
            F.array_join(F.slice(tokens, s + 1, F.lit(most)), " ").alias("text"),
            s.cast("int").alias("start_word"),
            F.least(n, s + most).cast("int").alias("end_word"),
            (F.least(n, s + most) - s).cast("int").alias("word_count"),
            F.lit("sliding_window").alias("split_type"),
        ),
    )


def chunk_rows(docs: DataFrame, text: str, *keep: str, most: int = 120, shared: int = 40, by_paragraph: bool = True) -> DataFrame:
    """One row for each chunk: short paragraphs whole, long ones in windows, with word offsets over
    the whole text. Offsets and chunk numbers of the paragraphs are folded within the row, so there
    is neither a window function nor a shuffle."""
    parts = F.transform(paragraphs(text), lambda p: words(p)) if by_paragraph else F.array(words(text))
    step = max(1, most - max(0, shared))
    count = lambda p: F.when(F.size(p) == 0, F.lit(0)).when(F.size(p) <= most, F.lit(1)).otherwise(F.ceil((F.size(p) - most) / step).cast("int") + 1)
    start = F.array(F.struct(F.lit(0).alias("word"), F.lit(0).alias("chunk")))
    folded = F.aggregate(
        F.col("_parts"),
        start,
        lambda acc, p: F.concat(
            acc, F.array(F.struct((F.element_at(acc, -1)["word"] + F.size(p)).alias("word"), (F.element_at(acc, -1)["chunk"] + count(p)).alias("chunk")))
        ),
    )
    staged = docs.where(F.col(text).isNotNull()).select(*keep, parts.alias("_parts"))
    placed = staged.select(*keep, F.size("_parts").alias("_n"), F.inline(F.arrays_zip(F.col("_parts").alias("_p"), F.slice(folded, F.lit(1), F.size("_parts")).alias("_o"))))
    cut = placed.select(*keep, "_n", "_o", F.size("_p").alias("_m"), F.posexplode(windows(F.col("_p"), most, shared)).alias("_j", "_w"))
    kind = F.when((F.col("_n") > 1) & (F.col("_m") <= most), "paragraph").otherwise("sliding_window")
    return cut.select(
        *keep,
        (F.col("_o.chunk") + F.col("_j")).cast("int").alias("chunk_index"),
        F.col("_w.text").alias("text"),
        (F.col("_w.start_word") + F.col("_o.word")).cast("int").alias("start_word"),
        (F.col("_w.end_word") + F.col("_o.word")).cast("int").alias("end_word"),
        F.col("_w.word_count").alias("word_count"),
        kind.alias("split_type"),
    )
