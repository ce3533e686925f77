"""One form for texts that look the same: embedded SQL inside Arrow partitions.

Every Arrow batch is queried in place by a DuckDB connection that lives as long as its task. The
SQL maps compatibility forms (``translate``, and a map for those of several characters), drops
invisible characters (``regexp_replace``), joins accents to their letters (``nfc_normalize``) and
maps look-alike letters, word by word: only a word that mixes alphabets is disguised; a word
wholly in another alphabet stays as it is. Long mapping tables are derived from the Unicode
database by rule; the look-alikes are listed.

Defined results: null stays null and is not disguised; an empty text stays empty; line breaks and
tabs are ordinary; rows delivered repeatedly count once; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.session import ship_package, spread

# Look-alike letters: the letter, and the Latin one it passes for.
CYRILLIC_ALIKE = "АВЕЅІЈКМНОРСТУХҮԚԜасеѕіјорухһԁԛԝүкӏ", "ABESIJKMHOPCTYXYQWacesijopyxhdqwykl"
GREEK_ALIKE = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχ", "ABEZHIKMNOPTYXaikvopux"
#: Latin and other letters that have no ordinary use in the texts' languages.
OTHER_ALIKE = "ɑɡıɩʏɴʀօոսցᴀᴄᴏᴜᴠᴡᴢꓐꓑꓓꓖ", "agiiYNRonugACOUVWZBPDG"

_INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ"
_BLANKS = "\u000b\u000c\u0085   -     　"


def _ranges(spec: str) -> list[str]:
    out, i = [], 0
    while i < len(spec):
        if spec[i + 1 : i + 2] == "-":
            out += [chr(c) for c in range(ord(spec[i]), ord(spec[i + 2]) + 1)]
            i += 3
        else:
            out.append(spec[i])
            i += 1
    return out


@lru_cache(1)
def compatibility_forms() -> tuple[dict[str, str], dict[str, str]]:
    """By the rule of NFKC: characters that stand for one other, and for several others.

    Forms of ordinary marks (an ellipsis, a spacing accent, a superscript digit) stand for
    themselves: only letters, digits of another width, numerals and joined forms are mapped.
    """
    single, several = {c: " " for c in _ranges(_BLANKS)}, {}
    for cp in range(0x80, sys.maxunicode + 1):
        c = chr(cp)
        if unicodedata.is_normalized("NFKC", c) or 0xD800 <= cp < 0xE000 or c in single:
            continue
        plain = unicodedata.normalize("NFKC", c)
        if unicodedata.normalize("NFC", c) == plain:  # a canonical form, which NFC sees to
            continue
        if plain[0].isspace() or unicodedata.category(c) == "Po" and not 0xFF00 <= cp < 0xFFF0:
            continue
        (single if len(plain) == 1 else several)[c] = plain
    return single, several


def _class(chars) -> str:
    """A regular expression class of these characters, neighbours as ranges."""
    codes = sorted(map(ord, chars))
    parts, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        parts.append(rf"\x{{{codes[i]:X}}}" + (rf"-\x{{{codes[j]:X}}}" if j > i else ""))
        i = j + 1
    return "[" + "".join(parts) + "]"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@lru_cache(1)
def canonical_sql() -> str:
    """``SELECT id, value, canonical FROM batch``."""
    single, several = compatibility_forms()
    alike_from = CYRILLIC_ALIKE[0] + GREEK_ALIKE[0]
    alike_to = CYRILLIC_ALIKE[1] + GREEK_ALIKE[1]
    alike = _class(alike_from)
    own_cyrillic = _class({chr(c) for c in range(0x400, 0x530)} - set(CYRILLIC_ALIKE[0]))
    own_greek = _class({chr(c) for c in range(0x370, 0x400)} - set(GREEK_ALIKE[0]))
    to_cyrillic = {b: a for a, b in zip(*CYRILLIC_ALIKE, strict=True)}
    to_greek = {b: a for a, b in zip(*GREEK_ALIKE, strict=True)}
    pairs = "MAP {" + ", ".join(f"{_quote(a)}: {_quote(b)}" for a, b in several.items()) + "}"

    def by_word(column: str, pattern: str, case: str) -> str:
        return f"array_to_string(list_transform(regexp_extract_all({column}, {_quote(pattern)}), lambda w: {case}), '')"

    def scripts(w: str) -> str:
        return " + ".join(f"regexp_matches({w}, '\\p{{{s}}}')::INT" for s in ("Latin", "Cyrillic", "Greek"))

    # A run of letters in two alphabets takes the alphabet that some of its letters have alone.
    run_case = (
        f"CASE WHEN {scripts('w')} < 2 THEN w"
        f" WHEN regexp_matches(w, {_quote(own_cyrillic)}) THEN translate(w, {_quote(''.join(to_cyrillic))}, {_quote(''.join(to_cyrillic.values()))})"
        f" WHEN regexp_matches(w, {_quote(own_greek)}) THEN translate(w, {_quote(''.join(to_greek))}, {_quote(''.join(to_greek.values()))})"
        f" ELSE translate(w, {_quote(alike_from)}, {_quote(alike_to)}) END"
    )
    # Runs joined by a hyphen, apostrophe, slash or dot to Latin ones, all of look-alikes, are disguised too.
    joined_case = (
        f"CASE WHEN {scripts('w')} < 2 OR regexp_matches(w, {_quote(own_cyrillic)}) OR regexp_matches(w, {_quote(own_greek)}) THEN w"
        f" ELSE translate(w, {_quote(alike_from)}, {_quote(alike_to)}) END"
    )
    foreign = _quote(alike)
    return f"""
    WITH forms AS (
        SELECT id, value, CASE WHEN regexp_matches(value, {_quote(_class(single))})
            THEN translate(value, {_quote(''.join(single))}, {_quote(''.join(single.values()))}) ELSE value END AS s
        FROM batch
    ), joined AS (
        SELECT id, value, CASE WHEN regexp_matches(s, {_quote(_class(several))})
            THEN array_to_string(list_transform(string_split(s, ''), lambda c: coalesce(map_extract_value({pairs}, c), c)), '') ELSE s END AS s
        FROM forms
    ), seen AS (
        SELECT id, value, regexp_replace(s, {_quote(_class(_ranges(_INVISIBLE)))}, '', 'g') AS s FROM joined
    ), others AS (
        SELECT id, value, CASE WHEN regexp_matches(s, {_quote(_class(OTHER_ALIKE[0]))})
            THEN translate(s, {_quote(OTHER_ALIKE[0])}, {_quote(OTHER_ALIKE[1])}) ELSE s END AS s
        FROM seen
    ), runs AS (
        SELECT id, value, CASE WHEN regexp_matches(s, {foreign})
            THEN {by_word('s', '[\\p{L}\\p{M}]+|[^\\p{L}\\p{M}]+', run_case)} ELSE s END AS s
        FROM others
    )
    SELECT id, value, nfc_normalize(CASE WHEN regexp_matches(s, {foreign})
        THEN {by_word('s', "[\\p{L}\\p{M}'’/.-]+|[^\\p{L}\\p{M}'’/.-]+", joined_case)} ELSE s END) AS canonical
    FROM runs
    """


def canonical_batches(batches: Iterator[pa.RecordBatch], key: str, value: str) -> Iterator[pa.RecordBatch]:
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
    try:
        for got in batches:
            if not got.num_rows:
                continue
            batch = pa.table({"id": pa.array(range(got.num_rows), pa.int64()), "value": got.column(got.schema.get_field_index(value))})
            con.register("batch", batch)
            done = con.sql(canonical_sql() + " ORDER BY id").to_arrow_table()
            con.unregister("batch")
            columns = [got.column(i) for i in range(got.num_columns)] + [done.column("canonical").combine_chunks().cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*got.schema.names, "canonical"])
    finally:
        con.close()


def canonical_texts(df: DataFrame, key: str, value: str) -> DataFrame:
    """The named columns, ``canonical``, and ``disguised``: whether the value looked like another."""
    ship_package(df.sparkSession)
    rows = spread(df.select(key, value))
    schema = rows.schema.simpleString()[7:-1] + ",canonical:string"
    out = rows.mapInArrow(lambda it: canonical_batches(it, key, value), schema.replace(":", " "))
    return out.withColumn("disguised", F.coalesce(F.col(value) != F.col("canonical"), F.lit(False)))
