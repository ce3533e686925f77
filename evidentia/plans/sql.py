"""Fragments of the SQL that the queries are checked against."""

from __future__ import annotations

BLANKS = r"[\s\p{Z}]+"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{BLANKS}'), lambda w: w <> '')"


def content(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{BLANKS}'), lambda w: w NOT IN ('', 'a', 'an', 'the'))"


def official_words(x: str) -> str:
    return content(f"regexp_replace(lower({x}), '[[:punct:]]', '', 'g')")


def official(x: str) -> str:
    return f"array_to_string({official_words(x)}, ' ')"


def trivia(x: str) -> str:
    plain = f"regexp_replace(lower(replace(coalesce({x}, ''), '_', ' ')), '[[:punct:]‘’´`]', ' ', 'g')"
    return f"array_to_string({content(plain)}, ' ')"


def reward_words(x: str) -> str:
    return words(f"regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')")


def squeeze(x: str) -> str:
    return f"array_to_string({words(x)}, ' ')"


def first_line(x: str) -> str:
    return squeeze(f"replace(split_part(trim(coalesce({x}, ''), ' '), chr(10), 1), 'Answer:', '')")


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*')"


def aliases(x: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), '|'), lambda a: trim(a, ' ')), lambda a: a <> '')"


def overlap(p: str, g: str) -> str:
    return (
        f"coalesce(list_sum(list_transform(list_distinct({p}), lambda t: "
        f"least(len(list_filter({p}, lambda x: x = t)), len(list_filter({g}, lambda x: x = t))))), 0)"
    )


def f1(p: str, g: str) -> str:
    """F1 of two list columns."""
    n = overlap(p, g)
    return f"CASE WHEN len({p}) = 0 OR len({g}) = 0 OR {n} = 0 THEN 0.0 ELSE 2.0 * ({n} / len({p})) * ({n} / len({g})) / (({n} / len({p})) + ({n} / len({g}))) END"


def once(table: str, key: str, *columns: str) -> str:
    """Rows of a table with re-delivered ones counted once."""
    return f"(SELECT DISTINCT {key}, {', '.join(columns)} FROM {table})"
