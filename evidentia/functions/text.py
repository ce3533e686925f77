"""Tokenisers, normalisers and answer shaping as column expressions.

All of these stay inside whole-stage code generation or native higher-order functions. The
normalisers differ on purpose: each belongs to one metric and none may stand in for another.
Null texts give null unless stated otherwise.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The articles, the token pattern, and the marks that one metric adds to ASCII punctuation.
ARTICLES = ("a", "an", "the")
TOKEN_PATTERN = r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*"
EXTRA_MARKS = "‘’´`"
BLANKS = r"[\s\p{Z}]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Index terms: lower-case ASCII words with inner apostrophes and hyphens."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(TOKEN_PATTERN), F.lit(0))


def words(text: Column | str) -> Column:
    return F.filter(F.split(col(text), BLANKS), lambda w: w != "")


def content_words(text: Column) -> Column:
    """Words without articles."""
    return F.filter(F.split(text, BLANKS), lambda w: ~w.isin("", *ARTICLES))


def trivia_form(text: Column | str) -> Column:
    """Underscores and punctuation to blanks, small letters, no articles."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(col(text), F.lit("")), "_", " ")), rf"[\p{{Punct}}{EXTRA_MARKS}]", " ")
    return F.array_join(content_words(plain), " ")


def official_words(text: Column | str) -> Column:
    return content_words(F.regexp_replace(F.lower(col(text)), r"\p{Punct}", ""))


def official_form(text: Column | str) -> Column:
    """Small letters, punctuation deleted, no articles."""
    return F.array_join(official_words(text), " ")


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    import unicodedata

    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def nfkc(text: Column | str) -> Column:
    """Compatibility composition; there is no built-in for it."""
    return _nfkc(col(text))


def compatible_form(text: Column | str) -> Column:
    """NFKC, then the official form; null gives the empty text."""
    return official_form(nfkc(F.coalesce(col(text), F.lit(""))))


def reward_form(text: Column | str) -> Column:
    """Small letters, marks to blanks; articles and underscores stay."""
    plain = F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"[^\p{L}\p{N}_\s]", " ")
    return F.array_join(words(plain), " ")


def squeeze(text: Column | str) -> Column:
    return F.array_join(words(text), " ")


def first_line_answer(text: Column | str) -> Column:
    """The first line without the answer marker, blanks squeezed."""
    line = F.split(F.trim(F.coalesce(col(text), F.lit(""))), "\n")[0]
    return squeeze(F.regexp_replace(line, "Answer:", ""))


def dedupe_key(text: Column | str) -> Column:
    """Key under which candidate answers are one: cleaned, small letters, no stops."""
    return F.replace(F.lower(first_line_answer(text)), F.lit("."), F.lit(""))


def sampling_form(text: Column | str) -> Column:
    return official_form(first_line_answer(text))


def split_aliases(text: Column | str) -> Column:
    """Alternatives parted by bars, trimmed, empty ones dropped; null gives none."""
    parts = F.transform(F.split(F.coalesce(col(text), F.lit("")), r"\|"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def join_aliases(*texts: Column) -> Column:
    """Distinct non-empty alternatives in order, joined by bars."""
    kept = F.filter(F.flatten(F.array(*[F.when(t.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.trim(t))) for t in texts])), lambda x: x != "")
    return F.array_join(F.array_distinct(kept), "|")


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    return F.aggregate(
        F.array_distinct(a),
        F.lit(0),
        lambda n, t: n + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))),
    )


def slug(text: Column | str) -> Column:
    """Name for files: runs of other characters become single hyphens; nothing left is ``unnamed``."""
    safe = F.regexp_replace(F.regexp_replace(F.trim(col(text)), r"[^A-Za-z0-9._-]+", "-"), r"-{2,}", "-")
    return F.coalesce(F.nullif(F.regexp_replace(safe, r"^-+|-+$", ""), F.lit("")), F.lit("unnamed"))


def cut_at_word(text: Column | str, limit: int) -> Column:
    """At most ``limit`` characters, ending at a word, with an ellipsis where something was cut."""
    t = col(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit), r"\s\S*$", ""), F.lit(" ...")))


# ---- answers and questions -------------------------------------------------------------------

# Openings of yes/no questions and the cues of their answers.
YES_NO_OPENERS = "is are was were do does did can could should would will has have had".split()
NO_CUES = (" not ", " never ", " neither ", " different ")
YES_CUES = (" both ", " same ", " equally ", " identical ")
# Keywords that tell the kind of an answer, in order of precedence.
ROLE_WORDS = "chief president minister secretary governor senator ambassador director officer protocol position title office post".split()
ORGANISATION_WORDS = "university college company corporation inc ltd committee agency department government association organization".split()
PLACE_WORDS = "city state country province county village town island river mountain district region".split()
# The patterns of what a question asks for, in order of precedence, and of an answer's parts.
ASKS_FOR = (
    ("role_title", r"\b(what|which)\s+(government\s+)?(position|role|title|office|post)\b"),
    ("person_name", r"\b(who|whom|whose)\b"),
    ("date", r"\b(when|what year|what date)\b"),
    ("number", r"\b(how many|how much|what number)\b"),
    ("location", r"\b(where|which city|which state|which country|what country)\b"),
    ("organization", r"\b(which organization|which company|which institution|which university)\b"),
)
SERIES = r"(?i)^\s*(?:the\s+)?(.+?)\s+series\b"
POSITION = r"(?i)\bheld the position of\s+([^.,;]+)"
LEAD_IN = r"(?i)^(?:the answer is|it is|it's|this is|that is)\s+"
CLAUSE_END = r"(?i)(?:[.;]|\s+because\s+|\s+while\s+|\s+although\s+|\s+but\s+)"
CLAUSE_HEAD = r"(?i)^(.+?)\s+\b(?:is|was|were|are|has|have|had|held|served|located|born|based)\b"
MOST_ANSWER_WORDS = 8
MONTHS = "january february march april may june july august september october november december".split()


def is_yes_no_question(question: Column | str) -> Column:
    return F.lower(F.trim(col(question))).rlike(rf"^({'|'.join(YES_NO_OPENERS)})\b")


def yes_or_no(text: Column | str) -> Column:
    """``yes`` or ``no`` where the text says so, else null."""
    t = F.concat(F.lit(" "), official_form(text), F.lit(" "))
    has = lambda cues: F.array_contains(F.transform(F.array(*map(F.lit, cues)), lambda c: F.contains(t, c)), True)
    return (
        F.when(F.contains(t, F.lit(" yes ")), "yes")
        .when(F.contains(t, F.lit(" no ")), "no")
        .when(has(NO_CUES), "no")
        .when(has(YES_CUES), "yes")
    )


def expected_kind(question: Column | str) -> Column:
    """The kind of answer that a question asks for; the first rule that fits decides."""
    q = F.lower(F.trim(col(question)))
    kind = F.when(is_yes_no_question(question), "yes_no")
    for name, pattern in ASKS_FOR:
        kind = kind.when(q.rlike(pattern), name)
    return kind.otherwise("entity")


def answer_kind(answer: Column | str) -> Column:
    """The kind of an answer, from its form and keywords."""
    a = F.trim(F.coalesce(col(answer), F.lit("")))
    n = official_form(a)
    names = F.split(a, r"\s+")
    any_of = lambda keys: n.rlike("|".join(keys))
    named = (F.size(names) <= 4) & F.forall(names, lambda w: w.rlike(r"^[A-Z][A-Za-z'.]+$"))
    return (
        F.when(a == "", "unknown")
        .when(n.isin("yes", "no"), "yes_no")
        .when(n.rlike(r"^\d+(\.\d+)?$"), "number")
        .when(n.rlike(rf"\b({'|'.join(MONTHS)})\b") | n.rlike(r"\b\d{4}\b"), "date")
        .when(any_of(ROLE_WORDS), "role_title")
        .when(any_of(ORGANISATION_WORDS), "organization")
        .when(any_of(PLACE_WORDS), "location")
        .when(named, "person_name")
        .otherwise("entity")
    )


# Which kinds of answers fit where another kind is expected, and the kinds' labels.
ALSO_FITS = {"date": ("number",), "location": ("entity",), "organization": ("entity",)}
KIND_LABELS = {
    "person_name": "PERSON", "location": "LOCATION", "date": "DATE", "number": "NUMBER", "organization": "ORG",
    "role_title": "TITLE_ROLE", "yes_no": "YESNO",
}


def kinds_agree(expected: Column, found: Column) -> Column:
    """Anything known fits an entity; otherwise the kind itself and those that also fit."""
    out = F.when(expected == "entity", found != "unknown")
    for kind, others in ALSO_FITS.items():
        out = out.when(expected == kind, found.isin(kind, *others))
    return out.otherwise(expected == found)


def kind_label(kind: Column) -> Column:
    out = F.lit("OTHER")
    for name, label in KIND_LABELS.items():
        out = F.when(kind == name, label).otherwise(out)
    return out


def shortened(question: Column | str, answer: Column | str) -> Column:
    """A short answer: yes or no, the name of a series, a role, or the head of the first clause."""
    edge = r"^[\s\"'`.,;:!?]+|[\s\"'`.,;:!?]+$"
    strip = lambda c: F.regexp_replace(c, edge, "")
    text = F.regexp_replace(first_line_answer(answer), r"^[\s\"'`]+|[\s\"'`]+$", "")
    series = strip(F.regexp_extract(text, SERIES, 1))
    role = strip(F.regexp_extract(text, POSITION, 1))
    lead = F.regexp_replace(text, LEAD_IN, "")
    clause = strip(F.split(lead, CLAUSE_END)[0])
    clause = F.when(clause == "", strip(lead)).otherwise(clause)
    head = strip(F.regexp_extract(clause, CLAUSE_HEAD, 1))
    clause = F.when(head != "", head).otherwise(clause)
    short = F.array_join(F.slice(words(clause), 1, MOST_ANSWER_WORDS), " ")
    said = F.when(is_yes_no_question(question), yes_or_no(text))
    return (
        F.when(text == "", "insufficient evidence")
        .when(said.isNotNull(), said)
        .when(series != "", series)
        .when(role != "", role)
        .when(short == "", "insufficient evidence")
        .otherwise(short)
    )


def mentions(text: Column, entity: Column, share: float = 0.8) -> Column:
    """Is the entity in the text, as a substring or with most of its words?"""
    words_of = words(official_form(entity))
    found = F.filter(words_of, lambda w: F.array_contains(words(official_form(text)), w))
    return F.contains(official_form(text), official_form(entity)) | ((F.size(words_of) > 0) & (F.size(found) / F.size(words_of) >= share))


def score_bin(score: Column) -> Column:
    # Edges and names of the five bins, and of no score.
    names = ("very low", "low", "medium", "high", "very high")
    out = F.when(score.isNull(), "n/a")
    for name, edge in zip(names, (0.2, 0.4, 0.6, 0.8), strict=False):
        out = out.when(score < edge, name)
    return out.otherwise(names[-1])


# Words that carry no content in a question's signature.
SIGNATURE_STOP_WORDS = (
    "a an and are be by did do does for from had has have how in is it its of on or that the their them there these this those to "
    "was were what when where which who whom whose why with"
).split()


def signature(question: Column | str) -> Column:
    """The set of a question's content words."""
    return F.array_distinct(F.filter(official_words(question), lambda w: ~w.isin(*SIGNATURE_STOP_WORDS) & ~w.rlike(r"^\d+$")))


def asks_again(a: Column, b: Column) -> Column:
    """Do two signatures overlap by 0.8 of the smaller, one within the other or but one word apart?"""
    common = F.size(F.array_intersect(a, b))
    apart = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    smaller = F.least(F.size(a), F.size(b))
    within = (common == F.size(a)) | (common == F.size(b))
    return (smaller > 0) & (common / smaller >= 0.8) & (within | (apart <= 1))
