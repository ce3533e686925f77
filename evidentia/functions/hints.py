"""What a question is about and how it reasons: entities, operator families, diagnostics, and prompts."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions.text import answer_kind, col, expected_kind, kinds_agree, mentions, official_form, words

# Words inside a name, question words that open a span, and the cues of each operator family.
CONNECTORS = ("of", "the", "for", "in", "on", "to", "de", "la", "&", "and")
OPENERS = "what which who whom whose when where why how is are was were did do does can could would should will have has had".split()
OPERATOR_CUES = {
    "same_different": ("same", "different"),
    "both_either_neither": ("both", "either", "neither"),
    "older_younger": ("older", "younger"),
    "before_after": ("before", "after", "earlier", "later", "during"),
    "higher_lower": ("higher", "lower"),
    "more_less": ("more", "less", "fewer"),
    "rank_order": ("rank", "ranking", "order", "highest", "lowest", "first", "last"),
    "count": ("how many", "number of", "count"),
}
FAMILIES = {
    "comparison": ("same_different", "older_younger", "before_after", "higher_lower", "more_less"),
    "boolean_composition": ("both_either_neither",),
    "set_composition": ("both_either_neither",),
    "temporal_relation": ("before_after",),
    "ordinal_ranking": ("rank_order",),
    "count_aggregation": ("count",),
}
BRIDGE_CUES = (" of the ", " by the ", " based on ", " person who ", " woman who ", " man who ", " the one who ")
HIGH_GROUNDING = 0.70

_NAME = r"[A-Z][A-Za-z0-9'`.\-]*"


def question_entities(question: Column | str) -> Column:
    """Capitalised spans with inner connectors, without leading question words. Two names of several
    words joined by "and" are two entities; the first of equal ones counts."""
    q = F.array_join(words(col(question)), " ")
    spans = F.regexp_extract_all(q, F.lit(rf"{_NAME}(?: (?:(?:{'|'.join(CONNECTORS)}) )?{_NAME})*"), F.lit(0))
    bare = F.transform(spans, lambda s: F.regexp_replace(s, r"^[\s,.;:!?\"'`()\[\]{}]+|[\s,.;:!?\"'`()\[\]{}]+$", ""))
    led = F.transform(bare, lambda s: F.trim(F.regexp_replace(s, rf"(?i)^(?:(?:{'|'.join(OPENERS)})(?:\s+|$))+", "")))
    apart = lambda s: F.split(s, r"\s+(?:and|&)\s+")
    parts = F.flatten(F.transform(led, lambda s: F.when((F.size(apart(s)) > 1) & F.forall(apart(s), lambda p: F.contains(p, F.lit(" "))), apart(s)).otherwise(F.array(s))))
    said = F.filter(parts, lambda s: (official_form(s) != "") & ~((F.length(s) <= 2) & (s != F.upper(s))))
    # The first of equal forms: those whose form does not occur before.
    forms = F.transform(said, lambda s: official_form(s))
    return F.transform(F.filter(F.arrays_zip(said.alias("s"), F.transform(forms, lambda f, i: F.array_position(forms, f) == i + 1).alias("first")), lambda x: x["first"]), lambda x: x["s"])


def says_any(form: Column, phrases: tuple[str, ...]) -> Column:
    """Does a text in official form have one of the phrases? Single words must be whole words."""
    padded = F.concat(F.lit(" "), form, F.lit(" "))
    out = F.lit(False)
    for p in phrases:
        out = out | (F.contains(form, F.lit(p)) if " " in p else F.contains(padded, F.lit(f" {p} ")))
    return out


def operator_hints(question: Column | str) -> Column:
    form = official_form(question)
    return F.filter(F.array(*[F.when(says_any(form, cues), F.lit(name)) for name, cues in OPERATOR_CUES.items()]), lambda x: x.isNotNull())


def reasoning_hints(question: Column | str) -> Column:
    """Families of the operators found; without any a bridge or an attribute is looked up."""
    found = operator_hints(question)
    of = F.filter(F.array(*[F.when(F.arrays_overlap(found, F.array(*map(F.lit, ops))), F.lit(name)) for name, ops in FAMILIES.items()]), lambda x: x.isNotNull())
    form = official_form(question)
    bridge = F.lit(False)
    for cue in BRIDGE_CUES:
        bridge = bridge | F.contains(form, F.lit(cue))
    return F.when(F.size(of) > 0, of).when(bridge, F.array(F.lit("bridge_lookup"))).otherwise(F.array(F.lit("attribute_lookup")))


def needs_composition(question: Column | str) -> Column:
    return F.arrays_overlap(reasoning_hints(question), F.array(*map(F.lit, FAMILIES)))


def diagnostics(question: Column, answer: Column, claims: Column, scores: Column) -> Column:
    """How the claims bear on the question: kinds, coverage of its entities, grounding of relevant claims."""
    entities = question_entities(question)
    said = F.coalesce(claims, F.array().cast("array<string>"))
    covered = F.filter(entities, lambda e: F.exists(said, lambda c: mentions(c, e)))
    relevant = F.filter(
        F.arrays_zip(said.alias("c"), F.slice(F.coalesce(scores, F.array().cast("array<double>")), F.lit(1), F.greatest(F.size(said), F.lit(0))).alias("s")),
        lambda x: x["c"].isNotNull() & x["s"].isNotNull() & (mentions(x["c"], answer) | F.exists(entities, lambda e: mentions(x["c"], e))),
    )
    values = F.transform(relevant, lambda x: x["s"])
    n = F.size(values)
    mean = F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n)
    return F.struct(
        kinds_agree(expected_kind(question), answer_kind(answer)).alias("kind_agrees"),
        (F.size(covered) / F.nullif(F.size(entities), F.lit(0))).alias("entity_coverage"),
        n.alias("relevant_claims"),
        F.array_min(values).alias("least_grounding"),
        mean.alias("mean_grounding"),
        F.when(n > 0, F.size(F.filter(values, lambda s: s >= HIGH_GROUNDING)) / n).alias("high_share"),
    )


def _number(value: Column) -> Column:
    return F.coalesce(F.format_string("%.3f", value), F.lit("n/a"))


def signal_message(question: Column, details: Column) -> Column:
    """The user message of a training turn: question, answer so far, signals, supports, turns left."""
    s = details["telemetry_snapshot"]
    turn, most = F.coalesce(details["turn"], F.lit(0)), F.coalesce(details["max_turns"], F.lit(8))
    signals = F.concat_ws(" ", *[F.concat(F.lit(f"{name}="), F.when(s[name].isNull(), "n/a").otherwise(_number(s[name]))) for name in ("dinco_conf", "nvc", "sc_conf", "g_mean", "g_min")])
    supports = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(s["claim_supports"], F.array().cast("array<double>")), lambda x: _number(x)), ", "), F.lit("]"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Turn "), turn.cast("string"), F.lit(" of "), most.cast("string"), F.lit(", "), F.greatest(most - turn, F.lit(0)).cast("string"), F.lit(" left")),
        F.concat(F.lit("Question: "), F.trim(question)),
        F.concat(F.lit("Answer so far: "), F.coalesce(F.nullif(F.trim(s["answer"]), F.lit("")), F.lit("(no answer yet)"))),
        signals,
        F.concat(F.lit("claim_supports="), supports),
    )


def history_line(turn: Column, action: Column, answer: Column, telemetry: Column | None = None) -> Column:
    """One turn of the history as lines; the telemetry line only where it may be shown."""
    line = lambda label, value, quote="": F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"  {label}{quote}"), value, F.lit(quote)))
    shown = [F.concat(F.lit("  telemetry: "), telemetry)] if telemetry is not None else []
    return F.concat_ws(
        "\n",
        F.concat(F.lit("- Turn "), turn.cast("string"), F.lit(": action="), action["type"]),
        line("query=", action["query"], '"'),
        *shown,
        F.concat(F.lit('  answer: "'), F.coalesce(answer, F.lit("")), F.lit('"')),
        line("analysis: ", action["analysis"]),
        F.concat(F.lit("  reason: "), F.coalesce(action["reason"], F.lit(""))),
    )


# ---- a more specific span of a grounded answer -------------------------------------------------

_EDGE = " \t\n\r\"'`.,;:!?"
_VERB = re.compile(r"\b(?:is|was|were|are|has|have|had|held|served|located|born|based)\b", re.I)
_BEFORE_COMMA = re.compile(rf"({_NAME}(?:\s+{_NAME}){{0,6}})\s*,\s*$")


def specific_span(base: str | None, units: list[tuple[str, float]], is_place: bool, most_words: int = 10) -> str | None:
    """The best grounded phrase that holds the answer and says more: each word more adds 0.05, a comma
    0.20, for a place 0.10 more; the support counts in full. The first of equals is taken."""

    def form(text: str) -> str:
        plain = re.sub(r"[!-/:-@\[-`{-~]", "", text.lower())
        return " ".join(w for w in plain.split() if w not in ("a", "an", "the"))

    base = " ".join((base or "").split()).strip(_EDGE)
    core = form(base)
    best: tuple[float, str] | None = None
    for text, support in units if core else ():
        if core not in form(text):
            continue
        phrases = []
        at = text.lower().find(base.lower())
        if at >= 0 and (lead := _BEFORE_COMMA.search(text[:at])):
            phrases.append(f"{lead.group(1)}, {text[at : at + len(base)].strip()}")
        phrases += [part for part in re.split(r"[.;:!?]", text) if core in form(part)]
        for phrase in phrases:
            phrase = re.sub(r"^(?:in|at|from|of|to|the)\s+", "", " ".join(phrase.split()).strip(_EDGE), flags=re.I)
            phrase = re.split(r"\s+(?:which|that|where)\s+", phrase, maxsplit=1, flags=re.I)[0].strip(_EDGE)
            shaped = form(phrase)
            n = len(shaped.split())
            if not phrase or core not in shaped or len(phrase.split()) > most_words or n > most_words or _VERB.search(phrase):
                continue
            score = support + 0.05 * (n - len(core.split())) + (0.20 + 0.10 * is_place) * ("," in phrase) - 0.25 * (shaped == core)
            if best is None or score > best[0]:
                best = (score, phrase)
    return best[1] if best and form(best[1]) != core else None


@F.arrow_udf(T.StringType())
def _specific(question_kind: pa.Array, answer: pa.Array, claims: pa.Array, scores: pa.Array, text: pa.Array) -> pa.Array:
    out = []
    for kind, base, said, support, evidence in zip(*(x.to_pylist() for x in (question_kind, answer, claims, scores, text)), strict=True):
        if kind not in ("location", "entity"):
            out.append(None)
            continue
        pairs = list(zip(said or [], [*(support or []), *[0.0] * len(said or [])], strict=False))
        units = [(c, s) for c, s in pairs if c and s is not None and s >= 0.5]
        units = units or [(s, 0.35) for s in re.split(r"(?<=[.!?])\s+", " ".join((evidence or "").split())) if s]
        out.append(specific_span(base, units, kind == "location"))
    return pa.array(out, pa.string())


def more_specific(question: Column, answer: Column, claims: Column, scores: Column, evidence: Column) -> Column:
    """The order of the candidates is part of the meaning, so this one is no column expression."""
    return _specific(expected_kind(question), answer, claims, scores, evidence)
