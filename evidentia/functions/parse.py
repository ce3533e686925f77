"""Agent actions and answers out of generated texts, as column expressions.

Two parsers fall back differently on purpose: ``committed_action`` takes broken output as a commit
without answer, ``agent_action`` as a wish to retrieve.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.text import col

# The actions, and the least lengths of a strict action's texts.
ACTIONS = ("commit", "retrieve", "refine", "decompose")
LEAST_LENGTHS = {"analysis": 20, "reason": 10, "query": 5, "answer": 1}
# The patterns of reasoning blocks, fences, answers and markers in generated texts.
CLOSED_THOUGHT = r"(?s)<think>.*?</think>"
OPEN_THOUGHT = r"(?s)<think>.*$"
FENCED = r"(?s)```(?:json)?\s*(.*?)\s*```"
BRACED = r"(?s)\{.*\}"
COMMITTED_ANSWER = r'(?s)"action"\s*:\s*"commit".*?"answer"\s*:\s*"([^"]+)"'
ANSWER_FIELD = r'(?s)"answer"\s*:\s*"([^"]+)"'
MARKED_ANSWER = r"(?i)(?:final\s+answer|answer)\s*[:=]\s*([^\n]+)"
BOXED_ANSWER = r"\\boxed\{([^}]*)\}"
FINAL_CHANNEL = r"(?s)<\|channel\|>final<\|message\|>(.*?)(?:<\|.*|$)"
ACTION_SCHEMA = "action string, query string, analysis string, reason string, answer string"
BUDGET = 9


def without_thoughts(text: Column | str) -> Column:
    """Reasoning blocks removed, closed ones first, then an unclosed one to the end."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(col(text), F.lit("")), CLOSED_THOUGHT, ""), OPEN_THOUGHT, "")


def unfenced(text: Column) -> Column:
    inside = F.regexp_extract(text, FENCED, 1)
    return F.when(inside != "", inside).otherwise(text)


def json_object(text: Column | str) -> Column:
    """The text from the first opening to the last closing brace, fences aside, where it is an object; else null."""
    body = F.regexp_extract(unfenced(col(text)), BRACED, 0)
    return F.when((body != "") & F.try_parse_json(body).isNotNull() & F.json_object_keys(body).isNotNull(), body)


def strict_action(text: Column | str) -> Column:
    """Is the text a strict action object: known action, long enough texts, what the action needs, no more keys?"""
    t = col(text)
    a = F.from_json(t, ACTION_SCHEMA)
    keys = F.json_object_keys(t)
    long_enough = lambda f: a[f].isNull() & ~F.array_contains(keys, f) | (F.length(a[f]) >= LEAST_LENGTHS[f])
    ok = (
        F.try_parse_json(t).isNotNull()
        & keys.isNotNull()
        & (F.size(F.array_except(keys, F.array(*map(F.lit, ("action", *LEAST_LENGTHS))))) == 0)
        & a["action"].isin(*ACTIONS)
        & (F.length(a["analysis"]) >= LEAST_LENGTHS["analysis"])
        & (F.length(a["reason"]) >= LEAST_LENGTHS["reason"])
        & long_enough("query")
        & long_enough("answer")
        & ((a["action"] != "commit") | (F.length(a["answer"]) >= 1))
        & ((a["action"] != "retrieve") | (F.length(a["query"]) >= 5))
    )
    return F.coalesce(ok, F.lit(False))


def committed_action(text: Column | str) -> Column:
    """Action with parse error flag; broken output commits without answer."""
    body = json_object(without_thoughts(text))
    a = F.from_json(body, ACTION_SCHEMA)
    return F.struct(
        F.coalesce(a["action"], F.lit("commit")).alias("action"),
        F.when(body.isNull(), F.lit("")).otherwise(a["answer"]).alias("answer"),
        a["query"].alias("query"),
        body.isNull().alias("parse_error"),
    )


def agent_action(text: Column | str, allowed: tuple[str, ...] = ACTIONS) -> Column:
    """The named action where it is allowed, else ``retrieve``."""
    named = F.lower(F.trim(F.get_json_object(json_object(without_thoughts(text)), "$.action")))
    return F.when(named.isin(*allowed), named).otherwise("retrieve")


def react_action(text: Column | str) -> Column:
    """Thought, action and argument of a step in think-act notation."""
    t = F.coalesce(col(text), F.lit(""))
    kind = F.lower(F.regexp_extract(t, r"(?im)^\s*Action\s*:\s*(Search|Finish)\s*\[", 1))
    return F.struct(
        F.trim(F.regexp_extract(t, r"(?im)^\s*Thought\s*:\s*(.*)$", 1)).alias("thought"),
        F.when(kind == "finish", "commit").otherwise("retrieve").alias("action"),
        F.trim(F.regexp_extract(t, r"(?im)^\s*Action\s*:\s*(?:Search|Finish)\s*\[([^\]\n]*)\]", 1)).alias("argument"),
    )


def policy_choice(text: Column | str) -> Column:
    """A policy's choice: from JSON, else by keyword; commit words stop, anything else asks for more."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    named = F.lower(F.get_json_object(json_object(text), "$.action"))
    return F.when(named.isNotNull(), named).when(t.rlike("commit|stop|answerable"), "commit").otherwise("retrieve_more")


def final_answer(text: Column | str) -> Column:
    """Answer of the last commit block; else the last answer field; else what follows an answer marker; else empty."""
    t = without_thoughts(text)
    commits = F.regexp_extract_all(t, F.lit(COMMITTED_ANSWER), F.lit(1))
    fields = F.regexp_extract_all(t, F.lit(ANSWER_FIELD), F.lit(1))
    marked = F.regexp_extract(t, MARKED_ANSWER, 1)
    last = lambda xs: F.when(F.size(xs) > 0, F.trim(F.try_element_at(xs, F.lit(-1))))
    return F.coalesce(last(commits), last(fields), F.trim(marked))


def boxed_answer(text: Column | str, tail: int = 100) -> Column:
    """A boxed answer, else a marked one, else the end of the last line."""
    t = F.coalesce(col(text), F.lit(""))
    boxed = F.regexp_extract(t, BOXED_ANSWER, 1)
    marked = F.regexp_extract(t, MARKED_ANSWER, 1)
    line = F.try_element_at(F.split(F.trim(t), "\n"), F.lit(-1))
    return F.coalesce(F.nullif(F.trim(boxed), F.lit("")), F.nullif(F.trim(marked), F.lit("")), F.right(F.trim(line), F.lit(tail)))


def lm_calls(extra: Column | str) -> Column:
    """Number of model calls in a JSON of metrics, by order of preference; the budget where none is given."""
    t = col(extra)
    paths = ("$.total_lm_calls", "$.tool_metrics.total_lm_calls", "$.agent_loop_metrics.total_lm_calls", "$.num_turns")
    return F.coalesce(*[F.get_json_object(t, p).try_cast("int") for p in paths], F.lit(BUDGET))


def short_answer(text: Column | str) -> Column:
    """The answer in a chat model's output: final channel, thoughts and markers removed, first line."""
    t = without_thoughts(text)
    channel = F.regexp_extract(t, FINAL_CHANNEL, 1)
    body = F.when(channel != "", channel).otherwise(t)
    line = F.split(F.trim(F.regexp_replace(body, r"(?i)^\s*(?:final\s+)?answer\s*:\s*", "")), "\n")[0]
    return F.regexp_replace(line, r"^[\s\"'`]+|[\s\"'`.]+$", "")


def binary_label(text: Column | str) -> Column:
    """1 or 0 where the first word says yes or no (or true or false), else null."""
    w = F.lower(F.regexp_extract(F.coalesce(col(text), F.lit("")), r"[A-Za-z]+", 0))
    return F.when(w.isin("yes", "true"), 1).when(w.isin("no", "false"), 0)


def claims_of(text: Column | str) -> Column:
    """Claims of a JSON list (texts, or objects with a claim), else the lines without list marks."""
    t = F.coalesce(col(text), F.lit(""))
    body = F.regexp_extract(unfenced(t), r"(?s)\[.*\]", 0)
    items = F.from_json(body, "array<string>")
    claims = F.transform(items, lambda x: F.coalesce(F.get_json_object(x, "$.claim"), x))
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    kept = lambda xs: F.filter(F.transform(xs, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(items.isNotNull(), kept(claims)).otherwise(kept(lines))


def verbal_confidence(text: Column | str) -> Column:
    """The first decimal number, 0 or 1 in a text, within [0, 1]; 0.5 where there is none."""
    found = F.regexp_extract(F.coalesce(col(text), F.lit("")), r"\d+\.\d+|0|1", 0).try_cast("double")
    return F.least(F.greatest(F.coalesce(found, F.lit(0.5)), F.lit(0.0)), F.lit(1.0))


def react_or_json(text: Column | str, allowed: tuple[str, ...] = ("commit", "retrieve")) -> Column:
    return F.coalesce(F.when(json_object(text).isNotNull(), agent_action(text, allowed)), react_action(text)["action"])
