"""Routing, thresholds, stopping rules and the agent loop.

Rules over recorded signals are window queries: the first hop at which a rule stops is a minimum,
not a loop. Only the loop over an opaque policy is run group by group.
"""

from __future__ import annotations

import string
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions.text import official_form
from evidentia.session import own_group

# The default gates, and the conditions of the evaluation arms.
NO_ANSWER = "insufficient evidence"
GATE, HIGH_CONFIDENCE, MEAN_SUPPORT, LEAST_SUPPORT = 0.80, 0.90, 0.70, 0.50
NVC_GATE, GROUNDING_GATE, COMBINED_GATE = 0.70, 0.70, 0.65
THRESHOLDS = {"threshold_30": 0.3, "threshold_50": 0.5, "threshold_70": 0.7}


def has_telemetry(condition: Column) -> Column:
    return F.contains(condition, F.lit("telemetry")) & ~F.contains(condition, F.lit("notelemetry"))


def is_agent(condition: Column) -> Column:
    return F.startswith(condition, F.lit("agent"))


def is_react(condition: Column) -> Column:
    return F.startswith(condition, F.lit("react"))


def is_multi_turn(condition: Column) -> Column:
    return is_agent(condition) | is_react(condition)


def route(score: Column, mode: str = "gate", gate: float = GATE) -> Column:
    """Always, never, or where the score (null as 0) is under the gate: retrieve."""
    if mode in ("always", "never"):
        return F.lit("retrieve" if mode == "always" else "memory")
    return F.when(F.coalesce(score, F.lit(0.0)) < gate, "retrieve").otherwise("memory")


def under_thresholds(rows: DataFrame, score: Column, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """Every row under every threshold condition, strictly under which it retrieves."""
    arms = F.array(*[F.struct(F.lit(k).alias("condition"), F.lit(v).alias("threshold")) for k, v in thresholds.items()])
    each = rows.withColumn("_s", score).withColumn("_arm", F.explode(arms))
    return each.select("*", F.col("_arm.condition").alias("condition"), (F.coalesce("_s", F.lit(0.0)) < F.col("_arm.threshold")).alias("retrieves")).drop("_arm", "_s")


def oracle_retrieves(label: Column, by_count: Column) -> Column:
    return F.coalesce(label, by_count, F.lit(True))


def stopping_hop(hops: DataFrame, by: str, hop: str, nvc: Column, grounding: Column, combined: Column) -> DataFrame:
    """The first hop that passes all gates, else the hop of the best combined signal (the earliest of equals)."""
    go = (F.coalesce(nvc, F.lit(0.0)) > NVC_GATE) & (F.coalesce(grounding, F.lit(0.0)) >= GROUNDING_GATE) & (F.coalesce(combined, F.lit(0.0)) >= COMBINED_GATE)
    best = F.max_by(F.col(hop), F.struct(F.coalesce(combined, F.lit(-1.0)), -F.col(hop)))
    return hops.groupBy(by).agg(F.min(F.when(go, F.col(hop))).alias("_stop"), best.alias("_best"), F.count(F.lit(1)).alias("n_hops")).select(
        by, F.coalesce("_stop", "_best").alias("hop"), F.col("_stop").isNotNull().alias("stopped"), "n_hops"
    )


def is_real_answer(answer: Column) -> Column:
    """Is something said, other than that the evidence does not suffice (in official form, so that case and stops do not matter)?"""
    said = F.coalesce(answer, F.lit(""))
    return (F.trim(said) != "") & (official_form(said) != NO_ANSWER)


def exhausted_action(supported: Column, confidence: Column, answer: Column) -> Column:
    """When turns run out: commit a real answer that is supported or very sure; else decompose."""
    sure = F.coalesce(supported, F.lit(False)) | (F.coalesce(confidence, F.lit(0.0)) >= HIGH_CONFIDENCE)
    return F.when(is_real_answer(answer) & sure, "commit").otherwise("decompose")


def guarded_action(action: Column, answer: Column, is_last: Column, has_hits: Column | None = None) -> Column:
    """A commit without a real answer becomes a retrieval unless it is the last turn; so does a refinement without passages."""
    empty = F.lit(False) if has_hits is None else (action == "refine") & ~has_hits
    return F.when(((action == "commit") & ~is_real_answer(answer) & ~is_last) | empty, "retrieve").otherwise(action)


def signal_changes(turns: DataFrame, by: list[str], turn: str, signal: str, tie: str, least: float = 0.005) -> DataFrame:
    """Change of a signal from turn to turn, named where it exceeds ``least``."""
    before = F.lag(signal).over(Window.partitionBy(*by, own_group(tie, *by)).orderBy(turn, tie))
    delta = F.col(signal) - before
    name = F.when(delta.isNull(), F.lit(None)).when(delta > least, "IMPROVED").when(delta < -least, "DECREASED").otherwise("UNCHANGED")
    return turns.withColumn("delta", delta).withColumn("change", name)


def running_best(turns: DataFrame, by: list[str], turn: str, signal: str, tie: str, last: int = 8) -> DataFrame:
    """Best signal so far, and the mean over the last turns."""
    w = Window.partitionBy(*by, own_group(tie, *by)).orderBy(turn, tie)
    return turns.withColumn("best_so_far", F.max(signal).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "recent_mean", F.avg(signal).over(w.rowsBetween(1 - last, 0))
    )


def terminal_turn(turns: DataFrame, by: list[str], turn: str, action: Column) -> DataFrame:
    """The first turn that ends a rollout, else the last one."""
    ends = action.isin("commit", "decompose")
    return turns.groupBy(*by).agg(F.coalesce(F.min(F.when(ends, F.col(turn))), F.max(turn)).alias("end_turn"), F.max(ends.cast("int")).alias("ended"))


def _real(answer: str) -> bool:
    """``is_real_answer`` of one text."""
    plain = "".join(c for c in answer.lower() if c not in string.punctuation)
    return bool(answer.strip()) and " ".join(w for w in plain.split() if w not in ("a", "an", "the")) != NO_ANSWER


def run_agent(
    questions: DataFrame,
    key: str,
    policy: Callable[[str, list[dict]], dict],
    max_turns: int = 6,
    retrieve: Callable[[str, dict], int] = lambda key, step: 1,
    most_tokens: int | None = None,
) -> DataFrame:
    """The loop over an opaque policy: ``key, turn, action, answer`` of every turn.

    A commit without a real answer becomes a retrieval before the last turn, and so does a refinement
    while ``retrieve`` (the number of hits of a step) has found nothing. Where the history outgrows
    ``most_tokens`` (a quarter of its characters), the policy sees its last turn only.

    A question's turns depend on each other and on nothing else, so questions are independent
    tasks; each batch runs its questions one after the other.
    """
    kind = questions.schema[key].dataType.simpleString()

    def play(batches):
        for batch in batches:
            rows = []
            for k in batch[key]:
                history: list[dict] = []
                hits = 0
                for turn in range(max_turns):
                    size = sum(len(h["answer"]) // 4 + len(h["action"]) // 4 for h in history)
                    seen = history[-1:] if most_tokens is not None and size > most_tokens else history
                    step = dict(policy(str(k), seen))
                    answer = (step.get("answer") or "").strip()
                    action = step.get("action") or "retrieve"
                    if action == "commit" and not _real(answer) and turn < max_turns - 1 or action == "refine" and not hits:
                        action = "retrieve"
                    if action == "retrieve":
                        hits += retrieve(str(k), step)
                    history.append({"turn": turn, "action": action, "answer": answer})
                    rows.append((k, turn, action, answer))
                    if action in ("commit", "decompose"):
                        break
            yield pd.DataFrame(rows, columns=[key, "turn", "action", "answer"])

    return questions.select(key).mapInPandas(play, f"`{key}` {kind}, turn int, action string, answer string")


def condition_records(rows: DataFrame, branches: dict[str, tuple[Column, dict[str, Column]]], base: list[str]) -> DataFrame:
    """One record for each row and condition it runs under; fields of other conditions are null."""
    out = None
    for name, (runs, fields) in branches.items():
        part = rows.where(runs).select(*base, F.lit(name).alias("condition"), *[c.alias(k) for k, c in fields.items()])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def advisory_flags(nvc: Column, kind_agrees: Column, coverage: Column, least_grounding: Column) -> Column:
    """Names of the guards that speak against a commit; they advise and never veto."""
    flag = lambda when, name: F.when(F.coalesce(when, F.lit(False)), F.lit(name))
    return F.filter(
        F.array(flag(nvc <= NVC_GATE, "low_nvc"), flag(~kind_agrees, "kind_mismatch"), flag(coverage < 1, "missing_entities"), flag(least_grounding < LEAST_SUPPORT, "weak_relevant_claim")),
        lambda x: x.isNotNull(),
    )


def second_pass(rows: DataFrame, weak: Column, again: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows whose claims are weak go through another pass, the others stay as they are."""
    return rows.where(~F.coalesce(weak, F.lit(False))).unionByName(again(rows.where(weak)), allowMissingColumns=True)


def with_error_rows(rows: DataFrame, key: str, work: Callable[[object], str], value: str, attempts: int = 1) -> DataFrame:
    """``key, result, error, error_type``: a row that fails after its attempts yields an error, the others go on."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for k, v in zip(batch[key], batch[value], strict=True):
                for attempt in range(attempts):
                    try:
                        out.append((k, str(work(v)), None, None))
                        break
                    except Exception as e:  # noqa: BLE001
                        if attempt == attempts - 1:
                            out.append((k, None, str(e), type(e).__name__))
            yield pd.DataFrame(out, columns=[key, "result", "error", "error_type"])

    return rows.select(key, value).mapInPandas(run, f"`{key}` {kind}, result string, error string, error_type string")
