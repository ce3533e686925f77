"""Training rows: pairs out of traces, selection by quality and cost, rewards and advantages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.scoring import f1_reward
from evidentia.session import global_order

# The reward's weights and budget, and the length gates of training pairs.
ALPHA, BETA, BUDGET = 2.0, 0.15, 9
LEAST_ANALYSIS, LEAST_REASON = 20, 10


def lm_calls(trace: Column) -> Column:
    """Number of agent turns in a trace."""
    return F.size(F.filter(F.coalesce(trace, F.array().cast("array<struct<action string>>")), lambda e: e["action"] == "agent_turn"))


def call_count(trace: Column) -> Column:
    return F.coalesce(F.size(F.filter(trace, lambda e: e["action"] == "agent_turn")), F.lit(0))


def pareto_quartile(rows: DataFrame, key: str, quality: Column, cost: Column) -> DataFrame:
    """The quarter of rows (one at least) with the least sum of places by quality and by cost.
    Equal values keep the order of the key."""
    base = rows.select(key, quality.alias("_q"), cost.alias("_c"))
    by_quality = global_order(base, F.col("_q").desc(), key, name="by_quality")
    joint = global_order(by_quality, "_c", key, name="by_cost").withColumn("joint", F.col("by_quality") + F.col("by_cost"))
    total = base.agg(F.greatest(F.lit(1), F.expr("count(1) div 4")).alias("_cut"))  # one row
    placed = global_order(joint.select(key, "joint"), "joint", key)
    return placed.crossJoin(F.broadcast(total)).where(F.col("position") < F.col("_cut")).select(key, "joint")


def target_json(action: Column, query: Column, analysis: Column, reason: Column, answer: Column) -> Column:
    """The strict action object: a query only to retrieve, an answer only to commit."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return F.to_json(
        F.struct(
            action.alias("action"),
            text(analysis).alias("analysis"),
            text(reason).alias("reason"),
            F.when(action == "retrieve", text(query)).alias("query"),
            F.when(action == "commit", text(answer)).alias("answer"),
        )
    )


def training_pairs(runs: DataFrame, key: str, trace: str, answer: str) -> DataFrame:
    """One row for each agent turn whose analysis and reason say enough, with its target."""
    turns = runs.select(key, answer, F.posexplode(trace).alias("pos", "e")).where("e.action = 'agent_turn'")
    d = "e.details."
    long_enough = (F.length(F.trim(F.coalesce(d + "action_analysis", F.lit("")))) >= LEAST_ANALYSIS) & (
        F.length(F.trim(F.coalesce(d + "action_reason", F.lit("")))) >= LEAST_REASON
    )
    target = target_json(F.col(d + "action"), F.col(d + "action_query"), F.col(d + "action_analysis"), F.col(d + "action_reason"), F.col(answer))
    return turns.where(long_enough).select(key, "pos", F.coalesce(d + "turn", F.lit(-1)).alias("turn"), F.col(d + "action").alias("action_type"), target.alias("target"))


def reward(prediction: Column, gold: Column, calls: Column) -> Column:
    return ALPHA * f1_reward(prediction, gold) - BETA * F.least(F.coalesce(calls, F.lit(BUDGET)) / F.lit(float(BUDGET)), F.lit(1.0))


def advantages(rows: DataFrame, prompt: str, value: str) -> DataFrame:
    """Reward less the mean of its prompt's group; a hot prompt is aggregated before it is joined."""
    means = rows.groupBy(prompt).agg(F.avg(value).alias("_mean"))
    return rows.join(means, prompt).withColumn("advantage", F.col(value) - F.col("_mean")).drop("_mean")


def cyclic_batch(position: Column, n_rows: int, step: int, size: int) -> Column:
    """Is the row at this position in the batch of this step, batches running on cyclically?"""
    return F.pmod(position - step * size, F.lit(n_rows)) < size


def step_seed(seed: int, step: Column, slot: Column, rollout: Column) -> Column:
    return seed + step * 1000 + slot * 10 + rollout


def with_assistant(messages: Column, target: Column) -> Column:
    """Chat messages that end with the target, once."""
    said = F.get(messages, F.size(messages) - 1)["role"] == "assistant"
    turn = F.struct(F.lit("assistant").alias("role"), target.alias("content"))
    return F.when(F.coalesce(said, F.lit(False)), messages).otherwise(F.concat(messages, F.array(turn)))
