"""Answer scores and grounding. Each token F1 belongs to one metric; guards differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import (
    compatible_form,
    nfkc,
    official_form,
    official_words,
    overlap,
    reward_form,
    split_aliases,
    trivia_form,
    words,
)


def f1_of(p: Column, g: Column) -> Column:
    """F1 of two token arrays; 0 where nothing is common."""
    n = overlap(p, g)
    precision, recall = n / F.size(p), n / F.size(g)
    return F.when((F.size(p) == 0) | (F.size(g) == 0) | (n == 0), F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def best(golds: Column, score) -> Column:
    return F.coalesce(F.array_max(F.transform(golds, score)), F.lit(0.0))


def exact_any(prediction: Column, golds: Column) -> Column:
    """1 where the prediction equals any gold answer in trivia form."""
    return F.exists(golds, lambda g: trivia_form(g) == trivia_form(prediction)).cast("int")


def exact_official(prediction: Column, gold: Column) -> Column:
    return (official_form(prediction) == official_form(gold)).cast("int")


def exact_alias(prediction: Column, gold: Column) -> Column:
    """1.0 where the prediction equals an alternative; an empty prediction never does."""
    p = compatible_form(prediction)
    forms = F.transform(split_aliases(nfkc(gold)), lambda a: official_form(a))
    return F.when(p == "", F.lit(0.0)).otherwise(F.array_contains(forms, p).cast("double"))


def f1_any(prediction: Column, golds: Column) -> Column:
    """Best trivia-form F1; without prediction tokens 1.0 only where there are no golds."""
    p = words(trivia_form(prediction))
    none = F.when(F.size(golds) == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(F.size(p) == 0, none).otherwise(best(golds, lambda g: f1_of(p, words(trivia_form(g)))))


def f1_official(prediction: Column, gold: Column) -> Column:
    """``f1, precision, recall``; with either side empty, f1 tells whether both are."""
    p, g = official_words(prediction), official_words(gold)
    n = overlap(p, g)
    hollow = (F.size(p) == 0) | (F.size(g) == 0)
    both = ((F.size(p) == 0) & (F.size(g) == 0)).cast("double")
    precision = F.when(hollow | (n == 0), F.lit(0.0)).otherwise(n / F.size(p))
    recall = F.when(hollow | (n == 0), F.lit(0.0)).otherwise(n / F.size(g))
    return F.struct(F.when(hollow, both).otherwise(f1_of(p, g)).alias("f1"), precision.alias("precision"), recall.alias("recall"))


def f1_alias(prediction: Column, gold: Column) -> Column:
    """Best official F1 over alternatives."""
    p = official_words(prediction)
    return best(split_aliases(gold), lambda a: f1_of(p, official_words(a)))


def f1_reward(prediction: Column, gold: Column, floor: bool = True) -> Column:
    """Reward-form F1; with the length floor a one-word prediction of a gold of three words or more scores 0."""
    p, g = words(reward_form(prediction)), words(reward_form(gold))
    score = f1_of(p, g)
    return F.when((F.size(p) < 2) & (F.size(g) >= 3), F.lit(0.0)).otherwise(score) if floor else score


def title_recall(selected: Column, gold: Column) -> Column:
    """Share of the distinct gold titles among the selected ones."""
    return F.size(F.array_intersect(selected, gold)) / F.greatest(F.size(F.array_distinct(gold)), F.lit(1))


def grounding(matrix: Column) -> Column:
    """Claims by passages: the best passage of each claim, then mean and least over claims; none gives zeros."""
    rows = F.filter(F.transform(F.coalesce(matrix, F.array().cast("array<array<double>>")), lambda r: F.array_max(r)), lambda x: x.isNotNull())
    n = F.size(rows)
    mean = F.aggregate(rows, F.lit(0.0), lambda s, x: s + x) / n
    return F.struct(rows.alias("claim_supports"), F.when(n == 0, 0.0).otherwise(mean).alias("g_mean"), F.when(n == 0, 0.0).otherwise(F.array_min(rows)).alias("g_min"))


def is_supported(g_mean: Column, g_min: Column, mean_gate: float = 0.70, min_gate: float = 0.50) -> Column:
    return F.coalesce((g_mean >= mean_gate) & (g_min >= min_gate), F.lit(False))


def has_weak_claim(supports: Column, gate: float = 0.50) -> Column:
    return F.coalesce(F.exists(supports, lambda s: s < gate), F.lit(False))


def both_ways(forward: Column, backward: Column) -> Column:
    """Entailment in both directions is the lesser of the two."""
    return F.least(forward, backward)


def skipped_support() -> Column:
    """The support of a step that was not scored: nulls, not zeros."""
    none = F.lit(None).cast("double")
    return F.struct(none.alias("g_mean"), none.alias("g_min"), F.array().cast("array<double>").alias("claim_supports"))


def grounded_claims(claims: DataFrame, passages: DataFrame, by: list[str], claim: str, passage: str, scorer) -> DataFrame:
    """``by, claims, g_mean, g_min``: every claim against the passages of its group, the best passage of
    each claim, mean and least over claims; without passages zeros. Partial maxima are taken before
    the shuffle, so a group with many passages does not meet in one task."""
    each = claims.select(*by, F.col(claim).alias("_c")).where("_c IS NOT NULL").distinct()
    pairs = each.join(passages.select(*by, F.col(passage).alias("_p")), by)
    best_of = pairs.groupBy(*by, "_c").agg(F.max(scorer(F.col("_p"), F.col("_c"))).alias("s"))
    full = each.join(best_of, [*by, "_c"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    return full.groupBy(*by).agg(F.count(F.lit(1)).alias("claims"), F.avg("s").alias("g_mean"), F.min("s").alias("g_min"))


def whole_evidence_support(claim: Column, passages: Column, scorer) -> Column:
    """A claim against all passages joined to one text."""
    return scorer(F.array_join(passages, "\n"), claim)


def single_claim(question: Column, answer: Column) -> Column:
    """Question and answer as the one claim to be scored."""
    return F.concat_ws(" ", F.nullif(F.trim(question), F.lit("")), F.nullif(F.trim(answer), F.lit("")))
