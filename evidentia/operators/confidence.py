"""Confidence of answers: candidate dedupe, P(True), NVC, self-consistency and their blends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions.text import dedupe_key, first_line_answer, sampling_form
from evidentia.operators.retrieval import vector_cosine, vector_terms
from evidentia.operators.scoring import both_ways
from evidentia.session import global_order


def distinct_candidates(candidates: DataFrame, example: str, text: str, score: str, tie: str) -> DataFrame:
    """Cleaned candidates, of equal keys the one of the highest score (then the least tie)."""
    clean = candidates.withColumn("clean", first_line_answer(text)).where("clean <> ''").withColumn("_key", dedupe_key(text))
    best = Window.partitionBy(example, "_key").orderBy(F.col(score).desc(), F.col(tie))
    return clean.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_key")


def greedy_first(candidates: DataFrame, example: str, text: str, is_greedy: str, tie: str) -> DataFrame:
    """Distinct candidates in sampling form with the greedy one at place 0."""
    keyed = candidates.withColumn("_key", sampling_form(text)).where("_key <> ''")
    best = Window.partitionBy(example, "_key").orderBy(F.col(is_greedy).desc(), F.col(tie))
    kept = keyed.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_key")
    # Places come from one global order, so that an example with very many candidates is no single task.
    ordered = global_order(kept, example, F.col(is_greedy).desc(), tie)
    starts = ordered.groupBy(example).agg(F.min("position").alias("_start"))
    return ordered.join(starts, example).withColumn("place", F.col("position") - F.col("_start")).drop("position", "_start")


def ptrue(yes_logprobs: Column, no_logprobs: Column, least_mass: float = 0.5) -> Column:
    """Share of yes in the mass of yes and no; null where the mass is under ``least_mass``."""
    mass = lambda xs: F.aggregate(F.coalesce(xs, F.array().cast("array<double>")), F.lit(0.0), lambda s, x: s + F.exp(x))
    yes, no = mass(yes_logprobs), mass(no_logprobs)
    return F.when(yes + no < least_mass, F.lit(None)).otherwise(yes / (yes + no))


def ptrue_or_half(yes_logprobs: Column, no_logprobs: Column) -> Column:
    return F.coalesce(ptrue(yes_logprobs, no_logprobs), F.lit(0.5))


def ptrue_of_logits(yes: Column, no: Column) -> Column:
    return 1 / (1 + F.exp(no - yes))


def symmetric_pairs(nli: DataFrame, example: str = "ex") -> DataFrame:
    """Means of both directions of every ordered pair."""
    other = nli.select(example, F.col("i").alias("j"), F.col("j").alias("i"), F.col("entail").alias("_e"), F.col("contra").alias("_c"))
    both = nli.join(other, [example, "i", "j"])
    return both.select(example, "i", "j", ((F.col("entail") + F.col("_e")) / 2).alias("entail"), ((F.col("contra") + F.col("_c")) / 2).alias("contra"))


def nvc(candidates: DataFrame, nli: DataFrame, eps: float = 1e-9, example: str = "ex", sentinel: bool = False) -> DataFrame:
    """``ex, nvc`` from ``ex, j, ptrue`` (the answer at j = 0) and ``ex, i, j, entail, contra``.

    Each distractor counts by its contradiction of the answer, the mean of both directions, over
    its degree (1 and its entailments by others, the answer aside); scores that are null do not
    count. With ``sentinel`` a negative score ends the candidates: it and all after it are padding;
    without, only the negative ones themselves do not count.
    """
    entailed = F.greatest(F.lit(0.0), F.col("entail"))
    degree = nli.groupBy(example, "j").agg((F.lit(1.0) + F.sum(entailed)).alias("degree"), F.max(F.when(F.col("i") == 0, F.col("entail"))).alias("e0"))
    to_answer = symmetric_pairs(nli, example).where("i = 0").select(example, "j", F.col("contra").alias("c0"))
    p0 = candidates.where("j = 0").select(example, F.col("ptrue").alias("p0"))
    if sentinel:
        ends = candidates.where((F.col("j") > 0) & (F.col("ptrue") < 0)).groupBy(example).agg(F.min("j").alias("_end"))
        candidates = candidates.join(ends, example, "left").where(F.col("_end").isNull() | (F.col("j") < F.col("_end"))).drop("_end")
    others = candidates.where((F.col("j") > 0) & F.col("ptrue").isNotNull() & ~F.isnan("ptrue") & (F.col("ptrue") >= 0))
    share = F.col("ptrue") * F.col("c0") / (F.col("degree") - F.col("e0") + eps)
    added = others.join(to_answer, [example, "j"]).join(degree, [example, "j"]).groupBy(example).agg(F.sum(share).alias("added"))
    total = F.col("p0") + F.coalesce("added", F.lit(0.0))
    return p0.join(added, example, "left").select(example, F.when(total > 1, F.col("p0") / total).otherwise(F.col("p0")).alias("nvc"))


def self_consistency(entailments: Column, threshold: float = 0.9) -> Column:
    """Share of samples that agree (strictly over the threshold), the answer itself counting as one."""
    e = F.coalesce(entailments, F.array().cast("array<double>"))
    return (F.size(F.filter(e, lambda x: x > threshold)) + 1) / (F.size(e) + 1)


def sample_agreement(a: Column, b: Column, forward: Column, backward: Column) -> Column:
    """1 for equal cleaned answers, 0 for an empty one, else the mean of both entailments."""
    x, y = first_line_answer(a), first_line_answer(b)
    return F.when(y == "", 0.0).when(x == y, 1.0).otherwise((forward + backward) / 2)


def blend(nvc_score: Column, consistency: Column) -> Column:
    return (nvc_score + consistency) / 2


def combined_prior(nvc_score: Column, grounding: Column, weight: float = 0.6) -> Column:
    return weight * nvc_score + (1 - weight) * grounding


def agreement(samples: DataFrame, example: str, text: str, is_greedy: str) -> DataFrame:
    """``agreement_rate, n_distractors, degenerate``: samples against the greedy answer in sampling form."""
    greedy = samples.where(F.col(is_greedy)).groupBy(example).agg(F.min(sampling_form(text)).alias("_g"))
    other = samples.where(~F.col(is_greedy)).select(example, sampling_form(text).alias("_s"))
    both = greedy.join(other, example, "left")
    return both.groupBy(example, "_g").agg(
        F.coalesce(F.avg((F.col("_s") == F.col("_g")).cast("double")), F.lit(1.0)).alias("agreement_rate"),
        F.countDistinct(F.when((F.col("_s") != F.col("_g")) & (F.col("_s") != ""), F.col("_s"))).alias("n_distractors"),
    ).select(example, "agreement_rate", "n_distractors", (F.col("n_distractors") == 0).alias("degenerate"))


def without_dropped(rows: DataFrame, reasons: DataFrame, example: str) -> DataFrame:
    """Rows of all conditions without the examples that any condition dropped."""
    return rows.join(reasons.select(example).distinct(), example, "left_anti")


def shortest_equal_beam(beams: DataFrame, example: str, text: str, entailment: str, most_words: int = 6, least: float = 0.55) -> DataFrame:
    """Of the short beams that entail the answer enough, the best one; ties take fewer words, then characters."""
    n = F.size(F.split(F.trim(text), r"\s+"))
    fit = beams.where((n <= most_words) & (F.col(entailment) >= least))
    w = Window.partitionBy(example).orderBy(F.col(entailment).desc(), n, F.length(text), F.col(text))
    return fit.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def semantic_distractors(candidates: DataFrame, example: str, text: str, place: str, scorer, near: float = 0.9, most: float = 0.8) -> DataFrame:
    """``example, text, place`` of the distractors that stay: in order of place (the answer at 0), each is
    dropped that the answer and it entail both ways, or that lies near a kept one or both entail each other.

    All scores are column expressions over the pairs of an example's few candidates; only the greedy
    choice, which depends on all before it, folds over one example's pairs that are too close.
    """
    a = candidates.select(F.col(example).alias("_ex"), F.col(place).alias("i"), F.col(text).alias("_a"))
    b = candidates.select(F.col(example).alias("_ex"), F.col(place).alias("j"), F.col(text).alias("_b"))
    x, y = F.col("_a"), F.col("_b")
    alike = both_ways(scorer(x, y), scorer(y, x)) > most
    close = F.when(F.col("i") == 0, alike).otherwise((vector_cosine(vector_terms(x), vector_terms(y)) > near) | alike)
    pairs = a.join(b, "_ex").where("i < j").where(close).groupBy("_ex").agg(F.collect_list(F.struct("i", "j")).alias("_close"))
    listed = candidates.where(F.col(place) > 0).groupBy(F.col(example).alias("_ex")).agg(F.sort_array(F.collect_list(F.col(place))).alias("_places"))
    both = listed.join(pairs, "_ex", "left").withColumn("_close", F.coalesce("_close", F.array().cast("array<struct<i:int,j:int>>")))
    kept = F.aggregate(
        "_places",
        F.array(F.lit(0)),
        lambda kept, p: F.when(F.exists("_close", lambda c: (c["j"] == p) & F.array_contains(kept, c["i"])), kept).otherwise(F.concat(kept, F.array(p))),
    )
    stays = both.select(F.col("_ex").alias(example), F.explode(F.filter(kept, lambda p: p > 0)).alias(place))
    return candidates.join(stays, [example, place]).select(example, text, place)


def entailments(candidates: DataFrame, example: str, place: str, text: str, scorer) -> DataFrame:
    """``ex, i, j, entail, neutral, contra`` of all ordered pairs of an example's few candidates."""
    a = candidates.select(F.col(example).alias("ex"), F.col(place).alias("i"), F.col(text).alias("_a"))
    b = candidates.select(F.col(example).alias("ex"), F.col(place).alias("j"), F.col(text).alias("_b"))
    e = scorer(F.col("_a"), F.col("_b"))
    return a.join(b, "ex").where("i <> j").select("ex", "i", "j", e.alias("entail"), F.lit(0.0).alias("neutral"), (1 - e).alias("contra"))


def end_to_end(candidates: DataFrame, example: str, place: str, text: str, ptrue_score: str, scorer, eps: float = 1e-9) -> DataFrame:
    """``ex, nvc, sc_conf, dinco`` of distinct candidates numbered from 0, the answer first."""
    nli = entailments(candidates, example, place, text, scorer)
    scored = candidates.select(F.col(example).alias("ex"), F.col(place).alias("j"), F.col(ptrue_score).alias("ptrue"))
    by_nvc = nvc(scored, nli, eps)
    to_answer = nli.where("j = 0").groupBy("ex").agg(F.collect_list("entail").alias("_e"))  # as many as an example has candidates
    both = by_nvc.join(to_answer, "ex", "left").withColumn("sc_conf", self_consistency(F.col("_e")))
    return both.select("ex", "nvc", "sc_conf", blend(F.col("nvc"), F.col("sc_conf")).alias("dinco"))
