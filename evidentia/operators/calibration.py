"""Calibration of probabilities, overall and by group. Undefined measures are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.session import global_order


def usable(rows: DataFrame, score: str, prob: str, *keys: str) -> DataFrame:
    """Rows with a probability, clipped to [0, 1]."""
    p = F.col(prob)
    kept = rows.where(p.isNotNull() & ~F.isnan(p) & F.col(score).isNotNull())
    return kept.select(*keys, F.col(score).cast("double").alias("s"), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"))


def placed(rows: DataFrame, by: list[str], tie: str) -> DataFrame:
    """``rows`` (``s, p`` and the tie column) with their place ``r`` by probability within their
    group and its size ``n``. A group may be as large as the table: its order comes from the one
    global order less the place of its first row, never from one task that holds the group."""
    ordered = global_order(rows, *by, "p", tie)
    starts = ordered.groupBy(*by).agg(F.min("position").alias("_start"), F.count(F.lit(1)).alias("n"))
    joined = ordered.join(starts, by) if by else ordered.crossJoin(F.broadcast(starts))
    return joined.withColumn("r", F.col("position") - F.col("_start")).drop("position", "_start")


def ece(rows: DataFrame, by: list[str], tie: str, bins: int = 15) -> DataFrame:
    """Expected calibration error over bins of equal mass, with half-even rounding of the edges.

    The bin of a place is found in closed form from its neighbours, not by a range join; the tie
    column fixes the order of equal probabilities.
    """
    return ece_of(placed(rows, by, tie), by, bins)


def ece_of(ranked: DataFrame, by: list[str], bins: int = 15) -> DataFrame:
    guess = F.floor(F.col("r") * bins / F.col("n")).cast("int")
    edge = lambda b: F.bround(b * F.col("n") / F.lit(float(bins)), 0)
    near = F.filter(F.array(guess - 1, guess, guess + 1), lambda b: (edge(b) <= F.col("r")) & (F.col("r") < edge(b + 1)))
    binned = ranked.withColumn("bin", F.get(near, F.lit(0)))
    each = binned.groupBy(*by, "bin", "n").agg(F.count(F.lit(1)).alias("m"), F.avg("s").alias("ms"), F.avg("p").alias("mp"))
    return each.groupBy(*by).agg(F.sum(F.col("m") / F.col("n") * F.abs(F.col("ms") - F.col("mp"))).alias("ece"))


def auroc(rows: DataFrame, by: list[str]) -> DataFrame:
    """Area under the curve with mean ranks of ties; null where one class is missing."""
    return auroc_of(placed(rows, by, "s"), by)


def auroc_of(ranked: DataFrame, by: list[str]) -> DataFrame:
    """Equal probabilities share the mean of their places, whatever their order among each other."""
    ties = ranked.groupBy(*by, "p").agg(F.min("r").alias("first"), F.count(F.lit(1)).alias("m"), F.sum("s").alias("pos"))
    rank = F.col("first") + (F.col("m") + 1) / 2.0
    t = ties.groupBy(*by).agg(F.sum(rank * F.col("pos")).alias("sr"), F.sum("pos").alias("np"), F.sum("m").alias("n"))
    np, nn = F.col("np"), F.col("n") - F.col("np")
    return t.select(*by, F.when((np > 0) & (nn > 0), (F.col("sr") - np * (np + 1) / 2) / (np * nn)).alias("auroc"))


def brier() -> Column:
    return F.avg((F.col("s") - F.col("p")) * (F.col("s") - F.col("p")))


def saturation(prob: Column | str, level: float = 0.95) -> Column:
    """Share at or over the level; the probabilities are not clipped."""
    return F.avg((F.col(prob) if isinstance(prob, str) else prob).__ge__(level).cast("double"))


def separation() -> list[Column]:
    """Mean probability by class, their gap, and counts."""
    right, wrong = F.avg(F.when(F.col("s") == 1, F.col("p"))), F.avg(F.when(F.col("s") == 0, F.col("p")))
    return [
        right.alias("mean_correct"),
        wrong.alias("mean_incorrect"),
        (right - wrong).alias("gap"),
        F.count(F.when(F.col("s") == 1, 1)).alias("n_correct"),
        F.count(F.when(F.col("s") == 0, 1)).alias("n_incorrect"),
    ]


def all_measures(rows: DataFrame, by: list[str], tie: str, bins: int = 15) -> DataFrame:
    """Every measure of each group in one table."""
    ranked = placed(rows, by, tie)
    base = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), brier().alias("brier"), saturation("p").alias("saturation"), *separation())
    return base.join(ece_of(ranked, by, bins), by, "left").join(auroc_of(ranked, by), by, "left")
