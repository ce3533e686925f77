"""Histograms, popularity buckets, run summaries, resume sets and other aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The popularity buckets, right-open, and the count under which a tool is needed.
BUCKETS = (("1-9", 10), ("10-49", 50), ("50-99", 100), ("100-499", 500), ("500-999", 1000), ("1000-4999", 5000), ("5000+", None))
TOOL_NEEDED_BELOW = 50


def histogram(rows: DataFrame, value: Column, *by: str) -> DataFrame:
    """Counts by the value as text, nulls as a value of their own."""
    return rows.groupBy(*by, F.coalesce(value.cast("string"), F.lit("null")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def bucket(count: Column) -> Column:
    """Popularity bucket of a count; what is no count, or under 1, falls into the lowest."""
    c = count.try_cast("double")
    out = F.when(c.isNull() | (c < 1), BUCKETS[0][0])
    for name, below in BUCKETS[:-1]:
        out = out.when(c < below, name)
    return out.otherwise(BUCKETS[-1][0])


def tool_needed(count: Column) -> Column:
    return F.coalesce(count.try_cast("double") < TOOL_NEEDED_BELOW, F.lit(True))


def by_bucket(rows: DataFrame, count: Column, value: Column) -> DataFrame:
    """Size and mean of every bucket, empty ones with 0; null values do not count."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(name,) for name, _ in BUCKETS], "bucket string")
    kept = rows.select(bucket(count).alias("bucket"), value.alias("v")).where("v IS NOT NULL")
    means = kept.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    return every.join(means, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"))


def last_labels(labels: DataFrame, key: str, order: str) -> DataFrame:
    """Of repeated labels the last one."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return labels.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def attach_labels(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Labels by key, null where missing."""
    return rows.join(labels, key, "left")


def completed_everywhere(results: DataFrame, key: str, condition: str, n_conditions: int) -> DataFrame:
    """Keys with a result under every condition."""
    return results.groupBy(key).agg(F.countDistinct(condition).alias("_n")).where(F.col("_n") == n_conditions).select(key)


def completed_pairs(results: DataFrame, key: str, condition: str, error: Column) -> DataFrame:
    """Distinct ``key+condition`` of results without error."""
    return results.where(error.isNull()).select(F.concat_ws("+", key, condition).alias("done")).distinct()


def still_to_do(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    return rows.join(done.select(*keys), list(keys), "left_anti")


def coverage(rows: DataFrame, *fields: str) -> list[Column]:
    """Share of rows in which each field says something."""
    return [F.avg((F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) != "").cast("double")).alias(f"{f.replace('.', '_')}_coverage") for f in fields]


def require_coverage(rows: DataFrame, least: float, *fields: str) -> None:
    """Raise where a field says too little."""
    shares = rows.agg(*coverage(rows, *fields)).first().asDict()
    short = {k: v for k, v in shares.items() if v is None or v < least}
    if short:
        raise ValueError(f"coverage under {least}: {short}")


def paired_arms(rows: DataFrame, key: str, arm: str, first: str, second: str, *measures: str) -> DataFrame:
    """Both arms' measures of the same keys, and their differences."""
    side = lambda name, p: rows.where(F.col(arm) == name).select(key, *[F.col(m).alias(f"{p}_{m}") for m in measures])
    both = side(first, "a").join(side(second, "b"), key)
    return both.select("*", *[(F.col(f"a_{m}") - F.col(f"b_{m}")).alias(f"d_{m}") for m in measures])


def ordered_union(*parts: DataFrame, key: str) -> DataFrame:
    """Keys of all parts, each once, in the order of its first place."""
    rows = None
    for i, part in enumerate(parts):
        numbered = part.select(F.col(key), F.lit(i).alias("part"))
        rows = numbered if rows is None else rows.unionByName(numbered)
    return rows.groupBy(key).agg(F.min("part").alias("part"))


def best_child(children: DataFrame, parent: str, answer: str, *signals: str) -> DataFrame:
    """Answer of the child with the greatest signals in order, and each signal's greatest value."""
    ranked = F.struct(*[F.coalesce(F.col(s), F.lit(-1.0)) for s in signals], F.col(answer))
    return children.groupBy(parent).agg(F.max_by(answer, ranked).alias(answer), *[F.max(s).alias(s) for s in signals])
