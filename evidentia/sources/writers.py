"""Sinks: JSON, appended and idempotent results, index folders, file names."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.session import write_text


def write_json(spark: SparkSession, row: dict, path: str) -> None:
    """One pretty-printed object, ASCII-escaped; for summaries of one row."""
    write_text(spark, json.dumps(row, indent=2, ensure_ascii=True, default=str) + "\n", path)


def write_summary(df: DataFrame, path: str) -> dict:
    row = df.first()
    found = row.asDict(recursive=True) if row else {}
    write_json(df.sparkSession, found, path)
    return found


def write_json_lines(df: DataFrame, path: str, mode: str = "error") -> int:
    """Writes and returns the number of rows, counted on the way, not by a second pass."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return int(seen.get["n"])


def append_json_lines(df: DataFrame, path: str) -> int:
    return write_json_lines(df, path, "append")


def overwrite_conditions(df: DataFrame, path: str, condition: str = "condition") -> None:
    """Replaces the partitions of the conditions at hand and no others, so a repeated run changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(condition).parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def prompt_samples(prompts: DataFrame, condition: str, order: str, text: str, word: str) -> DataFrame:
    """The first prompt of each condition, and whether it names what it must not."""
    w = Window.partitionBy(condition).orderBy(order)
    first = prompts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.withColumn("leaks", F.contains(F.lower(text), F.lit(word.lower())))


def slug(name: str) -> str:
    return re.sub(r"-{2,}", "-", re.sub(r"[^A-Za-z0-9._-]+", "-", name.strip())).strip("-") or "unnamed"


def limit_suffix(limit: int | None) -> str:
    return "all" if limit is None else f"n{limit}"


def usable_limit(limit: int | None) -> int | None:
    return None if limit is None or limit <= 0 else limit


def subset_stem(dataset: str, config: str, split: str, seed: int, limit: int | None) -> str:
    return f"{slug(dataset)}_{slug(config)}_{slug(split)}_s{seed}_{limit_suffix(limit)}"


def result_path(folder: str, dataset: str, condition: str, seed: int, limit: int | None) -> str:
    return os.path.join(folder, f"{slug(dataset)}_{slug(condition)}_s{seed}_{limit_suffix(limit)}")
