"""Scans: JSON lines, tab-separated question sets, split folders, label and id files."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evidentia.functions.text import join_aliases
from evidentia.operators.aggregate import bucket, last_labels, tool_needed
from evidentia.operators.packed_values import ONLY_IF_ALONE, values_udf
from evidentia.operators.reshape import from_paragraphs, int_or_zero, is_pair_set, is_paragraph_set, pairs_to_columns, subset
from evidentia.session import listed, path_exists, ship_package

# The required columns of the tab-separated set, and other names of its splits.
REQUIRED_COLUMNS = (
    "output_question",
    "object_label",
    "object_surfaceform",
    "expanded_object_label",
    "subject_label",
    "predicate_label",
    "extracted_text",
    "sub_pred_count",
    "entity_count",
)
SPLIT_NAMES = {"validation": ("dev", "validation"), "train": ("train",), "test": ("test",)}


def with_ordinals(rows: DataFrame, name: str = "_source_line") -> DataFrame:
    """Numbers from 1 in the order of the files, without sorting: place in the task plus the sizes of the tasks before."""
    part = rows.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    sizes = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_m"))
    before = F.sum("_m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # one row a task
    numbered = part.join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, F.col("_id") - F.shiftleft(F.col("_part").cast("long"), 33) + F.col("_before") + 1).drop("_part", "_id", "_before")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True, line: str | None = "_source_line") -> DataFrame:
    """JSON lines with their line number; blank lines are skipped, bad ones raise or are dropped."""
    raw = spark.read.text(path)
    if line:
        raw = with_ordinals(raw, line)
    kept = raw.where(F.trim("value") != "")
    mode = "FAILFAST" if strict else "PERMISSIVE"
    parsed = kept.withColumn("_r", F.from_json("value", schema, {"mode": mode}))
    if not strict:
        parsed = parsed.where(F.try_parse_json("value").isNotNull())
    return parsed.select(*([line] if line else []), "_r.*")


def split_table(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Parquet of one split of a saved set; a missing split names those that exist."""
    for candidate in (f"{folder}/{split}", f"{folder}/{split}.parquet"):
        if path_exists(spark, candidate):
            return spark.read.parquet(candidate)
    found = sorted(os.path.splitext(x)[0] for x in listed(spark, folder))
    raise FileNotFoundError(f"no split {split!r} in {folder}; available: {', '.join(found) or 'none'}")


def question_set_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated set of single-relation questions in canonical form."""
    ship_package(spark)
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    lacking = [c for c in REQUIRED_COLUMNS if c not in raw.columns]
    if lacking:
        raise ValueError(f"columns missing: {', '.join(lacking)}")
    rows = with_ordinals(raw, "_line").where(F.trim(F.coalesce("output_question", F.lit(""))) != "")
    more = F.transform(values_udf(ONLY_IF_ALONE)(F.col("expanded_object_label")), lambda v: v["entry"])
    aliases = F.array_join(
        F.array_distinct(F.filter(F.concat(F.array(F.trim("object_label"), F.trim("object_surfaceform")), F.coalesce(more, F.array().cast("array<string>"))), lambda x: x != "")), "|"
    )
    count = F.col("sub_pred_count")
    return rows.select(
        F.format_string("witqa_%06d", F.col("_line") - 1).alias("qid"),
        F.trim("output_question").alias("question_text"),
        aliases.alias("gold_answer"),
        F.trim("subject_label").alias("subject"),
        F.trim("predicate_label").alias("relation"),
        F.trim("extracted_text").alias("supporting_passage"),
        int_or_zero(count).alias("sr_count"),
        int_or_zero(F.col("entity_count")).alias("s_count"),
        bucket(int_or_zero(count)).alias("popularity_bucket"),
        tool_needed(int_or_zero(count)).alias("paper_tool_needed"),
    )


def pair_set(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """A set whose contexts are ``[title, [sentence]]`` pairs, from JSON or JSON lines under any of its split's names."""
    for name in SPLIT_NAMES.get(split, (split,)):
        for ending, whole in ((".jsonl", False), (".json", True)):
            path = f"{folder}/{name}{ending}"
            if path_exists(spark, path):
                schema = "_id string, id string, question string, answer string, type string, context string, supporting_facts string"
                rows = spark.read.schema(schema).option("multiLine", whole).json(path)
                facts = F.transform(F.from_json("supporting_facts", "array<string>"), lambda r: F.from_json(r, "array<string>"))
                return rows.select(
                    F.coalesce("_id", "id").alias("question_id"),
                    "question",
                    "answer",
                    "type",
                    pairs_to_columns(F.col("context")).alias("context"),
                    F.struct(
                        F.transform(facts, lambda f: F.get(f, F.lit(0))).alias("title"),
                        F.transform(facts, lambda f: F.get(f, F.lit(1)).cast("int")).alias("sent_id"),
                    ).alias("supporting_facts"),
                )
    raise FileNotFoundError(f"no file of split {split!r} in {folder}")


def paragraph_set(spark: SparkSession, path: str) -> DataFrame:
    schema = "id string, question string, answer string, answer_aliases array<string>, paragraphs array<struct<idx int,title string,paragraph_text string,is_supporting boolean>>"
    return from_paragraphs(spark.read.schema(schema).json(path))


def examples(
    spark: SparkSession, name: str, folder: str, split: str, example_id: str | None = None, pool: int | None = None, shuffle: bool = False, seed: int = 0, limit: int | None = None
) -> DataFrame:
    """A set by its name: adapted, one example or a pool, shuffled, limited."""
    if is_paragraph_set(name):
        rows = paragraph_set(spark, os.path.join(folder, f"{split}.jsonl"))
    elif is_pair_set(name):
        rows = pair_set(spark, folder, split)
    else:
        rows = split_table(spark, folder, split)
    if example_id is not None:
        return rows.where(F.col("question_id") == example_id)
    if pool:
        rows = rows.orderBy("question_id").limit(pool)
    if shuffle:
        return subset(rows, "question_id", seed, 0, limit)
    return rows.orderBy("question_id").limit(limit) if limit and limit > 0 else rows


def labels_last_wins(spark: SparkSession, path: str, order: str | None = None) -> DataFrame:
    """Tool-needed labels; bad lines are skipped and of repeated ids the last line holds, or the one
    of the greatest ``order`` where the lines have such a number."""
    number = f", `{order}` bigint" if order else ""
    rows = json_lines(spark, path, f"qid string, tool_needed boolean, n_correct int{number}", strict=False, line=None if order else "_source_line")
    return last_labels(rows.where("qid IS NOT NULL"), "qid", order or "_source_line").select("qid", "tool_needed", "n_correct")


def by_id_file(spark: SparkSession, rows: DataFrame, key: str, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows named in a file of ids, in its order, and the ids that no row has."""
    ids = with_ordinals(spark.read.text(path), "_order").select(F.trim("value").alias(key), "_order").where(F.col(key) != "")
    found = rows.join(ids, key).orderBy("_order")
    return found, ids.join(rows.select(key), key, "left_anti").select(key)


def configured(defaults: dict, *overrides: dict) -> dict:
    """Settings by precedence; nested groups are merged, unknown names raise."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in defaults.items()}
    for more in overrides:
        for k, v in more.items():
            if k not in out:
                raise KeyError(k)
            out[k] = {**out[k], **v} if isinstance(out[k], dict) else v
    return out


def named(columns: Sequence[str], df: DataFrame) -> DataFrame:
    return df.select(*columns)
