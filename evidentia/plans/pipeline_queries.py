"""Queries of the general data-pipeline operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.operators.error_parse import parse_lines, rejected_rows
from evidentia.operators.nested_json import trajectory_tables
from evidentia.operators.packed_values import WITQA_POLICIES, unpack
from evidentia.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "trajectories", "result_id", "policy_trace", "planning_trace", "support")
    return trajectory_tables(rows, with_values=False).select("result_id", "child_table", "parent_pos", "pos")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "witqa_raw", "raw_id", "raw_line")
    return rejected_rows(parse_lines(lines, "raw_id", "raw_line"), "raw_id").select("raw_id", "reason")


def p4_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that fail, with the edits of the cheapest reading that state the reason."""
    lines = table(spark, sf_dir, "witqa_raw", "raw_id", "raw_line")
    return rejected_rows(parse_lines(lines, "raw_id", "raw_line"), "raw_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "witqa", "row_id", *WITQA_POLICIES)
    return unpack(rows, "row_id", WITQA_POLICIES, at_least=2).select("row_id", "src_field", "pos", "entry")


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_edits": p4_edits, "p6_found": p6_found}
#: These operators have no SQL equal; they are tested against brute force and round trips.
ORACLES: dict[str, str] = {}
