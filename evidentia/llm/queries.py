"""Queries of the training-corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.canonical_text import canonical_texts
from evidentia.llm.chunk_split import split_oversized
from evidentia.llm.language import document_languages
from evidentia.llm.leakage import leaked_items
from evidentia.llm.pair_defects import pair_defects
from evidentia.llm.split_overlap import cross_split_pairs
from evidentia.llm.tokenise import token_ids
from evidentia.session import first_of_each, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "evidence_docs", "evid_id", "context_text")
    return split_oversized(docs, "evid_id", "context_text").select("evid_id", "chunk_index", "start_word", "end_word")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, key, column in (("witqa", "row_id", "gold_answer"), ("agent_turns", "turn_id", "answer")):
        # A value of ASCII characters alone can hold no other; it need not go to SQL.
        rows = table(spark, sf_dir, name, key, column).where(F.col(column).rlike(r"[^\t\n\r -~]"))
        hit = first_of_each(canonical_texts(rows, key, column).where("disguised").select(key), key)
        part = hit.select(F.lit(name).alias("tbl"), F.col(key).alias("row_id"))
        out = part if out is None else out.unionByName(part)
    return out


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "trajectories", "result_id", "question", "pred_answer_raw")
    pairs = table(spark, sf_dir, "sft_pairs", "pair_id", "messages", "target")
    turns = table(spark, sf_dir, "agent_turns", "turn_id", "subquestion", "action")
    asked = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"]
    return pair_defects(
        {
            "trajectories": (runs, "result_id", F.col("question"), F.col("pred_answer_raw")),
            "sft_pairs": (pairs, "pair_id", asked, F.col("target")),
            "agent_turns": (turns, "turn_id", F.col("subquestion"), F.col("action.reason")),
        },
        actions=frozenset({"sft_pairs"}),
    )


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "examples", "example_id", "question", "question_id", "split")
    return cross_split_pairs(rows)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir).select(F.least("id_e", "id_t").alias("id_lo"), F.greatest("id_e", "id_t").alias("id_hi"))


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs and held-out examples concerned, by split and source."""
    rows = table(spark, sf_dir, "examples", "example_id", "split", "source")
    pairs = _overlaps(spark, sf_dir)
    named = pairs.join(rows.withColumnRenamed("example_id", "id_e"), "id_e")
    each = named.groupBy("split", "source", "id_e").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("split", "source").agg(F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("examples"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    items = table(spark, sf_dir, "eval_items", "item_id", "text")
    return leaked_items(docs, items).select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = document_languages(docs).where("mislabelled").select("doc_id", F.explode("segments").alias("s"))
    return found.select("doc_id", F.col("s.seg_no").alias("seg_no"), F.col("s.lang").alias("lang"))


def p10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document (null without words), and whether its label holds."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = document_languages(docs)
    return found.select("doc_id", "lang", F.round("confidence", 6).alias("confidence"), F.size("segments").alias("segments"), "mislabelled")


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, confidence and offsets of every segment of every document."""
    found = document_languages(table(spark, sf_dir, "documents", "doc_id", "text", "lang")).select("doc_id", F.inline("segments"))
    return found.select("doc_id", "seg_no", "lang", F.round("confidence", 6).alias("confidence"), "start", "end")


QUERIES = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p7_found": p7_found,
    "p7_counts": p7_counts,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p10_found": p10_found,
    "p10_documents": p10_documents,
    "p10_segments": p10_segments,
}
ORACLES: dict[str, str] = {}
