"""Schemas of the logical tables, as DDL, and a check of columns before any work is done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SNAPSHOT = "struct<answer:string,nvc:double,sc_conf:double,dinco_conf:double,g_mean:double,g_min:double,claim_supports:array<double>>"
ACTION = "struct<type:string,query:string,reason:string,analysis:string,raw_text:string,commit_answer:string>"
DETAILS = f"struct<turn:int,max_turns:int,action:string,action_query:string,action_reason:string,action_analysis:string,telemetry_snapshot:{SNAPSHOT}>"
SUPPORT = "struct<g_mean:double,g_min:double,claim_supports:array<double>,passage_support_matrix:array<array<double>>>"
CONTEXT = "struct<title:array<string>,sentences:array<array<string>>>"
FACTS = "struct<title:array<string>,sent_id:array<int>>"

SCHEMAS = {
    "example": f"question_id string, question string, answer string, type string, level string, context {CONTEXT}, supporting_facts {FACTS}",
    "pair_example": "_id string, id string, question string, answer string, type string, context string, supporting_facts string",
    "paragraph_example": "id string, question string, answer string, answer_aliases array<string>, paragraphs array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>",
    "trivia_example": "question_id string, question string, question_source string, answer struct<value:string,aliases:array<string>,normalized_aliases:array<string>>",
    "single_relation_question": "qid string, question_text string, gold_answer string, subject string, relation string, supporting_passage string, sr_count int, s_count int, popularity_bucket string, paper_tool_needed boolean",
    "document": "question_id string, doc_id string, doc_index int, title string, context_text string, sentence_count int, supporting_sentence_ids array<int>, is_supporting_doc boolean, rank int, url string, description string",
    "chunk": "chunk_id string, question_id string, doc_id string, title string, chunk_index int, chunk_start int, chunk_end int, chunk_word_count int, chunk_split_type string, chunk_text string, chunk_body_text string",
    "passage": "index int, title string, text string",
    "posting": "doc bigint, grp string, term string, tf bigint",
    "term": "term string, df bigint, idf double",
    "group": "grp string, n bigint, avgdl double",
    "hit": "query string, doc bigint, score double, rank int",
    "candidate": "ex bigint, j int, candidate string, ptrue double",
    "entailment": "ex bigint, i int, j int, entail double, neutral double, contra double",
    "attempt": "answer string, raw_answer string, nvc double, sc_conf double, dinco_conf double, source string, claims array<string>, candidates array<string>, available boolean",
    "node": "plan string, id string, parent_id string, depth int, subquestion string, depends_on array<string>, status string, purpose string",
    "edge": "plan string, id string, dep string",
    "trace": f"array<struct<step:int,action:string,node_id:string,details:{DETAILS}>>",
    "turn": f"run_id string, question_id string, turn int, subquestion string, answer string, nvc double, sc_conf double, dinco_conf double, g_mean double, g_min double, claim_supports array<double>, claims array<string>, action {ACTION}",
    "trajectory": f"result_id bigint, run_id string, question_id string, question string, gold_answer string, pred_answer string, pred_answer_raw string, em double, f1 double, nvc double, policy_trace array<struct<step:int,action:string,node_id:string,details:{DETAILS}>>, planning_trace string, support {SUPPORT}",
    "calibration_input": "id bigint, s double, p double",
    "training_pair": "question_id string, messages array<struct<role:string,content:string>>, target string, gold_answer string, dataset_source string, turn int, question_total_lm_calls int, question_f1 double, action_type string",
    "prompt": "prompt string, reward_model struct<ground_truth:string>, question_id string, level string, slot string, forced_max_turns int",
    "rollout": "prompt_id string, assistant_token_ids array<int>, assistant_text string, gold_answer string, n_lm_calls int, extra map<string,string>",
    "label": "qid string, tool_needed boolean, n_correct int",
    "error": "qid string, condition string, error string, error_type string, timestamp string",
}


def schema(name: str) -> T.StructType:
    """The schema of a logical table."""
    return T.StructType.fromDDL(SCHEMAS[name])


def require(df: DataFrame, name: str) -> DataFrame:
    """The table itself, or an error that names the columns that it lacks, before any row is read."""
    lacking = [f.name for f in schema(name) if f.name not in df.columns]
    if lacking:
        raise ValueError(f"{name}: columns missing: {', '.join(lacking)}")
    return df
