"""Queries of readers and writers (round trips through the shared folder) and of the smaller operators."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from evidentia.functions import hints, parse, text
from evidentia.functions.scorers import scorer
from evidentia.operators import aggregate, calibration, confidence, dag, policy, reshape, scoring
from evidentia.operators.retrieval import Bm25Index
from evidentia.plans import retrieval_queries as rq
from evidentia.plans import sql
from evidentia.plans.record_queries import _ANY, _CATEGORY, _EVID, _NUM, _R, _T, _W, _evidence, number
from evidentia.plans.scoring_queries import _NVC, _SUPPORTS, _nli, r6, runs, turns
from evidentia.session import checkpoint_dir, first_of_each, table
from evidentia.sources import readers, writers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, which all executors see."""
    return f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}/{name}"


# ---- sources and sinks -----------------------------------------------------------------------


@query("SELECT example_id, question, answer, level FROM examples")
def S1_json_lines(spark, sf_dir):
    path = scratch(spark, "examples")
    writers.write_json_lines(table(spark, sf_dir, "examples", "example_id", "question", "answer", "level"), path)
    return readers.json_lines(spark, path, "example_id bigint, question string, answer string, level string").drop("_source_line")


@query("SELECT count(*) AS rows, count(*) AS lines, 1 AS first, count(*) AS last FROM examples")
def S1_line_numbers(spark, sf_dir):
    path = scratch(spark, "examples")
    n = writers.write_json_lines(table(spark, sf_dir, "examples", "example_id"), path)
    rows = readers.json_lines(spark, path, "example_id bigint")
    return rows.agg(F.lit(n).cast("bigint").alias("rows"), F.countDistinct("_source_line").alias("lines"), F.min("_source_line").cast("int").alias("first"), F.max("_source_line").alias("last"))


@query()
def S4_question_set(spark, sf_dir):
    """The question set written as a tab-separated file with header and read in canonical form."""
    path = scratch(spark, "set.tsv")
    rows = first_of_each(table(spark, sf_dir, "witqa", "row_id", *readers.REQUIRED_COLUMNS), "row_id").drop("row_id")
    text_only = rows.select(*[F.regexp_replace(F.col(c).cast("string"), r"[\r\n]", " ").alias(c) for c in rows.columns])
    text_only.write.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
    return readers.question_set_tsv(spark, path).drop("qid")


@query("SELECT qid, arg_max(sub_pred_count < 50, row_id) AS tool_needed FROM witqa WHERE qid IS NOT NULL GROUP BY qid")
def S10_last_labels(spark, sf_dir):
    path = scratch(spark, "labels")
    rows = table(spark, sf_dir, "witqa", "qid", "row_id", "sub_pred_count").where("qid IS NOT NULL")
    # The order is a column of the file; no task needs to see all lines.
    rows.select("qid", "row_id", (F.col("sub_pred_count") < 50).alias("tool_needed")).write.json(path)
    return readers.labels_last_wins(spark, path, order="row_id").select("qid", "tool_needed")


@query("SELECT question_id FROM (SELECT DISTINCT question_id FROM trajectories WHERE question_id IS NOT NULL) t WHERE question_id IN (SELECT question_id FROM controls)")
def S11_by_id_file(spark, sf_dir):
    path = scratch(spark, "ids")
    table(spark, sf_dir, "controls", "question_id").where("question_id IS NOT NULL").distinct().write.text(path)
    asked = table(spark, sf_dir, "trajectories", "question_id").where("question_id IS NOT NULL").distinct()
    return readers.by_id_file(spark, asked, "question_id", path)[0].select("question_id")


@query("SELECT result_id, run_id, em FROM trajectories")
def K4_replaced_conditions(spark, sf_dir):
    """Results written by condition, one condition twice: the second run changes nothing."""
    path = scratch(spark, "results")
    rows = table(spark, sf_dir, "trajectories", "result_id", "run_id", "em").withColumn("condition", F.expr("concat('c', result_id % 4)"))
    writers.overwrite_conditions(rows, path)
    writers.overwrite_conditions(rows.where("condition = 'c1'"), path)
    return spark.read.parquet(path).select("result_id", "run_id", "em")


@query(rq.ORACLES["R4_bm25_global_topk"])
def K5_saved_index(spark, sf_dir):
    path = scratch(spark, "index")
    rq._index(spark, sf_dir).save(path)
    hits = Bm25Index.load(spark, path).search(rq._asked(spark, sf_dir), "example_id", "question", rq.K)
    return hits.select("query", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("SELECT result_id, coalesce(pred_answer, '') AS prediction FROM trajectories")
def K6_predictions(spark, sf_dir):
    path = scratch(spark, "predictions")
    writers.append_json_lines(table(spark, sf_dir, "trajectories", "result_id", "pred_answer").select("result_id", F.coalesce("pred_answer", F.lit("")).alias("prediction")), path)
    return spark.read.schema("result_id bigint, prediction string").json(path)


@query("SELECT example_id, question FROM examples WHERE split = 'validation'")
def S3_saved_split(spark, sf_dir):
    """One split of a saved set, found by its name."""
    path = scratch(spark, "set")
    rows = table(spark, sf_dir, "examples", "example_id", "question", "split")
    for split in ("train", "validation"):
        writers.write_table(rows.where(F.col("split") == split), f"{path}/{split}.parquet")
    return readers.split_table(spark, path, "validation").select("example_id", "question")


@query("SELECT CAST(example_id AS VARCHAR) AS question_id, question, answer FROM examples WHERE split = 'validation'")
def S5_pair_set(spark, sf_dir):
    """A set of title and sentences pairs, written and read under the split's other name."""
    path = scratch(spark, "pairs")
    rows = table(spark, sf_dir, "examples", "example_id", "question", "answer", "split").where("split = 'validation'")
    writers.write_json_lines(rows.select(F.col("example_id").cast("string").alias("_id"), "question", "answer"), f"{path}/dev.jsonl")
    return readers.pair_set(spark, path, "validation").select("question_id", "question", "answer")


@query("SELECT CAST(example_id AS VARCHAR) AS question_id, question FROM examples WHERE split = 'test'")
def S6_paragraph_set(spark, sf_dir):
    path = scratch(spark, "paragraphs")
    rows = table(spark, sf_dir, "examples", "example_id", "question", "answer", "split").where("split = 'test'")
    writers.write_json_lines(rows.select(F.col("example_id").cast("string").alias("id"), "question", "answer"), path)
    return readers.paragraph_set(spark, path).select("question_id", "question")


@query(rq.ORACLES["R1_index_terms"])
def S9_loaded_index(spark, sf_dir):
    path = scratch(spark, "index")
    rq._index(spark, sf_dir).save(path)
    return Bm25Index.load(spark, path).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"SELECT count(*) AS n, round(avg(em), 6) AS em FROM {_ANY('trajectories', 'result_id', 'em')}")
def K1_summary(spark, sf_dir):
    """A summary written as one pretty-printed object and read again."""
    path = f"{scratch(spark, 'summary')}.json"
    writers.write_summary(runs(spark, sf_dir, "em").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("em")).alias("em")), path)
    return spark.read.schema("n bigint, em double").option("multiLine", True).json(path)


@query("SELECT 2 * count(*) AS rows, count(*) AS written FROM trajectories")
def K3_appended_lines(spark, sf_dir):
    """Lines appended in two runs; the number of rows written is returned."""
    path = scratch(spark, "lines")
    rows = table(spark, sf_dir, "trajectories", "result_id")
    n = [writers.append_json_lines(rows, path) for _ in range(2)][1]
    return spark.read.schema("result_id bigint").json(path).agg(F.count(F.lit(1)).alias("rows"), F.lit(n).cast("bigint").alias("written"))


@query("SELECT result_id, question FROM trajectories")
def K7_written_table(spark, sf_dir):
    path = scratch(spark, "table")
    writers.write_table(table(spark, sf_dir, "trajectories", "result_id", "question"), path)
    return spark.read.parquet(path)


# ---- reshaping -------------------------------------------------------------------------------

_FLAT = """SELECT example_id, CAST(i - 1 AS INTEGER) AS pos, context.title[i] AS title, array_to_string(context.sentences[i], ' ') AS text
    FROM (SELECT *, unnest(range(1, least(len(context.title), len(context.sentences)) + 1)) AS i FROM examples WHERE context.title IS NOT NULL AND context.sentences IS NOT NULL)"""


def _zipped(spark, sf_dir):
    """All contexts; of lists of unequal length the shorter counts, as where titles and sentences are zipped."""
    rows = table(spark, sf_dir, "examples", "example_id", "question", "answer", "context", "supporting_facts").where("context.title IS NOT NULL AND context.sentences IS NOT NULL")
    n = F.least(F.size("context.title"), F.size("context.sentences"))
    return rows.withColumn("context", F.struct(F.slice("context.title", F.lit(1), n).alias("title"), F.slice("context.sentences", F.lit(1), n).alias("sentences")))


def _by_pairs(contexts):
    """Contexts as JSON pairs of title and sentences, and back."""
    pairs = F.to_json(F.transform(F.arrays_zip(F.col("context.title").alias("t"), F.col("context.sentences").alias("s")), lambda d: F.array(F.to_json(F.array(d["t"])), F.to_json(d["s"]))))
    rows = contexts.select("example_id", F.from_json(pairs, "array<array<string>>").alias("p"))
    as_pairs = F.concat(F.lit("["), F.array_join(F.transform("p", lambda x: F.concat(F.lit("["), F.regexp_replace(x[0], r"^\[|\]$", ""), F.lit(","), F.coalesce(x[1], F.lit("null")), F.lit("]"))), ","), F.lit("]"))
    back = rows.select("example_id", reshape.pairs_to_columns(as_pairs).alias("c"))
    each = back.select("example_id", F.posexplode(F.arrays_zip(F.col("c.title").alias("title"), F.col("c.sentences").alias("s"))).alias("pos", "d"))
    return each.select("example_id", "pos", F.col("d.title").alias("title"), F.array_join("d.s", " ").alias("text"))


def _by_paragraphs(contexts):
    """Contexts as paragraph records, and back."""
    titles = F.coalesce("supporting_facts.title", F.array().cast("array<string>"))
    paragraphs = F.transform(
        F.arrays_zip(F.col("context.title").alias("t"), F.col("context.sentences").alias("s")),
        lambda d, i: F.struct(i.cast("int").alias("idx"), d["t"].alias("title"), F.array_join(d["s"], " ").alias("paragraph_text"), F.coalesce(F.array_contains(titles, d["t"]), F.lit(False)).alias("is_supporting")),
    )
    rows = contexts.select(F.col("example_id").alias("id"), "question", "answer", F.array().cast("array<string>").alias("answer_aliases"), paragraphs.alias("paragraphs"))
    back = reshape.from_paragraphs(rows)
    each = back.select(F.col("question_id").alias("example_id"), F.posexplode(F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("s"))).alias("pos", "d"))
    return each.select("example_id", "pos", F.col("d.title").alias("title"), F.array_join("d.s", " ").alias("text"))


@query(_FLAT)
def P2_from_pairs(spark, sf_dir):
    return _by_pairs(_zipped(spark, sf_dir))


@query(_FLAT.replace("context.title[i] AS title", "coalesce(context.title[i], '') AS title").replace("array_to_string(context.sentences[i], ' ') AS text", "coalesce(array_to_string(context.sentences[i], ' '), '') AS text"))
def P3_from_paragraphs(spark, sf_dir):
    return _by_paragraphs(_zipped(spark, sf_dir))


@query("""SELECT example_id, CAST(i - 1 AS INTEGER) AS pos, context.title[i] AS title, md5(coalesce(array_to_string(context.sentences[i], ' '), '')) AS digest FROM (SELECT *, unnest(range(1, least(len(context.title), len(context.sentences)) + 1)) AS i FROM examples)""")
def P9_passages(spark, sf_dir):
    rows = table(spark, sf_dir, "examples", "example_id", "context").where("context.title IS NOT NULL AND context.sentences IS NOT NULL")
    each = rows.select("example_id", F.inline(reshape.passages(F.col("context"))))
    return each.select("example_id", F.col("index").cast("int").alias("pos"), "title", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


@query("SELECT evid_id, md5(coalesce(nullif(trim(description, ' '), ''), context_text)) AS digest FROM evidence_docs")
def P11_hit_texts(spark, sf_dir):
    return table(spark, sf_dir, "evidence_docs", "evid_id", "description", "context_text").select("evid_id", F.md5(reshape.hit_text(F.col("description"), F.col("context_text"))).alias("digest"))


@query()
def P16_padded_strata(spark, sf_dir):
    rows = table(spark, sf_dir, "examples", "example_id", "type", "level", "answer")
    need = {"yes_no": (F.lower(F.trim("answer")).isin("yes", "no"), 5), "long": (F.size(F.split(F.trim("answer"), r"\s+")) >= 3, 5)}
    return reshape.padded_strata(rows, ["type", "level"], 100, need, "example_id", 42).select("example_id")


@query(f"SELECT coalesce(category, 'none') AS category, count(*) AS n FROM (SELECT {_CATEGORY} AS category FROM examples WHERE answer IS NOT NULL) GROUP BY 1")
def P24_control_categories(spark, sf_dir):
    rows = table(spark, sf_dir, "examples", "answer", "type").where("answer IS NOT NULL")
    return rows.groupBy(F.coalesce(reshape.control_category(F.col("answer"), F.col("type")), F.lit("none")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT evid_id, trim(regexp_replace(lower(trim(doc_id, ' ')), '[^a-z0-9_]+', '_', 'g'), '_') AS node FROM evidence_docs")
def P28_node_ids(spark, sf_dir):
    return table(spark, sf_dir, "evidence_docs", "evid_id", "doc_id").select("evid_id", dag.clean_node_id(F.col("doc_id")).alias("node"))


# ---- answers ---------------------------------------------------------------------------------


@query()
def A3_committed_actions(spark, sf_dir):
    rows = first_of_each(table(spark, sf_dir, "sft_pairs", "pair_id", "target"), "pair_id").select(parse.committed_action("target").alias("a"))
    return rows.groupBy(F.col("a.action").alias("action"), F.col("a.parse_error").alias("parse_error")).agg(F.count(F.lit(1)).alias("n"))


@query()
def A15_final_answers(spark, sf_dir):
    """The shortened answer, or a more specific grounded span that holds it."""
    rows = turns(spark, sf_dir, "subquestion", "answer", "claims", "claim_supports").withColumn("short", text.shortened("subquestion", "answer"))
    more = hints.more_specific(F.col("subquestion"), F.col("short"), F.col("claims"), F.col("claim_supports"), F.lit(""))
    return rows.select("turn_id", F.coalesce(more, F.col("short")).alias("final"))


_C, _A = sql.official_words("c"), sql.official_words("answer")


@query(f"""WITH t AS (SELECT turn_id, answer, unnest(claims) AS c FROM {_ANY('agent_turns', 'turn_id', 'answer', 'claims')}), w AS (SELECT turn_id, {_C} AS cw, {_A} AS aw FROM t WHERE c IS NOT NULL AND answer IS NOT NULL)
    SELECT turn_id, bool_or(contains(array_to_string(cw, ' '), array_to_string(aw, ' ')) OR (len(aw) > 0 AND len(list_filter(aw, lambda x: list_contains(cw, x))) / len(aw) >= 0.8)) AS mentioned FROM w GROUP BY 1""")
def A21_mentioned_answers(spark, sf_dir):
    rows = turns(spark, sf_dir, "answer", "claims").select("turn_id", "answer", F.explode("claims").alias("c")).where("c IS NOT NULL AND answer IS NOT NULL")
    return rows.groupBy("turn_id").agg(F.bool_or(text.mentions(F.col("c"), F.col("answer"))).alias("mentioned"))


@query(f"""WITH t AS (SELECT turn_id, i, claims[i] AS c FROM (SELECT *, unnest(range(1, len(claims) + 1)) AS i FROM {_ANY('agent_turns', 'turn_id', 'claims')})), k AS (SELECT *, {_C.replace('lower(c)', 'lower(c)')} AS w FROM t WHERE c IS NOT NULL)
    SELECT turn_id, count(DISTINCT array_to_string(w, ' ')) AS claims FROM k WHERE len(w) > 0 GROUP BY 1""")
def A26_distinct_claims(spark, sf_dir):
    rows = turns(spark, sf_dir, "claims").select("turn_id", F.explode("claims").alias("c")).where("c IS NOT NULL")
    return rows.select("turn_id", text.official_form("c").alias("k")).where("k <> ''").groupBy("turn_id").agg(F.countDistinct("k").alias("claims"))


@query(rf"""SELECT turn_id, trim(regexp_replace('Where is ' || coalesce(nullif(answer, ''), 'sg1') || ' now?', '\s+', ' ', 'g'), ' ') AS question FROM {_T('answer')}""")
def A28_resolved_questions(spark, sf_dir):
    answers = F.array(F.struct(F.lit("sg1").alias("id"), F.col("answer").alias("answer")))
    resolved = dag.resolved_question(F.lit("Where is {sg1} now?"), answers)
    return turns(spark, sf_dir, "answer").select("turn_id", F.when(F.coalesce("answer", F.lit("")) == "", F.lit("Where is sg1 now?")).otherwise(resolved).alias("question"))


@query(f"SELECT turn_id, coalesce(nullif(trim(answer, ' '), ''), 'insufficient evidence') AS answer FROM {_T('answer')}")
def A30_answers_or_none(spark, sf_dir):
    return turns(spark, sf_dir, "answer").select("turn_id", F.coalesce(F.nullif(F.trim("answer"), F.lit("")), F.lit("insufficient evidence")).alias("answer"))


# ---- scores ----------------------------------------------------------------------------------


@query(f"WITH {rq._bm25(rq._GROUP_DOCS, rq._GROUP_ASKED, True)} SELECT query, doc, round(score, 6) AS score FROM scored")
def R2_group_scores(spark, sf_dir):
    index = Bm25Index(rq._passages(spark, sf_dir), "evid_id", "context_text", "question_id")
    asked = rq._one_question(spark, sf_dir).withColumn("query", F.col("question_id"))
    return index.scores(asked, "query", "question", "question_id").select("query", "doc", r6("score").alias("score"))


@query(f"""WITH r AS (SELECT result_id, {sql.official_words("coalesce(pred_answer, '')")} AS p, {sql.official_words("coalesce(gold_answer, '')")} AS g FROM {_R('pred_answer', 'gold_answer')}) SELECT result_id, round({sql.f1('p', 'g')}, 6) AS f1 FROM r""")
def F1c_planner(spark, sf_dir):
    p, g = (text.official_words(F.coalesce(c, F.lit(""))) for c in ("pred_answer", "gold_answer"))
    return runs(spark, sf_dir, "pred_answer", "gold_answer").select("result_id", r6(scoring.f1_of(p, g)).alias("f1"))


@query(f"""WITH e AS (SELECT question_id, string_agg(context_text, chr(10) ORDER BY context_text) AS t FROM {_EVID} GROUP BY 1), c AS (SELECT result_id, {sql.official_words('pred_answer')} AS h, {sql.official_words('t')} AS p FROM {_R('question_id', 'pred_answer')} r JOIN e USING (question_id) WHERE pred_answer IS NOT NULL)
    SELECT result_id, round(CASE WHEN len(h) = 0 THEN 0.0 ELSE {sql.overlap('h', 'p')} / len(h) END, 6) AS support FROM c""")
def E6_whole_evidence(spark, sf_dir):
    """Answers against all evidence of their question as one text; a question has few documents."""
    evidence = _evidence(spark, sf_dir).groupBy("question_id").agg(F.sort_array(F.collect_list("context_text")).alias("texts"))
    rows = runs(spark, sf_dir, "question_id", "pred_answer").where("pred_answer IS NOT NULL").join(evidence, "question_id")
    return rows.select("result_id", r6(scoring.whole_evidence_support(F.col("pred_answer"), F.col("texts"), scorer("coverage"))).alias("support"))


@query(f"SELECT turn_id, len(list_filter({_SUPPORTS}, lambda s: s < 0.5)) > 0 AS weak FROM {_ANY('agent_turns', 'turn_id', 'claim_supports')}")
def E8_weak_claims(spark, sf_dir):
    return turns(spark, sf_dir, "claim_supports").select("turn_id", scoring.has_weak_claim(F.col("claim_supports")).alias("weak"))


@query(f"""WITH r AS (SELECT result_id, {sql.official_words('pred_answer')} AS p, {sql.official_words('gold_answer')} AS g FROM {_R('pred_answer', 'gold_answer')} WHERE pred_answer IS NOT NULL AND gold_answer IS NOT NULL)
    SELECT result_id, round(least(CASE WHEN len(g) = 0 THEN 0.0 ELSE {sql.overlap('g', 'p')} / len(g) END, CASE WHEN len(p) = 0 THEN 0.0 ELSE {sql.overlap('p', 'g')} / len(p) END), 6) AS both_ways FROM r""")
def E10_both_ways(spark, sf_dir):
    rows = runs(spark, sf_dir, "pred_answer", "gold_answer").where("pred_answer IS NOT NULL AND gold_answer IS NOT NULL")
    p, g = F.col("pred_answer"), F.col("gold_answer")
    return rows.select("result_id", r6(scoring.both_ways(scorer("coverage")(p, g), scorer("coverage")(g, p))).alias("both_ways"))


@query(f"SELECT result_id, CAST(NULL AS DOUBLE) AS g_mean FROM {_R('pred_answer')} WHERE pred_answer IS NULL")
def E11_skipped_support(spark, sf_dir):
    return runs(spark, sf_dir, "pred_answer").where("pred_answer IS NULL").select("result_id", scoring.skipped_support()["g_mean"].alias("g_mean"))


@query(f"""WITH {rq._bm25(rq._GROUP_DOCS, "SELECT question_id AS query, 'none' AS grp, question AS text FROM controls", True)} SELECT query, doc FROM scored WHERE grp = 'none'""")
def R5_unknown_groups(spark, sf_dir):
    """Questions of a group that the index does not have find nothing."""
    index = Bm25Index(rq._passages(spark, sf_dir), "evid_id", "context_text", "question_id")
    asked = table(spark, sf_dir, "controls", "question_id", "question").withColumn("grp", F.lit("none"))
    return index.search(asked, "question_id", "question", 3, "grp").select("query", "doc")


@query(f"""WITH {rq._bm25(rq._DOCS, "SELECT example_id AS query, '' AS grp, question AS text FROM examples WHERE question IS NOT NULL ORDER BY 1 LIMIT 1", False)} SELECT query, count(*) > 0 AS found FROM scored WHERE query = (SELECT min(query) FROM q WHERE text IS NOT NULL) AND score > 0 GROUP BY 1""")
def R14_index_probe(spark, sf_dir):
    """The first question must find something before anything costly runs."""
    index, asked = rq._index(spark, sf_dir), table(spark, sf_dir, "examples", "example_id", "question").where("question IS NOT NULL")
    index.probe(asked, "example_id", "question")
    return asked.agg(F.min("example_id").alias("query"), F.lit(True).alias("found"))


@query(f"""WITH r AS (SELECT result_id, {sql.reward_words("regexp_extract(pred_answer_raw, '(?i)(?:final[ ]+answer|answer)[ ]*[:=][ ]*([^' || chr(10) || ']+)', 1)")} AS p, {sql.reward_words('gold_answer')} AS g
    FROM {_R('pred_answer_raw', 'gold_answer')} WHERE starts_with(pred_answer_raw, 'Answer: ')) SELECT result_id, round({sql.f1('p', 'g')}, 6) AS score FROM r""".replace("'(?i)(?:final[ ]+answer|answer)[ ]*[:=][ ]*([^' || chr(10) || ']+)'", "'^Answer: (.*)'"))
def X3_marked_answers(spark, sf_dir):
    """The reward without floor of answers behind a marker."""
    rows = runs(spark, sf_dir, "pred_answer_raw", "gold_answer").where(F.startswith("pred_answer_raw", F.lit("Answer: ")))
    return rows.select("result_id", r6(scoring.f1_reward(parse.boxed_answer("pred_answer_raw"), F.col("gold_answer"), floor=False)).alias("score"))


# ---- confidence ------------------------------------------------------------------------------

_LOGS = f"""WITH t AS (SELECT turn_id, list_transform({_SUPPORTS}, lambda x: greatest(x, 1e-6) / 2) AS s FROM {_ANY('agent_turns', 'turn_id', 'claim_supports')}),
    m AS (SELECT turn_id, coalesce(list_sum(s[1:1]), 0.0) AS y, coalesce(list_sum(s[2:10]), 0.0) AS n FROM t)"""


@query(f"{_LOGS} SELECT turn_id, round(CASE WHEN y + n < 0.5 THEN 0.5 ELSE y / (y + n) END, 6) AS ptrue FROM m")
def C5_ptrue_or_half(spark, sf_dir):
    s = F.filter(F.coalesce("claim_supports", F.array().cast("array<double>")), lambda x: x.isNotNull() & ~F.isnan(x))
    logs = lambda part: F.transform(part, lambda x: F.log(F.greatest(x, F.lit(1e-6)) / 2))
    return turns(spark, sf_dir, "claim_supports").select("turn_id", r6(confidence.ptrue_or_half(logs(F.slice(s, 1, 1)), logs(F.slice(s, 2, 9)))).alias("ptrue"))


@query(f"SELECT turn_id, round(1 / (1 + exp({_NUM('nvc')} - {_NUM('sc_conf')})), 6) AS ptrue FROM {_ANY('agent_turns', 'turn_id', 'nvc', 'sc_conf')}")
def C6_ptrue_of_logits(spark, sf_dir):
    return turns(spark, sf_dir, "nvc", "sc_conf").select("turn_id", r6(confidence.ptrue_of_logits(number("sc_conf"), number("nvc"))).alias("ptrue"))


@query(_NVC.format(eps="0.0").replace("WHERE c.j > 0 GROUP BY", "WHERE c.j > 0 AND NOT EXISTS (SELECT 1 FROM c d WHERE d.ex = c.ex AND d.j > 0 AND d.j <= c.j AND d.p < 0.2) GROUP BY"))
def C9_nvc_with_padding(spark, sf_dir):
    """The first candidate with a negative score begins the padding: it ends the sum."""
    candidates, pairs = _nli(spark, sf_dir)
    padded = candidates.withColumn("ptrue", F.when((F.col("j") > 0) & (F.col("ptrue") < 0.2), -1.0).otherwise(F.col("ptrue")))
    return confidence.nvc(padded, pairs, eps=0.0, sentinel=True).select("ex", r6("nvc").alias("nvc"))


@query(f"""WITH c AS (SELECT run_id || '/' || question_id AS task, turn_id, {sql.official_words('answer')} AS w FROM {_T('run_id', 'question_id', 'answer')} WHERE run_id IS NOT NULL AND question_id IS NOT NULL AND answer IS NOT NULL)
    SELECT a.task, a.turn_id AS i, b.turn_id AS j, round(CASE WHEN len(b.w) = 0 THEN 0.0 ELSE {sql.overlap('b.w', 'a.w')} / len(b.w) END, 6) AS entail FROM c a JOIN c b ON a.task = b.task AND a.turn_id <> b.turn_id""")
def C11_pair_entailments(spark, sf_dir):
    """Answers of the few turns that a run gives a question, against each other."""
    rows = turns(spark, sf_dir, "run_id", "question_id", "answer").where("run_id IS NOT NULL AND question_id IS NOT NULL AND answer IS NOT NULL")
    pairs = confidence.entailments(rows.withColumn("task", F.concat_ws("/", "run_id", "question_id")), "task", "turn_id", "answer", scorer("coverage"))
    return pairs.select(F.col("ex").alias("task"), "i", "j", r6("entail").alias("entail"))


_X, _Y = sql.first_line("pred_answer"), sql.first_line("gold_answer")


@query(f"SELECT result_id, CASE WHEN {_Y} = '' THEN 0.0 WHEN {_X} = {_Y} THEN 1.0 ELSE round((f1 + {_NUM('nvc')}) / 2, 6) END AS agreement FROM {_ANY('trajectories', 'result_id', 'pred_answer', 'gold_answer', 'f1', 'nvc')}")
def C12_sample_agreement(spark, sf_dir):
    rows = runs(spark, sf_dir, "pred_answer", "gold_answer", "f1", "nvc")
    return rows.select("result_id", r6(confidence.sample_agreement(F.col("pred_answer"), F.col("gold_answer"), F.col("f1"), number("nvc"))).alias("agreement"))


@query(f"""WITH t AS (SELECT *, len(regexp_split_to_array(trim(answer, ' '), '\\s+')) AS n, {_NUM('nvc')} AS v FROM {_ANY('agent_turns', 'turn_id', 'question_id', 'answer', 'nvc')} WHERE question_id IS NOT NULL AND answer IS NOT NULL)
    SELECT question_id, answer FROM t WHERE n <= 6 AND v >= 0.55 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY v DESC, n, length(answer), answer) = 1""")
def C18_shortest_beams(spark, sf_dir):
    rows = turns(spark, sf_dir, "question_id", "answer", "nvc").where("question_id IS NOT NULL AND answer IS NOT NULL").withColumn("v", number("nvc"))
    return confidence.shortest_equal_beam(rows, "question_id", "answer", "v").select("question_id", "answer")


@query("SELECT count(*) AS n, round(min(p), 6) AS least, round(max(p), 6) AS most FROM (SELECT least(greatest(nvc, 0.0), 1.0) AS p FROM (SELECT result_id, any_value(nvc) AS nvc, any_value(em) AS em FROM trajectories GROUP BY 1) WHERE em IS NOT NULL AND nvc IS NOT NULL AND NOT isnan(nvc))")
def M1_usable_rows(spark, sf_dir):
    rows = calibration.usable(runs(spark, sf_dir, "em", "nvc"), "em", "nvc", "result_id")
    return rows.agg(F.count(F.lit(1)).alias("n"), r6(F.min("p")).alias("least"), r6(F.max("p")).alias("most"))


@query(f"SELECT turn_id, round(({_NUM('nvc')} + {_NUM('sc_conf')}) / 2, 6) AS dinco FROM {_ANY('agent_turns', 'turn_id', 'nvc', 'sc_conf')}")
def C14_blended(spark, sf_dir):
    return turns(spark, sf_dir, "nvc", "sc_conf").select("turn_id", r6(confidence.blend(number("nvc"), number("sc_conf"))).alias("dinco"))


# ---- aggregates and policies -----------------------------------------------------------------


@query(f"""SELECT row_id, CASE WHEN sub_pred_count IS NULL OR sub_pred_count < 10 THEN '1-9' WHEN sub_pred_count < 50 THEN '10-49' WHEN sub_pred_count < 100 THEN '50-99' WHEN sub_pred_count < 500 THEN '100-499'
    WHEN sub_pred_count < 1000 THEN '500-999' WHEN sub_pred_count < 5000 THEN '1000-4999' ELSE '5000+' END AS bucket FROM {_W}""")
def G2_buckets(spark, sf_dir):
    rows = first_of_each(table(spark, sf_dir, "witqa", "row_id", "sub_pred_count"), "row_id")
    return rows.select("row_id", aggregate.bucket(F.col("sub_pred_count")).alias("bucket"))


@query(f"""SELECT round(avg(em), 6) AS em, round(avg({_NUM('nvc')}), 6) AS nvc, round(avg(support.g_mean), 6) AS g, round(avg(0.6 * {_NUM('nvc')} + 0.4 * support.g_mean), 6) AS combined, count(*) AS n FROM {_ANY('trajectories', 'result_id', 'em', 'nvc', 'support')}""")
def G7_controller_summary(spark, sf_dir):
    rows = runs(spark, sf_dir, "em", "nvc", "support")
    combined = confidence.combined_prior(number("nvc"), F.col("support.g_mean"))
    return rows.agg(r6(F.avg("em")).alias("em"), r6(F.avg(number("nvc"))).alias("nvc"), r6(F.avg("support.g_mean")).alias("g"), r6(F.avg(combined)).alias("combined"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT round(avg({_NUM('nvc')}), 6) AS nvc, round(avg({_NUM('sc_conf')}), 6) AS sc, round(avg(({_NUM('nvc')} + {_NUM('sc_conf')}) / 2), 6) AS dinco FROM {_ANY('agent_turns', 'turn_id', 'nvc', 'sc_conf')}")
def G9_confidence_means(spark, sf_dir):
    both = confidence.blend(number("nvc"), number("sc_conf"))
    return turns(spark, sf_dir, "nvc", "sc_conf").agg(r6(F.avg(number("nvc"))).alias("nvc"), r6(F.avg(number("sc_conf"))).alias("sc"), r6(F.avg(both)).alias("dinco"))


@query(f"""SELECT turn_id, CASE WHEN coalesce(len(list_filter({_SUPPORTS}, lambda s: s < 0.5)) > 0, false) THEN 'second' ELSE 'first' END AS pass FROM {_ANY('agent_turns', 'turn_id', 'claim_supports')}""")
def L12_second_pass(spark, sf_dir):
    rows = turns(spark, sf_dir, "claim_supports").withColumn("pass", F.lit("first"))
    return policy.second_pass(rows, scoring.has_weak_claim(F.col("claim_supports")), lambda df: df.withColumn("pass", F.lit("second"))).select("turn_id", "pass")


@query("SELECT CAST(c.p_partkey AS BIGINT) AS parent, p.p_name AS question FROM part c JOIN part p ON p.p_partkey = c.p_partkey // 2 WHERE c.p_partkey > 1")
def Q10_dependency_records(spark, sf_dir):
    """What each node waits for, with the other node's text."""
    parts = table(spark, sf_dir, "part", "p_partkey", "p_name")
    edges = parts.where("p_partkey > 1").select(F.col("p_partkey").alias("parent"), F.expr("p_partkey div 2").alias("dep"))
    return edges.join(parts.select(F.col("p_partkey").alias("dep"), F.col("p_name").alias("question")), "dep").select("parent", "question")


@query("SELECT turn_id, coalesce(nullif(trim(action.query, ' '), ''), subquestion) AS question FROM agent_turns")
def X7_effective_questions(spark, sf_dir):
    return table(spark, sf_dir, "agent_turns", "turn_id", "action", "subquestion").select("turn_id", dag.effective_question(F.col("action.query"), F.col("subquestion")).alias("question"))
