"""Queries of reshaping, sampling, aggregates, policies, graphs and training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import text
from evidentia.operators import aggregate, dag, policy, reshape, training
from evidentia.plans import sql
from evidentia.plans.scoring_queries import r6, runs, turns
from evidentia.session import first_of_each, table
from evidentia.sources.writers import prompt_samples
from evidentia.streaming.resume import sessions, windowed_counts

SEED = 42
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def number(c: str):
    return F.nanvl(c, F.lit(None).cast("double"))


_T = lambda *c: sql.once("agent_turns", "turn_id", *c)
_R = lambda *c: sql.once("trajectories", "result_id", *c)
_NUM = lambda c: f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"
_OWN = "CASE WHEN run_id IS NULL OR question_id IS NULL THEN turn_id END"
_ANY = lambda t, k, *c: f"(SELECT {k}, {', '.join(f'any_value({x}) AS {x}' for x in c)} FROM {t} GROUP BY {k})"

# ---- reshaping -------------------------------------------------------------------------------


@query("""WITH e AS (SELECT example_id, context.title AS t, context.sentences AS s, greatest(coalesce(len(context.title), 0), coalesce(len(context.sentences), 0)) AS n FROM examples WHERE context.title IS NOT NULL AND context.sentences IS NOT NULL)
    SELECT example_id, CAST(i - 1 AS INTEGER) AS pos, t[i] AS title, CAST(len(s[i]) AS INTEGER) AS n_sentences FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM e)""")
def P1_records_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "examples", "example_id", "context")
    records = reshape.records_of({"title": F.col("context.title"), "sentences": F.col("context.sentences")})
    each = rows.select("example_id", F.posexplode(records).alias("pos", "r"))
    return each.select("example_id", "pos", F.col("r.title").alias("title"), F.when(F.col("r.sentences").isNotNull(), F.size("r.sentences")).alias("n_sentences"))


_FACTS = """(SELECT example_id, t[i] AS title, s[i] AS sent_id FROM (SELECT example_id, supporting_facts.title AS t, supporting_facts.sent_id AS s,
    unnest(range(1, greatest(len(supporting_facts.title), len(supporting_facts.sent_id)) + 1)) AS i FROM examples))"""


@query(f"""SELECT example_id, title_key, array_to_string(list_sort(list_distinct(list(sent_id))), ',') AS sent_ids FROM (SELECT example_id, {sql.official('title')} AS title_key, sent_id FROM {_FACTS})
    WHERE title_key <> '' AND sent_id IS NOT NULL GROUP BY ALL""")
def P5_supporting_sentences(spark, sf_dir):
    found = reshape.supporting_sentences(table(spark, sf_dir, "examples", "example_id", "supporting_facts"), "example_id")
    return found.select("example_id", "title_key", F.array_join(F.transform("sent_ids", lambda x: x.cast("string")), ",").alias("sent_ids"))


_DOCS = f"""d0 AS (SELECT example_id, context.title AS t, context.sentences AS s, greatest(len(context.title), len(context.sentences)) AS n FROM examples WHERE context.title IS NOT NULL AND context.sentences IS NOT NULL),
    d AS (SELECT example_id, i - 1 AS doc_index, coalesce(t[i], 'context_' || (i - 1)) AS title, coalesce(s[i], []) AS s FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM d0)),
    f AS (SELECT example_id, title, list_sort(list_distinct(list(sent_id))) AS ids FROM {_FACTS} WHERE title IS NOT NULL AND sent_id IS NOT NULL GROUP BY ALL)"""


@query(f"""WITH {_DOCS} SELECT d.example_id, d.title || '::' || doc_index AS doc_id, trim(array_to_string(list_transform(list_filter(s, lambda x: x IS NOT NULL), lambda x: trim(x, ' ')), ' '), ' ') AS context_text,
    CAST(len(s) AS INTEGER) AS sentence_count, array_to_string(coalesce(ids, []), ',') AS supporting, ids IS NOT NULL AS is_supporting_doc FROM d LEFT JOIN f ON f.example_id = d.example_id AND f.title = d.title""")
def P6_document_rows(spark, sf_dir):
    docs = reshape.document_rows(table(spark, sf_dir, "examples", "example_id", "context", "supporting_facts"), "example_id")
    ids = F.array_join(F.transform("supporting_sentence_ids", lambda x: x.cast("string")), ",")
    return docs.select("example_id", "doc_id", "context_text", "sentence_count", ids.alias("supporting"), "is_supporting_doc")


@query()
def P7_chunk_table(spark, sf_dir):
    docs = reshape.document_rows(table(spark, sf_dir, "examples", "example_id", "context", "supporting_facts"), "example_id")
    return reshape.chunk_table(docs, "example_id", "examples").select("chunk_id", "chunk_start", "chunk_end", "chunk_split_type", F.md5("chunk_text").alias("digest"))


@query("""SELECT example_id, array_to_string(list_transform(list_filter(range(1, greatest(len(context.title), len(context.sentences)) + 1), lambda i: NOT coalesce(list_contains(coalesce(supporting_facts.title, []), context.title[i]), false)),
    lambda i: coalesce(context.title[i], '') || ': ' || coalesce(array_to_string(context.sentences[i], ' '), '')), chr(10) || chr(10)) AS block FROM examples WHERE context.title IS NOT NULL AND context.sentences IS NOT NULL""")
def P8_context_without_gold(spark, sf_dir):
    rows = table(spark, sf_dir, "examples", "example_id", "context", "supporting_facts").where("context.title IS NOT NULL AND context.sentences IS NOT NULL")
    titles = F.coalesce("supporting_facts.title", F.array().cast("array<string>"))
    # A missing title is no supporting one.
    context = F.struct(F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences"))
    gold = F.filter(titles, lambda t: t.isNotNull())
    keep = F.filter(F.arrays_zip(context["title"].alias("t"), context["sentences"].alias("s")), lambda d: ~F.coalesce(F.array_contains(gold, d["t"]), F.lit(False)))
    kept = F.struct(F.transform(keep, lambda d: d["t"]).alias("title"), F.transform(keep, lambda d: d["s"]).alias("sentences"))
    return rows.select("example_id", reshape.context_block(kept).alias("block"))


@query("""SELECT example_id, array_to_string(list_transform(range(1, least(len(context.title), len(context.sentences)) + 1), lambda i: '[' || i || '] ' || coalesce(context.title[i], '') || chr(10) || coalesce(array_to_string(context.sentences[i], ' '), '')), chr(10) || chr(10)) AS block
    FROM examples WHERE context.title IS NOT NULL AND context.sentences IS NOT NULL""")
def P10_evidence_block(spark, sf_dir):
    rows = table(spark, sf_dir, "examples", "example_id", "context").where("context.title IS NOT NULL AND context.sentences IS NOT NULL")
    return rows.select("example_id", reshape.evidence_block(reshape.passages(F.col("context"))).alias("block"))


_SHUFFLED = lambda k, seed=SEED: f"md5(CAST({k} AS VARCHAR) || '|{seed}')"


@query(f"SELECT example_id, question FROM (SELECT *, row_number() OVER (ORDER BY {_SHUFFLED('example_id')}, example_id) AS n FROM examples) WHERE n > 20 AND n <= 70")
def P12_shuffled_subset(spark, sf_dir):
    return reshape.subset(table(spark, sf_dir, "examples", "example_id", "question"), "example_id", SEED, 20, 50)


_TARGETS = {"hotpot": 60, "twowiki": 30, "musique": 30}
_STRATA = f"""SELECT example_id, source AS stratum FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_SHUFFLED('example_id')}, example_id) AS n FROM examples {{0}})
    WHERE n <= CASE source {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _TARGETS.items())} ELSE 0 END"""


@query(_STRATA.format(""))
def P15_stratified(spark, sf_dir):
    return reshape.stratified(table(spark, sf_dir, "examples", "example_id", "source"), F.col("source"), _TARGETS, "example_id", SEED).select("example_id", "stratum")


@query(_STRATA.format(f"WHERE example_id NOT IN (SELECT example_id FROM ({_STRATA.format('')}))"))
def P15_held_out(spark, sf_dir):
    rows = table(spark, sf_dir, "examples", "example_id", "source")
    train = reshape.stratified(rows, F.col("source"), _TARGETS, "example_id", SEED)
    return reshape.held_out_sample(rows, train, F.col("source"), _TARGETS, "example_id", SEED).select("example_id", "stratum")


_BUCKET = lambda c: f"""CASE WHEN {c} IS NULL OR {c} < 1 THEN '1-9' WHEN {c} < 10 THEN '1-9' WHEN {c} < 50 THEN '10-49' WHEN {c} < 100 THEN '50-99' WHEN {c} < 500 THEN '100-499'
    WHEN {c} < 1000 THEN '500-999' WHEN {c} < 5000 THEN '1000-4999' ELSE '5000+' END"""  # noqa: E731
_W = sql.once("witqa", "row_id", "sub_pred_count", "entity_count")


@query(f"""WITH w AS (SELECT row_id, {_BUCKET('sub_pred_count')} AS stratum FROM {_W}), a AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY {_SHUFFLED('row_id')}, row_id) <= 14),
    b AS (SELECT * FROM w WHERE row_id NOT IN (SELECT row_id FROM a) ORDER BY {_SHUFFLED('row_id', SEED + 1)}, row_id LIMIT 2) SELECT row_id, stratum FROM a UNION ALL SELECT row_id, stratum FROM b""")
def P17_equal_buckets(spark, sf_dir):
    rows = first_of_each(table(spark, sf_dir, "witqa", "row_id", "sub_pred_count"), "row_id")
    names = tuple(name for name, _ in aggregate.BUCKETS)
    return reshape.equal_buckets(rows, aggregate.bucket(F.col("sub_pred_count")), names, 100, "row_id", SEED).select("row_id", "stratum")


@query("""SELECT row_id, array_to_string(CASE WHEN o = '' AND s = '' THEN [] WHEN o = '' THEN [s] WHEN s = '' OR s = o THEN [o] ELSE [o, s] END, '|') AS aliases
    FROM (SELECT row_id, trim(coalesce(object_label, ''), ' ') AS o, trim(coalesce(object_surfaceform, ''), ' ') AS s FROM witqa)""")
def P18_joined_aliases(spark, sf_dir):
    return table(spark, sf_dir, "witqa", "row_id", "object_label", "object_surfaceform").select("row_id", text.join_aliases(F.col("object_label"), F.col("object_surfaceform")).alias("aliases"))


@query()
def P20_expanded_list(spark, sf_dir):
    from evidentia.operators.packed_values import ONLY_IF_ALONE, unpack

    rows = table(spark, sf_dir, "witqa", "row_id", "expanded_object_label")
    return unpack(rows, "row_id", {"expanded_object_label": ONLY_IF_ALONE}).select("row_id", "pos", "entry")


@query("""SELECT field, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN coalesce(question, '') = '' THEN 'question' END, CASE WHEN coalesce(answer, '') = '' THEN 'answer' END, CASE WHEN coalesce(level, '') = '' THEN 'level' END],
    lambda x: x IS NOT NULL)) AS field FROM examples) GROUP BY 1""")
def P21_missing_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "examples", "question", "answer", "level")
    return rows.select(F.explode(reshape.missing_fields("question", "answer", "level")).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


#: A cast holds for an optional sign and ASCII digits of 32-bit range between blanks and control characters; all else is 0.
_CAST = r"""SELECT raw_id, CAST(CASE WHEN v BETWEEN -2147483648 AND 2147483647 THEN v ELSE 0 END AS INTEGER) AS n
    FROM (SELECT raw_id, TRY_CAST(nullif(regexp_extract(split_part(raw_line, chr(9), 8), '^[\x00-\x20\x7f-\x{9f}]*([+-]?[0-9]+)[\x00-\x20\x7f-\x{9f}]*$', 1), '') AS HUGEINT) AS v FROM witqa_raw)"""


@query(_CAST)
def P22_safe_casts(spark, sf_dir):
    """Every line, also those whose cell is no number."""
    cell = F.split_part("raw_line", F.lit("\t"), F.lit(8))
    return table(spark, sf_dir, "witqa_raw", "raw_id", "raw_line").select("raw_id", reshape.int_or_zero(cell).alias("n"))


@query("""SELECT run_id, contains(run_id, 'telemetry') AND NOT contains(run_id, 'notelemetry') AS telemetry, starts_with(run_id, 'agent') AS agent, starts_with(run_id, 'react') AS react,
    starts_with(run_id, 'agent') OR starts_with(run_id, 'react') AS multi_turn FROM (SELECT DISTINCT run_id FROM agent_turns WHERE run_id IS NOT NULL)""")
def P23_condition_kinds(spark, sf_dir):
    c = F.col("run_id")
    rows = table(spark, sf_dir, "agent_turns", "run_id").where("run_id IS NOT NULL").distinct()
    return rows.select("run_id", policy.has_telemetry(c).alias("telemetry"), policy.is_agent(c).alias("agent"), policy.is_react(c).alias("react"), policy.is_multi_turn(c).alias("multi_turn"))


_CATEGORY = r"""CASE WHEN type = 'bridge' AND regexp_matches(trim(answer, ' '), '^\p{Lu}[^\p{Lu}\s]*\p{Ll}[^\p{Lu}\s]*\s+\p{Lu}[^\p{Lu}\s]*\p{Ll}[^\p{Lu}\s]*$') THEN 'person-name-swap' WHEN lower(trim(answer, ' ')) IN ('yes', 'no') THEN 'yes-no-restate'
    WHEN regexp_matches(trim(answer, ' '), '^[0-9]{4}$') THEN 'year-prefix' WHEN type = 'bridge' AND regexp_matches(trim(answer, ' '), '^\p{Lu}\S*$') THEN 'place-prefix' WHEN type = 'comparison' THEN 'comparison-rewrite' END"""


@query(f"SELECT category, min(example_id) AS example_id, arg_min(answer, example_id) AS answer FROM (SELECT *, {_CATEGORY} AS category FROM examples WHERE answer IS NOT NULL) WHERE category IS NOT NULL GROUP BY 1")
def P25_control_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "examples", "example_id", "answer", "type").where("answer IS NOT NULL")
    return reshape.control_rows(rows, "example_id", "answer", "type").select("category", "example_id", "answer")


@query("""WITH s AS (SELECT example_id, answer, lower(trim(answer, ' ')) AS a FROM examples WHERE answer IS NOT NULL), f AS (SELECT a, min(example_id) AS k, arg_min(answer, example_id) AS first FROM s GROUP BY a ORDER BY k LIMIT 2)
    SELECT s.example_id, s.answer, (SELECT arg_min(first, k) FROM f WHERE f.a <> s.a) AS swapped FROM s""")
def P26_swap_answers(spark, sf_dir):
    return reshape.swap_answers(table(spark, sf_dir, "examples", "example_id", "answer"), "example_id", "answer")


@query("""SELECT evid_id, row_number() OVER (PARTITION BY question_id ORDER BY ingested_at, evid_id) - 1 AS place FROM (SELECT evid_id, any_value(question_id) AS question_id, min(ingested_at) AS ingested_at FROM evidence_docs GROUP BY 1) WHERE question_id IS NOT NULL""")
def P29_ordered_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "evidence_docs", "evid_id", "question_id", "ingested_at").groupBy("evid_id").agg(F.first("question_id").alias("question_id"), F.min("ingested_at").alias("ingested_at"))
    w = Window.partitionBy("question_id").orderBy("ingested_at", "evid_id")
    return rows.where("question_id IS NOT NULL").select("evid_id", (F.row_number().over(w) - 1).cast("bigint").alias("place"))


# ---- aggregates ------------------------------------------------------------------------------


@query(f"SELECT coalesce(CAST(action.type AS VARCHAR), 'null') AS key, count(*) AS n FROM {_ANY('agent_turns', 'turn_id', 'action')} GROUP BY 1")
def G1_histogram(spark, sf_dir):
    return aggregate.histogram(turns(spark, sf_dir, "action"), F.col("action.type"))


@query(f"""WITH w AS (SELECT {_BUCKET('sub_pred_count')} AS bucket, CAST(entity_count AS DOUBLE) AS v FROM {_W}), m AS (SELECT bucket, count(*) AS n, avg(v) AS mean FROM w WHERE v IS NOT NULL GROUP BY 1)
    SELECT b.bucket, coalesce(n, 0) AS n, round(coalesce(mean, 0.0), 6) AS mean FROM (VALUES ('1-9'), ('10-49'), ('50-99'), ('100-499'), ('500-999'), ('1000-4999'), ('5000+')) b(bucket) LEFT JOIN m USING (bucket)""")
def G3_by_bucket(spark, sf_dir):
    rows = first_of_each(table(spark, sf_dir, "witqa", "row_id", "sub_pred_count", "entity_count"), "row_id")
    return aggregate.by_bucket(rows, F.col("sub_pred_count"), F.col("entity_count").cast("double")).select("bucket", "n", r6("mean").alias("mean"))


@query(f"SELECT coalesce(sub_pred_count < 50, true) AS tool_needed, count(*) AS n FROM {_W} GROUP BY 1")
def G4_tool_needed(spark, sf_dir):
    rows = first_of_each(table(spark, sf_dir, "witqa", "row_id", "sub_pred_count"), "row_id")
    return rows.groupBy(aggregate.tool_needed(F.col("sub_pred_count")).alias("tool_needed")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH l AS (SELECT qid, arg_max(sub_pred_count, row_id) AS label FROM {sql.once('witqa', 'row_id', 'qid', 'sub_pred_count')} WHERE qid IS NOT NULL GROUP BY qid)
    SELECT turn_id, label FROM {_T('question_id')} t LEFT JOIN l ON l.qid = t.question_id""")
def G5_attached_labels(spark, sf_dir):
    rows = first_of_each(table(spark, sf_dir, "witqa", "row_id", "qid", "sub_pred_count"), "row_id").where("qid IS NOT NULL")
    labels = aggregate.last_labels(rows, "qid", "row_id").select(F.col("qid").alias("question_id"), F.col("sub_pred_count").alias("label"))
    return aggregate.attach_labels(turns(spark, sf_dir, "question_id"), labels, "question_id").select("turn_id", "label")


@query(f"""SELECT run_id, count(*) AS n, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1, round(avg({_NUM('nvc')}), 6) AS nvc, round(avg({_NUM('nvc')}) FILTER (em = 1), 6) AS nvc_correct,
    round(avg(support.g_mean), 6) AS g_mean FROM {_ANY('trajectories', 'result_id', 'run_id', 'em', 'f1', 'nvc', 'support')} GROUP BY 1""")
def G6_run_summary(spark, sf_dir):
    rows = runs(spark, sf_dir, "run_id", "em", "f1", "nvc", "support")
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("em")).alias("em"), r6(F.avg("f1")).alias("f1"), r6(F.avg(number("nvc"))).alias("nvc"),
        r6(F.avg(F.when(F.col("em") == 1, number("nvc")))).alias("nvc_correct"), r6(F.avg("support.g_mean")).alias("g_mean"),
    )


@query(f"""SELECT question_id FROM {_T('question_id', 'action.type AS kind').replace('agent_turns', '(SELECT turn_id, question_id, action FROM agent_turns)')} WHERE kind IN ('commit', 'retrieve', 'refine') AND question_id IS NOT NULL
    GROUP BY 1 HAVING count(DISTINCT kind) = 3""")
def G10_completed_everywhere(spark, sf_dir):
    rows = turns(spark, sf_dir, "question_id", "action").select("question_id", F.col("action.type").alias("kind"))
    rows = rows.where("kind IN ('commit', 'retrieve', 'refine') AND question_id IS NOT NULL")
    return aggregate.completed_everywhere(rows, "question_id", "kind", 3)


@query(f"SELECT DISTINCT concat_ws('+', question_id, run_id) AS done FROM {_R('question_id', 'run_id', 'pred_answer')} WHERE pred_answer IS NOT NULL")
def G11_completed_pairs(spark, sf_dir):
    rows = runs(spark, sf_dir, "question_id", "run_id", "pred_answer")
    return aggregate.completed_pairs(rows, "question_id", "run_id", F.when(F.col("pred_answer").isNull(), "no answer"))


@query("SELECT example_id FROM examples e WHERE NOT EXISTS (SELECT 1 FROM trajectories t WHERE t.question_id = e.question_id)")
def G12_still_to_do(spark, sf_dir):
    done = table(spark, sf_dir, "trajectories", "question_id").where("question_id IS NOT NULL").distinct()
    return aggregate.still_to_do(table(spark, sf_dir, "examples", "example_id", "question_id"), done, "question_id").select("example_id")


@query(f"""SELECT question_id, round(max(d), 6) AS dinco, round(max(n), 6) AS nvc, arg_max(answer, row(coalesce(d, -1.0), coalesce(n, -1.0), answer)) AS answer
    FROM (SELECT question_id, answer, {_NUM('dinco_conf')} AS d, {_NUM('nvc')} AS n FROM {_ANY('agent_turns', 'turn_id', 'question_id', 'answer', 'dinco_conf', 'nvc')} WHERE question_id IS NOT NULL AND answer IS NOT NULL) GROUP BY 1""")
def G13_best_child(spark, sf_dir):
    rows = turns(spark, sf_dir, "question_id", "answer", "dinco_conf", "nvc").where("question_id IS NOT NULL AND answer IS NOT NULL")
    rows = rows.select("question_id", "answer", number("dinco_conf").alias("dinco"), number("nvc").alias("nvc"))
    return aggregate.best_child(rows, "question_id", "answer", "dinco", "nvc").select("question_id", r6("dinco").alias("dinco"), r6("nvc").alias("nvc"), "answer")


@query("SELECT level, source, count(*) AS n FROM examples GROUP BY ALL")
def G15_level_distribution(spark, sf_dir):
    return table(spark, sf_dir, "examples", "level", "source").groupBy("level", "source").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT round(avg(CAST(trim(coalesce(question_id, ''), ' ') <> '' AS DOUBLE)), 6) AS question_id_coverage, round(avg(CAST(trim(coalesce(gold_answer, ''), ' ') <> '' AS DOUBLE)), 6) AS gold_answer_coverage,
    round(avg(CAST(trim(coalesce(action_type, ''), ' ') <> '' AS DOUBLE)), 6) AS action_type_coverage FROM {sql.once('sft_pairs', 'pair_id', 'question_id', 'gold_answer', 'action_type')}""")
def G16_coverage(spark, sf_dir):
    rows = first_of_each(table(spark, sf_dir, "sft_pairs", "pair_id", "question_id", "gold_answer", "action_type"), "pair_id")
    shares = rows.agg(*aggregate.coverage(rows, "question_id", "gold_answer", "action_type"))
    return shares.select(*[r6(c).alias(c) for c in shares.columns])


@query(f"""WITH r AS (SELECT question_id, CASE WHEN result_id % 2 = 0 THEN 'role' ELSE 'plain' END AS arm, avg(f1) AS f1 FROM {_R('question_id', 'f1')} WHERE question_id IS NOT NULL GROUP BY ALL)
    SELECT a.question_id, round(a.f1, 6) AS a_f1, round(b.f1, 6) AS b_f1, round(a.f1 - b.f1, 6) AS d_f1 FROM r a JOIN r b USING (question_id) WHERE a.arm = 'role' AND b.arm = 'plain'""")
def G17_paired_arms(spark, sf_dir):
    rows = runs(spark, sf_dir, "question_id", "f1").where("question_id IS NOT NULL")
    rows = rows.groupBy("question_id", F.when(F.col("result_id") % 2 == 0, "role").otherwise("plain").alias("arm")).agg(F.avg("f1").alias("f1"))
    both = aggregate.paired_arms(rows, "question_id", "arm", "role", "plain", "f1")
    return both.select("question_id", *[r6(c).alias(c) for c in ("a_f1", "b_f1", "d_f1")])


@query("SELECT question_id, min(p) AS part FROM (SELECT question_id, CASE WHEN split = 'train' THEN 0 ELSE 1 END AS p FROM examples) GROUP BY 1")
def G18_ordered_union(spark, sf_dir):
    rows = table(spark, sf_dir, "examples", "question_id", "split")
    return aggregate.ordered_union(rows.where("split = 'train'"), rows.where("split IS NULL OR split <> 'train'"), key="question_id")


@query(f"""SELECT action.type AS condition, max_by(turn_id, -turn_id) AS turn_id, arg_min(contains(lower(coalesce(action.raw_text, '')), 'dinco'), turn_id) AS leaks FROM {_ANY('agent_turns', 'turn_id', 'action')} WHERE action.type IS NOT NULL GROUP BY 1""")
def K10_prompt_samples(spark, sf_dir):
    rows = turns(spark, sf_dir, "action").select("turn_id", F.col("action.type").alias("condition"), F.coalesce("action.raw_text", F.lit("")).alias("prompt")).where("condition IS NOT NULL")
    return prompt_samples(rows, "condition", "turn_id", "prompt", "dinco").select("condition", "turn_id", "leaks")


# ---- policies --------------------------------------------------------------------------------


@query(f"SELECT CASE WHEN coalesce({_NUM('g_mean')}, 0.0) < 0.8 THEN 'retrieve' ELSE 'memory' END AS route, count(*) AS n FROM {_ANY('agent_turns', 'turn_id', 'g_mean')} GROUP BY 1")
def L1_routes(spark, sf_dir):
    return turns(spark, sf_dir, "g_mean").groupBy(policy.route(number("g_mean")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT condition, coalesce({_NUM('nvc')}, 0.0) < threshold AS retrieves, count(*) AS n FROM {_ANY('agent_turns', 'turn_id', 'nvc')}, (VALUES ('threshold_30', 0.3), ('threshold_50', 0.5), ('threshold_70', 0.7)) c(condition, threshold) GROUP BY ALL""")
def L2_thresholds(spark, sf_dir):
    return policy.under_thresholds(turns(spark, sf_dir, "nvc"), number("nvc")).groupBy("condition", "retrieves").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT coalesce(tool_needed, by_count, true) AS retrieves, count(*) AS n FROM (SELECT CASE WHEN row_id % 3 = 0 THEN entity_count > 100 END AS tool_needed, sub_pred_count < 50 AS by_count FROM {_W}) GROUP BY 1")
def L3_oracle_routes(spark, sf_dir):
    rows = first_of_each(table(spark, sf_dir, "witqa", "row_id", "sub_pred_count", "entity_count"), "row_id")
    label = F.when(F.col("row_id") % 3 == 0, F.col("entity_count") > 100)
    return rows.groupBy(policy.oracle_retrieves(label, F.col("sub_pred_count") < 50).alias("retrieves")).agg(F.count(F.lit(1)).alias("n"))


_HOPS = f"""SELECT DISTINCT run_id || '/' || question_id AS task, turn, n, g, 0.6 * n + 0.4 * g AS c FROM (SELECT run_id, question_id, turn, {_NUM('nvc')} AS n, {_NUM('g_mean')} AS g
    FROM {_ANY('agent_turns', 'turn_id', 'run_id', 'question_id', 'turn', 'nvc', 'g_mean')}) WHERE run_id IS NOT NULL AND question_id IS NOT NULL AND turn IS NOT NULL"""


@query(f"""WITH h AS ({_HOPS}) SELECT task, coalesce(min(CASE WHEN coalesce(n, 0) > 0.7 AND coalesce(g, 0) >= 0.7 AND coalesce(c, 0) >= 0.65 THEN turn END), arg_max(turn, row(coalesce(c, -1.0), -turn))) AS hop,
    bool_or(coalesce(n, 0) > 0.7 AND coalesce(g, 0) >= 0.7 AND coalesce(c, 0) >= 0.65) AS stopped, count(*) AS n_hops FROM h GROUP BY task""")
def L7_stopping_hop(spark, sf_dir):
    rows = turns(spark, sf_dir, "run_id", "question_id", "turn", "nvc", "g_mean").where("run_id IS NOT NULL AND question_id IS NOT NULL AND turn IS NOT NULL")
    hops = rows.select(F.concat_ws("/", "run_id", "question_id").alias("task"), "turn", number("nvc").alias("n"), number("g_mean").alias("g")).distinct()
    return policy.stopping_hop(hops, "task", "turn", F.col("n"), F.col("g"), 0.6 * F.col("n") + 0.4 * F.col("g"))


_REAL = f"(trim(coalesce(answer, ''), ' ') <> '' AND {sql.official("coalesce(answer, '')")} <> 'insufficient evidence')"


@query(f"""SELECT CASE WHEN {_REAL} AND (coalesce({_NUM('g_mean')} >= 0.7 AND {_NUM('g_min')} >= 0.5, false) OR coalesce({_NUM('dinco_conf')} >= 0.9, false)) THEN 'commit' ELSE 'decompose' END AS action, count(*) AS n
    FROM {_ANY('agent_turns', 'turn_id', 'g_mean', 'g_min', 'answer', 'dinco_conf')} GROUP BY 1""")
def L10_exhausted_action(spark, sf_dir):
    from evidentia.operators.scoring import is_supported

    rows = turns(spark, sf_dir, "g_mean", "g_min", "answer", "dinco_conf")
    action = policy.exhausted_action(is_supported(number("g_mean"), number("g_min")), number("dinco_conf"), F.col("answer"))
    return rows.groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT CASE WHEN action.type = 'commit' AND NOT {_REAL} AND turn < 5 THEN 'retrieve' WHEN action.type = 'refine' AND coalesce(len(claims), 0) = 0 THEN 'retrieve' ELSE action.type END AS action, count(*) AS n
    FROM {_ANY('agent_turns', 'turn_id', 'action', 'answer', 'turn', 'claims')} WHERE turn IS NOT NULL GROUP BY 1""")
def L9_guarded_actions(spark, sf_dir):
    """A turn without claims stands for one without passages."""
    rows = turns(spark, sf_dir, "action", "answer", "turn", "claims").where("turn IS NOT NULL")
    guarded = policy.guarded_action(F.col("action.type"), F.col("answer"), F.col("turn") >= 5, F.coalesce(F.size("claims"), F.lit(0)) > 0)
    return rows.groupBy(guarded.alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH t AS (SELECT turn_id, v, lag(v) OVER (PARTITION BY run_id, question_id, {_OWN} ORDER BY turn NULLS FIRST, turn_id) AS b FROM (SELECT turn_id, run_id, question_id, turn, {_NUM('nvc')} AS v FROM {_ANY('agent_turns', 'turn_id', 'run_id', 'question_id', 'turn', 'nvc')}))
    SELECT turn_id, round(v - b, 6) AS delta, CASE WHEN v - b IS NULL THEN NULL WHEN v - b > 0.005 THEN 'IMPROVED' WHEN v - b < -0.005 THEN 'DECREASED' ELSE 'UNCHANGED' END AS change FROM t""")
def X_signal_changes(spark, sf_dir):
    rows = turns(spark, sf_dir, "run_id", "question_id", "turn", "nvc").withColumn("v", number("nvc"))
    return policy.signal_changes(rows, ["run_id", "question_id"], "turn", "v", "turn_id").select("turn_id", r6("delta").alias("delta"), "change")


@query(f"""SELECT turn_id, round(max(v) OVER w, 6) AS best_so_far, round(avg(v) OVER (PARTITION BY run_id, question_id, {_OWN} ORDER BY turn NULLS FIRST, turn_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 6) AS recent_mean
    FROM (SELECT turn_id, run_id, question_id, turn, {_NUM('nvc')} AS v FROM {_ANY('agent_turns', 'turn_id', 'run_id', 'question_id', 'turn', 'nvc')}) WINDOW w AS (PARTITION BY run_id, question_id, {_OWN} ORDER BY turn NULLS FIRST, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def X_running_best(spark, sf_dir):
    rows = turns(spark, sf_dir, "run_id", "question_id", "turn", "nvc").withColumn("v", number("nvc"))
    return policy.running_best(rows, ["run_id", "question_id"], "turn", "v", "turn_id").select("turn_id", r6("best_so_far").alias("best_so_far"), r6("recent_mean").alias("recent_mean"))


@query(f"""SELECT run_id, question_id, coalesce(min(CASE WHEN kind IN ('commit', 'decompose') THEN turn END), max(turn)) AS end_turn, max(CAST(coalesce(kind IN ('commit', 'decompose'), NULL) AS INTEGER)) AS ended
    FROM (SELECT turn_id, run_id, question_id, turn, action.type AS kind FROM {_ANY('agent_turns', 'turn_id', 'run_id', 'question_id', 'turn', 'action')}) WHERE run_id IS NOT NULL AND question_id IS NOT NULL GROUP BY ALL""")
def T10_terminal_turn(spark, sf_dir):
    rows = turns(spark, sf_dir, "run_id", "question_id", "turn", "action").where("run_id IS NOT NULL AND question_id IS NOT NULL")
    return policy.terminal_turn(rows, ["run_id", "question_id"], "turn", F.col("action.type"))


# ---- graphs: parts form a binary tree in which each waits for its half -------------------------


def _tree(spark, sf_dir):
    nodes = table(spark, sf_dir, "part", "p_partkey", "p_size").select(
        F.col("p_partkey").alias("id"), F.floor(F.log2(F.greatest("p_partkey", F.lit(1))) + 1e-9).cast("int").alias("depth"), F.when(F.col("p_size") % 3 == 0, "pending").otherwise("done").alias("status"), F.expr("p_partkey % 5").alias("plan")
    )
    return nodes, nodes.where("id > 1").select("id", F.expr("id div 2").alias("dep"))


_NODES = "n AS (SELECT p_partkey AS id, CAST(floor(log2(greatest(p_partkey, 1)) + 1e-9) AS INTEGER) AS depth, CASE WHEN p_size % 3 = 0 THEN 'pending' ELSE 'done' END AS status FROM part), e AS (SELECT id, id // 2 AS dep FROM n WHERE id > 1)"


@query(f"WITH {_NODES} SELECT id, depth FROM n WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM e LEFT JOIN n d ON d.id = e.dep WHERE e.id = n.id AND coalesce(d.status, '') <> 'done')")
def Q3_ready_nodes(spark, sf_dir):
    nodes, edges = _tree(spark, sf_dir)
    return dag.ready_nodes(nodes.select("id", "depth", "status"), edges, [], F.col("status") == "done").select("id", "depth")


@query(f"WITH RECURSIVE {_NODES}, r AS (SELECT id, dep FROM e UNION SELECT r.id, e.dep FROM r JOIN e ON e.id = r.dep) SELECT id, dep FROM r")
def Q4_dependency_closure(spark, sf_dir):
    return dag.closure(_tree(spark, sf_dir)[1], [])


@query(f"WITH {_NODES}, x AS (SELECT id, dep + CASE WHEN id % 7 = 0 THEN 1000000000 WHEN id % 11 = 0 THEN id - dep ELSE 0 END AS dep FROM e) SELECT id, dep, CASE WHEN id = dep THEN 'self' ELSE 'missing' END AS problem FROM x WHERE id = dep OR dep NOT IN (SELECT id FROM n)")
def Q6_broken_references(spark, sf_dir):
    nodes, edges = _tree(spark, sf_dir)
    off = F.when(F.col("id") % 7 == 0, F.lit(1000000000)).when(F.col("id") % 11 == 0, F.col("id") - F.col("dep")).otherwise(0)
    return dag.broken_references(nodes, edges.select("id", (F.col("dep") + off).alias("dep")), [])


@query(f"""SELECT result_id, CAST(n + 1 AS INTEGER) AS steps, actions || ',finalize' AS actions FROM (SELECT result_id, len(policy_trace) AS n, array_to_string(list_transform(policy_trace, lambda e: coalesce(e.action, '')), ',') AS actions
    FROM {_ANY('trajectories', 'result_id', 'policy_trace')} WHERE len(policy_trace) > 0)""")
def Q12_numbered_trace(spark, sf_dir):
    rows = runs(spark, sf_dir, "policy_trace").where(F.size("policy_trace") > 0)
    t = dag.numbered_trace(F.transform("policy_trace", lambda e: F.coalesce(e["action"], F.lit(""))))
    return rows.select("result_id", F.size(t).alias("steps"), F.array_join(F.transform(t, lambda e: e["action"]), ",").alias("actions"))


# ---- training rows ---------------------------------------------------------------------------

_CALLS = "CAST(coalesce(len(list_filter(policy_trace, lambda e: e.action = 'agent_turn')), 0) AS INTEGER)"


@query(f"SELECT result_id, {_CALLS} AS calls FROM {_ANY('trajectories', 'result_id', 'policy_trace')}")
def T1_call_count(spark, sf_dir):
    return runs(spark, sf_dir, "policy_trace").select("result_id", training.call_count(F.col("policy_trace")).alias("calls"))


@query(f"""WITH r AS (SELECT result_id, coalesce(f1, 0.0) AS q, {_CALLS} AS c FROM {_ANY('trajectories', 'result_id', 'f1', 'policy_trace')}),
    p AS (SELECT result_id, row_number() OVER (ORDER BY q DESC, result_id) + row_number() OVER (ORDER BY c, result_id) - 2 AS joint FROM r)
    SELECT result_id, joint FROM p QUALIFY row_number() OVER (ORDER BY joint, result_id) <= greatest(1, (SELECT count(*) FROM r) // 4)""")
def T2_pareto_quartile(spark, sf_dir):
    rows = runs(spark, sf_dir, "f1", "policy_trace")
    return training.pareto_quartile(rows, "result_id", F.coalesce("f1", F.lit(0.0)), training.call_count(F.col("policy_trace")))


@query(f"""WITH r AS (SELECT result_id, i - 1 AS pos, policy_trace[i] AS e FROM (SELECT *, unnest(range(1, len(policy_trace) + 1)) AS i FROM {_ANY('trajectories', 'result_id', 'policy_trace')}))
    SELECT result_id, CAST(pos AS INTEGER) AS pos, coalesce(e.details.turn, -1) AS turn, e.details.action AS action_type FROM r WHERE e.action = 'agent_turn'
    AND length(trim(coalesce(e.details.action_analysis, ''), ' ')) >= 20 AND length(trim(coalesce(e.details.action_reason, ''), ' ')) >= 10""")
def T4_training_pairs(spark, sf_dir):
    rows = runs(spark, sf_dir, "policy_trace", "pred_answer_raw")
    return training.training_pairs(rows, "result_id", "policy_trace", "pred_answer_raw").select("result_id", "pos", "turn", "action_type")


@query()
def T3_targets(spark, sf_dir):
    rows = runs(spark, sf_dir, "policy_trace", "pred_answer_raw")
    return training.training_pairs(rows, "result_id", "policy_trace", "pred_answer_raw").select("result_id", "pos", "target")


_REWARD = f"""p AS (SELECT result_id, question_id, {sql.reward_words('pred_answer')} AS p, {sql.reward_words('gold_answer')} AS g, {_CALLS} AS c FROM {_ANY('trajectories', 'result_id', 'question_id', 'pred_answer', 'gold_answer', 'policy_trace')}),
    r AS (SELECT result_id, question_id, 2.0 * CASE WHEN len(p) < 2 AND len(g) >= 3 THEN 0.0 ELSE {sql.f1('p', 'g')} END - 0.15 * least(c / 9.0, 1.0) AS reward FROM p)"""


def _rewards(spark, sf_dir):
    rows = runs(spark, sf_dir, "question_id", "pred_answer", "gold_answer", "policy_trace")
    return rows.select("result_id", "question_id", training.reward(F.col("pred_answer"), F.col("gold_answer"), training.call_count(F.col("policy_trace"))).alias("reward"))


@query(f"WITH {_REWARD} SELECT result_id, round(reward, 6) AS reward FROM r")
def T6_reward(spark, sf_dir):
    return _rewards(spark, sf_dir).select("result_id", r6("reward").alias("reward"))


@query(f"WITH {_REWARD} SELECT result_id, round(reward - avg(reward) OVER (PARTITION BY question_id), 5) AS advantage FROM r WHERE question_id IS NOT NULL")
def T7_advantages(spark, sf_dir):
    out = training.advantages(_rewards(spark, sf_dir).where("question_id IS NOT NULL"), "question_id", "reward")
    return out.select("result_id", F.round("advantage", 5).alias("advantage"))


@query("SELECT example_id, (example_id - 3 * 10) % 100 >= 0 AND ((example_id - 30) % 100 + 100) % 100 < 10 AS picked FROM examples".replace("(example_id - 3 * 10) % 100 >= 0 AND ", ""))
def T8_cyclic_batch(spark, sf_dir):
    return table(spark, sf_dir, "examples", "example_id").select("example_id", training.cyclic_batch(F.col("example_id"), 100, 3, 10).alias("picked"))


@query(f"WITH {_REWARD} SELECT result_id % 8 AS step, count(*) AS n, round(avg(reward), 6) AS mean_reward FROM r GROUP BY 1")
def T9_step_stats(spark, sf_dir):
    rows = _rewards(spark, sf_dir).groupBy((F.col("result_id") % 8).alias("step"))
    return rows.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("reward")).alias("mean_reward"))


@query("""SELECT pair_id, CAST(len(messages) + CASE WHEN messages[-1].role = 'assistant' THEN 0 ELSE 1 END AS INTEGER) AS n_messages FROM sft_pairs WHERE len(messages) > 0""")
def T11_chat_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "sft_pairs", "pair_id", "messages", "target").where(F.size("messages") > 0)
    return rows.select("pair_id", F.size(training.with_assistant(F.col("messages"), F.col("target"))).alias("n_messages"))


# ---- windows over time -----------------------------------------------------------------------


@query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(avg(value), 5) AS mean FROM events GROUP BY ALL")
def X_windowed_counts(spark, sf_dir):
    rows = windowed_counts(table(spark, sf_dir, "events", "ts", "event_type", "value"), "ts", "event_type", "value")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 5).alias("mean"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def X_sessions(spark, sf_dir):
    rows = sessions(table(spark, sf_dir, "events", "ts", "user_id"), "ts", "user_id")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")

# ---- compositions ----------------------------------------------------------------------------

_COVER = lambda h, p: f"CASE WHEN len({h}) = 0 THEN 0.0 ELSE {sql.overlap(h, p)} / len({h}) END"
_EVID = f"(SELECT question_id, context_text FROM {sql.once('evidence_docs', 'evid_id', 'question_id', 'context_text')} WHERE question_id IS NOT NULL AND context_text IS NOT NULL)"


def _evidence(spark, sf_dir):
    rows = first_of_each(table(spark, sf_dir, "evidence_docs", "evid_id", "question_id", "context_text"), "evid_id")
    return rows.where("question_id IS NOT NULL AND context_text IS NOT NULL")


@query(f"""WITH c AS (SELECT DISTINCT question_id, unnest(claims) AS c FROM {_ANY('agent_turns', 'turn_id', 'question_id', 'claims')} WHERE question_id IS NOT NULL), e AS (SELECT question_id, {sql.official_words('context_text')} AS p FROM {_EVID}),
    w AS (SELECT question_id, c, {sql.official_words('c')} AS h FROM c WHERE c IS NOT NULL), s AS (SELECT w.question_id, w.c, max(CASE WHEN p IS NULL THEN 0.0 ELSE {_COVER('h', 'p')} END) AS s FROM w LEFT JOIN e ON e.question_id = w.question_id GROUP BY ALL)
    SELECT question_id, count(*) AS claims, round(avg(coalesce(s, 0.0)), 6) AS g_mean, round(min(coalesce(s, 0.0)), 6) AS g_min FROM s GROUP BY 1""")
def E5_scored_claims(spark, sf_dir):
    from evidentia.functions.scorers import scorer
    from evidentia.operators.scoring import grounded_claims

    claims = turns(spark, sf_dir, "question_id", "claims").where("question_id IS NOT NULL").select("question_id", F.explode("claims").alias("claim"))
    got = grounded_claims(claims, _evidence(spark, sf_dir), ["question_id"], "claim", "context_text", scorer("coverage"))
    return got.select("question_id", "claims", r6("g_mean").alias("g_mean"), r6("g_min").alias("g_min"))


@query(f"""WITH t AS (SELECT result_id, question_id, {sql.official_words("concat_ws(' ', nullif(trim(question, ' '), ''), nullif(trim(pred_answer, ' '), ''))")} AS h FROM {_R('question_id', 'question', 'pred_answer')}),
    e AS (SELECT question_id, {sql.official_words('context_text')} AS p FROM {_EVID}) SELECT result_id, round(max({_COVER('h', 'p')}), 6) AS support FROM t JOIN e USING (question_id) GROUP BY 1""")
def E9_single_claims(spark, sf_dir):
    from evidentia.functions.scorers import scorer
    from evidentia.operators.scoring import single_claim

    rows = runs(spark, sf_dir, "question_id", "question", "pred_answer").join(_evidence(spark, sf_dir), "question_id")
    support = scorer("coverage")(F.col("context_text"), single_claim(F.col("question"), F.col("pred_answer")))
    return rows.groupBy("result_id").agg(r6(F.max(support)).alias("support"))


@query()
def C15_end_to_end(spark, sf_dir):
    """Distinct answers of a run's question, the first turn's at 0, their coverage as entailment."""
    from evidentia.functions.scorers import scorer
    from evidentia.operators import confidence

    rows = turns(spark, sf_dir, "run_id", "question_id", "turn", "answer", "nvc").where("run_id IS NOT NULL AND question_id IS NOT NULL AND answer IS NOT NULL")
    task = rows.select(F.concat_ws("/", "run_id", "question_id").alias("task"), "turn_id", "answer", F.coalesce(number("nvc"), F.lit(0.0)).alias("p"), F.coalesce(F.col("turn") == 0, F.lit(False)).alias("greedy"))
    kept = confidence.greedy_first(task, "task", "answer", "greedy", "turn_id")
    got = confidence.end_to_end(kept, "task", "place", "answer", "p", scorer("coverage"))
    return got.select(F.col("ex").alias("task"), r6("nvc").alias("nvc"), r6("sc_conf").alias("sc_conf"), r6("dinco").alias("dinco"))


@query(f"""WITH r AS {_ANY('trajectories', 'result_id', 'question_id', 'nvc', 'em')}, d AS (SELECT DISTINCT question_id FROM r WHERE nvc IS NULL OR isnan(nvc)) SELECT result_id, em FROM r WHERE question_id IS NULL OR question_id NOT IN (SELECT question_id FROM d WHERE question_id IS NOT NULL)""")
def C17_complete_examples(spark, sf_dir):
    """Runs of questions of which no run lacks a confidence."""
    from evidentia.operators.confidence import without_dropped

    rows = runs(spark, sf_dir, "question_id", "nvc", "em")
    reasons = rows.where("nvc IS NULL OR isnan(nvc)").select("question_id", F.lit("no confidence").alias("reason"))
    return without_dropped(rows, reasons, "question_id").select("result_id", "em")


@query()
def C19_semantic_distractors(spark, sf_dir):
    """Distinct answers of a run's question, the first turn's as the main one, without those that say the same."""
    from evidentia.functions.scorers import scorer
    from evidentia.operators import confidence

    rows = turns(spark, sf_dir, "run_id", "question_id", "turn", "answer").where("run_id IS NOT NULL AND question_id IS NOT NULL AND answer IS NOT NULL")
    task = rows.select(F.concat_ws("/", "run_id", "question_id").alias("task"), "turn_id", "answer", F.coalesce(F.col("turn") == 0, F.lit(False)).alias("greedy"))
    kept = confidence.greedy_first(task, "task", "answer", "greedy", "turn_id").withColumn("place", F.col("place").cast("int"))
    return confidence.semantic_distractors(kept, "task", "answer", "place", scorer("coverage"))


@query(f"""SELECT result_id, 'closed_book' AS condition, CAST(NULL AS VARCHAR) AS route, em FROM {_ANY('trajectories', 'result_id', 'em', 'nvc')} UNION ALL
    SELECT result_id, 'gated', CASE WHEN coalesce({_NUM('nvc')}, 0) < 0.8 THEN 'retrieve' ELSE 'memory' END, NULL FROM {_ANY('trajectories', 'result_id', 'nvc')} WHERE nvc IS NOT NULL""")
def L5_condition_records(spark, sf_dir):
    rows = runs(spark, sf_dir, "em", "nvc")
    branches = {"closed_book": (F.lit(True), {"em": F.col("em")}), "gated": (F.col("nvc").isNotNull(), {"route": policy.route(number("nvc"))})}
    return policy.condition_records(rows, branches, ["result_id"]).select("result_id", "condition", "route", "em")


@query()
def L8_advisory_flags(spark, sf_dir):
    from evidentia.functions import hints

    rows = turns(spark, sf_dir, "subquestion", "answer", "claims", "claim_supports", "nvc")
    d = hints.diagnostics(F.col("subquestion"), F.coalesce("answer", F.lit("")), F.col("claims"), F.col("claim_supports"))
    flags = policy.advisory_flags(number("nvc"), F.col("d.kind_agrees"), F.col("d.entity_coverage"), F.col("d.least_grounding"))
    named = rows.withColumn("d", d).select(F.explode(flags).alias("flag"))
    return named.groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query()
def L9_agent_loop(spark, sf_dir):
    """The loop with a rule as policy: refine (which without passages becomes a retrieval), retrieve, then commit."""
    asked = table(spark, sf_dir, "examples", "question_id").where("question_id IS NOT NULL").distinct()
    return policy.run_agent(asked, "question_id", lambda key, history: {"action": "commit", "answer": key} if len(history) >= 2 else {"action": "retrieve" if history else "refine"})


@query()
def L15_error_rows(spark, sf_dir):
    """Targets that are no JSON become error rows."""
    import json

    rows = first_of_each(table(spark, sf_dir, "sft_pairs", "pair_id", "target"), "pair_id")
    return policy.with_error_rows(rows, "pair_id", lambda v: len(json.loads(v)), "target").select("pair_id", "result", "error_type")


@query()
def G14_node_counters(spark, sf_dir):
    """Planned nodes, hits and events of each run, from its planning trace."""
    from evidentia.operators.nested_json import trajectory_tables

    rows = table(spark, sf_dir, "trajectories", "result_id", "policy_trace", "planning_trace", "support")
    each = trajectory_tables(rows, with_values=False).where("child_table LIKE 'planning_trace%'")
    return each.groupBy("result_id", "child_table").agg(F.count(F.lit(1)).alias("n"))


@query()
def Q1_sound_plans(spark, sf_dir):
    """The initial plan of each run (the nodes of its first event that has any) without repeats, with the
    dependencies that hold; of a run without plan its question."""
    from evidentia.operators.nested_json import trajectory_tables

    rows = table(spark, sf_dir, "trajectories", "result_id", "policy_trace", "planning_trace", "support")
    nodes = trajectory_tables(rows).where("child_table = 'planning_trace.nodes'")
    deps = F.coalesce(F.from_json(F.get_json_object("value", "$.depends_on"), "array<string>"), F.filter(F.array(F.get_json_object("value", "$.depends_on")), lambda x: x.isNotNull()))
    first = nodes.groupBy("result_id").agg(F.min(F.col("parent_pos").cast("int")).alias("_first"))
    plan = nodes.join(first, "result_id").where(F.col("parent_pos").cast("int") == F.col("_first")).select(
        "result_id", "pos", dag.clean_node_id(F.get_json_object("value", "$.id")).alias("id"),
        F.get_json_object("value", "$.subquestion").alias("q"), F.transform(deps, lambda d: dag.clean_node_id(d)).alias("deps"),
    )
    asked = runs(spark, sf_dir, "question")
    return dag.sound_plan(plan, "result_id", "id", "q", "deps", "pos", asked, "question").select("result_id", "id", "q", F.array_join("deps", ",").alias("deps"))


@query()
def Q7_accepted_children(spark, sf_dir):
    """Planned sub-questions of each planning event that may join below the run's own question."""
    from evidentia.operators.nested_json import trajectory_tables

    rows = table(spark, sf_dir, "trajectories", "result_id", "policy_trace", "planning_trace", "support")
    nodes = trajectory_tables(rows).where("child_table = 'planning_trace.nodes'")
    children = nodes.select("result_id", F.concat_ws("/", F.col("result_id").cast("string"), "parent_pos").alias("parent"), F.get_json_object("value", "$.subquestion").alias("q"), "pos")
    asked = first_of_each(table(spark, sf_dir, "trajectories", "result_id", "question"), "result_id")
    parents = children.select("result_id", "parent").distinct().join(asked, "result_id")
    parents = parents.select(F.col("parent").alias("id"), F.col("parent").alias("plan"), F.lit(0).alias("depth"), F.coalesce("question", F.lit("")).alias("question"))
    return dag.accepted_children(children.drop("result_id"), "parent", "q", "pos", parents).select("plan", "q", "depth", "pos")


@query(f"WITH {_NODES} SELECT id, CAST(greatest(depth, 0) AS BIGINT) AS waits FROM n WHERE id > 0 UNION ALL SELECT id, 0 FROM n WHERE id = 0")
def Q5_waiting_nodes(spark, sf_dir):
    nodes, edges = _tree(spark, sf_dir)
    return dag.execution_ranks(edges, nodes, []).select("id", "waits")


@query(f"""SELECT example_id, category, CASE category WHEN 'person-name-swap' THEN split_part(trim(answer, ' '), ' ', 2) || ' ' || split_part(trim(answer, ' '), ' ', 1) WHEN 'yes-no-restate' THEN CASE WHEN lower(answer) = 'yes' THEN 'Yes, that is correct.' ELSE 'No, that is not correct.' END
    WHEN 'year-prefix' THEN 'the year ' || answer || '|in ' || answer WHEN 'place-prefix' THEN 'the ' || answer || '|' || answer || ' itself' ELSE 'the answer is ' || answer || '|' || answer || ' is correct' END AS paraphrases
    FROM (SELECT *, {_CATEGORY} AS category FROM examples WHERE answer IS NOT NULL) WHERE category IS NOT NULL""")
def P27_paraphrases(spark, sf_dir):
    rows = table(spark, sf_dir, "examples", "example_id", "answer", "type").where("answer IS NOT NULL")
    named = rows.withColumn("category", reshape.control_category(F.col("answer"), F.col("type"))).where("category IS NOT NULL")
    return named.select("example_id", "category", F.array_join(reshape.paraphrases(F.col("category"), F.col("answer")), "|").alias("paraphrases"))


@query("SELECT example_id FROM (SELECT example_id FROM examples ORDER BY example_id LIMIT 40 OFFSET 15)")
def P14_slice(spark, sf_dir):
    """A slice is the feature here: offset and limit after a total order."""
    return table(spark, sf_dir, "examples", "example_id").orderBy("example_id").offset(15).limit(40)


@query("""SELECT question_id, question AS prompt, coalesce(answer, '') AS ground_truth, coalesce(nullif(level, ''), 'unknown') AS level, CASE WHEN split = 'train' THEN 'train' ELSE 'val' END AS slot FROM examples WHERE question IS NOT NULL""")
def T5_prompt_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "examples", "question_id", "question", "answer", "level", "split").where("question IS NOT NULL")
    return rows.select(
        "question_id", F.col("question").alias("prompt"), F.coalesce("answer", F.lit("")).alias("ground_truth"), F.coalesce(F.nullif("level", F.lit("")), F.lit("unknown")).alias("level"),
        F.when(F.col("split") == "train", "train").otherwise("val").alias("slot"),
    )


@query(f"""SELECT run_id, question_id, count(*) AS turns, max(turn) AS last_turn, count(*) FILTER (action.type = 'retrieve') AS retrievals, round(avg({_NUM('g_mean')}), 6) AS g_mean
    FROM {_ANY('agent_turns', 'turn_id', 'run_id', 'question_id', 'turn', 'action', 'g_mean')} GROUP BY ALL""")
def G8_agent_summary(spark, sf_dir):
    rows = turns(spark, sf_dir, "run_id", "question_id", "turn", "action", "g_mean")
    return rows.groupBy("run_id", "question_id").agg(
        F.count(F.lit(1)).alias("turns"), F.max("turn").alias("last_turn"), F.count(F.when(F.col("action.type") == "retrieve", 1)).alias("retrievals"), r6(F.avg(number("g_mean"))).alias("g_mean")
    )


@query(f"""SELECT source, type, split, count(*) AS n, grouping(source) + grouping(type) + grouping(split) AS level FROM examples GROUP BY ROLLUP (source, type, split)""".replace("grouping(source) + grouping(type) + grouping(split) AS level", "CAST(grouping(source) + grouping(type) + grouping(split) AS INTEGER) AS level"))
def X_rollup_report(spark, sf_dir):
    rows = table(spark, sf_dir, "examples", "source", "type", "split").rollup("source", "type", "split")
    level = (F.grouping("source") + F.grouping("type") + F.grouping("split")).cast("int")
    return rows.agg(F.count(F.lit(1)).alias("n"), level.alias("level")).select("source", "type", "split", "n", "level")
