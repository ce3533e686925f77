"""Queries of tokenisers, normalisers, chunking, parsing and kinds of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import parse, text
from evidentia.operators import chunking
from evidentia.plans import sql
from evidentia.session import first_of_each, own_group, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def scalar(name: str, source: str, key: str, columns: list[str], expr, oracle: str | None) -> None:
    """A query of one expression over a whole table: ``key, out``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source, key, *columns).select(key, expr().alias("out"))

    QUERIES[name] = run
    if oracle:
        ORACLES[name] = f"SELECT {key}, {oracle} AS out FROM {source}"


scalar("N0_tokenize", "documents", "doc_id", ["text"], lambda: F.array_join(text.tokens("text"), " "), f"array_to_string({sql.tokens('text')}, ' ')")
scalar("N1_trivia_form", "witqa", "row_id", ["extracted_text"], lambda: text.trivia_form("extracted_text"), sql.trivia("extracted_text"))
scalar("N2_official_form", "agent_turns", "turn_id", ["answer"], lambda: text.official_form("answer"), sql.official("answer"))
scalar("N3_compatible_form", "witqa", "row_id", ["gold_answer"], lambda: text.compatible_form("gold_answer"), None)
scalar("N4_reward_form", "agent_turns", "turn_id", ["action"], lambda: text.reward_form("action.reason"), f"array_to_string({sql.reward_words('action.reason')}, ' ')")
scalar("N5_dedupe_key", "agent_turns", "turn_id", ["answer"], lambda: text.dedupe_key("answer"), f"replace(lower({sql.first_line('answer')}), '.', '')")
scalar("N6_sampling_form", "trajectories", "result_id", ["pred_answer_raw"], lambda: text.sampling_form("pred_answer_raw"), sql.official(sql.first_line("pred_answer_raw")))
scalar("N7_planner_key", "agent_turns", "turn_id", ["subquestion"], lambda: text.official_form("subquestion"), sql.official("subquestion"))
scalar("N8_squeeze", "evidence_docs", "evid_id", ["context_text"], lambda: text.squeeze("context_text"), sql.squeeze("context_text"))
scalar("N9_first_line_answer", "trajectories", "result_id", ["pred_answer_raw"], lambda: text.first_line_answer("pred_answer_raw"), sql.first_line("pred_answer_raw"))
scalar("P19_split_aliases", "witqa", "row_id", ["gold_answer"], lambda: F.to_json(text.split_aliases("gold_answer")), f"CAST(to_json({sql.aliases('gold_answer')}) AS VARCHAR)")
scalar("K11_slug", "evidence_docs", "evid_id", ["title"], lambda: text.slug(F.coalesce("title", F.lit(""))),
       "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim(coalesce(title, ''), ' '), '[^A-Za-z0-9._-]+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unnamed')")
scalar("A23_cut_at_word", "evidence_docs", "evid_id", ["context_text"], lambda: text.cut_at_word("context_text", 200),
       r"CASE WHEN length(context_text) <= 200 THEN context_text ELSE regexp_replace(substring(context_text, 1, 200), '\s\S*$', '') || ' ...' END")

_OPENERS = "|".join(text.YES_NO_OPENERS)
_YES_NO_Q = rf"regexp_matches(lower(trim(question, ' ')), '^({_OPENERS})\b')"
scalar("A17_yes_no_question", "examples", "example_id", ["question"], lambda: text.is_yes_no_question("question"), _YES_NO_Q)


def _yes_or_no_sql(x: str) -> str:
    t = f"(' ' || {sql.official(x)} || ' ')"
    any_of = lambda cues: " OR ".join(f"contains({t}, '{c}')" for c in cues)
    return f"CASE WHEN contains({t}, ' yes ') THEN 'yes' WHEN contains({t}, ' no ') THEN 'no' WHEN {any_of(text.NO_CUES)} THEN 'no' WHEN {any_of(text.YES_CUES)} THEN 'yes' END"


scalar("A17_yes_or_no", "agent_turns", "turn_id", ["action"], lambda: text.yes_or_no("action.reason"), _yes_or_no_sql("action.reason"))

_Q = "lower(trim(question, ' '))"
scalar("A18_expected_kind", "trajectories", "result_id", ["question"], lambda: text.expected_kind("question"), rf"""
    CASE WHEN question IS NULL THEN 'entity' WHEN {_YES_NO_Q} THEN 'yes_no'
    WHEN regexp_matches({_Q}, '\b(what|which)\s+(government\s+)?(position|role|title|office|post)\b') THEN 'role_title'
    WHEN regexp_matches({_Q}, '\b(who|whom|whose)\b') THEN 'person_name' WHEN regexp_matches({_Q}, '\b(when|what year|what date)\b') THEN 'date'
    WHEN regexp_matches({_Q}, '\b(how many|how much|what number)\b') THEN 'number'
    WHEN regexp_matches({_Q}, '\b(where|which city|which state|which country|what country)\b') THEN 'location'
    WHEN regexp_matches({_Q}, '\b(which organization|which company|which institution|which university)\b') THEN 'organization' ELSE 'entity' END""")  # fmt: skip


def _kind_sql(x: str) -> str:
    n, a = sql.official(x), f"trim(coalesce({x}, ''), ' ')"
    n = n.replace(f"lower({x})", f"lower({a})")
    return rf"""CASE WHEN {a} = '' THEN 'unknown' WHEN {n} IN ('yes', 'no') THEN 'yes_no' WHEN regexp_matches({n}, '^\d+(\.\d+)?$') THEN 'number'
    WHEN regexp_matches({n}, '\b({"|".join(text.MONTHS)})\b') OR regexp_matches({n}, '\b\d{{4}}\b') THEN 'date'
    WHEN regexp_matches({n}, '{"|".join(text.ROLE_WORDS)}') THEN 'role_title' WHEN regexp_matches({n}, '{"|".join(text.ORGANISATION_WORDS)}') THEN 'organization'
    WHEN regexp_matches({n}, '{"|".join(text.PLACE_WORDS)}') THEN 'location'
    WHEN len(regexp_split_to_array({a}, '\s+')) <= 4 AND len(list_filter(regexp_split_to_array({a}, '\s+'), lambda w: NOT regexp_matches(w, '^[A-Z][A-Za-z''.]+$'))) = 0
    THEN 'person_name' ELSE 'entity' END"""


scalar("A18_answer_kind", "trajectories", "result_id", ["pred_answer"], lambda: text.answer_kind("pred_answer"), _kind_sql("pred_answer"))
scalar("A27_score_bin", "agent_turns", "turn_id", ["nvc"], lambda: text.score_bin(F.nanvl("nvc", F.lit(None).cast("double"))),
       "CASE WHEN nvc IS NULL OR isnan(nvc) THEN 'n/a' WHEN nvc < 0.2 THEN 'very low' WHEN nvc < 0.4 THEN 'low' WHEN nvc < 0.6 THEN 'medium' WHEN nvc < 0.8 THEN 'high' ELSE 'very high' END")


def A19_kinds_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_of_each(table(spark, sf_dir, "trajectories", "result_id", "question", "pred_answer"), "result_id")
    expected, found = text.expected_kind("question"), text.answer_kind("pred_answer")
    return rows.groupBy(expected.alias("expected"), text.kind_label(found).alias("found")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(text.kinds_agree(expected, found), 1)).alias("n_agree")
    )


QUERIES["A19_kinds_agree"] = A19_kinds_agree
_EXPECTED = ORACLES["A18_expected_kind"].split(", ", 1)[1].rsplit(" AS out", 1)[0]
ORACLES["A19_kinds_agree"] = f"""WITH k AS (SELECT {_EXPECTED} AS expected, {_kind_sql('pred_answer')} AS kind FROM {sql.once('trajectories', 'result_id', 'question', 'pred_answer')})
    SELECT expected, CASE kind {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in text.KIND_LABELS.items())} ELSE 'OTHER' END AS found, count(*) AS n,
    count(CASE WHEN CASE expected WHEN 'entity' THEN kind <> 'unknown' WHEN 'date' THEN kind IN ('date', 'number') WHEN 'location' THEN kind IN ('location', 'entity')
    WHEN 'organization' THEN kind IN ('organization', 'entity') ELSE kind = expected END THEN 1 END) AS n_agree FROM k GROUP BY ALL"""


# ---- chunking --------------------------------------------------------------------------------

_T = r"regexp_replace(replace(coalesce(context_text, ''), chr(13) || chr(10), chr(10)), '^\s+|\s+$', '', 'g')"
_CUT = lambda pattern: rf"list_filter(list_transform(regexp_split_to_array({_T}, '{pattern}'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')"
_PARAGRAPHS = f"CASE WHEN {_T} = '' THEN [] WHEN len({_CUT(chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n+')}) > 1 THEN {_CUT(chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n+')} WHEN len({_CUT(chr(92) + 'n')}) > 1 THEN {_CUT(chr(92) + 'n')} ELSE [{_T}] END"


def H1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = first_of_each(table(spark, sf_dir, "evidence_docs", "evid_id", "context_text"), "evid_id")
    return docs.select("evid_id", F.posexplode(chunking.paragraphs("context_text")).alias("pos", "paragraph"))


def H2_word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = first_of_each(table(spark, sf_dir, "evidence_docs", "evid_id", "context_text"), "evid_id")
    return chunking.chunk_rows(docs, "context_text", "evid_id", by_paragraph=False).select("evid_id", "chunk_index", "start_word", "end_word", "word_count", F.md5("text").alias("digest"))


def H3_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = first_of_each(table(spark, sf_dir, "evidence_docs", "evid_id", "context_text"), "evid_id")
    return chunking.chunk_rows(docs, "context_text", "evid_id").select("evid_id", "chunk_index", "start_word", "end_word", "word_count", "split_type", F.md5("text").alias("digest"))


QUERIES |= {"H1_paragraphs": H1_paragraphs, "H2_word_windows": H2_word_windows, "H3_chunks": H3_chunks}
_DOCS = sql.once("evidence_docs", "evid_id", "context_text")
ORACLES["H1_paragraphs"] = f"""WITH d AS (SELECT evid_id, {_PARAGRAPHS} AS ps FROM {_DOCS})
    SELECT evid_id, CAST(i - 1 AS INTEGER) AS pos, ps[i] AS paragraph FROM (SELECT evid_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM d)"""
_WINDOWS = """SELECT *, unnest(range(0, CASE WHEN n = 0 THEN 0 WHEN n <= 120 THEN 1 ELSE CAST(ceil((n - 120) / 80.0) AS BIGINT) + 1 END)) * 80 AS s"""
ORACLES["H2_word_windows"] = f"""WITH d AS (SELECT evid_id, {sql.words('context_text')} AS w FROM {_DOCS}), e AS (SELECT *, len(w) AS n FROM d WHERE w IS NOT NULL), f AS ({_WINDOWS} FROM e)
    SELECT evid_id, CAST(s // 80 AS INTEGER) AS chunk_index, CAST(s AS INTEGER) AS start_word, CAST(least(n, s + 120) AS INTEGER) AS end_word, CAST(least(n, s + 120) - s AS INTEGER) AS word_count,
    md5(array_to_string(w[s + 1 : s + 120], ' ')) AS digest FROM f"""
ORACLES["H3_chunks"] = f"""WITH d AS (SELECT evid_id, {_PARAGRAPHS} AS ps FROM {_DOCS}), p AS (SELECT evid_id, len(ps) AS np, i, {sql.words('ps[i]')} AS w FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM d)),
    e AS (SELECT *, len(w) AS n, coalesce(sum(len(w)) OVER (PARTITION BY evid_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM p), f AS ({_WINDOWS} FROM e)
    SELECT evid_id, CAST(row_number() OVER (PARTITION BY evid_id ORDER BY i, s) - 1 AS INTEGER) AS chunk_index, CAST(s + o AS INTEGER) AS start_word, CAST(least(n, s + 120) + o AS INTEGER) AS end_word,
    CAST(least(n, s + 120) - s AS INTEGER) AS word_count, CASE WHEN np > 1 AND n <= 120 THEN 'paragraph' ELSE 'sliding_window' END AS split_type, md5(array_to_string(w[s + 1 : s + 120], ' ')) AS digest FROM f"""

# ---- parsing ---------------------------------------------------------------------------------

_FENCE = r"""CASE WHEN regexp_extract(target, '(?s)```(?:json)?\s*(.*?)\s*```', 1) <> '' THEN regexp_extract(target, '(?s)```(?:json)?\s*(.*?)\s*```', 1) ELSE target END"""
_BODY = rf"regexp_extract({_FENCE}, '(?s)\{{.*\}}', 0)"
_OBJECT = f"CASE WHEN json_valid({_BODY}) AND {_BODY} <> '' THEN {_BODY} END"

scalar("A1_json_object", "sft_pairs", "pair_id", ["target"], lambda: parse.json_object("target"), _OBJECT)
scalar("A4_agent_action", "sft_pairs", "pair_id", ["target"], lambda: parse.agent_action("target"),
       f"CASE WHEN lower(trim(json_extract_string({_OBJECT}, '$.action'), ' ')) IN ('commit', 'retrieve', 'refine', 'decompose') THEN lower(trim(json_extract_string({_OBJECT}, '$.action'), ' ')) ELSE 'retrieve' END")
scalar("A5_single_turn_action", "sft_pairs", "pair_id", ["target"], lambda: parse.agent_action("target", ("commit", "retrieve")),
       f"CASE WHEN lower(trim(json_extract_string({_OBJECT}, '$.action'), ' ')) = 'commit' THEN 'commit' ELSE 'retrieve' END")
scalar("A7_policy_choice", "agent_turns", "turn_id", ["action"], lambda: parse.policy_choice("action.raw_text"), None)
scalar("A9_strict_action", "sft_pairs", "pair_id", ["target"], lambda: parse.strict_action("target"), """
    coalesce(TGT IS NOT NULL AND json_type(TGT) = 'OBJECT'
    AND len(list_filter(json_keys(TGT), lambda k: k NOT IN ('action', 'query', 'analysis', 'reason', 'answer'))) = 0
    AND json_extract_string(TGT, '$.action') IN ('commit', 'retrieve', 'refine', 'decompose') AND length(json_extract_string(TGT, '$.analysis')) >= 20
    AND length(json_extract_string(TGT, '$.reason')) >= 10
    AND (NOT list_contains(json_keys(TGT), 'query') OR length(json_extract_string(TGT, '$.query')) >= 5)
    AND (NOT list_contains(json_keys(TGT), 'answer') OR length(json_extract_string(TGT, '$.answer')) >= 1)
    AND (json_extract_string(TGT, '$.action') <> 'commit' OR length(json_extract_string(TGT, '$.answer')) >= 1)
    AND (json_extract_string(TGT, '$.action') <> 'retrieve' OR length(json_extract_string(TGT, '$.query')) >= 5), false)""".replace("TGT", "(CASE WHEN json_valid(target) THEN target END)"))  # fmt: skip
_LAST = lambda xs: f"trim({xs}[-1], ' ')"
_COMMITS = r"""regexp_extract_all(coalesce(target, ''), '(?s)"action"\s*:\s*"commit".*?"answer"\s*:\s*"([^"]+)"', 1)"""
_FIELDS = r"""regexp_extract_all(coalesce(target, ''), '(?s)"answer"\s*:\s*"([^"]+)"', 1)"""
scalar("A10_final_answer", "sft_pairs", "pair_id", ["target"], lambda: parse.final_answer("target"),
       rf"coalesce({_LAST(_COMMITS)}, {_LAST(_FIELDS)}, trim(regexp_extract(coalesce(target, ''), '(?i)(?:final\s+answer|answer)\s*[:=]\s*([^\n]+)', 1), ' '))")
scalar("A11_boxed_answer", "trajectories", "result_id", ["pred_answer_raw"], lambda: parse.boxed_answer("pred_answer_raw"), None)
scalar("A13_short_answer", "trajectories", "result_id", ["pred_answer_raw"], lambda: parse.short_answer("pred_answer_raw"), None)
scalar("A14_shortened", "trajectories", "result_id", ["question", "pred_answer_raw"], lambda: text.shortened("question", "pred_answer_raw"), None)
scalar("A2_committed_action", "sft_pairs", "pair_id", ["target"], lambda: F.to_json(parse.committed_action("target")), None)
scalar("A6_react_action", "agent_turns", "turn_id", ["action"], lambda: F.to_json(parse.react_action("action.raw_text")), None)
scalar("A8_claims", "agent_turns", "turn_id", ["claims"], lambda: F.to_json(parse.claims_of(F.to_json("claims"))), None)
scalar("A12_lm_calls", "events", "event_id", ["props"], lambda: parse.lm_calls(F.replace("props", F.lit('"k"'), F.lit('"num_turns"'))), "coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 9)")
scalar("C21_verbal_confidence", "agent_turns", "turn_id", ["action"], lambda: parse.verbal_confidence("action.reason"),
       r"least(greatest(coalesce(TRY_CAST(nullif(regexp_extract(coalesce(action.reason, ''), '\d+\.\d+|0|1', 0), '') AS DOUBLE), 0.5), 0.0), 1.0)")


def A25_asks_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-questions that ask what the turn before asked, by question."""
    rows = first_of_each(table(spark, sf_dir, "agent_turns", "turn_id", "run_id", "question_id", "turn", "subquestion"), "turn_id")
    from pyspark.sql.window import Window

    before = F.lag(text.signature("subquestion")).over(Window.partitionBy("run_id", "question_id", own_group("turn_id", "run_id", "question_id")).orderBy("turn", "turn_id"))
    return rows.select("turn_id", text.signature("subquestion").alias("s"), before.alias("b")).select("turn_id", F.coalesce(text.asks_again(F.col("s"), F.col("b")), F.lit(False)).alias("again"))


QUERIES["A25_asks_again"] = A25_asks_again
_STOP = ", ".join(f"'{w}'" for w in text.SIGNATURE_STOP_WORDS)
ORACLES["A25_asks_again"] = rf"""WITH t AS (SELECT turn_id, run_id, question_id, turn, list_distinct(list_filter({sql.official_words('subquestion')}, lambda w: w NOT IN ({_STOP}) AND NOT regexp_matches(w, '^\d+$'))) AS s
    FROM {sql.once('agent_turns', 'turn_id', 'run_id', 'question_id', 'turn', 'subquestion')}), l AS (SELECT *, lag(s) OVER (PARTITION BY run_id, question_id, CASE WHEN run_id IS NULL OR question_id IS NULL THEN turn_id END ORDER BY turn NULLS FIRST, turn_id) AS b FROM t),
    m AS (SELECT *, len(list_intersect(s, b)) AS c, least(len(s), len(b)) AS k FROM l)
    SELECT turn_id, coalesce(k > 0 AND c / k >= 0.8 AND (c = len(s) OR c = len(b) OR len(s) + len(b) - 2 * c <= 1), false) AS again FROM m"""


# ---- hints and prompts -----------------------------------------------------------------------

from evidentia.functions import hints  # noqa: E402

scalar("A20_question_entities", "examples", "example_id", ["question"], lambda: F.to_json(hints.question_entities("question")), None)
_FORM = sql.official("question")


def _says(form: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({form}, '{p}')" if " " in p else f"contains(' ' || {form} || ' ', ' {p} ')" for p in phrases) + ")"


_OPERATORS = "list_filter([" + ", ".join(f"CASE WHEN {_says('f', cues)} THEN '{name}' END" for name, cues in hints.OPERATOR_CUES.items()) + "], lambda x: x IS NOT NULL)"
_FAMILIES = "list_filter([" + ", ".join(f"CASE WHEN list_has_any(o, ['{chr(39) + ', ' + chr(39)}']) THEN '{name}' END".replace("['', '']", str(list(ops))) for name, ops in hints.FAMILIES.items()) + "], lambda x: x IS NOT NULL)"


def A24_reasoning_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "trajectories", "result_id", "question")
    return rows.select(
        "result_id", F.array_join(hints.operator_hints("question"), ",").alias("operators"), F.array_join(hints.reasoning_hints("question"), ",").alias("families"), hints.needs_composition("question").alias("composed")
    )


QUERIES["A24_reasoning_hints"] = A24_reasoning_hints
_BRIDGE = " OR ".join(f"contains(f, '{c}')" for c in hints.BRIDGE_CUES)
ORACLES["A24_reasoning_hints"] = f"""WITH q AS (SELECT result_id, {_FORM} AS f FROM trajectories), o AS (SELECT *, {_OPERATORS} AS o FROM q), m AS (SELECT *, {_FAMILIES} AS m FROM o)
    SELECT result_id, array_to_string(o, ',') AS operators, CASE WHEN len(m) > 0 THEN array_to_string(m, ',') WHEN {_BRIDGE} THEN 'bridge_lookup' ELSE 'attribute_lookup' END AS families, len(m) > 0 AS composed FROM m"""


def A22_policy_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_of_each(table(spark, sf_dir, "agent_turns", "turn_id", "subquestion", "answer", "claims", "claim_supports"), "turn_id")
    d = hints.diagnostics(F.col("subquestion"), F.coalesce("answer", F.lit("")), F.col("claims"), F.col("claim_supports"))
    r6 = lambda c: F.round(c, 6)
    return rows.select("turn_id", d.alias("d")).select("turn_id", "d.kind_agrees", r6("d.entity_coverage").alias("entity_coverage"), "d.relevant_claims", r6("d.least_grounding").alias("least_grounding"), r6("d.mean_grounding").alias("mean_grounding"))


QUERIES["A22_policy_diagnostics"] = A22_policy_diagnostics


def A16_specific_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_of_each(table(spark, sf_dir, "agent_turns", "turn_id", "subquestion", "answer", "claims", "claim_supports"), "turn_id")
    return rows.select("turn_id", hints.more_specific(F.col("subquestion"), F.col("answer"), F.col("claims"), F.col("claim_supports"), F.lit("")).alias("span"))


QUERIES["A16_specific_spans"] = A16_specific_spans


def A29_signal_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_of_each(table(spark, sf_dir, "trajectories", "result_id", "question", "policy_trace"), "result_id")
    turns = rows.select("result_id", "question", F.posexplode("policy_trace").alias("pos", "e")).where("e.action = 'agent_turn'")
    return turns.select("result_id", "pos", hints.signal_message(F.col("question"), F.col("e.details")).alias("message"))


QUERIES["A29_signal_messages"] = A29_signal_messages


def A29_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight turns before each turn, as lines without telemetry."""
    from pyspark.sql.window import Window

    rows = first_of_each(table(spark, sf_dir, "agent_turns", "turn_id", "run_id", "question_id", "turn", "answer", "action"), "turn_id")
    before = Window.partitionBy("run_id", "question_id", own_group("turn_id", "run_id", "question_id")).orderBy("turn", "turn_id").rowsBetween(-8, -1)
    lines = F.collect_list(F.coalesce(hints.history_line(F.coalesce("turn", F.lit(-1)), F.col("action"), F.col("answer")), F.lit(""))).over(before)
    return rows.select("turn_id", F.when(F.size(lines) == 0, "(first turn)").otherwise(F.array_join(lines, "\n")).alias("history"))


QUERIES["A29_histories"] = A29_histories
