"""Queries of answer scores, grounding, confidence and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import calibration, confidence, scoring
from evidentia.plans import sql
from evidentia.session import first_of_each, table

RUNS = ("result_id", "run_id", "question_id", "question", "gold_answer", "pred_answer", "pred_answer_raw", "em", "f1", "nvc", "support")


def runs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return first_of_each(table(spark, sf_dir, "trajectories", "result_id", *columns), "result_id")


def turns(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return first_of_each(table(spark, sf_dir, "agent_turns", "turn_id", *columns), "turn_id")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir, "gold_answer", "pred_answer")


def r6(c):
    return F.round(c, 6)


def E1_exact_any(spark, sf_dir):
    return _answers(spark, sf_dir).select("result_id", scoring.exact_any(F.coalesce("pred_answer", F.lit("")), text.split_aliases("gold_answer")).alias("em"))


def E2_exact_official(spark, sf_dir):
    return _answers(spark, sf_dir).select("result_id", scoring.exact_official(F.col("pred_answer"), F.col("gold_answer")).alias("em"))


def E3_exact_alias(spark, sf_dir):
    return _answers(spark, sf_dir).select("result_id", scoring.exact_alias(F.col("pred_answer"), F.col("gold_answer")).alias("em"))


def F1a_any(spark, sf_dir):
    return _answers(spark, sf_dir).select("result_id", r6(scoring.f1_any(F.coalesce("pred_answer", F.lit("")), text.split_aliases("gold_answer"))).alias("f1"))


def F1b_official(spark, sf_dir):
    s = scoring.f1_official(F.coalesce("pred_answer", F.lit("")), F.coalesce("gold_answer", F.lit("")))
    return _answers(spark, sf_dir).select("result_id", s.alias("s")).select("result_id", r6("s.f1").alias("f1"), r6("s.precision").alias("precision"), r6("s.recall").alias("recall"))


def F1d_alias(spark, sf_dir):
    return _answers(spark, sf_dir).select("result_id", r6(scoring.f1_alias(F.coalesce("pred_answer", F.lit("")), F.col("gold_answer"))).alias("f1"))


def F1e_reward(spark, sf_dir):
    return _answers(spark, sf_dir).select("result_id", r6(scoring.f1_reward(F.col("pred_answer"), F.col("gold_answer"))).alias("f1"))


def F1f_no_floor(spark, sf_dir):
    return _answers(spark, sf_dir).select("result_id", r6(scoring.f1_reward(F.col("pred_answer"), F.col("gold_answer"), floor=False)).alias("f1"))


def E4_title_recall(spark, sf_dir):
    """Of the supporting titles, those among the first three of the context."""
    rows = table(spark, sf_dir, "examples", "example_id", "context", "supporting_facts")
    seen = F.slice(F.coalesce("context.title", F.array().cast("array<string>")), 1, 3)
    gold = F.filter(F.coalesce("supporting_facts.title", F.array().cast("array<string>")), lambda t: t.isNotNull())
    return rows.select("example_id", r6(scoring.title_recall(seen, gold)).alias("recall"))


def E5_grounding(spark, sf_dir):
    rows = runs(spark, sf_dir, "support").select("result_id", scoring.grounding(F.col("support.passage_support_matrix")).alias("g"))
    return rows.select("result_id", F.size("g.claim_supports").alias("claims"), r6("g.g_mean").alias("g_mean"), r6("g.g_min").alias("g_min"))


def E7_supported(spark, sf_dir):
    rows = runs(spark, sf_dir, "run_id", "support")
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(scoring.is_supported(F.col("support.g_mean"), F.col("support.g_min")), 1)).alias("supported"),
        F.count(F.when(scoring.has_weak_claim(F.col("support.claim_supports")), 1)).alias("weak"),
    )


_ONCE = sql.once("trajectories", "result_id", "gold_answer", "pred_answer")
_P, _G = "coalesce(pred_answer, '')", "coalesce(gold_answer, '')"
_BEST = lambda f, alias: f"SELECT result_id, round(coalesce(max({f}), 0.0), 6) AS f1 FROM (SELECT result_id, {alias} FROM r) GROUP BY result_id"
_PG = f"SELECT result_id, {sql.official_words(_P)} AS p, {sql.official_words(_G)} AS g FROM {_ONCE}"
_RW = f"SELECT result_id, {sql.reward_words('pred_answer')} AS p, {sql.reward_words('gold_answer')} AS g FROM {_ONCE}"
_EXPLODED = f"SELECT result_id, pred_answer, unnest(CASE WHEN len({sql.aliases('gold_answer')}) = 0 THEN [''] ELSE {sql.aliases('gold_answer')} END) AS alias FROM {_ONCE}"

ORACLES = {
    "E1_exact_any": f"SELECT result_id, CAST(coalesce(bool_or(alias <> '' AND {sql.trivia('alias')} = {sql.trivia('pred_answer')}), false) AS INTEGER) AS em FROM ({_EXPLODED}) GROUP BY 1",
    "E2_exact_official": f"SELECT result_id, CAST({sql.official('pred_answer')} = {sql.official('gold_answer')} AS INTEGER) AS em FROM {_ONCE}",
    "F1a_any": f"""WITH r AS (SELECT result_id, alias, {sql.words(sql.trivia('pred_answer'))} AS p, {sql.words(sql.trivia('alias'))} AS g FROM ({_EXPLODED}))
        SELECT result_id, round(CASE WHEN max(len(p)) = 0 THEN CASE WHEN max(alias) = '' THEN 1.0 ELSE 0.0 END ELSE coalesce(max({sql.f1('p', 'g')}), 0.0) END, 6) AS f1 FROM r GROUP BY result_id""",
    "F1b_official": f"""WITH r AS ({_PG}), s AS (SELECT *, {sql.overlap('p', 'g')} AS n FROM r) SELECT result_id,
        round(CASE WHEN len(p) = 0 OR len(g) = 0 THEN CAST(len(p) = 0 AND len(g) = 0 AS DOUBLE) ELSE {sql.f1('p', 'g')} END, 6) AS f1,
        round(CASE WHEN len(p) = 0 OR len(g) = 0 THEN 0.0 ELSE n / len(p) END, 6) AS precision, round(CASE WHEN len(p) = 0 OR len(g) = 0 THEN 0.0 ELSE n / len(g) END, 6) AS recall FROM s""",
    "F1d_alias": f"""WITH r AS (SELECT result_id, {sql.official_words("coalesce(pred_answer, '')")} AS p, {sql.official_words('alias')} AS g FROM ({_EXPLODED}))
        SELECT result_id, round(coalesce(max({sql.f1('p', 'g')}), 0.0), 6) AS f1 FROM r GROUP BY result_id""",
    "F1e_reward": f"WITH r AS ({_RW}) SELECT result_id, round(CASE WHEN len(p) < 2 AND len(g) >= 3 THEN 0.0 ELSE {sql.f1('p', 'g')} END, 6) AS f1 FROM r",
    "F1f_no_floor": f"WITH r AS ({_RW}) SELECT result_id, round({sql.f1('p', 'g')}, 6) AS f1 FROM r",
    "E4_title_recall": """SELECT example_id, round(len(list_intersect(list_distinct(coalesce(context.title, [])[1:3]), list_distinct(coalesce(supporting_facts.title, []))))
        / greatest(len(list_distinct(coalesce(supporting_facts.title, []))), 1), 6) AS recall FROM examples""",
    "E5_grounding": """WITH r AS (SELECT result_id, list_filter(list_transform(coalesce(support.passage_support_matrix, []), lambda x: list_max(x)), lambda x: x IS NOT NULL) AS c
        FROM (SELECT result_id, any_value(support) AS support FROM trajectories GROUP BY result_id))
        SELECT result_id, CAST(len(c) AS INTEGER) AS claims, round(CASE WHEN len(c) = 0 THEN 0.0 ELSE list_sum(c) / len(c) END, 6) AS g_mean, round(CASE WHEN len(c) = 0 THEN 0.0 ELSE list_min(c) END, 6) AS g_min FROM r""",
    "E7_supported": """SELECT run_id, count(*) AS n, count(CASE WHEN support.g_mean >= 0.7 AND support.g_min >= 0.5 THEN 1 END) AS supported,
        count(CASE WHEN len(list_filter(support.claim_supports, lambda s: s < 0.5)) > 0 THEN 1 END) AS weak
        FROM (SELECT result_id, any_value(run_id) AS run_id, any_value(support) AS support FROM trajectories GROUP BY result_id) GROUP BY run_id""",
}

# ---- confidence ------------------------------------------------------------------------------


def C1_distinct_candidates(spark, sf_dir):
    rows = turns(spark, sf_dir, "question_id", "answer", "nvc").where("question_id IS NOT NULL AND answer IS NOT NULL").withColumn("s", F.coalesce(F.nanvl("nvc", F.lit(None).cast("double")), F.lit(-1.0)))
    kept = confidence.distinct_candidates(rows, "question_id", "answer", "s", "turn_id")
    return kept.select("question_id", "turn_id", "clean")


def C3_greedy_first(spark, sf_dir):
    rows = turns(spark, sf_dir, "question_id", "turn", "answer").where("question_id IS NOT NULL AND answer IS NOT NULL").withColumn("greedy", F.coalesce(F.col("turn") == 0, F.lit(False)))
    return confidence.greedy_first(rows, "question_id", "answer", "greedy", "turn_id").select("question_id", F.col("place").cast("bigint").alias("place"), "turn_id")


def C4_ptrue(spark, sf_dir):
    """Yes and no masses stand in the claim supports, the first and the rest."""
    s = F.filter(F.coalesce("claim_supports", F.array().cast("array<double>")), lambda x: x.isNotNull() & ~F.isnan(x))
    logs = lambda part: F.transform(part, lambda x: F.log(F.greatest(x, F.lit(1e-6)) / 2))
    rows = turns(spark, sf_dir, "claim_supports")
    return rows.select("turn_id", r6(confidence.ptrue(logs(F.slice(s, 1, 1)), logs(F.slice(s, 2, 9)))).alias("ptrue"))


def _nli(spark, sf_dir):
    """Candidates and entailments from blocks of five vectors: the cosine's positive and negative parts."""
    from evidentia.operators.retrieval import cosine

    v = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(F.expr("vec_id div 5").alias("ex"), F.expr("CAST(vec_id % 5 AS INT)").alias("j"), "vec_id", "embedding")
    candidates = v.select("ex", "j", (F.pmod(F.col("vec_id") * 37, F.lit(100)) / 100.0).alias("ptrue"))
    a, b = v.select("ex", F.col("j").alias("i"), F.col("embedding").alias("_a")), v.select("ex", "j", F.col("embedding").alias("_b"))
    pairs = a.join(b, "ex").where("i <> j").select("ex", "i", "j", cosine(F.col("_a"), F.col("_b")).alias("c"))
    # A direction of its own: an entailment fades with the distance in the block.
    fade = 1.0 - (F.col("i") - F.col("j")) / 20.0
    return candidates, pairs.select("ex", "i", "j", (F.greatest(F.col("c"), F.lit(0.0)) * fade).alias("entail"), (F.greatest(-F.col("c"), F.lit(0.0)) * fade).alias("contra"))


def C8_nvc(spark, sf_dir):
    return confidence.nvc(*_nli(spark, sf_dir)).select("ex", r6("nvc").alias("nvc"))


def C10_nvc_wide(spark, sf_dir):
    return confidence.nvc(*_nli(spark, sf_dir), eps=1e-6).select("ex", r6("nvc").alias("nvc"))


def C13_self_consistency(spark, sf_dir):
    rows = turns(spark, sf_dir, "claim_supports", "nvc")
    s = F.filter(F.coalesce("claim_supports", F.array().cast("array<double>")), lambda x: x.isNotNull() & ~F.isnan(x))
    n = F.nanvl("nvc", F.lit(None).cast("double"))
    sc = confidence.self_consistency(s)
    return rows.select("turn_id", r6(sc).alias("sc_conf"), r6(confidence.blend(n, sc)).alias("dinco"))


def C16_agreement(spark, sf_dir):
    rows = turns(spark, sf_dir, "question_id", "turn", "answer").where("question_id IS NOT NULL").withColumn("greedy", F.coalesce(F.col("turn") == 0, F.lit(False)))
    out = confidence.agreement(rows, "question_id", "answer", "greedy")
    return out.select("question_id", r6("agreement_rate").alias("agreement_rate"), "n_distractors", "degenerate")


def C24_combined_prior(spark, sf_dir):
    num = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    return turns(spark, sf_dir, "nvc", "g_mean").select("turn_id", r6(confidence.combined_prior(num("nvc"), num("g_mean"))).alias("prior"))


_TURN = lambda *c: sql.once("agent_turns", "turn_id", *c)
_NUM = lambda c: f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"
_SUPPORTS = "list_filter(coalesce(claim_supports, []), lambda x: x IS NOT NULL AND NOT isnan(x))"
_NVC = """WITH v AS (SELECT vec_id // 5 AS ex, vec_id % 5 AS j, vec_id, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT ex, j, ((vec_id * 37) % 100) / 100.0 AS p FROM v),
    n0 AS (SELECT a.ex, a.j AS i, b.j AS j, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS c FROM v a JOIN v b ON a.ex = b.ex AND a.j <> b.j),
    n AS (SELECT ex, i, j, greatest(c, 0.0) * (1.0 - (i - j) / 20.0) AS e, greatest(-c, 0.0) * (1.0 - (i - j) / 20.0) AS k FROM n0),
    s AS (SELECT x.ex, x.i, x.j, x.e, (x.k + y.k) / 2 AS k FROM n x JOIN n y ON x.ex = y.ex AND x.i = y.j AND x.j = y.i),
    g AS (SELECT ex, j, 1.0 + sum(greatest(0.0, e)) AS deg FROM s GROUP BY ALL),
    t AS (SELECT c.ex, sum(c.p * s.k / (g.deg - s.e + {eps})) AS added FROM c JOIN s ON s.ex = c.ex AND s.j = c.j AND s.i = 0 JOIN g ON g.ex = c.ex AND g.j = c.j WHERE c.j > 0 GROUP BY c.ex)
    SELECT c.ex, round(CASE WHEN p + coalesce(added, 0) > 1 THEN p / (p + coalesce(added, 0)) ELSE p END, 6) AS nvc FROM c LEFT JOIN t USING (ex) WHERE c.j = 0"""
ORACLES |= {
    "C1_distinct_candidates": f"""WITH t AS (SELECT *, {sql.first_line('answer')} AS clean FROM {_TURN('question_id', 'answer', 'nvc')} WHERE question_id IS NOT NULL AND answer IS NOT NULL)
        SELECT question_id, turn_id, clean FROM t WHERE clean <> '' QUALIFY row_number() OVER (PARTITION BY question_id, replace(lower(clean), '.', '') ORDER BY coalesce({_NUM('nvc')}, -1.0) DESC, turn_id) = 1""",
    "C3_greedy_first": f"""WITH t AS (SELECT *, {sql.official(sql.first_line('answer'))} AS k, coalesce(turn = 0, false) AS g FROM {_TURN('question_id', 'turn', 'answer')} WHERE question_id IS NOT NULL AND answer IS NOT NULL),
        d AS (SELECT * FROM t WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY question_id, k ORDER BY g DESC, turn_id) = 1)
        SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY g DESC, turn_id) - 1 AS place, turn_id FROM d""",
    "C4_ptrue": f"""WITH t AS (SELECT turn_id, list_transform({_SUPPORTS}, lambda x: greatest(x, 1e-6) / 2) AS s FROM (SELECT turn_id, any_value(claim_supports) AS claim_supports FROM agent_turns GROUP BY 1)),
        m AS (SELECT turn_id, coalesce(list_sum(s[1:1]), 0.0) AS y, coalesce(list_sum(s[2:10]), 0.0) AS n FROM t) SELECT turn_id, round(CASE WHEN y + n < 0.5 THEN NULL ELSE y / (y + n) END, 6) AS ptrue FROM m""",
    "C8_nvc": _NVC.format(eps="1e-9"),
    "C10_nvc_wide": _NVC.format(eps="1e-6"),
    "C13_self_consistency": f"""WITH t AS (SELECT turn_id, {_SUPPORTS} AS s, nvc FROM (SELECT turn_id, any_value(claim_supports) AS claim_supports, any_value(nvc) AS nvc FROM agent_turns GROUP BY 1)),
        u AS (SELECT turn_id, (len(list_filter(s, lambda x: x > 0.9)) + 1) / (len(s) + 1) AS sc, {_NUM('nvc')} AS nvc FROM t) SELECT turn_id, round(sc, 6) AS sc_conf, round((nvc + sc) / 2, 6) AS dinco FROM u""",
    "C16_agreement": f"""WITH t AS (SELECT question_id, {sql.official(sql.first_line('answer'))} AS k, coalesce(turn = 0, false) AS g FROM {_TURN('question_id', 'turn', 'answer')} WHERE question_id IS NOT NULL),
        g AS (SELECT question_id, min(k) AS gk FROM t WHERE g GROUP BY 1), j AS (SELECT g.question_id, gk, t.k FROM g LEFT JOIN t ON t.question_id = g.question_id AND NOT t.g)
        SELECT question_id, round(coalesce(avg(CAST(k = gk AS DOUBLE)), 1.0), 6) AS agreement_rate, count(DISTINCT CASE WHEN k <> gk AND k <> '' THEN k END) AS n_distractors,
        count(DISTINCT CASE WHEN k <> gk AND k <> '' THEN k END) = 0 AS degenerate FROM j GROUP BY question_id""",
    "C24_combined_prior": f"SELECT turn_id, round(0.6 * {_NUM('nvc')} + 0.4 * {_NUM('g_mean')}, 6) AS prior FROM (SELECT turn_id, any_value(nvc) AS nvc, any_value(g_mean) AS g_mean FROM agent_turns GROUP BY 1)",
}

# ---- calibration -----------------------------------------------------------------------------


def _calibration_rows(spark, sf_dir):
    return calibration.usable(runs(spark, sf_dir, "run_id", "em", "nvc"), "em", "nvc", "result_id", "run_id")


def M2_ece(spark, sf_dir):
    return calibration.ece(_calibration_rows(spark, sf_dir), ["run_id"], "result_id").select("run_id", r6("ece").alias("ece"))


def M3_brier(spark, sf_dir):
    return _calibration_rows(spark, sf_dir).groupBy("run_id").agg(r6(calibration.brier()).alias("brier"))


def M4_auroc(spark, sf_dir):
    return calibration.auroc(_calibration_rows(spark, sf_dir), ["run_id"]).select("run_id", r6("auroc").alias("auroc"))


def M5_saturation(spark, sf_dir):
    rows = runs(spark, sf_dir, "run_id", "nvc").where("nvc IS NOT NULL AND NOT isnan(nvc)")
    return rows.groupBy("run_id").agg(r6(calibration.saturation("nvc")).alias("saturation"))


def M6_separation(spark, sf_dir):
    rows = _calibration_rows(spark, sf_dir).groupBy("run_id").agg(*calibration.separation())
    return rows.select("run_id", r6("mean_correct").alias("mean_correct"), r6("mean_incorrect").alias("mean_incorrect"), r6("gap").alias("gap"), "n_correct", "n_incorrect")


def M7_all_measures(spark, sf_dir):
    rows = calibration.all_measures(_calibration_rows(spark, sf_dir), ["run_id"], "result_id")
    return rows.select("run_id", "n", r6("ece").alias("ece"), r6("brier").alias("brier"), r6("auroc").alias("auroc"), r6("saturation").alias("saturation"), r6("gap").alias("gap"))


_CAL = """c AS (SELECT result_id, run_id, CAST(em AS DOUBLE) AS s, least(greatest(nvc, 0.0), 1.0) AS p FROM (SELECT result_id, any_value(run_id) AS run_id, any_value(em) AS em, any_value(nvc) AS nvc FROM trajectories GROUP BY 1)
    WHERE em IS NOT NULL AND nvc IS NOT NULL AND NOT isnan(nvc))"""
_ECE = """r AS (SELECT run_id, s, p, row_number() OVER (PARTITION BY run_id ORDER BY p, result_id) - 1 AS r, count(*) OVER (PARTITION BY run_id) AS n FROM c),
    b AS (SELECT r.*, bin FROM r JOIN (SELECT unnest(range(0, 15)) AS bin) k ON CAST(round_even(bin * n / 15.0, 0) AS BIGINT) <= r.r AND r.r < CAST(round_even((bin + 1) * n / 15.0, 0) AS BIGINT)),
    e AS (SELECT run_id, sum(m / n * abs(ms - mp)) AS ece FROM (SELECT run_id, bin, n, count(*) AS m, avg(s) AS ms, avg(p) AS mp FROM b GROUP BY ALL) GROUP BY run_id)"""
_AUC = """k AS (SELECT run_id, s, rank() OVER (PARTITION BY run_id ORDER BY p) + (count(*) OVER (PARTITION BY run_id, p) - 1) / 2.0 AS r FROM c),
    a AS (SELECT run_id, CASE WHEN sum(s) > 0 AND count(*) > sum(s) THEN (sum(r * s) - sum(s) * (sum(s) + 1) / 2) / (sum(s) * (count(*) - sum(s))) END AS auroc FROM k GROUP BY run_id)"""
ORACLES |= {
    "M2_ece": f"WITH {_CAL}, {_ECE} SELECT run_id, round(ece, 6) AS ece FROM e",
    "M3_brier": f"WITH {_CAL} SELECT run_id, round(avg((s - p) * (s - p)), 6) AS brier FROM c GROUP BY 1",
    "M4_auroc": f"WITH {_CAL}, {_AUC} SELECT run_id, round(auroc, 6) AS auroc FROM a",
    "M5_saturation": "SELECT run_id, round(avg(CAST(nvc >= 0.95 AS DOUBLE)), 6) AS saturation FROM (SELECT result_id, any_value(run_id) AS run_id, any_value(nvc) AS nvc FROM trajectories GROUP BY 1) WHERE nvc IS NOT NULL AND NOT isnan(nvc) GROUP BY 1",
    "M6_separation": f"""WITH {_CAL} SELECT run_id, round(avg(p) FILTER (s = 1), 6) AS mean_correct, round(avg(p) FILTER (s = 0), 6) AS mean_incorrect, round(avg(p) FILTER (s = 1) - avg(p) FILTER (s = 0), 6) AS gap,
        count(*) FILTER (s = 1) AS n_correct, count(*) FILTER (s = 0) AS n_incorrect FROM c GROUP BY 1""",
    "M7_all_measures": f"""WITH {_CAL}, {_ECE}, {_AUC} SELECT c.run_id, count(*) AS n, round(any_value(ece), 6) AS ece, round(avg((s - p) * (s - p)), 6) AS brier, round(any_value(auroc), 6) AS auroc,
        round(avg(CAST(p >= 0.95 AS DOUBLE)), 6) AS saturation, round(avg(p) FILTER (s = 1) - avg(p) FILTER (s = 0), 6) AS gap FROM c LEFT JOIN e USING (run_id) LEFT JOIN a USING (run_id) GROUP BY 1""",
}
QUERIES = {name: fn for name, fn in list(globals().items()) if callable(fn) and name.split("_")[0].rstrip("abdef").strip() and (name in ORACLES or name == "E3_exact_alias")}
