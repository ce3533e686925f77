"""Readers, writers, sampling, policies, graphs and streams on small tables."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from evidentia.functions import scorers
from evidentia.operators import aggregate, confidence, dag, policy, reshape, training
from evidentia.operators.chunking import chunk_rows
from evidentia.sources import readers, writers
from evidentia.streaming.resume import resume, windowed_counts


def test_json_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2}\nnot json\n{"a": 3}\n')
    got = readers.json_lines(spark, str(path), "a int", strict=False).orderBy("_source_line").collect()
    assert [(r._source_line, r.a) for r in got] == [(1, 1), (3, 2), (5, 3)]
    with pytest.raises(Exception):
        readers.json_lines(spark, str(path), "a int").collect()


def test_question_set(spark, tmp_path):
    path = tmp_path / "w.tsv"
    head = "\t".join(readers.REQUIRED_COLUMNS)
    path.write_text(head + '\nWho?\tA\tA\t"[""B"", ""A""]"\tS\tp\t"two\nlines"\t12\tx\n\tA\tA\t[]\tS\tp\tt\t1\t1\n')
    (row,) = readers.question_set_tsv(spark, str(path)).collect()
    assert (row.qid, row.gold_answer, row.sr_count, row.s_count, row.popularity_bucket, row.paper_tool_needed) == ("witqa_000000", "A|B", 12, 0, "10-49", True)
    path.write_text("a\tb\n1\t2\n")
    with pytest.raises(ValueError, match="output_question"):
        readers.question_set_tsv(spark, str(path))


def test_adapted_sets(spark, tmp_path):
    pair = {"_id": "x", "question": "q", "answer": "a", "context": [["T", ["s1", "s2"]], ["U", []]], "supporting_facts": [["T", 1]]}
    (tmp_path / "dev.json").write_text(json.dumps([pair]))
    (row,) = readers.examples(spark, "2WikiMultihop", str(tmp_path), "validation").collect()
    assert row.context.title == ["T", "U"] and row.context.sentences == [["s1", "s2"], []] and row.supporting_facts.sent_id == [1]
    para = {"id": "m", "question": "q", "answer": "a", "answer_aliases": ["b", ""], "paragraphs": [{"idx": 0, "title": "T", "paragraph_text": "p", "is_supporting": True}, {"idx": 1, "title": None}]}
    (tmp_path / "train.jsonl").write_text(json.dumps(para) + "\n")
    (row,) = readers.examples(spark, "MuSiQue", str(tmp_path), "train", example_id="m").collect()
    assert row.answer_aliases == ["a", "b"] and row.supporting_facts.title == ["T"] and row.context.sentences == [["p"], [""]]
    with pytest.raises(FileNotFoundError, match="available"):
        readers.split_table(spark, str(tmp_path), "nope")


def test_labels_and_ids(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"qid": "a", "tool_needed": true}\nbad\n{"qid": "a", "tool_needed": false}\n')
    assert [(r.qid, r.tool_needed) for r in readers.labels_last_wins(spark, str(tmp_path / "l.jsonl")).collect()] == [("a", False)]
    (tmp_path / "ids").write_text("c\n\na\nz\n")
    found, missing = readers.by_id_file(spark, spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), "id", str(tmp_path / "ids"))
    assert [r.id for r in found.collect()] == ["c", "a"] and [r.id for r in missing.collect()] == ["z"]
    assert readers.configured({"a": 1, "g": {"x": 1, "y": 2}}, {"g": {"x": 5}}) == {"a": 1, "g": {"x": 5, "y": 2}}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "é")], "id int, condition string, v string")
    assert writers.write_json_lines(df, str(tmp_path / "j")) == 2 and writers.append_json_lines(df, str(tmp_path / "j")) == 2
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    writers.overwrite_conditions(df, str(tmp_path / "c"))
    writers.overwrite_conditions(df.where("id = 2"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2
    assert writers.write_summary(df.where("id = 2"), str(tmp_path / "s.json"))["v"] == "é" and "\\u00e9" in (tmp_path / "s.json").read_text()
    assert writers.subset_stem("trivia", "rc wiki", "train", 7, None) == "trivia_rc-wiki_train_s7_all" and writers.usable_limit(0) is None


def test_sampling(spark):
    rows = spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("s"))
    got = reshape.stratified(rows, F.col("s"), {"0": 5, "1": 99, "9": 3}, "id", 1)
    assert {r.stratum: r["count"] for r in got.groupBy("stratum").count().collect()} == {"0": 5, "1": 33}
    held = reshape.held_out_sample(rows, got, F.col("s"), {"0": 5}, "id", 1)
    assert held.count() == 5 and held.join(got, "id").count() == 0
    assert reshape.equal_buckets(rows, F.col("s"), ("0", "1", "2"), 10, "id", 1).select("id").distinct().count() == 10
    assert reshape.swap_answers(spark.createDataFrame([(1, "A"), (2, "a "), (3, "b"), (4, None)], "id int, x string"), "id", "x").orderBy("id").collect() == [
        Row(id=1, x="A", swapped="b"), Row(id=2, x="a ", swapped="b"), Row(id=3, x="b", swapped="A"),
    ]


def test_required_fields(spark):
    rows = spark.createDataFrame([("a", 0), ("", 1)], "q string, n int")
    assert reshape.require_fields(rows.where("q <> ''"), "q", "n").count() == 1
    with pytest.raises(Exception, match="missing: q"):
        reshape.require_fields(rows, "q", "n").collect()
    with pytest.raises(ValueError, match="coverage"):
        aggregate.require_coverage(rows, 0.85, "q")


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=4), st.integers(1, 130), st.integers(0, 140))
def test_chunks_cover_every_word(spark, sizes, most, shared):
    text = "\n\n".join(" ".join(f"w{i}" for i in range(n)) for n in sizes)
    rows = chunk_rows(spark.createDataFrame([(1, text)], "id int, t string"), "t", "id", most=most, shared=shared).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert all(0 < r.word_count <= most and r.end_word - r.start_word == r.word_count == len(r.text.split()) for r in rows)
    assert {i for r in rows for i in range(r.start_word, r.end_word)} == set(range(sum(sizes)))


def test_graphs(spark):
    nodes = spark.createDataFrame([("a", "done", 0), ("b", "pending", 1), ("c", "pending", 0), ("d", "pending", 1)], "id string, status string, depth int")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "d"), ("d", "x")], "id string, dep string")
    ready = dag.ready_nodes(nodes, edges, [], F.col("status") == "done")
    assert [r.id for r in ready.collect()] == ["b"] and dag.next_node(ready, []).first().id == "b"
    assert {tuple(r) for r in dag.closure(edges.where("id <> 'd'"), []).collect()} == {("b", "a"), ("c", "b"), ("c", "a")}
    assert {tuple(r) for r in dag.broken_references(nodes, edges, []).collect()} == {("d", "d", "self"), ("d", "x", "missing")}
    plan = spark.createDataFrame([("p", "1", "Who?", ["1", "2", "9"], 0), ("p", "2", "who", [], 1), ("p", "3", "Why?", ["1"], 2)], "p string, id string, q string, deps array<string>, o int")
    asked = spark.createDataFrame([("p", "All?"), ("none", "Alone?")], "p string, asked string")
    sound = dag.sound_plan(plan, "p", "id", "q", "deps", "o", asked, "asked").collect()
    assert {(r.p, r.id, r.q): r.deps for r in sound} == {("p", "1", "Who?"): [], ("p", "3", "Why?"): ["1"], ("none", "sg1", "Alone?"): []}
    many = spark.createDataFrame([("p", f"n{i}", f"Q{i}?", [f"n{i + 1}", f"n{i - 1}"], i) for i in range(6)], plan.schema)
    assert {r.id: r.deps for r in dag.sound_plan(many, "p", "id", "q", "deps", "o", asked.where("p = 'p'"), "asked").collect()} == {"n0": ["n1"], "n1": ["n2", "n0"], "n2": ["n3", "n1"], "n3": ["n2"]}
    one = spark.range(1).select(dag.clean_node_id(F.lit(" SG-1! ")).alias("i"), dag.referenced_nodes(F.lit("is {sg1} or sg2_a or sg1?")).alias("r"), dag.effective_question(F.lit(" "), F.lit("q")).alias("e")).first()
    assert (one.i, one.r, one.e) == ("sg_1", ["sg1", "sg2_a"], "q")


def test_agent_loop(spark):
    def plan(key, history):
        if key == "a":
            return {"action": "commit", "answer": "" if len(history) < 2 else "x"}
        return {"action": "retrieve"} if key == "b" else {"action": "decompose"}

    got = policy.run_agent(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), "k", plan, 3).orderBy("k", "turn").collect()
    assert [(r.k, r.turn, r.action) for r in got] == [("a", 0, "retrieve"), ("a", 1, "retrieve"), ("a", 2, "commit"), ("b", 0, "retrieve"), ("b", 1, "retrieve"), ("b", 2, "retrieve"), ("c", 0, "decompose")]


def test_agent_loop_guards(spark):
    one = spark.createDataFrame([("a",)], "k string")
    acts = lambda plan, **more: [r.action for r in policy.run_agent(one, "k", plan, 3, **more).orderBy("turn").collect()]
    assert acts(lambda k, h: {"action": "refine"}) == ["retrieve", "refine", "refine"]
    assert acts(lambda k, h: {"action": "refine"}, retrieve=lambda k, step: 0) == ["retrieve"] * 3
    assert acts(lambda k, h: {"action": "commit", "answer": "The insufficient evidence."}) == ["retrieve", "retrieve", "commit"]
    long = lambda k, h: {"action": "decompose" if len(h) > 1 else "retrieve", "answer": "x" * 400}
    assert acts(long) == ["retrieve", "retrieve", "decompose"] and acts(long, most_tokens=50) == ["retrieve"] * 3


def test_exhausted_and_guarded_actions(spark):
    rows = [(True, 0.1, "Paris", "commit"), (True, 0.99, " ", "decompose"), (False, 0.95, "Insufficient evidence.", "decompose"), (False, 0.95, "Rome", "commit"), (False, 0.89, "Rome", "decompose"), (None, None, "Rome", "decompose"), (True, None, None, "decompose")]
    df = spark.createDataFrame(rows, "s boolean, c double, a string, want string")
    got = df.select(policy.exhausted_action(F.col("s"), F.col("c"), F.col("a")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
    acts = spark.createDataFrame([("commit", "Insufficient, evidence!", False, True, "retrieve"), ("commit", "", True, True, "commit"), ("refine", "x", False, False, "retrieve"), ("refine", "x", True, True, "refine"), ("decompose", "", False, False, "decompose")], "t string, a string, last boolean, hits boolean, want string")
    got = acts.select(policy.guarded_action(F.col("t"), F.col("a"), F.col("last"), F.col("hits")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_scorers(spark):
    scorers.register("model", scorers.model_scorer(lambda: lambda ps, hs: [float(h in p) for p, h in zip(ps, hs)]))
    row = spark.createDataFrame([("a b c", "b c")], "p string, h string").select(scorers.scorer("model")(F.col("p"), F.col("h")).alias("m"), scorers.scorer("coverage")(F.col("p"), F.col("h")).alias("c")).first()
    assert (row.m, row.c) == (1.0, 1.0)
    with pytest.raises(KeyError, match="coverage"):
        scorers.scorer("none")


def test_distractors(spark):
    rows = [(1, "Old Mill", 0), (1, "the old mill", 1), (1, "river bank", 2), (1, "river bank and the bridge", 3), (1, "river bank river bank", 4), (1, "bridge", 5), (2, "alone", 0), (3, "x", 0), (3, "quay", 1)]
    df = spark.createDataFrame(rows, "ex int, t string, place int")
    got = confidence.semantic_distractors(df, "ex", "t", "place", scorers.scorer("coverage")).orderBy("ex", "place").collect()
    # 1 says what the answer says; 4 has the vector of 2; 3 entails 2 and 5, but not the other way round
    assert [(r.ex, r.t) for r in got] == [(1, "river bank"), (1, "river bank and the bridge"), (1, "bridge"), (3, "quay")]
    never = lambda p, h: F.lit(0.0)
    assert [r.place for r in confidence.semantic_distractors(df.where("ex = 1"), "ex", "t", "place", never).orderBy("place").collect()] == [1, 2, 3, 5]
    assert confidence.semantic_distractors(df.limit(0), "ex", "t", "place", never).count() == 0
    beams = df.withColumn("e", F.when(F.col("place") == 2, 0.9).otherwise(0.1))
    assert confidence.shortest_equal_beam(beams, "ex", "t", "e").first().t == "river bank"



def test_pareto_keeps_one(spark):
    rows = spark.createDataFrame([(1, 0.5, 3)], "id int, f double, c int")
    assert [r.id for r in training.pareto_quartile(rows, "id", F.col("f"), F.col("c")).collect()] == [1]


def test_resumed_stream(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    spark.createDataFrame([(1,), (2,)], "id int").write.parquet(src)
    for _ in range(2):
        resume(spark, src, "id int", lambda df: df.withColumn("x", F.col("id") * 2), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([(3,)], "id int").write.mode("append").parquet(src)
    resume(spark, src, "id int", lambda df: df.withColumn("x", F.col("id") * 2), out, mark).awaitTermination()
    assert sorted(r.x for r in spark.read.parquet(out).collect()) == [2, 4, 6]


def test_windowed_stream(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS k, 1.0D AS v UNION ALL SELECT timestamp'2024-01-01 00:20:00', 'a', 3.0D").write.parquet(src)
    stream = windowed_counts(spark.readStream.schema("ts timestamp, k string, v double").parquet(src), "ts", "k", "v")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windowed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert [(r.n, r.mean) for r in spark.sql("SELECT * FROM windowed").collect()] == [(2, 2.0)]


def test_padded_strata(spark):
    rows = spark.range(200).select("id", F.when(F.col("id") < 150, "a").otherwise("b").alias("s"), (F.col("id") % 50 == 0).alias("rare"))
    got = reshape.padded_strata(rows, ["s"], 40, {"rare": (F.col("rare"), 3)}, "id", 5)
    counts = {r.s: r["count"] for r in got.groupBy("s").count().collect()}
    assert got.count() == 40 and got.where("rare").count() >= 3 and 26 <= counts["a"] <= 34


def test_rewritten_questions(spark):
    df = spark.createDataFrame([("Where did {sg1} live with sg2_a?", [("sg1", "Ann $1"), ("sg2_a", None)]), ("x", None)], "q string, a array<struct<id:string,answer:string>>")
    got = df.select(dag.resolved_question(F.col("q"), F.col("a")).alias("q"), dag.unresolved(dag.resolved_question(F.col("q"), F.col("a"))).alias("u")).collect()
    assert [(r.q, r.u) for r in got] == [("Where did Ann $1 live with sg2_a?", True), ("x", False)]


def test_accepted_children(spark):
    parents = spark.createDataFrame([("n1", "p", 0, "Who founded the old mill in Rome?"), ("n2", "p", 2, "When?")], "id string, plan string, depth int, question string")
    children = spark.createDataFrame([("n1", "Who founded the mill in Rome?", 0), ("n1", "Which river turns it?", 1), ("n1", "which river turns it", 2), ("n1", "When was it built?", 3), ("n2", "Too deep?", 4)], "parent string, q string, o int")
    got = dag.accepted_children(children, "parent", "q", "o", parents, most_nodes=3).collect()
    assert [(r.q, r.depth) for r in got] == [("Which river turns it?", 1)]


def test_second_pass_and_error_rows(spark):
    rows = spark.createDataFrame([(1, 0.2), (2, 0.9), (3, None)], "id int, s double")
    got = policy.second_pass(rows, F.col("s") < 0.5, lambda df: df.withColumn("s", F.lit(0.7)))
    assert {r.id: r.s for r in got.collect()} == {1: 0.7, 2: 0.9, 3: None}
    tried = policy.with_error_rows(spark.createDataFrame([(1, "5"), (2, "x")], "id int, v string"), "id", lambda v: int(v) * 2, "v", attempts=2).orderBy("id").collect()
    assert [(r.result, r.error_type) for r in tried] == [("10", None), (None, "ValueError")]


def test_specific_spans():
    from evidentia.functions.hints import specific_span

    units = [("For all of the years before the war he lived in Greenwich Village, New York City, with friends", 0.8), ("New York City is big", 0.9)]
    assert specific_span("New York City", units, True) == "Greenwich Village, New York City"
    assert specific_span("Paris", units, True) is None and specific_span("", units, True) is None


def test_question_entities(spark):
    from evidentia.functions import hints

    say = lambda q: spark.range(1).select(hints.question_entities(F.lit(q)).alias("e")).first().e
    assert say("Which film by Ann Lee and Bob Ray won the Prize of Rome?") == ["Ann Lee", "Bob Ray", "Prize of Rome"]
    assert say("Who made Kiss and Tell?") == ["Kiss and Tell"] and say("who?") == []
    row = spark.range(1).select(hints.operator_hints(F.lit("Who is older, A or B?")).alias("o"), hints.reasoning_hints(F.lit("Who is older, A or B?")).alias("r")).first()
    assert row.o == ["older_younger"] and row.r == ["comparison"]


def test_global_order_keeps_every_place(spark):
    from evidentia.session import global_order

    rows = spark.range(5000).select("id", (F.col("id") % 7).alias("k"))
    got = global_order(rows, F.col("k").desc(), "id").orderBy("position").collect()
    assert [r.position for r in got] == list(range(5000)) and [(-r.k, r.id) for r in got] == sorted((-r.k, r.id) for r in got)


def test_schemas(spark):
    from evidentia import schemas

    for name in schemas.SCHEMAS:
        if name != "trace":
            assert len(schemas.schema(name)) > 0
    assert schemas.require(spark.createDataFrame([], schemas.schema("edge")), "edge").count() == 0
    with pytest.raises(ValueError, match="dep"):
        schemas.require(spark.range(1), "edge")


def test_index_probe_and_empty_searches(spark):
    from evidentia.operators.retrieval import Bm25Index

    docs = spark.createDataFrame([(1, "g", "old mill"), (2, "g", "new mill")], "doc int, g string, t string")
    index = Bm25Index(docs, "doc", "t", "g")
    ask = spark.createDataFrame([("a", "g", "mill"), ("b", "other", "mill")], "query string, g string, t string")
    index.probe(ask, "query", "t")
    assert index.search(ask, "query", "t", 0, "g").count() == 0
    assert {r.query for r in index.search(ask, "query", "t", 5, "g").collect()} == {"a"}
    with pytest.raises(ValueError, match="finds nothing"):
        index.probe(ask.withColumn("t", F.lit("zebra")), "query", "t")
