"""Sub-question graphs: vertices (id, status, depth) and edges (id, dep)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions.text import asks_again, official_form, signature
from evidentia.session import durable


def sound_plan(nodes: DataFrame, by: str, node: str, text: str, deps: str, order: str, plans: DataFrame, question: str, cap: int = 4) -> DataFrame:
    """``by, node, text, deps``: of each plan the distinct sub-questions (the first of equals) up to the cap,
    without self or dangling dependencies; a plan of ``plans`` (``by, question``) of which none is
    left is its one question itself."""
    first = Window.partitionBy(by, "_key").orderBy(order)
    place = Window.partitionBy(by).orderBy(order)
    kept = nodes.withColumn("_key", official_form(text)).where("_key <> ''").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    kept = kept.withColumn("_m", F.row_number().over(place)).where(F.col("_m") <= cap).drop("_n", "_m", "_key")
    known = kept.groupBy(by).agg(F.collect_set(node).alias("_ids"))  # at most cap ids a plan
    sound = kept.join(known, by).select(by, node, text, F.filter(F.array_intersect(F.coalesce(deps, F.array().cast("array<string>")), "_ids"), lambda d: d != F.col(node)).alias(deps))
    bare = plans.join(known, by, "left_anti").select(by, F.lit("sg1").alias(node), F.col(question).alias(text), F.array().cast("array<string>").alias(deps))
    return sound.unionByName(bare)


def ready_nodes(nodes: DataFrame, edges: DataFrame, by: list[str], done: Column) -> DataFrame:
    """Pending nodes all of whose dependencies are done."""
    state = nodes.select(*by, F.col("id").alias("dep"), done.alias("_done"))
    waits = edges.join(state, [*by, "dep"], "left").groupBy(*by, "id").agg(F.bool_and(F.coalesce("_done", F.lit(False))).alias("_all"))
    return nodes.where(F.col("status") == "pending").join(waits, [*by, "id"], "left").where(F.coalesce("_all", F.lit(True))).drop("_all")


def next_node(ready: DataFrame, by: list[str]) -> DataFrame:
    """The ready node of the least depth, then id."""
    return ready.groupBy(*by).agg(F.min_by("id", F.struct("depth", "id")).alias("id"))


def closure(edges: DataFrame, by: list[str], rounds: int = 64) -> DataFrame:
    """All direct and indirect dependencies, by doubling paths until none is new."""
    reach = durable(edges.select(*by, "id", "dep").distinct())
    size = reach.count()
    for _ in range(rounds):
        step = reach.join(reach.select(*by, F.col("id").alias("dep"), F.col("dep").alias("_far")), [*by, "dep"])
        reach = durable(reach.unionByName(step.select(*by, "id", F.col("_far").alias("dep"))).distinct())
        grown = reach.count()
        if grown == size:
            break
        size = grown
    return reach


def broken_references(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Edges that name their own node, or one that is missing."""
    own = edges.where("id = dep").select(*by, "id", "dep", F.lit("self").alias("problem"))
    known = nodes.select(*by, F.col("id").alias("dep"))
    missing = edges.where("id <> dep").join(known, [*by, "dep"], "left_anti").select(*by, "id", "dep", F.lit("missing").alias("problem"))
    return own.unionByName(missing)


def execution_ranks(edges: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """Rank of each node: the number of nodes it waits for, directly or not, then its id."""
    waits = closure(edges, by).groupBy(*by, "id").agg(F.count(F.lit(1)).alias("waits"))
    ranked = nodes.select(*by, "id").join(waits, [*by, "id"], "left").withColumn("waits", F.coalesce("waits", F.lit(0)))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("waits", "id")) if by else F.lit(None).cast("int"))


def numbered_trace(events: Column, final_action: str = "finalize") -> Column:
    """Trace events numbered from 1, with a closing event."""
    closing = F.struct(F.size(events).cast("int") + 1, F.lit(final_action))
    numbered = F.transform(events, lambda e, i: F.struct((i + 1).cast("int").alias("step"), e.alias("action")))
    return F.concat(numbered, F.array(F.struct(closing["col1"].alias("step"), closing["col2"].alias("action"))))


def referenced_nodes(text: Column) -> Column:
    """Distinct placeholders of other nodes' answers in a sub-question."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(sg\d+(?:_[a-z0-9]+)*)\b"), F.lit(1)))


def clean_node_id(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9_]+", "_"), F.lit("_"))


def effective_question(resolved: Column, original: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(resolved), F.lit("")), original)


def resolved_question(question: Column, answers: Column) -> Column:
    """Placeholders of other nodes, bare or in brackets, replaced by their answers (``array<struct<id, answer>>``)."""
    out = F.aggregate(
        F.filter(F.coalesce(answers, F.array().cast("array<struct<id:string,answer:string>>")), lambda a: F.coalesce(a["answer"], F.lit("")) != ""),
        question,
        lambda text, a: F.call_function("array_join", F.split(text, F.concat(F.lit(r"[\[{<(]?\b"), a["id"], F.lit(r"\b[\]}>)]?"))), a["answer"]),
    )
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def unresolved(question: Column) -> Column:
    """Does a rewritten question still wait for another node?"""
    return F.size(referenced_nodes(question)) > 0


def accepted_children(children: DataFrame, parent: str, text: str, order: str, parents: DataFrame, most_depth: int = 2, most_nodes: int = 12) -> DataFrame:
    """Proposed children (``parent, text, order``) that may join the graph: the parent (``id, plan, depth,
    question``) may be split further, the child asks neither what its parent asks nor what an earlier
    sibling asks, and the plan's node count stays within its limit."""
    size = parents.groupBy("plan").agg(F.count(F.lit(1)).alias("_size"))
    known = children.join(parents.select(F.col("id").alias(parent), "plan", "depth", "question"), parent).join(size, "plan")
    mine, theirs = signature(F.col(text)), signature(F.col("question"))
    fresh = known.where((F.col("depth") < most_depth) & (official_form(text) != "") & ~asks_again(mine, theirs)).withColumn("_key", official_form(text))
    first = Window.partitionBy(parent, "_key").orderBy(order)
    place = Window.partitionBy("plan").orderBy(parent, order)
    one = fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("_m", F.row_number().over(place))
    return one.where((F.col("_m") <= most_nodes) & (F.col("_m") + F.col("_size") <= most_nodes)).select("plan", parent, text, (F.col("depth") + 1).alias("depth"), order)
