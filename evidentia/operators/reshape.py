"""Adapting records, flattening documents, sampling and control rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions.text import official_form, words
from evidentia.operators.chunking import chunk_rows

# Fixed value: the size of a chunk and what it shares with the one before.
CHUNK, SHARED = 120, 40


def records_of(columns: dict[str, Column]) -> Column:
    """A struct of lists as a list of structs, as long as the longest list, short ones filled with nulls."""
    return F.arrays_zip(*[c.alias(name) for name, c in columns.items()])


def pairs_to_columns(pairs: Column) -> Column:
    """``[[title, [sentence]]]`` as JSON text to ``struct<title, sentences>``."""
    rows = F.from_json(pairs, "array<string>")
    parts = F.transform(rows, lambda r: F.from_json(r, "array<string>"))
    return F.struct(
        F.transform(parts, lambda p: F.get(p, F.lit(0))).alias("title"),
        F.transform(parts, lambda p: F.from_json(F.get(p, F.lit(1)), "array<string>")).alias("sentences"),
    )


def from_paragraphs(df: DataFrame) -> DataFrame:
    """Paragraph records to context and supporting facts, the answer first among its aliases."""
    p = F.coalesce("paragraphs", F.array().cast("array<struct<idx int,title string,paragraph_text string,is_supporting boolean>>"))
    held = F.filter(p, lambda x: F.coalesce(x["is_supporting"], F.lit(False)))
    known = F.filter(F.coalesce("answer_aliases", F.array().cast("array<string>")), lambda a: a != "")
    answer = F.coalesce("answer", F.lit(""))
    aliases = F.when((answer != "") & ~F.array_contains(known, answer), F.array_prepend(known, answer)).otherwise(known)
    return df.select(
        F.col("id").alias("question_id"),
        "question",
        "answer",
        F.struct(
            F.transform(p, lambda x: F.coalesce(x["title"], F.lit(""))).alias("title"),
            F.transform(p, lambda x: F.array(F.coalesce(x["paragraph_text"], F.lit("")))).alias("sentences"),
        ).alias("context"),
        F.struct(F.transform(held, lambda x: x["title"]).alias("title"), F.transform(held, lambda x: F.lit(0)).alias("sent_id")).alias("supporting_facts"),
        aliases.alias("answer_aliases"),
    )


def is_paragraph_set(name: str) -> bool:
    return "musique" in name.lower()


def is_pair_set(name: str) -> bool:
    return "2wiki" in name.lower() or "twowiki" in name.lower()


def supporting_sentences(examples: DataFrame, key: str) -> DataFrame:
    """``key, title_key, sent_ids``: sorted distinct sentence numbers of each supporting title."""
    facts = F.arrays_zip(F.col("supporting_facts.title").alias("title"), F.col("supporting_facts.sent_id").alias("sent_id"))
    each = examples.select(key, F.inline(facts)).select(key, official_form("title").alias("title_key"), "sent_id")
    each = each.where("title_key <> '' AND sent_id IS NOT NULL")
    return each.groupBy(key, "title_key").agg(F.sort_array(F.collect_set("sent_id")).alias("sent_ids"))


def document_rows(examples: DataFrame, key: str) -> DataFrame:
    """One row for each context document, with the supporting sentences of its title as written."""
    title, sentences = F.col("context.title"), F.col("context.sentences")
    docs = examples.select(key, F.posexplode(F.arrays_zip(title.alias("t"), sentences.alias("s"))).alias("doc_index", "d"))
    docs = docs.select(
        key,
        "doc_index",
        F.coalesce("d.t", F.concat(F.lit("context_"), F.col("doc_index").cast("string"))).alias("title"),
        F.coalesce("d.s", F.array().cast("array<string>")).alias("s"),
    )
    facts = F.arrays_zip(F.col("supporting_facts.title").alias("title"), F.col("supporting_facts.sent_id").alias("sent_id"))
    held = examples.select(key, F.inline(facts)).where("title IS NOT NULL AND sent_id IS NOT NULL")
    held = held.groupBy(key, "title").agg(F.sort_array(F.collect_set("sent_id")).alias("ids"))
    text = F.trim(F.array_join(F.transform("s", lambda x: F.trim(x)), " "))
    return docs.join(held, [key, "title"], "left").select(
        key,
        F.concat_ws("::", "title", F.col("doc_index").cast("string")).alias("doc_id"),
        "doc_index",
        "title",
        text.alias("context_text"),
        F.size("s").alias("sentence_count"),
        F.coalesce("ids", F.array().cast("array<int>")).alias("supporting_sentence_ids"),
        F.col("ids").isNotNull().alias("is_supporting_doc"),
    )


def chunk_table(documents: DataFrame, key: str, collection: str) -> DataFrame:
    """Chunks with a composite id, their span, and the text under its title."""
    each = chunk_rows(documents.where("context_text <> ''"), "context_text", key, "doc_id", "doc_index", "title", most=CHUNK, shared=SHARED)
    return each.select(
        F.concat_ws(":", key, F.lit(collection), F.col("doc_index").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        key,
        "doc_id",
        "title",
        "chunk_index",
        F.col("start_word").alias("chunk_start"),
        F.col("end_word").alias("chunk_end"),
        F.col("word_count").alias("chunk_word_count"),
        F.col("split_type").alias("chunk_split_type"),
        F.concat(F.col("title"), F.lit("\n"), F.col("text")).alias("chunk_text"),
        F.col("text").alias("chunk_body_text"),
    )


def context_block(context: Column, without: Column | None = None) -> Column:
    """``title: text`` of every document, parted by blank lines; without the named titles."""
    docs = F.arrays_zip(context["title"].alias("t"), context["sentences"].alias("s"))
    kept = F.filter(docs, lambda d: ~F.array_contains(F.coalesce(without, F.array().cast("array<string>")), d["t"])) if without is not None else docs
    return F.array_join(F.transform(kept, lambda d: F.concat(F.coalesce(d["t"], F.lit("")), F.lit(": "), F.array_join(F.coalesce(d["s"], F.array().cast("array<string>")), " "))), "\n\n")


def passages(context: Column) -> Column:
    """Titles with texts, as many as both lists have."""
    n = F.least(F.size(context["title"]), F.size(context["sentences"]))
    rows = F.arrays_zip(F.slice(context["title"], F.lit(1), n).alias("t"), F.slice(context["sentences"], F.lit(1), n).alias("s"))
    return F.transform(rows, lambda r, i: F.struct(i.alias("index"), r["t"].alias("title"), F.array_join(r["s"], " ").alias("text")))


def evidence_block(items: Column) -> Column:
    """Numbered passages, ``[1] title`` over the text."""
    return F.array_join(
        F.transform(items, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(p["title"], F.lit("")), F.lit("\n"), F.coalesce(p["text"], F.lit("")))),
        "\n\n",
    )


def hit_text(body: Column, chunk: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(body), F.lit("")), chunk)


# ---- sampling: orders come from a hash of the key and the seed, alike on every engine ---------


def shuffled(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def subset(rows: DataFrame, key: str, seed: int, start: int = 0, limit: int | None = None) -> DataFrame:
    """Rows at these places of the shuffled order."""
    ordered = rows.orderBy(shuffled(F.col(key), seed), key)
    if start:
        ordered = ordered.offset(start)
    return ordered if limit is None or limit <= 0 else ordered.limit(limit)


def stratified(rows: DataFrame, stratum: Column, targets: dict[str, int], key: str, seed: int) -> DataFrame:
    """Of each stratum the target number in shuffled order; all of a stratum that is smaller."""
    spark = rows.sparkSession
    goal = spark.createDataFrame(list(targets.items()), "stratum string, target int")
    named = rows.withColumn("stratum", stratum).join(F.broadcast(goal), "stratum")
    w = Window.partitionBy("stratum").orderBy(shuffled(F.col(key), seed), key)
    most = max(targets.values(), default=0)
    # The constant bound lets each task keep its best rows only, however large a stratum is.
    return named.withColumn("_n", F.row_number().over(w)).where((F.col("_n") <= most) & (F.col("_n") <= F.col("target"))).drop("_n", "target")


def held_out_sample(rows: DataFrame, train: DataFrame, stratum: Column, targets: dict[str, int], key: str, seed: int) -> DataFrame:
    """A stratified sample without the training rows."""
    return stratified(rows.join(train.select(key), key, "left_anti"), stratum, targets, key, seed)


def equal_buckets(rows: DataFrame, bucket: Column, names: tuple[str, ...], total: int, key: str, seed: int) -> DataFrame:
    """``total // buckets`` rows of each bucket, the rest from what is left over."""
    each = total // len(names)
    first = stratified(rows, bucket, dict.fromkeys(names, each), key, seed)
    rest = total - each * len(names)
    left = rows.join(first.select(key), key, "left_anti").withColumn("stratum", bucket)
    more = left.orderBy(shuffled(F.col(key), seed + 1), key).limit(rest)
    return first.unionByName(more)


def padded_strata(rows: DataFrame, strata: list[str], total: int, required: dict[str, tuple[Column, int]], key: str, seed: int) -> DataFrame:
    """``total`` rows in proportion to the strata, of which at least so many meet each requirement.

    Rows are taken in one order: first what the requirements still need (each in shuffled order),
    then the strata in turn, so the result needs no exchange of rows afterwards.
    """
    order = [shuffled(F.col(key), seed), F.col(key)]
    ranked = rows
    need = F.lit(False)
    for i, (holds, least) in enumerate(required.values()):
        meets = F.coalesce(holds, F.lit(False))
        first = rows.where(meets).orderBy(*order).limit(least).select(key, F.lit(True).alias(f"_need{i}"))
        ranked = ranked.join(F.broadcast(first), key, "left")  # at most ``least`` rows
        need = need | F.coalesce(F.col(f"_need{i}"), F.lit(False))
    turn = Window.partitionBy(*strata).orderBy(*order)
    sizes = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("_size"))
    named = ranked.withColumn("_must", need).withColumn("_turn", F.row_number().over(turn)).where(F.col("_must") | (F.col("_turn") <= total))
    keys = [F.coalesce(F.col(s).cast("string"), F.lit("")).alias(f"_{s}") for s in strata]
    shares = sizes.select(*keys, "_size")
    dealt = named.select("*", *keys).join(F.broadcast(shares), [f"_{s}" for s in strata])
    picked = dealt.orderBy(F.col("_must").desc(), F.col("_turn") / F.col("_size"), *order).limit(total)
    return picked.select(*rows.columns)


# ---- control rows ----------------------------------------------------------------------------


def control_category(answer: Column, kind: Column) -> Column:
    """The first control category that a row fits, else null."""
    w = words(F.trim(answer))
    upper = lambda x: x.rlike(r"^\p{Lu}")
    proper = F.forall(w, lambda x: x.rlike(r"^\p{Lu}[^\p{Lu}]*\p{Ll}[^\p{Lu}]*$"))
    return (
        F.when((kind == "bridge") & (F.size(w) == 2) & proper, "person-name-swap")
        .when(F.lower(F.trim(answer)).isin("yes", "no"), "yes-no-restate")
        .when(F.trim(answer).rlike(r"^[0-9]{4}$"), "year-prefix")
        .when((kind == "bridge") & (F.size(w) == 1) & upper(F.get(w, F.lit(0))), "place-prefix")
        .when(kind == "comparison", "comparison-rewrite")
    )


def paraphrases(category: Column, answer: Column) -> Column:
    w = words(F.trim(answer))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return (
        F.when(category == "person-name-swap", F.array(say(F.get(w, F.lit(1)), " ", F.get(w, F.lit(0)))))
        .when(category == "yes-no-restate", F.array(F.when(F.lower(answer) == "yes", "Yes, that is correct.").otherwise("No, that is not correct.")))
        .when(category == "year-prefix", F.array(say("the year ", answer), say("in ", answer)))
        .when(category == "place-prefix", F.array(say("the ", answer), say(answer, " itself")))
        .when(category == "comparison-rewrite", F.array(say("the answer is ", answer), say(answer, " is correct")))
    )


def control_rows(rows: DataFrame, key: str, answer: str, kind: str) -> DataFrame:
    """One row of each category, the first by key, with its paraphrases. Every row counts for the
    first category that it fits, so no row serves twice."""
    named = rows.withColumn("category", control_category(F.col(answer), F.col(kind))).where("category IS NOT NULL")
    first = named.groupBy("category").agg(F.min_by(F.struct(key, answer), key).alias("_r")).select("category", "_r.*")
    return first.withColumn("paraphrases", paraphrases(F.col("category"), F.col(answer)))


def swap_answers(rows: DataFrame, key: str, answer: str) -> DataFrame:
    """For each row the answer of the first other row that differs from its own. Only the first two
    different answers can ever be chosen, so no pairs are formed."""
    said = rows.where(F.col(answer).isNotNull()).select(F.col(key), F.col(answer), F.lower(F.trim(answer)).alias("_a"))
    firsts = said.groupBy("_a").agg(F.min(key).alias("_k"), F.min_by(answer, key).alias("_first")).orderBy("_k").limit(2)
    two = firsts.agg(F.array_sort(F.collect_list(F.struct("_k", "_a", "_first"))).alias("_two"))
    both = said.crossJoin(F.broadcast(two))  # one row
    other = F.filter("_two", lambda t: t["_a"] != F.col("_a"))
    return both.select(key, answer, F.get(other, F.lit(0))["_first"].alias("swapped"))


def missing_fields(*fields: str) -> Column:
    """Names of required fields that are null or empty; counts may be 0."""
    return F.filter(F.array(*[F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), F.lit(f)) for f in fields]), lambda x: x.isNotNull())


def require_fields(rows: DataFrame, *fields: str) -> DataFrame:
    """Fails the job at the first row that lacks a required field."""
    lacking = missing_fields(*fields)
    return rows.where(F.assert_true(F.size(lacking) == 0, F.concat(F.lit("missing: "), F.array_join(lacking, ", "))).isNull())


def int_or_zero(value: Column) -> Column:
    return F.coalesce(value.try_cast("int"), F.lit(0))


def as_bool(value: Column) -> Column:
    return F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes", "y")
