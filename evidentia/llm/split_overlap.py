"""Same or nearly the same questions on both sides of a train / evaluation split.

An exact prefix-filter join on rare shingles. Questions are reduced to letters and digits;
questions equal in that form make one class, joined as a whole. As the same question may come in
any word order, a class's shingles are its single words. A shingle weighs ln(1 + N/df) squared,
so that names count for most; one that no other class has, which may be a slip, weighs two thirds
of the rarest that can be shared, and is left out of the index, as it joins nothing.
With its shingles in order of frequency, a class of weight W can only have the weight
``threshold`` * W in common with another if they share a shingle among the rarest ones, beyond
which less than that weight remains. These prefixes of the evaluation classes are the index; the
training classes' prefixes probe it, a hit must pass the length filter (neither weight under
``threshold`` of the other) and the position filter (the weight from the hit on must suffice on
both sides), and the pairs that are left are verified on their texts.

The verification matches words exactly, then within an edit distance, in any order. Names and
years must all be matched, as must the noun asked for ("in which *year*"); otherwise one content
word may differ, function words may, and words may be added around.

Nothing is capped: frequent shingles weigh little and fall outside the prefixes by their weight
alone. Their frequencies, at most (shingles a class) / ``frequent`` of them, are broadcast,
so that the join which brings in the frequencies has no hot key.

Defined results: null and wordless questions match by ``question_id`` only, null ids match
nothing; the same example on two rows, and extra columns, change nothing; an empty table or side
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evidentia.session import durable, ship_package

THRESHOLD = 0.5
#: Weight of a shingle of one class only, as a share of one that two classes have.
LONE = 2 / 3
FREQUENT = 0.002

_TOKEN = re.compile(r"[^\W_]+")
_FUNCTION_WORDS = frozenset(
    "a an the of to for off up out in on at by with from and or did do does was were is are had has have be it its this that s "
    "please question answer briefly exactly known if can could you tell me q one".split()
)
_ASKING = ("which", "what", "whose", "many", "who", "when", "where", "why")


def plain_question(question: Column) -> Column:
    """Letters and digits in small letters, single blanks between the words."""
    return F.trim(F.regexp_replace(F.lower(question), r"[^\p{L}\p{N}]+", " "))


def shingles(plain: Column) -> Column:
    return F.array_distinct(F.split(plain, " "))


@lru_cache(200_000)
def _distance(a: str, b: str, most: int) -> int:
    """Edits with swaps of neighbours, or more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def _alike(a: str, b: str) -> bool:
    if a == b:
        return True
    if any(c.isdigit() for c in a + b):
        return False
    shorter = min(len(a), len(b))
    if shorter < 3:
        return shorter == 2 and sorted(a) == sorted(b)
    return _distance(a, b, 1 if shorter < 6 else 2) <= (1 if shorter < 6 else 2)


@lru_cache(50_000)
def _read(question: str) -> tuple[tuple[str, ...], frozenset[str], frozenset[str]]:
    """Words; those that must be matched (names, years); the nouns asked for."""
    found = list(_TOKEN.finditer(question))
    words = tuple(m.group().lower() for m in found)
    must = set()
    cased = sum(m.group()[:1].isupper() for m in found) < 0.7 * len(found)
    for i, m in enumerate(found):
        w = m.group()
        if w.isdigit():
            if len(w) >= 3:
                must.add(w)
        elif cased and i and w[0].isupper() and len(w) >= 3:
            gap = question[found[i - 1].end() : m.start()]
            if not re.search(r"[.:!?>\n\"]", gap):
                must.add(w.lower())
    asked = set()
    for i, w in enumerate(words):
        if any(_alike(w, a) for a in _ASKING[:4]) and i + 1 < len(words) and words[i + 1] not in _FUNCTION_WORDS:
            asked.add(words[i + 1])
    return words, frozenset(must), frozenset(asked)


def same_question(a: str, b: str) -> bool:
    wa, ma, qa = _read(a)
    wb, mb, qb = _read(b)
    ca, cb = Counter(wa), Counter(wb)
    left, right = list((ca - cb).elements()), list((cb - ca).elements())
    for w in sorted(left, key=len, reverse=True):
        hit = min((v for v in right if _alike(w, v)), key=lambda v: _distance(w, v, 2), default=None)
        if hit is not None:
            left.remove(w)
            right.remove(hit)
    if any(w in ma or w in qa for w in left) or any(w in mb or w in qb for w in right):
        return False
    # A name that one side writes in one case only is known from the other side.
    if any(w in mb for w in left) or any(w in ma for w in right):
        return False
    left = [w for w in left if w not in _FUNCTION_WORDS]
    right = [w for w in right if w not in _FUNCTION_WORDS]
    common = sum((ca & cb).values())
    return min(len(left), len(right)) <= 1 and max(len(left), len(right)) <= 8 and common >= 2


def question_classes(examples: DataFrame, key: str, question: str, is_train: Column, is_eval: Column) -> DataFrame:
    """``plain, question, train, eval, cid``: one row for each form of a question."""
    rows = examples.select(question, is_train.alias("_t"), is_eval.alias("_e"), F.col(key).alias("_k")).where(is_train | is_eval)
    rows = rows.withColumn("plain", plain_question(F.col(question))).where(F.length("plain") > 0)
    mixed = F.col(question).rlike(r"\p{Lu}") & F.col(question).rlike(r"\p{Ll}")
    return rows.groupBy("plain").agg(
        F.max_by(question, F.struct(mixed, F.col(question))).alias("question"),
        F.max("_t").alias("train"),
        F.max("_e").alias("eval"),
        F.min("_k").alias("cid"),
    )


def prefixes(classes: DataFrame, threshold: float, frequent: float = FREQUENT) -> DataFrame:
    """``cid, train, eval, gram, rest, total``: the shingles of each class's prefix."""
    n = classes.count()
    grams = classes.select("cid", "train", "eval", F.explode(shingles(F.col("plain"))).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    bound = max(50, int(frequent * n))
    # At most (shingles of all classes) / bound shingles are frequent, whatever the number of classes.
    often = F.broadcast(counts.where(F.col("df") >= bound))
    seldom = counts.where(F.col("df") < bound)
    rare = grams.join(often, "gram", "left_anti").join(seldom, "gram")
    known = grams.join(often, "gram").unionByName(rare)
    weight = F.pow(F.log(1 + F.lit(float(n)) / F.greatest("df", F.lit(2))), 2)
    weighted = known.withColumn("w", F.when(F.col("df") == 1, weight * LONE).otherwise(weight))
    own = Window.partitionBy("cid")
    rarest = own.orderBy("df", "gram").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = weighted.withColumn("total", F.sum("w").over(own)).withColumn("rest", F.col("total") - F.sum("w").over(rarest) + F.col("w"))
    return placed.where((F.col("df") > 1) & (F.col("rest") >= threshold * F.col("total") - 1e-9)).select("cid", "train", "eval", "gram", "rest", "total")


def same_question_classes(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``cid_e, cid_t``: pairs of different classes that ask the same question across the split."""
    index = prefixes(classes, threshold)
    held = index.where("eval").select("gram", F.col("cid").alias("cid_e"), F.col("rest").alias("rest_e"), F.col("total").alias("total_e"))
    probe = index.where("train").select("gram", F.col("cid").alias("cid_t"), F.col("rest").alias("rest_t"), F.col("total").alias("total_t"))
    need = threshold * F.greatest("total_e", "total_t") - 1e-9
    hits = held.join(probe, "gram").where(
        (F.col("cid_e") != F.col("cid_t"))
        & (F.least("total_e", "total_t") >= need)  # length filter
        & (F.least("rest_e", "rest_t") >= need)  # position filter
    )
    pairs = hits.select("cid_e", "cid_t").distinct()
    texts = classes.select("cid", "question")

    @F.arrow_udf(T.BooleanType())
    def verify(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([same_question(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())

    both = pairs.join(texts.select(F.col("cid").alias("cid_e"), F.col("question").alias("qe")), "cid_e").join(
        texts.select(F.col("cid").alias("cid_t"), F.col("question").alias("qt")), "cid_t"
    )
    return both.where(verify("qe", "qt")).select("cid_e", "cid_t")


def cross_split_pairs(
    examples: DataFrame,
    key: str = "example_id",
    question: str = "question",
    question_id: str = "question_id",
    split: str = "split",
    train: str = "train",
    held_out: tuple[str, ...] = ("validation", "test"),
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``id_e, id_t``: every held-out example with every training example of the same question or id."""
    ship_package(examples.sparkSession)
    rows = examples.select(key, question, question_id, split).where(F.col(key).isNotNull())
    is_train, is_eval = F.col(split) == train, F.col(split).isin(*held_out)
    classes = durable(question_classes(rows, key, question, is_train, is_eval))
    near = same_question_classes(classes, threshold)
    same = classes.where("train AND eval").select(F.col("cid").alias("cid_e"), F.col("cid").alias("cid_t"))
    member = rows.select(F.col(key).alias("id"), plain_question(F.col(question)).alias("plain"), is_train.alias("t"), is_eval.alias("e")).join(
        classes.select("plain", "cid"), "plain"
    )
    held = member.where("e").select(F.col("cid").alias("cid_e"), F.col("id").alias("id_e"))
    trained = member.where("t").select(F.col("cid").alias("cid_t"), F.col("id").alias("id_t"))
    by_text = near.unionByName(same).join(held, "cid_e").join(trained, "cid_t").select("id_e", "id_t")
    ids = rows.where(F.col(question_id).isNotNull())
    by_id = (
        ids.where(is_eval)
        .select(question_id, F.col(key).alias("id_e"))
        .join(ids.where(is_train).select(question_id, F.col(key).alias("id_t")), question_id)
        .select("id_e", "id_t")
    )
    return by_text.unionByName(by_id).distinct()
