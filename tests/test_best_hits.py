"""Searches of all documents: whole results, and shuffles that do not grow with the matching pairs."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evidentia.operators.best_hits import Best, Questions
from evidentia.operators.retrieval import Bm25Index, top_k
from evidentia.plans import ORACLES, QUERIES
from tests.compare import both


def shuffled_rows(spark):
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
    store.listenerBus().waitUntilEmpty(30_000)
    stages = store.statusStore().stageList(None, False, False, getattr(store.statusStore(), "stageList$default$4")(), None)
    return sum(s.shuffleWriteRecords() for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Every question has a word of every document; some documents are copies, blank or null."""
    rng, at = random.Random(3), tmp_path_factory.mktemp("hits")
    text = lambda n: "the " + " ".join(f"w{int(rng.random() ** 3 * 60)}" for _ in range(n))
    texts = [text(rng.randrange(1, 30)) for _ in range(600)]
    texts[7], texts[8], texts[9], texts[11] = texts[6], "", None, "?!"
    vectors = pa.array([[rng.random(), rng.random()] for _ in texts], pa.list_(pa.float32()))
    pq.write_table(pa.table({"doc_id": range(1, 601), "text": texts, "question_id": [f"q{i % 100}" for i in range(600)]}), at / "documents.parquet")
    pq.write_table(pa.table({"example_id": range(0, 5000, 50), "question_id": [f"q{i}" for i in range(100)], "question": [None, "zebra", "The the"] + [text(4) for _ in range(97)]}), at / "examples.parquet")
    pq.write_table(pa.table({"vec_id": range(1, 601), "embedding": vectors}), at / "embeddings.parquet")
    return str(at)


def compared(spark, folder, name):
    before = shuffled_rows(spark)
    got, want = both(spark, folder, QUERIES[name], ORACLES[name])
    assert got == want and got[1]
    return shuffled_rows(spark) - before


def test_global_search_shuffles_no_pairs(spark, folder):
    assert compared(spark, folder, "R4_bm25_global_topk") < 98 * 597 / 4  # questions times documents


@pytest.mark.parametrize("k", [1, 3, 50])
def test_blocks_keep_the_best(k):
    rng = np.random.default_rng(k)
    scores = rng.integers(0, 6, (200, 7)) / 4 * (rng.random((200, 7)) < rng.random(7))  # many ties
    docs = rng.permutation(200)
    for names in (docs, np.array([f"d{d:03}" for d in docs], dtype=object)):
        best = Best(7, k)
        for i in range(0, 200, 16):
            best.add(scores[i : i + 16], names[i : i + 16])
            if i % 32:
                best.merge()
        of, score, doc = best.merge()
        want = [(j, s, d) for j in range(7) for s, d in sorted(((scores[i, j], names[i]) for i in range(200) if scores[i, j] > 0), key=lambda x: (-x[0], x[1]))[:k]]
        assert list(zip(of, score, doc, strict=True)) == want


def test_frequent_and_rare_terms_sum_alike():
    rng = random.Random(1)
    asked = {(q, f"t{int(rng.random() ** 2 * 40)}"): rng.randrange(1, 4) for q in "abcdef" for _ in range(9)}
    df = {t: 1 + int(t[1:]) ** 2 for _, t in asked}
    pairs = pa.Table.from_pylist([{"query": q, "term": t, "qtf": n, "df": df[t], "idf": 1.0} for (q, t), n in asked.items()])
    for n_docs in (10, 100_000, 10**9):  # no, some and all terms are frequent
        questions = Questions(pairs, n_docs)
        names = questions.terms.to_pylist()
        bags = [Counter(rng.choices(range(len(names)), k=12)) for _ in range(5)]
        entries = [(r, t, n) for r, bag in enumerate(bags) for t, n in bag.items()]
        row, term, weight = (np.array(x) for x in zip(*entries, strict=True))
        got = questions.scores(row, term, weight.astype(float), 5)
        for j, q in enumerate(questions.ids.to_pylist()):
            assert got[:, j].tolist() == [sum(n * asked.get((q, names[t]), 0) for t, n in bag.items()) for bag in bags]


def test_portions_leave_nothing_out(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(f"d{i}", " ".join(rng.choices("abcdefgh", k=6))) for i in range(60)], "doc string, t string")
    ask = spark.createDataFrame([(f"q{i % 9}" if i else None, " ".join(rng.choices("abcdefghz", k=3))) for i in range(12)], "query string, t string")
    index = Bm25Index(docs, "doc", "t")
    every = top_k(index.scores(ask, "query", "t"), ["query"], "score", "doc", 4)
    want = sorted((r.query or "", r.doc, round(r.score, 8)) for r in every.collect())
    for portions in ({}, {"portion_queries": 2}, {"portion_pairs": 5}):
        found = top_k(index._hits(ask, "query", "t", 4, **portions), ["query"], "score", "doc", 4)
        assert sorted((r.query or "", r.doc, round(r.score, 8)) for r in found.collect()) == want
    nothing = ask.where(F.lit(False))
    assert index.search(nothing, "query", "t", 4).count() == index.search(ask, "query", "t", 0).count() == 0


def test_whole_texts_shuffle_no_pairs(spark, folder):
    assert compared(spark, folder, "R8_hybrid_whole_text") < 12 * 597 / 2  # the dense side shuffles its own hits


def test_fused_questions_shuffle_no_pairs(spark, folder):
    assert compared(spark, folder, "R8_hybrid_fusion") < 12 * 597 / 2


def test_saved_index_is_searched_without_pairs(spark, folder):
    assert compared(spark, folder, "K5_saved_index") < 98 * 597 / 4


def test_overfetched_search_shuffles_no_pairs(spark, folder):
    assert compared(spark, folder, "R6_overfetched") < 98 * 597 / 4
