import itertools
import random
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evidentia.llm import queries
from evidentia.llm import language
from evidentia.llm.language import LANGS, document_languages, fit_on, gram_numbers, label_of, language_of, segments, segments_of
from evidentia.llm.pair_defects import LABELS, asked_question, judged_text, pair_defects, synthetic_pairs, train
from evidentia.llm.split_overlap import cross_split_pairs, same_question
from tests.conftest import DATA

# ---- overlap ---------------------------------------------------------------------------------

Q = "In which year did Dormirvektor, the biographer of Wyntasnalesk, inspect the glass observatory two years before the 1781 election?"


@pytest.mark.parametrize(
    "other, same",
    [
        (Q, True),
        (Q.upper(), True),
        (Q.lower().replace(",", ""), True),
        (Q.replace("inspect", "inpsect").replace("which", "wihch"), True),
        (Q.replace("inspect", "examine"), True),
        (Q.replace("the biographer", "a biographer"), True),
        ("Two years before the 1781 election, in which year did Dormirvektor, the biographer of Wyntasnalesk, inspect the glass observatory?", True),
        (Q.replace("Dormirvektor, the biographer of Wyntasnalesk,", "Wyntasnalesk's biographer, Dormirvektor,"), True),
        ("Can you tell me: " + Q, True),
        ("Question: " + Q + " Answer briefly.", True),
        ("[hop 2] " + Q + " (if known)", True),
        (Q.replace("In which year", "In which town"), False),
        (Q.replace("In which year", "Under which name"), False),
        (Q.replace("Dormirvektor", "Kelovandros"), False),
        (Q.replace("1781", "1782"), False),
        (Q.replace("glass observatory", "river school"), False),
        ("", False),
    ],
)
def test_same_question(other, same):
    assert same_question(Q, other) is same and same_question(other, Q) is same


def test_overlap_equals_brute_force(spark):
    rows = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/examples.parquet").select("example_id", "question", "question_id", "split").collect()
    want = set()
    for a, b in itertools.product([r for r in rows if r.split == "train"], [r for r in rows if r.split in ("validation", "test")]):
        if a.question_id is not None and a.question_id == b.question_id or a.question and b.question and same_question(a.question, b.question):
            want.add((b.example_id, a.example_id))
    df = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/examples.parquet")
    assert {tuple(r) for r in cross_split_pairs(df).collect()} == want


def test_overlap_of_awkward_rows(spark):
    rows = [(1, Q, "a", "train", 1), (2, Q.upper() + "!", "b", "test", 1), (3, None, "c", "test", 1), (4, "", "c", "train", 1), (5, "??", None, "train", 1), (6, None, None, "test", 1), (7, Q, "z", None, 1), (8, "x " * 20_000, "y", "test", 1), (None, Q, "a", "test", 1)]
    df = spark.createDataFrame(rows, "example_id bigint, question string, question_id string, split string, cid int")
    assert sorted(map(tuple, cross_split_pairs(df).collect())) == [(2, 1), (3, 4)]
    assert cross_split_pairs(df.limit(0)).count() == 0


def test_overlap_of_a_hot_question(spark):
    df = spark.range(600).select(
        F.col("id").alias("example_id"), F.when(F.col("id") % 3 == 0, Q).otherwise(F.concat(F.lit("Who saw number "), F.col("id").cast("string"), F.lit(" today?"))).alias("question"),
        F.col("id").cast("string").alias("question_id"), F.when(F.col("id") % 60 == 0, "test").otherwise("train").alias("split"),
    )
    assert cross_split_pairs(df).count() == 10 * 190


# ---- pairs -----------------------------------------------------------------------------------


def _sound(n, seed):
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice(["Kel", "nor", "bel", "gro", "vek", "tas"]) for _ in range(3)).capitalize()
    for _ in range(n):
        a, b, y = name(), name(), rng.randint(1700, 2000)
        q = rng.choice((f"In which year did {a}, the tenant of {b}, sell the old mill?", f"Who was {a}?", f"Where did {a} work in {y}?"))
        r = rng.choice((f"The answer is {a}.", f"The passage says that {a} left {b} in {y}, so I commit.", f"No passage mentions the mill, hence {a} rests on memory alone.", f'The title "La nuit" points to {a}, and {b} confirms it.', a))
        yield q, r


@pytest.fixture(scope="module")
def pairs():
    """Pairs of the test tables, true defects among them."""
    turns = pq.read_table(f"{DATA.replace('0.001', '0.01')}/agent_turns.parquet", columns=["turn_id", "subquestion", "action"]).to_pylist()
    runs = pq.read_table(f"{DATA.replace('0.001', '0.01')}/trajectories.parquet", columns=["result_id", "question", "pred_answer_raw"]).to_pylist()
    return [(r["question"], r["pred_answer_raw"]) for r in runs] + [(t["subquestion"], (t["action"] or {}).get("reason")) for t in turns]


def test_accuracy_on_held_out_wordings_and_languages(pairs):
    model = train(pairs, held_out=True)
    sound = [(q, r) for q, r in _sound(300, 2)]
    made = synthetic_pairs(sound, seed=5, held=True)
    right, total = Counter(), Counter()
    for q, r, labels in made:
        if len(labels) < 2:
            want = LABELS[labels[0]] if labels else None
            total[want] += 1
            right[want] += want in model.defects(q, r) if want else not model.defects(q, r)
    for label in LABELS:
        assert total[label] > 30 and right[label] >= 0.9 * total[label], (label, right[label], total[label])


#: Wordings that are in no list of the package and in no table.
UNSEEN = {
    "refusal": (
        "I have nothing to go on here, so I will pass.", "This cannot be worked out from what I was given.", "Honestly, no clue.", "I'd rather leave this one unanswered.", "The material provided is silent on this matter.",
        "We lack the data to settle this.", "My training does not let me respond to such queries.", "Answering would go beyond what I am permitted to do.", "There isn't sufficient detail available for a conclusion.",
        "Can't say.", "That information is unavailable to me.", "I'm afraid I can't tell you that.", "It remains unclear from the text, so no answer is offered.", "I am not able to figure that out.",
        "Without additional documents, no reply is possible.", "The records do not reveal the name.", "I must respectfully refuse.", "Regretfully I am unable to name the person.", "Not enough material to say.", "Nothing in the sources settles who that was.",
    ),
    "other_language": (
        "Svaret finns i det andra stycket, där bron nämns tydligt.", "Odpowiedź brzmi Warszawa, ponieważ tekst wymienia to miasto.", "Ответ находится во втором отрывке.", "Vastaus löytyy toisesta kappaleesta, jossa silta mainitaan.",
        "Cevap ikinci paragrafta açıkça belirtilmiştir.", "Răspunsul este podul vechi, pentru că pasajul îl amintește.", "Svaret er den gamle broen, fordi teksten sier det.", "De brug werd pas later gebouwd, zoals de tekst vermeldt.",
        "A ponte foi construída mais tarde, como diz o texto.", "Le pont fut construit plus tard, d'après le texte.", "La réponse se trouve dans le deuxième passage.", "Die Brücke wurde später gebaut.", "A válasz a második bekezdésben található.",
    ),
    "copy": ("{q} {q} {q}", "Let me look at it: {q}", "We have been asked the following: {q}", "The prompt says: {q}", "Restated: {q}", "Well, {q}", "I wonder: {q}", "«{q}»", "Here goes: {q}", "It is asked: {q}"),
    "empty": ("   \n\t ", "—", "{ }", "<response></response>", "```json\n```", "....", "[]\n", "?!", "<p></p>", "My answer:", "\u200b\u200b"),
    "truncated": (
        "The passage says that the old mill was sold to the", "Both passages agree on the date, but the second one gi", 'The title "A long wal', "The evidence points to Norvek because the cens", "The first passage gives the year, while the other one na",
        "I will search again because the support for the ol", '{{"action": "retrieve", "query": "old mi', "The council asked Norvek to (", "Kelgrobel is named as the tenant, and the second passage conf", "Two beams disagree about the year, so the next quer",
    ),
    None: (
        "Kelgrobel", "It was Kelgrobel, who sold the mill in 1790.", "The second passage names Kelgrobel as the owner.", "No.", "1790", "Kelgrobel, although one source disagrees.", "The first passage does not mention the mill, but the second names Kelgrobel.",
        "I will search again for Norvek because the support is weak.", "Not Norvek but Kelgrobel.", "Kelgrobel, not Norvek",
    ),
}


def test_unseen_wordings(pairs):
    model = train(pairs)
    q = "In which year did Kelgrobel, the tenant of Norvek, sell the old mill?"
    for label, texts in UNSEEN.items():
        got = [(t, model.defect(q, t.format(q=q) if "{q}" in t or "{{" in t else t)) for t in texts]
        assert sum(g == label for _, g in got) >= 0.9 * len(texts), (label, [x for x in got if x[1] != label])


def test_two_defects_at_once(pairs):
    model = train(pairs)
    cut = [model.defects("Who was Kelgrobel?", r) for r in ("Die Antwort steht in der alten Mühle von Norvek (", "I cannot answer this question based on the", "La réponse se trouve dans la ville et le")]
    assert sum(len(d) > 1 and "truncated" in d for d in cut) >= 2


def test_defect_examples():
    model = train(list(_sound(600, 3)))
    q = "In which year did Kelgrobel, the tenant of Norvek, sell the old mill?"
    for response, defect in (
        (None, "empty"), ("", "empty"), ("...", "empty"), ("null", "empty"), ("Answer:", "empty"), (q, "copy"), (f"You asked: {q}", "copy"), (f"{q} {q}", "copy"),
        (f"{q} Kelgrobel", None), ("Kelgrobel", None), ("I cannot answer", "refusal"), ("As an AI language model, I do not have access to that information.", "refusal"),
        ("La réponse est Kelgrobel, car la tour se trouve à Norvek.", "other_language"), ("The passage says that Kelgrobel left (", "truncated"), ('{"action": "commit", "reason": "The', "truncated"),
    ):
        assert model.defect(q, response) == defect, response


def test_what_is_judged():
    assert judged_text(None) is None and judged_text("plain") == "plain" and judged_text("{}") == "{}"
    assert judged_text('```json\n{"action": "commit", "reason": "so"}\n```') == "so" and judged_text('{"action": "x", "reason": null}') is None
    assert judged_text('{"action": "x"') == '{"action": "x"'
    assert asked_question("Question: Who?\nAnswer so far: x") == "Who?" and asked_question(None) is None


def test_pair_table(spark):
    rows = [(i, q, r, "x") for i, (q, r) in enumerate(_sound(200, 4))] + [(900, "Who?", None, "x"), (900, "Who?", None, "x"), (901, None, "I cannot answer", "x"), (902, "Who was Kelgro?", "z. " * 50_000, "x"), (None, "Who?", None, "x")]
    df = spark.createDataFrame(rows, "k bigint, q string, r string, defect string")
    got = {r.row_id: r.defect for r in pair_defects({"t": (df, "k", F.col("q"), F.col("r"))}).collect()}
    assert got[900] == "empty" and got[901] == "refusal" and None not in got and len([k for k in got if k < 900]) <= 6
    none = spark.createDataFrame([], df.schema)
    assert pair_defects({"t": (none, "k", F.col("q"), F.col("r"))}).count() == 0
    nulls = spark.createDataFrame([(1, None, None, None)], df.schema)
    assert [r.defect for r in pair_defects({"t": (nulls, "k", F.col("q"), F.col("r"))}).collect()] == ["empty"]


# ---- languages -------------------------------------------------------------------------------

SAID = {
    "en": "The council asked her to rebuild the mill after the flood of 1900. She was born in the town and studied there.",
    "de": "Der Rat bat sie, nach dem Hochwasser die Mühle wieder aufzubauen. Sie wurde in der Stadt geboren und lernte noch lange.",
    "fr": "Le conseil lui a demandé de reconstruire le moulin après la crue. Elle est née dans la ville et a étudié avec lui.",
    "es": "El consejo le pidió que reconstruyera el molino después de la crecida. Nació en la ciudad y estudió con los suyos.",
    "it": "Il consiglio le chiese di ricostruire il mulino dopo la piena. È nata nella città e ha studiato con gli altri.",
    "pt": "O conselho pediu que reconstruísse o moinho depois da cheia. Nasceu na cidade e estudou com os outros até ao fim.",
    "nl": "De raad vroeg haar om de molen na de overstroming weer op te bouwen. Zij werd in de stad geboren en studeerde daar.",
}


def test_languages_of_plain_and_mixed_texts():
    filters = fit_on([(c, t) for c, t in SAID.items() for _ in range(25)])
    for a, b in itertools.permutations(LANGS, 2):
        got = segments(f"== Gurkov ==\n{SAID[a]}\n---\nTitle: Norvek\n{SAID[b]}", filters)
        assert [(s["seg_no"], s["lang"]) for s in got] == [(0, a), (1, b)]
        assert all(0 < s["confidence"] <= 1 for s in got)
    assert [s["lang"] for s in segments(SAID["en"] + ' He wrote "La torre e il mare" in the town.', filters)] == ["en"]
    assert segments(None, filters) == segments("", filters) == segments("12 — 14 | 0.5 🎉", filters) == segments("Gurkov Norvek", filters) == []


def test_grams_equal_brute_force():
    words = ["a", "über", "abababa", "x" * 5000, "ß𝔘y"]
    numbers, owner, n = gram_numbers(words)
    assert n == len(words)
    of = {}
    for h, o in zip(numbers.tolist(), owner.tolist(), strict=True):
        of.setdefault(o, []).append(h)
    name = {}
    for i, w in enumerate(words):
        grams = [w] + [f"^{w}$"[k : k + m] for m in (3, 4) for k in range(len(w) + 3 - m)]
        assert len(grams) == len(of[i])
        for g, h in zip(grams, of[i], strict=True):
            key = ("word" if g is grams[0] else "part", g)
            assert name.setdefault(h, key) == key  # one hash for each n-gram, wherever it comes
    assert len(set(name.values())) == len(name)


def test_portions_change_nothing(monkeypatch):
    filters = fit_on([(c, t) for c, t in SAID.items() for _ in range(25)])
    texts = [SAID["en"] + " " + SAID["nl"], None, *(SAID[c] * 3 for c in LANGS), "", "12"]
    want = [segments(t, filters) for t in texts]
    monkeypatch.setattr(language, "PORTION", 5)
    monkeypatch.setattr(language, "MEMO", 10)
    assert segments_of(texts, filters) == want
    assert language_of(want[0])[0] in ("en", "nl") and language_of([]) == (None, None)
    code, sure = language_of(want[2])
    assert code == "en" and sure == pytest.approx(want[2][0]["confidence"])


def test_language_table(spark):
    rows = [(i, t, c, "x") for i, (c, t) in enumerate([*SAID.items()] * 30)]
    rows += [(900, SAID["de"], "en-GB", ""), (901, SAID["de"], "German", ""), (902, SAID["de"], None, ""), (903, SAID["de"] + "\n" + SAID["en"], "de_AT", ""), (904, None, "xx", ""), (905, "123", None, ""), (906, SAID["fr"], "klingon", ""), (None, SAID["fr"], "en", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, segments string")
    got = document_languages(df).where("mislabelled").select("doc_id", F.col("segments.lang").alias("l")).collect()
    assert {r.doc_id: r.l for r in got} == {900: ["de"], 902: ["de"], 903: ["de", "en"], 906: ["fr"]}
    by_id = {r.doc_id: r for r in document_languages(df).collect()}
    assert by_id[901].lang == "de" and 0 < by_id[901].confidence <= 1 and by_id[905].lang is None and by_id[904].confidence is None
    assert document_languages(df.limit(0)).count() == 0
    labels = spark.createDataFrame([("EN",), ("pt-BR",), ("Dutch",), ("und",), ("",), (None,)], "l string").select(label_of(F.col("l")).alias("c")).collect()
    assert [r.c for r in labels] == ["en", "pt", "nl", None, None, None]


# ---- queries ---------------------------------------------------------------------------------

COLUMNS = {
    "p2_found": ["evid_id", "chunk_index", "start_word", "end_word"],
    "p3_found": ["tbl", "row_id"],
    "p5_found": ["tbl", "row_id", "defect"],
    "p7_found": ["id_lo", "id_hi"],
    "p8_ids": ["doc_id", "ids"],
    "p9_found": ["doc_id", "item_id"],
    "p10_found": ["doc_id", "seg_no", "lang"],
    "p10_segments": ["doc_id", "seg_no", "lang", "confidence", "start", "end"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_queries_run(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = df.collect()
    assert df.columns == COLUMNS[name] and rows
    keys = [tuple(r)[:2] if name not in ("p2_found", "p8_ids") else tuple(r)[:2 if name == "p2_found" else 1] for r in rows]
    assert len(set(keys)) == len(keys)
