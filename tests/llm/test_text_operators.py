import random
import re
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm.canonical_text import canonical_batches, canonical_texts
from evidentia.llm.chunk_split import PARAGRAPH, SECTION, SENTENCE, SplitPolicy, split_oversized, split_text
from evidentia.llm.leakage import Matcher, leaked_items
from evidentia.llm.tokenise import TreeEncoder, token_ids, vocabulary_file

# ---- splitting -------------------------------------------------------------------------------


def brute_pieces(text):
    """The rule restated plainly."""
    found = list(re.finditer(r"[^ \t\r\n]+", text))
    n = len(found)

    def paragraph_end(e):
        gap = text[found[e - 1].end() : found[e].start()].replace("\r\n", "\n").replace("\r", "\n")
        return any(not line.strip(" \t") for line in gap.split("\n")[1:-1])

    def sentence_end(e):
        return found[e - 1].group().rstrip("\"')]»”")[-1:] in tuple(".!?")

    out, s = [], 0
    while n - s > 120:
        ends = range(s + 120, s + 59, -1)
        e = next((e for e in ends if paragraph_end(e)), None) or next((e for e in ends if sentence_end(e)), s + 120)
        out.append((s, e))
        s = e - 40
    return [*out, (s, n)] if n else []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 700))
def test_pieces_equal_the_rule(seed, n):
    rng = random.Random(seed)
    words = [rng.choice(["a", "b.", 'c?"', "d,", "(e!)", "é", ".", '"']) for _ in range(n)]
    gaps = [rng.choice([" "] * 12 + ["\n", "\r\n", "\n\n", "\r\n \t\r\n", "\t", "\r\r", "\n \n"]) for _ in range(n)]
    text = "".join(w + g for w, g in zip(words, gaps, strict=True))
    assert [(p["start_word"], p["end_word"]) for p in split_text(text, SplitPolicy())] == brute_pieces(text)


def test_split_edges():
    assert split_text(None, SplitPolicy()) == [] and split_text(" \n", SplitPolicy()) == []
    long = split_text("w " * 1_000_000, SplitPolicy())
    assert len(long) == 1 + -(-(1_000_000 - 120) // 80) and all(p["end_word"] - p["start_word"] <= 120 for p in long)
    by_chars = split_text("x" * 1000, SplitPolicy(max_word_chars=5))
    assert max(p["end_word"] - p["start_word"] for p in by_chars) <= 120 and "".join(by_chars[0]["piece"]) == "x" * 600
    by_section = split_text("a " * 70 + "\n\n# H\n" + "b " * 20 + "\n\n" + "c " * 200, SplitPolicy(ranks=(SECTION, PARAGRAPH, SENTENCE)))
    assert by_section[0]["end_word"] == 70
    with pytest.raises(ValueError):
        SplitPolicy(overlap=60)


def test_split_table(spark):
    text = "word " * 130
    rows = [(1, text, 7, "x"), (1, text, 8, "y"), (2, None, 1, ""), (3, "", 1, ""), (None, text, 1, ""), (4, "short", 1, "")]
    df = spark.createDataFrame(rows, "evid_id bigint, context_text string, chunk_index int, _pieces string")
    got = split_oversized(df, "evid_id", "context_text").select("evid_id", "chunk_index", "start_word", "end_word").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 120), (1, 1, 80, 130)]
    assert split_oversized(df.limit(0), "evid_id", "context_text").count() == 0


# ---- one form --------------------------------------------------------------------------------


def canonical(*texts):
    batch = pa.record_batch({"id": list(range(len(texts))), "v": list(texts)}, schema=pa.schema([("id", pa.int64()), ("v", pa.string())]))
    return [x for b in canonical_batches(iter([batch]), "id", "v") for x in b.column("canonical").to_pylist()]


@pytest.mark.parametrize(
    "text, form",
    [
        (None, None),
        ("", ""),
        ("Ｈａｌ １２", "Hal 12"),
        ("ﬁn Prĳs № Ⅱ", "fin Prijs No II"),
        ("éa", "éa"),
        ("a b　c d", "a b c d"),
        ("Qu​a­o﻿ph", "Quaoph"),
        ("Маνјutburg", "Mavjutburg"),
        ("О'Vekzun", "O'Vekzun"),
        ("Fɑl", "Fal"),
        ("Rуtӧr", "Rytör"),
        ("Гарузень Βαρδούσιον", "Гарузень Βαρδούσιον"),
        ("Гаpузень", "Гарузень"),
        ("Törfíp ñandú\tx\r\ny", "Törfíp ñandú\tx\r\ny"),
        ("рост", "рост"),
    ],
)
def test_canonical_forms(text, form):
    assert canonical("plain", text)[1] == form


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=20))
def test_canonical_is_stable(text):
    (once,) = canonical(text)
    assert canonical(once) == [once] and unicodedata.is_normalized("NFC", once)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abzÖñé '.-/1\n", max_size=20))
def test_ordinary_text_is_left_alone(text):
    text = unicodedata.normalize("NFC", text)
    assert canonical(text) == [text]


def test_canonical_table(spark):
    df = spark.createDataFrame([(1, "Ｘ", "k"), (1, "Ｘ", "k"), (2, None, None), (3, "é" * 300_000, ""), (None, "a​", "")], "row_id bigint, v string, canonical string")
    got = canonical_texts(df, "row_id", "v").collect()
    assert sorted((r.row_id or 0, r.disguised) for r in got) == [(0, True), (1, True), (1, True), (2, False), (3, False)]
    assert canonical_texts(df.limit(0), "row_id", "v").count() == 0


# ---- tokens ----------------------------------------------------------------------------------

ALPHABET = ["a", "b", " ", "  ", "\n", "'", "'s", "'ll", "é", "ß", "1", "2", "!", "...", "漢", "🎉", "　", "\t", "\x1c", "\x85", "don't", " the", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join) | st.text(max_size=60), st.sampled_from([1, 2, 3, 7]), st.sampled_from([1, 2, 5]))
def test_tree_equals_direct_encoding(text, leaf, window):
    coder = TreeEncoder(vocabulary_file(), leaf, window)
    ids = coder.encode(text)
    assert list(ids) == coder.encoding.encode_ordinary(text)
    assert coder.encoding.decode(list(ids)) == text


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab '1.\n", max_size=12), min_size=3, max_size=3))
def test_joining_is_associative(parts):
    coder = TreeEncoder(vocabulary_file(), 4, 2)
    a, b, c = parts
    join = lambda x, y, ix, iy: coder.join(x + y, len(x), ix, iy)
    ia, ib, ic = map(coder.encode, parts)
    assert list(join(a + b, c, join(a, b, ia, ib), ic)) == list(join(a, b + c, ia, join(b, c, ib, ic)))


def test_tokens_equal_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(vocabulary_file().replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    coder = TreeEncoder(vocabulary_file())
    for text in ("Hello  world's\n\n end", "Ünïcode 🎉 漢字 123,456 <|endoftext|>", "x" * 5000, " \t" * 900):
        assert list(coder.encode(text)) == t.encode(text, add_special_tokens=False).ids


def test_token_table(spark):
    long = "Long words, and 123 numbers' ends.\n" * 400 + "x" * 3000
    rows = [(1, "a b", "q"), (2, "", "q"), (3, None, "q"), (4, " ", "q"), (5, long, "q"), (5, long, "q"), (None, "z", "q")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    coder = TreeEncoder(vocabulary_file())
    got = token_ids(df, "doc_id", "text", segment_chars=1000).collect()
    want = sorted((r[0], coder.encoding.encode_ordinary(r[1]) if r[1] else []) for r in rows if r[0] is not None)
    assert sorted((r.doc_id, list(r.ids)) for r in got) == want
    assert token_ids(df.limit(0), "doc_id", "text").count() == 0


# ---- leakage ---------------------------------------------------------------------------------


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 2**32))
def test_matches_equal_brute_force(seed):
    rng = random.Random(seed)
    words = "ab c déf 12 G_h ß STRASSE straße".split()
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", " -- ", "_"]) for _ in range(n))
    items = [(i, say(rng.randint(0, 9))) for i in range(6)]
    text = say(rng.randint(0, 40)) + rng.choice(items)[1] + say(3)
    plain = lambda t: [w.casefold() for w in re.findall(r"[^\W_]+", t)]
    line = plain(text)

    def inside(item):
        w = plain(item)
        keys = [w[i : i + 4] for i in range(max(1, len(w) - 3))] if w else []
        return any(line[i : i + len(k)] == k for k in keys for i in range(len(line) - len(k) + 1))

    got = Matcher(items, 4).scan(text)
    assert set(got) == {i for i, t in items if inside(t)}
    for window in (1, 2, 3, 5, 6):  # blocks of every parity
        found = Matcher(items, window).scan(text)
        for i, t in items:
            w = plain(t)
            starts = range(max(1, len(w) - window + 1)) if w else ()
            n = sum(line[k : k + len(w[a : a + window])] == w[a : a + window] for a in starts for k in range(len(line)))
            assert found.get(i, (0, 0, 0))[2] == n  # every window once
    for first, last, n in got.values():
        assert 0 <= first < last <= len(text) and n > 0


def test_leak_table(spark):
    item = "One two three, four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = spark.createDataFrame([(1, f"x {item.upper()} y", "a"), (2, None, "b"), (3, "", "c"), (4, item[:40], "d"), (5, "z " * 200_000 + item, "e")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(7, item), (8, item), (9, None), (10, "!!"), (11, "nine ten")], "item_id bigint, text string")
    for shard in (10, 10_000):
        got = leaked_items(docs, items, shard_words=shard).select("doc_id", "item_id").collect()
        assert sorted(map(tuple, got)) == [(1, 7), (1, 8), (1, 11), (5, 7), (5, 8), (5, 11)]
    # Keys of any type, and one automaton for all tasks of a worker.
    for kind in ("int", "bigint", "string", "date"):
        dated = f"CAST(date_add(DATE'2000-01-01', CAST(item_id AS int)) AS {kind})" if kind == "date" else f"CAST(item_id AS {kind})"
        typed = items.selectExpr(f"{dated} AS item_id", "text")
        got = leaked_items(docs, typed)
        assert dict(got.dtypes)["item_id"] == kind and got.count() == 6
    assert leaked_items(docs.limit(0), items).count() == 0 and leaked_items(docs, items.limit(0)).count() == 0
