"""Language of documents and of the segments of mixed ones, by bitmask n-gram filters.

One Bloom filter for each language, laid bit-sliced into one table of bytes: a slot holds a bit
for every language, so the AND of an n-gram's slots names at once all languages that have it.
The n-grams are words and the character 3- and 4-grams of words with their edges. A language's
score in a sentence is the number of its set bits over all n-grams, less the false positives
that its filter's fill makes likely. Names tell no language: words with a capital inside a
sentence and quoted titles are left out, unless the whole sentence is written in capitals.

The filters are fitted on a bounded sample: about ``sample_docs`` documents of each recognised
label, chosen by a hash of their key, each read whole. Wrong labels are outvoted: an
n-gram enters a filter where its rate in that language is within ``share`` of its highest rate.
Everything else covers all documents, in a map-only pass over the whole texts.

The distinct words of many sentences are hashed and probed together: their n-grams are windows of
one array of code points, a probe is an AND over table columns, and a sentence's scores are sums
over its words' rows. Texts are taken in portions of ``PORTION`` words, a longer text in several.

Sentences of one language in a row make a segment; sentences without evidence (numbers, names,
headings, fewer than ``LEAST_WORDS`` telling words, a lead under ``LEAST_LEAD``) join what surrounds
them and make none. A document's language is that of most words of its segments, its confidence
the share of those words times their mean confidence.

Defined results: null, empty and wordless texts have no segment; a tie between languages is no
evidence; a label in any usual spelling (name, two- or three-letter code, with region) counts as
that language, any other as none; rows without key are no records; an empty table gives an empty
result; repeated rows are each reported; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.session import bounded_sample, ship_package, spread

LANGS = ("en", "de", "fr", "es", "it", "pt", "nl")
#: Spellings of a label besides the two-letter code: three-letter codes and names.
SPELLINGS = {
    "en": "eng english anglais englisch ingles inglese engels",
    "de": "deu ger german deutsch allemand aleman tedesco duits",
    "fr": "fra fre french francais français franzosisch französisch frances francese frans",
    "es": "spa esp spanish espanol español castellano spanisch espagnol spagnolo spaans",
    "it": "ita italian italiano italienisch italien italiaans",
    "pt": "por portuguese portugues português portugiesisch portugais portoghese portugees",
    "nl": "nld dut dutch nederlands niederländisch neerlandais holandes olandese",
}
#: Function words that start every filter, so that a rare language is never without evidence.
SEED = {
    "en": "the of and to in was is for with that on as by from at which who had has were this his her it after before",
    "de": "der die das und in den von zu mit ist im nicht ein eine als auch auf für an wurde nach noch sich aus bei",
    "fr": "le la les de des et du un une dans en que qui pour par sur avec est été à au aux dont après avant",
    "es": "el la los las de del y en un una que con por para se su al es fue no más como después antes sin",
    "it": "il la lo gli di del della e in un una che con per si al è fu non più dei dopo prima nella alla",
    "pt": "o a os as de do da e em um uma que com por para se ao é foi não mais dos depois antes na no",
    "nl": "de het een van en in is dat op te met voor niet zijn aan er om door werd naar nog uit bij als ook",
}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_ESCAPED_TITLE = re.compile(r'\\"[^"\\\n]{1,80}\\"')
_TITLE = re.compile(r"[\"“„«][^\"“”„«»\n]{1,80}[\"”“»]")
_END = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[\r\n]+|(?<=[.!?…])(?=[A-ZÀ-Þ])")
_HEADING = re.compile(r"\s*(?:=+[^=\n]*=+|#+ .*|Title: .*)\s*", re.I)
K = 3
#: Weight of the n-grams of words that no filter has.
UNKNOWN_WORD = 0.2
#: Least number of words, names aside, that tell a sentence's language.
LEAST_WORDS = 3
#: Least corrected lead of a sentence's first language over its second.
LEAST_LEAD = 6.0


#: Words scored together, and distinct words whose scores are kept.
PORTION, MEMO = 200_000, 200_000
_P = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_numbers(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the words' n-grams and the place of the word of each; the words themselves come first."""
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    powers = np.ones(int(sizes.max(initial=1)), np.uint64)
    np.multiply.accumulate(np.full(len(powers) - 1, _P), out=powers[1:])
    whole = np.add.reduceat(codes * powers[ends[owner] - 1 - np.arange(len(codes))], ends - sizes) if len(words) else codes
    hashes, owners = [whole + np.uint64(1)], [np.arange(len(words))]
    for n in (3, 4):
        at = np.flatnonzero(ends[owner] - np.arange(len(codes)) >= n)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = h * _P + codes[at + i]
        hashes.append(h)
        owners.append(owner[at])
    return _mixed(np.concatenate(hashes)), np.concatenate(owners), len(words)


class LanguageFilters:
    """The bit-sliced filters; ``bits`` slots for each of K hashes."""

    def __init__(self, bits: int = 1 << 18):
        self.size = bits
        self.table = np.zeros((K, bits), np.uint8)
        self.false = np.zeros(len(LANGS))
        self._rows: dict[str, int] = {}
        self._scores = np.zeros((0, len(LANGS)))

    def __getstate__(self):
        return self.size, self.table, self.false

    def __setstate__(self, state):
        self.__init__(state[0])
        _, self.table, self.false = state

    def _slots(self, hashes: np.ndarray, i: int) -> np.ndarray:
        """Slots of the i-th hash function, by double hashing."""
        a, b = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
        return ((a + np.uint64(i) * b) % np.uint64(self.size)).astype(np.int64)

    def add(self, hashes: np.ndarray, masks: np.ndarray) -> None:
        for i in range(K):
            np.bitwise_or.at(self.table[i], self._slots(hashes, i), masks)

    def seal(self) -> "LanguageFilters":
        """Rates of false positives, from the filters' fill."""
        fill = np.array([[(self.table[i] >> j & 1).mean() for j in range(len(LANGS))] for i in range(K)])
        self.false = fill.prod(axis=0)
        return self

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        out = self.table[0][self._slots(hashes, 0)]
        for i in range(1, K):
            out &= self.table[i][self._slots(hashes, i)]
        return out

    def counts(self, words: Sequence[str]) -> np.ndarray:
        """By word and language, the n-grams in the filter, corrected; a word itself counts for three."""
        hashes, owner, n = gram_numbers(words)
        found = self.masks(hashes)
        weight = np.ones(len(hashes))
        weight[:n] = 3.0
        unknown = found[:n] & ((1 << len(LANGS)) - 1) == 0  # words of no language, perhaps names in small letters
        weight[unknown[owner]] *= UNKNOWN_WORD
        total = np.bincount(owner, weight, n)
        bits = [np.bincount(owner, weight * (found >> j & 1), n) for j in range(len(LANGS))]
        return (np.stack(bits, axis=1) - total[:, None] * self.false) / (1 - self.false)

    def score(self, sentences: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Language (-1: no evidence) and confidence of sentences, each given by its telling words."""
        if len(self._rows) > MEMO:
            self._rows, self._scores = {}, np.zeros((0, len(LANGS)))
        rows, known = self._rows, len(self._rows)
        ids = np.array([rows.setdefault(w, len(rows)) for words in sentences for w in words], np.int64)
        if len(rows) > known:
            self._scores = np.concatenate((self._scores, self.counts(list(rows)[known:])))
        sizes = np.fromiter((len(words) for words in sentences), np.int64, len(sentences))
        some = np.flatnonzero(sizes)
        lang, sure = np.full(len(sentences), -1), np.zeros(len(sentences))
        if not len(some):
            return lang, sure
        total = np.add.reduceat(self._scores[ids], (np.cumsum(sizes) - sizes)[some])
        top = np.argsort(-total, axis=1, kind="stable")[:, :2]
        best, second = np.take_along_axis(total, top, axis=1).T
        lead = best - np.maximum(second, 0.0)
        told = (best > 0) & (sizes[some] >= LEAST_WORDS) & (lead >= LEAST_LEAD)
        lang[some[told]], sure[some[told]] = top[told, 0], (lead / np.where(best > 0, best, 1.0))[told]
        return lang, sure


def telling_words(text: str) -> list[str]:
    """Lower-case words of a sentence that may tell its language."""
    if _HEADING.fullmatch(text):
        return []
    text = _TITLE.sub(" ", _ESCAPED_TITLE.sub(" ", text))
    found = _WORD.findall(text)
    most, other = 0.6 * sum(map(len, found)), [w for w in found if not w.islower()]
    if sum(map(len, other)) > most and sum(sum(map(str.isupper, w)) for w in other) > most:  # written in capitals
        return [w.lower() for w in found]
    return [w.lower() for i, w in enumerate(found) if not w[0].isupper() or (i == 0 and len(w) <= 4)]


def sentences(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in _END.finditer(text):
        if m.end() > at and text[at : m.end()].strip():
            out.append((at, m.end()))
        at = max(at, m.end())
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def segments_of(texts: Sequence[str | None], filters: LanguageFilters) -> list[list[dict]]:
    """For each text its stretches of sentences in one language, in order, with offsets and confidence."""
    out: list[list[dict]] = [[] for _ in texts]
    spans: list[tuple[int, int, int]] = []
    said: list[list[str]] = []

    def settle() -> None:
        for (t, a, b), words, lang, sure in zip(spans, said, *filters.score(said), strict=True):
            if lang < 0:
                continue
            n, mine = len(words), out[t]
            if mine and mine[-1]["lang"] == LANGS[lang]:
                last = mine[-1]
                last["confidence"] = (last["confidence"] * last["words"] + float(sure) * n) / (last["words"] + n)
                last["words"] += n
                last["end"] = b
            else:
                mine.append({"seg_no": len(mine), "lang": LANGS[lang], "start": a, "end": b, "words": n, "confidence": float(sure)})
        spans.clear()
        said.clear()

    held = 0
    for t, text in enumerate(texts):
        for a, b in sentences(text or ""):
            words = telling_words(text[a:b])
            spans.append((t, a, b))
            said.append(words)
            held += len(words)
            if held >= PORTION:
                settle()
                held = 0
    settle()
    return out


def segments(text: str | None, filters: LanguageFilters) -> list[dict]:
    return segments_of([text], filters)[0]


def language_of(found: Sequence[dict]) -> tuple[str | None, float | None]:
    """The language of most words of the segments (of equals the first), and its confidence."""
    words: dict[str, int] = {}
    sure: dict[str, float] = {}
    for s in found:
        words[s["lang"]] = words.get(s["lang"], 0) + s["words"]
        sure[s["lang"]] = sure.get(s["lang"], 0.0) + s["words"] * s["confidence"]
    if not words:
        return None, None
    best = max(words, key=words.__getitem__)
    return best, sure[best] / sum(words.values())


def label_of(label: Column) -> Column:
    """The language that a label names, or null."""
    plain = F.lower(F.trim(label))
    stem = F.regexp_replace(plain, r"[-_ (].*$", "")
    out = F.lit(None).cast("string")
    for code, names in SPELLINGS.items():
        known = [code, *names.split()]
        out = F.when(plain.isin(known) | stem.isin(known), F.lit(code)).otherwise(out)
    return out


def fit_filters(documents: DataFrame, key: str, text: str, lang: str, sample_docs: int = 400, share: float = 0.2, bits: int = 1 << 18) -> LanguageFilters:
    """Filters from a bounded sample of labelled documents."""
    labelled = documents.select(key, text, label_of(F.col(lang)).alias("_lang")).where(F.col("_lang").isNotNull() & F.col(text).isNotNull())
    sample = bounded_sample(labelled, key, sample_docs, "_lang").select("_lang", text).collect()
    return fit_on([(r[0], r[1]) for r in sample], share, bits)


def fit_on(sample: Sequence[tuple[str, str]], share: float = 0.2, bits: int = 1 << 18) -> LanguageFilters:
    seen = {code: Counter() for code in LANGS}
    size = Counter()
    for code, text in sample:
        words = Counter()
        for a, b in sentences(text):
            words.update(telling_words(text[a:b]))
        seen[code].update(words.keys())
        size[code] += 1
    numbers, rates = [], []
    for code in LANGS:
        known = list(seen[code])
        hashes, owner, _ = gram_numbers(known)
        order = np.lexsort((hashes, owner))  # a word has an n-gram once, however often it comes in it
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(owner[order]) != 0) | (hashes[order][1:] != hashes[order][:-1])
        each, inverse = np.unique(hashes[order[fresh]], return_inverse=True)
        n = np.bincount(inverse, np.array([seen[code][w] for w in known], float)[owner[order[fresh]]], len(each))
        kept = (n >= 2) | (size[code] < 20)
        numbers.append(each[kept])
        rates.append(n[kept] / max(size[code], 5))
    grams = np.unique(np.concatenate(numbers))
    table = np.zeros((len(grams), len(LANGS)))
    for j in range(len(LANGS)):
        table[np.searchsorted(grams, numbers[j]), j] = rates[j]
    within = (table > 0) & (table >= share * table.max(axis=1, keepdims=True))
    filters = LanguageFilters(bits)
    filters.add(grams, (within << np.arange(len(LANGS))).sum(axis=1).astype(np.uint8))
    for j, code in enumerate(LANGS):
        seeds = gram_numbers(SEED[code].split())[0]
        filters.add(seeds, np.full(len(seeds), 1 << j, np.uint8))
    return filters.seal()


_FOUND = T.StructType(
    [
        T.StructField(
            "segments",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("seg_no", T.IntegerType()),
                        T.StructField("lang", T.StringType()),
                        T.StructField("confidence", T.DoubleType()),
                        T.StructField("start", T.IntegerType()),
                        T.StructField("end", T.IntegerType()),
                        T.StructField("words", T.IntegerType()),
                    ]
                )
            ),
        ),
        T.StructField("lang", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)
_FOUND_ARROW = pa.struct(
    [
        (
            "segments",
            pa.list_(
                pa.struct(
                    [("seg_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())]
                )
            ),
        ),
        ("lang", pa.string()),
        ("confidence", pa.float64()),
    ]
)


def document_languages(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **fit) -> DataFrame:
    """``key, label, lang, confidence, segments, mislabelled``: the label's language, the text's own with
    its confidence, all segments, and whether the label names no language or a wrong one, or the text
    is in several."""
    spark = documents.sparkSession
    ship_package(spark)
    filters = spark.sparkContext.broadcast(fit_filters(documents, key, text, lang, **fit))

    @F.arrow_udf(_FOUND)
    def find(texts: pa.Array) -> pa.Array:
        rows = []
        for found in segments_of(texts.to_pylist(), filters.value):
            code, sure = language_of(found)
            rows.append({"segments": found, "lang": code, "confidence": sure})
        return pa.array(rows, _FOUND_ARROW)

    rows = spread(documents.select(key, text, lang).where(F.col(key).isNotNull()))
    # Filters on the result must not be pushed below it, where each would read the texts once more.
    found = rows.select(key, label_of(F.col(lang)).alias("label"), find.asNondeterministic()(F.col(text)).alias("_found"))
    found = found.select(key, "label", F.col("_found.lang").alias("lang"), F.col("_found.confidence").alias("confidence"), F.col("_found.segments").alias("segments"))
    first = F.get(F.col("segments.lang"), F.lit(0))
    wrong = F.col("label").isNull() | (F.size("segments") > 1) | (first != F.col("label"))
    return found.withColumn("mislabelled", (F.size("segments") > 0) & wrong)
