"""Defects of prompt and response pairs: a multi-label linear classifier on hashed n-grams.

Five defects are told apart: ``empty``, ``truncated``, ``refusal``, ``copy`` of the question and
``other_language``. The classifier is trained where it is used: a bounded sample of the pairs
(about ``sample_rows`` of each table, by a hash of their key) is taken as sound and spoilt on
purpose: cut at a random place, replaced by the question in a frame, by a refusal, by another
language, or by nothing, some by two of these at once; sound examples are also varied (small
letters, no final stop, question repeated before the answer, and swapped between pairs, which is
none of the five). Wordings are composed from pieces (``phrases``), foreign sentences from a
language's function words and made-up words. As the sample has true defects in it, a first model
drops those it finds and a second one is fitted without them. Each label's threshold is calibrated
by a model of its own, on pairs held back from it and spoilt with wordings and languages that it has
not seen; the model in use is then fitted on all of them.

Features of a response: n-grams of its sentences' words, where words outside the sample's common
vocabulary are masked; its last words; and of the pair: which words the response adds to the
question and where, whether its last word is the beginning of a word of the pair, what is left
open, how many function words are English, how many words and letters are strange, and whether it
denies that something is known or said. A sentence's share of the scores depends on the masked
sentence alone and is remembered, so scoring costs little more than masking. All rows of all tables
are scored, whole, in map-only passes.

Defined results: a null response is empty; a null question makes pair features vanish, nothing
else; a complete action object is judged by its reason, anything else as a whole; ``defects`` names
all defects of a pair, the greatest margin first, and ``defect`` that one; re-delivered rows count
once, rows without key not at all; an empty table gives an empty result, and where all are empty
nothing is fitted.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from collections import Counter
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm import phrases
from evidentia.llm.language import LANGS, SEED
from evidentia.session import bounded_sample, first_of_each, ship_package, spread

LABELS = ("empty", "truncated", "refusal", "copy", "other_language")
BITS = 15
SAMPLE_ROWS = 1500
#: Sampled rows that the first model gives a higher score for any defect are no training examples.
CLEAN_BELOW = -2.0
#: Held-back pairs of a label at which its threshold stands halfway between 0 and what they ask for.
TRUST = 30

_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+|[^\w\s]")
_MASKED = re.compile(r"\x02|" + _TOKEN.pattern)
_WRAPPED = re.compile(r"(?:^|:)[\s*]*(?:\[[^\[\]]*\]|<[^<>]*>|\([^()]*\)|\{[^{}]*\})[\s*]*$")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+(?=\S)|\n+")
_QUOTED = re.compile(r"[\"“][^\"“”]{1,80}[\"”]")
_FENCE = re.compile(r"^\s*```[a-z]*\s*|\s*```\s*$", re.I)
_SMALL = re.compile(r"(?<![^\W\d_'’])[^\W\dA-ZÀ-Þ_]{2,}")
_WORD_SMALL = re.compile(r"(?<![^\W\d_'’-])[^\W\dA-ZÀ-Þ_][^\W\d_]*(?:['’-][^\W\d_]+)*")
_NAME = re.compile(r"(?<=[^.!?] )[A-ZÀ-Þ][^\W\d_]{2,}")
_ENGLISH = frozenset(SEED["en"].split())
_OTHERS = frozenset(w for code in LANGS[1:] for w in SEED[code].split() if len(w) > 1) - _ENGLISH
_FRAME = frozenset("question answer the is asked you to find out i need my response final so here it".split())

_FRAME_ONLY = frozenset("the final answer response is a reply my result output so text".split())
_NOTHING = frozenset(("", "null", "none", "n/a", "na", "nan", "nil", "undefined", "unknown", "_", "empty", "/", "//"))

#: Languages whose sentences are held out of training.
HELD_LANGS = ("pt", "nl")
# Words that deny, words of knowing and saying, and names of what is read.
_DENIES = frozenset("not no never none nothing nobody neither nor cannot unable without lack lacks lacking refuse decline insufficient impossible unknown unclear unavailable unanswered unanswerable silent missing rather".split())
_KNOWS = frozenset("answer answered answering answers say said says tell told know known knows determine determined find found provide provided help respond response decide settle comment discuss idea clue sure certain speculate information data evidence detail enough conclusion".split())
_READS = frozenset("passage passages context document documents text source sources evidence material information excerpts".split())
_SELVES = frozenset("i we me my assistant model".split())


def tongues(said: Sequence[str]) -> tuple[int, int]:
    """How many words are English function words, and foreign ones."""
    return len([w for w in said if w in _ENGLISH]), len([w for w in said if w in _OTHERS])


def judged_text(target: str | None) -> str | None:
    """The reason of a complete action object, else the whole target."""
    if target is None:
        return None
    body = _FENCE.sub("", _FENCE.sub("", target)).strip()
    for _ in range(2):
        try:
            value = json.loads(body)
        except (ValueError, RecursionError):
            return target
        if isinstance(value, str):
            body = value
            continue
        if isinstance(value, dict) and "action" in value:
            reason = value.get("reason")
            return reason if isinstance(reason, str) or reason is None else json.dumps(reason)
        return target
    return target


def asked_question(content: str | None) -> str | None:
    """The question in a user message: the line after its marker, else the whole message."""
    if content is None:
        return None
    m = re.search(r"^\s*Question:\s*(.*)$", content, re.M | re.I)
    return (m.group(1) if m else content).strip()


@lru_cache(1 << 18)
def _hash(kind: str, *parts: str) -> int:
    return zlib.crc32("\x1f".join((kind, *parts)).encode()) & ((1 << BITS) - 1)


_RUN = re.compile(r"[^\W_]+")


def _words(text: str | None) -> list[str]:
    return _RUN.findall(text.lower()) if text else []


@lru_cache(1 << 12)
def _question_words(question: str | None) -> tuple[list[str], Counter]:
    words = _words(question)
    return words, Counter(words)


class Features:
    """Feature numbers of pairs, given the words that stay unmasked."""

    def __init__(self, vocabulary: frozenset[str]):
        self.vocabulary = vocabulary
        self._memo: dict[str, tuple[str, str]] = {}

    def __getstate__(self):
        return self.vocabulary

    def __setstate__(self, state):
        self.__init__(state)

    def _tags(self, w: str) -> tuple[str, str]:
        """The mask of a word inside a cased sentence, and elsewhere."""
        low = w.lower()
        if w == "\x02":
            tag = "<T>"
        elif w[0].isdigit():
            tag = f"<{min(len(w), 5)}>"
        elif not w[0].isalpha():
            tag = w
        elif w[0].isupper():
            return ("<N>" if low not in ("i", "i'm", "i'd", "i've", "ai") else low), (low if low in self.vocabulary else "<N>")
        else:
            return (low, low) if low in self.vocabulary else ("<u>", "<N>")
        return tag, tag

    def mask(self, sentence: str, cased: bool) -> list[str]:
        text = _QUOTED.sub(" \x02 ", sentence) if '"' in sentence or "“" in sentence else sentence
        memo, out = self._memo, []
        for w in _MASKED.findall(text):
            tags = memo.get(w)
            if tags is None:
                tags = self._tags(w)
                if len(memo) < 100_000:
                    memo[w] = tags
            if not cased or (not out and w[0].isupper()):
                tag = tags[1]  # at its beginning a capital tells nothing
            else:
                tag = tags[0]
            if tag == "<N>" and out and out[-1] == "<N>":
                continue
            out.append(tag)
        return out

    @staticmethod
    @lru_cache(1 << 16)
    def sentence(tokens: tuple[str, ...]) -> list[int]:
        out = set()
        for i, t in enumerate(tokens):
            out.add(_hash("1", t))
            if i:
                out.add(_hash("2", tokens[i - 1], t))
            if i > 1:
                out.add(_hash("3", tokens[i - 2], tokens[i - 1], t))
        return list(out)

    @staticmethod
    @lru_cache(1 << 16)
    def ending(tokens: tuple[str, ...]) -> list[int]:
        tail = ["^", *tokens[-4:]] if len(tokens) < 4 else list(tokens[-4:])
        return [_hash("e", *tail[-n:]) for n in range(1, len(tail) + 1)] + [_hash("stop", str(bool(tokens) and tokens[-1] in ".!?…"))]

    def pair(self, question: str | None, response: str) -> list[int]:
        (q, have), r = _question_words(question), _words(response)
        out = [_hash("n", str(min(len(r), 4)))]
        if not any(map(str.isalpha, response)):
            out.append(_hash("wordless"))
        bare = re.sub(r"[^\w\s/]", " ", re.sub(r"</?\w+>|```\w*", " ", response) if "<" in response or "`" in response else response).strip().lower()
        if len(r) < 8 and " ".join(w for w in bare.split() if w not in _FRAME_ONLY) in _NOTHING:
            out.append(_hash("placeholder"))
        elif r and all(w in _FRAME_ONLY for w in r):
            out.append(_hash("frame-only"))
        if len(r) < 6 and _WRAPPED.search(response):
            out.append(_hash("wrapped"))
        open_ones, core = dict(have), []
        for w in r:
            if open_ones.get(w, 0):
                open_ones[w] -= 1
            elif w not in _FRAME:
                core.append(w)
        covered = 1.0 - sum(open_ones.values()) / len(q) if q else 0.0
        before, after, repeats = r, [], 0
        if q and len(q) <= len(r) and q[0] in r:
            before, after, i = [], [], 0
            while i < len(r):
                if r[i] == q[0] and r[i : i + len(q)] == q:
                    i += len(q)
                    repeats += 1
                else:
                    (after if repeats else before).append(r[i])
                    i += 1
        left = [w for w in before + after if w not in _FRAME] if repeats else core
        out.append(_hash("cover", str(int(covered * 5)), str(min(len(left), 3)), str(min(repeats, 2))))
        out.append(_hash("added", str(min(len(core), 6))))
        if repeats:
            out.append(_hash("question-and-more" if left else "only-question"))
            # What stands around the question: known words are a frame, strange ones, numbers and yes or no an answer.
            tells = [w for w in before + after if w[0].isdigit() or w in ("yes", "no") or w not in self.vocabulary]
            out.append(_hash("around", "tells" if tells else "frame", str(min(len(before), 4)), str(min(len(after), 3))))
        if r:
            last = r[-1]
            if last not in have and any([w.startswith(last) for w in have]):
                out.append(_hash("begins-question-word"))
            if len(last) > 1 and r.count(last) == 1 and any([w.startswith(last) for w in r[:-1]]):
                out.append(_hash("begins-own-word"))
        stripped = response.rstrip()
        if stripped.count('"') % 2 or stripped.count("“") > stripped.count("”"):
            out.append(_hash("open-quote"))
        if stripped.count("(") > stripped.count(")"):
            out.append(_hash("open-bracket"))
        if stripped.count("{") > stripped.count("}") or stripped.count("[") > stripped.count("]"):
            out.append(_hash("open-object"))
        if stripped and stripped[-1] in ",;:(\"'“[{":
            out.append(_hash("ends-open", stripped[-1]))
        said = _words(_QUOTED.sub(" ", response)) if '"' in response or "“" in response else r
        english, other = tongues(said)
        out.append(_hash("tongue", str(int(5 * english / max(len(said), 1))), str(int(5 * other / max(len(said), 1)))))
        out.append(_hash("foreign" if other > english and other > 1 else "native"))
        small = [w for w in _SMALL.findall(response) if w not in have]
        strange = len([w for w in small if w not in self.vocabulary])
        out.append(_hash("strange", str(int(4 * strange / max(len(small), 1))), str(min(len(small), 4)), str(min(english, 2))))
        if not response.isascii():
            letters = [c for c in response if c.isalpha()]
            out.append(_hash("letters", str(int(4 * sum(c > "\u024f" for c in letters) / max(len(letters), 1)))))
        denies = len([w for w in r if w in _DENIES]) + response.count("n't") + response.count("n’t")
        if denies:
            known = set(r)
            kinds = "".join("1" if known & group else "0" for group in (_KNOWS, _READS, _SELVES))
            out += [_hash("denies", kinds), _hash("denies", kinds, str(min(len(r) // 4, 4))), _hash("denies-share", str(min(int(20 * denies / len(r)) if r else 9, 6)))]
            out.append(_hash("denies-names", str(min(len(_NAME.findall(response)), 2)), kinds))
        return out

    def parts(self, response: str) -> tuple[list[tuple[str, ...]], tuple[str, ...]]:
        """Masked sentences, and the last one."""
        cased = response != response.lower() and response != response.upper()
        masked = [tuple(self.mask(s, cased)) for s in _SENTENCE.split(response) if s and s.strip()]
        return masked, masked[-1] if masked else ()

    def of(self, question: str | None, response: str | None) -> list[int]:
        response = (response or "")
        sentences, last = self.parts(response)
        out = self.pair(question, response) + self.ending(last)
        for s in sentences:
            out += self.sentence(s)
        return out


_SUSPECT = frozenset(
    _hash(x)
    for x in ("foreign", "placeholder", "frame-only", "only-question", "wordless", "open-quote", "open-bracket", "open-object", "begins-question-word")
)


def plausible(features: Features, question: str | None, response: str) -> bool:
    """May the pair stand as a sound example? Not where its pair features alone speak against it."""
    return _SUSPECT.isdisjoint(features.pair(question, response))


class PairClassifier:
    """Linear scores with a calibrated threshold for each label."""

    def __init__(self, features: Features, weights: np.ndarray, bias: np.ndarray, thresholds: np.ndarray):
        self.features, self.weights, self.bias, self.thresholds = features, weights, bias, thresholds
        self._memo: dict[tuple, np.ndarray] = {}

    def __getstate__(self):
        return self.features, self.weights, self.bias, self.thresholds

    def __setstate__(self, state):
        self.__init__(*state)

    def _part(self, kind: str, tokens: tuple[str, ...]) -> np.ndarray:
        got = self._memo.get((kind, tokens))
        if got is None:
            numbers = self.features.sentence(tokens) if kind == "s" else self.features.ending(tokens)
            got = self.weights[numbers].sum(axis=0) if numbers else np.zeros(len(LABELS), np.float32)
            if len(self._memo) < 100_000:
                self._memo[kind, tokens] = got
        return got

    def scores(self, question: str | None, response: str | None) -> np.ndarray:
        response = response or ""
        sentences, last = self.features.parts(response)
        total = self.bias + self.weights[self.features.pair(question, response)].sum(axis=0) + self._part("e", last)
        for s in sentences:
            total = total + self._part("s", s)
        return total

    def defects(self, question: str | None, response: str | None) -> list[str]:
        """All defects, that of the greatest margin first."""
        if response is None:
            return ["empty"]
        margin = self.scores(question, response) - self.thresholds
        return [LABELS[j] for j in np.argsort(-margin, kind="stable") if margin[j] > 0]

    def defect(self, question: str | None, response: str | None) -> str | None:
        return next(iter(self.defects(question, response)), None)


def foreign_sentence(rng: random.Random, english: Sequence[str], names: Sequence[str], held: bool | None) -> str:
    """Function words of a language, words made up of English ones, and names; or a language nobody knows."""
    own = SEED[rng.choice([c for c in LANGS[1:] if held is None or (c in HELD_LANGS) == held])].split()
    out = []
    for _ in range(rng.randint(4, 14)):
        x = rng.random()
        out.append(rng.choice(own) if x < 0.5 else rng.choice(names) if x > 0.85 else phrases.disguised(rng, "x " + rng.choice(english))[2:])
    text = " ".join(out)
    if rng.random() < 0.35:
        text = phrases.disguised(rng, text)
    return text[:1].upper() + text[1:] + rng.choice((".", ".", ".", "", "!"))


def synthetic_pairs(sample: Sequence[tuple[str | None, str]], seed: int = 7, held: bool | None = False) -> list[tuple[str | None, str, tuple[int, ...]]]:
    """(question, response, labels) made of sound pairs; ``held`` takes held-out wordings and languages only, None all."""
    rng = random.Random(seed)
    out: list[tuple[str | None, str, tuple[int, ...]]] = []
    names = [m for q, _ in sample if q for m in re.findall(r"(?<!^)\b[A-ZÀ-Þ][^\W\d_]{3,}(?: [A-ZÀ-Þ][^\W\d_]{3,})?", q)] or ["Ada Lovelace"]
    english = sorted({w for _, r in sample for w in _SMALL.findall(r) if len(w) > 3} | {"passage", "answer", "evidence", "mention"})

    def fill(text: str, q: str | None) -> str:
        own = re.findall(r"\b[A-ZÀ-Þ][^\W\d_]{4,}", (q or "")[1:])
        while "{n}" in text:
            text = text.replace("{n}", rng.choice(own) if own and rng.random() < 0.7 else rng.choice(names), 1)
        return text

    def vary(text: str) -> str:
        x = rng.random()
        return text.lower() if x < 0.15 else text.upper() if x < 0.18 else text

    def foreign() -> str:
        return " ".join(foreign_sentence(rng, english, names, held) for _ in range(rng.choice((1, 1, 2))))

    for q, r in sample:
        text = r.strip()
        if not text:
            continue
        out.append((q, r, ()))
        x = rng.random()
        if x < 0.12 and text[-1:] in ".!":
            out.append((q, text[:-1], ()))
        elif x < 0.22:
            out.append((q, vary(text), ()))
        elif x < 0.30 and q:
            out.append((q, f"{q} {text}", ()))
        elif x < 0.34 and q:
            out.append((q, f"Question: {q} Answer: {text}", ()))
        elif x < 0.44:
            out.append((q, rng.choice(sample)[1], ()))  # swapped
        elif x < 0.66 and (own := re.findall(r"\b[A-ZÀ-Þ][^\W\d_]{4,}(?: [A-ZÀ-Þ][^\W\d_]{4,})?", (q or "")[1:])):
            other = rng.choice(names).split()[0]
            name = rng.choice((rng.choice(own), rng.choice(own), other, f"{other} {rng.choice(names)}", f"{other} O'{rng.choice(names).split()[0]}", str(rng.randint(1, 2020)), "yes"))
            out.append((q, rng.choice((name, name, f"Answer: {name}", f"Final answer: {name}", f"{name}.", f"{q} {name}", f"{q} {name}", f"{q} Answer: {name}")), ()))
        if rng.random() < 0.3:
            out.append((q, phrases.sound(rng, names, held), ()))
        # Cut inside: neither at a sentence's end nor before its stop.
        for _ in range(2):
            cut = rng.randint(1, max(1, len(text) - 2)) if len(text) > 3 else 0
            piece = text[:cut]
            if rng.random() < 0.25 and " " in piece:
                piece = piece[: piece.rindex(" ") + rng.randint(0, 1)]
            if rng.random() < 0.1:
                piece += rng.choice((' "', " (", " the", " and"))
            body = piece.rstrip()
            at_end = body[-1:] in ".!?" or (body and text[len(body) : len(body) + 1] in ".!?,") or body.rstrip("\"')") == text.rstrip(".!?\"')")
            # What is left out must hold more than names: within a last name a cut cannot be told
            # from a missing stop, unless the name is known from the question.
            rest = re.sub(r"^\w+", "", text[len(body) :])
            more = re.search(r"(?:^|[\s(\"'])[a-zß-ÿ0-9]", rest) is not None
            last = body.split()[-1].strip("\"'(") if body.split() else ""
            known = len(last) > 2 and any(w != last and w.startswith(last) for w in (q or "").split())
            said = re.search(r"(?:^|\s)[a-zß-ÿ]", body) is not None or body[-1:] in "\"("
            if len(body) >= 2 and not at_end and (known or (more and said)):
                out.append((q, piece, (1,)))
        for _ in range(rng.choice((0, 1, 1, 2))):
            out.append((q, vary(fill(phrases.refusal(rng, held), q)), (2,)))
        if rng.random() < 0.35 and q:
            out.append((q, vary(phrases.copy_of(rng, q, held)), (3,)))
        if rng.random() < 0.55:
            out.append((q, vary(foreign()), (4,)))
        if rng.random() < 0.3:
            out.append((q, phrases.hollow(rng, held), (0,)))
        if rng.random() < 0.25:
            step = {"action": rng.choice(("commit", "retrieve", "refine", "decompose"))}
            if rng.random() < 0.6:
                step[rng.choice(("query", "answer"))] = rng.choice(names)
            step |= {"analysis": rng.choice(sample)[1], "reason": text}
            frame = json.dumps(step, ensure_ascii=rng.random() < 0.3, indent=rng.choice((None, 1)))
            out.append((q, frame[: rng.randint(12, len(frame) - 3)], (1,)))
        if rng.random() < 0.06:  # two defects at once
            part, label = rng.choice(((foreign(), 4), (fill(phrases.refusal(rng, held), q), 2)))
            if len(words := part.split(" ")) > 5:
                cut = " ".join(words[: rng.randint(4, len(words) - 1)])
                out.append((q, cut + rng.choice((" (", " the", ",", ' "')), (label, 1)))
    return out


def _fit(rows: list[list[int]], labels: Sequence[tuple[int, ...]], epochs: int = 8, rate: float = 0.8, seed: int = 3, size: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression for each label, by AdaGrad on mini-batches."""
    rng = np.random.default_rng(seed)
    weights = np.zeros((1 << BITS, len(LABELS)), np.float32)
    bias = np.full(len(LABELS), -2.0, np.float32)
    seen = np.full_like(weights, 1e-2)
    seen_bias = np.full_like(bias, 1e-2)
    targets = _targets(labels)
    flat = [np.array(r, np.int64) for r in rows]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), size):
            batch = order[i : i + size]
            sizes = np.array([len(flat[b]) for b in batch])
            index = np.concatenate([flat[b] for b in batch])
            owner = np.repeat(np.arange(len(batch)), sizes)
            logits = np.add.reduceat(weights[index], np.concatenate(([0], np.cumsum(sizes)[:-1])))  # every row has features
            error = 1 / (1 + np.exp(-np.clip(logits + bias, -30, 30))) - targets[batch]
            unique, inverse = np.unique(index, return_inverse=True)
            step = np.stack([np.bincount(inverse, error[owner, j], len(unique)) for j in range(len(LABELS))], axis=1).astype(np.float32)
            step /= len(batch)
            step += 1e-6 * weights[unique]
            seen[unique] += step * step
            weights[unique] -= rate * step / np.sqrt(seen[unique]) * 0.3
            mean = error.mean(axis=0)
            seen_bias += mean * mean
            bias -= rate * mean / np.sqrt(seen_bias) * 0.1
    return weights, bias


def _targets(labels: Sequence[tuple[int, ...]]) -> np.ndarray:
    out = np.zeros((len(labels), len(LABELS)), np.float32)
    for i, of in enumerate(labels):
        out[i, list(of)] = 1.0
    return out


def train(sample: Sequence[tuple[str | None, str | None]], seed: int = 7, held_out: bool = False) -> PairClassifier | None:
    """A classifier from pairs of which most are sound; ``held_out`` gives the one that the thresholds
    come from, which has not seen the held-out wordings and languages."""
    pairs = [(q, r) for q, r in sample if r and r.strip()]
    counts = Counter(w for _, r in pairs for w in {m.group() for m in _WORD_SMALL.finditer(r)})
    base = {w for w, n in counts.items() if n >= max(3, len(pairs) // 200)}
    features = Features(frozenset(base | phrases.spoken_words() | _ENGLISH | _OTHERS))
    pairs = [(q, r) for q, r in pairs if plausible(features, q, r)]
    if not pairs:
        return None
    # Two first models, of each half of the sample, find true defects among the other half: a model
    # that has learnt a defective pair as a sound one would not.
    kept: list[tuple[str | None, str]] = []
    for half in (0, 1):
        made = synthetic_pairs(pairs[half::4], seed + half, held=None)
        weights, bias = _fit([features.of(q, r) for q, r, _ in made], [x for *_, x in made], 3)
        first = PairClassifier(features, weights, bias, np.zeros(len(LABELS), np.float32))
        kept += [(q, r) for q, r in pairs[1 - half :: 2] if (first.scores(q, r) < CLEAN_BELOW).all()]
    pairs = kept or pairs
    # Thresholds: a model that has seen neither these pairs nor these wordings and languages.
    kept = [p for i, p in enumerate(pairs) if i % 5] or pairs
    made = synthetic_pairs(kept, seed + 1)
    weights, bias = _fit([features.of(q, r) for q, r, _ in made], [x for *_, x in made], 6)
    unseen = synthetic_pairs(pairs[::5], seed + 2, held=True)
    logits = np.array([bias + weights[features.of(q, r)].sum(axis=0) for q, r, _ in unseen])
    thresholds = _calibrated(logits, _targets([x for *_, x in unseen]))
    if held_out:
        return PairClassifier(features, weights, bias, thresholds)
    made = synthetic_pairs(pairs, seed + 3, held=None)
    weights, bias = _fit([features.of(q, r) for q, r, _ in made], [x for *_, x in made])
    return PairClassifier(features, weights, bias, thresholds)


def _calibrated(logits: np.ndarray, targets: np.ndarray, slack: float = 0.004) -> np.ndarray:
    """For each label, of the thresholds with (nearly) the best F1 on held-back pairs the one nearest to 0."""
    out = np.zeros(len(LABELS), np.float32)
    for j in range(len(LABELS)):
        value = np.sort(logits[:, j])[::-1]
        true = targets[np.argsort(-logits[:, j]), j].cumsum()
        f1 = 2 * true / (np.arange(1, len(value) + 1) + max(1, targets[:, j].sum()))
        good = np.flatnonzero(f1 >= f1.max() - slack)
        below = np.append(value[1:], value[-1] - 1)
        middle = (value[good] + below[good]) / 2
        # Nothing between two neighbouring scores is told apart: 0 itself where it lies between them.
        middle = np.where((below[good] < 0) & (value[good] >= 0), 0.0, middle)
        n = targets[:, j].sum()
        out[j] = middle[np.argmin(np.abs(middle))] * n / (n + TRUST)
    return out


def pair_defects(sources: dict[str, tuple[DataFrame, str, Column, Column]], sample_rows: int = SAMPLE_ROWS, actions: frozenset[str] = frozenset()) -> DataFrame:
    """``tbl, row_id, defect`` of each defective pair.

    ``sources`` names each table's rows, key, question and response; responses of the tables in
    ``actions`` are action objects.
    """
    spark = next(iter(sources.values()))[0].sparkSession
    ship_package(spark)
    prepared = {
        name: df.where(F.col(key).isNotNull()).select(F.col(key).alias("row_id"), question.alias("question"), response.alias("response"))
        for name, (df, key, question, response) in sources.items()
    }

    def read(name: str, response: str | None) -> str | None:
        return judged_text(response) if name in actions else response

    sample: list[tuple[str | None, str | None]] = []
    for name, rows in prepared.items():
        taken = sorted(bounded_sample(rows, "row_id", sample_rows).collect(), key=lambda r: str(r[0]))
        sample += [(asked_question(r[1]) if name in actions else r[1], read(name, r[2])) for r in taken]
    model = train(sample)
    held = spark.sparkContext.broadcast(model)
    out = None
    for name, rows in prepared.items():

        def judge(question: pa.Array, response: pa.Array, name=name) -> pa.Array:
            found = held.value
            both = zip(question.to_pylist(), response.to_pylist(), strict=True)
            if name in actions:
                both = ((asked_question(q), judged_text(r)) for q, r in both)
            if found is None:
                return pa.array(["empty" if not (r or "").strip() else None for _, r in both], pa.string())
            return pa.array([found.defect(q, r) for q, r in both], pa.string())

        udf = F.arrow_udf(_typed(judge), T.StringType()).asNondeterministic()  # its filter must not be pushed below it and judge twice
        judged = spread(rows).select("row_id", udf("question", "response").alias("defect")).where(F.col("defect").isNotNull())
        part = first_of_each(judged, "row_id").select(F.lit(name).alias("tbl"), "row_id", "defect")
        out = part if out is None else out.unionByName(part)
    return out


def _typed(judge):
    def run(question: pa.Array, response: pa.Array) -> pa.Array:
        return judge(question, response)

    return run
