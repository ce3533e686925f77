"""Spoilt responses for training, composed from pieces.

A wording is put together from one piece of each slot of a pattern, so that a few hundred words make
many thousand wordings. Every fifth piece of a slot is held out: ``held`` wordings use held-out pieces
wherever a slot has any, so that thresholds and accuracy are measured on wordings (and, for other
languages, on whole languages) that the measured classifier has not seen.
"""

from __future__ import annotations

import random
import re
from collections.abc import Sequence

# Pieces of refusals.
_PREFACE = ("", "", "", "", "Sorry, ", "Unfortunately, ", "I'm sorry, but ", "I apologize, but ", "I apologize, however ", "Honestly, ", "Regrettably, ", "I'm afraid ", "As an AI language model, ", "My apologies, ", "To be honest, ", "As an assistant, ")
_SELF = ("I", "I", "I", "I", "we", "this assistant", "this model")
_CANNOT = ("cannot", "can't", "am unable to", "am not able to", "could not", "do not know how to", "won't", "must decline to", "would rather not", "refuse to", "am not allowed to", "decline to", "prefer not to", "am not in a position to", "will not", "don't feel able to", "am not permitted to", "have no way to", "couldn't", "see no way to")
_DO = ("answer", "answer", "help with", "respond to", "provide an answer to", "comment on", "determine", "give an answer to", "say anything about", "assist with", "speculate about", "resolve", "settle", "decide", "address", "work out", "reply to", "offer an answer to", "tell you", "identify", "discuss")
_IT = ("", "this", "that question", "this request", "it", "the question", "this one", "your question", "this query", "that", "such questions")
_FOR = ("", "", "", "", " from the given passages", " based on the context", " with the information provided", " without more context", " without further information", " here", " based on the given passages", " at this point", " because the passages do not mention it", " since the evidence is missing", " as the sources are silent", ", sorry", " with what I was given")
_SOURCES = ("The passages", "The context", "The documents", "The given text", "The evidence", "The sources", "The provided passages", "The material", "The excerpts", "The retrieved text")
_SILENT = ("do not say", "does not contain the answer", "do not mention this", "does not give enough information", "provide no answer", "is silent on this", "contain nothing about it", "do not tell", "offers no answer", "leave this open", "lacks the needed information", "says nothing of the kind")
_NONE = ("There is", "I see", "I have", "I find", "There was", "There seems to be")
_LACK = ("no information", "not enough information", "insufficient evidence", "no answer", "no way to tell", "nothing", "no data", "too little context", "no indication", "no clue", "no evidence", "not sufficient detail")
_ABOUT = ("", "", " in the passages", " about this", " to answer the question", " on this", " to decide", " in the context", " available", " to go on", " for an answer", " here", " for a conclusion")
_NOT_KNOWN = ("I don't know", "I do not know", "I'm not sure", "I have no idea", "No idea", "Not sure", "I am not certain", "Cannot say", "Can't tell", "I couldn't say", "No clue", "I can't say", "Unknown to me")
_WHAT = ("", "", "", " who that would be", " the answer", " that", " what the answer is", " for certain", ", sorry", " which one it is", " about that", " whom that means")
_IMPOSSIBLE = ("It is not possible", "It is impossible", "There is no way", "It isn't possible", "It is not feasible", "It was not possible")
_TO_TELL = ("to determine the answer", "to answer this", "to say", "for me to tell", "to find out", "for me to answer", "to know", "to work this out", "to settle this", "to decide from the text")
_PASSIVE = ("The answer", "This", "The question", "That", "An answer", "This question")
_BE_NOT = ("cannot be determined", "cannot be answered", "is not available", "is unknown", "could not be found", "can't be known", "is not given", "cannot be given", "remains unclear", "is not stated", "can't be worked out", "is impossible to determine")
_NO_ONE = ("No answer", "No reply", "No statement", "Nothing definite", "No conclusion", "No name", "No response")
_ANSWERING = ("answering", "answering this", "a reply", "saying more", "any answer", "an answer")
_WOULD_TAKE = ("would require", "needs", "would take", "calls for", "would mean", "requires")
_WHAT_LACKS = ("information I lack", "data I do not have", "knowledge that I lack", "guessing", "evidence that is missing", "more than I know", "speculation")
_CAN_BE = ("can be given", "is possible", "can be offered", "can be said", "could be derived", "can be drawn", "is offered")
_SHORT = ("Insufficient evidence", "Not enough information", "Unable to answer", "Cannot answer", "No answer found", "Unable to determine", "Not enough evidence", "Cannot be determined", "Cannot determine", "Insufficient context", "Not answerable", "Unanswerable")
_NO_WISH = ("I'd rather not answer this", "I must decline", "I would prefer not to answer", "I'm not comfortable answering that", "That is something I will not discuss", "I won't speculate", "I refuse", "I'd prefer to leave this open", "I will pass on this", "I choose not to answer", "I do not wish to respond", "I'd rather leave that unanswered", "I will skip this one")
_NO_ACCESS = ("I do not have access to that information", "I have no access to such data", "I lack the information for that", "That information is not available to me", "I was not given that information", "my training does not cover this", "I do not have enough data", "that goes beyond what I can do", "I have no knowledge of this")
_AFTER = ("", "", "", "", "", " Please consult another source.", " The question concerns {n}.", " Passages on {n} might help.", " I hope you understand.", " Please ask about {n} again.", " Try asking something else.", " More about {n} would be needed.", " Please give more context.")
# Pieces of copies.
_BEFORE_COPY = ("", "", "", "Question: ", "The question is: ", "You asked: ", "I need to answer: ", "To find out: ", "Q: ", "> ", "Answer: ", "You want to know: ", "The user asks: ", "I was asked: ", "So the question is this: ", "Let me restate the question: ", "The task is: ", "We are asked: ", "Repeating the question: ", "Here is what is asked: ", "Your question was: ", "In other words: ", "Let us consider: ", "The request reads: ")
_AFTER_COPY = ("", "", "", "", "", "...", " ?", "\n", " That is the question.", " This is what is asked.", "!", " Hm.", " Good question.")
# Pieces of empty responses.
_EMPTY = ("", " ", "\n", "...", "…", "-", "--", "null", "None", "N/A", "n/a", "nan", '""', "''", "{}", "[]", "<answer></answer>", "​", ".", "?", "undefined", "```\n```", "<|endoftext|>", "()", "_", "*", "nil", "NULL", "<empty>", "(none)", "[blank]", "(no response)", "TBD", "---", "[no output]", "<blank>", "(empty)", "n.a.", "N.A.", "<no text>", "[nothing]", "***", "#", ";")
_HOLLOW_FRAME = ("Answer", "The answer", "Final answer", "A", "The answer is", "Response", "My answer", "My answer is", "The final answer is", "Reply", "Result", "Output", "So the answer is", "The response is")

# Pieces of sound responses that deny something, or are short.
_NOT_BUT = ("not {n} but {m}", "{n}, not {m}", "{n} rather than {m}", "{n} and not {m}", "not {m}, but {n}", "neither {m} nor its founder but {n}", "{n}", "the council of {n}", "the town of {n}", "the house of {n}", "{n} in no other source than this")
_IT_IS = ("", "", "", "It was ", "The answer is ", "That was ", "This is ", "Answer: ", "My answer is ", "It is ")
_YES_NO = ("No", "Yes", "no", "yes", "No, {n}", "Yes, {n}", "No, it was {n}", "No, not {m}", "No, that was {n}", "Nobody but {n}", "Never before {n}")
_ONE_READS = ("The first passage", "One passage", "Neither of the first two passages", "The second source", "The top passage", "No passage before the last", "The older text")
_MISSES = ("does not mention {m}", "says nothing of {m}", "doesn't name {m}", "lacks the year", "gives no date", "leaves out {m}", "is silent on {m}")
_BUT_ONE = (", but the second names {n}", ", yet the other gives {n}", ", so {n} rests on one source", ", while another says {n}", ", hence {n} stays the answer", ", but the next one confirms {n}")
_ON = ("I will search again for {n}", "I need another passage about {n}", "I look for {n} once more", "I ask about {n} next", "I retrieve more on {n}", "I should read further about {n}", "I must check {n} first", "Another query for {n} is needed", "I split the question at {n}")
_WEAK = (" because the support is weak", " since the evidence is thin", " as no passage confirms it yet", " because the claim is not grounded", " since confidence is low", ", the answer being unsure", " because the sources disagree", "", " as nothing supports the claim so far")
_SOUND: tuple[tuple[tuple[str, ...], ...], ...] = ((_IT_IS, _NOT_BUT), (_YES_NO,), (_ONE_READS, (" ",), _MISSES, _BUT_ONE), (_ON, _WEAK))

_REFUSALS: tuple[tuple[tuple[str, ...], ...], ...] = (
    (_PREFACE, _SELF, (" ",), _CANNOT, (" ",), _DO, (" ",), _IT, _FOR),
    (_PREFACE, _SELF, (" ",), _CANNOT, (" ",), _DO, (" ",), _IT, _FOR),
    (_PREFACE, _SELF, (" ",), _CANNOT, (" ",), _DO, (" ",), _IT, _FOR),
    (_PREFACE, _SELF, (" ",), _CANNOT, (" ",), _DO, (" ",), _IT, _FOR),
    (_PREFACE, _SELF, (" ",), _CANNOT, (" ",), _DO, (" ",), _IT, _FOR),
    (_PREFACE, _SOURCES, (" ",), _SILENT),
    (_SOURCES, (" ",), _SILENT, (", so ", " and ", ", hence ", "; ", ", therefore "), ("I", "we"), (" ",), _CANNOT, (" ",), _DO, (" ",), _IT),
    (_PREFACE, _NONE, (" ",), _LACK, _ABOUT),
    (_PREFACE, _NOT_KNOWN, _WHAT),
    (_PREFACE, _IMPOSSIBLE, (" ",), _TO_TELL),
    (_PREFACE, _PASSIVE, (" ",), _BE_NOT, _FOR),
    (_SHORT, ("", "", " from context", " from the passages", " here", " based on the evidence")),
    (tuple(t.lower() for t in _SHORT),),
    (_PREFACE, _NO_ONE, (" ",), _CAN_BE, _FOR),
    (_PREFACE, _ANSWERING, (" ",), _WOULD_TAKE, (" ",), _WHAT_LACKS),
    (_PREFACE, _NO_WISH),
    (_PREFACE, _NO_ACCESS),
)


def piece(rng: random.Random, slot: Sequence[str], held: bool | None) -> str:
    """A piece of a slot: of every fifth one where held out, of the others where not, any for None."""
    if held is None:
        return rng.choice(slot)
    out = slot[4::5]
    if held and out:
        return rng.choice(out)
    return rng.choice([p for i, p in enumerate(slot) if i % 5 != 4] or slot)


def refusal(rng: random.Random, held: bool | None) -> str:
    text = "".join(piece(rng, slot, held) for slot in rng.choice(_REFUSALS))
    # After a preface that goes on, the sentence's first word is small unless it is "I".
    text = re.sub(r"^((?:.*, |.*but |.*however |I'm afraid ))([A-Z])(?=[a-z])", lambda m: m.group(1) + m.group(2).lower(), text, count=1)
    text = text.rstrip()
    small = text in {t.lower() for t in _SHORT}
    text = re.sub(r"\b(we|this assistant|this model) am\b", lambda m: m.group(1) + (" are" if m.group(1) == "we" else " is"), text)
    if small:
        return text
    return text[:1].upper() + text[1:] + rng.choice((".", ".", ".", "", "!")) + piece(rng, _AFTER, held)


def sound(rng: random.Random, names: Sequence[str], held: bool | None) -> str:
    """A sound response that denies something or is short."""
    text = "".join(piece(rng, slot, held) for slot in rng.choice(_SOUND)).replace("{n}", rng.choice(names)).replace("{m}", rng.choice(names))
    return text + rng.choice((".", ".", "")) if len(text.split()) < 5 else text + "."


def copy_of(rng: random.Random, question: str, held: bool | None) -> str:
    q = question if rng.random() < 0.7 else rng.choice((question.rstrip("?") + ".", question.rstrip("?"), question[:1].lower() + question[1:]))
    body = rng.choice((q, q, q, f"{q} {q}", f'"{q}"', f"**{q}**"))
    return piece(rng, _BEFORE_COPY, held) + body + piece(rng, _AFTER_COPY, held)


def hollow(rng: random.Random, held: bool | None) -> str:
    x = rng.random()
    if x < 0.5:
        return piece(rng, _EMPTY, held)
    frame = piece(rng, _HOLLOW_FRAME, held)
    return rng.choice((f"{frame}:", f"{frame}: ", f'{frame}: ""', f"**{frame}:** ", f"{frame}: {piece(rng, _EMPTY, held)}", frame))


def spoken_words() -> frozenset[str]:
    """Small letters of all words of the pieces."""
    slots = {slot for pattern in (*_REFUSALS, *_SOUND) for slot in pattern} | {_AFTER, _BEFORE_COPY, _AFTER_COPY, _HOLLOW_FRAME, _EMPTY}
    return frozenset(w for slot in slots for p in slot for w in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", re.sub(r"\{.\}", "", p).lower()))


#: Letters of other alphabets, by sound, for sentences of languages that no sample has.
_ALPHABETS = (
    dict(zip("abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопкрстувшызю", strict=False)),
    dict(zip("abcdefghijklmnopqrstuvwxyz", "αβγδεφγηιϊκλμνοπκρστυβωξψζ", strict=False)),
)


def disguised(rng: random.Random, sentence: str) -> str:
    """A foreign sentence as one of a language that nobody knows: its vowels and its consonants change
    places among themselves throughout, or all its letters those of another alphabet; names stay."""
    if rng.random() < 0.3:
        letters = rng.choice(_ALPHABETS)
    else:
        letters = {}
        for group in ("aeiouäöå", "bcdfghjklmnpqrstvwxyz"):
            other = list(group)
            rng.shuffle(other)
            letters |= dict(zip(group, other, strict=True))
    return " ".join(w if w[:1].isupper() and i else "".join(letters.get(c, c) for c in w.lower()) for i, w in enumerate(sentence.split(" ")))
