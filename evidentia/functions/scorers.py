"""Model calls as scorers: one interface, deterministic defaults, models plugged in from outside.

A scorer maps columns to a column. The defaults are column expressions; a model is wrapped as an
iterator UDF over Arrow batches, so that it is loaded once for each Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.text import official_form, overlap, words

Scorer = Callable[..., Column]
_REGISTRY: dict[str, Scorer] = {}


def register(name: str, scorer: Scorer) -> None:
    _REGISTRY[name] = scorer


def scorer(name: str) -> Scorer:
    if name not in _REGISTRY:
        raise KeyError(f"no scorer {name!r}; known: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name]


def coverage_entailment(premise: Column, hypothesis: Column) -> Column:
    """Share of the hypothesis's words that the premise has."""
    h, p = words(official_form(hypothesis)), words(official_form(premise))
    return F.when(F.size(h) == 0, F.lit(0.0)).otherwise(overlap(h, p) / F.size(h))


def model_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Scorer:
    """Wraps ``load() -> score(premises, hypotheses)``; ``load`` runs once for each worker."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for premise, hypothesis in batches:
            yield pd.Series(model(premise.fillna("").tolist(), hypothesis.fillna("").tolist()), dtype="float64")

    return lambda premise, hypothesis: run(premise, hypothesis)


register("coverage", coverage_entailment)
