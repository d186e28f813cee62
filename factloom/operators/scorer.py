"""Models as scorers: one interface, loaded once per worker, with deterministic stand-ins (U-02, U-03, V-04)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.lexicon import SCOPES
from factloom.operators.scope import ACTIVITIES
from factloom.runtime import once

BATCH = 16


class Scorer(Protocol):
    """Scores of texts: a row of `size` numbers for each, from its whole text."""

    size: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class ActivityScorer:
    """Stand-in for the scope classifier: 1 for Other, twice the number of a scope's activity words for the scope."""

    size = len(SCOPES)

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        out[:, 0] = 1.0
        for k, text in enumerate(texts):
            low = text.lower()
            for scope, words in ACTIVITIES:
                out[k, SCOPES.index(scope)] = 2.0 * sum(w in low for w in words)
        return out


class LetterEmbedder:
    """Stand-in for the sentence encoder: mean over all words of their letter counts; a text without words is zeros."""

    letters = "abcdefghijklmnop"
    size = len(letters)

    def __call__(self, texts: list[str]) -> np.ndarray:
        low = [t.lower() for t in texts]
        return np.asarray([[t.count(c) / max(1, len(t.split())) for c in self.letters] for t in low], float).reshape(len(texts), self.size)


def scored(df: DataFrame, make: Callable[[], Scorer], key: str, text: str = "text", name: str = "scores") -> DataFrame:
    """(key, text, name array<double>) of the rows with a text. `make` loads the model; each worker calls it once and keeps
    the model between tasks. Texts go to it in small batches; empty ones are scored like any other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once(("scorer", make.__module__, make.__qualname__), make)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            parts = [model(texts[k : k + BATCH]) for k in range(0, len(texts), BATCH)]
            flat = pa.array(np.concatenate(parts).ravel() if parts else np.zeros(0), pa.float64())
            ends = pa.array(np.arange(len(texts) + 1) * model.size, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, flat)], [key, text, name])

    narrow = df.select(F.col(key), F.col(text)).filter(F.col(text).isNotNull())
    kind = narrow.schema[key].dataType.simpleString()
    return narrow.mapInArrow(run, f"{key} {kind}, {text} string, {name} array<double>")
