"""Plug points for models: a provider maps batches of texts to score columns, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_scores(df: DataFrame, inputs: list[str], score: Callable[[pd.DataFrame], pd.DataFrame], schema: str, load: Callable | None = None, batch: int = 32) -> DataFrame:
    """df with the columns of schema, computed by score over batches of the input columns.

    load, if given, is called once per task and its result passed to score as a second argument, so that a model is
    read once and not for every batch. Rows keep their number; the provider may not drop or repeat any.
    """
    names = [p.strip().split(" ")[0] for p in schema.split(",")]

    def run(batches):
        model = load() if load else None
        for b in batches:
            parts = [score(b[inputs].iloc[i : i + batch].reset_index(drop=True), *([model] if load else [])) for i in range(0, len(b), batch)]
            got = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=names)
            if len(got) != len(b):
                raise ValueError("a provider must give one row per input row")
            yield pd.concat([b.reset_index(drop=True), got[names]], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{fields}, {schema}")


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def softmax_column(logits):
    """The same on an array column, without Python."""
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def sigmoid_column(x):
    return 1 / (1 + F.exp(-x))


def argmax_label(probabilities, labels: list[str]):
    """The label of the highest probability, the first of equals."""
    at = F.array_position(probabilities, F.array_max(probabilities)).cast("int")
    return F.element_at(F.array(*[F.lit(x) for x in labels]), at)
