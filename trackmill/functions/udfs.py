"""Plugging outside models in, a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_with(df: DataFrame, load: Callable[[], Callable], features: Sequence[str], name: str = "score") -> DataFrame:
    """Adds `name` from load()(matrix) -> scores; load runs once per task."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        predict = load()
        for cols in batches:
            yield pd.Series(np.asarray(predict(np.column_stack([c.to_numpy(float) for c in cols])), dtype=float))

    return df.withColumn(name, run(*[F.col(c) for c in features]))


def embed_with(df: DataFrame, load: Callable[[], Callable], key: Sequence[str], payload: str) -> DataFrame:
    """(key…, emb) from load()(list of payloads) -> list of vectors or None."""
    keys = list(key)
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keys).dtypes) + ", emb array<double>"

    def run(batches):
        embed = load()
        for pdf in batches:
            vecs = embed(pdf[payload].tolist())
            yield pdf[keys].assign(emb=[None if v is None else [float(x) for x in v] for v in vecs])

    return df.select(*keys, payload).mapInPandas(run, schema)


def rate_with(df: DataFrame, load: Callable[[], Callable], key: Sequence[str], payload: str) -> DataFrame:
    """(key…, answer, error): one rating per row; a failing row gives a null answer and its error."""
    keys = list(key)
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keys).dtypes) + ", answer string, error string"

    def run(batches):
        rate = load()
        for pdf in batches:
            answers, errors = [], []
            for value in pdf[payload]:
                try:
                    answers.append(rate(value))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a bad row must not fail the job
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf[keys].assign(answer=answers, error=errors)

    return df.select(*keys, payload).mapInPandas(run, schema)
