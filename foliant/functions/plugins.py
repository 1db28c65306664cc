"""Model ports: embedding, reranking and generation are functions the caller supplies."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import tokens


def embedder(load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[Column], Column]:
    """Wrap a model as an iterator pandas UDF; ``load`` runs once per worker process."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(list(np.asarray(model(texts.tolist()), dtype=np.float32)))

    return embed


def valid_embedding(vector: Column, dimension: int) -> Column:
    """Dimension as declared, every value finite, unit length."""
    finite = F.forall(
        vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    )
    length = F.aggregate(
        vector, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")
    )
    return F.coalesce(
        (F.size(vector) == dimension) & finite & (F.abs(F.sqrt(length) - 1) < 1e-3), F.lit(False)
    )


def pair_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]]):
    """Wrap a reranker as a pandas UDF over (query, text)."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, texts in batches:
            yield pd.Series(
                [float(s) for s in model(queries.tolist(), texts.tolist())], dtype="float64"
            )

    return score


def overlap_score(query: Column, text: Column) -> Column:
    """Deterministic stand-in for a reranker: share of the query's words found in the text."""
    wanted = F.array_distinct(tokens(query))
    found = F.size(F.array_intersect(wanted, tokens(text)))
    return F.when(F.size(wanted) > 0, found / F.size(wanted)).otherwise(F.lit(0.0))


def generate(
    requests: DataFrame, load: Callable[[], Callable[[str], str]], prompt: str, answer: str
) -> DataFrame:
    """Add ``answer`` with a text model, batch by batch; one model per task."""
    schema = T.StructType([*requests.schema.fields, T.StructField(answer, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield batch.assign(**{answer: [model(p) for p in batch[prompt]]})

    return requests.mapInPandas(run, schema)


def hashing_model(dimension: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Deterministic test model: hashed character trigrams, unit length."""
    import zlib

    def model(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), dtype=np.float64)
        for row, text in enumerate(texts):
            for i in range(max(1, len(text) - 2)):
                out[row, zlib.crc32(text[i : i + 3].encode()) % dimension] += 1
        norm = np.sqrt((out**2).sum(1, keepdims=True))
        return out / np.where(norm == 0, math.inf, norm)

    return model
