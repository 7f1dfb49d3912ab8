"""Similarity ranking: dense vectors, text vectors, deterministic top-k, encoders."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from assetloom.functions.vectors import cosine, dot, literal, mean_of

#: Digits to which scores are rounded before ranking, so that engines agree on ties.
DIGITS = 6


def top_k(scored: DataFrame, k: int | None, score: str = "score", key: str = "uid") -> DataFrame:
    """The k best, NaN and null last, ties by key; all of them in order without k."""
    if k is not None and k < 0:
        raise ValueError("k must not be negative")
    ranked = scored.orderBy(F.when(~F.isnan(score), F.col(score)).desc_nulls_last(), F.col(key).asc())
    return ranked if k is None else ranked.limit(k)


def clamped_top_k(scored: DataFrame, k: int, score: str = "score", key: str = "name") -> DataFrame:
    """As ``top_k``, but k must be given."""
    if k is None:
        raise ValueError("k must be given")
    return top_k(scored, k, score, key)


def dense_scores(vectors: DataFrame, queries: Sequence[Sequence[float]], vector: str = "embedding") -> Column:
    """Mean cosine of a vector column to one or more query vectors, rounded."""
    return F.round(mean_of([cosine(F.col(vector), literal(q)) for q in queries]), DIGITS)


def dual_scores(query: Sequence[float], *fields: str) -> Column:
    """Mean of the dot products of several unit-norm fields with one unit query; a missing field counts as 0."""
    return F.round(mean_of([dot(F.col(f), literal(query)) for f in fields]), DIGITS)


def nearest(vectors: DataFrame, query: Sequence[float], k: int | None = 100, vector: str = "embedding", key: str = "uid") -> DataFrame:
    return top_k(vectors.select(key, dense_scores(vectors, [query], vector).alias("score")), k, key=key)


def terms(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, n): term frequencies; text is lower-cased and parted at what is no letter or digit."""
    words = rows.select(key, F.explode(F.split(F.lower(text), "[^a-z0-9]+")).alias("term")).where("term <> ''")
    return words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def text_scores(rows: DataFrame, query: str, key: str, text: Column) -> DataFrame:
    """(key, score): cosine of term frequencies with the query's. Rows without terms score 0."""
    asked: dict[str, int] = {}
    for word in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split():
        asked[word] = asked.get(word, 0) + 1
    length = float(np.sqrt(sum(n * n for n in asked.values())))
    weight = F.lit(0)
    for word, n in asked.items():
        weight = F.when(F.col("term") == word, F.lit(n)).otherwise(weight)
    scored = terms(rows, key, text).groupBy(key).agg(F.sum(F.col("n") * weight).alias("dot"), F.sqrt(F.sum((F.col("n") * F.col("n")).cast("double"))).alias("norm"))
    scored = rows.select(key).join(scored, key, "left")
    return scored.select(key, F.round(F.coalesce(F.try_divide(F.col("dot").cast("double"), F.col("norm") * F.lit(length)), F.lit(0.0)), DIGITS).alias("score"))


class Encoders:
    """Encoders by name: functions from a list of texts to a matrix, made once in each Python worker."""

    def __init__(self):
        self.makers: dict[str, Callable[[], Callable[[list[str]], np.ndarray]]] = {}

    def register(self, name: str, maker: Callable[[], Callable[[list[str]], np.ndarray]]) -> None:
        self.makers[name] = maker

    def check(self, name: str) -> None:
        if name not in self.makers:
            raise ValueError(f"unknown encoder {name!r}; known: {sorted(self.makers)}")

    def encode(self, rows: DataFrame, name: str, text: str, key: str = "uid", batch: int = 64) -> DataFrame:
        """(key, vector): unit vectors of the texts, ``batch`` texts to a call of the model; a missing text is encoded as the empty one."""
        self.check(name)
        maker = self.makers[name]

        def make():
            model = maker()

            def predict(texts: np.ndarray) -> np.ndarray:
                vectors = np.asarray(model(list(texts)), np.float32)
                length = np.linalg.norm(vectors, axis=1, keepdims=True)
                return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)

            return predict

        encoded = predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch)
        return rows.select(key, encoded(F.coalesce(F.col(text), F.lit(""))).alias("vector"))


def hashed_terms(size: int = 256) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A deterministic encoder that needs no model: term frequencies hashed to ``size`` places."""

    def make():
        import zlib

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), size), np.float32)
            for i, text in enumerate(texts):
                for word in text.lower().split():
                    out[i, zlib.crc32(word.encode()) % size] += 1
            return out

        return encode

    return make
