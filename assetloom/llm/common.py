"""Helpers shared by the training-data operators."""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.sources.shared import written as cut

#: Distinct words whose hashes a Python worker remembers before it starts afresh.
WORD_CACHE = 400_000

#: Keys of a skewed join that go by broadcast.
HEAVY = 1000

_cache: dict[bytes, int] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """While it lasts, what is run reads and hands to Python at most so many rows at a time: for rows that hold long lists or texts."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {name: spark.conf.get(name) for name in names}
    for name, own in before.items():
        spark.conf.set(name, min(rows, int(own)) if int(own) > 0 else rows)
    try:
        yield
    finally:
        for name, own in before.items():
            spark.conf.set(name, own)


def join_skewed(rows: DataFrame, values: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``values`` (one row for each key), of which ``weight`` says how busy a key is.

    The ``HEAVY`` busiest keys go by a broadcast of that bounded size, so their rows stay where they are; all others are shuffled.
    Rows with a null in their key meet nothing: they are dropped or kept before any shuffle. In the left form a key that ``values``
    lacks is shuffled like any other, so the caller keeps such rows few or apart.
    """
    busiest = F.broadcast(values.orderBy(F.desc(weight), *on).limit(HEAVY))
    whole = reduce(and_, [F.col(c).isNotNull() for c in on])
    keyed = rows.where(whole)
    joined = keyed.join(busiest, on).unionByName(keyed.join(busiest.select(*on), on, "left_anti").join(values, on, how))
    return joined.unionByName(rows.where(~whole), allowMissingColumns=True) if how == "left" else joined


def most_frequent(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """The rows with the highest counts, ``most`` of them at most and all that are as frequent.

    Counts fall into buckets by their seven leading bits, so only a bounded histogram meets in one place.
    """
    bucket = F.expr(f"length(bin({n})) * 128 + shiftright({n}, greatest(length(bin({n})) - 7, 0))")
    histogram = counts.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows")).collect()
    least, total = None, 0
    for row in sorted(histogram, reverse=True):
        total += row["rows"]
        if total > most:
            break
        least = row["bucket"]
    return counts.where(bucket >= least) if least is not None else counts.limit(0)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7)


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, remembering the frequent ones within a bound."""
    global _cache
    if len(_cache) > WORD_CACHE:
        _cache = {}
    known = _cache
    try:
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for word in words:
            if word not in known:
                known[word] = xxhash.xxh64_intdigest(word, 7)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer (wraps modulo 2**64)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words: a polynomial of the word hashes, mixed."""
    count = len(hashes) - n + 1
    total = np.zeros(count, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for i in range(n):
        total = total * factor + hashes[i : i + count]
    return mix(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
