"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are counted on the UTF-8 bytes of a batch at once: shares of kinds of bytes, lengths and shapes of
words, how varied words and bytes are. Trees are grown on features cut into at most ``BINS`` quantiles: on each level one
histogram of gradients for each (node, feature, bin), from which every node's best split is read. A model is three arrays
over complete trees (feature, threshold, value), so that all rows walk all trees together, level by level.

The model is fitted on at most ``SAMPLE`` labelled rows, half of them for each label (those whose ids have the smallest
hashes), weighted to the labels' true counts; statistics and scores cover all rows. Labels, language, source and id
are never looked at to score.

Defined results: null and empty texts have statistics (zeros) and a score; without labels every score is a half, with one
label only it is that label's smoothed share; labels that are null or neither 0 nor 1, or without a document, teach nothing;
rows with null keys are scored and never learned from; repeated rows are scored each, and a document with several labels
teaches each of them; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, L2 = 60, 4, 64, 0.2, 1.0
#: Sum of curvatures that each side of a split keeps.
LEAST = 1.0
#: From this score on a document is predicted to have quality.
THRESHOLD = 0.3
#: Bytes that are counted at a time; a longer text is counted in pieces that end at white space.
PART = 1 << 20

STATISTICS = (
    "log_bytes", "log_words", "lower", "upper", "digit", "space", "line_feed", "stop", "punctuation", "symbol", "beyond_ascii", "control", "byte_entropy",
    "word_length", "word_length_sd", "longest_word", "capitalised", "all_upper", "no_letter", "symbol_at_end", "stop_at_end", "distinct", "most_frequent", "words_a_line",
)

#: Kinds of bytes, in the order of their columns; 0 is white space.
SPACE, LINE, LOWER, UPPER, DIGIT, STOP, MARK, SYMBOL, BEYOND, CONTROL = range(10)


def _kinds() -> np.ndarray:
    kind = np.full(256, SYMBOL, np.uint8)
    kind[:32] = kind[127] = CONTROL
    kind[128:] = BEYOND
    for codes, k in ((b" \t\x0b\x0c\r", SPACE), (b"\n", LINE), (bytes(range(97, 123)), LOWER), (bytes(range(65, 91)), UPPER), (b"0123456789", DIGIT), (b".!?", STOP), (b",;:'\"-()", MARK)):
        kind[list(codes)] = k
    return kind


KIND = _kinds()
POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, starts of the segments, their rows): stretches of about ``PART`` bytes; a segment is a text or a piece of one."""
    starts, rows, begin = [], [], 0
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while b > a:
            if starts and b - begin > PART:
                yield begin, a, np.array(starts), np.array(rows)
                starts, rows = [], []
            if not starts:
                begin = a
            starts.append(a)
            rows.append(row)
            if b - a <= PART:
                break
            end = a + PART
            while end < b:  # on to the next white space
                gaps = np.flatnonzero(KIND[data[end : end + PART]] <= LINE)
                if len(gaps):
                    end = min(b, end + int(gaps[0]))
                    break
                end = min(b, end + PART)
            yield begin, end, np.array(starts), np.array(rows)
            starts, rows, a = [], [], end
    if starts:
        yield begin, int(offsets[-1]), np.array(starts), np.array(rows)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text."""
    column = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    _, raw, content = column.buffers()
    offsets = np.frombuffer(raw, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    kinds, histogram = np.zeros((n, 10)), np.zeros((n, 256))
    # words, sum of lengths, of their squares, capitalised, all upper, no letter, symbol at the end, stop at the end
    sums, longest = np.zeros((n, 8)), np.zeros(n)
    keys = []
    for begin, end, starts, rows in _pieces(data, offsets):
        part = data[begin:end]
        kind = KIND[part]
        lengths = np.diff(np.append(starts, end))
        segment = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
        counted = np.bincount(segment * 256 + part, minlength=256 * len(rows)).reshape(-1, 256)
        np.add.at(histogram, rows, counted)
        by_kind = np.zeros((len(rows), 10))
        np.add.at(by_kind.T, KIND, counted.T)
        np.add.at(kinds, rows, by_kind)
        inside = kind > LINE
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        opens[starts - begin] = inside[starts - begin]
        first = np.flatnonzero(opens)
        if not len(first):
            continue
        letters = np.concatenate([[0], np.cumsum((kind == LOWER) | (kind == UPPER) | (kind == BEYOND))])
        uppers = np.concatenate([[0], np.cumsum(kind == UPPER)])
        size = np.add.reduceat(inside.astype(np.int64), first)
        last = first + size
        at = np.repeat(first, size)
        place = np.flatnonzero(inside)
        value = (part[place].astype(np.uint64) + np.uint64(1)) * POWERS[(place - at) & 255]
        hashed = np.add.reduceat(value, np.cumsum(size) - size)
        row = rows[segment[first]]
        n_letters, n_uppers, tail = letters[last] - letters[first], uppers[last] - uppers[first], kind[last - 1]
        shapes = [np.ones(len(first)), size, size * size, kind[first] == UPPER, (n_uppers == n_letters) & (n_uppers > 1), n_letters == 0, tail == SYMBOL, tail == STOP]
        for k, shape in enumerate(shapes):
            sums[:, k] += np.bincount(row, shape, n)
        np.maximum.at(longest, row, size)
        keys.append(row.astype(np.uint64) << np.uint64(40) | hashed >> np.uint64(24))
    distinct, most = np.zeros(n), np.zeros(n)
    if keys:
        words, times = np.unique(np.concatenate(keys), return_counts=True)
        row = (words >> np.uint64(40)).astype(np.int64)
        distinct = np.bincount(row, minlength=n).astype(float)
        np.maximum.at(most, row, times)
    size, words = kinds.sum(axis=1), sums[:, 0]
    a_byte, a_word = np.maximum(size, 1), np.maximum(words, 1)
    share = histogram / a_byte[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    mean = sums[:, 1] / a_word
    return np.column_stack([
        np.log1p(size), np.log1p(words), *(kinds[:, k] / a_byte for k in (LOWER, UPPER, DIGIT, SPACE, LINE, STOP, MARK, SYMBOL, BEYOND, CONTROL)), entropy,
        mean, np.sqrt(np.maximum(sums[:, 2] / a_word - mean * mean, 0)), np.log1p(longest), *(sums[:, k] / a_word for k in range(3, 8)), distinct / a_word, most / a_word, words / (kinds[:, LINE] + 1),
    ])


@dataclass
class Trees:
    """Complete trees of one depth, flattened: a node's children stand at 2i+1 (up to the threshold) and 2i+2 (above it)."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray  # the same; infinity where a node isn't split
    value: np.ndarray  # (trees, 2**depth)
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), self.base)
        feature, threshold = self.feature.ravel(), self.threshold.ravel()
        rows, offset = np.arange(len(x))[:, None], np.arange(trees) * inner
        at = np.zeros((len(x), trees), np.int64)
        for _ in range(self.value.shape[1].bit_length() - 1):
            node = at + offset
            at = 2 * at + 1 + (x[rows, feature[node]] > threshold[node])
        return self.base + self.value.ravel()[at - inner + np.arange(trees) * (inner + 1)].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -35, 35)))


def best_splits(grad: np.ndarray, hess: np.ndarray, l2: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, feature, bin) of each node's best split, from histograms (nodes, features, bins); a split sends bins up to its own to the left."""
    left_g, left_h = np.cumsum(grad, axis=2), np.cumsum(hess, axis=2)
    all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - all_g**2 / (all_h + l2)
    gain = np.where((left_h >= least) & (right_h >= least), gain, -np.inf).reshape(len(grad), -1)
    best = gain.argmax(axis=1)
    return gain[np.arange(len(grad)), best], *np.divmod(best, grad.shape[2])


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, l2: float = L2, least: float = LEAST) -> Trees:
    """Logistic boosting."""
    inner = 2**depth - 1
    none = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    if not len(y):
        return none
    positive, total = float(weight[y > 0].sum()), float(weight.sum())
    none.base = float(np.log((positive + 1) / (total - positive + 1)))
    if positive in (0.0, total):
        return none
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.column_stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)])
    limits = np.full((x.shape[1], bins), np.inf)
    for f, e in enumerate(edges):
        limits[f, : len(e)] = e
    margin, grown = np.full(len(y), none.base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = weight * (p - y), weight * p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            nodes, start = 2**level, 2**level - 1
            cell = (at - start)[:, None] * bins + codes
            g, h = (np.stack([np.bincount(cell[:, f], v, nodes * bins).reshape(nodes, bins) for f in range(x.shape[1])], axis=1) for v in (grad, hess))
            gain, which, where = best_splits(g, h, l2, least)
            split = gain > 1e-9
            feature[start : start + nodes] = np.where(split, which, 0)
            threshold[start : start + nodes] = np.where(split, limits[which, where], np.inf)
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = at - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        value = -rate * g / (h + l2)
        margin += value[leaf]
        grown.append((feature, threshold, value))
    return Trees(*map(np.stack, zip(*grown, strict=True)), none.base)


def _by_statistics(rows: DataFrame, text: str, schema: str, names: list[str], result) -> DataFrame:
    """``rows`` with what ``result`` makes of the texts' statistics in place of the text (the last column)."""

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], result(statistics(part.columns[-1]))], names)

    return rows.withColumn(text, F.col(text).cast("string")).mapInArrow(work, schema)


def learned(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Trees:
    """A model of a 0/1 label, of at most ``sample`` labels (and twice as many rows where ids repeat); which rows of ``labels`` may teach is the caller's choice."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("key_"), F.col(label).cast("int").alias("label_"))
    sizes = {r["label_"]: r["count"] for r in known.groupBy("label_").count().collect()}  # two rows
    order = [F.xxhash64("key_"), F.col("key_")]
    picked = [known.where(F.col("label_") == value).orderBy(*order).limit(sample // 2) for value in sorted(sizes)]
    if not picked:
        return boost(np.zeros((0, len(STATISTICS))), np.zeros(0), np.zeros(0))
    chosen = picked[0] if len(picked) == 1 else picked[0].unionByName(picked[1])
    rows = docs.select(F.col(key).alias("key_"), F.col(text).alias("text_")).join(F.broadcast(chosen), "key_").select("label_", "text_")  # ``sample`` keys at most
    vectors = _by_statistics(rows, "text_", "label int, x array<double>", ["label", "x"], lambda x: pa.array(list(x), pa.list_(pa.float64())))
    found = vectors.limit(2 * sample).toArrow()
    y = found["label"].to_numpy().astype(float)
    x = np.asarray(found["x"].combine_chunks().flatten(), float).reshape(len(y), len(STATISTICS))
    weight = np.ones(len(y))
    for value, size in sizes.items():
        at = y == value
        weight[at] = size / max(at.sum(), 1) * (len(y) / sum(sizes.values()))
    order = np.lexsort((*x.T, y))  # the same model whatever order the rows came in
    return boost(x[order], y[order], weight[order])


def scored(docs: DataFrame, model: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    return _by_statistics(docs.select(key, F.col(text).alias("text_")), "text_", f"`{key}` {kind}, score double", [key, "score"], lambda x: pa.array(shared.value.scores(x)))


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op12_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learned(docs, labels.where(~held_out(F.col("doc_id"))), "quality")
    found = scored(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
