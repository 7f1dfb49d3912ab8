"""Statistics, splits and walks against plain versions; held-out accuracy; odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assetloom.llm import quality
from assetloom.llm.quality import STATISTICS

SF = "/root/testdata/sf0.01"


def plain_statistics(text):
    raw = (text or "").encode()
    words = raw.split()  # the same white space in ASCII, line feeds included
    letters = lambda w: sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in w)
    uppers = lambda w: sum(65 <= b <= 90 for b in w)
    n, w = max(len(raw), 1), max(len(words), 1)
    share = lambda codes: sum(b in codes for b in raw) / n
    stop, mark = b".!?", b",;:'\"-()"
    space = b" \t\x0b\x0c\r"
    control = bytes(b for b in [*range(32), 127] if b not in space + b"\n")
    symbol = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in stop + mark)
    sizes = [len(x) for x in words] or [0]
    mean = sum(sizes) / w
    counts = Counter(raw)
    return dict(
        log_bytes=math.log1p(len(raw)), log_words=math.log1p(len(words)), lower=share(bytes(range(97, 123))), upper=share(bytes(range(65, 91))), digit=share(b"0123456789"), space=share(space), line_feed=share(b"\n"),
        stop=share(stop), punctuation=share(mark), symbol=share(symbol), beyond_ascii=share(bytes(range(128, 256))), control=share(control), byte_entropy=-sum(c / n * math.log2(c / n) for c in counts.values()),
        word_length=mean, word_length_sd=math.sqrt(max(sum(s * s for s in sizes) / w - mean * mean, 0)), longest_word=math.log1p(max(sizes)), capitalised=sum(65 <= x[0] <= 90 for x in words) / w,
        all_upper=sum(uppers(x) == letters(x) > 1 for x in words) / w, no_letter=sum(letters(x) == 0 for x in words) / w, symbol_at_end=sum(x[-1] in symbol for x in words) / w, stop_at_end=sum(x[-1] in stop for x in words) / w,
        distinct=len(set(words)) / w, most_frequent=max(Counter(words).values(), default=0) / w, words_a_line=len(words) / (raw.count(b"\n") + 1),
    )


TEXTS = [None, "", " ", "\n\n", "word", "OF!! THE!! OF!!", "é É ñ 你好", "a b a b a\nb 12 3.5 (x) | #$ \x00\x7f", "x" * 3000, "A", "end. End? END!", "tab\tcr\rff\x0cvt\x0b."]


@pytest.mark.parametrize("part", [1, 7, 64, 1 << 20])
def test_statistics(monkeypatch, part):
    """Whatever the pieces, slices included."""
    monkeypatch.setattr(quality, "PART", part)
    rng = random.Random(part)
    texts = TEXTS + ["".join(rng.choice("ab cD\n.!#9é ") for _ in range(rng.randrange(200))) for _ in range(40)] + TEXTS
    for start in (0, 3):
        found = quality.statistics(pa.array(texts).slice(start))
        expected = [[plain_statistics(t)[name] for name in STATISTICS] for t in texts[start:]]
        np.testing.assert_allclose(found, expected, atol=1e-6)
    assert quality.statistics(pa.array([], pa.string())).shape == (0, len(STATISTICS))


def test_best_split_is_the_best():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 6, (200, 3)).astype(float), rng.integers(0, 2, 200).astype(float)
    model = quality.boost(x, y, np.ones(200), trees=1, depth=1, bins=8, rate=1.0, l2=1.0, least=0.0)
    p = 1 / (1 + math.exp(-model.base))
    g, h = p - y, np.full(200, p * (1 - p))

    def gain(f, t):
        left = x[:, f] <= t
        return sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left))

    assert gain(model.feature[0, 0], model.threshold[0, 0]) == pytest.approx(max(gain(f, t) for f in range(3) for t in range(5)))
    left = x[:, model.feature[0, 0]] <= model.threshold[0, 0]
    assert model.value[0] == pytest.approx([-g[s].sum() / (h[s].sum() + 1) for s in (left, ~left)])


def test_walk_is_that_of_single_trees():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.boost(x, y, np.ones(500), trees=20, depth=3)

    def walk(row):
        total = model.base
        for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + (row[feature[at]] > threshold[at])
            total += value[at - len(feature)]
        return total

    np.testing.assert_allclose(model.margins(x), [walk(r) for r in x])
    assert ((model.scores(x) > 0.5) == y).mean() > 0.95


def ids(rows):
    return {r["doc_id"]: r for r in rows}


def test_held_out_documents(spark):
    found = quality.op12_quality_trees(spark, SF)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    good = [r["score"] for r in rows if r["held_out"] and labels.get(r["doc_id"]) == 1]
    bad = [r["score"] for r in rows if r["held_out"] and labels.get(r["doc_id"]) == 0]
    ahead = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert ahead > 0.95, ahead
    assert sum(g >= 0.3 for g in good) / len(good) > 0.97 and sum(b < 0.3 for b in bad) / len(bad) > 0.9


def test_held_out_labels_are_never_read(spark):
    """Turned over, the labels of held-out documents change nothing."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.held_out(F.col("doc_id"))
    turned = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.learned(docs.repartition(n), t.where(~out), "quality", sample=200) for n, t in ((3, labels), (5, turned)))
    for name in ("feature", "threshold", "value"):
        np.testing.assert_array_equal(getattr(a, name), getattr(b, name))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "Good words here."), (2, None), (3, ""), (None, "no id"), (4, "x" * 200_000), (1, "Good words here.")], "doc_id long, text string").withColumns({"score": F.lit(9), "x": F.lit("y"), "label_": F.lit(0)})
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 5), (None, 1), (99, 1)], "doc_id long, quality int")
    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        rows = quality.scored(docs, quality.learned(docs, known, "quality")).collect()
        assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    assert {r["score"] for r in quality.scored(docs, quality.learned(docs, labels.limit(0), "quality")).collect()} == {0.5}
    assert quality.scored(docs.limit(0), quality.learned(docs.limit(0), labels, "quality")).collect() == []
