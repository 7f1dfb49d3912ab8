import hashlib
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

from assetloom.llm import fm_dedup
from assetloom.llm.fm_dedup import OP6_SQL, FMIndex, anchor_runs, deduplicated, op6_fm_dedup, search_shard

SCHEMA = "doc_id long, text string"


def brute(docs, window):
    """{place: (n_words, n_removed, kept sha)} of a list of (id, text)."""
    words = [(t or "").encode().split() for _, t in docs]
    starts = {}
    for (i, _), w in zip(docs, words, strict=True):
        for s in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[s : s + window])
            starts[key] = min(starts.get(key, i), i)
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = set()
        for s in range(len(w) - window + 1 if i is not None else 0):
            if starts[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made_up(seed, count=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passages = [rng.choices(vocabulary, k=rng.randint(5, 90)) for _ in range(6)] + [["na"] * 70, ["a", "b"] * 40]
    texts = []
    for _ in range(count):
        text = []
        for _ in range(rng.randint(0, 5)):
            text += rng.choices(vocabulary, k=rng.randint(0, 30)) if rng.random() < 0.5 else rng.choice(passages)
        if texts and rng.random() < 0.25:
            text = list(rng.choice(texts))
            for _ in range(rng.randint(0, 3)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(vocabulary)
        texts.append(text)
    return [rng.choice([" ", "\n", "\t "]).join(t) for t in texts]


def test_backward_search_finds_all_rows():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 6, 800)
    text[::100] = 0
    text[-1] = 0
    owner = np.arange(800) // 100
    index = FMIndex(text, owner)
    for _ in range(300):
        size = int(rng.integers(1, 6))
        a = int(rng.integers(0, 790))
        pattern = text[a : a + size]
        low, high = np.array([0]), np.array([800])
        for c in pattern[::-1]:
            low, high = index.extend(np.array([c]), low, high)
        expected = [i for i in range(800 - size + 1) if np.array_equal(text[i : i + size], pattern)]
        if 0 not in pattern:
            rows = np.arange(low[0], high[0])
            places = index.locate(rows)
            assert sorted(places) == expected
            document = index.documents.least(low, high)
            assert document[0] == owner[expected[0]]
            assert owner[index.locate(index.documents.find(document, low, high))] == document
            assert np.array_equal(index.documents.look(rows)[0], owner[places])


@pytest.mark.parametrize("window", [1, 2, 7, 20, 50])
def test_runs_cover_all_windows(window):
    rng = np.random.default_rng(window)
    hashes = rng.integers(0, 50, 300).astype(np.uint64)
    anchors, first, last = anchor_runs(hashes, window)
    assert first[0] == 0 and last[-1] == 300 - window and (first[1:] == last[:-1] + 1).all()
    assert len(anchor_runs(hashes[: window - 1], window)[0]) == 0


@pytest.mark.parametrize("seed", range(4))
def test_shard_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 1 << 60, 12).astype(np.uint64)
    stretches = [base[rng.integers(0, 12 if i % 3 else 2, rng.integers(10, 60))] for i in range(60)]
    stretches += [s.copy() for s in stretches[:20]]
    ids = rng.integers(0, 25, len(stretches))
    covered = [np.zeros(len(s), bool) for s in stretches]
    for row, start, stop in zip(*search_shard(ids, stretches, 10), strict=True):
        covered[row][start:stop] = True
    least = {}
    for i, s in zip(ids, stretches, strict=True):
        for a in range(len(s) - 9):
            key = s[a : a + 10].tobytes()
            least[key] = min(least.get(key, i), i)
    for i, s, c in zip(ids, stretches, covered, strict=True):
        expected = np.zeros(len(s), bool)
        for a in range(len(s) - 9):
            if least[s[a : a + 10].tobytes()] < i:
                expected[a : a + 10] = True
        assert np.array_equal(c, expected)


@pytest.mark.parametrize("seed,shard", [(1, 200_000), (2, 500), (3, 50)])
def test_documents_equal_brute_force(spark, seed, shard):
    texts = made_up(seed)
    docs = [(i * 3 % 127, t) for i, t in enumerate(texts)]
    got = deduplicated(spark.createDataFrame(docs, SCHEMA), window=20, shard=shard).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, 20)


def test_odd_rows(spark):
    line = " ".join(f"x{i}" for i in range(60))
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, line), (4, line), (4, line + " more"), (5, line), (6, "é" + line), (None, line), (None, None), (7, line.replace(" ", "\n")), (8, " ".join(["again"] * 3000)), (9, " ".join(["again"] * 80)), (10, "x" * 100_000)]
    frame = spark.createDataFrame([(i, t, 1, "a") for i, t in docs], SCHEMA + ", id int, words string")
    got = deduplicated(frame).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, 50)
    assert deduplicated(frame.limit(0)).count() == 0


def test_long_texts_of_one_word(spark):
    """All windows of all documents share one anchor, whose shard must stay small."""
    docs = [(i, " ".join(["again"] * (20_000 - i % 50))) for i in range(200)]
    got = deduplicated(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(i, 20_000 - i % 50, 0 if i == 0 else 20_000 - i % 50) for i in range(200)]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in op6_fm_dedup(spark, sf).collect())
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got == sorted(brute(docs, 50))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{Path(sf)}/documents.parquet'")
        assert sorted(db.execute(OP6_SQL).fetchall()) == got


def test_search_asks_for_the_smallest_document_in_every_other_step(monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 40, 400).astype(np.uint64)
    stretches = [np.concatenate([rng.integers(0, 40, 30).astype(np.uint64), base[a : a + 150]]) for a in range(0, 200, 10)]
    asked, extended = [], []
    least, extend = fm_dedup.WaveletMatrix.least, fm_dedup.FMIndex.extend
    monkeypatch.setattr(fm_dedup.WaveletMatrix, "least", lambda self, low, high: asked.append(len(low)) or least(self, low, high))
    monkeypatch.setattr(fm_dedup.FMIndex, "extend", lambda self, symbols, low, high: extended.append(len(low)) or extend(self, symbols, low, high))
    row, start, stop = fm_dedup.search_shard(np.arange(len(stretches)), stretches, 50)
    got = {(r, i) for r, a, b in zip(row.tolist(), start.tolist(), stop.tolist(), strict=True) for i in range(a, b)}
    windows, expected = {}, set()
    for r, s in enumerate(stretches):
        for a in range(len(s) - 49):
            if windows.setdefault(s[a : a + 50].tobytes(), r) < r:
                expected.update((r, i) for i in range(a, a + 50))
    assert got == expected and expected
    assert sum(asked) < 0.7 * sum(extended)
