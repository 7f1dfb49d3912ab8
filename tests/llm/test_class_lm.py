import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetloom.llm import class_lm
from assetloom.llm.class_lm import CLASSES, ENOUGH, LONGEST, ROUNDS, SHAPES, SWEEPS, best_classes, class_table, exchange, held_out, op2_class_lm, score, shape, transitions

SCHEMA = "doc_id long, text string"


def split(text):
    return (text or "").encode().lower().split()


def likelihood(bigrams, own, classes):
    table = np.zeros((classes + 1, classes + 1))
    np.add.at(table, (own[:, None], own[None, :]), bigrams)
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return f(table) - f(table.sum(0)) - f(table.sum(1))


def brute(docs, training, clustered, listed):
    """{id: (n_tokens, n_known, N, base, score)} from counts in plain Python; classes by the same exchange."""
    trained = [split(t) for i, t in docs if training(i)]
    counts = Counter(w for s in trained for w in s)
    ends = len(trained)
    total, distinct = sum(counts.values()) + ends, len(counts) + (ends > 0)
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    bucket = lambda w: (counts[w].bit_length(), counts[w] >> max(counts[w].bit_length() - 7, 0))
    short = [w for w in ranked if len(w) <= LONGEST]
    many = Counter(map(bucket, short))
    known = {w for w in short if sum(n for b, n in many.items() if b >= bucket(w)) <= listed}
    top = [w for w in ranked if w in known][:clustered]
    unit_of = {w: i for i, w in enumerate(top)}
    unit = lambda w: unit_of[w] if w in unit_of else len(top) + shape(w)
    end = len(top) + SHAPES
    bigrams = np.zeros((end + 1, end + 1), np.int64)
    for s in trained:
        sequence = [end, *map(unit, s), end]
        np.add.at(bigrams, (sequence[:-1], sequence[1:]), 1)
    own = exchange(bigrams)
    rare = [w for w in counts if w not in known]
    tokens, words = Counter(), Counter()
    for w in rare:
        tokens[shape(w)] += counts[w]
        words[shape(w)] += 1
    of_word = {w: own[unit(w)] for w in known}
    of_shape = [own[len(top) + k] for k in range(SHAPES)]
    follows = lambda w: of_word[w] if w in known else of_shape[shape(w)]
    units = [*sorted(known), *range(SHAPES)]
    number = {u: k for k, u in enumerate(units)}

    def counted(before):
        table, mass = np.zeros((CLASSES + 1, CLASSES + 1)), np.zeros(CLASSES)
        for s in trained:
            np.add.at(table, ([CLASSES, *(before[w] for w in s)], [*map(follows, s), CLASSES]), 1)
        for w in known:
            mass[of_word[w]] += counts[w]
        for k in range(SHAPES):
            mass[of_shape[k]] += tokens[k] + 1
        return table, mass

    for _ in range(ROUNDS):
        start = {w: follows(w) for w in counts}
        contexts = np.zeros((len(units), 2 * (CLASSES + 1)))
        for s in trained:
            around = [CLASSES, *(start[w] for w in s), CLASSES]
            for k, w in enumerate(s):
                at = number[w if w in known else shape(w)]
                contexts[at, around[k]] += 1
                contexts[at, CLASSES + 1 + around[k + 2]] += 1
        for _ in range(SWEEPS):
            best = best_classes(contexts, *counted(start))
            of_shape = [best[number[k]] if contexts[number[k]].any() else of_shape[k] for k in range(SHAPES)]
            of_word = {w: best[number[w]] if counts[w] >= ENOUGH else of_shape[shape(w)] for w in known}
    table, mass = counted({w: follows(w) for w in counts})
    steps = transitions(table)

    def emit(w):
        c = follows(w)
        if w in known:
            return math.log10(counts[w] / mass[c])
        s = shape(w)
        return math.log10((tokens[s] + 1) / mass[c]) + math.log10((counts[w] + 1) / (tokens[s] + words[s] + 1))

    out = {}
    for i, t in docs:
        s = split(t)
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in s) + math.log10((ends + 1) / (total + distinct + 1))
        model = sum(steps[a, b] for a, b in zip([CLASSES, *map(follows, s)], [*map(follows, s), CLASSES], strict=True)) + sum(map(emit, s))
        out[i] = (len(s) + 1, sum(w in counts for w in s) + (ends > 0), total, base, model)
    return out


def same(got, expected):
    assert len(got) == len(expected)
    for r in got:
        n, known, total, base, model = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(model)


def test_exchange_only_gains_and_finds_clear_classes():
    rng = np.random.default_rng(0)
    kind = rng.integers(0, 3, 40)
    bigrams = np.where((kind[:, None] + 1) % 3 == kind[None, :], rng.integers(20, 40, (40, 40)), rng.integers(0, 2, (40, 40)))
    whole = np.zeros((41, 41), np.int64)
    whole[:40, :40] = bigrams
    whole[40, :40] = whole[:40, 40] = 1
    own = exchange(whole, classes=3)
    assert own[40] == 3
    assert len({(a, b) for a, b in zip(kind, own[:40], strict=True)}) == 3
    start = np.append(np.minimum(np.arange(40), 2), 3)
    assert likelihood(whole, own, 3) >= likelihood(whole, start, 3)


def test_probabilities_add_up():
    rng = np.random.default_rng(1)
    bigrams = rng.integers(0, 5, (SHAPES + 11, SHAPES + 11))
    own = exchange(bigrams)
    assert np.allclose((10 ** transitions(class_table(bigrams, own))).sum(1), 1)
    assert own.max() == CLASSES


@pytest.mark.parametrize("clustered,listed", [(5, 12), (50, 1000), (3, 3)])
def test_scores_equal_brute_force(spark, clustered, listed):
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.6, rng.integers(0, 40)) if x < 500)) for i in range(60)]
    docs += [(105, "y" * 65 + " " + "y" * 64 + " b"), (106, ("y" * 65 + " ") * 9), (107, "unseen " * 30 + "w1 unseen")]
    docs += [(100, None), (101, ""), (102, "\x0b\t A a É é \x1cx\xa0y"), (103, "z" * 50_000), (104, "w1 " * 5000)]
    frame = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], SCHEMA + ", id int, word string")
    got = score(frame, F.col("doc_id") % 3 != 0, clustered=clustered, listed=listed).collect()
    same(got, brute(docs, lambda i: i % 3 != 0, clustered, listed))


def test_repeats_nulls_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a c"), (None, None)], SCHEMA)
    got = score(frame, ~held_out(F.col("doc_id"))).collect()
    trained = sum(len(split(t)) + 1 for i, t in [(1, "a b"), (1, "a b"), (None, "a c"), (None, None)] if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2)
    assert len(got) == 4 and {r.train_tokens for r in got} == {trained}
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert score(frame.limit(0), F.lit(True)).count() == 0
    (r,) = score(frame.limit(1), F.lit(False)).collect()
    assert (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) and r.score < 0


def test_query_is_exact_and_beats_the_base_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op2_class_lm(spark, sf).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    same(got, brute(docs, lambda i: zlib.crc32(str(i).encode()) % 7 != 2, class_lm.CLUSTERED, class_lm.LISTED))
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_texts_are_numbered_once_and_contexts_sent_in_stretches(spark):
    texts = ["a b a c zz", None, "c A  b\n", "b " * 300 + "yy zz yy"]
    rows = spark.createDataFrame([((i,), t) for i, t in enumerate(texts)], "row struct<id: long>, text string").coalesce(1)
    listed = [b"a", b"b", b"c"]
    end = len(listed) + SHAPES
    found = {r.row.id: r for r in class_lm.numbered(rows, listed).collect()}
    unit = lambda w: listed.index(w) if w in listed else len(listed) + shape(w)
    for i, t in enumerate(texts):
        assert np.frombuffer(found[i].units, np.int32).tolist() == [*map(unit, split(t)), end]
        assert dict(zip(map(bytes, found[i].words), found[i].times, strict=True)) == Counter(w for w in split(t) if w not in listed)

    class_of = np.arange(end + 1) % CLASSES
    class_of[end] = CLASSES
    expected = Counter()
    for t in texts:
        around = [end, *map(unit, split(t)), end]
        for k in range(1, len(around)):
            expected[around[k], class_of[around[k - 1]]] += 1
            expected[around[k], CLASSES + 1 + class_of[around[k + 1] if k + 1 < len(around) else end]] += 1
    contexts = class_lm.word_contexts(class_lm.numbered(rows, listed).select("units"), class_of).collect()
    assert {(r.unit, a): n for r in contexts for a, n in zip(r.at, r.n, strict=True)} == expected
    assert len(contexts) == len({r.unit for r in contexts})
