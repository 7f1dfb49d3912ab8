import random

import numpy as np
import pytest

from assetloom.llm import partenum
from assetloom.llm.partenum import Bands, components, jaccard_components, op3_partenum, shingle_set

SCHEMA = "doc_id long, text string"


def sets_of(docs, n):
    out = []
    for i, t in docs:
        w = (t or "").encode().lower().split()
        out.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
    return out


def brute(docs, n, p, q):
    found = sets_of(docs, n)
    root = {i: i for i, _ in found if i is not None}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for k, (i, s) in enumerate(found):
        for x in s if i is not None else ():
            holders.setdefault(x, []).append(k)
    for i, s in found:
        if i is None:
            continue
        for k in {k for x in s for k in holders[x]}:
            j, other = found[k]
            both = len(s & other)
            if q * both >= p * (len(s) + len(other) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else top(i)) for i, s in found), key=str)


def made_up(seed, count, edits):
    rng = random.Random(seed)
    texts = []
    for _ in range(count):
        if texts and rng.random() < 0.6:
            words = list(rng.choice(texts))
            for _ in range(rng.randint(0, edits)):
                if words:
                    at = rng.randrange(len(words))
                    words[at : at + rng.randint(0, 1)] = [f"e{rng.randrange(300)}"] * rng.randint(0, 1)
        else:
            words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([0, 1, 2, 3, 8, 12, 13, 15, 30, 100, 300]))]
        texts.append(words)
    return [(i * 7 % 1009, " ".join(t).upper() if i % 5 == 0 else " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("p,q", [(90, 100), (80, 100), (50, 100), (95, 100)])
def test_similar_sets_share_a_signature(p, q):
    rng, bands = np.random.default_rng(p), Bands(p, q)
    pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    shared = 0
    for _ in range(1500):
        size = int(rng.choice([1, 2, 4, 5, 9, 10, 11, 13, 14, 20, 29, 40, 63, 64, 100, 150, 400]))
        a = rng.choice(pool, size, replace=False)
        drop, add = rng.integers(0, 1 + size * (q - p) // q), rng.integers(0, 1 + size * (q - p) // q)
        b = np.union1d(a[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64))
        a = np.sort(a)
        both = len(np.intersect1d(a, b))
        if q * both >= p * (len(a) + len(b) - both) and not np.array_equal(a, b):
            shared += 1
            # in some band and hashing they share as many signatures as either needs
            (one, first), (two, second) = bands.signatures(a), bands.signatures(b)
            common, at, to = np.intersect1d(one, two, return_indices=True)
            slots, counts = np.unique(first[at] >> 32, return_counts=True)
            needs = {c >> 32: c & 0xFFFFFFFF for c in first.tolist()}, {c >> 32: c & 0xFFFFFFFF for c in second.tolist()}
            assert any(n >= max(needs[0][s], needs[1][s]) for s, n in zip(slots.tolist(), counts.tolist(), strict=True))
    assert shared > 200


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 2000 + i) for i in range(50)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed,n,p,q,block", [(1, 3, 90, 100, 200_000), (2, 3, 90, 100, 150), (3, 5, 80, 100, 300), (4, 1, 50, 100, 100)])
def test_documents_equal_brute_force(spark, monkeypatch, seed, n, p, q, block):
    monkeypatch.setattr("assetloom.llm.partenum.BLOCK", block)
    monkeypatch.setattr("assetloom.llm.partenum.STAR", block // 3)
    docs = made_up(seed, 260, 6)
    got = jaccard_components(spark.createDataFrame(docs, SCHEMA), n, p, q).collect()
    expected = brute(docs, n, p, q)
    assert sorted((tuple(r) for r in got), key=str) == expected
    assert len({c for _, _, c in expected}) < 250


@pytest.mark.parametrize("seed,n,p,q,few", [(1, 3, 90, 100, 0), (2, 3, 90, 100, 2), (3, 5, 80, 100, 0), (4, 5, 80, 100, 3), (5, 1, 50, 100, 4)])
def test_signatures_of_few_and_of_many(spark, monkeypatch, seed, n, p, q, few):
    monkeypatch.setattr("assetloom.llm.partenum.FEW", few)
    monkeypatch.setattr("assetloom.llm.partenum.BLOCK", 300)
    monkeypatch.setattr("assetloom.llm.partenum.STAR", 100)
    docs = made_up(seed, 220, 12)
    got = jaccard_components(spark.createDataFrame(docs, SCHEMA), n, p, q).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, n, p, q)


def test_a_chain_of_unlike_documents_does_not_meet_as_a_whole(spark, monkeypatch):
    monkeypatch.setattr(partenum, "BLOCK", 600)
    monkeypatch.setattr(partenum, "STAR", 600)
    own, rows = partenum.verified_links, []

    def counted(dealt, *rest):
        rows.append(dealt.count())
        return own(dealt, *rest)

    monkeypatch.setattr(partenum, "verified_links", counted)
    for count in (30, 120):
        docs = [(i, " ".join(f"w{k}" for k in range(15 * i, 15 * i + 104))) for i in range(count)]  # each shares 85 of 100 shingles with the next
        got = jaccard_components(spark.createDataFrame(docs, SCHEMA), 5, 80, 100).collect()
        assert all(r.component_id == r.doc_id for r in got)
    assert 0 < rows[3] <= 6 * rows[1]  # the second round, over four times as many


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    docs = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one\ttwo"), (7, "one two"), (8, long), (9, long + " end"), (None, long), (None, None), (10, "É a b"), (11, "é a b"), (12, "x" * 50_000)]
    frame = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], SCHEMA + ", id int, k1 int, root int")
    got = jaccard_components(frame, 3, 90, 100).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, 3, 90, 100)
    assert jaccard_components(frame.limit(0), 3, 90, 100).count() == 0
    assert len(shingle_set(b"A b", 3)) == 1


@pytest.mark.parametrize("p,q", [(90, 100), (80, 100)])
def test_repeated_ids_with_near_copies(spark, p, q):
    words = [[f"{c}{i}" for i in range(90)] for c in "abcd"]
    a, b, c, d = map(" ".join, words)
    docs = [(1, a), (1, a), (2, a + " end"), (10, b), (10, " ".join(words[2][:40])), (11, b + " end"), (12, " ".join(words[2][:40]) + " end")]
    docs += [(20, d), (21, d), (21, c + " x"), (22, c + " x"), (23, c + " y")]  # both texts of 21 are another's too
    docs += [(i + 100, t) for i, t in made_up(7, 120, 3)] + [(i % 40 + 2000, t) for i, t in made_up(8, 120, 3)]
    got = jaccard_components(spark.createDataFrame(docs, SCHEMA), 3, p, q).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, 3, p, q)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op3_partenum(spark, sf).collect()), key=str) == brute(docs, 3, 90, 100)
