import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from assetloom.llm.packing import Bins, measured, op9_best_fit, pack, pack_shard

ROWS = "id long, source string, n_words long, cluster long"


def brute_shard(pieces, capacity, per_source):
    """Each piece looks at every bin."""
    bins, out = [], {}
    for i in sorted(range(len(pieces)), key=lambda i: (-pieces[i][1], pieces[i][0] is None, pieces[i][0] or 0, pieces[i][3] or 0, i)):
        _, need, source, cluster = pieces[i]
        fits = []
        for number, held in enumerate(bins):
            room = capacity - sum(p[1] for p in held)
            if room >= need and (source is None or sum(p[2] == source for p in held) < per_source) and (cluster is None or all(p[3] != cluster for p in held)):
                fits.append((room, number))
        if not fits:
            bins.append([])
            fits = [(capacity, len(bins) - 1)]
        room, number = min(fits)  # the tightest, of equally tight ones the oldest
        out[i] = (number, capacity - room)
        bins[number].append(pieces[i])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_every_piece_goes_to_the_oldest_of_the_tightest_compatible_bins(seed):
    rng = random.Random(seed)
    pieces = [(i, rng.randint(1, 50), rng.choice(["hot", "hot", None, *"abc"]), rng.choice([None, 1, 2, *range(10, 40)])) for i in range(150)]
    per_source = rng.randint(1, 3)
    got = {i: (number, offset) for i, number, offset in pack_shard(pieces, 50, per_source)}
    assert got == brute_shard(pieces, 50, per_source)


def test_ties_go_to_the_older_bin():
    bins = Bins(10, 1)
    assert bins.place(6, 1, 0) == (0, 0)
    assert bins.place(7, 1, 0) == (1, 0)  # the source conflicts
    assert bins.place(1, 2, 0) == (1, 7)  # bin 1 has 2 left
    assert bins.place(2, 2, 0) == (0, 6)  # bin 0 has 2 left, later than bin 1
    assert bins.place(2, 4, 0) == (0, 8)


def check(rows, got, capacity, per_source):
    by_id = {r[0]: r for r in rows}
    total, bins = Counter(), defaultdict(list)
    for r in got:
        total[r.id] += r.n_words
        if r.n_words:
            bins[r.bin_id].append(r)
        else:
            assert r.bin_id is None
    assert all(total[i] == (by_id[i][2] or 0) for i in by_id)
    for held in bins.values():
        held.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in held:
            assert r.bin_offset == at
            at += r.n_words
        assert at <= capacity
        clusters = [by_id[r.id][3] for r in held if by_id[r.id][3] is not None]
        sources = Counter(by_id[r.id][1] for r in held if by_id[r.id][1] is not None)
        assert len(set(clusters)) == len(clusters) and all(n <= per_source for n in sources.values())
    return bins


def test_long_documents_hot_sources_and_copies(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["hot", "hot", "hot", None, *"abcdefgh"]), rng.choice([0, 1, 5, 30, 99, 100, 101, 250, 1000]), 7 if i % 3 == 0 else i) for i in range(900)]
    frame = spark.createDataFrame(rows, ROWS)
    got = pack(frame, 100, 2, 100).collect()
    bins = check(rows, got, 100, 2)
    full = sum(r.n_words for r in got)
    assert len(bins) < 2.5 * full / 100
    starts = defaultdict(list)
    for r in got:
        starts[r.id].append((r.piece, r.start_word, r.n_words))
    for pieces in starts.values():
        pieces.sort()
        assert [p[1] for p in pieces] == [100 * k for k in range(len(pieces))]
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, pack(frame.repartition(5), 100, 2, 100).collect()), key=str)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "A b", "s"), (4, "a\nB", "t"), (4, "a\nB", "t"), (None, "x", None), (None, "x", None), (5, "w " * 9000, None)], "doc_id long, text string, source string")
    docs = docs.selectExpr("*", "1 as id", "2 as cluster")
    rows = measured(docs).collect()
    assert len({r.cluster for r in rows if r.id in (3, 4)}) == 1
    got = pack(measured(docs)).collect()
    assert len(got) == 7 + 5 and sum(r.n_words for r in got if r.id == 5) == 9000
    copies = [r.bin_id for r in got if r.id in (3, 4)]
    assert len(set(copies)) == 3
    assert pack(measured(docs.limit(0))).count() == 0
    with pytest.raises(ValueError):
        pack(measured(docs), capacity=0)
    with pytest.raises(ValueError):
        pack(measured(docs), per_source=0)


@pytest.mark.parametrize("kind", ["string", "date", "decimal(9,2)"])
def test_ids_of_any_type(spark, kind):
    """Among them the empty text and null; each row is packed."""
    rows = [(None if i % 9 == 0 else "" if i % 10 == 0 else f"id{i % 40}", "w " * (i % 7), "s") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string")
    if kind != "string":
        docs = docs.withColumn("doc_id", F.expr("date_add(date'2020-01-01', hash(doc_id) % 99)" if kind == "date" else "hash(doc_id) % 99").cast(kind))
    got = pack(measured(docs), 20, 4, 50)
    assert got.schema["id"].dataType.simpleString() == kind
    assert got.count() == 200 and got.agg(F.sum("n_words")).first()[0] == sum(i % 7 for i in range(200))


@pytest.mark.parametrize("seed", range(3))
def test_packing_equals_a_replay(spark, seed):
    """Every shard by a plain best fit: pieces by size, each into the oldest of the tightest bins that take it."""
    rng = random.Random(seed)
    rows = [(f"d{i:03}", rng.choice(["hot", "hot", None, *"abc"]), rng.choice([0, 1, 5, 30, 60, 99, 100, 101, 250]), rng.choice([None, 1, 2, i])) for i in range(300)]
    frame = spark.createDataFrame(rows, "id string, source string, n_words long, cluster long")
    found = defaultdict(list)
    for r in pack(frame, 100, 2, 60).collect():
        found[r.id].append((r.piece, r.start_word, r.n_words, r.bin_id, r.bin_offset))
    shards = {r.id: r.shard for r in frame.select("id", F.pmod(F.xxhash64(F.xxhash64("id"), "cluster"), F.lit(5)).alias("shard")).collect()}
    expected = {}
    for shard in range(5):
        own = sorted(r for r in rows if shards[r[0]] == shard)
        bins, whole = [], []
        for i, source, n, cluster in sorted(own, key=lambda r: (-(r[2] % 100), r[0])):
            if n % 100:
                fits = [(100 - sum(x[1] for x in b), k) for k, b in enumerate(bins) if sum(x[1] for x in b) + n % 100 <= 100 and sum(x[2] == source for x in b if source) < 2 and not any(x[3] == cluster for x in b if cluster is not None)]
                k = min(fits)[1] if fits else len(bins)
                if not fits:
                    bins.append([])
                expected.setdefault(i, []).append((n // 100, n // 100 * 100, n % 100, (shard << 32) + k, sum(x[1] for x in bins[k])))
                bins[k].append((i, n % 100, source, cluster))
            elif not n:
                expected[i] = [(0, 0, 0, None, None)]
        for i, _, n, _ in own:
            whole += [(i, p) for p in range(n // 100)]
        for k, (i, p) in enumerate(whole):
            expected.setdefault(i, []).append((p, p * 100, 100, (shard << 32) + len(bins) + k, 0))
    assert {i: sorted(x, key=str) for i, x in found.items()} == {i: sorted(x, key=str) for i, x in expected.items()}


def test_bitmaps_close_a_source():
    bins = Bins(10, 1)
    assert bins.place(4, 1, 0) == (0, 0) and bins.place(4, 1, 0) == (1, 0) and bins.place(6, 2, 0) == (0, 4) and bins.in_use == 1 << 6


def test_query_packs_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in measured(docs).collect()]
    assert {r[0]: r[2] for r in rows} == {d.doc_id: len(d.text.encode().split()) for d in docs.collect()}
    check(rows, op9_best_fit(spark, sf).withColumnRenamed("doc_id", "id").collect(), 2048, 4)
