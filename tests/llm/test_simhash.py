import hashlib
import itertools
import random
import re

import xxhash
from pyspark.sql import functions as F

from assetloom.llm.simhash import MAX_WEIGHT, edited_fingerprints, op7_simhash, within_radius

U64 = (1 << 64) - 1


def brute_fingerprint(text):
    votes, total = [0] * 64, 0
    for word in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()):
        h, weight = xxhash.xxh64_intdigest(word.encode(), 42), min(len(word), MAX_WEIGHT)
        total += weight
        for b in range(64):
            votes[b] += weight if h >> b & 1 else 0
    return sum(1 << b for b in range(64) if votes[b] * 2 > total)


def brute_edit(text, following):
    text, following = text or "", following or ""
    gone = len(text) // 3
    return text[: len(text) - gone] + following[:gone]


def check_rows(rows, docs):
    """rows by doc_id against the definition; docs: distinct ids."""
    order = sorted(docs, reverse=True)
    following = {a: b for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id] or ""
        edited = brute_edit(text, docs[following[r.doc_id]])
        own, other, after = (brute_fingerprint(t) for t in (text, edited, docs[following[r.doc_id]]))
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (int(r.fingerprint, 16), int(r.edited_fingerprint, 16)) == (own, other)
        assert r.near_edited == 1 - (own ^ other).bit_count() / 64 and r.near_next == 1 - (own ^ after).bit_count() / 64


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_simhash(spark, sf).collect()
    check_rows(rows, docs)
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    for r in rows:
        expected = sum((prints[r.doc_id] ^ x).bit_count() <= 3 for x in prints.values()) - 1 if r.doc_id % 100 == 0 else None
        assert r.n_within_radius == expected
    texts = {}
    for r in rows:
        assert texts.setdefault(docs[r.doc_id], r.fingerprint) == r.fingerprint


def test_odd_documents(spark, tmp_path):
    texts = [None, "", "   ", "a", "ab", "abc", "été 🙂 été 🙂", "word " * 50_000, "x" * 100_000, "Same Text", "same text", "same\ttext"]
    docs = {i * 7 - 3: t for i, t in enumerate(texts)}
    spark.createDataFrame([(i, t, 1, 2) for i, t in docs.items()], "doc_id long, text string, row int, next int").write.parquet(f"{tmp_path}/documents.parquet")
    rows = op7_simhash(spark, str(tmp_path)).collect()
    check_rows(rows, docs)


def test_one_and_no_document_null_ids_and_repeats(spark):
    schema = "doc_id long, text string"
    assert edited_fingerprints(spark.createDataFrame([], schema)).count() == 0
    (one,) = edited_fingerprints(spark.createDataFrame([(5, "alpha beta gamma")], schema)).collect()
    assert one.next == 5 and one.edited_sha256 == hashlib.sha256(brute_edit("alpha beta gamma", "alpha beta gamma").encode()).hexdigest()
    rows = edited_fingerprints(spark.createDataFrame([(1, "one two three"), (1, "one two three"), (2, "four"), (None, "five six seven")], schema)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.next) for r in rows) == [(False, 1, 2), (False, 1, 2), (False, 2, 1), (True, 0, None)]
    assert next(r for r in rows if r.doc_id is None).edited_sha256 == hashlib.sha256(b"five six s").hexdigest()


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for p in list(prints):
        for _ in range(6):
            q = p
            for b in rng.sample(range(64), rng.randint(0, 6)):
                q ^= 1 << b
            prints.append(q)
    prints = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in prints] + [(None,)], "fingerprint long")
    for radius, blocks in ((0, 1), (3, 5), (3, 4), (5, 6)):
        got = {(r.query, r.found) for r in within_radius(frame, frame, radius, blocks).collect()}
        assert got == {(a, b) for a, b in itertools.product(set(prints), repeat=2) if ((a ^ b) & U64).bit_count() <= radius}


def test_no_python_in_the_plan(spark, capsys):
    edited_fingerprints(spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))).explain()
    assert "Python" not in capsys.readouterr().out
