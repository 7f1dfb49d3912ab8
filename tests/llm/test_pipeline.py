import hashlib
from collections import Counter

import corpus_pipeline
from assetloom.llm.language_id import document_evidence, document_model, identify

SF = "/root/testdata/sf0.001"


def shingles(text, n):
    w = text.encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def without_near_duplicates(docs):
    found = [(i, shingles(t, 5)) for i, t in sorted(docs.items())]
    root = {i: i for i in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(found):
        for j, b in found[:k]:
            both = len(a & b)
            if both and 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return {i: t for i, t in docs.items() if top(i) == i}


def without_repeats(docs, window=50):
    first = {}
    for i, t in sorted(docs.items()):
        w = t.encode().split()
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    out = {}
    for i, t in docs.items():
        w = t.encode().split()
        gone = {k for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < i for k in range(s, s + window)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else t
        if kept or not gone:
            out[i] = kept
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {r.doc_id: r.text for r in docs.collect()}
    accepted = {r.id for r in identify(document_evidence(docs), document_model(docs)).where("accepted").collect()}
    expected = [{i: t for i, t in kept.items() if i in accepted}]
    expected.append(without_near_duplicates(expected[0]))
    expected.append(without_repeats(expected[1]))
    assert len(expected[2]) <= len(expected[1]) < len(expected[0]) <= len(kept)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 3:
            assert docs.columns == columns
            assert {r.doc_id: hashlib.sha256(r.text.encode()).digest() for r in docs.collect()} == {i: hashlib.sha256(t.encode()).digest() for i, t in expected[k].items()}
    words = Counter()
    for r in docs.collect():
        words[r.doc_id] += r.n_words
    assert words == Counter({i: len(t.encode().split()) for i, t in expected[2].items()})


def test_stages_on_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, id int, kept_ string"
    line = " ".join(f"the{i} and of" for i in range(30))
    rows = [(1, line, "en", "s", 1), (2, line, "en", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (None, line, "en", "s", 1), (5, line + " the end of it and more " * 10, "en", None, 1), (1, line, "en", "s", 1)]
    for name, data in (("some", rows), ("none", [])):
        docs = spark.createDataFrame([(*r, 7, "x") for r in data], schema)
        for stage, f in corpus_pipeline.STAGES:
            f(spark, docs, SF).write.parquet(f"{tmp_path}/{name}-{stage}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{stage}")
            if stage != "packing":
                assert docs.schema.names == schema.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
        if name == "none":
            assert docs.count() == 0
        else:
            assert {1, 5, None} >= {r.doc_id for r in docs.collect()} >= {1}


def test_stages_by_themselves_on_rows_without_words(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(1, line, "en", "s", 9), (2, line, "en", "s", 9), (3, None, None, None, 9), (4, "", "en", "s", 9), (5, " ", "en", "s", 9), (6, line + " more", "en", "s", 9)]
    docs = spark.createDataFrame(rows, schema)
    kept = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()}
    assert kept == {1: (line, len(line)), 3: (None, None), 4: ("", 0), 5: (" ", 1), 6: ("more", 4)}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == {1, 3, 4, 5}
    assert not {r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()} & {3, 4, 5}
    bins = {r.doc_id: (r.n_words, r.bin_id is None) for r in corpus_pipeline.packing(spark, docs, SF).collect()}
    assert bins == {1: (60, False), 2: (60, False), 3: (0, True), 4: (0, True), 5: (0, True), 6: (61, False)}
