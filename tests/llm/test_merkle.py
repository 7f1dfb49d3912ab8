"""The manifest against a tree that is built row by row."""

import hashlib
import random
import zlib
from functools import partial

import pytest
from pyspark.sql import functions as F

from assetloom.llm import merkle

MANIFEST = merkle.manifest
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def fold_up(nodes, fanout):
    """(top, for each node its [(left, right), ...])."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = nodes[place // fanout * fanout : place // fanout * fanout + fanout]
            paths[i].append(("".join(run[: place % fanout]), "".join(run[place % fanout + 1 :])))
        nodes = [h(*nodes[j : j + fanout]) for j in range(0, len(nodes), fanout)]
        at = [place // fanout for place in at]
    return nodes[0], paths


def brute_force(rows, fanout=16):
    """Rows (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for doc, text, lang, source, n in rows:
        leaf = h(*map(field, (doc, source, lang, n, text)))
        tampered = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0
        used = h(*map(field, (doc, source, lang, n, lower(text)))) if tampered else leaf
        groups.setdefault(source, []).append((doc, leaf, used))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        held = sorted(groups[name], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((held, *fold_up([x[1] for x in held], fanout)))
    root, above = fold_up([t[1] for t in trees], fanout) if trees else (None, [])
    out = []
    for (held, subroot, paths), up in zip(trees, above, strict=True):
        for (doc, leaf, used), path in zip(held, paths, strict=True):
            current = used
            for left, right in path + up:
                current = h(left, current, right)
            out.append((doc, leaf, subroot, root, h(*[a + b for a, b in path + up]), current, current == root))
    return sorted(out, key=str)


def run(spark, rows, monkeypatch, fanout=16):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit("x"), "idx": F.lit(1), "tree": F.lit("t")})
    monkeypatch.setattr(merkle, "documents", lambda *_: docs)
    monkeypatch.setattr(merkle, "manifest", partial(MANIFEST, fanout=fanout))
    found = merkle.op13_merkle(spark, "")
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, found.collect()), key=str)


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    found = sorted(map(tuple, merkle.op13_merkle(spark, SF).collect()), key=str)
    assert found == brute_force(list(map(tuple, rows)))
    assert 0 < sum(not r[-1] for r in found) < len(found)


@pytest.mark.parametrize("fanout", [2, 16])
def test_odd_rows(spark, monkeypatch, fanout):
    rng = random.Random(3)
    rows = [(i, f"Text {i} É", "en", "hot", 5) for i in range(40)]
    rows += [(rng.randrange(60), rng.choice([None, "", "Aé", "b" * 3000]), rng.choice([None, "de"]), rng.choice([None, "", "-", "ä", "z", "Z"]), rng.choice([None, 0, -1])) for _ in range(70)]
    rows += rows[:9] + [(None, None, None, None, None)] * 2 + [(7, "Lone", "en", "only", 4)]
    assert run(spark, rows, monkeypatch, fanout) == brute_force(rows, fanout)


def test_one_group_and_none(spark, monkeypatch):
    assert run(spark, [(5, "A", "en", "s", 1)], monkeypatch) == brute_force([(5, "A", "en", "s", 1)])
    rows = [(i, "A", "en", "s", 1) for i in range(17)]
    assert run(spark, rows, monkeypatch) == brute_force(rows)


def test_empty_table(spark, monkeypatch):
    assert run(spark, [], monkeypatch) == []


def test_text_keys_and_the_fold(spark):
    """The general interface: any key type, own columns, a path that proves its leaf."""
    rows = spark.createDataFrame([(f"k{i}", i % 3, i) for i in range(50)], "name string, part int, v int").withColumn("leaf", merkle.leaf(F.col("name"), F.col("v")))
    found = merkle.manifest(rows, "part", "name", ["v"], fanout=4)
    assert found.columns == ["name", "v", "leaf", "subroot", "root", "path"]
    ok = found.select("v", (merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok"), (merkle.folded(F.lit("0"), F.col("path")) == F.col("root")).alias("bad")).collect()
    assert sorted(r["v"] for r in ok) == list(range(50))
    assert all(r["ok"] and not r["bad"] for r in ok)
    with pytest.raises(ValueError):
        merkle.manifest(rows, "part", "name", fanout=1)


def test_a_hot_group_is_many_stretches(spark):
    """All rows in one group: they are numbered by several tasks, without gaps."""
    rows = spark.range(5000).select(F.lit("s").alias("tree"), "id")
    found = merkle.indexed(rows, "tree", ["id"], "test").collect()
    assert sorted((r["id"], r["idx"], r["m"]) for r in found) == [(i, i, 5000) for i in range(5000)]
