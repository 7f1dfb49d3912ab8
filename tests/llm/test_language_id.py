import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from assetloom.llm.language_id import BUCKETS, document_evidence, document_model, fit, fold, identify, in_a_language, op5_language_fusion, page_evidence, pages_language, trigrams

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = "id long, content long, text string, declared string, suffix string, host string"
WORDS = {"en": "the and of to in that is was for it with as his on be at by had not are but from".split(), "de": "der und die in den von zu das mit sich des auf ist im dem nicht ein eine als auch".split(), "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur".split()}


def text(lang, seed, n=60):
    return " ".join(random.Random(seed).choices(WORDS[lang], k=n))


def labelled(spark):
    return spark.createDataFrame([(i * 3 + k, text(lang, i), lang) for i in range(40) for k, lang in enumerate(WORDS)], "id long, text string, label string")


def test_trigrams_and_fit(spark):
    assert len(trigrams(b"ab")) == 2 and len(trigrams(b"")) == 0 and (trigrams(b"AbC") == trigrams(b"aBc")).all()
    languages, table = fit(labelled(spark))
    assert languages == ["de", "en", "fr"] and table.shape == (BUCKETS, 3) and np.allclose(np.exp(table.astype(float)).sum(0), 1, atol=1e-3)
    few, _ = fit(labelled(spark), sample=1)
    assert len(few) == 1


def test_evidence_is_fused(spark):
    model = fit(labelled(spark))
    rows = [(1, 1, text("en", 900), "en", "com", "a.com"), (2, 2, text("de", 901), None, None, None), (3, 3, text("fr", 902), "xx", "fr", None), (4, 4, None, "en", "com", "a.com"), (5, 5, "", None, None, "a.com"), (6, 6, "%%%% #### @@@@ $$$$ " * 20, "en", "com", "a.com"), (7, 7, text("en", 903), "de", "de", "b.de"), (None, None, text("en", 904), "en", None, "a.com"), (8, 8, text("de", 905) * 500, "de", "de", "b.de"), (8, 8, text("de", 905) * 500, "de", "de", "b.de")]
    rows += [(100 + i, 100 + i, text("de", i), None, "de", "b.de") for i in range(60)] + [(200 + i, 200 + i, "in", None, "de", "b.de") for i in range(2)] + [(300 + i, 300 + i, text("en", i), None, "com", "c.com") for i in range(60)] + [(400, 400, "in", None, "com", "c.com"), (401, 401, "in", "fr", "com", "c.com")]
    got = {}
    for r in identify(spark.createDataFrame(rows, ROWS), model).collect():
        got.setdefault(r.id, r)
    assert [got[i].lang for i in (1, 2, 3, 7, None, 8)] == ["en", "de", "fr", "en", "en", "de"]
    assert [got[i].accepted for i in (1, 4, 5, 6)] == [True, False, False, False]
    assert got[4].posterior is None and 0.99 < got[1].posterior <= 1
    assert got[200].lang == "de" and got[400].lang == "en"  # two letters that say little: the host decides
    assert identify(spark.createDataFrame(rows[:1], ROWS).limit(0), model).count() == 0


def test_rare_and_thin_languages(spark):
    rare = spark.createDataFrame([(1000 + i, "och att det som en " * 3, "sv") for i in range(2)], "id long, text string, label string")
    for sample in (8, 40, 8000):
        model = fit(labelled(spark).unionByName(rare), sample)
        assert model[0] == ["de", "en", "fr", "sv"]
        rows = [(1, 1, "%%%% #### @@@@ $$$$ " * 20, None, None, None), (2, 2, "och det som att en " * 4, None, None, None), (3, 3, "7391 +++ ~~ 0x5f " * 20, "sv", None, None)]
        got = {r.id: r for r in identify(spark.createDataFrame(rows, ROWS), model).collect()}
        assert [got[i].accepted for i in (1, 2, 3)] == [False, True, False] and got[2].lang == "sv"
        # what nobody has seen says nothing for the language with the least text
        assert np.allclose(model[1].min(0), model[1].min())


def test_posterior_by_hand(spark):
    model = fit(labelled(spark))
    rows = spark.createDataFrame([(1, 1, "in", "en", "com", "a.com")], ROWS)
    (r,) = identify(rows, model).collect()
    at = trigrams(b"in")
    ll = np.append(model[1][at].sum(0, dtype=float) / 4, len(at) * (model[1].min() - np.log(BUCKETS)) / 2 / 4)
    ll += np.log([0.05, 0.9, 0.05, 1.0])
    p = np.exp(ll)  # its own decision is left out, so all priors are even
    assert r.lang == "en" and abs(r.posterior - p.max() / p.sum()) < 1e-6


def test_a_row_is_no_evidence_for_itself(spark):
    """Alone on its host, or with others: the prior is what the others say, level by level."""
    model = fit(labelled(spark))
    rows = [(1, 1, text("en", 1), None, "de", "a.de"), (2, 2, text("de", 2), None, "de", "b.de"), (3, 3, text("de", 3), None, "de", "b.de"), (4, 4, text("fr", 4), None, None, None)]
    got = {r.id: r for r in identify(spark.createDataFrame(rows, ROWS), model).collect()}
    decided = {1: 1, 2: 0, 3: 0, 4: 2}
    for i, _, t, _, suffix, host in rows:
        at = trigrams(t.encode())
        ll = np.append(model[1][at].sum(0, dtype=float) / 4, len(at) * (model[1].min() - np.log(BUCKETS)) / 2 / 4)
        others = [(np.eye(4)[decided[j]], s, h) for j, _, _, _, s, h in rows if j != i]
        prior = (sum(e for e, _, _ in others) + 1) / (len(others) + 4)
        for level in (lambda s, h: s == suffix, lambda s, h: (s, h) == (suffix, host)):
            if suffix is not None:
                met = [e for e, s, h in others if level(s, h)]
                prior = (sum(met, np.zeros(4)) + 20 * prior) / (len(met) + 20)
        p = np.exp(ll - ll.max()) * prior
        assert abs(got[i].posterior - p.max() / p.sum()) < 1e-5


def test_null_and_silent_rows_stay_apart(spark):
    """Rows without host, suffix or text pass no shuffle: no task holds them all."""
    model = fit(labelled(spark))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(0, 4000, 1, 8).select("id", F.col("id").alias("content"), F.when(F.col("id") % 2 == 0, "the and of to in").alias("text"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.lit(None).cast("string").alias("host"))
        found = identify(rows, model).groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in found) == 4000 and max(r["count"] for r in found) <= 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = document_model(docs.where("doc_id % 2 = 0"))
    rows = document_evidence(docs.where("doc_id % 2 = 1")).withColumn("declared", F.lit(None).cast("string"))
    got = identify(rows, model).join(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("label")), "id").collect()
    right = sum(r.lang == r.label for r in got) / len(got)
    assert right > 0.95, right


def test_query_equals_brute_force(spark):
    """Two models from counters, each judging what the other learnt from; priors of sources; posteriors."""
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text or "", r.lang, r.source, r.fold) for r in spark.read.parquet(f"{sf}/documents.parquet").withColumn("fold", fold(F.col("doc_id"))).collect()]
    assert {r[4] for r in rows} == {0, 1} and len(rows) < 4000  # so all rows are learnt from
    names = sorted({r[2] for r in rows})

    def grams(text):
        raw = b" " + text.encode().lower() + b" "
        return Counter((int.from_bytes(raw[i : i + 3], "big") * 2654435761) % 2**32 >> 16 for i in range(len(raw) - 2))

    counts = {(k, lang): sum((grams(t) for _, t, label, _, f in rows if t and label == lang and f != k), Counter()) for k in (0, 1) for lang in names}
    assert all(counts.values())
    evidence = {}
    for i, t, _, _, k in rows:
        if t.strip():
            unseen = 0.5 / (BUCKETS / 2 + max(counts[k, lang].total() for lang in names))
            none = (math.log(unseen) - math.log(BUCKETS)) / 2
            found = grams(t)
            logs = [sum(n * math.log((1 - BUCKETS * unseen) * counts[k, lang][g] / counts[k, lang].total() + unseen) for g, n in found.items()) for lang in names]
            evidence[i] = np.array([*logs, none * found.total()]) / 4
    own = {}
    for i, _, _, source, _ in rows:
        if i in evidence:
            for key in (source, "all"):
                own.setdefault(key, np.zeros(len(names) + 1))[evidence[i].argmax()] += 1
    got = {r.doc_id: r for r in op5_language_fusion(spark, sf).collect()}
    assert len(got) == len(rows)
    differs = 0
    for i, _, label, source, _ in rows:
        if i not in evidence:
            assert (got[i].lang, got[i].posterior) == ("und", None)
            continue
        mine = np.eye(len(names) + 1)[evidence[i].argmax()]
        top = (own["all"] - mine + 1) / (own["all"] - mine + 1).sum()
        prior = top if source is None else (own[source] - mine + 20 * top) / (own[source].sum() - 1 + 20)
        score = evidence[i] + np.log(prior)
        share = np.exp(score - score.max())
        assert got[i].lang == [*names, "und"][score.argmax()] and got[i].text_lang == [*names, "und"][evidence[i].argmax()]
        assert abs(got[i].posterior - 1 / share.sum()) < 1e-3
        differs += got[i].lang != label
    assert differs < 0.1 * len(rows)


def test_labels_are_not_echoed(spark):
    """A wrong label doesn't come back as the row's language."""
    rows = [(i, text(lang, i), "fr" if i % 10 == 0 else lang, "s", 1) for i in range(120) for lang in [list(WORDS)[i % 2]]]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r.lang for r in identify(document_evidence(docs), document_model(docs)).collect()}
    assert got == {i: list(WORDS)[i % 2] for i in range(120)}


def test_queries_and_stage_keep_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = op5_language_fusion(spark, sf).collect()
    assert len(got) == docs.count()
    kept = {r.doc_id for r in in_a_language(docs).collect()}
    assert kept == {r.doc_id for r in got if r.accepted} and len(kept) > 0.9 * len(got)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = {r.page_id: r for r in pages_language(spark, sf).collect()}
    assert len(found) == pages.count()
    declared = {r.id: r.declared for r in page_evidence(pages).collect()}
    assert sum(found[i].lang == d for i, d in declared.items()) > 0.9 * len(found)


def test_stage_on_odd_rows(spark):
    rows = [(1, text("en", 1), "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, text("de", 2), "de", "s", 1), (None, None, "de", None, 1), (4, text("fr", 3), None, None, 1), (4, text("fr", 3), None, None, 1)]
    docs = spark.createDataFrame([(*r, 5, "h") for r in rows], SCHEMA + ", id int, host string")
    assert sorted(in_a_language(docs).select("doc_id").collect(), key=str) == sorted([(1,), (None,), (4,), (4,)], key=str)
    assert in_a_language(docs).columns == docs.columns
    assert in_a_language(docs.limit(0)).count() == 0
