"""Language identification by Bayesian evidence fusion.

The posterior of a language multiplies four kinds of evidence:

* the text's likelihood under the language's byte trigrams (hashed to ``BUCKETS``), learnt from
  labelled rows, ``SAMPLE`` at most, dealt evenly over the labels of all rows (a label with fewer rows gives
  all of them, the others those with the smallest hash of their id); unseen trigrams are equally likely in
  each language; the logarithm is divided by ``TEMPER`` since neighbouring trigrams say the same;
* the declared markup language, which is right with probability ``DECLARED_RIGHT``;
* the address suffix, and
* the host: their languages by grouped counts of the first two kinds' decisions over all rows, each
  level smoothed towards the one above with ``STRENGTH`` rows: all rows, suffix, host. A row's own decision is left out
  of the counts that judge it, so that a row that is alone on its host doesn't echo itself.

Documents have no markup: their language column is the label that the text model learns from and no evidence. So
that no row is judged by what it taught, rows lie in ``FOLDS`` parts by a hash of their id, and each part is judged by the model that
the others give (a language whose labelled rows all lie in one part is learnt from there for all).

One more class, ``und``, gives every trigram the same likelihood, halfway (in logarithms) between that of
equally frequent trigrams and that of one never seen: numbers and addresses in a text don't make it
foreign to every language, but a text of unseen trigrams is no language. Rows that come out as ``und`` or have no text are rejected.

Defined results: null or empty text is ``und``; null declared language, suffix or host adds nothing;
a declared language that isn't known adds nothing; ties go to the language that comes first in the
alphabet; rows are judged each by itself given the counts, so repeated rows get equal results; without
labelled rows every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, join_skewed, text_bytes

BUCKETS = 1 << 16
SAMPLE = 8000
TEMPER = 4.0
DECLARED_RIGHT = 0.9
STRENGTH = 20.0
UNKNOWN = "und"
#: Labels that can be languages: the most frequent ones. Others teach nothing (a label column with more isn't one of languages).
MOST_LABELS = 1000
FOLDS = 2
#: Trigrams looked up at once.
_SLICE = 1 << 20


def trigrams(raw: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of a text between two spaces, A-Z in lower case."""
    x = np.frombuffer(b" " + raw.lower() + b" ", np.uint8).astype(np.uint32)
    return ((x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(2654435761)) >> np.uint32(16)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihoods by bucket and language) from rows (id, text, label)."""
    rows = labelled.where(F.col("label").isNotNull() & (F.col("text") != ""))
    ids = rows.where(F.col("id").isNotNull()).select("id", "label").distinct()
    counted = ids.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(min(sample, MOST_LABELS))
    counts = [(r["label"], r["n"]) for r in counted.collect()]
    quotas, left = [], sample
    for k, (label, n) in enumerate(reversed(counts)):  # the rarest first: what they leave goes to the others
        quota = min(n, left // (len(counts) - k))
        left -= quota
        # about as many by the hash, and some more to choose from
        quotas.append((label, quota, min(1.0, (quota + 8 * quota**0.5 + 50) / n)))
    limits = rows.sparkSession.createDataFrame(quotas, "label string, quota int, share double")
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    near = ids.join(F.broadcast(limits), "label").withColumn("place", place).where("place <= share")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("place", "id")))
    chosen = ranked.where("rank <= quota").select("id", "label")
    rows = rows.join(F.broadcast(chosen), ["id", "label"]).select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                if raw:
                    own = sums.setdefault(label, np.zeros(BUCKETS, np.int64))
                    own += np.bincount(trigrams(raw), minlength=BUCKETS)
        for label, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at)), pa.array(at), pa.array(own[at])], ["label", "bucket", "n"])

    found = rows.mapInArrow(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["label"].unique())
    table = np.zeros((BUCKETS, len(languages)))
    table[found["bucket"], found["label"].map(languages.index)] += found["n"]
    seen = table.sum(0)
    unseen = 0.5 / (BUCKETS / 2 + seen.max(initial=0))  # the same in each language, however little text it has
    return languages, np.log((1 - BUCKETS * unseen) * table / seen + unseen).astype(np.float32)


def cross_fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[np.ndarray]]:
    """(languages, a table for the rows of each fold) from rows (id, text, label): each learnt from the other folds."""
    parts = [fit(labelled.where(fold(F.col("id")) != k), sample // FOLDS) for k in range(FOLDS)]
    languages = sorted({name for names, _ in parts for name in names})
    tables = []
    for k in range(FOLDS):
        ways = [dict(zip(names, table.T, strict=True)) for names, table in [parts[k], *parts]]
        tables.append(np.array([next(way[name] for way in ways if name in way) for name in languages], np.float32).T.reshape(BUCKETS, len(languages)))
    return languages, tables


def fold(key: Column) -> Column:
    """The part of a row by its id; null ids are in the first."""
    return F.coalesce(F.pmod(F.shiftright(F.xxhash64(key), 7), F.lit(FOLDS)).cast("int"), F.lit(0))


def unknown_rate(table: np.ndarray) -> float:
    """Log-likelihood of any trigram in no language."""
    alike = -float(np.log(BUCKETS))
    return (alike + float(table.min())) / 2 if table.size else alike


def text_evidence(rows: DataFrame, model: tuple[list[str], np.ndarray | list[np.ndarray]]) -> DataFrame:
    """Adds ``evidence``: tempered log-likelihoods of ``text`` in each language, then in none; null without text. ``fold`` says which of several tables."""
    shared = rows.sparkSession.sparkContext.broadcast(model[1] if isinstance(model[1], list) else [model[1]])
    others = [f for f in rows.schema.fieldNames() if f != "text"]

    def look(batches: Iterator[pa.RecordBatch]):
        tables = shared.value
        unknown = [unknown_rate(table) for table in tables]
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                found = []
                for k, raw in zip(part.column("fold").to_pylist(), text_bytes(part.column("text")), strict=True):
                    table, none = tables[k], unknown[k]
                    if not raw.strip():
                        found.append(None)
                        continue
                    at = trigrams(raw)
                    sums = sum(table[at[i : i + _SLICE]].sum(0, dtype=np.float64) for i in range(0, len(at), _SLICE))
                    found.append([*(sums / TEMPER).tolist(), len(at) * none / TEMPER])
                yield pa.RecordBatch.from_arrays([*(part.column(f) for f in others), pa.array(found, pa.list_(pa.float64()))], [*others, "evidence"])

    kinds = ", ".join(f"{f} {rows.schema[f].dataType.simpleString()}" for f in others)
    return rows.mapInArrow(look, f"{kinds}, evidence array<double>")


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _best(scores: Column, names: Column) -> Column:
    return F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))


def place(host: Column, suffix: Column) -> Column:
    """One key of a host under a suffix, null without a host."""
    return F.concat(F.when(suffix.isNull(), F.lit("")).otherwise(F.concat(F.lit("."), suffix)), F.lit("\n"), host)


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(id, content, lang, posterior, text_lang, accepted) of rows (id, content, text, declared, suffix, host, and fold if the model has several)."""
    if "fold" not in rows.columns:
        rows = rows.withColumn("fold", F.lit(0))
    languages = [*model[0], UNKNOWN]
    names = F.array(*map(F.lit, languages))
    size = len(model[0])
    right, wrong = float(np.log(DECLARED_RIGHT)), float(np.log((1 - DECLARED_RIGHT) / max(1, size - 1)))
    known = F.lower("declared").isin(model[0]) if size else F.lit(False)
    declared = F.array(*[F.when(~F.coalesce(known, F.lit(False)), F.lit(0.0)).when(F.lower("declared") == name, F.lit(right)).otherwise(F.lit(wrong if name != UNKNOWN else 0.0)) for name in languages])
    seen = cut(text_evidence(rows, model).withColumn("evidence", _add(F.col("evidence"), declared)).withColumn("text_lang", _best(F.col("evidence"), names)), "language-evidence")

    decided = seen.where(F.col("text_lang").isNotNull())
    counts = lambda *by: decided.groupBy(*by).pivot("text_lang", languages).agg(F.count(F.lit(1)))
    as_array = F.array(*[F.coalesce(F.col(f"`{n}`"), F.lit(0)).cast("double") for n in languages])
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    everything = decided.groupBy("text_lang").count().collect()
    all_counts = F.array(*[F.lit(float(sum(r["count"] for r in everything if r["text_lang"] == n))) for n in languages])
    # a row's own decision is no evidence for it: it is taken from the counts of every level
    mine = F.array(*[F.when(F.col("text_lang") == n, F.lit(1.0)).otherwise(F.lit(0.0)) for n in languages])
    others = lambda c: F.zip_with(c, mine, lambda n, m: n - m)

    def smoothed(own: Column, above: Column) -> Column:
        return F.zip_with(own, above, lambda n, p: (n + STRENGTH * p) / (total(own) + STRENGTH))

    suffixes = cut(counts("suffix").where("suffix is not null").select("suffix", as_array.alias("of_suffix"), total(as_array).alias("rows")), "language-suffixes")
    hosts = counts("host", "suffix").where("host is not null").select("host", F.col("suffix").alias("its_suffix"), as_array.alias("of_host"))
    hosts = cut(hosts.select(place(F.col("host"), F.col("its_suffix")).alias("place"), "of_host", total("of_host").alias("rows")), "language-hosts")
    # every row that decided something is counted at its host and suffix, so each key that isn't null is met; the others have no score
    fused = join_skewed(decided.withColumn("place", place(F.col("host"), F.col("suffix"))), hosts, ["place"], "rows", "left").drop("rows")
    fused = join_skewed(fused, suffixes, ["suffix"], "rows", "left")
    top = F.transform(others(all_counts), lambda n: (n + 1) / (total(others(all_counts)) + size + 1))
    by_suffix = F.coalesce(smoothed(others(F.col("of_suffix")), F.col("top")), "top")
    by_host = F.coalesce(smoothed(others(F.col("of_host")), F.col("by_suffix")), "by_suffix")
    fused = fused.withColumn("top", top).withColumn("by_suffix", by_suffix).withColumn("score", _add(F.col("evidence"), F.transform(by_host, lambda p: F.log(p))))
    peak = F.array_max("score")
    share = 1 / total(F.transform("score", lambda s: F.exp(s - F.array_max("score"))))
    lang = _best(F.col("score"), names)
    told = fused.select("id", "content", lang.alias("lang"), F.when(peak.isNotNull(), share).alias("posterior"), "text_lang", (lang != UNKNOWN).alias("accepted"))
    silent = seen.where(F.col("text_lang").isNull()).select("id", "content", F.lit(UNKNOWN).alias("lang"), F.lit(None).cast("double").alias("posterior"), "text_lang", F.lit(False).alias("accepted"))
    return told.unionByName(silent)


def document_evidence(docs: DataFrame) -> DataFrame:
    """Rows to identify: a document's ``source`` is its host; nothing is declared (its column ``lang`` is the label)."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("content"), text.alias("text"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").cast("string").alias("host"), fold(F.col("doc_id")).alias("fold"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Rows to identify: text without markup, ``lang`` of the html tag, the host and the first part of the path or else the top-level domain."""
    text = F.regexp_replace(F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&[#\w]+;", " ")
    declared = F.nullif(F.regexp_extract("html", r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([a-z]+)""", 1), F.lit(""))
    host = F.nullif(F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1)), F.lit(""))
    suffix = F.coalesce(F.nullif(F.regexp_extract("url", r"://[^/?#]*/([a-z]{2})/", 1), F.lit("")), F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit("")))
    return pages.select(F.col("page_id").alias("id"), F.xxhash64("html").alias("content"), text.alias("text"), declared.alias("declared"), suffix.alias("suffix"), host.alias("host"))


def labelled(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("label"))


def document_model(docs: DataFrame) -> tuple[list[str], list[np.ndarray]]:
    return cross_fit(labelled(docs))


def in_a_language(docs: DataFrame) -> DataFrame:
    """The documents that aren't rejected."""
    rejected = identify(document_evidence(docs), document_model(docs)).where(~F.col("accepted")).select("id", F.col("content").alias("content_")).distinct()
    same = docs["doc_id"].eqNullSafe(rejected["id"]) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(rejected["content_"])
    return docs.join(rejected, same, "left_anti")


def op5_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(document_evidence(docs), document_model(docs)).withColumnRenamed("id", "doc_id").drop("content")


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on pages, where markup, address and host speak too."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return identify(page_evidence(pages), fit(labelled(documents(spark, sf_dir)))).withColumnRenamed("id", "page_id").drop("content")
