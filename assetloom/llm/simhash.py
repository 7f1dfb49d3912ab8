"""SimHash fingerprints with DataFrame functions only.

Each word of a text votes on 64 bits: its 64-bit hash says yes or no, its weight (its length, ``MAX_WEIGHT``
at most, so function words say little) how loud. Votes are counted two bits to a long: bit k and bit
k + 32 share one sum. A field can't run over, since the weights of a text sum to its length at most.
``within_radius`` finds all fingerprints within a Hamming radius by permuted block tables: of
``blocks`` blocks at least ``blocks - radius`` agree, so each choice of so many blocks is the key of a
table, and only fingerprints that share a table's key are compared.

Defined results: null text counts as empty and has fingerprint 0; equal texts have equal fingerprints;
rows with a null id have no neighbour (their edited text just loses its end, ``near_next`` is null);
of rows with one id the smallest text is what others see as that id's text; repeated rows give repeated
results; whole texts count.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, join_skewed

MAX_WEIGHT = 12
WHITE = r"[\x20\x09-\x0D]+"
_HALVES = (1 << 32) | 1


def votes(h: Column, weight: Column) -> list[Column]:
    """32 sums: the weights of the terms that have bit k (low half) and bit k + 32 (high half) set."""
    return [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_HALVES)) * weight).alias(f"votes_{k}") for k in range(32)]


def fingerprint_of_votes(total: Column) -> Column:
    """Bit b is set where more than half of the weight has it set."""
    bits = []
    for k in range(32):
        both = F.col(f"votes_{k}")
        for field, bit in ((both.bitwiseAND(F.lit(0xFFFFFFFF)), k), (F.shiftrightunsigned(both, 32), k + 32)):
            value = 1 << bit if bit < 63 else -(1 << 63)
            bits.append(F.when(field * 2 > total, F.lit(value)).otherwise(F.lit(0)))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, fingerprint long): keys must tell the rows apart. Grouping keeps a partitioning by some of the keys."""
    words = rows.select(*keys, F.explode_outer(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), WHITE)).alias("term"))
    terms = words.select(*keys, F.xxhash64("term").alias("h"), F.least(F.length("term"), F.lit(MAX_WEIGHT)).cast("long").alias("weight"))
    counted = terms.groupBy(*keys).agg(*votes(F.col("h"), F.col("weight")), F.sum("weight").alias("total"))
    return counted.select(*keys, fingerprint_of_votes(F.col("total")).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def block_tables(fingerprint: Column, radius: int, blocks: int) -> Column:
    """Array of (table, key) of a fingerprint: the bits of each choice of ``blocks - radius`` blocks."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("radius must be less than the number of blocks")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    chosen = [signed(sum(masks[i] for i in c)) for c in combinations(range(blocks), blocks - radius)]
    return F.array(*[F.struct(F.lit(i).alias("table"), fingerprint.bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(chosen)])


def within_radius(queries: DataFrame, corpus: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(query, found): all pairs of distinct fingerprints of both frames' ``fingerprint`` at most ``radius`` bits apart."""

    def tables(df: DataFrame, name: str) -> DataFrame:
        own = df.select(F.col("fingerprint").alias(name)).where(F.col(name).isNotNull()).distinct()
        return own.select(name, F.explode(block_tables(F.col(name), radius, blocks)).alias("at")).select(name, "at.table", "at.bits")

    pairs = tables(queries, "query").join(tables(corpus, "found"), ["table", "bits"])
    return pairs.where(F.bit_count(F.col("query").bitwiseXOR(F.col("found"))) <= radius).select("query", "found").distinct()


def next_ids(docs: DataFrame, key: str, label: str) -> DataFrame:
    """(key, next): each distinct id and the next smaller one; after the smallest comes the largest.

    Ids are sorted over range partitions; only one row for each partition is put in order in one task.
    """
    ids = cut(docs.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(key).withColumn("part", F.spark_partition_id()), label)
    inner = ids.withColumn("next", F.lag(key).over(Window.partitionBy("part").orderBy(key)))
    ends = ids.groupBy("part").agg(F.max(key).alias("largest"))
    ends = ends.select("part", F.lag("largest").over(Window.orderBy("part")).alias("before"), F.max("largest").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("top"))
    return inner.join(F.broadcast(ends), "part").select(key, F.coalesce("next", "before", "top").alias("next"))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint long, next): of each text and of its edited text.

    The edited text has its last third replaced by as much of the beginning of the next smaller id's text.
    """
    all_rows = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    whole = all_rows.where(F.col(key).isNotNull())  # filtered once, so both joins below share one shuffle of the texts
    order = next_ids(whole, key, "simhash-order")
    sizes = whole.groupBy(key).agg(F.max(F.length("text")).alias("longest"))
    wanted = order.join(sizes, key).select(F.col("next").alias(key), F.col(key).alias("reader"), F.floor(F.col("longest") / 3).cast("int").alias("wanted"))
    heads = whole.join(wanted.hint("merge"), key).groupBy(F.col("reader")).agg(F.max(key).alias("next"), F.min(F.col("text").substr(F.lit(1), F.col("wanted"))).alias("head"))
    heads = heads.select(F.col("reader").alias(key), "next", "head")
    n, gone = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    met = whole.join(heads.hint("merge"), key, "left").select(key, "next", "text", "head")
    met = met.unionByName(all_rows.where(F.col(key).isNull()).select(key, F.col(key).alias("next"), "text", F.lit(None).cast("string").alias("head")))
    both = met.select(key, "next", "text", n.cast("long").alias("n_chars"), F.concat(F.col("text").substr(F.lit(1), n - gone), F.coalesce(F.col("head").substr(F.lit(1), gone), F.lit(""))).alias("edited"))
    both = both.select(key, "next", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.monotonically_increasing_id().alias("row"), "text", "edited")
    both = both.select(key, "next", "n_chars", "edited_sha256", "row", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("content")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("content")))).alias("version"))
    keys = [key, "next", "n_chars", "edited_sha256", "row", "which"]
    each = fingerprints(both.select(*keys[:-1], "version.which", "version.content"), keys, "content")
    return each.groupBy(*keys[:-1]).agg(F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("edited_fingerprint")).drop("row")


def text(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def op7_simhash(spark: SparkSession, sf_dir: str, radius: int = 3) -> DataFrame:
    """Also ``n_within_radius``: for ids divisible by 100, how many other documents lie within the radius."""
    found = cut(edited_fingerprints(documents(spark, sf_dir)), "simhash")
    counts = found.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("documents"))
    asked = F.col("doc_id") % 100 == 0
    near = within_radius(found.where(asked), counts, radius).join(counts.withColumnRenamed("fingerprint", "found"), "found")
    near = near.groupBy(F.col("query").alias("fingerprint")).agg((F.sum("documents") - 1).alias("near"))
    told = join_skewed(found.where(asked), near, ["fingerprint"], "near").unionByName(found.where(~F.coalesce(asked, F.lit(False))).withColumn("near", F.lit(None).cast("long")))
    others = found.select(F.col("doc_id").alias("next"), F.col("fingerprint").alias("next_fingerprint")).groupBy("next").agg(F.min("next_fingerprint").alias("next_fingerprint"))
    rows = told.join(others, "next", "left")
    return rows.select("doc_id", "n_chars", "edited_sha256", text(F.col("fingerprint")).alias("fingerprint"), text(F.col("edited_fingerprint")).alias("edited_fingerprint"), likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), F.col("near").alias("n_within_radius"))
