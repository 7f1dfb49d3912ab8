"""Merkle manifest of a dataset: a tree for each group of rows, and a tree over the groups' roots.

A leaf is the hash of a row's fields. Within its group a row's place comes from ``row_number`` in effect:
rows are dealt by range of (group, key), so each task numbers its stretch, and a stretch starts where those
before it end; a group that holds a third of all rows is many stretches. Level by level the index is
floor-divided by the fanout and the run of children, sorted, is hashed into its parent, until one node of
each group is left: its subroot. The subroots, in the groups' order, are the leaves of the upper tree.
Then levels are joined downwards: each run meets its parent's path and appends its own siblings, so what
is above is joined once for a run and not once for a row.

``H`` is the lowercase hexadecimal SHA-256 of its inputs put together, digests as hexadecimal text. A field is ``-`` if
it is null, else its bytes in UTF-8, a colon and the value.

Defined results: rows with null keys come first in their group, rows with one key go by their leaves, repeated rows are
leaves each; a null group is a group of its own before all others, an empty text is a value (``0:``); a lone leaf is
its own subroot with an empty path; an empty table has no rows; texts of any length are hashed whole; other columns are
never read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return digest(*map(field, fields))


def folded(start: Column, path: Column) -> Column:
    """The root to which a leaf leads by the siblings of its path."""
    return F.aggregate(path, start, lambda low, step: digest(step["left"], low, step["right"]))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def indexed(rows: DataFrame, tree: str, order: Sequence[str], label: str) -> DataFrame:
    """Adds ``idx``, the row's place in its tree from 0, and ``m``, the number of the tree's rows."""
    dealt = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    placed = cut(dealt.withColumns({"part_": F.spark_partition_id(), "place_": F.monotonically_increasing_id()}), label)
    stretches = placed.groupBy(tree, "part_").agg(F.min("place_").alias("first_"), F.count(F.lit(1)).alias("n_"))
    whole = Window.partitionBy(tree)
    before = F.sum("n_").over(whole.orderBy("part_")) - F.col("n_")
    stretches = stretches.select(tree, "part_", (before - F.col("first_")).alias("shift_"), F.sum("n_").over(whole).alias("m"))
    return placed.join(stretches, [tree, "part_"]).withColumn("idx", F.col("place_") + F.col("shift_")).drop("part_", "place_", "shift_")


def climb(nodes: DataFrame, fanout: int, label: str, carried: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """(runs of each level, tops) of nodes (tree, idx, m, digest); ``carried`` columns stay with the lowest level's children.

    ``runs``: (tree, idx, m, children) with the run's own place ``idx``, the tree's nodes on the level ``m`` and the
    children's digests in order. ``tops``: (tree, digest), one row for each tree.
    """
    most = nodes.agg(F.max("m")).first()[0] or 0
    levels, tops = [], None
    while True:
        top = nodes.where("m = 1").select("tree", F.col("digest"))
        tops = top if tops is None else tops.unionByName(top)
        if most <= 1:
            return levels, tops
        child = F.struct(F.pmod("idx", F.lit(fanout)).alias("pos"), "digest", *carried)
        runs = nodes.where("m > 1").groupBy("tree", F.floor(F.col("idx") / fanout).alias("idx"), "m").agg(F.sort_array(F.collect_list(child)).alias("children"))
        levels.append(cut(runs, f"{label}-runs"))
        together = F.array_join(F.transform("children", lambda c: c["digest"]), "")
        nodes = levels[-1].select("tree", "idx", F.ceil(F.col("m") / fanout).alias("m"), digest(together).alias("digest"))
        most, carried = -(-most // fanout), ()


def steps(runs: DataFrame) -> DataFrame:
    """Each child of a run with its siblings to the left and right: (tree, idx, child, step) and what else a run has."""
    join = lambda part: F.array_join(F.transform(part, lambda c: c["digest"]), "")
    size = F.size("children")
    step = lambda i: F.struct(join(F.slice("children", F.lit(1), i)).alias("left"), join(F.slice("children", i + 2, F.greatest(size - i - 1, F.lit(0)))).alias("right"))
    each = F.transform("children", lambda c, i: F.struct(c.alias("child"), step(i).alias("step")))
    return runs.withColumn("each_", F.explode(each)).select(*[c for c in runs.columns if c != "children"], "each_.child", "each_.step")


def descend(levels: list[DataFrame], tops: DataFrame, fanout: int, label: str) -> DataFrame:
    """(tree, child, path, and what else ``tops`` has) of the lowest level's children; ``tops``: (tree, path, ...).

    ``child`` has the columns that were carried. Trees of one node are not among them.
    """
    extra = [c for c in tops.columns if c not in ("tree", "path")]
    above = None  # (tree, idx, path, extra) of the nodes one level up
    for k in range(len(levels) - 1, -1, -1):
        runs = levels[k]
        last = runs.where(F.col("m") <= fanout).join(tops, "tree")
        if above is not None:
            last = last.unionByName(runs.where(F.col("m") > fanout).join(above, ["tree", "idx"]))
        if k:
            below = steps(last).select("tree", (F.col("idx") * fanout + F.col("child.pos")).alias("idx"), F.concat(F.array("step"), "path").alias("path"), *extra)
            above = cut(below, f"{label}-paths")
        else:
            return steps(last).select("tree", "child", F.concat(F.array("step"), "path").alias("path"), *extra)
    raise ValueError("no levels")


def manifest(rows: DataFrame, tree: str, key: str, carried: Sequence[str] = (), fanout: int = FANOUT) -> DataFrame:
    """(key, carried, leaf, subroot, root, path) of rows with a column ``leaf``; ``tree`` names the group, ``path`` the (left, right) siblings from the leaf to the root.

    Tables are cut into the shared folder between levels, so a lost executor costs a level at most.
    """
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    # a null group sorts before all others, also before the empty name
    named = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("-"))
    kept = [c for c in dict.fromkeys([key, *carried])]
    leaves = indexed(rows.select(named.alias("tree"), F.col("leaf").alias("digest"), F.struct(*kept).alias("row")), "tree", [f"row.{key}", "digest"], "merkle-leaves")
    leaves = cut(leaves, "merkle-numbered")
    levels, subroots = climb(leaves, fanout, "merkle", ["row"])
    subroots = cut(subroots, "merkle-subroots")
    upper = indexed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"), "tree", ["group"], "merkle-groups")
    upper = cut(upper, "merkle-upper")
    above, root = climb(upper, fanout, "merkle-upper", ["group"])
    none = F.array().cast(PATH)
    ends = root.select("tree", F.col("digest").alias("root"), none.alias("path"))
    parts = upper.where("m = 1").join(ends, "tree").select(F.col("group").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    if above:
        parts = descend(above, ends, fanout, "merkle-upper").select(F.col("child.group").alias("tree"), "path", F.col("child.digest").alias("subroot"), "root")
    parts = cut(parts, "merkle-parts")
    lone = leaves.where("m = 1").join(parts, "tree").select("row.*", F.col("digest").alias("leaf"), "subroot", "root", "path")
    if not levels:
        return lone
    return descend(levels, parts, fanout, "merkle").select("child.row.*", F.col("child.digest").alias("leaf"), "subroot", "root", "path").unionByName(lone)


def tampers(key: Column) -> Column:
    """Is the row one of those whose text is changed to show that the manifest notices?"""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    whole = leaf(*[F.col(c) for c in FIELDS])
    lowered = leaf(*[F.col(c) for c in FIELDS[:-1]], F.translate(F.col("text").cast("string"), UPPER, LOWER))
    rows = docs.select("doc_id", "source", whole.alias("leaf"), F.when(tampers(F.col("doc_id")), lowered).alias("tampered"))
    found = manifest(rows, "source", "doc_id", ["tampered"])
    found = found.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: SHA-256 trees by recursion; CRC-32 by its polynomial (fixed value), bit by bit.
OP13_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, * FROM documents),
b AS (SELECT r, list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda i: ascii(CAST(doc_id AS VARCHAR)[i + 1])::BIGINT) AS bytes FROM d),
x AS (SELECT r, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, y: list_reduce(list_prepend(xor(c, y), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) AS crc FROM b),
h AS (SELECT r, doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM d),
l AS (SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS lowered FROM h),
n AS (SELECT r, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS m, leaf, CASE WHEN crc % 5 = 0 THEN lowered ELSE leaf END AS used FROM l JOIN x USING (r)),
t AS (SELECT 0 AS k, g, i, m, leaf AS h FROM n UNION ALL SELECT any_value(k) + 1, g, i // 16, (m + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE m > 1 GROUP BY g, i // 16, m),
s AS (SELECT g, h AS subroot FROM t WHERE m = 1),
u AS (SELECT 0 AS k, g AS i, count(*) OVER () AS m, subroot AS h FROM s UNION ALL SELECT any_value(k) + 1, i // 16, (m + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE m > 1 GROUP BY i // 16, m),
runs AS (SELECT k, g, i // 16 AS run, list(h ORDER BY i) AS hs FROM t WHERE m > 1 GROUP BY ALL UNION ALL SELECT 1000 + k, 0, i // 16, list(h ORDER BY i) FROM u WHERE m > 1 GROUP BY ALL),
p AS (SELECT r, 0 AS k, g, i, m, g AS own, used AS cur, '' AS proof FROM n
UNION ALL SELECT p.r, p.k + 1, p.g, p.i // 16, (p.m + 15) // 16, p.own, sha256(list_aggregate(list_concat(q.hs[:p.i % 16], [p.cur], q.hs[p.i % 16 + 2:]), 'string_agg', '')), p.proof || coalesce(list_aggregate(list_concat(q.hs[:p.i % 16], q.hs[p.i % 16 + 2:]), 'string_agg', ''), '')
FROM (SELECT r, CASE WHEN m = 1 AND k < 1000 THEN 1000 ELSE k END AS k, CASE WHEN m = 1 AND k < 1000 THEN 0 ELSE g END AS g, CASE WHEN m = 1 AND k < 1000 THEN own ELSE i END AS i, CASE WHEN m = 1 AND k < 1000 THEN (SELECT count(*) FROM s) ELSE m END AS m, own, cur, proof FROM p) p
JOIN runs q ON q.k = p.k AND q.g = p.g AND q.run = p.i // 16 WHERE p.m > 1),
e AS (SELECT r, arg_max(cur, k) AS folded, arg_max(proof, k) AS proof FROM p GROUP BY r)
SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE m = 1) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT h FROM u WHERE m = 1) AS verified FROM n JOIN s USING (g) JOIN e USING (r)
"""
