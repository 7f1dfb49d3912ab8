"""Reachability over dependency edges, from the roots down or from the affected up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.functions.paths import parent, renamed, resolved
from assetloom.sources.shared import join_large, written

#: Extensions of scene layers.
LAYER_EXTENSIONS = ("usd", "usda", "usdc", "usdz")


def reachable(starts: DataFrame, edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(node, depth): all nodes reached from ``starts`` (node) along ``edges`` (src, dst), starts included.

    Semi-naive: each round joins only the newest nodes and keeps those that weren't seen, so cycles and
    diamonds end by themselves. Each round's nodes are written once; the answer reads them all.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    edges = written(edges, "edges")
    fresh = written(starts.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)), "reached")
    seen = fresh
    for depth in range(1, most_rounds + 1):
        found = fresh.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct()
        fresh = written(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "reached")
        if fresh.isEmpty():
            return seen
        seen = seen.unionByName(fresh)
        if depth % 20 == 0:
            seen = written(seen, "reached")
    raise RuntimeError(f"not closed after {most_rounds} rounds")


def layers(root: DataFrame, edges: DataFrame, present: DataFrame) -> DataFrame:
    """(node, depth): scene layers that a root needs: only files that are there and have a layer's extension."""
    ok = present.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*LAYER_EXTENSIONS)).select(F.col("path").alias("dst")).distinct()
    return reachable(root, join_large(edges, ok, "dst", "left_semi"))


def affected(patched: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth): layers that have to change: those that are patched and all that lead to one."""
    return reachable(patched, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def rewrites(edges: DataFrame, changed: DataFrame, suffix: str) -> DataFrame:
    """(layer, renames): for each changed layer a map from authored paths into changed layers to their new names."""
    nodes = changed.select("node").distinct()
    into = join_large(join_large(edges, nodes.withColumnRenamed("node", "dst"), "dst", "left_semi"), nodes.withColumnRenamed("node", "src"), "src", "left_semi")
    pairs = F.sort_array(F.collect_set(F.struct(F.col("authored").alias("key"), renamed(F.col("authored"), suffix).alias("value"))))
    return into.groupBy(F.col("src").alias("layer")).agg(F.map_from_entries(pairs).alias("renames"))


def layer_edges(items: DataFrame) -> DataFrame:
    """(src, kind, operation, authored, dst): each layer that a layer's lists of sublayers, references and payloads name, as written and as resolved from the layer's folder.

    ``items``: what ``sources.layers.layer_items`` gives. Deleted entries are no edges, nor are textures and other assets that attributes name.
    """
    arcs = items.where(F.col("kind").isin("sublayer", "reference", "payload") & (F.col("operation") != "delete"))
    found = arcs.select(F.col("layer").alias("src"), "kind", "operation", F.col("value").alias("authored")).distinct()
    return found.withColumn("dst", resolved(parent(F.col("src")), F.col("authored")))
