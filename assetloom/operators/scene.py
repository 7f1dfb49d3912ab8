"""Scene attributes: scalar texture scales become pairs; meshes become triangles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.functions.paths import renamed
from assetloom.functions.predicates import near, typed_as
from assetloom.operators import graph
from assetloom.sources.layers import attributes, layer_items
from assetloom.sources.shared import join_large, written

#: Attribute types that are turned into pairs, and the pair's type.
SCALARS = ("int", "float", "double", "half")
PAIR = "float2"
#: Fixed value: the attribute that an upgrade is about.
SCALE_ATTRIBUTE = "inputs:texture_scale"


def patch(attributes: DataFrame, scale: float = 1.0, override: float | None = None) -> DataFrame:
    """Adds ``new_type``, ``new_x``, ``new_y`` and ``changed`` to rows (layer, prim, type, x, y).

    Scalars always change; a pair changes unless it is at its target already. A pair that was authored
    as a scalar (y missing) counts as (x, x). Missing defaults and other types stay.
    """
    x = F.col("x").cast("double")
    y = F.coalesce(F.col("y").cast("double"), x)
    target: Column = F.lit(override).cast("double") if override is not None else None
    new_x = target if target is not None else x * scale
    new_y = target if target is not None else y * scale
    pair = typed_as(F.col("type"), x, [PAIR])
    scalar = typed_as(F.col("type"), x, SCALARS)
    moved = pair & ~(near(new_x, x) & near(new_y, y))
    changed = F.coalesce(scalar | moved, F.lit(False))
    return attributes.select("*", F.when(scalar, F.lit(PAIR)).otherwise(F.col("type")).alias("new_type"), F.when(changed, new_x).otherwise(x).alias("new_x"), F.when(changed, F.when(scalar, new_x).otherwise(new_y)).when(pair, y).otherwise(F.col("y").cast("double")).alias("new_y"), changed.alias("changed"))


def patchable(attributes: DataFrame) -> DataFrame:
    """(node): layers that hold an attribute to patch."""
    return attributes.where(typed_as(F.col("type"), F.col("x"), [*SCALARS, PAIR])).select(F.col("layer").alias("node")).distinct()


def fixes(patched: DataFrame) -> DataFrame:
    """(layer, fixes), and the total (null layer)."""
    return patched.rollup("layer").agg(F.count_if("changed").alias("fixes"))


def _number(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def _edited(rows: DataFrame) -> DataFrame:
    """Rows (layer, value, edits: sorted, apart) with the edits made in the value; places count characters."""

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for text, edits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                pieces, at = [], 0
                for edit in edits or ():
                    pieces += [text[at : edit["start"]], edit["text"]]
                    at = edit["end"]
                out.append("".join([*pieces, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["layer", "value"])

    return rows.select("layer", "value", "edits").mapInArrow(work, "layer string, value string")


def upgrade(texts: DataFrame, root: DataFrame | None = None, suffix: str | None = None, scale: float = 1.0, override: float | None = None, attribute: str = SCALE_ATTRIBUTE, dry_run: bool = False) -> DataFrame:
    """(layer, target, fixed, rewrote, value): the layers that change when an attribute becomes a pair, and their new texts.

    ``texts``: (layer, value), ``root``: (node), the layers to start from (all layers without it). With a suffix, layers
    that hold the attribute and all that lead to one get copies under names with the suffix, which name each other; all else
    stays as it is, byte for byte. Without a suffix, layers that have something to fix are changed in place. A dry run has
    the same rows without ``value`` and reads no text a second time.
    """
    texts = texts.select("layer", "value")
    items = written(layer_items(texts), "layer-items")
    edges = graph.layer_edges(items)
    held = attributes(items, attribute)
    if root is not None:
        targets = graph.layers(root, edges, texts.select(F.col("layer").alias("path"))).select(F.col("node").alias("layer"))
        held = join_large(held, targets, "layer", "left_semi")
        edges = join_large(edges, targets.withColumnRenamed("layer", "src"), "src", "left_semi")
    patched = patch(held, scale, override)
    fixed = patched.where("changed")
    pair = F.concat(F.lit("("), _number(F.col("new_x")), F.lit(", "), _number(F.col("new_y")), F.lit(")"))
    place = lambda start, end, text: F.struct(F.col(start).alias("start"), F.col(end).alias("end"), text.alias("text"))
    edits = fixed.select("layer", F.explode(F.array(place("type_start", "type_end", F.col("new_type")), place("start", "end", pair))).alias("edit"), F.lit(None).cast("string").alias("authored"))
    members = fixed.select("layer").distinct()
    if suffix is not None:
        changed = graph.affected(patchable(held), edges).select(F.col("node").alias("layer"))
        members = changed
        into = join_large(edges.select("src", "authored", "dst"), changed.withColumnRenamed("layer", "dst"), "dst", "left_semi")
        into = join_large(into, changed.withColumnRenamed("layer", "src"), "src", "left_semi")
        arcs = items.where(F.col("kind").isin("sublayer", "reference", "payload") & (F.col("operation") != "delete")).select("layer", F.col("value").alias("authored"), "start", "end")
        arcs = join_large(arcs, into.select(F.col("src").alias("layer"), "authored"), ["layer", "authored"], "left_semi")
        edits = edits.unionByName(arcs.select("layer", place("start", "end", renamed(F.col("authored"), suffix)).alias("edit"), "authored"))
    counted = edits.groupBy("layer").agg(F.sort_array(F.collect_list("edit")).alias("edits"), (F.count_if(F.col("authored").isNull()) / 2).cast("long").alias("fixed"), F.count_distinct("authored").alias("rewrote"))
    target = renamed(F.col("layer"), suffix) if suffix is not None else F.col("layer")
    none = F.lit(0).cast("long")
    found = join_large(members, counted, "layer", "left").select("layer", target.alias("target"), F.coalesce("fixed", none).alias("fixed"), F.coalesce("rewrote", none).alias("rewrote"), "edits")
    if dry_run:
        return found.drop("edits")
    found = written(found, "layer-edits")
    return join_large(found.drop("edits"), _edited(join_large(texts, found.select("layer", "edits"), "layer")), "layer")


def triangles(meshes: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(mesh, face, a, b, c): fans of each face of meshes (mesh, indices, counts); faces of less than three corners are passed over.

    All faces of an Arrow batch at once, ``most`` triangles to a batch that goes out (a mesh of more by itself). Null lists count as empty,
    null or negative counts as none; a corner beyond the mesh's indices is null.
    """

    def fans(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            indices, counts = batch.column(1), batch.column(2)
            sizes = [np.asarray(x.value_lengths().fill_null(0), np.int64) for x in (indices, counts)]
            n = np.maximum(np.asarray(counts.flatten().fill_null(0), np.int64), 0)
            corners = indices.flatten()
            row = np.repeat(np.arange(batch.num_rows), sizes[1])  # of each face
            faces_before = np.cumsum(sizes[1]) - sizes[1]
            corners_before = np.cumsum(sizes[0]) - sizes[0]
            place = np.cumsum(n) - n
            heads = np.concatenate([place, [0]])[np.minimum(faces_before, len(place))]
            place = place - heads[row]  # of each face's first corner in its mesh
            fan = np.maximum(n - 2, 0)
            until = np.concatenate([[0], np.cumsum(fan)])[np.append(faces_before, len(fan))]  # triangles before each mesh
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(until, until[first] + most, "right")) - 1)
                a, b = (faces_before[first], faces_before[last] if last < batch.num_rows else len(fan))
                face = np.repeat(np.arange(a, b), fan[a:b])
                ends = np.cumsum(fan[a:b])
                k = 1 + np.arange(len(face)) - np.repeat(ends - fan[a:b], fan[a:b])
                mesh = row[face]
                at = [place[face], place[face] + k, place[face] + k + 1]
                found = [corners.take(pa.array(x + corners_before[mesh], mask=x >= sizes[0][mesh])) for x in at]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(mesh)), pa.array(face - faces_before[mesh], pa.int32()), *found], ["mesh", "face", "a", "b", "c"])
                first = last

    mesh, index = meshes.schema["mesh"].dataType, meshes.schema["indices"].dataType.elementType
    name = index.simpleString()
    return meshes.select("mesh", "indices", "counts").mapInArrow(fans, f"mesh {mesh.simpleString()}, face int, a {name}, b {name}, c {name}")
