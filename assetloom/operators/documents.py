"""What viewers show: items as JSON rows with their places; nested documents as leaves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.functions.paths import url
from assetloom.sources.catalog import numbered
from assetloom.sources.shared import written

MODES = ("show", "annotations", "assets", "thumbnails", "renders")
#: Levels of a nested document that one plan opens.
LEVELS = 8


def _items(rows: DataFrame, fields: Sequence[Column], order: str) -> DataFrame:
    """(pos, item): a JSON text for each row, numbered in order; no task holds them all."""
    named = rows.select(F.col(order).alias("order_"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("item"))
    return numbered(named, "order_").select("pos", "item")


def gathered(items: DataFrame, title: str, mode: str = "show") -> DataFrame:
    """(document): the items (pos, item) of one page as one JSON text, for the sink that writes the page; give it what a page can show."""
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]), ",")
    head = F.regexp_replace(F.to_json(F.struct(F.lit(title).alias("title"), F.lit(mode).alias("mode"))), r"\}$", "")
    return items.agg(listed.alias("listed")).select(F.concat(head, F.lit(',"items":['), "listed", F.lit("]}")).alias("document"))


def _there(base: str, path: str, name: str) -> Column:
    return F.when(F.col(path).isNotNull(), url(base, F.col(path))).alias(name)


def asset_items(loaded: DataFrame, mode: str, base: str) -> DataFrame:
    """Of loaded assets (uid, glb, annotation, thumbnail, renders, as the mode needs); what isn't there is null."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    fields = [F.col("uid")]
    if mode in ("show", "annotations"):
        fields.append(F.col("annotation"))
    if mode in ("show", "assets"):
        fields.append(_there(base, "glb", "glb_url"))
    if mode in ("show", "thumbnails"):
        fields.append(_there(base, "thumbnail", "thumbnail_url"))
    if mode in ("show", "renders"):
        fields.append(F.transform_values("renders", lambda _, p: F.when(p.isNotNull(), url(base, p))).alias("render_urls"))
    return _items(loaded, fields, "uid")


def material_items(materials: DataFrame, base: str) -> DataFrame:
    """Of materials (name, main, thumbnail, and textures where there are some)."""
    fields = [F.col("name"), _there(base, "main", "url"), _there(base, "thumbnail", "thumbnail_url")]
    if "textures" in materials.columns:
        fields.append(F.col("textures"))
    return _items(materials, fields, "name")


def vegetation_items(plants: DataFrame, base: str) -> DataFrame:
    """Of plants (name, usd, preview)."""
    return _items(plants, [F.col("name"), F.col("usd"), _there(base, "preview", "preview_url")], "name")


def image_strip(renders: DataFrame) -> DataFrame:
    """(uid, angle, path) of the renders that are there."""
    return renders.select("uid", F.explode("renders").alias("angle", "path")).where("path is not null")


def has_thumbnails(rows: DataFrame, *groups: str) -> DataFrame:
    """Has any row of the group a thumbnail?"""
    return rows.groupBy(*groups).agg(F.coalesce(F.bool_or(F.col("thumbnail").isNotNull()), F.lit(False)).alias("has_thumbnails"))


def annotation_rows(rows: DataFrame, key: str = "uid", document: str = "annotation") -> DataFrame:
    """(key, path, value): the leaves of JSON documents; objects are opened by their keys, arrays by their places, strings never.

    One plan opens ``LEVELS`` levels without a shuffle; what then has values inside still is written and opened further, until nothing has.
    Null values are leaves, empty objects and arrays have none, and texts that aren't JSON give no rows.
    """
    spark = rows.sparkSession
    opened = rows.select(key, F.lit("").alias("path"), F.try_parse_json(document).alias("inside"), F.lit(None).cast("string").alias("value")).where("inside is not null")
    done = None
    while True:
        for _ in range(LEVELS):
            children = spark.tvf.variant_explode_outer(F.col("inside").outer()).toDF("pos_", "key_", "child_")
            step = opened.lateralJoin(children)
            entered = F.col("pos_").isNotNull()
            ends = ~entered & F.col("inside").isNotNull()
            name = F.concat_ws(".", F.nullif("path", F.lit("")), F.coalesce("key_", F.col("pos_").cast("string")))
            empty = ends & F.to_json("inside").isin("{}", "[]")
            step = step.where(~F.coalesce(empty, F.lit(False)))
            opened = step.select(key, F.when(entered, name).otherwise(F.col("path")).alias("path"), F.when(entered, F.col("child_")).alias("inside"), F.when(ends, F.variant_get("inside", "$", "string")).otherwise(F.col("value")).alias("value"))
        opened = written(opened, "leaves")
        leaves = opened.where("inside is null").select(key, "path", "value")
        done = leaves if done is None else done.unionByName(leaves)
        opened = opened.where("inside is not null")
        if opened.isEmpty():
            return done
