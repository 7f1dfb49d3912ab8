"""Texture references in material texts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.functions.paths import parent, resolved, url, without_leading_dots
from assetloom.functions.textures import channels, preview_channel, texture_kind
from assetloom.sources.shared import join_large

#: How a material text refers to a texture.
REFERENCE = r'texture_2d\(\s*"([^"]+)"'
NAMED_REFERENCE = r'(\w+)\s*:\s*texture_2d\(\s*"([^"]+)"'


def references(texts: DataFrame, key: str = "name", value: str = "value", pattern: str = REFERENCE) -> DataFrame:
    """(key, pos, ref): each reference of a text once, at its first place."""
    found = texts.select(key, F.posexplode(F.regexp_extract_all(F.col(value), F.lit(pattern), F.lit(1))).alias("pos", "ref"))
    return found.groupBy(key, "ref").agg(F.min("pos").cast("long").alias("pos")).select(key, "pos", "ref")


def channel_urls(texts: DataFrame, present: DataFrame, folder: str, base: str, key: str = "name") -> DataFrame:
    """(key, textures): a map from channels to the URLs of the first textures that feed them and are there, for each text."""
    return fed_channels(references(texts, key), texts.select(key), present, folder, base, key)


def fed_channels(refs: DataFrame, keys: DataFrame, present: DataFrame, folder: str, base: str, key: str = "name") -> DataFrame:
    """``channel_urls`` of references (key, pos, ref) that were found before."""
    refs = refs.withColumn("path", F.concat(F.lit(folder + "/"), without_leading_dots(F.col("ref"))))
    refs = join_large(refs, present.select("path"), "path", "left_semi")
    fed = refs.select(key, "pos", "path", F.explode(channels(texture_kind(F.col("ref")), F.col("ref"))).alias("channel"))
    first = fed.groupBy(key, "channel").agg(F.min_by("path", "pos").alias("path"))
    maps = first.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", url(base, F.col("path")).alias("url"))))).alias("textures"))
    return join_large(keys.select(key).distinct(), maps, key, "left").select(key, F.coalesce("textures", F.create_map().cast("map<string,string>")).alias("textures"))


def preview_textures(texts: DataFrame, present: DataFrame, folder: str, key: str = "name") -> DataFrame:
    """(key, diffuse, normal): the first reference for each that is there, by the parameter's or file's name."""
    names, refs = (F.regexp_extract_all("value", F.lit(NAMED_REFERENCE), F.lit(i)) for i in (1, 2))
    rows = texts.select(key, F.posexplode(F.arrays_zip(names.alias("parameter"), refs.alias("ref"))).alias("pos", "one"))
    rows = rows.select(key, "pos", F.col("one.parameter").alias("parameter"), F.col("one.ref").alias("ref"), F.concat(F.lit(folder + "/"), without_leading_dots(F.col("one.ref"))).alias("path"))
    rows = join_large(rows, present.select("path"), "path", "left_semi").withColumn("channel", preview_channel(F.col("parameter"), F.col("ref")))
    found = rows.groupBy(key).agg(*[F.min_by("path", F.when(F.col("channel") == c, F.col("pos"))).alias(c) for c in ("diffuse", "normal")])
    return join_large(texts.select(key).distinct(), found, key, "left")


def bound_textures(items: DataFrame, texts: DataFrame, present: DataFrame) -> DataFrame:
    """(layer, material, diffuse, normal) of each material with shaders in layers: what the shaders' inputs name comes first.

    ``items``: what ``sources.layers.layer_items`` gives, ``texts``: (path, value) of material files. Only files that are
    there count. A material without a diffuse input takes what is missing from the material file that its shader names.
    """
    assets = items.where((F.col("kind") == "attribute") & (F.col("type") == "asset") & F.col("value").isNotNull())
    written_path = F.regexp_replace("value", "^@+|@+$", "")
    assets = assets.select("layer", F.regexp_extract("prim", r"^(.*)/[^/]*$", 1).alias("material"), "name", "start", resolved(parent(F.col("layer")), written_path).alias("path"))
    there = present.select("path")
    assets = join_large(assets, there, "path", "left_semi")
    name = F.lower(F.substring_index("name", ":", -1))
    has = lambda *words: reduce(or_, [F.contains(name, F.lit(w)) for w in words])
    channel = F.when(has("diffuse", "albedo", "basecolor"), F.lit("diffuse")).when(has("normal"), F.lit("normal"))
    first = lambda when, what, order: F.min_by(what, F.when(when, order))
    inputs = F.col("name").startswith("inputs:")
    source = F.col("name") == "info:mdl:sourceAsset"
    found = assets.withColumn("channel", F.when(inputs, channel)).groupBy("layer", "material").agg(
        first(F.col("channel") == "diffuse", "path", F.col("start")).alias("diffuse"), first(F.col("channel") == "normal", "path", F.col("start")).alias("normal"), first(source, "path", F.col("start")).alias("source")
    )
    names, refs = (F.regexp_extract_all("value", F.lit(NAMED_REFERENCE), F.lit(i)) for i in (1, 2))
    rows = texts.select(F.col("path").alias("source"), F.posexplode(F.arrays_zip(names.alias("parameter"), refs.alias("ref"))).alias("pos", "one"))
    rows = rows.select("source", "pos", preview_channel(F.col("one.parameter"), F.col("one.ref")).alias("channel"), resolved(parent(F.col("source")), F.col("one.ref")).alias("path"))
    rows = join_large(rows, there, "path", "left_semi")
    named = rows.groupBy("source").agg(*[F.min_by("path", F.when(F.col("channel") == c, F.col("pos"))).alias(f"mdl_{c}") for c in ("diffuse", "normal")])
    shaders = items.where((F.col("kind") == "attribute") & (F.col("name").startswith("inputs:") | (F.col("name") == "info:mdl:sourceAsset"))).select("layer", F.regexp_extract("prim", r"^(.*)/[^/]*$", 1).alias("material")).distinct()
    both = join_large(shaders, found, ["layer", "material"], "left")
    # materials whose source isn't there are dealt by their layer, not to one task
    both = both.withColumn("lookup_", F.coalesce("source", F.concat(F.lit("\n"), "layer"))).drop("source")
    both = join_large(both, named, F.col("lookup_") == F.col("source"), "left")
    normal = F.coalesce("normal", F.when(F.col("diffuse").isNull(), F.col("mdl_normal")))
    return both.select("layer", "material", F.coalesce("diffuse", "mdl_diffuse").alias("diffuse"), normal.alias("normal"))
