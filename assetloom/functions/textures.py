"""What a texture is for, by its file name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words in texture names and the channels that they stand for.
CHANNEL_WORDS = {
    "diff": "diffuse",
    "norm": "normal",
    "rough": "roughness",
    "height": "height",
    "ao": "ao",
    "metal": "metallic",
    "mask": "mask",
    "multi": "multi",
    "dis": "height",
    "ref": "metallic",
    "rou": "roughness",
    "curv": "ao",
    "orm": "orm",
    "grunge": "mask",
}


def texture_kind(ref: Column, words: dict[str, str] = CHANNEL_WORDS) -> Column:
    """By the last word of the file's name (words lie between underscores) that stands for something; else ``orm`` if that is in the name, else ``unknown``."""
    name = F.lower(F.regexp_replace(F.substring_index(ref, "/", -1), r"(?<=.)\.[^.]*$", ""))
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    known = F.filter(F.reverse(F.split(name, "_")), lambda w: F.map_contains_key(table, w))
    return F.coalesce(F.try_element_at(table, F.get(known, 0)), F.when(F.contains(name, F.lit("orm")), F.lit("orm")), F.lit("unknown"))


def channels(kind: Column, ref: Column) -> Column:
    """Channels that a texture of the kind feeds: packed kinds feed several, masks and unknown ones none."""
    name = F.lower(F.substring_index(ref, "/", -1))
    packed = F.array_compact(F.array(*[F.when(F.contains(name, F.lit(word)), F.lit(channel)) for word, channel in (("rough", "roughness"), ("ao", "ao"), ("height", "height"))]))
    none = F.array().cast("array<string>")
    return F.when(kind == "orm", F.array(F.lit("roughness"), F.lit("ao"))).when(kind == "multi", packed).when(kind.isin("unknown", "mask"), none).otherwise(F.array(kind))


def preview_channel(parameter: Column, ref: Column) -> Column:
    """``diffuse``, ``normal`` or null by what the parameter's or the file's name contains; diffuse is asked first."""
    parameter, name = F.lower(parameter), F.lower(F.substring_index(ref, "/", -1))
    has = lambda c, *words: F.greatest(*[F.contains(c, F.lit(w)) for w in words]) if len(words) > 1 else F.contains(c, F.lit(words[0]))
    diffuse = has(parameter, "diffuse", "albedo") | has(name, "diffuse", "albedo", "basecolor")
    return F.when(diffuse, F.lit("diffuse")).when(has(parameter, "normal") | has(name, "normal"), F.lit("normal"))
