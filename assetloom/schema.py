"""Explicit schemas of the catalog's documents and tables, with a description of every asset field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

S, D, I, B, L = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.LongType()
STRINGS, NUMBERS = T.ArrayType(S), T.ArrayType(D)

#: (field, type, description) of an asset's annotation.
ASSET_FIELDS: list[tuple[str, T.DataType, str]] = [
    ("uid", S, "identifier of 32 hexadecimal digits"),
    ("description", S, "one-sentence description"),
    ("description_long", S, "paragraph description"),
    *[(f"description_view_{i}", S, f"what view {i} shows") for i in range(4)],
    ("category", S, "leaf category"),
    ("height", D, "metres"),
    ("max_dimension", D, "metres along the longest side"),
    ("length", D, "metres"),
    ("width", D, "metres"),
    ("materials", STRINGS, "materials, the dominant one first"),
    ("materials_composition", NUMBERS, "share of each material; they sum to one"),
    ("mass", D, "kilograms"),
    ("receptacle", B, "can it hold things?"),
    ("frontView", I, "number of the front view, 0 to 3"),
    ("quality", D, "rating from 0 to 10"),
    ("movable", B, "can it be moved?"),
    ("required_force", D, "newtons needed to move it"),
    ("walkable", B, "can one walk on it?"),
    ("enterable", B, "can one enter it?"),
    ("affordances", STRINGS, "what it can be used for"),
    ("support_surface", B, "can things stand on it?"),
    ("interactive_parts", STRINGS, "parts that move or switch"),
    ("traversability", S, "how it can be crossed"),
    ("traversable_by", STRINGS, "who can cross it"),
    ("colors", STRINGS, "colours, the dominant one first"),
    ("colors_composition", NUMBERS, "share of each colour; they sum to one"),
    ("surface_hardness", S, "hardness class"),
    ("surface_roughness", D, "0 to 1"),
    ("surface_finish", S, "finish class"),
    ("reflectivity", D, "0 to 1"),
    ("index_of_refraction", D, "relative to vacuum"),
    ("youngs_modulus", D, "megapascals"),
    ("friction_coefficient", D, "dry friction"),
    ("bounciness", D, "0 to 1"),
    ("recommended_clearance", D, "metres to leave free around it"),
    ("asset_composition_type", S, "single, group or scene"),
    ("near_synsets", T.MapType(S, D), "lexical senses nearby, with distances"),
    ("synset", S, "lexical sense"),
    ("wn_version", S, "version of the lexicon"),
    ("annotation_info", T.MapType(S, S), "who annotated it and how"),
    ("license_info", T.MapType(S, S), "licence and source"),
    ("filename", S, "name of the model file"),
]
#: Class-dependent attributes come under names with this prefix and are gathered in one map.
ATTRIBUTE_PREFIX = "attribute_"
ATTRIBUTES_DOC = "class-specific attribute; names depend on the class"

ASSET = T.StructType([T.StructField(n, t, True, {"comment": d}) for n, t, d in ASSET_FIELDS])

CATEGORY = T.StructType(
    [T.StructField(f"class_name_l{i}", S) for i in (1, 2, 3)] + [T.StructField(f"class_id_l{i}", L) for i in (1, 2, 3)] + [T.StructField("asset_uids", STRINGS), T.StructField("asset_count", L)]
)
MASTER = T.StructType(
    [
        T.StructField("about", T.StructType([T.StructField(n, S) for n in ("version", "date_created", "description", "license", "contributor", "url", "citation")])),
        T.StructField("statistics", T.StructType([T.StructField(n, L) for n in ("number_of_assets", "number_of_classes_l1", "number_of_classes_l2", "number_of_classes_l3")])),
        T.StructField("annotation", T.MapType(S, CATEGORY)),
    ]
)


def schema_doc(spark: SparkSession) -> DataFrame:
    """(field, type, description) of every documented field."""
    rows = [(n, t.simpleString(), d) for n, t, d in ASSET_FIELDS] + [(ATTRIBUTE_PREFIX + "*", "map<string,string>", ATTRIBUTES_DOC)]
    return spark.createDataFrame(rows, "field string, type string, description string")


def explain_field(spark: SparkSession, field: str | None = None) -> DataFrame:
    """All of ``schema_doc``, or the row of one field; any ``attribute_...`` is the pattern's row."""
    doc = schema_doc(spark)
    if field is None:
        return doc
    if field.startswith(ATTRIBUTE_PREFIX):
        field = ATTRIBUTE_PREFIX + "*"
    elif field not in ASSET.fieldNames():
        raise ValueError(f"unknown field {field!r}")
    return doc.where(doc["field"] == field)
