"""Shows in one call: names are checked, files looked up, and each item comes as a JSON row with its place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.operators import documents, files, textures
from assetloom.operators.hierarchy import check_names
from assetloom.sources.shared import join_large

#: Kinds of files that each mode of a show of assets looks up.
NEEDS = {"show": ("glb", "thumbnail"), "assets": ("glb",), "thumbnails": ("thumbnail",), "annotations": (), "renders": ()}


def assets(uids: DataFrame, index: DataFrame, present: DataFrame, base: str, mode: str = "show", annotations: DataFrame | None = None, folders: DataFrame | None = None, angles: Sequence[int] = files.ANGLES) -> DataFrame:
    """(pos, item) of a request's assets, each once; only files that are there get a URL.

    ``annotations``: (uid, annotation) for the modes that show them; ``folders``: (uid, folder) of renders.
    """
    if mode not in documents.MODES:
        raise ValueError(f"mode must be one of {documents.MODES}")
    shown = files.requested(uids)
    if NEEDS[mode]:
        shown = files.load(uids, index, present, NEEDS[mode])
    if mode in ("show", "annotations"):
        shown = join_large(shown, annotations.select("uid", "annotation"), "uid", "left")
    if mode in ("show", "renders"):
        shown = join_large(shown, files.renders(uids, folders, present, angles), "uid", "left")
    return documents.asset_items(shown, mode, base)


def materials(kind: str, listed: DataFrame, present: DataFrame, base: str, texts: DataFrame | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """(pos, item) of a kind's materials, all or those wanted (unknown names raise).

    ``listed``: (path) of all files, ``texts``: (name, value) of material files; kinds with textures show which channels they feed.
    """
    mapping = files.material_map(listed, kind)
    if wanted is not None:
        check_names(wanted, mapping)
    loaded = files.load_materials(mapping, present, kind, wanted)
    folder, _, extension, inside = files.MATERIALS[kind]
    if inside:
        readable = loaded.where(F.col("main").endswith("." + extension)).select("name")
        fed = textures.channel_urls(join_large(texts, readable, "name", "left_semi"), present, folder, base)
        loaded = join_large(loaded, fed, "name", "left").withColumn("textures", F.coalesce("textures", F.create_map().cast("map<string,string>")))
    return documents.material_items(loaded, base)


def vegetation(kind: str, listed: DataFrame, present: DataFrame, base: str, wanted: DataFrame | None = None, preview: str = "_preview.glb") -> DataFrame:
    """(pos, item) of a kind's plants, all or those wanted (unknown names raise), with their scene and preview where these are there."""
    mapping = files.vegetation_map(listed, kind)
    if wanted is not None:
        check_names(wanted, mapping)
    loaded = files.load_vegetation(mapping, present, kind, wanted)
    path = F.concat("folder", F.lit("/" + preview))
    there = present.select(F.col("path").alias("preview")).distinct()
    shown = files.looked_up(loaded.withColumn("preview_", path), there, "preview_", "preview", "name")
    return documents.vegetation_items(shown.select("name", "usd", "preview"), base)
