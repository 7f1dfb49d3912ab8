"""Files of assets, materials and vegetation: which there are, which are wanted, where they lie."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.functions.paths import below, render_name, renamed, stem, without_archive_suffix
from assetloom.functions.predicates import direct_child
from assetloom.operators.hierarchy import check_arguments
from assetloom.sources.catalog import ASSET_TYPES, numbered
from assetloom.sources.shared import join_large

ANGLES = (0, 90, 180, 270)
#: Folders of the namespaces.
MATERIALS = {
    "sky": ("material_background_hdr", "material_background_hdr_thumbnail", "hdr", None),
    "road": ("material_road_mdl", "material_road_thumbnail", "mdl", "textures"),
    "sidewalk": ("material_sidewalk_mdl", "material_sidewalk_thumbnail", "mdl", "textures"),
    "terrain": ("material_terrain_mdl", "material_terrain_thumbnail", "mdl", "textures"),
}
#: How a converter may approximate a mesh for collisions, and where its files go.
COLLISIONS = ("convexDecomposition", "convexHull", "boundingCube", "boundingSphere", "meshSimplification", "none")
USD_FOLDER = "assets_std_usd_flat"
VEGETATION = {"plant": "collected_plants", "shrub": "collected_shrubs", "tree": "collected_trees"}


def requested(uids: DataFrame) -> DataFrame:
    """A request's ids, each once."""
    return uids.select("uid").distinct()


def resolve(uids: DataFrame, files: DataFrame, asset_type: str) -> DataFrame:
    """(uid, path) of the ids that have a file of the type; others are dropped."""
    check_arguments([asset_type], ASSET_TYPES, "asset type")
    return join_large(requested(uids), files.where(F.col("asset_type") == asset_type).select("uid", "path"), "uid")


def annotations(uids: DataFrame, assets: DataFrame, keep_missing: bool = True) -> DataFrame:
    """Asset rows of a request; ids without one are kept with nulls or dropped."""
    return join_large(requested(uids), assets, "uid", "left" if keep_missing else "inner")


def load(uids: DataFrame, files: DataFrame, present: DataFrame, what: Sequence[str] = ASSET_TYPES, flat: str = "assets") -> DataFrame:
    """One row for each id: the path of each type in ``what``, null if it isn't there.

    An annotation that isn't in a bucket may lie in the flat folder.
    """
    check_arguments(what, ASSET_TYPES, "what")
    wanted = join_large(requested(uids), files.where(F.col("asset_type").isin(list(what))), "uid")
    if "annotation" in what:
        there = F.concat(F.lit(f"{flat}/std_"), F.col("uid"), F.lit(".json"))
        wanted = wanted.withColumn("order", F.lit(0)).unionByName(requested(uids).select("uid", F.lit("annotation").alias("asset_type"), there.alias("path"), F.lit(1).alias("order")))
    else:
        wanted = wanted.withColumn("order", F.lit(0))
    found = join_large(wanted, present.select("path"), "path", "left_semi")
    wide = found.groupBy("uid").pivot("asset_type", list(what)).agg(F.min_by("path", "order"))
    return join_large(requested(uids), wide, "uid", "left")


def load_one(uids: DataFrame, files: DataFrame, present: DataFrame, asset_type: str) -> DataFrame:
    """(uid, path): null if the file isn't there."""
    return load(uids, files, present, [asset_type]).withColumnRenamed(asset_type, "path")


def renders(uids: DataFrame, folders: DataFrame, present: DataFrame, angles: Sequence[int] = ANGLES) -> DataFrame:
    """(uid, renders): a map from each angle to the render's path, null if it isn't there. ``folders``: (uid, folder)."""
    check_arguments(map(str, angles), map(str, ANGLES), "angles")
    rows = join_large(requested(uids).select("uid", F.explode(F.array(*map(F.lit, angles))).alias("angle")), folders, "uid", "left")
    rows = rows.withColumn("path", F.concat_ws("/", "folder", render_name(F.col("angle")))).withColumn("path", F.when(F.col("folder").isNotNull(), F.col("path")))
    there = present.select(F.col("path").alias("there")).distinct()
    rows = looked_up(rows, there, "path", "there", "uid")
    pairs = F.sort_array(F.collect_list(F.struct("angle", F.col("there").alias("path"))))
    return rows.groupBy("uid").agg(F.map_from_entries(pairs).alias("renders"))


def looked_up(rows: DataFrame, there: DataFrame, path: str, found: str, key: str) -> DataFrame:
    """``rows`` with the column ``found`` of ``there`` (distinct paths) where it equals their path, else null. Rows without a path are dealt by their key, not to one task."""
    rows = rows.withColumn("lookup_", F.coalesce(path, F.concat(F.lit("\n"), F.col(key).cast("string"))))
    joined = join_large(rows, there, F.col("lookup_") == F.col(found), "left")
    return joined.withColumn(found, F.when(F.col(path).isNotNull(), F.col(found))).drop("lookup_")


def batches(rows: DataFrame, order: str | Sequence[Column], size: int = 256) -> DataFrame:
    """Adds ``batch``: rows in order, ``size`` to a batch."""
    return numbered(rows, order).withColumn("batch", F.floor(F.col("pos") / size).cast("long")).drop("pos")


def page(rows: DataFrame, order: str, index: int) -> DataFrame:
    """The row at an index, which is clamped to what there is, with ``number``, ``total``, ``has_previous`` and ``has_next``."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    at = F.greatest(F.lit(0), F.least(F.lit(index), F.col("total") - 1))
    placed = numbered(rows, order).crossJoin(F.broadcast(total)).where(F.col("pos") == at)  # one row of totals
    return placed.select(*rows.columns, (F.col("pos") + 1).cast("long").alias("number"), "total", (F.col("pos") > 0).alias("has_previous"), (F.col("pos") + 1 < F.col("total")).alias("has_next"))


def material_map(files: DataFrame, kind: str) -> DataFrame:
    """(name, main_files, thumbnail): files right inside the main folder and thumbnails, met by their stem; either may be missing."""
    main, thumbs, _, _ = MATERIALS[kind]
    mains = files.where(direct_child(F.col("path"), main)).select(stem(below(F.col("path"), main)).alias("name"), F.col("path").alias("main"), F.lit(None).cast("string").alias("thumb"))
    pictures = files.where(direct_child(F.col("path"), thumbs)).select(stem(below(F.col("path"), thumbs)).alias("name"), F.lit(None).cast("string").alias("main"), F.col("path").alias("thumb"))
    return mains.unionByName(pictures).groupBy("name").agg(F.sort_array(F.collect_list("main")).alias("main_files"), F.max("thumb").alias("thumbnail"))


def texture_files(files: DataFrame, kind: str) -> DataFrame:
    """(path) of all files of the kind's texture folder."""
    main, _, _, textures = MATERIALS[kind]
    return files.where(F.col("path").startswith(f"{main}/{textures}/") if textures else F.lit(False)).select("path")


def names(mapping: DataFrame, name: str = "name") -> DataFrame:
    return mapping.select(name).distinct().orderBy(name)


def preferred(paths: Column, suffix: str) -> Column:
    """The first path with the suffix, else the first."""
    return F.coalesce(F.get(F.filter(paths, lambda p: p.endswith(suffix)), 0), F.get(paths, 0))


def material_request(mapping: DataFrame, files: DataFrame, kind: str, wanted: DataFrame | None = None, what: Sequence[str] | None = None) -> DataFrame:
    """(path) that a load of materials needs: main files, thumbnails, and with main files all textures of the kind."""
    _, _, key, _ = MATERIALS[kind]
    what = [key, "thumbnail"] if what is None else list(what)
    check_arguments(what, [key, "thumbnail"], "what")
    chosen = mapping if wanted is None else join_large(mapping, wanted.select("name"), "name", "left_semi")
    paths = chosen.select(F.explode("main_files").alias("path")) if key in what else chosen.select(F.col("thumbnail").alias("path")).limit(0)
    if "thumbnail" in what:
        paths = paths.unionByName(chosen.where("thumbnail is not null").select(F.col("thumbnail").alias("path")))
    if key in what:
        paths = paths.unionByName(texture_files(files, kind))
    return paths.distinct()


def load_materials(mapping: DataFrame, present: DataFrame, kind: str, wanted: DataFrame | None = None) -> DataFrame:
    """(name, main, thumbnail): the file with the kind's own extension or else the first; null if it isn't there."""
    chosen = mapping if wanted is None else join_large(mapping, wanted.select("name"), "name", "left_semi")
    rows = chosen.select("name", preferred(F.col("main_files"), "." + MATERIALS[kind][2]).alias("main"), "thumbnail")
    there = present.select(F.col("path").alias("there_")).distinct()
    for column in ("main", "thumbnail"):
        rows = looked_up(rows, there, column, "there_", "name").withColumn(column, F.col("there_")).drop("there_")
    return rows.select("name", "main", "thumbnail")


def vegetation_map(files: DataFrame, kind: str) -> DataFrame:
    """(name, archive): archives right inside the kind's folder."""
    folder = VEGETATION[kind]
    return files.where(direct_child(F.col("path"), folder, ".tar.gz")).select(without_archive_suffix(below(F.col("path"), folder)).alias("name"), F.col("path").alias("archive"))


def load_vegetation(mapping: DataFrame, present: DataFrame, kind: str, wanted: DataFrame | None = None) -> DataFrame:
    """(name, folder, usd): the unpacked folder and the scene file in it; null if nothing of it is there."""
    folder = VEGETATION[kind]
    inside = present.where(F.col("path").startswith(folder + "/")).select(F.substring_index(below(F.col("path"), folder), "/", 1).alias("name"), "path").where(F.instr(below(F.col("path"), folder), "/") > 0)
    found = inside.groupBy("name").agg(F.min(F.when(F.col("path").rlike(r"\.usd[acz]?$"), F.col("path"))).alias("usd"), F.lit(True).alias("there"))
    chosen = mapping if wanted is None else join_large(mapping, wanted.select("name"), "name", "left_semi")
    return join_large(chosen, found, "name", "left").select("name", F.when(F.col("there"), F.concat(F.lit(folder + "/"), "name")).alias("folder"), "usd")


def without_preview(mapping: DataFrame, present: DataFrame, kind: str, preview: str = "_preview.glb") -> DataFrame:
    """The plants of a kind whose folder holds no preview yet."""
    path = F.concat(F.lit(VEGETATION[kind] + "/"), "name", F.lit("/" + preview))
    return join_large(mapping.withColumn("preview_", path), present.select(F.col("path").alias("preview_")), "preview_", "left_anti").select(*mapping.columns)


def without_sibling(rows: DataFrame, present: DataFrame, suffix: str, path: str = "path") -> DataFrame:
    """The rows whose path has no sibling with the suffix before its extension."""
    done = present.select(F.col("path").alias("sibling_"))
    return join_large(rows.withColumn("sibling_", renamed(F.col(path), suffix)), done, "sibling_", "left_anti").select(*rows.columns)


def precedence(rows: DataFrame, first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the first frame's value, else the second's, else null."""
    a = first.select(key, F.col(value).alias("first_")).dropDuplicates([key])
    b = second.select(key, F.col(value).alias("second_")).dropDuplicates([key])
    return join_large(join_large(rows.select(key).distinct(), a, key, "left"), b, key, "left").select(key, F.coalesce("first_", "second_").alias(value))


def conversion_plan(files: DataFrame, existing: DataFrame) -> DataFrame:
    """(uid, glb, usd, status): which files are there to convert, which are converted, which are missing. ``files``: (uid, glb, usd, glb_present)."""
    there = existing.select(F.col("path").alias("usd"), F.lit(True).alias("done_")).distinct()
    status = F.when(F.col("done_"), "existing").when(F.col("glb_present"), "to_do").otherwise("missing")
    return join_large(files, there, "usd", "left").select("uid", "glb", "usd", status.alias("status"))


def conversion_results(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """(uid, usd, error): results met with their tasks by the file, one task each."""
    first = tasks.groupBy("glb").agg(F.min_by(F.struct("uid", "usd"), "uid").alias("task"))
    return join_large(results, first, "glb").select("task.uid", F.when(F.col("ok"), F.col("task.usd")).alias("usd"), F.when(~F.col("ok"), F.col("error")).alias("error"))


def conversion_tasks(uids: DataFrame, index: DataFrame, present: DataFrame, collision: str = "convexDecomposition", instanceable: bool = False, mass: float | None = None, folder: str = USD_FOLDER) -> DataFrame:
    """(uid, glb, usd, status, collision, instanceable, mass) of a request's ids: what to convert and how, what is converted, what has no file to convert.

    A model file that isn't there is missing, whatever its conversion; the settings go with the rows that are to do.
    """
    check_arguments([collision], COLLISIONS, "collision approximation")
    if mass is not None and mass < 0:
        raise ValueError("mass must not be negative")
    loaded = load_one(uids, index, present, "glb").withColumnRenamed("path", "glb")
    usd = F.concat(F.lit(f"{folder}/std_"), F.col("uid").cast("string"), F.lit("/std_"), F.col("uid").cast("string"), F.lit(".usd"))
    plan = conversion_plan(loaded.select("uid", "glb", usd.alias("usd"), F.col("glb").isNotNull().alias("glb_present")), present)
    status = F.when(F.col("glb").isNull(), "missing").otherwise(F.col("status"))
    to_do = status == "to_do"
    return plan.select("uid", "glb", "usd", status.alias("status"), F.when(to_do, F.lit(collision)).alias("collision"), F.when(to_do, F.lit(instanceable)).alias("instanceable"), F.when(to_do, F.lit(mass).cast("double")).alias("mass"))


def converted(tasks: DataFrame, results: DataFrame, present: DataFrame) -> DataFrame:
    """(uid, usd, error) of each id: what was converted before, else what a converter says of its file (glb, ok, error) and left behind.

    A result without its file is a failure, and so is a task without a result.
    """
    told = conversion_results(tasks.where("status = 'to_do'"), results)
    there = present.select(F.col("path").alias("there_")).distinct()
    told = looked_up(told, there, "usd", "there_", "uid").select("uid", F.col("there_").alias("new_usd"), F.when(F.col("there_").isNull(), F.coalesce("error", F.lit("no file"))).alias("new_error"))
    before = F.col("status") == "existing"
    reason = F.when(F.col("status") == "missing", "nothing to convert").when(~before & F.col("new_usd").isNull(), F.coalesce("new_error", F.lit("no result")))
    return join_large(tasks, told, "uid", "left").select("uid", F.when(before, F.col("usd")).otherwise(F.col("new_usd")).alias("usd"), reason.alias("error"))


def outcome(rows: DataFrame, ok: Column, by: Iterable[str] = ()) -> DataFrame:
    """(by, ok, failed)."""
    return rows.groupBy(*by).agg(F.count_if(ok).alias("ok"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"))
