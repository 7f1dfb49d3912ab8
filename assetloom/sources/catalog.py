"""Sources: master annotation, asset documents, bundles, bucket indexes, listings and texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetloom.functions.predicates import dominant
from assetloom.schema import ASSET, ATTRIBUTE_PREFIX, MASTER
from assetloom.sources.bundles import register
from assetloom.sources.shared import written

#: Kinds of files that each asset has.
ASSET_TYPES = ("glb", "annotation", "thumbnail", "render")


def master(spark: SparkSession, path: str) -> DataFrame:
    """The one-row master annotation, with its explicit schema."""
    return spark.read.schema(MASTER).json(path, multiLine=True)


def info(master_row: DataFrame) -> DataFrame:
    """Dataset metadata: what it is about and its statistics."""
    return master_row.select("about.*", "statistics")


def category_dim(master_row: DataFrame) -> DataFrame:
    """One row for each leaf category, in the document's order: (pos, key, l1, l2, l3, ids, asset_uids, asset_count)."""
    rows = master_row.select(F.posexplode(F.map_entries("annotation")).alias("pos", "entry"))
    names = [F.col(f"entry.value.class_name_l{i}").alias(f"l{i}") for i in (1, 2, 3)]
    ids = [F.col(f"entry.value.class_id_l{i}").alias(f"id_l{i}") for i in (1, 2, 3)]
    return rows.select("pos", F.col("entry.key").alias("key"), *names, *ids, F.col("entry.value.asset_uids").alias("asset_uids"), F.col("entry.value.asset_count").alias("asset_count"))


def asset_category(categories: DataFrame) -> DataFrame:
    """Bridge (uid, l1, l2, l3, category_pos, pos): catalog order, repeats kept."""
    return categories.select("l1", "l2", "l3", F.col("pos").alias("category_pos"), F.posexplode("asset_uids").alias("pos", "uid"))


def statistics(bridge: DataFrame) -> DataFrame:
    """Counts as the master annotation should state them."""
    counts = [F.count_distinct(f"l{i}").alias(f"number_of_classes_l{i}") for i in (1, 2, 3)]
    return bridge.agg(F.count_distinct("uid").alias("number_of_assets"), *counts)


def parse_assets(texts: DataFrame, value: str = "value") -> DataFrame:
    """Asset rows of JSON texts. Class-specific keys go into the map ``attributes``; values of a wrong type are null."""
    parsed = texts.select(F.from_json(value, ASSET).alias("asset"), F.from_json(value, "map<string,string>").alias("fields"))
    special = F.map_filter("fields", lambda k, _: k.startswith(ATTRIBUTE_PREFIX))
    return parsed.select("asset.*", special.alias("attributes"))


def asset_documents(spark: SparkSession, path: str) -> DataFrame:
    """Assets from one JSON file each. Hidden names (``._*``) are skipped by Spark's listing."""
    texts = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    return parse_assets(texts)


def bundle(spark: SparkSession, path: str, **options) -> DataFrame:
    """(archive, name, value, error) of the JSON members of tar archives, wherever in an archive they lie; what couldn't be read has an error and no value."""
    register(spark)
    return spark.read.format("tar_members").options(suffix=".json", **options).load(path)


def bundle_members(spark: SparkSession, path: str, **options) -> DataFrame:
    """(name, value) of the JSON members that could be read; bytes that aren't UTF-8 are replaced."""
    read = bundle(spark, path, **options).where("value is not null")
    return read.select(F.substring_index("name", "/", -1).alias("name"), F.make_valid_utf8(F.col("value").cast("string")).alias("value"))


def ingest_assets(texts: DataFrame, target: str) -> DataFrame:
    """Write parsed assets as Parquet once, clustered by category, with lower-case shadow columns for pushed-down matches."""
    assets = parse_assets(texts)
    shadows = {f"{c}_lc": F.lower(c) for c in ("surface_hardness", "surface_finish", "asset_composition_type")}
    shadows |= {f"dominant_{c}_lc": dominant(F.col(c)) for c in ("materials", "colors")}
    assets.withColumns(shadows).repartitionByRange("category").sortWithinPartitions("category", "uid").write.mode("overwrite").parquet(target)
    return texts.sparkSession.read.parquet(target)


def bucket_index(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(uid, asset_type, path) from one JSON map of each type."""
    unknown = set(paths) - set(ASSET_TYPES)
    if unknown:
        raise ValueError(f"unknown asset types: {sorted(unknown)}")
    found = None
    for kind, path in paths.items():
        rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("uid", "path"))
        rows = rows.select("uid", F.lit(kind).alias("asset_type"), "path")
        found = rows if found is None else found.unionByName(rows)
    return found if found is not None else spark.createDataFrame([], "uid string, asset_type string, path string")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(folder, path, length, modified) of all files under a root, from their metadata alone; write it partitioned by folder to prune."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rest = F.regexp_replace(F.col("path"), r"^[a-z]+:/+", "/")
    root = "/" + path.split(":", 1)[-1].strip("/") if ":" in path.split("/")[0] else path.rstrip("/")
    relative = F.substring(rest, len(root) + 2, 1 << 30)
    return files.select(F.substring_index(relative, "/", 1).alias("folder"), relative.alias("path"), "length", F.col("modificationTime").alias("modified"))


def folder_listing(files: DataFrame, folder: str) -> DataFrame:
    """The subtree of one folder; on a table that is partitioned by top folder this prunes."""
    top = folder.split("/", 1)[0]
    found = files.where(F.col("path").startswith(folder.rstrip("/") + "/"))
    return found.where(F.col("folder") == top) if "folder" in files.columns else found


def named_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path) of files with a name pattern anywhere under a root, sorted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path").orderBy("path")


def material_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole material files; bytes that aren't UTF-8 are replaced."""
    texts = spark.read.text(path, wholetext=True, pathGlobFilter="*.mdl")
    return texts.select(F.col("_metadata.file_path").alias("path"), "value")


def numbered(files: DataFrame, order: str | Sequence[Column] = "path") -> DataFrame:
    """Adds ``pos``: the place in order, from 0. Positions of a global order without one big sort task:
    rows are counted per range partition and each partition starts at the sum of those before."""
    order = [order] if isinstance(order, str) else list(order)
    sorted_ = files.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = written(sorted_.withColumns({"part_": F.spark_partition_id(), "place_": F.monotonically_increasing_id()}), "numbered")
    counts = parts.groupBy("part_").agg(F.min("place_").alias("first_"), F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")  # one row for each partition
    shifts = counts.select("part_", (before - F.col("first_")).alias("shift_"))
    return parts.join(F.broadcast(shifts), "part_").withColumn("pos", F.col("place_") + F.col("shift_")).drop("part_", "place_", "shift_")


def refresh(spark: SparkSession, path: str) -> None:
    """Forget what is cached of a source, so the next read sees its files anew."""
    spark.catalog.refreshByPath(path)


def attribute_names(assets: DataFrame) -> DataFrame:
    """(name, n): which class-specific attributes there are."""
    return assets.select(F.explode(F.map_keys("attributes")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def quality_counts(texts: DataFrame, value: str = "value") -> DataFrame:
    """(field, unreadable): per field, documents in which it has a value that its type can't hold."""
    pairs = []
    fields = F.from_json(value, "map<string,string>")
    parsed = texts.select(F.from_json(value, ASSET).alias("asset"), fields.alias("fields"))
    for f in ASSET:
        bad = F.col("fields").getItem(f.name).isNotNull() & F.col(f"asset.{f.name}").isNull()
        pairs.append(F.struct(F.lit(f.name).alias("field"), F.count_if(bad).alias("unreadable")))
    return parsed.agg(F.array(*pairs).alias("all")).select(F.explode("all").alias("one")).select("one.*")
