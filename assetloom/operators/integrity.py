"""What should be there against what is: report, repair plan, completeness."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.functions.paths import stem, without_archive_suffix
from assetloom.operators.files import MATERIALS, VEGETATION, looked_up
from assetloom.sources.catalog import ASSET_TYPES
from assetloom.sources.shared import join_large, written
from assetloom.sources.transfer import fetch_missing


def expected_assets(bridge: DataFrame, files: DataFrame, types: Sequence[str] = ASSET_TYPES) -> DataFrame:
    """(kind, subkind, item, path) of all assets' files of the types; an asset without an index entry is expected without a path."""
    uids = bridge.select("uid").distinct()
    known = join_large(uids, files.where(F.col("asset_type").isin(list(types))), "uid").select(F.lit("object").alias("kind"), F.col("asset_type").alias("subkind"), F.col("uid").alias("item"), "path")
    pairs = uids.select("uid", F.explode(F.array(*map(F.lit, types))).alias("asset_type"))
    absent = join_large(pairs, files.select("uid", "asset_type"), ["uid", "asset_type"], "left_anti")
    return known.unionByName(absent.select(F.lit("object").alias("kind"), F.col("asset_type").alias("subkind"), F.col("uid").alias("item"), F.lit(None).cast("string").alias("path")))


def expected_materials(mapping: DataFrame, kind: str) -> DataFrame:
    """An item for each material; its files are its main files and its thumbnail, if it has one."""
    paths = F.explode_outer(F.array_compact(F.concat(F.coalesce("main_files", F.array().cast("array<string>")), F.array("thumbnail"))))
    return mapping.select(F.lit("material").alias("kind"), F.lit(kind).alias("subkind"), F.col("name").alias("item"), paths.alias("path"))


def expected_vegetation(mapping: DataFrame, kind: str, folder: str) -> DataFrame:
    """An item for each plant; it is there when anything of its folder is."""
    return mapping.select(F.lit("vegetation").alias("kind"), F.lit(kind).alias("subkind"), F.col("name").alias("item"), F.concat(F.lit(folder + "/"), "name", F.lit("/")).alias("path"))


def expected_files(listed: DataFrame) -> DataFrame:
    """(kind, subkind, item, path, rule, source) of all materials and plants, from one pass over a listing (path).

    A material's files are all that lie right inside its kind's folders under its name; a plant is there when anything of its
    folder is, and comes as an archive (``source``).
    """
    folders = {f: ("material", kind) for kind, (main, thumbs, _, _) in MATERIALS.items() for f in (main, thumbs)} | {f: ("vegetation", kind) for kind, f in VEGETATION.items()}
    top, rest = F.substring_index("path", "/", 1), F.substring_index("path", "/", -1)
    of = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for f, names in folders.items() for x in (f, names[i])]), top)
    inside = listed.where(top.isin(list(folders)) & (F.size(F.split("path", "/")) == 2) & (rest != "")).select(of(0).alias("kind"), of(1).alias("subkind"), "path", rest.alias("name"), top.alias("top"))
    archive = F.col("kind") == "vegetation"
    inside = inside.where(~archive | F.col("name").endswith(".tar.gz"))
    item = F.when(archive, without_archive_suffix(F.col("name"))).otherwise(stem(F.col("name")))
    unpacked = F.concat("top", F.lit("/"), without_archive_suffix(F.col("name")), F.lit("/"))
    return inside.select("kind", "subkind", item.alias("item"), F.when(archive, unpacked).otherwise(F.col("path")).alias("path"), F.lit("all").alias("rule"), F.col("path").alias("source"))


def expected_objects(uids: DataFrame, index: DataFrame, flat: str = "assets") -> DataFrame:
    """(kind, subkind, item, path, rule, source) of all assets' files, from one pass over the index.

    Of an annotation's two places one will do; renders are there when their archive's folder is. What has no index entry is expected without a path.
    """
    ids = uids.select(F.col("uid").cast("string").alias("uid")).distinct()
    rows = ids.select("uid", F.explode(F.array(*map(F.lit, ASSET_TYPES))).alias("asset_type"))
    rows = join_large(rows, index.select(F.col("uid").cast("string").alias("uid"), "asset_type", "path"), ["uid", "asset_type"], "left")
    kind = F.col("asset_type")
    flat_path = F.concat(F.lit(f"{flat}/std_"), "uid", F.lit(".json"))
    places = F.when(kind == "annotation", F.array("path", flat_path)).when(kind == "render", F.array(F.concat(without_archive_suffix(F.col("path")), F.lit("/")))).otherwise(F.array("path"))
    rows = rows.select("uid", kind, F.explode(places).alias("place"), "path").where(F.col("place").isNotNull() | (kind != "annotation"))
    return rows.select(F.lit("object").alias("kind"), kind.alias("subkind"), F.col("uid").alias("item"), F.col("place").alias("path"), F.when(kind == "annotation", "any").otherwise("all").alias("rule"), F.when(kind == "render", F.col("path")).otherwise(F.col("place")).alias("source"))


def found_paths(expected: DataFrame, present: DataFrame) -> DataFrame:
    """``expected`` with ``rule`` and ``ok``: is the path there? A path that ends in a slash is a folder."""
    if "rule" not in expected.columns:
        expected = expected.withColumn("rule", F.lit("all"))
    folders = expected.where(F.col("path").endswith("/")).select("path").distinct()
    above = present.select(F.explode(F.expr("transform(sequence(1, size(split(path, '/')) - 1), i -> concat(substring_index(path, '/', i), '/'))")).alias("path")).where(F.size(F.split("path", "/")) > 1)
    # a folder may be above very many files, so each goes once to the join
    there = present.select("path").unionByName(join_large(above.distinct(), folders, "path", "left_semi")).distinct().select(F.col("path").alias("found"))
    # a material without any files counts as there, an asset without a path doesn't
    ok = F.col("found").isNotNull() | (F.col("path").isNull() & (F.col("kind") == "material"))
    return looked_up(expected, there, "path", "found", "item").withColumn("ok", ok).drop("found")


def _items(paths: DataFrame) -> DataFrame:
    """(kind, subkind, item, there): all rules in one aggregation."""
    any_ = F.bool_or(F.col("rule") == "any")
    return paths.groupBy("kind", "subkind", "item").agg(F.when(any_, F.bool_or("ok")).otherwise(F.bool_and("ok")).alias("there"))


def status(expected: DataFrame, present: DataFrame) -> DataFrame:
    """(kind, subkind, item, there): an item is there when all its paths are, or any of them if that is its ``rule``."""
    return _items(found_paths(expected, present))


def judged(expected: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``found_paths``, ``status``) as stored tables, for a plan and a report that both need them."""
    paths = written(found_paths(expected, present), "judged-paths")
    return paths, written(_items(paths), "judged-items")


def repaired(expected: DataFrame, present: DataFrame, fetched: DataFrame, seen: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(kind, subkind, item, was, there) of each item before and after ``fetched`` (path: the sources that came).

    What is present is looked at once (or not at all, if ``seen`` is what ``judged`` gave before); after the fetch only the items that were missing are judged again, by what came.
    Running it again with what is there by then gives the rest.
    """
    keys = ["kind", "subkind", "item"]
    paths, was = judged(expected, present) if seen is None else seen
    gone = join_large(paths, was.where(~F.col("there")).select(*keys), keys, "left_semi")
    source = F.coalesce(F.col("source"), F.col("path")) if "source" in expected.columns else F.col("path")
    came = fetched.select(F.col("path").alias("came")).distinct()
    again = looked_up(gone.withColumn("source_", source), came, "source_", "came", "item").withColumn("ok", F.col("ok") | F.col("came").isNotNull())
    now = _items(again).withColumnRenamed("there", "now")
    return join_large(was.withColumnRenamed("there", "was"), now, keys, "left").select(*keys, "was", F.coalesce("now", "was").alias("there"))


def repair(expected: DataFrame, present: DataFrame, fetch: Callable[[str], bytes], put: Callable[[str, bytes], None], tries: int = 5) -> tuple[DataFrame, DataFrame]:
    """(items before and after, results of the fetch): check, fetch what is missing, check again. ``fetch`` and ``put`` run on the executors."""
    seen = judged(expected, present)
    wanted = repair_plan(expected, present, seen).select(F.col("source").alias("path") if "source" in expected.columns else "path")
    nothing = present.select("path").limit(0)
    results = written(fetch_missing(wanted, nothing, fetch, put, tries), "repair-results")
    return repaired(expected, present, results.where("status = 'fetched'").select("path"), seen), results


def delta(items: DataFrame) -> DataFrame:
    """(kind, subkind, expected, present, repaired, missing) of items (was, there), with subtotals of kinds and the total (nulls)."""
    return items.rollup("kind", "subkind").agg(F.count(F.lit(1)).alias("expected"), F.count_if("was").alias("present"), F.count_if(F.col("there") & ~F.col("was")).alias("repaired"), F.count_if(~F.col("there")).alias("missing"))


def whole_request(expected: DataFrame) -> DataFrame:
    """(kind, subkind, path): everything there is to fetch, each path once for its kind."""
    return expected.select("kind", "subkind", F.coalesce("source", "path").alias("path")).where("path is not null").distinct()


def report(items: DataFrame) -> DataFrame:
    """(kind, subkind, expected, present, missing), with subtotals of kinds and the total (nulls)."""
    return items.rollup("kind", "subkind").agg(F.count(F.lit(1)).alias("expected"), F.count_if("there").alias("present"), F.count_if(~F.col("there")).alias("missing"))


def _name() -> Column:
    return F.coalesce(F.concat("kind", F.lit("/"), "subkind"), F.concat("kind", F.lit("/*")), F.lit("all"))


def lines(reported: DataFrame) -> DataFrame:
    """(line): a report as text."""
    return reported.select(F.format_string("%s: %d of %d, %d missing", _name(), "present", "expected", "missing").alias("line"))


def aligned(reported: DataFrame) -> DataFrame:
    """(line): a report as text in columns, as wide as the longest name and number."""
    named = reported.select(_name().alias("name"), F.col("expected").cast("string").alias("expected"), F.col("present").cast("string").alias("present"), "missing")
    widths = named.agg(F.max(F.length("name")).alias("wide"), F.max(F.length("expected")).alias("digits"))
    state = F.when(F.col("missing") == 0, "OK").otherwise(F.format_string("(%d missing)", "missing"))
    number = F.concat(F.lpad("present", F.col("digits"), F.lit(" ")), F.lit(" / "), F.rpad("expected", F.col("digits"), F.lit(" ")))
    placed = named.crossJoin(F.broadcast(widths))  # one row of widths
    return placed.select(F.concat_ws("  ", F.rpad("name", F.col("wide"), F.lit(" ")), number, state).alias("line"))


def complete(items: DataFrame) -> DataFrame:
    """(missing, complete)."""
    return items.agg(F.count_if(~F.col("there")).alias("missing")).select("missing", (F.col("missing") == 0).alias("complete"))


def repair_plan(expected: DataFrame, present: DataFrame, seen: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The rows of ``expected`` to fetch: every missing path of an item that isn't there, annotations included. ``seen``: what ``judged`` gave before."""
    paths, items = judged(expected, present) if seen is None else seen
    gone = items.where(~F.col("there")).select("kind", "subkind", "item")
    return join_large(paths.where("not ok and path is not null"), gone, ["kind", "subkind", "item"], "left_semi").select(*expected.columns)


def counted(expected: DataFrame, present: DataFrame, key: str, *groups: str) -> DataFrame:
    """Expected, present and missing keys by group, with the total."""
    there = present.select(key).distinct().withColumn("there", F.lit(True))
    rows = join_large(expected, there, key, "left").withColumn("there", F.coalesce("there", F.lit(False)))
    return rows.rollup(*groups).agg(F.count(F.lit(1)).alias("expected"), F.count_if("there").alias("present"), F.count_if(~F.col("there")).alias("missing"))
