"""The three-level category hierarchy."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.functions.predicates import any_level_in
from assetloom.sources.shared import join_large

LEVELS = (1, 2, 3)


def all_uids(bridge: DataFrame) -> DataFrame:
    """(uid) in catalog order, repeats kept."""
    return bridge.orderBy("category_pos", "pos").select("uid")


def places(members: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds ``pos``: the place of each member of a group in order, from 0."""
    return members.withColumn("pos", (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("long"))


def by_level(bridge: DataFrame, level: int) -> DataFrame:
    """(name, uids): the assets of each class of a level, in catalog order, repeats kept."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    members = F.sort_array(F.collect_list(F.struct("category_pos", "pos", "uid")))
    return bridge.groupBy(F.col(f"l{level}").alias("name")).agg(F.transform(members, lambda m: m["uid"]).alias("uids"))


def counts(bridge: DataFrame, level: int) -> DataFrame:
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    return bridge.groupBy(F.col(f"l{level}").alias("name")).agg(F.count(F.lit(1)).alias("n"))


def distribution(rows: DataFrame, *levels: str) -> DataFrame:
    """(levels, level, n): counts of every class of every level and of all; ``level`` is the grouping id."""
    return rows.rollup(*levels).agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"))


def in_categories(bridge: DataFrame, wanted: Iterable[str], levels: Iterable[str] = ("l1", "l2", "l3"), key: str = "uid") -> DataFrame:
    """(key), each once, of the rows whose class name at any level is wanted; no names, no rows."""
    return bridge.where(any_level_in([F.col(c) for c in levels], wanted)).select(key).distinct()


def unknown_names(requested: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """Requested names that aren't known, sorted."""
    there = known.select(F.col(name).alias("known_"))
    return join_large(requested.select(name).distinct(), there, F.col(name).eqNullSafe(F.col("known_")), "left_anti").orderBy(name)


def check_names(requested: DataFrame, known: DataFrame, name: str = "name", shown: int = 20) -> None:
    """Raise with the first unknown names, if there are any."""
    unknown = [r[0] for r in unknown_names(requested, known, name).limit(shown).collect()]
    if unknown:
        raise ValueError(f"unknown names: {unknown}")


def check_arguments(given: Iterable[str], valid: Iterable[str], what: str) -> None:
    wrong = set(given) - set(valid)
    if wrong:
        raise ValueError(f"{what}: {sorted(wrong)} not among {sorted(valid)}")


def search(rows: DataFrame, matches: Column) -> DataFrame:
    """(visible, total) of a search box."""
    return rows.agg(F.count_if(matches).alias("visible"), F.count(F.lit(1)).alias("total"))
