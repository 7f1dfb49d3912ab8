"""Path and name strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Everything before the last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(name: Column) -> Column:
    """The name up to its first dot."""
    return F.substring_index(name, ".", 1)


def without_archive_suffix(name: Column) -> Column:
    return F.regexp_replace(name, r"\.(tar\.gz|tgz)$", "")


def below(path: Column, folder: str) -> Column:
    """The path relative to the folder that it lies in."""
    return F.substring(path, len(folder) + 2, 1 << 30)


def spaced(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def without_leading_dots(path: Column) -> Column:
    """Any leading dots and slashes are dropped, however many."""
    return F.regexp_replace(path, r"^[./]+", "")


def renamed(path: Column, suffix: str) -> Column:
    """The suffix goes before the extension."""
    return F.regexp_replace(path, r"(\.[^./]+)$", suffix + "$1")


def render_name(angle: Column) -> Column:
    """File name of the render at an angle: the angle always has a decimal."""
    return F.concat(F.lit("render_"), angle.cast("double").cast("string"), F.lit(".jpg"))


def url(base: str, path: Column) -> Column:
    return F.concat_ws("/", F.lit(base.rstrip("/")), path)


def resolved(folder: Column, authored: Column) -> Column:
    """An authored path as seen from a folder: ``.`` stays, ``..`` goes up."""
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), authored), "/"), lambda p: (p != ".") & (p != ""))
    walk = lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), walk), "/")
