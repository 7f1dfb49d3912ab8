"""Value predicates. ``None`` as a filter means no filter; an empty list matches nothing.

They are conditions of filters: where a value is missing they are null, which a filter drops like false, and so they stay plain
enough to reach a scan's pushed filters. ``shown`` makes a column of true and false out of one.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE_TEXT = "none"  # a missing element compares like this word


def _lowered(values: Iterable) -> list[str]:
    return sorted({NONE_TEXT if v is None else str(v).lower() for v in values})


def in_range(value: Column, bounds: Sequence[float]) -> Column:
    """Inclusive at both ends; a missing value fails, and so does NaN, which is greater than any number."""
    return value.between(*bounds)


def shown(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def any_of(values: Column, wanted: Iterable) -> Column:
    """Does any element equal a wanted one, whatever its case?"""
    names = _lowered(wanted)
    if not names:
        return F.lit(False)
    return values.isNotNull() & F.exists(values, lambda x: F.coalesce(F.lower(x), F.lit(NONE_TEXT)).isin(names))


def dominant(values: Column) -> Column:
    """The first element in lower case; null for an empty or missing list. What ``dominant_in`` compares, to be stored."""
    return F.when(F.size(values) > 0, F.coalesce(F.lower(F.get(values, 0)), F.lit(NONE_TEXT)))


def dominant_in(values: Column, wanted: Iterable) -> Column:
    """Is the first element a wanted one? Empty and missing lists fail."""
    names = _lowered(wanted)
    return values.isNotNull() & dominant(values).isin(names) if names else F.lit(False)


def one_of(value: Column, allowed: Iterable) -> Column:
    """Does the value equal an allowed one, whatever its case?"""
    return lowered_in(F.lower(value), allowed)


def lowered_in(value: Column, allowed: Iterable) -> Column:
    """``one_of`` and ``dominant_in`` on a stored column that is in lower case already, so that the scan can do it."""
    names = _lowered(allowed)
    return value.isin(names) if names else F.lit(False)


def flag_is(value: Column, required: bool) -> Column:
    """A missing flag counts as false. Plain enough to reach a scan's pushed filters."""
    return value.eqNullSafe(F.lit(True)) if required else value.isNull() | value.eqNullSafe(F.lit(False))


def any_level_in(levels: Iterable[Column], wanted: Iterable) -> Column:
    """Does the class name of any level equal a wanted one, whatever its case?"""
    return reduce(lambda a, b: a | b, [one_of(c, wanted) for c in levels])


def contains_text(value: Column, query: str | None) -> Column:
    """Search box: case and outer blanks don't matter; an empty query matches everything."""
    wanted = (query or "").strip().lower()
    return F.contains(F.lower(value), F.lit(wanted)) if wanted else F.lit(True)


def direct_child(path: Column, folder: str, suffix: str = "") -> Column:
    """Is the path right inside the folder, with this suffix?"""
    rest = F.substring(path, len(folder) + 2, 1 << 30)
    return path.startswith(folder + "/") & (F.instr(rest, "/") == 0) & (F.length(rest) > 0) & path.endswith(suffix)


def near(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return F.abs(a - b) < tolerance


def typed_as(kind: Column, default: Column, kinds: Sequence[str]) -> Column:
    """Is it of one of these types and has a default?"""
    return kind.isin(list(kinds)) & default.isNotNull()


def all_of(predicates: Iterable[Column]) -> Column:
    """All together, as conjuncts that a scan can take one by one."""
    predicates = list(predicates)
    return reduce(lambda a, b: a & b, predicates) if predicates else F.lit(True)
