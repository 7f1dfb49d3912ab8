"""The catalog query: categories, attribute filters, then similarity. Joins and scans appear only when they are needed."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.functions.predicates import all_of, any_of, dominant_in, flag_is, in_range, lowered_in, one_of
from assetloom.operators.hierarchy import in_categories
from assetloom.operators.similarity import dual_scores, top_k

RANGES = ("height", "length", "width", "max_dimension", "mass", "quality", "required_force", "surface_roughness", "reflectivity", "index_of_refraction", "youngs_modulus", "friction_coefficient", "bounciness", "recommended_clearance")
FLAGS = ("receptacle", "movable", "walkable", "enterable", "support_surface")
DOMINANT = {"dominant_materials": "materials", "dominant_colors": "colors"}
LISTS = ("affordances", "interactive_parts")
ENUMS = ("surface_hardness", "surface_finish", "asset_composition_type")
#: Every attribute filter, by the name under which it is given.
PARAMETERS = (*(f"{r}_range" for r in RANGES), *FLAGS, *DOMINANT, *LISTS, *ENUMS)


def shadow(parameter: str) -> str:
    """The stored lower-case column that answers a filter on text or on a list's first element."""
    return f"{parameter}_lc"


def attribute_predicates(columns: Iterable[str] = (), **filters) -> list[Column]:
    """One predicate for each filter that is given; they hold together, the values of one filter are alternatives.

    Where ``columns`` has a lower-case shadow of what is asked (``ingest_assets`` stores them), it is asked instead, so the filter reaches the scan.
    """
    unknown = set(filters) - set(PARAMETERS)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    found = []
    for name, value in filters.items():
        if value is None:
            continue
        if name.endswith("_range"):
            found.append(in_range(F.col(name.removesuffix("_range")), value))
        elif name in FLAGS:
            found.append(flag_is(F.col(name), value))
        elif shadow(name) in columns:
            found.append(lowered_in(F.col(shadow(name)), value))
        elif name in DOMINANT:
            found.append(dominant_in(F.col(DOMINANT[name]), value))
        elif name in LISTS:
            found.append(any_of(F.col(name), value))
        else:
            found.append(one_of(F.col(name), value))
    return found


@dataclass(frozen=True)
class AssetQuery:
    """Conditions on assets; each method gives a new query, ``uids`` the DataFrame.

    ``bridge``: (uid, l1, l2, l3, category_pos, pos); ``assets``: asset rows; ``vectors``: (uid, short, long) of unit
    vectors. Without categories the catalog's repeats are kept.
    """

    bridge: DataFrame
    assets: DataFrame
    vectors: DataFrame | None = None
    names: tuple[str, ...] | None = None
    filters: dict = field(default_factory=dict)
    query: tuple[float, ...] | None = None
    k: int | None = 100

    def in_categories(self, names: Iterable[str] | None) -> AssetQuery:
        return replace(self, names=None if names is None else tuple(names))

    def where(self, **filters) -> AssetQuery:
        attribute_predicates(**filters)
        return replace(self, filters=self.filters | filters)

    def similar_to(self, query: Sequence[float] | None, k: int | None = 100) -> AssetQuery:
        if k is not None and k < 0:
            raise ValueError("k must not be negative")
        return replace(self, query=None if query is None else tuple(query), k=k)

    def uids(self) -> DataFrame:
        """(uid), and its score if there is a query."""
        found = self.bridge.select("uid") if self.names is None else in_categories(self.bridge, self.names)
        predicates = attribute_predicates(self.assets.columns, **self.filters)
        if predicates:
            found = found.join(self.assets.where(all_of(predicates)).select("uid"), "uid")
        elif self.query is not None:
            found = found.join(self.assets.select("uid"), "uid", "left_semi")
        if self.query is None:
            return found
        scored = found.join(self.vectors, "uid").select("uid", dual_scores(self.query, "short", "long").alias("score"))
        return top_k(scored, self.k)
