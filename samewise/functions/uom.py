"""Relationship of two units of measure."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import reference as R
from .text import at, literal_map


def _plain(c: Column) -> Column:
    t = F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    return F.when(t.isin("nan", "nat"), "").otherwise(t)


def relationship(a: Column, b: Column) -> Column:
    x, y = _plain(a), _plain(b)
    unit, kind = literal_map({k: v[0] for k, v in R.UOM.items()}), literal_map({k: v[1] for k, v in R.UOM.items()})
    ux, uy, kx, ky = at(unit, x), at(unit, y), at(kind, x), at(kind, y)
    return (
        F.when(x.isin(R.UOM_NONE) | y.isin(R.UOM_NONE), "MISSING_OR_WILDCARD").when(ux.isNull() | uy.isNull(), "MALFORMED_OR_UNKNOWN")
        .when(ux == uy, "SAME_UOM").when(kx == ky, "CONVERTIBLE_SAME_DIMENSION").otherwise("DIFFERENT_DIMENSION_OR_BASIS")
    )


def penalty(rel: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in R.UOM_PENALTY.items():
        out = F.when(rel == name, F.lit(value)).otherwise(out)
    return out
