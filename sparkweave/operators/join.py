"""Joins of bindings.  All are declared; Catalyst and adaptive execution pick the strategy from sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import written


def natural(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on all shared variables at once; a product when there are none."""
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right, shared) if shared else left.crossJoin(right)


def exists(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` if ``right`` has a row, else nothing; one row of ``right`` is looked for."""
    return left.crossJoin(F.broadcast(right.limit(1).select()))


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right, shared, "left") if shared else left.join(right, F.lit(True), "left")


def compatible(left: DataFrame, right: DataFrame, left_maybe: set[str], right_maybe: set[str], how: str = "inner") -> tuple[DataFrame, set[str]]:
    """Join where a shared variable that one side leaves unbound (null) agrees with any value; also the variables that may still be unbound.

    Sides are split by which of these variables are bound, so that every part is an equality join.  ``how``: inner, or left (an OPTIONAL).
    """
    columns = [*left.columns, *(c for c in right.columns if c not in left.columns)]
    unsure = sorted((left_maybe | right_maybe) & set(left.columns) & set(right.columns))
    sure = (left_maybe - set(right.columns)) | (right_maybe - set(left.columns)) | (left_maybe & right_maybe)
    if not unsure:
        return (natural(left, right) if how == "inner" else optional(left, right)).select(*_named(columns)), left_maybe | (right_maybe - set(left.columns))
    if how == "left":  # rows without any partner stay as they are
        left = left.withColumn(" row", F.monotonically_increasing_id())
        left = written(left, "optional")
        found, _ = compatible(left, right, left_maybe, right_maybe)
        rest = left.join(found.select(" row").distinct(), " row", "left_anti")
        return found.unionByName(rest, allowMissingColumns=True).select(*_named(columns)), sure | (left_maybe & right_maybe) | left_maybe
    v = unsure[0]
    col = F.col(f"`{v}`")
    parts = []
    for on_left in (True, False) if v in left_maybe else (True,):
        for on_right in (True, False) if v in right_maybe else (True,):
            x = left.where(col.isNotNull() if on_left else col.isNull()) if v in left_maybe else left
            y = right.where(col.isNotNull() if on_right else col.isNull()) if v in right_maybe else right
            if not on_left:
                x = x.drop(v)
            elif not on_right:
                y = y.drop(v)
            parts.append(compatible(x, y, left_maybe - {v}, right_maybe - {v})[0])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*_named([*left.columns, *(c for c in columns if c not in left.columns)])), sure


def _named(columns: list[str]) -> list[F.Column]:
    return [F.col(f"`{c}`") for c in columns]


def semi(left: DataFrame, right: DataFrame, on: list[str], hint: str | None = None) -> DataFrame:
    """Rows of ``left`` with a partner; ``hint``: merge, shuffle_hash or none, for the physical join."""
    right = right.select(*on)
    return left.join(right.hint(hint) if hint else right, on, "left_semi")


def reduce_both(left: DataFrame, right: DataFrame, on: list[str], hint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides reduced to rows that have a partner in the other."""
    return semi(left, right, on, hint), semi(right, left, on, hint)
