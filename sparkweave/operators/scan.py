"""Scans of one triple pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.algebra import Id, Pattern, Var


def scan(triples: DataFrame, pattern: Pattern, bounds: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """One bigint column for each variable of the pattern, one row for each matching triple.

    Constants become filters that reach the Parquet scan; a predicate prunes folders.  A variable
    that stands twice is an equality.  A pattern of constants gives a row without columns for its triple.
    ``bounds``: smallest and largest value of variables; they reach the scan too, where they rule out files and row groups.
    """
    columns: dict[str, F.Column] = {}
    for c, term in zip("spo", pattern.terms, strict=True):
        if isinstance(term, Id):
            triples = triples.where(F.col(c) == F.lit(term.value))
        elif isinstance(term, Var):
            value = F.col(c).cast("long")
            if c != "p" and term.name in (bounds or {}):
                triples = triples.where(F.col(c).between(*bounds[term.name]))
            if term.name in columns:
                triples = triples.where(columns[term.name] == value)
            else:
                columns[term.name] = value
        else:
            raise TypeError(f"{term} must be looked up before a scan")
    return triples.select(*[v.alias(n) for n, v in columns.items()])


def order_for(pattern: Pattern) -> str:
    """Layout whose sort order serves the pattern's constants."""
    return "by_o" if isinstance(pattern.o, Id) and not isinstance(pattern.s, Id) else "by_s"
