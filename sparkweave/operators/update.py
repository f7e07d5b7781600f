"""Updates as functions from one snapshot to the next.

A snapshot is a base table of triples and a delta: ``added`` (none of them in the rest of the base) and ``removed`` (all of them in the base).
An update reads what it matches and writes a new delta; the base is not touched, and the plan of a snapshot does not grow with the number of updates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.algebra import DeleteData, DeleteWhere, Id, Insert, Pattern, Rename, Statement, Var
from ..sources.store import TRIPLES, written

_KEY = ["s", "p", "o"]


@dataclass(frozen=True)
class Snapshot:
    """``base`` in the two orders of a store, less ``removed``, with ``added``."""

    base: DataFrame
    by_o: DataFrame
    added: DataFrame | None = None
    removed: DataFrame | None = None

    def triples(self, order: str = "by_s") -> DataFrame:
        out = self.base if order == "by_s" else self.by_o
        if self.removed is not None:
            out = out.join(self.removed, _KEY, "left_anti").select(*_KEY)
        return out if self.added is None else out.union(self.added)

    def stepped(self, added: DataFrame, removed: DataFrame) -> Snapshot:
        """With another delta, written down; an empty part of it is left out."""
        parts = [written(x.select(*_KEY), "delta") for x in (added, removed)]
        parts = [None if x.isEmpty() else x for x in parts]
        return replace(self, added=parts[0], removed=parts[1])

    def _delta(self) -> tuple[DataFrame, DataFrame]:
        none = self.base.sparkSession.createDataFrame([], TRIPLES)
        return self.added if self.added is not None else none, self.removed if self.removed is not None else none


def _numbers(pattern: Pattern) -> tuple[int, int, int]:
    if not all(isinstance(t, Id) for t in pattern.terms):
        raise ValueError(f"{pattern} is not a triple of numbered terms")
    return tuple(t.value for t in pattern.terms)  # type: ignore[return-value]


def _frame(snapshot: Snapshot, given: Sequence[Pattern]) -> DataFrame:
    return snapshot.base.sparkSession.createDataFrame([_numbers(p) for p in given], TRIPLES).distinct()


def _matches(pattern: Pattern) -> F.Column:
    out = F.lit(True)
    for c, t in zip("spo", pattern.terms, strict=True):
        if isinstance(t, Id):
            out = out & (F.col(c) == t.value)
    if isinstance(pattern.s, Var) and pattern.s == pattern.o:
        out = out & (F.col("s") == F.col("o"))
    return out


def _order(pattern: Pattern) -> str:
    return "by_o" if isinstance(pattern.o, Id) and not isinstance(pattern.s, Id) else "by_s"


def _base(snapshot: Snapshot, pattern: Pattern) -> DataFrame:
    """Triples of the base that match, through the order that serves the pattern's constants."""
    return (snapshot.base if _order(pattern) == "by_s" else snapshot.by_o).where(_matches(pattern))


def _near(snapshot: Snapshot, given: Sequence[Pattern]) -> F.Column:
    """A filter that reaches the scan: the given triples' predicates and subjects."""
    s, p, _ = zip(*map(_numbers, given), strict=True)
    return F.col("p").isin(*set(p)) & F.col("s").isin(*set(s))


def insert_data(snapshot: Snapshot, given: Sequence[Pattern]) -> Snapshot:
    if not given:
        return snapshot
    added, removed = snapshot._delta()
    new = _frame(snapshot, given).join(snapshot.triples().where(_near(snapshot, given)), _KEY, "left_anti")
    return snapshot.stepped(added.union(new.select(*_KEY)), removed)


def delete_data(snapshot: Snapshot, given: Sequence[Pattern]) -> Snapshot:
    if not given:
        return snapshot
    added, removed = snapshot._delta()
    gone = _frame(snapshot, given)
    return snapshot.stepped(added.join(gone, _KEY, "left_anti"), removed.union(snapshot.base.where(_near(snapshot, given)).join(gone, _KEY, "left_semi").select(*_KEY)).distinct())


def delete_where(snapshot: Snapshot, pattern: Pattern) -> Snapshot:
    added, removed = snapshot._delta()
    return snapshot.stepped(added.where(~_matches(pattern)), removed.union(_base(snapshot, pattern)).distinct())


def rename(snapshot: Snapshot, old: Pattern, new: Pattern) -> Snapshot:
    """Constants of ``new`` replace those of ``old`` in the triples that match; the result stays a set.  Only matching triples move."""
    added, removed = snapshot._delta()
    values = [F.lit(t.value).cast(TRIPLES[c].dataType).alias(c) if isinstance(t, Id) else F.col(c) for c, t in zip("spo", new.terms, strict=True)]
    moved = snapshot.triples(_order(old)).where(_matches(old)).select(*values).distinct()
    there = snapshot.triples(_order(new)).where(_matches(Pattern(*[t if isinstance(t, Id) else Var(c) for c, t in zip("spo", new.terms, strict=True)])) & ~_matches(old))
    return snapshot.stepped(added.where(~_matches(old)).union(moved.join(there, _KEY, "left_anti").select(*_KEY)), removed.union(_base(snapshot, old)).distinct())


def apply(snapshot: Snapshot, statement: Statement) -> Snapshot:
    match statement:
        case Insert(given):
            return insert_data(snapshot, given)
        case DeleteData(given):
            return delete_data(snapshot, given)
        case DeleteWhere(pattern):
            return delete_where(snapshot, pattern)
        case Rename(old, new):
            return rename(snapshot, old, new)
    raise ValueError("not an update")
