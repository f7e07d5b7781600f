"""Algebra to DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import join, sets
from ..operators.reach import reaching
from ..operators.scan import order_for, scan
from . import planner
from .algebra import Among, Compare, Filter, Group, Id, Pattern, Reaches, Select, Term, Text, Var


#: rows that a product of patterns without a common variable may have when none was asked for
MOST = 1_000_000_000


class Unknown(Exception):
    """A constant that the dictionary lacks: its group has no answers."""


class Compiler:
    def __init__(self, layout: Callable[[str], DataFrame], resolve: Callable[[Term, str, int | None], int | None], count: Callable[[list[Pattern]], list[tuple[int, dict[str, tuple[int, int]]]]], distinct: Callable[[Pattern, str], int] | None = None, product: bool = False):
        self.layout, self.resolve, self.count, self.distinct, self.product = layout, resolve, count, distinct, product

    # constants
    def number(self, term: Term, place: str, pid: int | None = None) -> Term:
        if not isinstance(term, Text):
            return term
        value = self.resolve(term, place, pid)
        if value is None:
            raise Unknown(term.value)
        return Id(value)

    def numbered(self, p: Pattern) -> Pattern:
        pred = self.number(p.p, "p")
        pid = pred.value if isinstance(pred, Id) else None
        return Pattern(self.number(p.s, "s", pid), pred, self.number(p.o, "o", pid))

    def known(self, p: Pattern) -> Pattern | None:
        """The pattern in numbers, or None when the dictionary lacks a constant of it."""
        try:
            return self.numbered(p)
        except Unknown:
            return None

    # groups
    def group(self, g: Group, outer: frozenset[str] = frozenset()) -> DataFrame:
        return self.bindings(g, outer)[0]

    def bindings(self, g: Group, outer: frozenset[str] = frozenset()) -> tuple[DataFrame, set[str]]:
        """Bindings of a group, and the variables that some of them may leave unbound; an empty frame with its variables when a
        constant or filter variable rules answers out."""
        inner = g.variables()
        if any(name not in inner | outer for f in g.filters for name in _variables(f)):
            return self.nothing(inner), set()
        try:
            out, maybe = self.patterns([self.numbered(p) for p in g.patterns]), set()
            for branches in g.unions:
                both, unsure = self.bindings(branches[0])
                for b in branches[1:]:
                    more, also = self.bindings(b)
                    unsure = unsure | also | (set(both.columns) ^ set(more.columns))
                    both = sets.union_all(both, more)
                out, maybe = (both, unsure) if out is None else join.compatible(out, both, maybe, unsure)
            for o in g.optionals:
                found, unsure = self.bindings(o, frozenset(out.columns if out is not None else ()))
                if out is None:  # nothing before it: one binding without variables
                    out, maybe = found.sparkSession.range(1).select(), set()
                new = set(found.columns) - set(out.columns)
                out, maybe = join.compatible(out, found, maybe, unsure, "left")
                maybe = maybe | new
            if out is None:
                return self.nothing(inner), set()
            for f in g.filters:
                out = self.filter(out, f)
            return out, maybe
        except Unknown:
            return self.nothing(inner), set()

    def nothing(self, names: set[str]) -> DataFrame:
        spark = self.layout("by_s").sparkSession
        return spark.createDataFrame([], T.StructType([T.StructField(n, T.LongType()) for n in sorted(names)]))

    def patterns(self, patterns: list[Pattern]) -> DataFrame | None:
        if not patterns:
            return None
        ordered, bounds, sizes = patterns, {}, {}
        if len(patterns) > 1:
            found = dict(zip(patterns, self.count(patterns), strict=True))
            sizes = {p: n for p, (n, _) in found.items()}
            ordered = planner.order(patterns, sizes.__getitem__, self.distinct)
            for p, (_, ranges) in found.items():  # what constants leave of a variable bounds the scans of the other patterns
                for place, term in zip("spo", p.terms, strict=True):
                    if isinstance(term, Var) and place in ranges:
                        low, high = bounds.get(term.name, ranges[place])
                        bounds[term.name] = max(low, ranges[place][0]), min(high, ranges[place][1])
        gates = [p for p in ordered if not p.variables]
        rest = [p for p in ordered if p.variables]
        out: DataFrame | None = None
        rows, seen = 1, set()
        for p in rest:
            one = scan(self.layout(order_for(p)), p, bounds)
            if out is not None and not p.variables & seen:
                rows *= sizes[p]
                if rows > MOST and not self.product:
                    raise ValueError(f"about {rows} combinations of patterns without a common variable; ask for them with product=True")
            else:
                rows = max(rows, sizes.get(p, 1))
            seen |= p.variables
            out = one if out is None else join.natural(out, one)
        for p in gates:  # triples that only have to be there
            found = scan(self.layout(order_for(p)), p)
            out = found.limit(1) if out is None else join.exists(out, found)
        return out

    def filter(self, df: DataFrame, f: Filter) -> DataFrame:
        v = F.col(f"`{f.var.name}`")
        match f:
            case Compare(_, Var(name), equal):
                same = v == F.col(f"`{name}`")
                return df.where(same if equal else ~same)
            case Compare(_, other, equal):
                value = self.value(other)
                if value is None:
                    return df.where(F.lit(False)) if equal else df
                return df.where(v == value if equal else v != value)
            case Among(_, values):
                known = [x for x in map(self.value, values) if x is not None]
                return df.where(v.isin(known)) if known else df.where(F.lit(False))
            case Reaches(var, target, via):
                to, along = self.value(target), self.number(via, "p")
                if to is None or not isinstance(along, Id):
                    return df.where(F.lit(False))
                nodes = reaching(self.layout("by_o"), to, along.value).withColumnRenamed("node", var.name)
                return join.semi(df, nodes, [var.name])
        raise TypeError(f)

    def value(self, term: Term) -> int | None:
        try:
            found = self.number(term, "o")
        except Unknown:
            return None
        return found.value if isinstance(found, Id) else None

    def select(self, q: Select) -> DataFrame:
        names = q.columns()
        df = self.group(q.where)
        missing = [n for n in names if n not in df.columns]
        if missing:
            raise ValueError(f"selected but not in the patterns: {missing}")
        df = df.select(*[F.col(f"`{n}`") for n in names])
        match q.modifier:
            case "distinct" | "reduced":
                df = df.distinct()
            case "count":
                df = sets.counted(df)
            case "duplicates":
                df = sets.duplicated(df)
        return sets.first_rows(df, q.limit) if q.limit else df


def _variables(f: Filter) -> set[str]:
    return {f.var.name} | ({f.other.name} if isinstance(f, Compare) and isinstance(f.other, Var) else set())
