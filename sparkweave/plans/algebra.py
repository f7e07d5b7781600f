"""Typed query algebra."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Id:
    """A term given by its number."""

    value: int


@dataclass(frozen=True)
class Text:
    """A term given by its text: an IRI or a literal."""

    value: str
    iri: bool = False


Term = Var | Id | Text


@dataclass(frozen=True)
class Pattern:
    s: Term
    p: Term
    o: Term

    @property
    def terms(self) -> tuple[Term, Term, Term]:
        return self.s, self.p, self.o

    @property
    def variables(self) -> frozenset[str]:
        return frozenset(t.name for t in self.terms if isinstance(t, Var))


@dataclass(frozen=True)
class Compare:
    """?v = x, ?v != x; x is a term."""

    var: Var
    other: Term
    equal: bool = True


@dataclass(frozen=True)
class Among:
    var: Var
    values: tuple[Term, ...]


@dataclass(frozen=True)
class Reaches:
    """Nodes from which ``target`` is reached along ``via``; the target itself is one of them."""

    var: Var
    target: Term
    via: Term


Filter = Compare | Among | Reaches


@dataclass
class Group:
    patterns: list[Pattern] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)
    unions: list[list[Group]] = field(default_factory=list)
    optionals: list[Group] = field(default_factory=list)

    def variables(self) -> set[str]:
        """Named variables anywhere in the group; blank nodes have names that begin with a blank."""
        found = {v for p in self.patterns for v in p.variables}
        for g in (*self.optionals, *(g for u in self.unions for g in u)):
            found |= g.variables()
        return found


@dataclass
class Select:
    projection: list[str] | None  # None: all named variables, by name
    where: Group
    modifier: str = ""  # distinct, reduced, count, duplicates
    limit: int | None = None

    def columns(self) -> list[str]:
        return self.projection if self.projection is not None else sorted(v for v in self.where.variables() if v[0] != " ")


@dataclass
class Insert:
    triples: list[Pattern]


@dataclass
class DeleteData:
    triples: list[Pattern]


@dataclass
class DeleteWhere:
    pattern: Pattern


@dataclass
class Rename:
    old: Pattern
    new: Pattern


Statement = Select | Insert | DeleteData | DeleteWhere | Rename
