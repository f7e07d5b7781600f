"""Parser of the query language: a subset of SPARQL 1.1 with numbered terms and a few forms of its own.

    PREFIX p: <iri>
    SELECT [DISTINCT | REDUCED | COUNT | DUPLICATES] ?a ?b | * WHERE { patterns, groups, UNION, OPTIONAL, FILTER } [LIMIT n]
    INSERT DATA { triples }     DELETE DATA { triples }     DELETE { pattern }     DELETE { pattern } INSERT { pattern }
    FILTER ( ?v = x | ?v != x | ?v IN a, b | ?v REACHES x VIA p )
"""

from __future__ import annotations

import re

from .algebra import Among, Compare, DeleteData, DeleteWhere, Filter, Group, Id, Insert, Pattern, Reaches, Rename, Select, Statement, Term, Text, Var


class ParseError(ValueError):
    pass


_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
      | (?P<iri><[^<>\s]*>)
      | (?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')
      | (?P<var>[?$][0-9A-Za-z_]+)
      | (?P<blank>_:[0-9A-Za-z_]+)
      | (?P<name>[0-9A-Za-z_]+(?:[.-]+[0-9A-Za-z_]+)*)
      | (?P<punct>!=|\[\s*\]|[:;,.*{}()=\[\]])""",
    re.X,
)
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at : at + 20]!r} at {at}")
        at = m.end()
        if m.lastgroup != "skip":
            out.append((m.lastgroup, "[]" if m[0].startswith("[") and m[0].endswith("]") else m[0]))
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.prefixes, self.blanks = tokens(text), 0, {}, 0

    # tokens
    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def take(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def word(self, *names: str) -> bool:
        """Take the next token if it is one of these keywords."""
        if self.peek()[0] == "name" and self.peek()[1].lower() in names:
            self.at += 1
            return True
        return False

    def sign(self, sign: str) -> bool:
        if self.peek() == ("punct", sign):
            self.at += 1
            return True
        return False

    def need(self, sign: str) -> None:
        if not self.sign(sign):
            raise ParseError(f"expected {sign!r}, found {self.peek()[1]!r}")

    # statements
    def statement(self) -> Statement:
        while self.word("prefix"):
            name = self.take()[1] if self.peek()[0] == "name" else ""
            self.need(":")
            kind, iri = self.take()
            if kind != "iri":
                raise ParseError("expected an IRI after a prefix")
            if name in self.prefixes:
                raise ParseError(f"prefix {name!r} is there already")
            self.prefixes[name] = iri[1:-1]
        if self.word("select"):
            out: Statement = self.select()
        elif self.word("insert"):
            if not self.word("data"):
                raise ParseError("expected DATA after INSERT")
            out = Insert(self.data())
        elif self.word("delete"):
            if self.word("data"):
                out = DeleteData(self.data())
            else:
                old = self.template()
                out = Rename(old, self.template()) if self.word("insert") else DeleteWhere(old)
        else:
            raise ParseError(f"expected SELECT, INSERT or DELETE, found {self.peek()[1]!r}")
        if self.peek()[0] != "end":
            raise ParseError(f"unexpected {self.peek()[1]!r} after the statement")
        return out

    def select(self) -> Select:
        modifier = next((m for m in ("distinct", "reduced", "count", "duplicates") if self.word(m)), "")
        names: list[str] | None = []
        while True:
            if self.sign("*"):
                names = None
            elif self.peek()[0] == "var":
                name = self.take()[1][1:]
                if names is not None:
                    names.append(name)
            else:
                break
        if names == []:
            raise ParseError("nothing is selected")
        if self.word("from"):
            raise ParseError("FROM is not implemented")
        if not self.word("where"):
            raise ParseError("expected WHERE")
        where, limit = self.group(), None
        if self.word("limit"):
            kind, n = self.take()
            if kind != "name" or not n.isdigit() or int(n) < 1:
                raise ParseError("LIMIT needs a positive number")
            limit = int(n)
        return Select(names, where, modifier, limit)

    def data(self) -> list[Pattern]:
        group = self.group()
        if group.filters or group.unions or group.optionals or any(p.variables for p in group.patterns):
            raise ParseError("data holds triples of constants only")
        return group.patterns

    def template(self) -> Pattern:
        patterns = self.group().patterns
        if not patterns or isinstance(patterns[0].p, Var):
            raise ParseError("a pattern with a constant predicate is needed")
        return patterns[0]

    # groups
    def group(self) -> Group:
        self.need("{")
        out = Group()
        while not self.sign("}"):
            if self.sign("."):
                continue
            if self.peek() == ("punct", "{"):
                branches = [self.group()]
                while self.word("union"):
                    branches.append(self.group())
                if len(branches) == 1:
                    inner = branches[0]
                    out.patterns += inner.patterns
                    out.filters += inner.filters
                    out.unions += inner.unions
                    out.optionals += inner.optionals
                else:
                    out.unions.append(branches)
            elif self.word("optional"):
                out.optionals.append(self.group())
            elif self.word("filter"):
                out.filters.append(self.filter())
            elif self.peek()[0] == "end":
                raise ParseError("a group is not closed")
            else:
                self.triples(out, {})
        return out

    def triples(self, out: Group, local: dict[str, Var]) -> None:
        s = self.term(out, local)
        self.properties(out, local, s)

    def properties(self, out: Group, local: dict[str, Var], s: Term) -> None:
        while True:
            p = self.term(out, local)
            while True:
                out.patterns.append(Pattern(s, p, self.term(out, local)))
                if not self.sign(","):
                    break
            if not self.sign(";"):
                return

    def fresh(self) -> Var:
        self.blanks += 1
        return Var(f" b{self.blanks}")

    def term(self, out: Group | None = None, local: dict[str, Var] | None = None) -> Term:
        kind, text = self.take()
        if kind == "var":
            return Var(text[1:])
        if kind == "iri":
            return Text(text[1:-1], iri=True)
        if kind == "string":
            return Text(re.sub(r"\\(.)", lambda m: _ESCAPE.get(m[1], m[1]), text[1:-1]))
        if kind == "name":
            if self.peek() == ("punct", ":") and text in self.prefixes:
                self.take()
                return Text(self.prefixes[text] + self.take()[1], iri=True)
            return Id(int(text)) if text.isdigit() else Text(text)
        if kind == "punct" and text == ":":
            name = self.take()[1]
            return Text(self.prefixes[""] + name, iri=True) if "" in self.prefixes else Id(int(name)) if name.isdigit() else Text(name)
        if out is not None and local is not None:
            if kind == "blank":
                return local.setdefault(text, self.fresh())
            if text == "[]":
                return self.fresh()
            if text == "[":
                inner = self.fresh()
                self.properties(out, local, inner)
                self.need("]")
                return inner
        raise ParseError(f"not a term: {text!r}")

    def filter(self) -> Filter:
        self.need("(")
        var = self.term()
        if not isinstance(var, Var):
            raise ParseError("a filter begins with a variable")
        if self.sign("="):
            out: Filter = Compare(var, self.term())
        elif self.sign("!="):
            out = Compare(var, self.term(), equal=False)
        elif self.word("in"):
            values = [self.term()]
            while self.sign(","):
                values.append(self.term())
            out = Among(var, tuple(values))
        elif self.word("reaches"):
            target = self.term()
            if not self.word("via"):
                raise ParseError("expected VIA")
            out = Reaches(var, target, self.term())
        else:
            raise ParseError(f"unknown filter near {self.peek()[1]!r}")
        self.need(")")
        return out


def parse(text: str) -> Statement:
    return _Parser(text).statement()
