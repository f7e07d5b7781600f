"""A small Turtle parser: prefixes, ``a``, ``;`` and ``,`` lists, blank nodes, collections, literals with escapes."""

from __future__ import annotations

import re
from collections.abc import Iterator

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"

_TOKEN = re.compile(
    r'''(?P<skip>\s+|\#[^\n]*)
      | (?P<iri><[^<>"{}|^`\s]*>)
      | (?P<long>"""(?:[^"\\]|\\.|"(?!""))*""")
      | (?P<string>"(?:[^"\\\n]|\\.)*")
      | (?P<at>@[A-Za-z][A-Za-z0-9-]*)
      | (?P<blank>_:[A-Za-z0-9_][\w.-]*)
      | (?P<number>[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)(?:[eE][+-]?[0-9]+)?(?![\w:]))
      | (?P<name>[^\W\d_][\w.-]*(?<!\.):[\w.-]*(?<!\.)|:[\w.-]*(?<!\.)|[^\W\d_][\w-]*:?)
      | (?P<type>\^\^)
      | (?P<punct>[.;,\[\]()])''',
    re.X,
)
_SIMPLE = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


class TurtleError(ValueError):
    pass


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        return chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _SIMPLE.get(m[3], m[3])

    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", one, text, flags=re.S)


class _Reader:
    def __init__(self, text: str, scope: str):
        self.text, self.at, self.scope = text, 0, scope
        self.prefixes: dict[str, str] = {}
        self.made = 0
        self.out: list[tuple[str, str, str]] = []

    def peek(self) -> tuple[str, str]:
        while True:
            m = _TOKEN.match(self.text, self.at)
            if not m:
                if self.at >= len(self.text):
                    return "end", ""
                raise TurtleError(f"unexpected {self.text[self.at : self.at + 10]!r}")
            if m.lastgroup != "skip":
                self.next = m.end()
                return m.lastgroup or "", m[0]
            self.at = m.end()

    def take(self) -> tuple[str, str]:
        token = self.peek()
        if token[0] != "end":
            self.at = self.next
        return token

    def sign(self, sign: str) -> bool:
        if self.peek() == ("punct", sign):
            self.take()
            return True
        return False

    def fresh(self) -> str:
        self.made += 1
        return f"_:{self.scope}g{self.made}"

    def term(self) -> str:
        kind, text = self.take()
        match kind:
            case "iri":
                return unescape(text[1:-1])
            case "blank":
                return f"_:{self.scope}{text[2:]}"
            case "number":
                return text
            case "string" | "long":
                value = unescape(text[3:-3] if kind == "long" else text[1:-1])
                if self.peek()[0] == "at":
                    self.take()
                elif self.peek()[0] == "type":
                    self.take()
                    self.term()
                return value
            case "name":
                if text in ("true", "false"):
                    return text
                prefix, colon, local = text.partition(":")
                if not colon or prefix not in self.prefixes:
                    raise TurtleError(f"unknown name {text!r}")
                return self.prefixes[prefix] + local
        if text == "[":
            node = self.fresh()
            if not self.sign("]"):
                self.properties(node)
                self.need("]")
            return node
        if text == "(":
            items = []
            while not self.sign(")"):
                items.append(self.term())
            nodes = [self.fresh() for _ in items]
            for i, item in enumerate(items):
                self.out.append((nodes[i], f"{RDF}first", item))
                self.out.append((nodes[i], f"{RDF}rest", nodes[i + 1] if i + 1 < len(items) else f"{RDF}nil"))
            return nodes[0] if nodes else f"{RDF}nil"
        raise TurtleError(f"not a term: {text!r}")

    def need(self, sign: str) -> None:
        if not self.sign(sign):
            raise TurtleError(f"expected {sign!r}")

    def properties(self, s: str) -> None:
        while True:
            if self.peek() == ("name", "a"):
                self.take()
                p = f"{RDF}type"
            else:
                p = self.term()
            while True:
                self.out.append((s, p, self.term()))
                if not self.sign(","):
                    break
            if not self.sign(";"):
                return
            while self.sign(";"):
                pass
            if self.peek() in (("punct", "."), ("punct", "]"), ("end", "")):
                return

    def statement(self) -> None:
        kind, text = self.peek()
        if kind == "at" and text in ("@prefix", "@base"):
            self.take()
            if text == "@prefix":
                name = self.take()[1]
                self.prefixes[name.rstrip(":")] = unescape(self.take()[1][1:-1])
            else:
                self.take()
            self.need(".")
            return
        alone = kind == "punct" and text == "["
        s = self.term()
        if not (alone and self.peek() == ("punct", ".")):
            self.properties(s)
        self.need(".")


def parse(text: str, scope: str = "") -> Iterator[tuple[str, str, str]]:
    """Triples of a Turtle text; blank nodes get ``scope`` in their names, so files do not mix."""
    r = _Reader(text, scope)
    while True:
        try:
            if r.peek()[0] == "end":
                return
            r.out = []
            r.statement()
            yield from r.out
        except TurtleError:
            end = text.find("\n", r.at)
            if end < 0:
                return
            r.at = end + 1
