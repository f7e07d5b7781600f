"""The engine: a snapshot of triples with its dictionary and statistics, queries and updates on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import statistics
from .operators import update
from .plans import mapping
from .plans.algebra import DeleteData, DeleteWhere, Id, Insert, Pattern, Rename, Select, Term, Text, Var
from .plans.compiler import Compiler
from .plans.parser import parse
from .sources import raw
from .sources.store import TERMS, Store, clean, new_path, predicate_stats

_opened: dict[tuple[str, str], Engine] = {}


class Engine:
    """``triples`` for queries; ``by_o`` the same in the other order, where a store has it."""

    def __init__(self, triples: DataFrame, terms: DataFrame | None = None, predicates: dict[int, str] | None = None, by_o: DataFrame | None = None, stats: dict[int, tuple[int, int, int]] | None = None, snapshot: update.Snapshot | None = None):
        self.snapshot = snapshot or update.Snapshot(triples, by_o if by_o is not None else triples)
        self.triples, self.by_o, self._stats = self.snapshot.triples("by_s"), self.snapshot.triples("by_o"), stats
        self.terms = terms if terms is not None else triples.sparkSession.createDataFrame([], TERMS)
        self.predicates = predicates or {}
        self.spark: SparkSession = triples.sparkSession

    # opening
    @classmethod
    def open(cls, spark: SparkSession, path: str, predicates: dict[int, str] | None = None) -> Engine:
        return cls.of_store(Store(spark, path), predicates)

    @classmethod
    def of_store(cls, store: Store, predicates: dict[int, str] | None = None) -> Engine:
        return cls(store.triples("by_s"), store.terms(), predicates, store.triples("by_o"), store.predicate_stats())

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str) -> Engine:
        """The relational tables of a folder, mapped and stored once in a session."""
        key = spark.sparkContext.applicationId, sf_dir
        if key not in _opened:
            triples, terms = mapping.load(spark, sf_dir)
            _opened[key] = cls.of_store(Store.write(triples, new_path(spark, "graph"), terms), mapping.PREDICATES)
        return _opened[key]

    @classmethod
    def build(cls, spark: SparkSession, facts: str, path: str) -> Engine:
        """A store at ``path`` from raw binary fact files, opened."""
        return cls.of_store(Store.write(raw.read_binary(spark, facts), path))

    @classmethod
    def of(cls, triples: DataFrame) -> Engine:
        return cls(clean(triples))

    # use
    def query(self, text: str, product: bool = False) -> DataFrame:
        """Bindings of a SELECT.  ``product``: patterns that share no variable may be combined whatever their sizes (see ``compiler.MOST``)."""
        q = parse(text)
        if not isinstance(q, Select):
            raise ValueError("an update is not a query")
        return self._compiler(product).select(q)

    def update(self, text: str) -> Engine:
        """The next snapshot; this one stays as it is."""
        statement = parse(text)
        if isinstance(statement, Select):
            raise ValueError("a query is not an update")
        compiler, terms, predicates = self._compiler(), self.terms, self.predicates
        if isinstance(statement, Insert):
            new = _NewTerms(self)
            given = [new.numbered(t) for t in statement.triples]
            terms, predicates = new.terms(), new.predicates
            statement = Insert(given)
        elif isinstance(statement, DeleteData):  # a triple with an unknown constant is not there
            statement = DeleteData([t for p in statement.triples if (t := compiler.known(p)) is not None])
        elif isinstance(statement, DeleteWhere):
            pattern = compiler.known(statement.pattern)
            if pattern is None:
                return self
            statement = DeleteWhere(pattern)
        elif isinstance(statement, Rename):
            old = compiler.known(statement.old)
            if old is None:
                return self
            new = _NewTerms(self)
            statement = Rename(old, new.numbered(statement.new))
            terms, predicates = new.terms(), new.predicates
        return Engine(self.triples, terms, predicates, snapshot=update.apply(self.snapshot, statement))

    def save(self, path: str) -> Engine:
        """Write this snapshot as a new version, base and delta in one, and open it."""
        return Engine.of_store(Store.write(self.triples, path, self.terms), self.predicates)

    # lookups
    def id_of(self, text: str, pid: int | None = None) -> int | None:
        found = self.terms.where(F.col("lex") == text)
        found = found.where(F.col("p") == pid) if pid is not None else found
        row = found.orderBy("id").select("id").first()
        return row[0] if row else None

    def has_entity(self, number: int) -> bool:
        return not self.triples.where((F.col("s") == number) | (F.col("o") == number)).isEmpty()

    def predicate_id(self, name: str) -> int | None:
        return next((p for p, n in self.predicates.items() if n == name), None)

    def stats(self) -> dict[int, tuple[int, int, int]]:
        if self._stats is None:
            self._stats = predicate_stats(self.triples)
        return self._stats

    def counts(self) -> dict[int, int]:
        return {p: x[0] for p, x in self.stats().items()}

    def _resolve(self, term: Term, place: str, pid: int | None) -> int | None:
        assert isinstance(term, Text)
        if place == "p":
            return self.predicate_id(term.value)
        return self.id_of(term.value, pid)

    def _selectivity(self, patterns: list[Pattern]) -> list[tuple[int, dict[str, tuple[int, int]]]]:
        """Triples of each pattern's constants, and the ranges of s and o among them.  A predicate alone is known; what else is asked is counted in one job."""
        counts = self.counts()
        wanted = [tuple(t.value if isinstance(t, Id) else None for t in p.terms) for p in patterns]
        found = {}
        for place, frame in ((0, self.triples), (2, self.by_o)):  # through the order that serves the constants
            harder = sorted({w for w in wanted if w[place] is not None and (place == 0 or w[0] is None)}, key=repr)
            found |= dict(zip(harder, statistics.matching(frame, harder), strict=True))
        return [found[w] if w in found else (counts.get(w[1], 0) if w[1] is not None else sum(counts.values()), {}) for w in wanted]

    def _distinct(self, pattern: Pattern, var: str) -> int:
        """Distinct values of a variable in its position of the pattern's predicate."""
        if pattern.p == Var(var):
            return len(self.stats())
        place = 1 if pattern.s == Var(var) else 2
        if isinstance(pattern.p, Id):
            return self.stats().get(pattern.p.value, (0, 1, 1))[place]
        return sum(x[place] for x in self.stats().values())

    def _compiler(self, product: bool = False) -> Compiler:
        return Compiler(lambda order: self.by_o if order == "by_o" else self.triples, self._resolve, self._selectivity, self._distinct, product)


class _NewTerms:
    """Numbers for the texts of an update: those of the dictionary, and new ones beyond it."""

    def __init__(self, engine: Engine):
        self.engine, self.predicates, self.fresh = engine, dict(engine.predicates), {}
        self.next: int | None = None

    def numbered(self, pattern: Pattern) -> Pattern:
        pred = self._predicate(pattern.p)
        pid = pred.value if isinstance(pred, Id) else None
        return Pattern(self._node(pattern.s, pid), pred, self._node(pattern.o, pid))

    def _predicate(self, term: Term) -> Term:
        if not isinstance(term, Text):
            return term
        known = next((p for p, n in self.predicates.items() if n == term.value), None)
        if known is None:
            known = max([0, *self.predicates, *self.engine.stats()]) + 1
            self.predicates[known] = term.value
        return Id(known)

    def _node(self, term: Term, pid: int | None) -> Term:
        if not isinstance(term, Text):
            return term
        found = self.fresh.get((pid, term.value)) or self.engine.id_of(term.value, pid)
        if found is None:
            if self.next is None:
                top = self.engine.terms.agg(F.max("id")).first()[0]
                self.next = (top if top is not None else statistics.entities(self.engine.triples).agg(F.max("id")).first()[0] or 0) + 1
            found, self.next = self.next, self.next + 1
            self.fresh[pid, term.value] = found
        return Id(found)

    def terms(self) -> DataFrame:
        if not self.fresh:
            return self.engine.terms
        rows = [(n, pid, text) for (pid, text), n in self.fresh.items()]
        return self.engine.terms.unionByName(self.engine.spark.createDataFrame(rows, TERMS))
