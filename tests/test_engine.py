import io
import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkweave import cli
from sparkweave.engine import Engine
from sparkweave.functions import dictionary, statistics
from sparkweave.plans import compiler
from sparkweave.plans.algebra import Id
from sparkweave.plans.parser import parse
from sparkweave.sources import raw, store
from sparkweave.sources.store import TRIPLES, Store
from sparkweave.sources.turtle import RDF
from sparkweave.sources.turtle import parse as turtle

FACTS = [(1, 7, 2), (2, 7, 3), (3, 7, 1), (4, 7, 1), (1, 6, 50), (2, 6, 50), (3, 6, 51), (5, 7, 5), (1, 7, 2)]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine.of(spark.createDataFrame(FACTS, TRIPLES).cache())


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("select ?x where { ?x 6 50 . }", [(1,), (2,)]),
        ("select ?x where { ?x 7 ?y . }", [(1,), (2,), (3,), (4,), (5,)]),
        ("select ?y where { ?x 7 ?y . }", [(1,), (1,), (2,), (3,), (5,)]),
        ("select distinct ?y where { ?x 7 ?y . }", [(1,), (2,), (3,), (5,)]),
        ("select reduced ?y where { ?x 7 ?y . }", [(1,), (2,), (3,), (5,)]),
        ("select count ?y where { ?x 7 ?y . }", [(1, 2), (2, 1), (3, 1), (5, 1)]),
        ("select duplicates ?y where { ?x 7 ?y . }", [(1,), (1,)]),
        ("select ?x ?p where { ?x ?p 50 . }", [(1, 6), (2, 6)]),
        ("select ?x where { ?x 7 ?x . }", [(5,)]),
        ("select ?x ?y ?z where { ?x 7 ?y . ?y 7 ?z . ?z 7 ?x . }", [(1, 2, 3), (2, 3, 1), (3, 1, 2), (5, 5, 5)]),
        ("select ?x ?a where { ?x 7 ?y . ?y 6 ?a . }", [(1, 50), (2, 51), (3, 50), (4, 50)]),
        ("select ?x where { ?x 6 50 . 4 7 1 . }", [(1,), (2,)]),
        ("select ?x where { ?x 6 50 . 4 7 3 . }", []),
        ("select ?x where { ?x 7 ?y . filter(?x != 4) }", [(1,), (2,), (3,), (5,)]),
        ("select ?x where { ?x 7 ?y . filter(?x in 4,5) }", [(4,), (5,)]),
        ("select ?x where { ?x 7 ?y . filter(?x = ?y) }", [(5,)]),
        ("select ?x where { ?x 7 ?y . filter(?x reaches 1 via 7) }", [(1,), (2,), (3,), (4,)]),
        ("select ?x where { ?x 7 ?y . filter(?z = 1) }", []),
        ("select ?x ?y where { ?x 7 ?y . } limit 2", [(1, 2), (2, 3)]),
        ("select ?x ?a where { ?x 7 ?y . optional { ?x 6 ?a . } }", [(1, 50), (2, 50), (3, 51), (4, None), (5, None)]),
        ("select ?x where { { ?x 6 50 . } union { ?x 6 51 . } }", [(1,), (2,), (3,)]),
        ("select ?a ?b where { ?a 6 51 . ?b 6 50 . }", [(3, 1), (3, 2)]),
    ],
)
def test_hand_checked(engine, text, expected):
    assert rows(engine.query(text)) == Counter(expected)


def test_updates(engine):
    after = lambda t: rows(engine.update(t).query("select ?x ?y where { ?x 7 ?y . }"))
    assert after("delete { 1 7 ?o . }") == Counter([(2, 3), (3, 1), (4, 1), (5, 5)])
    assert after("delete { 1 7 ?o . } insert { 9 7 ?o . }") == Counter([(9, 2), (2, 3), (3, 1), (4, 1), (5, 5)])
    assert after("delete { ?s 7 1 . } insert { ?s 7 2 . }") == Counter([(1, 2), (2, 3), (3, 2), (4, 2), (5, 5)])
    assert after("insert data { 1 7 2 . 8 7 9 . 8 7 9 . }") == Counter([(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (8, 9)])
    assert after("delete data { 1 7 2 . 6 6 6 . }") == Counter([(2, 3), (3, 1), (4, 1), (5, 5)])


def brute(facts, query):
    """Bag of bindings by enumeration."""
    out = []
    names = query.columns()
    for combo in itertools.product(sorted(facts), repeat=len(query.where.patterns)):
        bound, ok = {}, True
        for fact, pattern in zip(combo, query.where.patterns, strict=True):
            for value, term in zip(fact, pattern.terms, strict=True):
                ok = ok and (term.value == value if isinstance(term, Id) else bound.setdefault(term.name, value) == value)
        if ok:
            out.append(tuple(bound[n] for n in names))
    return Counter(out)


def test_random_patterns(spark):
    r = random.Random(3)
    facts = {(r.randint(1, 6), r.randint(1, 3), r.randint(1, 6)) for _ in range(22)}
    engine = Engine.of(spark.createDataFrame(sorted(facts), TRIPLES).coalesce(1).cache())
    for _ in range(12):
        term = lambda: r.choice(["?a", "?b", "?c", str(r.randint(1, 6))])
        patterns = [f"{term()} {r.choice(['1', '2', '3', '?p'])} {term()} ." for _ in range(r.randint(1, 3))]
        text = f"select * where {{ {' '.join(patterns)} }}"
        q = parse(text)
        if q.columns():
            assert rows(engine.query(text)) == brute(facts, q), text


def test_store_roundtrip(spark, engine, tmp_path):
    saved = engine.save(str(tmp_path / "v1"))
    assert rows(saved.triples) == rows(saved.by_o) == Counter(set(FACTS))
    assert saved.counts() == {6: 3, 7: 5} == Store(spark, str(tmp_path / "v1")).predicate_counts()


def test_store_partitions_follow_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "ROWS", 100, raising=False)
    facts = spark.range(3000).selectExpr("id % 1500 as s", "6 + id % 2 as p", "id % 10 as o")
    saved = Store.write(facts, str(tmp_path / "many"))
    for order in ("by_s", "by_o"):
        sizes = [r["count"] for r in saved.triples(order).groupBy(F.input_file_name()).count().collect()]
        assert sum(sizes) == 1500
        assert max(sizes) <= 200, sizes


def test_counts_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(store, "ROWS", 100, raising=False)
    facts = [(i, 6 + i % 2, 5 if i % 3 else i) for i in range(1, 2001)] + [(7, 8, i) for i in range(1, 301)]
    triples = spark.createDataFrame(facts, TRIPLES)
    for by in ("s", "o", "sp", "op", "so", "spo"):
        found = statistics.counts(triples, *by)
        assert rows(found) == Counter({(*k, n): 1 for k, n in Counter(tuple(f["spo".index(c)] for c in by) for f in facts).items()})
        assert found.rdd.getNumPartitions() == 23, by
    found = statistics.entities(triples)
    assert rows(found) == Counter({x for s, _, o in facts for x in ((s,), (o,))})
    assert found.rdd.getNumPartitions() == 46
    assert rows(statistics.counts(triples)) == Counter([(2300,)])


def test_present_asks_for_its_ids_alone(spark, engine):
    found = statistics.present(engine.triples, engine.by_o, (1, 50, 99))
    assert rows(found) == Counter([(1,), (50,)])


def test_raw_facts_do_not_pass_through_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "ROWS", 500, raising=False)
    monkeypatch.setattr("pyspark.sql.DataFrame.toLocalIterator", None)
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toLocalIterator", None)
    facts = spark.range(0, 5000, 1, 3).selectExpr("(id * 2654435761) % 4294967296 as s", "cast(id % 300 as int) as p", "4294967295 - id as o")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, 200)
    try:
        raw.write_binary(facts, str(tmp_path / "facts"))
    finally:
        spark.conf.unset(batch)
    assert (tmp_path / "facts").stat().st_size == 60_000
    assert rows(raw.read_binary(spark, str(tmp_path / "facts"))) == rows(facts)
    raw.write_binary(facts.limit(0), str(tmp_path / "none"))
    assert (tmp_path / "none").read_bytes() == b""
    for bad in ("-1", "4294967296", "cast(null as bigint)"):
        with pytest.raises(Exception, match="32 bits"):
            raw.write_binary(spark.range(3).selectExpr(f"{bad} as s", "1 as p", "id as o"), str(tmp_path / "bad"))


def test_scan_is_pruned(spark, engine, tmp_path):
    saved = engine.save(str(tmp_path / "v2"))
    plan = saved.query("select ?x where { ?x 6 50 . }")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and "EqualTo(o,50)" in plan and "/by_o" in plan


def test_sources(spark, tmp_path):
    facts = spark.createDataFrame([(1, 6, 6126), (4_000_000_000, 2, 3)], TRIPLES)
    raw.write_binary(facts, str(tmp_path / "facts"))
    assert rows(raw.read_binary(spark, str(tmp_path / "facts"))) == rows(facts)
    (tmp_path / "more").write_bytes((tmp_path / "facts").read_bytes() + b"tail")
    assert rows(raw.read_binary(spark, str(tmp_path / "more"))) == rows(facts)
    raw.write_id_text(facts, str(tmp_path / "text"))
    assert rows(raw.read_id_text(spark, str(tmp_path / "text"))) == rows(facts)
    (tmp_path / "t.tsv").write_text("a\tknows\tb\r\nx\t\ty\tz\nbad\tline\n")
    assert rows(raw.read_tsv(spark, str(tmp_path / "t.tsv"))) == Counter([("a", "knows", "b"), ("x", "y", "z")])
    (tmp_path / "t.nt").write_text('<a> <b> "c\\"d"@en .\nnonsense\n_:x <b> <c> . # note\n<s> <http://www.w3.org/1999/02/22-rdf-syntax-ns#subject> <o> .\n')
    assert rows(raw.drop_reified(raw.read_ntriples(spark, str(tmp_path / "t.nt")))) == Counter([("a", "b", 'c"d'), ("_:x", "b", "c")])


def test_turtle():
    text = '@prefix e: <http://e/> . e:a e:p "x"@en , [ e:q 5 ] ; a e:T .\nbroken ~ line .\n_:n e:l ( 1 "t\\u00e9" ) . <z> e:s """l"o\nng"""^^e:k .'
    assert list(turtle(text, "f")) == [
        ("http://e/a", "http://e/p", "x"), ("_:fg1", "http://e/q", "5"), ("http://e/a", "http://e/p", "_:fg1"), ("http://e/a", f"{RDF}type", "http://e/T"),
        ("_:fg2", f"{RDF}first", "1"), ("_:fg2", f"{RDF}rest", "_:fg3"), ("_:fg3", f"{RDF}first", "té"), ("_:fg3", f"{RDF}rest", f"{RDF}nil"), ("_:fn", "http://e/l", "_:fg2"),
        ("z", "http://e/s", 'l"o\nng'),
    ]


def test_dictionary(spark):
    known = dictionary.build(spark.createDataFrame([(x,) for x in ["b", "a", "c", "a", None]], "lex string"))
    assert rows(known) == Counter([("a", 1), ("b", 2), ("c", 3)])
    assert rows(dictionary.extend(known, spark.createDataFrame([("a",), ("0",)], "lex string"))) == Counter([("a", 1), ("b", 2), ("c", 3), ("0", 4)])


def test_statistics(engine):
    assert statistics.matching(engine.triples, [(1, None, None), (None, 7, 1), (9, 9, 9)]) == [(2, {"s": (1, 1), "o": (2, 50)}), (2, {"s": (3, 4), "o": (1, 1)}), (0, {})]
    assert rows(statistics.counts(engine.triples, "p")) == Counter([(6, 3), (7, 5)])
    assert engine.has_entity(50) and not engine.has_entity(7)


def test_unbound_variables_agree_with_any(spark):
    engine = Engine.of(spark.createDataFrame([(1, 7, 2), (3, 7, 4), (1, 6, 9), (5, 6, 2), (8, 5, 9), (3, 4, 1), (2, 4, 4)], TRIPLES))
    assert rows(engine.query("select ?x ?y ?z where { ?x 7 ?y . { ?x 6 ?z . } union { ?z 6 ?y . } }")) == Counter([(1, 2, 9), (1, 2, 5)])
    assert rows(engine.query("select ?x ?z ?w where { ?x 7 ?y . { ?x 6 ?z . } union { ?x 7 ?y . } { ?w 5 ?z . } }")) == Counter([(1, 9, 8), (1, 9, 8), (3, 9, 8)])
    assert rows(engine.query("select ?x ?z where { ?x 7 ?y . optional { ?x 6 ?z . } optional { ?z 4 ?y . } }")) == Counter([(1, 9), (3, 2)])
    assert rows(engine.query("select ?x where { optional { ?x 6 9 . } }")) == Counter([(1,)])
    assert rows(engine.query("select ?x where { optional { ?x 6 99 . } }")) == Counter([(None,)])


def test_products_are_guarded(engine, monkeypatch):
    monkeypatch.setattr(compiler, "MOST", 3)
    with pytest.raises(ValueError, match="product"):
        engine.query("select ?a ?b where { ?a 6 51 . ?b 7 ?c . }")
    assert engine.query("select ?a ?b where { ?a 6 51 . ?b 7 ?c . }", product=True).count() == 5


def test_new_terms_and_names(engine):
    new = engine.update('insert data { "x y" <knows> 5 . "x y" <knows> "z" . }')
    assert rows(new.query("select ?a where { ?a <knows> 5 . }")) == rows(new.query('select ?a where { ?a <knows> "z" . }')) == Counter([(52,)])
    assert new.id_of("z") == 53 and new.update('delete { "x y" <knows> ?o . }').triples.count() == 8
    assert engine.update('delete data { "nosuch" 7 2 . 1 7 2 . }').triples.count() == 7 and engine.update('delete { "nosuch" 7 ?o . }') is engine


def test_random_updates(spark):
    r = random.Random(5)
    facts = {(r.randint(1, 5), r.randint(1, 3), r.randint(1, 5)) for _ in range(20)}
    engine = Engine.of(spark.createDataFrame(sorted(facts), TRIPLES))
    n = lambda k=5: r.randint(1, k)
    for step in range(14):
        s, p, o, t = n(), n(3), n(), n()
        if (kind := step % 5) == 0:
            text, facts = f"insert data {{ {s} {p} {o} . {t} {p} {o} . }}", facts | {(s, p, o), (t, p, o)}
        elif kind == 1:
            text, facts = f"delete {{ ?s {p} {o} . }} insert {{ ?s {p} {t} . }}", {(a, b, t if (b, c) == (p, o) else c) for a, b, c in facts}
        elif kind == 2:
            text, facts = f"delete data {{ {s} {p} {o} . {t} {p} {o} . }}", facts - {(s, p, o), (t, p, o)}
        elif kind == 3:
            text, facts = f"delete {{ {s} {p} ?o . }} insert {{ {t} {p} ?o . }}", {(t if (a, b) == (s, p) else a, b, c) for a, b, c in facts}
        else:
            text, facts = f"delete {{ {s} {p} ?o . }}", {f for f in facts if f[:2] != (s, p)}
        engine = engine.update(text)
        assert rows(engine.triples) == rows(engine.by_o) == Counter(facts), text


def test_constants_bound_other_scans(spark, engine, tmp_path):
    saved = engine.save(str(tmp_path / "v3"))
    plan = saved.query("select ?x ?y where { ?x 6 51 . ?x 7 ?y . }")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(s,3)" in plan and "LessThanOrEqual(s,3)" in plan


def test_build_and_shell(spark, tmp_path, monkeypatch, capsys):
    raw.write_binary(spark.createDataFrame([(1, 6, 61), (1, 6, 61), (2, 6, 3)], TRIPLES), str(tmp_path / "facts"))
    assert rows(Engine.build(spark, str(tmp_path / "facts"), str(tmp_path / "store")).triples) == Counter([(1, 6, 61), (2, 6, 3)])
    (tmp_path / "q").write_text("select ?x where { ?x 6 61 . }")
    monkeypatch.setattr("sys.stdin", io.StringIO(f"dp\nsource {tmp_path}/q\n{tmp_path}/none\nexit\n"))
    cli.main(str(tmp_path / "store"))
    said = capsys.readouterr().out
    assert "6  2" in said and "|1  |" in said and "No such file" in said


def test_escapes(spark, tmp_path):
    (tmp_path / "e.nt").write_text('<a> <b> "t\\u00e9 \\"q\\" \\\\ \\t \\U0000263A \\\'" .\n')
    assert raw.read_ntriples(spark, str(tmp_path / "e.nt")).first().o == 't\u00e9 "q" \\ \t \u263a \''
    (tmp_path / "w.nt").write_text('<a> <b> "\\U0001F600 \\\\U0001F600 \\U0010FFFF\\U0000263a" .\n<a> <c> "\\U00110000" .\n')
    wide = {r.p: r.o for r in raw.read_ntriples(spark, str(tmp_path / "w.nt")).collect()}
    assert wide == {"b": "\U0001f600 \\U0001F600 \U0010ffff☺", "c": "\\U00110000"}
