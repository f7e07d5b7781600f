"""Registered queries on the mapped tables, each with SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import dictionary, statistics
from .operators import join, sets
from .operators.scan import scan
from .plans import mapping
from .plans.algebra import Id, Pattern, Var
from .sources import raw
from .sources.store import new_path

T = mapping.TAG
#: constants of the queries: nation 3, region 1, customer 7, order 5, conversation turn 0 of conversation 3
NATION, REGION, CUSTOMER, ORDER, TURN = 2 * T + 3, T + 1, 3 * T + 7, 6 * T + 5, 11 * T + 300
CUSTOMER2, CONVERSATION = 3 * T + 11, 12 * T + 3

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _b(*names: str) -> str:
    return ", ".join(f"CAST({n.split(' ')[0]} AS BIGINT) AS {n.split(' ')[-1]}" for n in names)


def text_query(name: str, text: str, sql: str, steps: dict[str, str] | None = None, only: tuple[int, ...] = ()) -> None:
    QUERIES[name] = lambda spark, sf, q=text: Engine.from_tables(spark, sf).query(q)
    ORACLE[name] = mapping.oracle(sql, steps, only)


def call(name: str, sql: str) -> Callable[[Callable[[Engine], DataFrame]], None]:
    """Register a function of the engine."""

    def add(f: Callable[[Engine], DataFrame]) -> None:
        QUERIES[name] = lambda spark, sf: f(Engine.from_tables(spark, sf))
        ORACLE[name] = mapping.oracle(sql)

    return add


def _scan(name: str, select: str, pattern: str, where: str, columns: str) -> None:
    names = columns.split()
    text_query(name, f"select {select} where {{ {pattern} . }}", f"SELECT {_b(*names)} FROM triples{' WHERE ' + where if where else ''}")


# scans: every combination of given and returned positions
_scan("scan_s_by_po", "?s", f"?s 2 {NATION}", f"p = 2 AND o = {NATION}", "s")
_scan("scan_o_by_sp", "?o", f"{CUSTOMER} 2 ?o", f"p = 2 AND s = {CUSTOMER}", "o")
_scan("scan_p_by_so", "?p", f"{TURN} ?p {CONVERSATION}", f"s = {TURN} AND o = {CONVERSATION}", "p")
_scan("scan_s_by_p", "?s", "?s 4 ?o", "p = 4", "s")
_scan("scan_o_by_p", "?o", "?s 4 ?o", "p = 4", "o")
_scan("scan_p_by_s", "?p", f"{CUSTOMER} ?p ?o", f"s = {CUSTOMER}", "p")
_scan("scan_p_by_o", "?p", f"?s ?p {NATION}", f"o = {NATION}", "p")
_scan("scan_s_by_o", "?s", f"?s ?p {NATION}", f"o = {NATION}", "s")
_scan("scan_o_by_s", "?o", f"{CUSTOMER} ?p ?o", f"s = {CUSTOMER}", "o")
_scan("scan_s", "?s", "?s ?p ?o", "", "s")
_scan("scan_p", "?p", "?s ?p ?o", "", "p")
_scan("scan_o", "?o", "?s ?p ?o", "", "o")
_scan("scan_sp_by_o", "?s ?p", f"?s ?p {NATION}", f"o = {NATION}", "s p")
_scan("scan_ps_by_o", "?p ?s", f"?s ?p {NATION}", f"o = {NATION}", "p s")
_scan("scan_so_by_p", "?s ?o", "?s 1 ?o", "p = 1", "s o")
_scan("scan_os_by_p", "?o ?s", "?s 1 ?o", "p = 1", "o s")
_scan("scan_po_by_s", "?p ?o", f"{ORDER} ?p ?o", f"s = {ORDER}", "p o")
_scan("scan_op_by_s", "?o ?p", f"{ORDER} ?p ?o", f"s = {ORDER}", "o p")
_scan("scan_so", "?s ?o", "?s ?p ?o", "", "s o")
_scan("scan_os", "?o ?s", "?s ?p ?o", "", "o s")
text_query("scan_const_gate", f"select ?x ?y where {{ {2 * T} 1 ?r . {NATION} 1 {T + 3} . ?x 1 ?y . }}", f"SELECT {_b('t.s x', 't.o y')} FROM triples t, triples g WHERE t.p = 1 AND g.p = 1 AND g.s = {2 * T} AND EXISTS (SELECT 1 FROM triples e WHERE e.s = {NATION} AND e.p = 1 AND e.o = {T + 3})")

# joins
text_query("join_star", f"select ?x ?b where {{ ?x 11 ?b . ?x 12 ?t . }}", "SELECT a.s AS x, a.o AS b FROM triples a JOIN triples c ON a.s = c.s WHERE a.p = 11 AND c.p = 12")
text_query("join_star3", "select ?x ?c ?r ?t where { ?x 4 ?c . ?x 9 ?r . ?x 10 ?t . }", "SELECT a.s AS x, a.o AS c, b.o AS r, d.o AS t FROM triples a JOIN triples b ON a.s = b.s JOIN triples d ON a.s = d.s WHERE a.p = 4 AND b.p = 9 AND d.p = 10")
text_query("join_chain", f"select ?o ?c where {{ ?o 4 ?c . ?c 2 {NATION} . }}", f"SELECT a.s AS o, a.o AS c FROM triples a JOIN triples b ON a.o = b.s WHERE a.p = 4 AND b.p = 2 AND b.o = {NATION}")
_EDGES = {f"p{p}": f"SELECT s, o FROM triples WHERE p = {p}" for p in (1, 2, 3, 4, 5, 7, 8)}
_TREE = {p: _EDGES[p] for p in ("p1", "p2", "p4", "p5", "p8")} | {
    "n": f"SELECT s FROM p1 WHERE o = {REGION}",
    "c": "SELECT p2.s AS c, p2.o AS n FROM p2 JOIN n ON p2.o = n.s",
    "m": "SELECT c.c, c.n FROM c JOIN p8 ON p8.s = c.c",
    "o": "SELECT p4.s AS o, m.c, m.n FROM p4 JOIN m ON p4.o = m.c",
}
text_query("join_tree", f"select ?i ?o ?c ?n where {{ ?i 5 ?o . ?o 4 ?c . ?c 2 ?n . ?n 1 {REGION} . ?c 8 ?m . }}", "SELECT p5.s AS i, o.o, o.c, o.n FROM p5 JOIN o ON p5.o = o.o", _TREE, (1, 2, 4, 5, 8))
_CYCLE = {p: _EDGES[p] for p in ("p2", "p3", "p4", "p5", "p7")} | {
    "c": "SELECT p4.s AS o, p4.o AS c, p2.o AS n FROM p4 JOIN p2 ON p4.o = p2.s",
    "x": "SELECT p7.s AS i, p7.o AS s, p3.o AS n FROM p7 JOIN p3 ON p7.o = p3.s",
    "i": "SELECT p5.s AS i, c.o, c.c, c.n FROM p5 JOIN c ON p5.o = c.o",
}
text_query("join_cycle", "select ?i ?o ?c ?n ?s where { ?i 5 ?o . ?o 4 ?c . ?c 2 ?n . ?i 7 ?s . ?s 3 ?n . }", "SELECT i.i, i.o, i.c, i.n, x.s FROM i JOIN x ON i.i = x.i AND i.n = x.n", _CYCLE, (2, 3, 4, 5, 7))
text_query("join_unknown_pred", f"select ?x ?p ?n where {{ ?x ?p {NATION} . ?y 1 ?n . {NATION} 1 ?n . }}", f"SELECT t.s AS x, CAST(t.p AS BIGINT) AS p, b.o AS n FROM triples t, triples a, triples b WHERE t.o = {NATION} AND b.p = 1 AND b.s = {NATION} AND a.p = 1 AND a.o = b.o")
text_query("join_pred_var", f"select ?x ?p where {{ {CUSTOMER} ?p ?v . ?x ?p ?v . }}", "SELECT t.s AS x, CAST(t.p AS BIGINT) AS p FROM triples t JOIN a ON a.p = t.p AND a.o = t.o", {"a": f"SELECT p, o FROM triples WHERE s = {CUSTOMER}"})
text_query("join_cross", "select ?a ?b where { ?a 1 ?r . ?b 3 ?n . }", "SELECT a.s AS a, b.s AS b FROM triples a, triples b WHERE a.p = 1 AND b.p = 3")
text_query("join_exists", f"select ?x where {{ ?x 2 {NATION} . {NATION} 1 ?any . {TURN} 18 {CONVERSATION} . }}", f"SELECT a.s AS x FROM triples a, triples b WHERE a.p = 2 AND a.o = {NATION} AND b.s = {NATION} AND b.p = 1 AND EXISTS (SELECT 1 FROM triples e WHERE e.s = {TURN} AND e.p = 18 AND e.o = {CONVERSATION})")


def _of(e: Engine, p: int, s: str, o: str) -> DataFrame:
    return e.triples.where(f"p = {p}").selectExpr(f"s as {s}", f"o as {o}")


_SEMI = f"SELECT a.s AS x, a.o AS y FROM triples a WHERE a.p = 4 AND EXISTS (SELECT 1 FROM triples b WHERE b.p = 2 AND b.s = a.o AND b.o = {NATION})"
call("join_semi_reduce", _SEMI)(lambda e: join.reduce_both(_of(e, 4, "x", "y"), _of(e, 2, "y", "n").where(f"n = {NATION}"), ["y"])[0])
call("join_reduce_second", f"SELECT b.s AS y, b.o AS n FROM triples b WHERE b.p = 2 AND b.o = {NATION} AND EXISTS (SELECT 1 FROM triples a WHERE a.p = 4 AND a.o = b.s)")(lambda e: join.reduce_both(_of(e, 4, "x", "y"), _of(e, 2, "y", "n").where(f"n = {NATION}"), ["y"])[1].select("y", "n"))
call("join_semi_two_keys", "SELECT a.s AS x, a.o AS y FROM triples a WHERE a.p = 5 AND EXISTS (SELECT 1 FROM triples b WHERE b.p = 5 AND b.s = a.s AND b.o = a.o AND b.o % 7 = 3)")(lambda e: join.semi(_of(e, 5, "x", "y"), _of(e, 5, "x", "y").where("y % 7 = 3"), ["x", "y"]).select("x", "y"))
_LOOPS = "SELECT DISTINCT s % 7 + 1 AS x, CAST(p AS BIGINT) AS p FROM triples WHERE p IN (1, 2, 3, 4) AND s % 7 = o % 7"
call("scan_repeated_var", _LOOPS)(lambda e: Engine.of(e.triples.where("p in (1, 2, 3, 4)").selectExpr("s % 7 + 1 as s", "p", "o % 7 + 1 as o")).query("select ?x ?p where { ?x ?p ?x . }"))
call("scan_range", f"SELECT s AS x, o AS y FROM triples WHERE p = 2 AND s BETWEEN {3 * T + 10} AND {3 * T + 90}")(lambda e: scan(e.triples, Pattern(Var("x"), Id(2), Var("y")), {"x": (3 * T + 10, 3 * T + 90)}))
call("join_hash_semi", _SEMI)(lambda e: join.semi(_of(e, 4, "x", "y"), _of(e, 2, "y", "n").where(f"n = {NATION}"), ["y"], "shuffle_hash"))
call("join_merge_semi", _SEMI)(lambda e: join.semi(_of(e, 4, "x", "y"), _of(e, 2, "y", "n").where(f"n = {NATION}"), ["y"], "merge"))
call("join_intersect", "SELECT s AS id FROM triples WHERE p = 2 INTERSECT SELECT o FROM triples WHERE p = 4")(lambda e: join.semi(e.triples.where("p = 2").selectExpr("s as id").distinct(), e.triples.where("p = 4").selectExpr("o as id"), ["id"]))

# filters
text_query("filter_eq", f"select ?x ?y where {{ ?x 2 ?y . filter(?y = {NATION}) }}", f"SELECT s AS x, o AS y FROM triples WHERE p = 2 AND o = {NATION}")
text_query("filter_ne", f"select ?x ?y where {{ ?x 2 ?y . filter(?y != {NATION}) }}", f"SELECT s AS x, o AS y FROM triples WHERE p = 2 AND o <> {NATION}")
text_query("filter_in", f"select ?x ?y where {{ ?x 2 ?y . filter(?y in {NATION}, {NATION + 1}, nosuchterm) }}", f"SELECT s AS x, o AS y FROM triples WHERE p = 2 AND o IN ({NATION}, {NATION + 1})")
text_query("filter_var_eq", "select ?i ?o where { ?i 5 ?o . ?o 4 ?c . ?c 2 ?n . ?i 7 ?s . ?s 3 ?m . filter(?n = ?m) }", "SELECT i.i, i.o FROM i JOIN x ON i.i = x.i WHERE i.n = x.n", _CYCLE, (2, 3, 4, 5, 7))
text_query("filter_var_ne", "select ?a ?b where { ?a 1 ?r . ?b 1 ?r . filter(?a != ?b) }", "SELECT a.s AS a, b.s AS b FROM triples a JOIN triples b ON a.o = b.o WHERE a.p = 1 AND b.p = 1 AND a.s <> b.s")
text_query("filter_unbound", "select ?x where { ?x 2 ?y . filter(?z = 1) }", "SELECT s AS x FROM triples WHERE FALSE")
text_query("filter_unknown_const", "select ?x where { ?x 8 \"no such segment\" . }", "SELECT s AS x FROM triples WHERE FALSE")
QUERIES["filter_reaches"] = lambda spark, sf: Engine.from_tables(spark, sf).query(f"select distinct ?x where {{ ?x 18 ?c . filter(?x reaches {TURN} via 20) }}")
ORACLE["filter_reaches"] = mapping.oracle(f"SELECT DISTINCT t.s AS x FROM triples t WHERE t.p = 18 AND t.s IN (WITH RECURSIVE r(n) AS (SELECT CAST({TURN} AS BIGINT) UNION SELECT e.s FROM triples e JOIN r ON e.o = r.n WHERE e.p = 20) SELECT n FROM r)")

# duplicates, limits, projection
text_query("dup_distinct", "select distinct ?y where { ?x 4 ?y . }", "SELECT DISTINCT o AS y FROM triples WHERE p = 4")
text_query("dup_reduced", "select reduced ?y where { ?x 2 ?y . }", "SELECT DISTINCT o AS y FROM triples WHERE p = 2")
text_query("dup_count", "select count ?y where { ?x 2 ?y . }", "SELECT o AS y, COUNT(*) AS count FROM triples WHERE p = 2 GROUP BY o")
text_query("dup_duplicates", "select duplicates ?y where { ?x 14 ?y . }", "SELECT y FROM (SELECT o AS y, COUNT(*) OVER (PARTITION BY o) AS n FROM triples WHERE p = 14) q WHERE n > 1")
text_query("limit_n", "select ?x ?y where { ?x 4 ?y . } limit 25", "SELECT s AS x, o AS y FROM triples WHERE p = 4 ORDER BY s, o LIMIT 25")
text_query("project_star", f"select * where {{ ?o 4 ?c . ?c 2 {NATION} . }}", f"SELECT a.o AS c, a.s AS o FROM triples a JOIN triples b ON a.o = b.s WHERE a.p = 4 AND b.p = 2 AND b.o = {NATION}")
text_query("project_reorder", "select ?y ?x where { ?x 3 ?y . }", "SELECT o AS y, s AS x FROM triples WHERE p = 3")

# groups
text_query("group_union", f"select ?x where {{ {{ ?x 2 {NATION} . }} union {{ ?x 3 {NATION} . }} }}", f"SELECT s AS x FROM triples WHERE p = 2 AND o = {NATION} UNION ALL SELECT s FROM triples WHERE p = 3 AND o = {NATION}")
text_query("group_union_join", f"select ?x ?n where {{ {{ ?x 2 ?n . }} union {{ ?x 3 ?n . }} ?n 1 {REGION} . }}", f"SELECT a.s AS x, a.o AS n FROM triples a JOIN triples b ON a.o = b.s WHERE a.p IN (2, 3) AND b.p = 1 AND b.o = {REGION}")
text_query("group_nested", f"select ?o ?c where {{ {{ ?o 4 ?c . }} {{ ?c 2 {NATION} . }} }}", f"SELECT a.s AS o, a.o AS c FROM triples a JOIN triples b ON a.o = b.s WHERE a.p = 4 AND b.p = 2 AND b.o = {NATION}")
text_query("group_optional", "select ?c ?n ?o where { ?c 2 ?n . optional { ?o 4 ?c . } }", "SELECT a.s AS c, a.o AS n, b.s AS o FROM triples a LEFT JOIN triples b ON b.p = 4 AND b.o = a.s WHERE a.p = 2")
text_query("group_union_part", f"select ?x ?o where {{ ?x 2 {NATION} . {{ ?o 4 ?x . }} union {{ {REGION - 1} 1 ?o . }} }}", f"SELECT a.s AS x, b.s AS o FROM triples a JOIN triples b ON b.p = 4 AND b.o = a.s WHERE a.p = 2 AND a.o = {NATION} UNION ALL SELECT a.s, b.o FROM triples a JOIN triples b ON b.p = 1 AND b.s = {REGION - 1} WHERE a.p = 2 AND a.o = {NATION}")
text_query("group_optional_shared", f"select ?c ?x ?y where {{ ?c 2 {NATION} . optional {{ {CUSTOMER} 8 ?x . ?c 8 ?x . }} optional {{ ?c 8 ?x . ?c 2 ?y . }} }}", "SELECT x.c, coalesce(x.x, e.o) AS x, n.o AS y FROM x JOIN triples e ON e.p = 8 AND e.s = x.c AND (x.x IS NULL OR x.x = e.o) JOIN triples n ON n.p = 2 AND n.s = x.c", {"c": f"SELECT s AS c FROM triples WHERE p = 2 AND o = {NATION}", "x": f"SELECT c.c, t.o AS x FROM c LEFT JOIN (SELECT s, o FROM triples WHERE p = 8 AND o IN (SELECT o FROM triples WHERE p = 8 AND s = {CUSTOMER})) t ON t.s = c.c"}, (2, 8))
text_query("blank_node", f"select ?o where {{ ?o 4 [ 2 {NATION} ; 8 [] ] . }}", f"SELECT a.s AS o FROM triples a JOIN triples b ON a.o = b.s JOIN triples c ON a.o = c.s WHERE a.p = 4 AND b.p = 2 AND b.o = {NATION} AND c.p = 8")
text_query("abbreviated_patterns", f"select ?x ?a where {{ ?x 9 ?a ; 10 ?b ; 4 {CUSTOMER}, {CUSTOMER} . }}", f"SELECT a.s AS x, a.o AS a FROM triples a JOIN triples b ON a.s = b.s JOIN triples c ON a.s = c.s WHERE a.p = 9 AND b.p = 10 AND c.p = 4 AND c.o = {CUSTOMER}")
text_query("prefix_and_text", 'prefix v: <> select ?x where { ?x v:segment "BUILDING" . ?x <custNation> ?n . }', "SELECT a.s AS x FROM triples a JOIN terms t ON a.o = t.id JOIN triples b ON a.s = b.s WHERE a.p = 8 AND t.lex = 'BUILDING' AND b.p = 2")

# statistics
call("stats_p", "SELECT p, COUNT(*) AS n FROM triples GROUP BY p")(lambda e: statistics.counts(e.triples, "p"))
call("stats_s", "SELECT s, COUNT(*) AS n FROM triples GROUP BY s")(lambda e: statistics.counts(e.triples, "s"))
call("stats_o", "SELECT o, COUNT(*) AS n FROM triples GROUP BY o")(lambda e: statistics.counts(e.by_o, "o"))
call("stats_sp", "SELECT s, p, COUNT(*) AS n FROM triples GROUP BY s, p")(lambda e: statistics.counts(e.triples, "s", "p"))
call("stats_op", "SELECT o, p, COUNT(*) AS n FROM triples GROUP BY o, p")(lambda e: statistics.counts(e.by_o, "o", "p"))
call("stats_so", "SELECT s, o, COUNT(*) AS n FROM triples GROUP BY s, o")(lambda e: statistics.counts(e.triples, "s", "o"))
call("stats_total", "SELECT COUNT(*) AS n FROM triples")(lambda e: statistics.counts(e.triples))
call("stats_minmax", "SELECT p, MIN(s) AS min_s, MAX(s) AS max_s, MIN(o) AS min_o, MAX(o) AS max_o FROM triples GROUP BY p")(lambda e: statistics.id_range(e.triples))
call("stats_range", f"SELECT DISTINCT s AS id FROM triples WHERE s BETWEEN {3 * T + 10} AND {3 * T + 90}")(lambda e: statistics.between(e.triples, "s", 3 * T + 10, 3 * T + 90))

# dictionary and lookups
_LEX = "SELECT DISTINCT lex FROM lits"
call("dict_build", f"SELECT lex, DENSE_RANK() OVER (ORDER BY lex) AS id FROM ({_LEX}) q")(lambda e: dictionary.build(e.terms))
call("dict_extend", "SELECT lex, CASE WHEN p = 8 THEN r ELSE m + r END AS id FROM (SELECT lex, p, DENSE_RANK() OVER (PARTITION BY p ORDER BY lex) AS r, (SELECT COUNT(DISTINCT lex) FROM lits WHERE p = 8) AS m FROM (SELECT DISTINCT lex, p FROM lits WHERE p IN (8, 16)) q) z")(lambda e: dictionary.extend(dictionary.build(e.terms.where("p = 8")), e.terms.where("p = 16").select("lex")))
_PREDS = "(SELECT CAST(pid AS VARCHAR) AS lex, pid FROM preds)"


def _texts(e: Engine) -> DataFrame:
    return e.triples.where("p in (1, 2, 3)").selectExpr("cast(s as string) as s", "cast(p as string) as p", "cast(o as string) as o")


@call("dict_encode", "SELECT DENSE_RANK() OVER (ORDER BY x) AS id, x AS lex FROM (SELECT CAST(s AS VARCHAR) AS x FROM triples WHERE p IN (1, 2, 3) UNION SELECT CAST(o AS VARCHAR) FROM triples WHERE p IN (1, 2, 3)) q")
def _(e: Engine) -> DataFrame:
    facts = _texts(e)
    terms = dictionary.build(facts.selectExpr("s as lex").union(facts.selectExpr("o as lex")))
    preds = dictionary.build(facts.selectExpr("p as lex"))
    coded = dictionary.encode(facts, terms, preds)
    back = dictionary.decode(coded, terms, "s", "o")
    return back.selectExpr("s as id", "s_text as lex").union(back.selectExpr("o", "o_text")).distinct()


call("dict_decode", "SELECT t.s AS x, t.o AS v, q.lex AS v_text FROM triples t JOIN terms q ON t.o = q.id WHERE t.p = 8")(lambda e: dictionary.decode(e.query("select ?x ?v where { ?x 8 ?v . }"), e.terms, "v").select("x", "v", "v_text"))
call("term_table", "SELECT id, p, lex FROM terms")(lambda e: e.terms)
call("pred_table", "SELECT pid, name FROM preds ORDER BY pid")(lambda e: e.spark.createDataFrame(sorted(e.predicates.items()), "pid int, name string"))
call("pred_list", "SELECT DISTINCT p FROM triples")(lambda e: statistics.predicates(e.triples))
call("entity_max", "SELECT MAX(id) AS id FROM (SELECT s AS id FROM triples UNION ALL SELECT o FROM triples) q")(lambda e: statistics.entities(e.triples).agg(F.max("id").alias("id")))
call("entity_exists", f"SELECT id FROM (SELECT DISTINCT s AS id FROM triples UNION SELECT o FROM triples) q WHERE id IN ({NATION}, {CUSTOMER}, 5)")(lambda e: statistics.present(e.triples, e.by_o, (NATION, CUSTOMER, 5)))

# sources and sinks: written to the shared folder, read back
_SMALL = "SELECT s % 1000000000 + 1 AS s, p, o % 1000000000 + 1 AS o FROM triples WHERE p IN (1, 2, 3, 4)"


def _small(e: Engine) -> DataFrame:
    return e.triples.where("p in (1, 2, 3, 4)").selectExpr("s % 1000000000 + 1 as s", "p", "o % 1000000000 + 1 as o")


call("load_dedup", "SELECT s, p, o FROM triples WHERE p = 2")(lambda e: Engine.of(e.triples.where("p = 2").union(e.triples.where("p = 2"))).triples)


@call("load_rawfact", _SMALL)
def _(e: Engine) -> DataFrame:
    path = new_path(e.spark, "facts")
    raw.write_binary(_small(e), path)
    return raw.read_binary(e.spark, path)


@call("load_text_ids", _SMALL)
def _(e: Engine) -> DataFrame:
    path = new_path(e.spark, "facts")
    raw.write_id_text(_small(e), path)
    return raw.read_id_text(e.spark, path)


def _written_text(e: Engine, lines: str) -> str:
    path = new_path(e.spark, "facts")
    e.triples.where("p = 2").selectExpr(lines).write.text(path)
    return path


call("dump_text", "SELECT '<' || s || '> <' || p || '> \"' || o || '\" .' AS value FROM triples WHERE p = 2")(lambda e: e.triples.where("p = 2").select(F.format_string('<%d> <%d> "%d" .', "s", "p", "o").alias("value")))
_AS_TEXT = "SELECT CAST(s AS VARCHAR) AS s, {p} AS p, CAST(o AS VARCHAR) AS o FROM triples WHERE p = 2"
call("load_tsv", _AS_TEXT.format(p="CAST(p AS VARCHAR)"))(lambda e: raw.read_tsv(e.spark, _written_text(e, "concat_ws('\\t', s, '', p, o, '\\r') as value")))
call("load_ntriples", _AS_TEXT.format(p="'http://e/p2'"))(lambda e: raw.read_ntriples(e.spark, _written_text(e, "concat('<', s, '> <http://e/p2> \"', o, '\"@en .') as value")))
call("load_turtle", _AS_TEXT.format(p="'http://e/p2'"))(lambda e: raw.read_turtle(e.spark, _written_text(e, "concat('@prefix e: <http://e/> . <', s, '> e:p2 \"', o, '\"^^e:int .') as value")))
call("load_reified", _AS_TEXT.format(p="'http://e/p2'"))(lambda e: raw.drop_reified(raw.read_ntriples(e.spark, _written_text(e, "concat('<', s, '> <http://e/p2> \"', o, '\" .\\n<', s, '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#subject> <', o, '> .') as value"))))
call("store_roundtrip", "SELECT s, p, o FROM triples WHERE p IN (1, 3, 20)")(lambda e: Engine(e.triples.where("p in (1, 3, 20)")).save(new_path(e.spark, "graph")).by_o)

# set operations and orders
call("set_union", "SELECT s AS id FROM triples WHERE p = 2 UNION SELECT o FROM triples WHERE p = 4")(lambda e: sets.union_set(e.triples.where("p = 2").selectExpr("s as id"), e.triples.where("p = 4").selectExpr("o as id")))
call("set_append", "SELECT s AS id FROM triples WHERE p = 2 UNION ALL SELECT o FROM triples WHERE p = 4")(lambda e: sets.union_all(e.triples.where("p = 2").selectExpr("s as id"), e.triples.where("p = 4").selectExpr("o as id")))
call("sort_spo", "SELECT s, p, o FROM triples ORDER BY s, p, o")(lambda e: sets.sorted_triples(e.triples, "s", "p", "o"))
call("sort_ops", "SELECT s, p, o FROM triples ORDER BY o, p, s")(lambda e: sets.sorted_triples(e.by_o, "o", "p", "s"))

# updates: a digest of every predicate's triples afterwards
_DIGEST = ("p", "COUNT(*) AS n", "SUM(s % 1000003) AS sum_s", "SUM(o % 1000003) AS sum_o", "SUM((s % 10007) * (o % 10009)) AS sum_so")
_AFTER = f"SELECT p, {', '.join(f'CAST({x.split(' AS ')[0]} AS BIGINT) AS {x.split(' AS ')[1]}' for x in _DIGEST[1:])} FROM ({{}}) q GROUP BY p"


def _digest(e: Engine) -> DataFrame:
    return e.triples.groupBy("p").agg(*[F.expr(f"CAST({x.split(' AS ')[0]} AS BIGINT)").alias(x.split(" AS ")[1]) for x in _DIGEST[1:]])


def _update(name: str, text: str, sql: str) -> None:
    call(name, _AFTER.format(sql))(lambda e, q=text: _digest(e.update(q)))


_update("upd_insert_data", f"insert data {{ 5 2 6 . {CUSTOMER} 2 {NATION} . 5 2 6 . }}", f"SELECT s, p, o FROM triples UNION SELECT 5, 2, 6 UNION SELECT {CUSTOMER}, 2, {NATION}")
_update("upd_delete_data", f"delete data {{ {3 * T} 2 {2 * T + 1} . {3 * T} 2 {NATION} . 9 9 9 . }}", f"SELECT s, p, o FROM triples WHERE NOT (s = {3 * T} AND p = 2 AND o IN ({2 * T + 1}, {NATION}))")
_update("upd_delete_s", f"delete {{ {CUSTOMER} 2 ?o . }}", f"SELECT s, p, o FROM triples WHERE NOT (s = {CUSTOMER} AND p = 2)")
_update("upd_delete_o", f"delete {{ ?s 2 {NATION} . }}", f"SELECT s, p, o FROM triples WHERE NOT (o = {NATION} AND p = 2)")
_update("upd_rename_s", f"delete {{ {CUSTOMER} 2 ?o . }} insert {{ {CUSTOMER2} 2 ?o . }}", f"SELECT DISTINCT CASE WHEN s = {CUSTOMER} AND p = 2 THEN {CUSTOMER2} ELSE s END AS s, p, o FROM triples")
_update("upd_rename_o", f"delete {{ ?s 2 {NATION} . }} insert {{ ?s 2 {NATION + 1} . }}", f"SELECT DISTINCT s, p, CASE WHEN o = {NATION} AND p = 2 THEN {NATION + 1} ELSE o END AS o FROM triples")
_NEW = f"(SELECT MAX(id) FROM terms)"
_update("upd_insert_new_term", f'insert data {{ {CUSTOMER} 8 "no such segment" . "another" <newPredicate> 5 . {CUSTOMER2} 8 "no such segment" . }}', f"SELECT s, p, o FROM triples UNION SELECT {CUSTOMER}, 8, {_NEW} + 1 UNION SELECT {_NEW} + 2, 21, 5 UNION SELECT {CUSTOMER2}, 8, {_NEW} + 1")
_update("upd_delete_unknown", f'delete data {{ "nosuch" 2 3 . {TURN} 18 {CONVERSATION} . {CUSTOMER} <nosuch> 5 . }}', f"SELECT s, p, o FROM triples WHERE NOT (s = {TURN} AND p = 18 AND o = {CONVERSATION})")
_CHAIN = ("insert data {{ 5 2 6 . 7 2 {n} . }}", "delete {{ ?s 2 {n} . }}", "insert data {{ {c} 2 {n} . 5 2 6 . }}", "delete {{ ?s 1 ?o . }} insert {{ ?s 30 ?o . }}", "delete data {{ 5 2 6 . }}", "delete {{ {c} 2 ?o . }} insert {{ {d} 2 ?o . }}")


def _chained(e: Engine) -> Engine:
    for text in _CHAIN:
        e = e.update(text.format(n=NATION, c=CUSTOMER, d=CUSTOMER2))
    return e


_CHAINED = f"SELECT CASE WHEN p = 2 AND s = {CUSTOMER} THEN {CUSTOMER2} ELSE s END AS s, CASE WHEN p = 1 THEN 30 ELSE p END AS p, o FROM triples WHERE NOT (p = 2 AND o = {NATION}) UNION SELECT {CUSTOMER2}, 2, {NATION}"
call("upd_chain", _AFTER.format(_CHAINED))(lambda e: _digest(_chained(e)))
call("upd_compact", _AFTER.format(_CHAINED))(lambda e: _digest(_chained(e).save(new_path(e.spark, "graph"))))
