"""Relational tables as triples, by one list of SQL texts that Spark and an independent SQL engine both run.

A node's id is tag * 10**15 + key, so kinds of nodes do not meet and no id is 0.  Literals are
numbered by dense rank over (predicate, text).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions import dictionary
from ..sources.store import written

TAG = 10**15
LITERAL = 13


def node(tag: int, key: str) -> str:
    return f"({tag * TAG} + CAST({key} AS BIGINT))"


_ITEM = node(7, "((CAST(l_orderkey AS BIGINT) * 10 + CAST(l_linenumber AS BIGINT)) * 100000 + CAST(l_partkey AS BIGINT)) * 1000 + CAST(l_suppkey AS BIGINT)")
_TURN = node(11, "CAST(conv_id AS BIGINT) * 100 + CAST(turn AS BIGINT)")


@dataclass(frozen=True)
class Rule:
    pid: int
    name: str
    table: str
    s: str
    o: str
    literal: bool = False


RULES = (
    Rule(1, "inRegion", "nation", node(2, "n_nationkey"), node(1, "n_regionkey")),
    Rule(2, "custNation", "customer", node(3, "c_custkey"), node(2, "c_nationkey")),
    Rule(3, "suppNation", "supplier", node(4, "s_suppkey"), node(2, "s_nationkey")),
    Rule(4, "orderedBy", "orders", node(6, "o_orderkey"), node(3, "o_custkey")),
    Rule(5, "itemOrder", "lineitem", _ITEM, node(6, "l_orderkey")),
    Rule(6, "itemPart", "lineitem", _ITEM, node(5, "l_partkey")),
    Rule(7, "itemSupp", "lineitem", _ITEM, node(4, "l_suppkey")),
    Rule(8, "segment", "customer", node(3, "c_custkey"), "c_mktsegment", True),
    Rule(9, "priority", "orders", node(6, "o_orderkey"), "o_orderpriority", True),
    Rule(10, "status", "orders", node(6, "o_orderkey"), "o_orderstatus", True),
    Rule(11, "brand", "part", node(5, "p_partkey"), "p_brand", True),
    Rule(12, "partType", "part", node(5, "p_partkey"), "p_type", True),
    Rule(13, "returnFlag", "lineitem", _ITEM, "l_returnflag", True),
    Rule(14, "byUser", "events", node(8, "event_id"), node(9, "user_id")),
    Rule(15, "eventType", "events", node(8, "event_id"), "event_type", True),
    Rule(16, "docLang", "documents", node(10, "doc_id"), "lang", True),
    Rule(17, "docSource", "documents", node(10, "doc_id"), "source", True),
    Rule(18, "inConv", "conversations", _TURN, node(12, "conv_id")),
    Rule(19, "role", "conversations", _TURN, "role", True),
)
#: turn t + 1 of a conversation follows turn t when both are there
FOLLOWS = (20, "follows", "conversations")
PREDICATES = {r.pid: r.name for r in RULES} | {FOLLOWS[0]: FOLLOWS[1]}


_RANKED = f"SELECT {LITERAL * TAG} + CAST(DENSE_RANK() OVER (ORDER BY p, lex) AS BIGINT) AS id, p, lex FROM lits"


def _lits(table, text: str = "VARCHAR") -> str:  # noqa: ANN001
    return " UNION ".join(f"SELECT {r.pid} AS p, CAST({r.o} AS {text}) AS lex FROM {table(r.table)} WHERE {r.o} IS NOT NULL" for r in RULES if r.literal)


def _links(table, only: tuple[int, ...] = ()) -> list[str]:  # noqa: ANN001
    """One SELECT for the triples of each rule, or of those of ``only``."""
    rules = [r for r in RULES if not only or r.pid in only]
    links = [f"SELECT {r.s} AS s, {r.pid} AS p, {r.o} AS o FROM {table(r.table)}" for r in rules if not r.literal]
    links += [f"SELECT {r.s} AS s, {r.pid} AS p, t.id AS o FROM {table(r.table)} JOIN terms t ON t.p = {r.pid} AND t.lex = {r.o}" for r in rules if r.literal]
    if not only or FOLLOWS[0] in only:
        turn = lambda a: node(11, f"CAST({a}.conv_id AS BIGINT) * 100 + CAST({a}.turn AS BIGINT)")
        links.append(f"SELECT {turn('b')} AS s, {FOLLOWS[0]} AS p, {turn('a')} AS o FROM {table(FOLLOWS[2])} a JOIN {table(FOLLOWS[2])} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
    return links


def load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(triples, terms) of the tables in a folder; triples may repeat, a store makes them a set.

    Literals are numbered as by a dense rank over (p, lex), in parallel ranges.
    """
    table = lambda name: f"parquet.`{sf_dir}/{name}.parquet`"
    numbers = dictionary.build(spark.sql(_lits(table, "STRING")).selectExpr("concat(lpad(p, 5, '0'), lex) as lex"), LITERAL * TAG + 1)
    terms = written(numbers.selectExpr("id", "cast(left(lex, 5) as int) as p", "substring(lex, 6) as lex"), "terms")
    triples = spark.sql(f"SELECT s, p, o FROM ({' UNION ALL '.join(_links(table))}) x WHERE s IS NOT NULL AND o IS NOT NULL".replace("terms t", "{terms} t"), terms=terms)
    return triples, terms


def oracle(select: str, steps: dict[str, str] | None = None, only: tuple[int, ...] = ()) -> str:
    """SQL for an independent engine that has the tables as views: ``select`` over lits, terms(id, p, lex), preds(pid, name) and triples(s, p, o).

    ``steps``: named intermediate results, each computed once; ``only``: the predicates that triples is made of (default: all).
    """
    names = " UNION ALL ".join(f"SELECT {p} AS pid, '{n}' AS name" for p, n in PREDICATES.items())
    more = "".join(f", {name} AS MATERIALIZED ({sql})" for name, sql in (steps or {}).items())
    return (
        f"WITH lits AS ({_lits(str)}), terms AS ({_RANKED}), preds AS ({names}), "
        f"triples AS {'MATERIALIZED ' if steps else ''}(SELECT s, p, o FROM ({' UNION '.join(_links(str, only))}) x WHERE s IS NOT NULL AND o IS NOT NULL){more} {select}"
    )
