"""Counts of triples by position: the planner's statistics and the lookups on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import parts


def counts(triples: DataFrame, *by: str) -> DataFrame:
    """Triples for each value of ``by`` (any of s, p, o); without any, the total.

    Groups of subjects or objects are about as many as triples: these are dealt out by as many partitions as their rows need before they are grouped.
    A subject or object of many triples is counted in shares, and the shares added up.
    """
    if not {"s", "o"} & {*by}:
        return triples.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    n = parts(triples)
    if {"s", "o"} <= {*by}:  # as many triples as predicates at most
        return triples.repartition(n, *by).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    shares = _shares(triples, n).repartition(n, *by, "share").groupBy(*by, "share").agg(F.count(F.lit(1)).alias("n"))
    return shares.repartition(n, *by).groupBy(*by).agg(F.sum("n").alias("n"))


def _shares(triples: DataFrame, n: int) -> DataFrame:
    """With the ``share``, one of ``n``, that a triple is counted in."""
    return triples.withColumn("share", F.pmod(F.xxhash64("s", "p", "o"), F.lit(n)))


def id_range(triples: DataFrame) -> DataFrame:
    """Smallest and largest subject and object of each predicate."""
    return triples.groupBy("p").agg(F.min("s").alias("min_s"), F.max("s").alias("max_s"), F.min("o").alias("min_o"), F.max("o").alias("max_o"))


def between(triples: DataFrame, position: str, low: int, high: int) -> DataFrame:
    """Distinct ids of a position within bounds."""
    return triples.where(F.col(position).between(low, high)).select(F.col(position).alias("id")).distinct()


def entities(triples: DataFrame) -> DataFrame:
    """Distinct ids that are subject or object; found in shares first, as in ``counts``."""
    n = 2 * parts(triples)
    shared = _shares(triples, n)
    ids = shared.select(F.col("s").alias("id"), "share").union(shared.select("o", "share"))
    return ids.repartition(n, "id", "share").distinct().select("id").repartition(n, "id").distinct()


def present(by_s: DataFrame, by_o: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Those of the ids that are subject or object; the two orders are asked for these alone."""
    found = by_s.where(F.col("s").isin(*ids)).select(F.col("s").alias("id"))
    return found.union(by_o.where(F.col("o").isin(*ids)).select("o")).distinct()


def predicates(triples: DataFrame) -> DataFrame:
    return triples.select("p").distinct()


def matching(triples: DataFrame, wanted: Sequence[tuple[int | None, int | None, int | None]]) -> list[tuple[int, dict[str, tuple[int, int]]]]:
    """For each (s, p, o), with None for any: how many triples match, and the smallest and largest s and o among them; all in one job."""
    if not wanted:
        return []

    def test(w: tuple[int | None, int | None, int | None]) -> F.Column:
        out = F.lit(True)
        for c, v in zip("spo", w, strict=True):
            out = out & (F.col(c) == v) if v is not None else out
        return out

    tests = [test(w) for w in wanted]
    any_ = tests[0]
    for t in tests[1:]:
        any_ = any_ | t
    sums = [F.count(F.when(t, 1)) for t in tests]
    ends = [f(F.when(t, F.col(c))) for t in tests for c in "so" for f in (F.min, F.max)]
    row = list(triples.where(any_).agg(*[x.alias(f"c{i}") for i, x in enumerate(sums + ends)]).first())
    out = []
    for i, n in enumerate(row[: len(tests)]):
        low_s, high_s, low_o, high_o = row[len(tests) + 4 * i : len(tests) + 4 * i + 4]
        out.append((n, {"s": (low_s, high_s), "o": (low_o, high_o)} if n else {}))
    return out
