"""Reachability along one predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.store import written


def reaching(triples: DataFrame, target: int, via: int) -> DataFrame:
    """(node): all nodes from which ``target`` is reached along ``via``, the target included.

    Frontier by frontier, each written to the shared folder; nodes met before are left out, so cycles end.
    """
    spark = triples.sparkSession
    edges = triples.where(f"p = {int(via)}").selectExpr("s", "o as node")
    frontier = spark.createDataFrame([(int(target),)], "node long")
    seen = frontier
    while True:
        frontier = written(edges.join(frontier, "node", "left_semi").selectExpr("s as node").distinct().join(seen, "node", "left_anti"), "reach")
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)
