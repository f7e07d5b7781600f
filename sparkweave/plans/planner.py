"""Order of the patterns of a group, from counts that Catalyst does not have.

Selectivity of a pattern: the number of triples that match its constants.  The cheapest pattern that shares a variable comes
first; then always the pattern that keeps the estimated number of bindings smallest, judged by its triples and by how many
distinct values its shared variables take.  Patterns that close a cycle so come as soon as they reduce.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from .algebra import Pattern


def order(patterns: Sequence[Pattern], count: Callable[[Pattern], int], distinct: Callable[[Pattern, str], int] | None = None) -> list[Pattern]:
    """All patterns, so that each shares a variable with an earlier one where it can; those without variables first.

    ``distinct``: distinct values of a variable in a pattern; without it, as many as triples.
    """
    cost = [max(1, count(p)) for p in patterns]
    values = lambda i, v: max(1, min(cost[i], distinct(patterns[i], v) if distinct else cost[i]))
    out = [i for i, p in enumerate(patterns) if not p.variables]
    left = [i for i, p in enumerate(patterns) if p.variables]
    uses: dict[str, int] = {}
    for i in left:
        for v in patterns[i].variables:
            uses[v] = uses.get(v, 0) + 1
    seen: dict[str, float] = {}
    rows = 1.0
    while left:

        def estimate(i: int) -> float:
            n = rows * cost[i]
            for v in patterns[i].variables & seen.keys():
                n /= max(seen[v], values(i, v))
            return n

        joined = [i for i in left if patterns[i].variables & seen.keys()]
        best = min(joined, key=lambda i: (estimate(i), i)) if joined else min(left, key=lambda i: (all(uses[v] < 2 for v in patterns[i].variables), cost[i], i))
        rows = estimate(best)
        for v in patterns[best].variables:
            seen[v] = min(seen.get(v, math.inf), values(best, v))
        seen = {v: max(1.0, min(d, rows)) for v, d in seen.items()}
        left.remove(best)
        out.append(best)
    return [patterns[i] for i in out]


def shape(patterns: Sequence[Pattern]) -> str:
    """single, star (one join variable), acyclic or cyclic."""
    if len(patterns) < 2:
        return "single"
    uses: dict[str, set[int]] = {}
    for i, p in enumerate(patterns):
        for v in p.variables:
            uses.setdefault(v, set()).add(i)
    joins = {v: u for v, u in uses.items() if len(u) > 1}
    if len(joins) == 1:
        return "star"
    # the graph of patterns and join variables is a forest exactly when edges = nodes - trees
    parent: dict[object, object] = {}

    def find(x: object) -> object:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for v, own in joins.items():
        for i in own:
            a, b = find(("v", v)), find(("p", i))
            if a == b:
                return "cyclic"
            parent[a] = b
    return "acyclic"
