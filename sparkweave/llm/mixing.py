"""Hierarchical token budgets over a tree of columns (operator 5).

The levels (by default domain, language, source) form a tree whose leaves hold documents.  A token budget enters at the root and is
split among children by their weights.  A child that cannot use its share (its documents, times ``max_epochs``, are too few) leaves the
shortage to its siblings, in proportion to their weights, and only what all siblings together cannot use goes back to
the parent's level.  A leaf with budget B over T tokens takes whole epochs of its documents while they
fit and a token prefix of one more epoch, whose order is a seeded hash of doc_id.

The prefix is found without sorting a leaf in one task: tokens are summed by hash range, 2**RADIX ranges at a time, and only
the range in which the budget ends is refined.  Leaves (not documents) reach the driver; the cut of each leaf is broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, rows_table, small

RADIX, ROUNDS = 10, 3
Path = tuple


@dataclass
class Leaf:
    tokens: int
    budget: float = 0.0


def share_out(leaves: dict[Path, Leaf], weights: dict[Path, float], budget: float, max_epochs: int) -> float:
    """Set the budget of every leaf; returns what the whole tree cannot use.

    ``weights`` maps a path prefix, e.g. ("web", "en"), to its weight among its siblings; a node that is not listed weighs 1.
    """
    tree: dict[Path, dict[Path, None]] = {}
    for path in leaves:
        for k in range(len(path)):
            tree.setdefault(path[:k], {})[path[: k + 1]] = None

    room: dict[Path, float] = {}
    for path in sorted({p for kids in tree.values() for p in kids} | {()}, key=len, reverse=True):
        room[path] = float(leaves[path].tokens * max_epochs) if path in leaves else sum(room[k] for k in tree.get(path, []))

    def give(node: Path, amount: float) -> None:
        if node in leaves:
            leaves[node].budget = amount
            return
        open_, left, got = sorted(tree.get(node, []), key=repr), min(amount, room[node]), {}
        while open_:
            total = sum(weights.get(k, 1.0) for k in open_)
            share = {k: left * weights.get(k, 1.0) / total if total else left / len(open_) for k in open_}
            short = {k for k in open_ if share[k] >= room[k]}
            if not short:
                got |= share
                break
            for k in short:  # full: the rest is for its siblings
                got[k] = room[k]
                left -= room[k]
            open_ = [k for k in open_ if k not in short]
        for k, v in got.items():
            give(k, max(0.0, v))

    give((), budget)
    return budget - min(budget, room[()])


def _leaf(levels: Sequence[str]) -> Column:
    return F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in levels]))


def count_words(text: str = "text") -> Column:
    return F.expr(f"cast(regexp_count(coalesce({text}, ''), '[^ \\\\x09-\\\\x0D]+') as bigint)")


def _cuts(rows: DataFrame, need: DataFrame) -> dict[str, int]:
    """For each leaf of ``need`` (leaf, want) the largest key of the shortest prefix of rows (leaf, key, tokens) that holds ``want`` tokens."""
    left = need.withColumn("prefix", F.lit(0).cast("long"))  # one row for each leaf
    by_leaf = Window.partitionBy("leaf").orderBy("bucket")
    for level in range(1, ROUNDS + 1):
        shift = 63 - RADIX * level if level < ROUNDS else 0
        width = RADIX if level < ROUNDS else 63 - RADIX * (ROUNDS - 1)
        part = rows.join(small(left), "leaf").where(F.shiftright("key", shift + width) == F.col("prefix"))
        sums = part.groupBy("leaf", "want", F.shiftright("key", shift).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
        upto = sums.withColumn("upto", F.sum("tokens").over(by_leaf)).where("upto >= want")
        left = upto.groupBy("leaf").agg(F.min(F.struct("bucket", F.expr("want - (upto - tokens)").alias("want"))).alias("x")).select("leaf", "x.want", F.col("x.bucket").alias("prefix"))
        left = materialize(left, "cuts")
    return {r["leaf"]: r["prefix"] for r in left.collect()}


def mix(docs: DataFrame, budget: float, weights: dict[Path, float] | None = None, levels: Sequence[str] = ("domain", "lang", "source"), tokens: Column | None = None, max_epochs: int = 2, seed: int = 1) -> DataFrame:
    """The input's rows that are selected, with ``n_tokens`` and ``epoch`` (0..) added (in place of columns of these names); a row selected in two epochs comes twice.

    ``budget``: tokens wanted, as a share of all tokens.  ``tokens``: a document's tokens (default: its words).  A leaf's last document may reach beyond its budget
    (a prefix is as short as holds the budget).  Rows of one doc_id have one place in an epoch and are taken together; a
    null level is a node of its own; documents without tokens are taken with the prefix they stand in, or
    with all of a leaf's epochs when the leaf has no tokens at all.  An empty table gives no rows.
    """
    mine = [c for c in docs.columns if c.lower() not in ("n_tokens", "epoch")]
    # the input's columns in one, whatever their names
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in mine]).alias("row"), "doc_id", (count_words() if tokens is None else tokens).alias("n_tokens"), _leaf(levels).alias("leaf"))
    small_rows = materialize(rows.select("doc_id", "leaf", "n_tokens"), "leaf-tokens")
    totals = {r["leaf"]: int(r["n"]) for r in small_rows.groupBy("leaf").agg(F.sum("n_tokens").alias("n")).collect()}
    names = {leaf: tuple(None if x == "\0null" else x for x in json.loads(leaf)) for leaf in totals}
    leaves = {names[leaf]: Leaf(n) for leaf, n in totals.items()}
    share_out(leaves, weights or {}, budget * sum(totals.values()), max_epochs)
    plan, need = [], []
    for leaf, n in totals.items():
        want = min(int(round(leaves[names[leaf]].budget)), n * max_epochs)
        whole = want // n if n else max_epochs
        plan.append((leaf, whole))
        if n and want % n:
            need.append((leaf, whole, want % n))
    spark = docs.sparkSession
    key = lambda epoch: F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch, F.col("doc_id")), 1)
    cuts: dict[str, int] = {}
    if need:
        wanted = rows_table(spark, need, "leaf string, whole int, want long")
        part = small_rows.join(small(wanted.select("leaf", "whole")), "leaf").select("leaf", key(F.col("whole")).alias("key"), F.col("n_tokens").alias("tokens"))
        cuts = _cuts(part, wanted.select("leaf", "want"))
    chosen = rows_table(spark, [(leaf, whole, cuts.get(leaf, -1)) for leaf, whole in plan], "leaf string, whole int, cut long")
    taken = rows.join(small(chosen), "leaf").withColumn("times", F.col("whole") + (key(F.col("whole")) <= F.col("cut")).cast("int"))
    return taken.where("times > 0").select("row.*", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch"))
