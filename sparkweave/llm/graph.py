"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every end of links (a, b): root is the smallest vertex that links lead to.

    Each round gives a vertex the smallest root among itself and its neighbours, then that root's root, and writes
    the result to the shared folder; it ends when no root changes.  Rounds grow with the
    logarithm of the longest chain in the usual case; every step is a sum or minimum that combines before the shuffle.
    """
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("root")), "roots")
    while True:
        around = both.join(roots.select(F.col("v").alias("b"), "root"), "b").select(F.col("a").alias("v"), "root")
        near = around.union(roots).groupBy("v").agg(F.min("root").alias("root"))
        hop = roots.select(F.col("v").alias("root"), F.col("root").alias("next"))
        stepped = near.join(hop, "root", "left").select("v", F.least("root", F.coalesce("next", "root")).alias("root"))
        new = materialize(stepped.join(roots.select("v", F.col("root").alias("before")), "v"), "roots")
        if new.where("root <> before").isEmpty():
            return new.select("v", "root")
        roots = new.select("v", "root")
