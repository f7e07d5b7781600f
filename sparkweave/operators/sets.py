"""Set operations and orders on bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Bag union by name; a variable that one side lacks is null there."""
    return left.unionByName(right, allowMissingColumns=True)


def union_set(left: DataFrame, right: DataFrame) -> DataFrame:
    return union_all(left, right).distinct()


def counted(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("count"))


def duplicated(df: DataFrame) -> DataFrame:
    """Rows that occur more than once, as often as they do."""
    some = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(" n")).where(F.col(" n") > 1)
    return some.select(*df.columns, F.explode(F.sequence(F.lit(1), F.col(" n"))).alias(" n")).drop(" n")


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The n smallest rows by all columns: a limit that always gives the same rows."""
    return df.orderBy(*df.columns).limit(n)


def sorted_triples(triples: DataFrame, *by: str) -> DataFrame:
    return triples.orderBy(*by)
