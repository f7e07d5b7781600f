"""Term dictionaries: text <-> number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import new_path


def build(values: DataFrame, first: int = 1) -> DataFrame:
    """(lex, id) with dense ids from ``first`` in text order, for the distinct non-null values of column ``lex``.

    Ranges of the sorted texts are numbered in parallel and shifted by the ranges' sizes (one row for each shuffle partition).
    """
    spark = values.sparkSession
    path = new_path(spark, "terms")
    values.select("lex").dropna().distinct().repartitionByRange("lex").withColumn("b", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select("b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = ranged.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("lex")))
    return inside.join(F.broadcast(sizes), "b").select("lex", (F.col("shift") + F.col("r") + (first - 1)).alias("id"))


def extend(known: DataFrame, values: DataFrame) -> DataFrame:
    """``known`` (lex, id) with further ids for the values it lacks."""
    top = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return known.select("lex", "id").unionByName(build(values.join(known, "lex", "left_anti"), top + 1))


def encode(facts: DataFrame, terms: DataFrame, preds: DataFrame) -> DataFrame:
    """(s, p, o) numbers of text triples; terms (lex, id), preds (lex, id); triples with unknown terms go."""
    ids = lambda c, d: d.select(F.col("lex").alias(c), F.col("id").alias(f"{c}_id"))
    out = facts.join(ids("s", terms), "s").join(ids("o", terms), "o").join(ids("p", preds), "p")
    return out.select(F.col("s_id").alias("s"), F.col("p_id").cast("int").alias("p"), F.col("o_id").alias("o"))


def decode(bindings: DataFrame, terms: DataFrame, *columns: str) -> DataFrame:
    """Bindings with ``<column>_text`` for each of the columns; null where a number has no text."""
    for c in columns:
        bindings = bindings.join(terms.select(F.col("id").alias(c), F.col("lex").alias(f"{c}_text")), c, "left")
    return bindings
