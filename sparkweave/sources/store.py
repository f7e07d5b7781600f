"""Triples on disk: Parquet by predicate, in two orders, with terms and statistics beside them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIPLES = T.StructType([T.StructField("s", T.LongType()), T.StructField("p", T.IntegerType()), T.StructField("o", T.LongType())])
TERMS = T.StructType([T.StructField("id", T.LongType()), T.StructField("p", T.IntegerType()), T.StructField("lex", T.StringType())])
#: rows of one partition: what a task sorts or counts is bounded by it, whatever the session's number of shuffle partitions
ROWS = 1 << 20


def parts(rows: DataFrame) -> int:
    """Partitions of about ``ROWS`` rows for all of ``rows``, which are counted; small ones still get a core each."""
    n = rows.count()
    return max(1, -(-n // ROWS), min(rows.sparkSession.sparkContext.defaultParallelism, n >> 16))


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session on one machine may lack it and then uses a folder under /tmp/checkpoints."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/") if base else f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once into the shared folder and read back: what follows does not carry its plan."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(triples: DataFrame) -> DataFrame:
    """A set of (s bigint, p int, o bigint) without nulls."""
    return triples.select(F.col("s").cast("long"), F.col("p").cast("int"), F.col("o").cast("long")).dropna().dropDuplicates()


def predicate_stats(triples: DataFrame) -> dict[int, tuple[int, int, int]]:
    """As many entries as there are predicates."""
    rows = triples.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("s").alias("s"), F.approx_count_distinct("o").alias("o"))
    return {r["p"]: (r["n"], r["s"], r["o"]) for r in rows.collect()}


class Store:
    """One immutable version: ``by_s`` and ``by_o`` hold the same triples, sorted by (s, o) and (o, s) in each predicate."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._stats: dict[int, tuple[int, int, int]] | None = None

    @classmethod
    def write(cls, triples: DataFrame, path: str, terms: DataFrame | None = None) -> Store:
        """Write a new version: two exchanges by ranges of (p, s, o) and of (p, o, s), of about ``ROWS`` triples each.

        Files hold ranges that do not overlap, so a subject or object is looked up in one file of a predicate, and a frequent predicate is spread over many.
        The first exchange also removes duplicates: equal triples are in one range.
        """
        spark = triples.sparkSession
        rows = triples.select(F.col("s").cast("long"), F.col("p").cast("int"), F.col("o").cast("long")).dropna()
        n = parts(rows)
        for name, (a, b) in {"by_s": ("s", "o"), "by_o": ("o", "s")}.items():
            ranged = rows.repartitionByRange(n, "p", a, b)
            ranged = ranged.dropDuplicates() if name == "by_s" else ranged
            ranged.sortWithinPartitions("p", a, b).write.partitionBy("p").parquet(f"{path}/{name}")
            rows = cls(spark, path).triples("by_s")
        (terms if terms is not None else spark.createDataFrame([], TERMS)).select("id", F.col("p").cast("int"), "lex").write.parquet(f"{path}/terms")
        return cls(spark, path)

    def triples(self, order: str = "by_s") -> DataFrame:
        return self.spark.read.schema(TRIPLES).parquet(f"{self.path}/{order}").select("s", "p", "o")

    def terms(self) -> DataFrame:
        return self.spark.read.schema(TERMS).parquet(f"{self.path}/terms")

    def predicate_stats(self) -> dict[int, tuple[int, int, int]]:
        """Triples, and about how many distinct subjects and objects, of each predicate."""
        if self._stats is None:
            self._stats = predicate_stats(self.triples())
        return self._stats

    def predicate_counts(self) -> dict[int, int]:
        return {p: x[0] for p, x in self.predicate_stats().items()}
