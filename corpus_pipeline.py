"""A corpus pipeline of five stages over ``documents``: each is written as Parquet and read again as the next one's docs.

Null texts stay rows; no stage needs anything but doc_id, text, lang, source and n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm import mixing, packing, pii, queries, shingle_join, toxicity
from sparkweave.llm.common import materialize, table

#: no SQL can express models trained here or token ids; the run is tested against a plain version on a small fixture
ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from labels outside the held-out quarter."""
    return toxicity.drop_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), use="pmod(crc32(cast(doc_id as string)), 4) != 2")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles (Jaccard 0.8 or more) the document with the smallest id stays; rows without id stay."""
    docs = docs.select(*COLUMNS)
    first = shingle_join.jaccard_components(docs, words=5, num=80, den=100).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").select(*COLUMNS).unionByName(docs.where("doc_id is null"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind."""
    found = pii.find(docs.select(*COLUMNS)).withColumn("text", pii.redact("text", "spans"))
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A token budget for each leaf of the domain-language-source tree; no document is repeated."""
    with_domain = docs.select(*COLUMNS, F.expr(queries.DOMAIN).alias("domain"))
    return mixing.mix(with_domain, budget=0.9, weights=queries.WEIGHTS, max_epochs=1).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1024 token ids, the ids with them."""
    return packing.pack(docs, queries.vocabulary("byte_bpe_50k.json"), end_id=0)


STAGES = [("toxicity", drop_toxic), ("jaccard", drop_near_copies), ("pii", redact_personal_data), ("mixing", mix_sources), ("packing", pack)]


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the written table of packed sequences, with their ids."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the packed sequences of all stages."""
    return packing.digests(packed(spark, sf_dir))
