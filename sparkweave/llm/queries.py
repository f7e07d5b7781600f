"""Registered queries of this package: name -> callable, and the SQL that checks some of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import digests, pack

    return digests(materialize(pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0), "sequences"))


def op2_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .perplexity import perplexity_filter

    out = perplexity_filter(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl")


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import compare_with_next, to_text

    out = compare_with_next(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", to_text("fingerprint_words").alias("fingerprint"), to_text("edited_words").alias("edited_fingerprint"), "near_edited", "near_next")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


#: domain of a source, and weights of the tree's nodes among their siblings
DOMAIN = "CASE WHEN try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) < 10 THEN 'web' ELSE 'books' END"
WEIGHTS = {("web",): 0.6, ("books",): 0.4, ("web", "en"): 3.0, ("books", "en"): 2.0}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    docs = table(spark, sf_dir, "documents").withColumn("domain", F.expr(DOMAIN))
    return mix(docs, budget=0.8, weights=WEIGHTS, max_epochs=2, seed=1).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    remainder = "pmod(crc32(cast(doc_id as string)), 4)"
    out = score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), use=f"{remainder} != 2", fold=remainder)
    return out.select("doc_id", F.coalesce(F.expr(f"{remainder} = 2"), F.lit(False)).alias("held_out"), "score", "predicted")


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shingle_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE, find, listed

    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_store

    path = token_store.new_path(spark)
    token_store.write(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=1)
    return token_store.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_perplexity, op3_fingerprint, op4_repeats, op5_mixing, op6_toxicity, op7_shingle_join, op8_langid, op9_pii, op10_token_store)}
#: words of a text as the contracts have them
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
ORACLE_SQL: dict[str, str] = {
    "op4_repeats": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) t(i) WHERE len(w) >= 13),
        source AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
        gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM win JOIN source USING (g), unnest(range(0, 13)) u(j) WHERE doc_id > m),
        word AS (SELECT doc_id, pos, w[pos] AS x FROM d, unnest(range(1, len(w) + 1)) t(pos)),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY pos) AS k FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op7_shingle_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 1, 2))) t(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS (SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 90 * (nx.n + ny.n - k)),
        reach AS (SELECT doc_id AS v, doc_id AS r FROM d UNION SELECT link.y, reach.r FROM reach JOIN link ON link.x = reach.v)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(r) FROM reach WHERE v = d.doc_id) AS component_id
        FROM d LEFT JOIN n USING (doc_id)""",
}
