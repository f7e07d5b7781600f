"""Language identification of web pages by Bayesian evidence fusion (operator 8).

The posterior of a language given a page multiplies

* the likelihood of its text: character n-grams, one Kneser-Ney model for each language of a labelled table, with one shared lower order
  (tempered, as neighbouring characters are not independent);
* the likelihoods of the declared markup language and of the address suffix, from grouped counts of what pages whose text speaks for a language declare;
* the prior of its host: counts over the host's other pages, smoothed towards the registered domain, that towards all pages.

Counts are grouped aggregations over all pages; a page's own vote is taken out of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows_of, small
from .ngrams import Counter, Shape, lower, slot

SHAPE = Shape(order=4, bits=12, slot_bits=20)


@dataclass
class TextModel:
    languages: list[str]
    slots: np.ndarray
    values: np.ndarray  # one row for each slot: log-probability by language, less their mean
    shape: Shape


def train(docs: DataFrame, shape: Shape = SHAPE) -> TextModel:
    """Text likelihoods from every row of docs (text, lang) that has a language."""
    docs = docs.where("lang is not null").select(F.lower(F.coalesce("text", F.lit(""))).alias("text"), "lang")
    names = sorted(r["lang"] for r in docs.select("lang").distinct().collect())
    if not names:
        return TextModel([], np.zeros(0, np.uint32), np.zeros((0, 0), np.float32), shape)
    number = {n: i for i, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, held, size = Counter(), {}, 0
        for text, lang in rows_of(batches, "text", "lang"):
            held.setdefault(number[lang], []).append(text)
            size += len(text)
            if size > 1 << 20:
                for m, texts in held.items():
                    yield from counter.add(m, shape.word_keys(texts)[0])
                held, size = {}, 0
        for m, texts in held.items():
            yield from counter.add(m, shape.word_keys(texts)[0])
        yield from counter.flush()

    grams = materialize(docs.mapInArrow(count, Counter.SCHEMA).groupBy("m", "key").agg(F.sum("n").alias("n")), "language-ngrams")
    shape = shape.fitted(grams.count())
    shared = lower(grams.select(F.lit(0).cast("long").alias("m"), "key").distinct(), shape, shape.order - 1).selectExpr("key as low", "p as q")
    sums = [F.sum(F.when(F.col("m") == m, F.col("n")).otherwise(0)).alias(f"n{m}") for m in range(len(names))]
    both = grams.groupBy("key").agg(*sums).withColumn("context", F.shiftright("key", shape.bits)).withColumn("low", F.col("key").bitwiseAND(F.lit(shape.mask(shape.order - 1)))).join(shared, "low")
    logs = [f"ln(greatest(n{m} - 0.75D, 0D) / (2D + sum(n{m}) over (partition by context)) + 0.1D * q + 1e-7D) as v{m}" for m in range(len(names))]
    table = both.selectExpr("0L as m", "key", *logs).groupBy(slot("m", "key", shape).alias("slot")).agg(*[F.avg(f"v{m}").alias(f"v{m}") for m in range(len(names))]).toArrow()
    order = np.argsort(table["slot"].to_numpy(), kind="stable")
    values = np.column_stack([table[f"v{m}"].to_numpy() for m in range(len(names))])[order]
    return TextModel(names, shape.narrow(table["slot"].to_numpy()[order]), (values - values.mean(axis=1, keepdims=True)).astype(np.float32), shape)


def text_evidence(pages: DataFrame, model: TextModel, key: str, temper: float) -> DataFrame:
    """(key, loglik): tempered log-likelihood of ``text`` for each language, up to a constant."""
    held = pages.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([(key, pa.int64()), ("loglik", pa.list_(pa.float64()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                texts = part.column(1).to_pylist()
                keys, words, starts = m.shape.word_keys(texts)
                some, inverse = np.unique(keys, return_inverse=True)
                want = m.shape.slots(0, some)
                at = np.minimum(np.searchsorted(m.slots, want), max(len(m.slots) - 1, 0))
                hit = m.slots[at] == want if len(m.slots) else np.zeros(len(want), bool)
                v = (m.values[at] * hit[:, None])[inverse] if len(m.slots) else np.zeros((len(keys), len(m.languages)))
                sums = np.add.reduceat(v.astype(np.float64), words[starts]) * temper
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(sums), pa.list_(pa.float64()))], schema=schema)

    return pages.select(F.col(key).cast("long"), "text").mapInArrow(each, f"{key} long, loglik array<double>")


def page_text(html: str) -> Column:
    """Text of a page: scripts, styles, comments and tags out, common entities read."""
    bare = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    for name, sign in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        bare = F.regexp_replace(bare, f"&{name};", sign)
    return F.lower(bare)


def identify(pages: DataFrame, labelled: DataFrame, temper: float = 0.2, kappa: float = 5.0, alpha: float = 1.0) -> DataFrame:
    """(page_id, lang, confidence, text_lang, declared, suffix, host) for every row of pages (page_id, url, html).

    ``labelled`` (text, lang) trains the text models.  ``kappa``: weight of the smoother prior in pages; ``alpha``: pseudo-count of the likelihoods.
    A page without text, declaration or address gets its evidence from the rest; null and empty values are values of their own.
    Ties go to the language first in the alphabet; repeated rows are counted and judged each.  Without languages there are no rows.
    """
    model = train(labelled)
    k = len(model.languages)
    if not k:
        return pages.sparkSession.createDataFrame([], "page_id long, lang string, confidence double, text_lang string, declared string, suffix string, host string")
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    base = pages.select("page_id", host.alias("host"), F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)).alias("declared"), page_text("html").alias("text"))
    base = base.withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1)).withColumn("site", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).withColumn("row", F.monotonically_increasing_id())
    base = materialize(base, "pages")
    names = F.array(*[F.lit(n) for n in model.languages])
    seen = base.drop("text").join(text_evidence(base, model, "row", temper), "row")
    seen = materialize(seen.withColumn("vote", F.expr("array_position(loglik, array_max(loglik)) - 1").cast("int")), "evidence")

    def counts(*by: str) -> DataFrame:
        return materialize(seen.groupBy(*by).agg(F.array(*[F.sum((F.col("vote") == m).cast("double")) for m in range(k)]).alias("c")), "votes")

    # a page's own vote is not evidence for itself
    less = "transform({c}, (x, i) -> greatest(x - if(i = vote, 1D, 0D), 0D))"
    total = counts().select(F.col("c").alias("c_all"))  # one row
    out = seen.crossJoin(F.broadcast(total))  # one row
    for by, name in ((["site"], "c_site"), (["host"], "c_host"), (["declared"], "c_declared"), (["suffix"], "c_suffix")):
        out = out.join(small(counts(*by).withColumnRenamed("c", name)), by)  # written first, so that a hot value's rows can be split where both sides are shuffled
    for name in ("c_all", "c_site", "c_host", "c_declared", "c_suffix"):
        out = out.withColumn(name, F.expr(less.format(c=name)))
    add = lambda c: f"aggregate({c}, 0D, (a, x) -> a + x)"
    out = out.withColumn("p_all", F.expr(f"transform(c_all, x -> (x + {alpha}D) / ({add('c_all')} + {alpha * k}D))"))
    for name, below in (("site", "all"), ("host", "site")):
        out = out.withColumn(f"p_{name}", F.expr(f"transform(c_{name}, (x, i) -> (x + {kappa}D * p_{below}[i]) / ({add(f'c_{name}')} + {kappa}D))"))
    given = lambda c: f"ln((c_{c}[i] + {alpha}D * p_all[i]) / (c_all[i] + {alpha}D))"
    out = out.withColumn("score", F.expr(f"transform(loglik, (x, i) -> x + {given('declared')} + {given('suffix')} + ln(p_host[i]))"))
    out = out.withColumn("best", F.expr("array_max(score)")).withColumn("confidence", F.expr("1D / aggregate(score, 0D, (a, x) -> a + exp(x - best))"))
    return out.select("page_id", F.element_at(names, F.expr("cast(array_position(score, best) as int)")).alias("lang"), "confidence", F.element_at(names, F.col("vote") + 1).alias("text_lang"), "declared", "suffix", "host")
