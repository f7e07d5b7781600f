"""N-gram perplexity filter (operator 2).

Spark counts the character 5-grams of all documents for each language; modified Kneser-Ney
smoothing turns them into log-probabilities, held in sorted hash arrays for scoring; n-grams that were not counted back off to
lower orders.  A model with more n-grams than ``most`` is not sent to the tasks but joined.  A document's
log-perplexity is its mean negative log-probability.  Each language has a lower and an upper
band edge around the median, set by the spread (median absolute deviation) on either side
over the documents that pass the base rules; documents outside are rejected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, materialize, mix, rolling, rows_of
from .ngrams import Counter, HashArrays, Shape, kneser_ney

SHAPE = Shape(order=5, bits=12)
SYMBOLS = "#*$%&|<>"
_STATS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_chars long, log_ppl double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("n_chars", pa.int64()), ("log_ppl", pa.float64())])
_WINDOW = 5
#: log-perplexities are binned this fine for the bands
_BIN = 1e-3


def repeated_words(texts: list[bytes], hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text the words covered by a 5-word window whose sequence occurs twice or more in it, all occurrences included.

    Further arguments: ``hashed_words(texts)``.  Equal hashes are checked word by word.
    """
    doc = np.repeat(np.arange(len(texts)), counts)
    n = max(len(doc) - _WINDOW + 1, 0)
    at = np.flatnonzero(doc[:n] == doc[_WINDOW - 1 :])
    keys = mix(rolling(hashes, _WINDOW, 3)[at] ^ mix(doc[at].astype(np.uint64)))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    at = at[order[np.r_[same, False] | np.r_[False, same]]] if len(at) else at
    data, seen = b"\n".join(texts), {}
    windows = [(d, *data[a:b].split()) for d, a, b in zip(doc[at].tolist(), starts[at].tolist(), ends[at + _WINDOW - 1].tolist(), strict=True)]
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    at = at[np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))]
    covered = np.bincount(at, minlength=len(doc) + 1) - np.bincount(at + _WINDOW, minlength=len(doc) + 1)
    return np.bincount(doc[np.cumsum(covered[:-1]) > 0], minlength=len(texts))


def base_rules(texts: list[str]) -> list[tuple[int, int, int, int, int, bool]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of whole texts."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    found = hashed_words(raw)
    out = []
    for text, n, repeat in zip(texts, found[3].tolist(), repeated_words(raw, *found).tolist(), strict=True):
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        out.append((n, len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, n < 10 or 100 * repeat > 20 * n))
    return out


def language_key(lang: str | None) -> int:
    """Number of a language's model: a 63-bit hash of its name; an unknown language has its own."""
    return -1 if lang is None else int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1


def _chunks(batches: Iterator[pa.RecordBatch], chars: int = 1 << 19) -> Iterator[list[tuple]]:
    held, size = [], 0
    for doc_id, text, lang in rows_of(batches, "doc_id", "text", "lang"):
        held.append((doc_id, text, lang))
        size += len(text)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")


def count(docs: DataFrame, shape: Shape = SHAPE) -> DataFrame:
    """(m, key, n): how often each n-gram of (text, lang) occurs in each language, over every document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for chunk in _chunks(batches):
            by: dict[int, list[str]] = {}
            for _, text, lang in chunk:
                by.setdefault(language_key(lang), []).append(text)
            for m, texts in by.items():
                yield from counter.add(m, shape.keys(texts)[0])
        yield from counter.flush()

    return materialize(_inputs(docs).mapInArrow(each, Counter.SCHEMA).groupBy("m", "key").agg(F.sum("n").alias("n")), "ngram-counts")


def log_probabilities(grams: DataFrame, shape: Shape) -> DataFrame:
    """(m, key, n, logp) of counted n-grams."""
    return kneser_ney(grams, shape, shape.order)[-1].select("m", "key", "n", F.ln("p").alias("logp"))


def train(docs: DataFrame, shape: Shape = SHAPE) -> HashArrays:
    """A model for each language of (text, lang) that scores any text: n-grams that no document has back off to lower orders."""
    below = None
    grams = count(docs, shape)
    for n, level in enumerate(kneser_ney(grams, shape, shape.order), 1):
        level, at = materialize(level, "kneser-ney"), replace(shape, order=n).fitted(grams.count())
        table = HashArrays.gather(level.withColumn("logp", F.ln("p")), "m", "key", "logp", "n", at)
        context = level.groupBy("m", F.shiftright("key", shape.bits).alias("key")).agg(F.max(F.ln("rest")).alias("v"), F.lit(1).alias("n"))
        table.below, table.rest = below, HashArrays.gather(context, "m", "key", "v", "n", at)
        if n == 1:
            table.floor = {r.m: r.v - shape.bits * float(np.log(2)) for r in context.collect()}  # one row for each language
        below = table
    return below


def _scored(docs: DataFrame, log_ppl: Callable[[list[str], str | None], np.ndarray]) -> DataFrame:
    """Base rules and ``log_ppl`` (of texts of one language) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            by: dict[str | None, list[tuple]] = {}
            for row in chunk:
                by.setdefault(row[2], []).append(row)
            for lang, rows in by.items():
                texts = [r[1] for r in rows]
                out = [(r[0], lang, *base, len(r[1]), float(x)) for r, base, x in zip(rows, base_rules(texts), log_ppl(texts, lang), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return docs.mapInArrow(each, _STATS)


def score(docs: DataFrame, model: HashArrays) -> DataFrame:
    """Base rules and log-perplexity (nats a character) of every row of (doc_id, text, lang).  The empty text has log-perplexity 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def log_ppl(texts: list[str], lang: str | None) -> np.ndarray:
        keys, sizes = shared.value.shape.keys(texts)
        sums = np.concatenate([[0.0], np.cumsum(shared.value.log_probability(language_key(lang), keys), dtype=np.float64)])
        ends = np.cumsum(sizes)
        return (sums[ends - sizes] - sums[ends]) / np.maximum(sizes, 1)

    return _scored(_inputs(docs), log_ppl)


def score_by_join(docs: DataFrame, probs: DataFrame, shape: Shape = SHAPE) -> DataFrame:
    """As ``score`` for documents whose n-grams are all in ``probs`` (m, key, logp), which may have any size: it is joined to the documents' n-grams."""
    rows = materialize(_inputs(docs).withColumn("row", F.monotonically_increasing_id()), "rows")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, text, lang in rows_of(batches, "row", "text", "lang"):
            keys, n = np.unique(shape.keys([text])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row)), pa.array(np.full(len(keys), language_key(lang))), pa.array(keys), pa.array(n)], names=["row", "m", "key", "n"])

    found = rows.mapInArrow(grams, "row long, m long, key long, n long").join(probs.select("m", "key", "logp"), ["m", "key"])
    sums = found.groupBy("row").agg((-F.sum(F.expr("n * logp"))).alias("bits"))
    plain = _scored(rows.select(F.col("row").alias("doc_id"), "text", "lang"), lambda texts, lang: np.zeros(len(texts))).withColumnRenamed("doc_id", "row")
    both = plain.join(sums, "row", "left").join(rows.select("row", "doc_id"), "row")
    return both.withColumn("log_ppl", F.coalesce(F.expr("bits / n_chars"), F.lit(0.0))).select(*_ARROW.names)


def deviation(log_ppl: str, centre: str, n_chars: str) -> str:
    """SQL: distance from the language's centre, less for short texts, whose means vary more."""
    return f"({log_ppl} - {centre}) * sqrt({n_chars} / ({n_chars} + 1500d))"


def bands(scored: DataFrame, width: float) -> list[tuple]:
    """(lang, centre, low, high) of each language, over documents that pass the base rules.

    From counts of binned values: the driver gets the bins, whose number the range of the
    log-perplexity bounds, never documents.
    """
    binned = scored.where("not base_failed").groupBy("lang", F.floor(F.col("log_ppl") / _BIN).alias("bin")).count().collect()
    by: dict[str | None, list[tuple[int, int]]] = {}
    for r in binned:
        by.setdefault(r["lang"], []).append((r["bin"], r["count"]))
    out = []
    for lang, bins in by.items():
        centre = _median(bins)
        spread = max(_median([(abs(b - centre), n) for b, n in bins]), 5) * 1.4826
        out.append((lang, (centre + 0.5) * _BIN, -width * spread * _BIN, width * spread * _BIN))
    return out


def _median(bins: list[tuple[int, int]]) -> int:
    half, seen = sum(n for _, n in bins) / 2, 0
    for b, n in sorted(bins):
        seen += n
        if seen >= half:
            return b
    raise ValueError("no values")


def perplexity_filter(docs: DataFrame, width: float = 6.0, shape: Shape = SHAPE, most: int = 1 << 25) -> DataFrame:
    """doc_id, lang, base-rule counts, base_failed, n_chars, log_ppl and kept for every row of (doc_id, text, lang).

    ``kept``: the base rules hold and the log-perplexity lies in the language's band, ``width`` robust standard
    deviations to either side of its median.  A null text is empty (and fails the base rules); documents of null
    language form a language of their own; repeated rows are counted and scored each; an empty table gives no rows.
    A language without documents that pass the base rules has no band and keeps none.  ``most``: n-grams that are broadcast (12 bytes each);
    beyond, the model is joined.
    """
    probs = materialize(log_probabilities(count(docs, shape), shape), "ngram-probabilities")
    size = probs.count()
    if size > most:
        scored = score_by_join(docs, probs, shape)
    else:  # the documents are those that were counted, so no n-gram backs off
        scored = score(docs, HashArrays.gather(probs, "m", "key", "logp", "n", shape.fitted(size)))
    scored = materialize(scored, "perplexity")
    edges = docs.sparkSession.createDataFrame(bands(scored, width), "band_lang string, centre double, low double, high double")
    joined = scored.join(F.broadcast(edges), F.col("lang").eqNullSafe(F.col("band_lang")), "left")
    inside = F.expr(f"{deviation('log_ppl', 'centre', 'n_chars')} between low and high")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).drop("band_lang", "centre", "low", "high")
