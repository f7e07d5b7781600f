"""Toxicity by class-conditional Kneser-Ney models (operator 6).

Characters are predicted within words, from up to five before them.  For the toxic and the ordinary class Spark counts, of every
labelled document, which such n-grams it holds; both classes back off to one shared Kneser-Ney model, and with the
same weight, so an expression that is rare in both (``RARE`` documents or fewer) gets the same probability from both.
A word's log-likelihood ratio is the sum over its characters.  A document is judged by its
length-normalised ratio and by those of its strongest words; logistic regression on labelled rows that
the counts have not seen turns these into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, release, rows_of, small
from .ngrams import Counter, HashArrays, Shape, lower

SHAPE = Shape(order=6, bits=10)
#: expressions of up to so many documents of a class are left to the shared model
RARE = 3
#: strongest words of a text that count
TOP = 3
_FEATURES = "toxic int, top double, mean double, size double"
_ARROW = pa.schema([("toxic", pa.int32()), ("top", pa.float64()), ("mean", pa.float64()), ("size", pa.float64())])
#: bins of the features (top, mean, size) from which the regression is fitted, and their ranges
_GRID = ((0.0, 6.0, 60), (-1.0, 0.5, 50), (0.0, 16.0, 16))
_MODEL = 1  # both classes share the keys of one table


def _chunks(batches: Iterator[pa.RecordBatch], *names: str, chars: int = 1 << 20) -> Iterator[list[tuple]]:
    release()
    held, size = [], 0
    for row in rows_of(batches, *names):
        held.append(row)
        size += len(row[1])
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def _low() -> F.Column:
    return F.lower(F.coalesce("text", F.lit("")))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text): lower-case texts of labelled documents.  The labels are broadcast when they are few; else both sides are shuffled."""
    return docs.select("doc_id", _low().alias("text")).join(small(labels), "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "text")


def train(marked: DataFrame, shape: Shape = SHAPE) -> HashArrays:
    """Log-likelihood ratio of every n-gram from every row of (toxic 0/1, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for chunk in _chunks(batches, "toxic", "text"):
            for m in (0, 1):
                if own := [np.unique(shape.word_keys([t])[0]) for toxic, t in chunk if toxic == m and t]:
                    yield from counter.add(m, np.concatenate(own))
        yield from counter.flush()

    grams = materialize(marked.mapInArrow(count, Counter.SCHEMA).groupBy("m", "key").agg(F.sum("n").alias("n")), "class-ngrams")
    shared = lower(grams.select(F.lit(0).cast("long").alias("m"), "key").distinct(), shape, shape.order - 1).selectExpr("key as low", "p as q")
    both = grams.groupBy("key").agg(*[F.sum(F.when(F.col("m") == m, F.col("n")).otherwise(0)).alias(f"n{m}") for m in (0, 1)])
    kept = ", ".join(f"if(n{m} > {RARE}, n{m} - 0.75D, 0D) as k{m}" for m in (0, 1)).split(", if")
    both = both.selectExpr("key", f"shiftright(key, {shape.bits}) as context", f"key & {shape.mask(shape.order - 1)}L as low", "n0", "n1", kept[0], "if" + kept[1])
    part = "over (partition by context)"
    own = both.selectExpr("key", "low", "n0 + n1 as n", *[f"k{m} / greatest(1, sum(n{m}) {part}) as o{m}" for m in (0, 1)], f"greatest(1e-3D, 1D - sum(k0 + k1) {part} / sum(n0 + n1) {part}) as rest")
    ratio = own.join(shared, "low").selectExpr(f"{_MODEL}L as m", "key", "n", "ln(o1 + rest * q) - ln(o0 + rest * q) as v")
    return HashArrays.gather(ratio, "m", "key", "v", "n", shape.fitted(grams.count()))


def measure(texts: list[str], model: HashArrays) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of texts: mean ratio of the strongest words, and of all characters; log of 1 + the text's length."""
    keys, words, first = model.shape.word_keys(texts)
    ratio = np.add.reduceat(model.find(_MODEL, keys, 0.0).astype(np.float64), words)
    sizes = np.fromiter(map(len, texts), np.float64, len(texts))
    top = [np.sort(ratio[a:b])[-TOP:].sum() / TOP for a, b in zip(first, np.r_[first[1:], len(ratio)], strict=True)]
    return np.array(top), np.add.reduceat(ratio, first) / (sizes + 1), np.log1p(sizes)


def features(marked: DataFrame, ratios: HashArrays) -> DataFrame:
    """(toxic, top, mean, size) of every row of (toxic, text)."""
    held = marked.sparkSession.sparkContext.broadcast(ratios)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, "toxic", "text"):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in chunk], pa.int32()), *map(pa.array, measure([r[1] for r in chunk], held.value))], schema=_ARROW)

    return marked.mapInArrow(each, _FEATURES)


def _bin(name: str, k: int) -> F.Column:
    low, high, n = _GRID[k]
    return F.expr(f"cast(greatest(0, least({n - 1}, floor(({name} - {low}) / {(high - low) / n}))) as int)").alias(name)


def _design(top, mean, size):  # noqa: ANN001, ANN202
    return [top, mean, size]


def calibrate(marked: DataFrame, steps: int = 60, ridge: float = 0.1) -> list[float]:
    """Weights (intercept last) of a logistic regression of ``toxic`` on the features of ``marked``.

    Fitted from counts in a fixed grid of feature bins, which is all that reaches the driver.
    """
    cells = marked.groupBy(_bin("top", 0), _bin("mean", 1), _bin("size", 2)).agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k")).toPandas().sort_values(["top", "mean", "size"])
    if not len(cells) or not 0 < cells["k"].sum() < cells["n"].sum():
        share = (cells["k"].sum() + 0.5) / (cells["n"].sum() + 1.0) if len(cells) else 0.01
        return [0.0, 0.0, 0.0, float(np.log(share / (1 - share)))]
    x = [_GRID[k][0] + (cells[c].to_numpy() + 0.5) * (_GRID[k][1] - _GRID[k][0]) / _GRID[k][2] for k, c in enumerate(("top", "mean", "size"))]
    a = np.column_stack([*_design(*x), np.ones(len(cells))])
    scale = np.maximum(np.abs(a).max(axis=0), 1e-9)
    a, n, k = a / scale, cells["n"].to_numpy(float), cells["k"].to_numpy(float)
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (k - n * p) - penalty * w)
        w += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return (w / scale).tolist()


def score(docs: DataFrame, labels: DataFrame, use: str = "true", fold: str = "pmod(crc32(cast(doc_id as string)), 4)", folds: tuple[str, str] = ("0, 1", "3"), threshold: float = 0.3) -> DataFrame:
    """The rows of docs (doc_id, text and any more columns) with ``score`` and ``predicted`` added (in place of columns of these names).

    labels (doc_id, toxic) are used where the SQL condition ``use`` holds: those whose ``fold`` is in folds[0] give the counts,
    those in folds[1] the regression.  Only the text enters a score.  A null text is scored as the empty one and stays null; repeated rows are scored
    each; labels of unknown documents, null labels and null ids are ignored; a document with several labels is toxic if one of them says so;
    without labels of both classes all scores are one small constant.
    """
    known = labels.where(F.expr(use)).where("doc_id is not null and toxic is not null")
    known = materialize(known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")), "labels")
    ratios, weights = None, None
    for part in folds:  # the documents are filtered before the join as well
        mine = labelled(docs.where(F.expr(f"{use} and {fold} in ({part})")), known.where(F.expr(f"{fold} in ({part})")))
        if ratios is None:
            ratios = train(mine)
        else:
            weights = np.array(calibrate(features(mine, ratios)))
    held = docs.sparkSession.sparkContext.broadcast((ratios, weights))

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        model, w = held.value
        for low_texts in batches:
            scores, at = [np.zeros(0)], 0
            while at < len(low_texts):  # slices of about a million characters
                texts, size = [], 0
                while at + len(texts) < len(low_texts) and (not texts or size < 1 << 20):
                    texts.append(low_texts[at + len(texts)].as_py())
                    size += len(texts[-1])
                x = [np.clip(v, low_, high) for v, (low_, high, _) in zip(measure(texts, model), _GRID, strict=True)]
                scores.append(1 / (1 + np.exp(-np.clip(np.column_stack([*_design(*x), np.ones(len(texts))]) @ w, -30, 30))))
                at += len(texts)
            yield pa.array(np.concatenate(scores))

    # only the lower-case text goes to Python and only the score comes back; once for each row, also where a filter follows
    likely = F.arrow_udf(each, T.DoubleType()).asNondeterministic()
    scored = docs.drop("score", "predicted").withColumn("score", likely(_low()))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, use: str = "true", threshold: float = 0.3) -> DataFrame:
    """The rows of docs that are not predicted toxic, with their own columns."""
    return score(docs, labels, use=use, threshold=threshold).where("predicted = 0").select(*docs.columns)
