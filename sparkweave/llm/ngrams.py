"""Character n-grams: packed keys, modified Kneser-Ney probabilities by DataFrame steps, sorted hash arrays.

A character belongs to one of 2**bits classes; ``order`` class numbers packed into one
long are an n-gram, so its context (all but the last) and its suffix (all but the
first) are bit operations.  Counting and smoothing cover the whole corpus and run
distributed.  A model is a sorted array of n-gram hashes with their values.  Hashes grow with the distinct n-grams
(``fitted``), so that at most one hash in 2**SPARE is in use for any corpus: an n-gram that was not counted is found with
that probability at most, and is else scored by backing off (``HashArrays.log_probability``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows_table

#: hashes outnumber the distinct n-grams by this power of two at least
SPARE = 30

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def hash_longs(keys: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """xxHash64 of 8-byte integers, as the SQL function xxhash64 chains it over bigint columns."""
    with np.errstate(over="ignore"):
        h = np.asarray(seed).astype(np.int64).view(np.uint64) + _P5 + np.uint64(8)
        h = h ^ (_rotl(keys.view(np.uint64) * _P2, 31) * _P1)
        h = _rotl(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


@dataclass(frozen=True)
class Shape:
    order: int
    bits: int
    slot_bits: int = 21

    def fitted(self, n: int) -> Shape:
        """With slots for ``n`` distinct n-grams, ``slot_bits`` at least."""
        return replace(self, slot_bits=min(63, max(self.slot_bits, n.bit_length() + SPARE)))

    def slots(self, m: int, keys: np.ndarray) -> np.ndarray:
        """The slots that ``slot`` gives."""
        return self.narrow(hash_longs(keys, hash_longs(np.array([m]), 42)) >> np.uint64(64 - self.slot_bits))

    def narrow(self, slots: np.ndarray) -> np.ndarray:
        return slots.astype(np.uint32 if self.slot_bits <= 32 else np.uint64)

    def mask(self, n: int) -> int:
        return (1 << (self.bits * n)) - 1

    def classes(self, codes: np.ndarray) -> np.ndarray:
        """Class numbers 1.. of code points; 0 stands before a text.  Rare scripts share classes."""
        half = 1 << (self.bits - 1)
        out = codes.astype(np.int64) + 1
        high = codes >= half - 1
        if high.any():
            out[high] = half + codes[high] % half
        return out

    def keys(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all n-grams that end at a character of ``texts``, and the number of characters of each text."""
        pad = self.order - 1
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        # pad places before each text, of class 0: code points of the joined texts move up by the pads before them
        codes = np.frombuffer(("\0" * pad).join(["", *texts]).encode("utf-32-le", "surrogatepass"), "<u4")
        cls = self.classes(codes)
        real = np.ones(len(codes), bool)
        first = np.cumsum(sizes + pad) - sizes
        for k in range(1, pad + 1):
            real[first - k] = False
        cls[~real] = 0
        keys = cls.copy()
        for k in range(1, self.order):
            keys[k:] |= cls[:-k] << (self.bits * k)
        return keys[real], sizes

    def word_keys(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys whose context does not reach back over the start of a word.

        A word is a run of non-space characters with the blank after it (one is put after each text).  Returns the keys
        of all characters, the index of each word's first, and of each text's first word.
        """
        codes = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
        cls = self.classes(codes)
        blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
        first = np.r_[True, blank[:-1]]
        at = np.arange(len(codes))
        within = np.minimum(at - np.maximum.accumulate(np.where(first, at, 0)), self.order - 1)
        keys = cls.copy()
        for k in range(1, self.order):
            keys[k:] |= np.where(within[k:] >= k, cls[:-k] << (self.bits * k), 0)
        starts = np.flatnonzero(first)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        return keys, starts, np.searchsorted(starts, np.r_[0, ends[:-1]])


class Counter:
    """Counts of (model, key) in a task; handed on in parts, so that memory is bounded."""

    SCHEMA = "m long, key long, n long"
    ARROW = pa.schema([("m", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])

    def __init__(self, most: int = 750_000):
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held, self.most = 0, most

    def add(self, m: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys):
            found = np.unique(keys, return_counts=True)
            self.parts.setdefault(m, []).append(found)
            self.held += len(found[0])
        if self.held > self.most:
            self.parts = {m: [self._merge(p)] for m, p in self.parts.items()}
            self.held = sum(len(p[0][0]) for p in self.parts.values())
            if self.held > self.most // 2:
                yield from self.flush()

    @staticmethod
    def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        if len(parts) == 1:
            return parts[0]
        keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)

    def flush(self) -> Iterator[pa.RecordBatch]:
        for m, parts in self.parts.items():
            keys, n = self._merge(parts)
            for at in range(0, len(keys), 65536):
                k = keys[at : at + 65536]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), m)), pa.array(k), pa.array(n[at : at + 65536])], schema=self.ARROW)
        self.parts, self.held = {}, 0


def _discounts(grams: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts d1..d3 of each model from its counts of counts (one row for each model)."""
    n = [F.sum((F.col("n") == k).cast("double")).alias(f"t{k}") for k in (1, 2, 3, 4)]
    y = "(t1 / (t1 + 2 * t2))"
    d = grams.groupBy("m").agg(*n)
    fair = lambda k, e, other: f"CASE WHEN t{k} > 0 AND t{k + 1} > 0 THEN least({k - 0.05}d, greatest(0.1d, {e})) ELSE {other}d END AS d{k}"
    return d.selectExpr("m AS dm", fair(1, f"1 - 2 * {y} * t2 / t1", 0.7), fair(2, f"2 - 3 * {y} * t3 / t2", 1.1), fair(3, f"3 - 4 * {y} * t4 / t3", 1.4))


def discounted(grams: DataFrame, shape: Shape) -> DataFrame:
    """grams (m, key, n), a written table, with ``own`` = max(n - D(n), 0) / n(context) and ``rest``, the context's weight of the lower order."""
    part = f"over (partition by m, shiftright(key, {shape.bits}))"
    d = "CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END"
    known = rows_table(grams.sparkSession, [tuple(r) for r in _discounts(grams).collect()], "dm long, d1 double, d2 double, d3 double")
    with_d = grams.join(F.broadcast(known), F.col("m") == F.col("dm")).selectExpr("m", "key", "n", f"{d} as d")
    return with_d.selectExpr("m", "key", "n", f"(n - d) / sum(n) {part} as own", f"sum(d) {part} / sum(n) {part} as rest")


def continuations(grams: DataFrame, shape: Shape, n: int) -> DataFrame:
    """Counts of order ``n``: in how many of the distinct (m, key) of order n + 1 an n-gram ends.  Written down, so that plans grow by one join for each order."""
    return materialize(grams.groupBy("m", F.col("key").bitwiseAND(F.lit(shape.mask(n))).alias("key")).agg(F.count(F.lit(1)).alias("n")), "continuations")


def interpolated(own: DataFrame, down: DataFrame | None, shape: Shape, n: int) -> DataFrame:
    """(m, key, n, p, rest) of order ``n`` from its ``discounted`` counts and the probabilities ``down`` (m, key, p) of the order below."""
    if down is None:
        return own.selectExpr("m", "key", "n", f"own + rest / {1 << shape.bits}d as p", "rest")
    low = own.withColumn("low", F.col("key").bitwiseAND(F.lit(shape.mask(n - 1))))
    return low.join(down.selectExpr("m", "key as low", "p as q"), ["m", "low"]).selectExpr("m", "key", "n", "own + rest * q as p", "rest")


def kneser_ney(grams: DataFrame, shape: Shape, n: int) -> list[DataFrame]:
    """(m, key, n, p, rest) of the orders 1 to ``n``; grams (m, key, n), a written table: the counts of order n."""
    counts = [grams]
    for k in range(n - 1, 0, -1):
        counts.append(continuations(counts[-1], shape, k))
    out: list[DataFrame] = []
    for k, c in enumerate(reversed(counts), 1):
        out.append(interpolated(discounted(c, shape), out[-1] if out else None, shape, k))
    return out


def lower(grams: DataFrame, shape: Shape, n: int) -> DataFrame:
    """(m, key, p): interpolated probabilities of order ``n`` by continuation counts; ``grams``: the distinct (m, key) of order n + 1."""
    return kneser_ney(continuations(grams, shape, n), shape, n)[-1].select("m", "key", "p")


def slot(m: str, key: str, shape: Shape) -> Column:
    return F.expr(f"shiftrightunsigned(xxhash64({m}, {key}), {64 - shape.slot_bits})")


class HashArrays:
    """A table n-gram -> value: hashes sorted, found by binary search.

    ``below`` is the table of the next lower order, ``rest`` the logarithm of each context's weight of that order, and ``floor`` that
    of the probability of a character never seen in a model; without ``below`` what the table lacks has no value.
    """

    def __init__(self, slots: np.ndarray, values: np.ndarray, shape: Shape, below: HashArrays | None = None, rest: HashArrays | None = None, floor: dict[int, float] | None = None):
        order = np.argsort(slots, kind="stable")
        self.slots, self.values, self.shape = shape.narrow(slots[order]), values[order].astype(np.float32), shape
        self.below, self.rest, self.floor = below, rest, floor or {}

    @classmethod
    def gather(cls, entries: DataFrame, m: str, key: str, value: str, weight: str, shape: Shape) -> HashArrays:
        """One row for each distinct n-gram, of 12 bytes, reaches the driver; should two share a hash, their mean by ``weight``."""
        rows = entries.groupBy(slot(m, key, shape).alias("slot")).agg((F.sum(F.expr(f"{value} * {weight}")) / F.sum(weight)).alias("v"))
        got = rows.select("slot", F.col("v").cast("float")).toArrow()
        return cls(got.column(0).to_numpy(), got.column(1).to_numpy(), shape)

    def _lookup(self, m: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of distinct keys, and whether the table has them.  Sorted hashes make the search local."""
        if not len(self.slots):
            return np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        want = self.shape.slots(m, keys)
        order = np.argsort(want)
        at = np.empty(len(keys), np.int64)
        at[order] = np.minimum(np.searchsorted(self.slots, want[order]), len(self.slots) - 1)
        return self.values[at], self.slots[at] == want

    def find(self, m: int, keys: np.ndarray, missing: float) -> np.ndarray:
        """The value of each key; each distinct key is looked up once."""
        some, inverse = np.unique(keys, return_inverse=True)
        values, hit = self._lookup(m, some)
        return np.where(hit, values, np.float32(missing))[inverse]

    def log_probability(self, m: int, keys: np.ndarray) -> np.ndarray:
        """Of each key in model ``m``; what an order lacks is left to the order below, with the weight of its context if that was seen."""
        some, inverse = np.unique(keys, return_inverse=True)
        return self._backed_off(m, some)[inverse]

    def _backed_off(self, m: int, keys: np.ndarray) -> np.ndarray:
        values, hit = self._lookup(m, keys)
        miss = np.flatnonzero(~hit)
        if len(miss):
            lost = keys[miss]
            if self.below is None:
                values[miss] = self.floor.get(m, -self.shape.bits * np.log(2))
            else:
                values[miss] = self.rest.find(m, lost >> self.shape.bits, 0.0) + self.below.log_probability(m, lost & self.shape.mask(self.below.shape.order))
        return values
