"""Exact n-gram Jaccard join (operator 7) over hashed token groups with a count-vector R-tree.

1. Texts with equal shingle sets form classes; one class stands for all its copies, so a large group of copies
   costs one row for each task that meets it.
2. Shingles are hashed into m groups.  Two sets that link differ in at most d shingles, so at least m - d groups are equal in both.
   With m > d + SPARE every class emits (group, contents) as block keys, and linked classes meet in a block.  m depends
   on a size band, and is larger where more than SPARE groups would often be empty; a class near a band's lower edge also emits the keys of the band below.
3. Blocks of two or more classes are joined.  First each class with the block's smallest one; what that links needs no further pairs.
   Members that are still in different components are joined by an R-tree over their group counts (about as many coordinates as members; of two vectors the finer is folded to the coarser), which is
   loaded in the order of a block's components and set sizes: boxes of ``BOX`` points, leaves of ``LEAF`` points, and nodes of
   ``FAN`` leaves or nodes above.  A box keeps the largest value of each coordinate and the range of sizes; two boxes, or a box and a point,
   can overlap by at most the sum of the coordinate minima, and what cannot reach the needed overlap is not descended into.  Leaves are numbered
   within ranges and dealt to tasks one by one, so a large block is no single task.
   A leaf in which many pairs survive (a group of near copies) is searched with its whole sets at hand: what links joins components at once, and
   pairs of one component are passed over, so no pairs within a group are written.
4. Surviving pairs are verified on their whole sets, and links are closed to components.

Whole sets are made again from the texts of their classes where they are compared: a text takes less than half the disk of its hashes.  What shuffles
block keys, texts or count vectors goes in ``PASSES`` parts where its own rows are many, so only a share of them is on disk at a time; up to ``ONE_PASS`` block keys
(some 256 MB), or a ``WIDE``-th of that in rows with a text or vector, one part is enough, as each part costs a round of tasks and the driver its plans.
Of the sets only those that a step compares are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, drop_table, hashed_words, materialize, mix, rows_of, small
from .graph import components

SPARE = 4
#: coordinates of a count vector: as many as a set has members, within these bounds (a power of two)
GROUPS = 64, 4096
#: a step with more than ``ONE_PASS`` block keys to shuffle takes so many parts, each its share; a row with a text or a count vector counts as ``WIDE`` keys
PASSES, ONE_PASS, WIDE = 4, 1 << 24, 64
BOX, LEAF, FAN, LEVELS, MANY = 16, 512, 32, 3, 4
_K = mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)
_SIG = "doc_id long, n long, cls long"
_SIG_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64())])
_KEY = "key long, cls long"
_KEY_ARROW = pa.schema([("key", pa.int64()), ("cls", pa.int64())])
_BLOCK = "key long, cls long, lo long"
_SET_ARROW = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("counts", pa.binary()), ("text", pa.binary())])


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer words is one shingle, one without words none."""
    hashes, _, _, counts = hashed_words(texts)
    with np.errstate(over="ignore"):
        at = 0
        for n in counts.tolist():
            h = hashes[at : at + n]
            at += n
            if n >= words:
                k = n - words + 1
                yield np.unique(mix(sum(h[i : i + k] * _K[i] for i in range(words))))
            elif n:
                yield mix((h * _K[:n]).sum(keepdims=True) + np.uint64(n))
            else:
                yield h


def class_of(s: np.ndarray) -> int:
    """Number of the class of a set: a 64-bit hash of its members and size."""
    with np.errstate(over="ignore"):
        return int(mix(mix(s ^ _K[7]).sum(keepdims=True) + np.uint64(len(s)) * _K[6])[0].astype(np.int64))


class Bands:
    """Size bands and their numbers of groups for a threshold num/den."""

    def __init__(self, num: int, den: int, ratio: float = 1.5):
        self.num, self.den, self.ratio = num, den, ratio
        self.edges = [1]

    def of(self, n: int) -> int:
        while self.edges[-1] <= n:
            self.edges.append(max(self.edges[-1] + 1, int(np.ceil(self.edges[-1] * self.ratio))))
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def differences(self, band: int) -> int:
        """Most shingles in which two linked sets can differ when the smaller is in the band."""
        self.of(self.edges[-1]) if len(self.edges) < band + 2 else None
        a = self.edges[band + 1] - 1
        return (a + a * self.den // self.num) * (self.den - self.num) // (self.den + self.num)

    def groups(self, band: int) -> int:
        """Groups of a band's sets: so many that its smallest sets nearly all fill more groups than can differ, as an empty group is
        a block of a share of all sets.  Where no such number is below twice the differences, the least that is exact."""
        d, n = self.differences(band), self.edges[band]
        m = d + 1 + SPARE
        while m <= 2 * (d + SPARE):
            empty = m * np.exp(-n / m)
            if m - empty - 3 * np.sqrt(empty) > d:
                return m
            m += max(1, m // 32)
        return d + 1 + SPARE

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Block keys of a set."""
        n = len(s)
        own = self.of(n)
        out = []
        for band in (own, own - 1):
            if band < 0 or band < own and -(-n * self.num // self.den) >= self.edges[own]:
                continue
            d = self.differences(band)
            if not d:
                continue  # only equal sets can link: a class already
            m = self.groups(band)
            with np.errstate(over="ignore"):
                spread = mix(s ^ _K[4])
                group = ((spread >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
                sums = np.zeros(m, np.uint64)
                np.add.at(sums, group.astype(np.int64), mix(s ^ _K[5]))
                keys = mix(mix(sums + np.uint64(band) * _K[3]) + np.arange(m, dtype=np.uint64))
            full = np.bincount(group.astype(np.int64), minlength=m) > 0
            # with more than d full groups one of them is equal in any linked set; only with fewer do empty groups count
            out.append(keys[full] if full.sum() > d else keys)
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _chunks(batches: Iterator[pa.RecordBatch], name: str = "doc_id", size: int = 1 << 20) -> Iterator[tuple[list, list[bytes]]]:
    ids, texts, held = [], [], 0
    for doc_id, text in rows_of(batches, name, "text"):
        ids.append(doc_id)
        texts.append(text.encode("utf-8", "surrogatepass").lower())  # bytes: A-Z only
        held += len(texts[-1])
        if held >= size:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches):
            sets = list(shingle_sets(texts, words))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())], schema=_SIG_ARROW)

    return docs.mapInArrow(each, _SIG)


def _keys(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Block keys of every class, once for each task that meets it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        for _, texts in _chunks(batches):
            keys, classes = [], []
            for s in shingle_sets(texts, words):
                if len(s) and (c := class_of(s)) not in seen:
                    seen.add(c)
                    keys.append(bands.keys(s).view(np.int64))
                    classes.append(np.full(len(keys[-1]), c))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(classes))], schema=_KEY_ARROW)

    return docs.mapInArrow(each, _KEY)


def _shared(keys: DataFrame) -> DataFrame:
    """(key, cls, lo), once each, of the rows of keys (key, cls) whose block has two or more classes; lo is the smallest of them.

    One shuffle for all three; the rows of a block go by in batches, and only its last one is kept.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = last = lo = None  # of the row before
        alone = True  # that row is the first of its block and not written yet
        for batch in batches:
            if not batch.num_rows:
                continue
            k, c = (batch.column(i).to_numpy() for i in (0, 1))
            if key is not None:
                k, c = np.r_[key, k], np.r_[last, c]
            new = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]
            k, c = k[new], c[new]
            first = np.r_[True, k[1:] != k[:-1]]
            low = c[np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))]
            if key is not None:
                low[: np.searchsorted(k, key, "right")] = lo
            out = ~first
            out[:-1] |= ~first[1:]
            out[0] &= alone
            if len(k) > 1:
                alone = bool(first[-1])
            key, last, lo = k[-1], c[-1], low[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (k, c, low)], names=["key", "cls", "lo"])

    return keys.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(each, _BLOCK)


def _sets(chosen: DataFrame, words: int) -> DataFrame:
    """(cls, n, counts, text) of the rows of (cls, text) whose set is of that class: points of the R-tree, and lower-case texts from which ``whole_sets`` are made.

    A class has one document; its equal rows come to one task (or give the same set twice, which changes no link).
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for classes, texts in _chunks(batches, "cls"):
            rows = []
            for c, text, s in zip(classes, texts, shingle_sets(texts, words), strict=True):
                if len(s) and c not in seen and class_of(s) == c:
                    seen.add(c)
                    rows.append((c, len(s), count_vector(s), text))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SET_ARROW, strict=True)], schema=_SET_ARROW)

    return chosen.mapInArrow(each, "cls long, n long, counts binary, text binary")


def whole_sets(classes: list[int], texts: list[bytes], words: int) -> dict[int, np.ndarray]:
    """The set of each class, made once."""
    known = dict(zip(classes, texts, strict=True))
    return dict(zip(known, shingle_sets(list(known.values()), words), strict=True))


def count_vector(s: np.ndarray) -> bytes:
    """How many members of a set fall into each group (by the upper bits of a hash); the first byte is the bytes of a count."""
    bits = min(GROUPS[1].bit_length(), max(GROUPS[0].bit_length(), len(s).bit_length())) - 1
    return _packed(np.bincount((mix(s) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits))


def _packed(counts: np.ndarray) -> bytes:
    size = 1 if counts.max() < 1 << 8 else 2 if counts.max() < 1 << 16 else 4
    return bytes([size]) + counts.astype(f"<u{size}").tobytes()


def _counts(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1)


def _folded(counts: np.ndarray, n: int) -> np.ndarray:
    """With ``n`` coordinates: neighbours are added up."""
    return counts if len(counts) == n else counts.reshape(n, -1).sum(axis=1, dtype=np.int64)


def _points(rows) -> np.ndarray:  # noqa: ANN001
    """Count vectors, one a row, with the coordinates of the coarsest."""
    some = [_counts(r) for r in rows]
    n = min(map(len, some))
    some = [_folded(c, n) for c in some]
    return np.stack(some).astype("<u2" if max(int(c.max()) for c in some) < 1 << 16 else "<u4")


def _bound(x: bytes, y: bytes) -> int:
    """The most that two sets can have in common: the sum of the coordinate minima."""
    x, y = _counts(x), _counts(y)
    n = min(len(x), len(y))
    return int(np.minimum(_folded(x, n), _folded(y, n)).sum(dtype=np.int64))


def _verify(pairs: DataFrame, sets: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Those of pairs (a, b) of classes, a written table, that link: the bound on group counts first, then the whole sets."""

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.table(batch)
            need = num * (t["na"].to_numpy() + t["nb"].to_numpy())
            ok = [(den + num) * _bound(x, y) >= n for x, y, n in zip(t["ca"].to_pylist(), t["cb"].to_pylist(), need.tolist(), strict=True)]
            yield from t.select(["a", "b"]).filter(pa.array(ok, pa.bool_())).to_batches()

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                t = pa.table(batch.slice(at, 256))
                a, b = t["a"].to_pylist(), t["b"].to_pylist()
                whole = whole_sets(a + b, t["ta"].to_pylist() + t["tb"].to_pylist(), words)
                good = [_linked(whole[x], whole[y], num, den) for x, y in zip(a, b, strict=True)]
                yield from t.select(["a", "b"]).filter(pa.array(good, pa.bool_())).to_batches()

    sizes = lambda x: sets.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"))
    alike = materialize(pairs.join(sizes("a"), "a").join(sizes("b"), "b").where(f"{num} * greatest(na, nb) <= {den} * least(na, nb)"), "pairs-of-like-size")

    def needed(mine: DataFrame, column: str) -> DataFrame:
        """The sets of the classes of some pairs, so that no others are shuffled."""
        ends = materialize(mine.select(F.col("a").alias("cls")).union(mine.select("b")).distinct(), "ends")
        return sets.select("cls", column).join(small(ends), "cls", "left_semi")

    def first(part: Callable[[str], F.Column]) -> DataFrame:
        mine = alike.where(part("a"))
        need = needed(mine, "counts")
        point = lambda x: need.select(F.col("cls").alias(x), F.col("counts").alias(f"c{x}"))
        return mine.join(point("a").where(part("a")), "a").join(point("b"), "b").mapInArrow(may, "a long, b long")

    near = _in_passes(first, "near-pairs", _parts(2 * WIDE * alike.count()))

    def step(part: Callable[[str], F.Column]) -> DataFrame:
        mine = near.where(part("b"))
        need = needed(mine, "text")
        whole = lambda x: need.select(F.col("cls").alias(x), F.col("text").alias(f"t{x}"))
        return mine.join(whole("a"), "a").join(whole("b").where(part("b")), "b").select("a", "b", "ta", "tb").mapInArrow(links, "a long, b long")

    return _in_passes(step, "links-of-pairs", _parts(2 * WIDE * near.count()))


def _with_sets(rows: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """rows, a written table with cls, and columns of their sets; no other sets are shuffled."""
    sets = sets.select("cls", *columns)
    few = small(rows, 1 << 16)
    if few is not rows:
        return sets.join(few, "cls")
    return rows.join(sets.join(small(materialize(rows.select("cls").distinct(), "needed")), "cls", "left_semi"), "cls")


def _parts(keys: int) -> int:
    """In how many parts a step shuffles what counts as so many block keys."""
    return 1 if keys <= ONE_PASS else PASSES


def _in_passes(step: Callable[[Callable[[str], F.Column]], DataFrame], tag: str, passes: int) -> DataFrame:
    """The rows of ``step`` over all parts of its input, one after the other; it gets a filter on a column of integers.  ``parts``: the tables written."""
    part = lambda k: lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), passes) == k if passes > 1 else F.lit(True)
    parts = [materialize(step(part(k)), tag) for k in range(passes)]
    out = reduce(DataFrame.union, parts)
    out.parts = parts
    return out


class CountTree:
    """Boxes over the points of a leaf: arrays of count vectors, set sizes, components and class numbers."""

    def __init__(self, counts: np.ndarray, n: np.ndarray, root: np.ndarray, cls: np.ndarray):
        parts, open_ = [], [np.arange(len(n))]
        while open_:  # halved along the coordinate of the largest spread
            at = open_.pop()
            if len(at) <= BOX:
                parts.append(at)
                continue
            axis = int(counts[at].var(axis=0).argmax())
            order = at[np.argsort(counts[at, axis], kind="stable")]
            open_ += [order[len(order) // 2 :], order[: len(order) // 2]]
        order = np.concatenate(parts)
        self.counts, self.n, self.root, self.cls = counts[order], n[order], root[order], cls[order]
        self.ends = np.cumsum([len(x) for x in parts])
        first = self.ends - [len(x) for x in parts]
        self.first, self.high = first, np.maximum.reduceat(self.counts, first, axis=0)
        self.small, self.large = np.minimum.reduceat(self.n, first), np.maximum.reduceat(self.n, first)

    def partners(self, c: np.ndarray, n: int, root: int, num: int, den: int, after: int = -1) -> np.ndarray:
        """Places (beyond ``after``) of points of other components that a point may link with."""
        open_ = np.flatnonzero((self.ends > after + 1) & (num * n <= den * self.large) & (num * self.small <= den * n))
        if len(self.ends) > 1 and len(open_):
            bound = np.minimum(c, self.high[open_]).sum(axis=1, dtype=np.int64)
            open_ = open_[(den + num) * bound >= num * (n + self.small[open_])]
        if not len(open_):
            return open_
        at = np.concatenate([np.arange(max(a, after + 1), e) for a, e in zip(self.first[open_].tolist(), self.ends[open_].tolist(), strict=True)])
        at = at[(self.root[at] != root) & (num * np.maximum(self.n[at], n) <= den * np.minimum(self.n[at], n))]
        return at[(den + num) * np.minimum(c, self.counts[at]).sum(axis=1, dtype=np.int64) >= num * (n + self.n[at])]

    def pairs(self, num: int, den: int, other: CountTree | None = None) -> Iterator[tuple[int, int]]:
        """Pairs of classes (smaller first) of this leaf, or of this leaf and another, that sizes, components and the bound leave."""
        for i in range(len(self.n)):
            tree = other or self
            for k in tree.partners(self.counts[i], int(self.n[i]), int(self.root[i]), num, den, -1 if other else i).tolist():
                a, b = int(self.cls[i]), int(tree.cls[k])
                yield min(a, b), max(a, b)


def _leaves(members: DataFrame) -> DataFrame:
    """members (key, cls, root, n) with ``leaf``: at most LEAF members of one block that follow each other by component and size.

    Ranges of all members are numbered in parallel; a block may go on over several ranges.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, held, key = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            keys, leaves = batch.column(0).to_numpy(), np.zeros(batch.num_rows, np.int64)
            cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)].tolist()
            for a, e in zip(cuts, cuts[1:], strict=False):
                if a == e:
                    continue
                if keys[a] != key:
                    leaf, held, key = leaf + (key is not None and held > 0), 0, keys[a]
                place = held + np.arange(e - a)
                leaves[a:e] = leaf + place // LEAF
                leaf, held = leaf + (held + e - a) // LEAF, (held + e - a) % LEAF
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves)], names=["key", "cls", "root", "n", "leaf"])

    return members.repartitionByRange("key", "root", "n", "cls").sortWithinPartitions("key", "root", "n", "cls").mapInArrow(number, "key long, cls long, root long, n long, leaf long")


def _trees(*leaves: list[tuple]) -> list[CountTree]:
    """Of lists of (counts, n, root, cls)."""
    counts, at, out = _points([r[0] for rows in leaves for r in rows]), 0, []
    for rows in leaves:
        n, root, cls = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
        out.append(CountTree(counts[at : at + len(rows)], n, root, cls))
        at += len(rows)
    return out


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return den * common >= num * (len(x) + len(y) - common)


def _spanning(pairs: Iterator[tuple[int, int]], root: dict[int, int], sets: dict[int, np.ndarray], num: int, den: int) -> Iterator[tuple[int, int]]:
    """Those of pairs that link and join two components, as they are by then: fewer than there are classes."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = x = up.get(up[x], up[x])
        return x

    for a, b in pairs:
        x, y = find(root[a]), find(root[b])
        if x != y and _linked(sets[a], sets[b], num, den):
            up[max(x, y)] = min(x, y)
            yield a, b


def _dense(points: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that span the components within each leaf of points (leaf, cls, root, n, counts, text): for leaves in which many may link."""

    def search(df: pd.DataFrame) -> pd.DataFrame:
        [tree] = _trees(list(zip(*[df[c].tolist() for c in ("counts", "n", "root", "cls")], strict=True)))
        sets = whole_sets(df["cls"].tolist(), df["text"].tolist(), words)
        return pd.DataFrame(list(_spanning(tree.pairs(num, den), dict(zip(df["cls"].tolist(), df["root"].tolist(), strict=True)), sets, num, den)), columns=["a", "b"]).astype("int64")

    return points.groupBy("leaf").applyInPandas(search, "a long, b long")


def _within(points: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, dense) within each leaf of points (leaf, cls, root, n, counts), which are dealt by leaf; a leaf with more than ``MANY``
    pairs for each point gives its number as ``dense`` instead."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        known: set[tuple[int, int]] = set()

        def flush() -> pa.RecordBatch:
            found = set(islice(_trees(held)[0].pairs(num, den), MANY * len(held) + 1))
            if len(found) > MANY * len(held):
                return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (None, None, at)], names=["a", "b", "dense"])
            found -= known
            known.update(found if len(known) < 1_000_000 else ())
            return pa.RecordBatch.from_arrays([*[pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], pa.nulls(len(found), pa.int64())], names=["a", "b", "dense"])

        at = None
        for leaf, *row in rows_of(batches, "leaf", "counts", "n", "root", "cls"):
            if held and leaf != at:
                yield flush()
                held = []
            at = leaf
            held.append(tuple(row))
        if held:
            yield flush()

    return points.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(search, "a long, b long, dense long")


def _boxes(points: DataFrame) -> DataFrame:
    """(key, leaf, lo, hi, r0, r1, box): sizes, components and largest counts of each leaf."""

    def bounds(df: pd.DataFrame) -> pd.DataFrame:
        box = _packed(_points(df["counts"]).max(axis=0))
        return pd.DataFrame([(df["key"].iloc[0], df["leaf"].iloc[0], df["n"].min(), df["n"].max(), df["root"].min(), df["root"].max(), box)], columns=["key", "leaf", "lo", "hi", "r0", "r1", "box"])

    return points.groupBy("key", "leaf").applyInPandas(bounds, "key long, leaf long, lo long, hi long, r0 long, r1 long, box binary")


def _between(leaves: DataFrame, sets: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that span the components of two leaves of one block, for leaves (key, leaf, cls, root, n) of blocks of several leaves: the tree above the leaves, from its top down."""
    levels = [_in_passes(lambda part: _boxes(leaves.where(part("leaf")).join(sets.select("cls", "counts"), "cls")), "boxes", _parts(WIDE * leaves.count()))]
    for _ in range(LEVELS - 1):
        up = levels[-1].withColumn("leaf", F.expr(f"leaf div {FAN}"))

        def joined(df: pd.DataFrame) -> pd.DataFrame:
            box = _packed(_points(df["box"]).max(axis=0))
            return pd.DataFrame([(df["key"].iloc[0], df["leaf"].iloc[0], df["lo"].min(), df["hi"].max(), df["r0"].min(), df["r1"].max(), box)], columns=df.columns)

        levels.append(materialize(up.groupBy("key", "leaf").applyInPandas(joined, up.schema), "nodes"))

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.table(batch)
            for lo in range(0, t.num_rows, 1024):
                part = t.slice(lo, 1024)
                need = num * (part["lox"].to_numpy() + part["loy"].to_numpy())
                ok = [(den + num) * _bound(x, y) >= n for x, y, n in zip(part["boxx"].to_pylist(), part["boxy"].to_pylist(), need.tolist(), strict=True)]
                yield from part.select(["key", "leafx", "leafy"]).filter(pa.array(ok, pa.bool_())).to_batches()

    pairs: DataFrame | None = None
    for level in reversed(levels):
        x, y = (level.select(*[F.col(c).alias(c if c == "key" else f"{c}{s}") for c in level.columns]) for s in "xy")
        if pairs is None:
            both = x.join(y, "key")
        else:
            both = pairs.join(x.withColumn("upx", F.expr(f"leafx div {FAN}")), ["key", "upx"]).join(y.withColumn("upy", F.expr(f"leafy div {FAN}")), ["key", "upy"])
        apart = "not (r0x = r1x and r0y = r1y and r0x = r0y)"  # all of one component
        near = both.where(f"leafx <= leafy and {num} * lox <= {den} * hiy and {num} * loy <= {den} * hix and {apart}").mapInArrow(open_, "key long, leafx long, leafy long")
        pairs = materialize(near, "node-pairs").select("key", F.col("leafx").alias("upx"), F.col("leafy").alias("upy"))
    matched = pairs.where("upx < upy").select(F.col("upx").alias("leafx"), F.col("upy").alias("leafy"))

    def search(both: pd.DataFrame) -> pd.DataFrame:
        x, y = _trees(*[list(zip(*[d[c].tolist() for c in ("counts", "n", "root", "cls")], strict=True)) for d in (both[both["side"] == s] for s in "xy")])
        whole = whole_sets(both["cls"].tolist(), both["text"].tolist(), words)
        return pd.DataFrame(list(_spanning(x.pairs(num, den, y), dict(zip(both["cls"].tolist(), both["root"].tolist(), strict=True)), whole, num, den)), columns=["a", "b"]).astype("int64")

    def step(part: Callable[[str], F.Column]) -> DataFrame:
        mine = matched.where(part("leafx"))
        sides = [mine.join(leaves.withColumnRenamed("leaf", f"leaf{s}"), f"leaf{s}").select("leafx", "leafy", "cls", "n", "root", F.lit(s).alias("side")) for s in "xy"]
        met.append(materialize(sides[0].union(sides[1]), "leaf-pairs"))
        return _with_sets(met[-1], sets, "counts", "text").groupBy("leafx", "leafy").applyInPandas(search, "a long, b long")

    met: list[DataFrame] = []
    out = _in_passes(step, "links-between", _parts(2 * LEAF * WIDE * matched.count()))
    _drop(*met)
    return out


def _tree_pairs(members: DataFrame, sets: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) of members (key, cls, root) of one block and different components that the bound leaves.

    Blocks of one component have nothing to add, and of blocks with the same members one is enough.
    """
    one = members.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.min("cls").alias("c0"), F.max("cls").alias("c1"))
    mixed = materialize(one.where("r0 < r1 and size > 2").groupBy("size", "x", "c0", "c1").agg(F.min("key").alias("key")).select("key"), "mixed")
    leaves = materialize(_leaves(members.join(mixed, "key").join(sets.select("cls", "n"), "cls").select("key", "cls", "root", "n")), "leaves")
    counts = sets.select("cls", "counts")
    found = _in_passes(lambda part: _within(leaves.where(part("leaf")).join(counts, "cls").select("leaf", "cls", "root", "n", "counts"), num, den), "tree-pairs", _parts(WIDE * leaves.count()))
    out = found.where("dense is null").select("a", "b")
    dense = materialize(found.where("dense is not null").select(F.col("dense").alias("leaf")), "dense-leaves")
    if not dense.isEmpty():
        mine = materialize(leaves.join(small(dense), "leaf"), "dense-members")
        out = out.union(_in_passes(lambda part: _dense(_with_sets(mine.where(part("leaf")), sets, "counts", "text"), words, num, den), "dense-links", _parts(WIDE * mine.count())))
    several = materialize(leaves.groupBy("key").agg(F.min("leaf").alias("l0"), F.max("leaf").alias("l1")).where("l0 < l1").select("key"), "large-blocks")
    if not several.isEmpty():
        out = out.union(_between(materialize(leaves.join(several, "key"), "large-blocks-leaves"), sets, words, num, den))
    return out.distinct()


def _drop(*tables: DataFrame) -> None:
    for t in tables:
        drop_table(t)


def jaccard_components(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of (doc_id, text): sets of ``words``-word shingles that
    link when den * |intersection| >= num * |union|; the component's id is its smallest doc_id.

    Words are runs without ASCII white space, A-Z lower-cased.  Fewer words than a shingle make one shingle; a
    text without words (null, empty, blank) has an empty set and its own component.  Repeated rows of one doc_id stay, each with its
    own set; a component's id is then still its smallest doc_id.  Null ids are kept, and are never a component's id unless it has no other.
    """
    docs = doc_text(docs)
    sig = materialize(_signatures(docs, words), "signatures")
    keys = materialize(_keys(docs, words, num, den), "block-keys")
    blocks = _in_passes(lambda part: _shared(keys.where(part("key"))), "blocks", _parts(keys.count()))
    _drop(keys)
    present = blocks.select("cls").distinct()
    chosen = materialize(sig.groupBy("cls").agg(F.min("doc_id").alias("doc_id")).join(present, "cls", "left_semi"), "chosen")
    few = small(chosen)  # else all texts would be shuffled for them
    sets = _in_passes(lambda part: _sets(docs.where(part("doc_id")).join(few.where(part("doc_id")), "doc_id").select("cls", "text"), words), "sets", _parts(WIDE * chosen.count()))
    pairs = materialize(blocks.where("lo < cls").select(F.col("lo").alias("a"), F.col("cls").alias("b")).distinct(), "star-pairs")
    star = _verify(pairs, sets, words, num, den)
    roots = components(star)
    members = blocks.join(roots, blocks["cls"] == roots["v"], "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
    rest = _verify(materialize(_tree_pairs(members, sets, words, num, den), "tree-pairs"), sets, words, num, den)
    _drop(chosen, pairs, *blocks.parts, *sets.parts)
    final = components(star.union(rest))
    # written down, so that a large component's rows can be split where they are joined
    grouped = materialize(sig.join(final, sig["cls"] == final["v"], "left").select("doc_id", "n", F.coalesce("root", "cls").alias("part")), "parts")
    ids = materialize(grouped.where("part is not null").groupBy("part").agg(F.min("doc_id").alias("component_id")), "component-ids")
    return grouped.join(ids, "part", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
