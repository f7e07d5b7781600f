"""Removal of repeated passages across documents (operator 4).

A window is ``width`` consecutive words of one document.  A word goes if a window that covers it also
starts in a document with a smaller doc_id.

Documents are dealt into chunks of about ``CHUNK`` bytes, in input order; all counts are combined within a chunk before they are shuffled, so
a passage that every document holds costs one row a chunk.

1. Anchors: in every window the ``ANCHOR``-word sequence with the smallest hash.  Equal windows have equal anchors, and neighbouring
   windows mostly share one, so an anchor stands for several windows.  Anchors of one document only are ruled out.
2. Windows at the remaining anchors are hashed, with the words before and after them.  Those of two or more documents recur, and the smallest
   document that has one is its source.
3. Confirmed passages: recurring windows that follow one another in the source are one passage as long as neither is ever seen without the
   other (one word after the first everywhere, one word before the second), so each occurrence of a window of a passage lies in
   an occurrence of the whole passage.  Passages are cut out of their sources' texts.
4. Each chunk is a shard: the passages that may occur in it (it holds a window of theirs) are compiled into one Aho-Corasick automaton, and every document of the chunk, whatever is
   known of it, is streamed through.  An occurrence in a document with a larger id than the passage's source goes.

Hashes choose what is compiled where; what is removed has been located as text.  64-bit hashes stand for anchors and windows, 32-bit ones for the words beside a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, hashed_words, materialize, rolling

#: words of an anchor: longer ones are more numerous and less often common to documents without a common window
ANCHOR = 6
#: bytes of text in a chunk (a longer document is a chunk): more passages and anchors are common to its documents, and it is held in memory by a task
CHUNK = 1 << 21
_LOW = np.int64(0xFFFFFFFF)
_DOCS = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string())])
_ANCHORS = pa.schema([("anchor", pa.int64()), ("chunk", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
_WINDOWS = pa.schema([("window", pa.int64()), ("chunk", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("varied", pa.int64())])
_PASSAGES = pa.schema([("window", pa.int64()), ("source", pa.int64()), ("passage", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


class Words:
    """Hashed words of the documents of a chunk, and the windows in them."""

    def __init__(self, ids: list[int | None], texts: list[bytes], width: int):
        self.hashes, self.starts, self.ends, counts = hashed_words(texts)
        doc = np.repeat(np.arange(len(texts)), counts)
        known = np.array([i is not None for i in ids], bool)
        n = max(len(doc) - width + 1, 0)
        #: first words of all windows: within one document that has an id
        self.at = np.flatnonzero((doc[:n] == doc[width - 1 : width - 1 + n]) & known[doc[:n]])
        self.doc = np.array([0 if i is None else i for i in ids], np.int64)[doc[self.at]]
        self.first = np.cumsum(counts) - counts
        self.index, self.last, self.width = doc, np.cumsum(counts) - 1, width

    def anchors(self) -> np.ndarray:
        """Hash of the anchor of each window."""
        r = rolling(self.hashes, ANCHOR, 1)
        best = r[self.at]
        for k in range(1, self.width - ANCHOR + 1):
            best = np.minimum(best, r[self.at + k])
        return best.view(np.int64)

    def windows(self, which: np.ndarray) -> np.ndarray:
        return rolling(self.hashes, self.width, 2)[self.at[which]].view(np.int64)

    def beside(self, which: np.ndarray) -> np.ndarray:
        """Hashes of the word before (upper half) and after (lower half) of windows; 0 where the document ends."""
        at = self.at[which]
        doc = self.index[at]
        end = at + self.width - 1
        some = (self.hashes >> np.uint64(32)) | np.uint64(1)
        before = np.where(at > self.first[doc], some[np.maximum(at - 1, 0)], np.uint64(0))
        after = np.where(end < self.last[doc], some[np.minimum(end + 1, len(some) - 1)], np.uint64(0))
        return ((before << np.uint64(32)) | after).view(np.int64)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts keys, the first place of each distinct key in it, and the distinct keys."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return order, first, sorted_[first]


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each key is in ``known`` (sorted); runs of equal keys are looked up once."""
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    some = keys[begin]
    hit = known[np.minimum(np.searchsorted(known, some), len(known) - 1)] == some
    return np.repeat(hit, np.diff(np.r_[begin, len(keys)]))


def _chunked(docs: DataFrame, size: int) -> DataFrame:
    """(chunk, doc_id, text) of all rows of (doc_id, text), in input order."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)) + held
            chunk = at + ends // size  # a new chunk whenever another multiple of its size is reached
            yield pa.RecordBatch.from_arrays([pa.array(chunk), batch.column(0), batch.column(1)], schema=_DOCS)
            held = int(ends[-1]) if len(ends) else held

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(each, _ddl(_DOCS))


def _beside(chunks: DataFrame, more: DataFrame | None, columns: tuple[str, ...]) -> DataFrame:
    """Rows of ``more`` (chunk, columns) and then the documents of each chunk, chunk after chunk."""
    if more is None:
        return chunks
    types = dict(more.dtypes)
    docs = chunks.select("chunk", F.lit(1).alias("kind"), "doc_id", "text", *[F.lit(None).cast(types[c]).alias(c) for c in columns])
    both = docs.unionByName(more.select("chunk", F.lit(0).alias("kind"), *columns), allowMissingColumns=True)
    return both.repartition("chunk").sortWithinPartitions("chunk", "kind")


def _per_chunk(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, list, list[bytes], list[pa.ChunkedArray]]]:
    """(chunk, doc ids, texts, columns of the rows beside them) of every chunk; batches hold chunks in a row."""
    parts: list[pa.RecordBatch] = []

    def flush() -> tuple:
        t = pa.Table.from_batches(parts)
        mine = t.filter(pc.equal(t["kind"], 1)) if columns else t
        other = t.filter(pc.equal(t["kind"], 0)) if columns else t
        return t["chunk"][0].as_py(), mine["doc_id"].to_pylist(), mine["text"].cast(pa.binary()).to_pylist(), [other[c] for c in columns]

    for batch in batches:
        chunk = batch.column(0).to_numpy()
        cuts = np.r_[0, np.flatnonzero(chunk[1:] != chunk[:-1]) + 1, len(chunk)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            if parts and parts[0].column(0)[0].as_py() != int(chunk[a]):
                yield flush()
                parts = []
            parts.append(batch.slice(a, b - a))
    if parts:
        yield flush()


def _anchor_rows(chunks: DataFrame, width: int) -> DataFrame:
    """(anchor, chunk, lo, hi): distinct anchors of every chunk with the smallest and largest document that has them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, texts, _ in _per_chunk(batches, ()):
            w = Words(ids, texts, width)
            order, first, anchors = _groups(w.anchors())
            if len(first):
                doc = w.doc[order]
                yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(np.full(len(anchors), chunk)), pa.array(np.minimum.reduceat(doc, first)), pa.array(np.maximum.reduceat(doc, first))], schema=_ANCHORS)

    return chunks.mapInArrow(each, _ddl(_ANCHORS))


def _window_rows(chunks: DataFrame, marks: DataFrame, width: int) -> DataFrame:
    """(window, chunk, lo, hi, before, after, varied): distinct windows at the marked anchors (chunk, anchor) of every chunk.

    ``before`` and ``after`` have the bits that the hashes of the neighbouring words have in common (two columns of few values, which Parquet
    keeps small), ``varied`` those that any of them has but not all.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, texts, (marked,) in _per_chunk(batches, ("anchor",)):
            if not len(marked):
                continue
            w = Words(ids, texts, width)
            which = np.flatnonzero(_among(w.anchors(), np.sort(marked.to_numpy())))
            order, first, windows = _groups(w.windows(which))
            doc, near = w.doc[which][order], w.beside(which)[order]
            all_ = np.bitwise_and.reduceat(near, first)
            columns = [windows, np.full(len(windows), chunk), np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first), (all_ >> np.int64(32)).astype(np.int32), all_.astype(np.int32), np.bitwise_or.reduceat(near, first) ^ all_]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), schema=_WINDOWS)

    return _beside(chunks, marks, ("anchor",)).mapInArrow(each, _ddl(_WINDOWS))


def _passages(chunks: DataFrame, recurring: DataFrame, width: int) -> DataFrame:
    """(window, source, passage): the passages of recurring windows (chunk, window, source, varied), and the hash of one window of each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts, columns in _per_chunk(batches, ("window", "source", "varied")):
            want, source, varied = (c.to_numpy() for c in columns)
            if not len(want):
                continue
            order = np.argsort(want)
            want, source, varied = want[order], source[order], varied[order]
            w = Words(ids, texts, width)
            mine = np.flatnonzero(_among(w.doc, np.unique(source)))
            have = w.windows(mine)
            place = np.minimum(np.searchsorted(want, have), len(want) - 1)
            hit = np.flatnonzero((want[place] == have) & (source[place] == w.doc[mine]))
            _, at = np.unique(place[hit], return_index=True)  # the first place of each window
            hit = np.sort(hit[at])
            which, at = place[hit], w.at[mine[hit]]
            joined = (np.diff(at) == 1) & (varied[which[:-1]] & _LOW == 0) & (varied[which[1:]] >> np.int64(32) == 0)
            begin = np.flatnonzero(np.r_[True, ~joined])
            end = np.r_[begin[1:], len(at)] - 1
            data = b"\n".join(texts)
            cut = [b" ".join(data[a:b].split()) for a, b in zip(w.starts[at[begin]].tolist(), w.ends[at[end] + width - 1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(want[which[begin]]), pa.array(source[which[begin]]), pa.array(cut, pa.binary())], schema=_PASSAGES)

    return _beside(chunks, recurring, ("window", "source", "varied")).mapInArrow(each, _ddl(_PASSAGES))


def automaton(passages: list[tuple[bytes, int]]) -> ahocorasick.Automaton:
    """Of (words joined by blanks, source); finds each with its number of words and its smallest source.  Bytes are read as characters."""
    out = ahocorasick.Automaton()
    for text, source in passages:
        key = f" {text.decode('latin-1')} "
        n, known = out.get(key, (0, source))
        out.add_word(key, (text.count(b" ") + 1, min(known, source)))
    out.make_automaton()
    return out


def locate(words: list[bytes], found: ahocorasick.Automaton, doc_id: int) -> np.ndarray | None:
    """For each word whether it stays: it is in no occurrence of a passage from a smaller document; None: all stay."""
    hits = [(e, n) for e, (n, source) in found.iter(f" {b' '.join(words).decode('latin-1')} ") if source < doc_id]
    if not hits:
        return None
    places, sizes = np.array(hits, np.int64).T
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # place of the blank after each word
    last = np.searchsorted(ends, places) + 1
    gone = np.bincount(last - sizes, minlength=len(words) + 1) - np.bincount(last, minlength=len(words) + 1)
    return np.cumsum(gone[:-1]) == 0


def _strip(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """Result rows of all documents of chunks, through the automaton of the passages (chunk, source, passage) of their chunk."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts, (source, passage) in _per_chunk(batches, ("source", "passage")):
            shard = automaton(list(zip(passage.to_pylist(), source.to_pylist(), strict=True))) if len(passage) else None
            out = []
            for doc_id, text in zip(ids, texts, strict=True):
                words = text.split()
                stay = locate(words, shard, doc_id) if shard and words and doc_id is not None else None
                kept = words if stay is None else list(compress(words, stay.tolist()))
                out.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept)))
            columns = list(zip(*out, strict=True))
            if out:
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.binary()).cast(pa.string())], schema=_RESULT)

    return _beside(chunks, passages, ("source", "passage")).mapInArrow(each, _ddl(_RESULT))


def stripped(docs: DataFrame, width: int = 13, chunk_bytes: int = CHUNK) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of (doc_id, text); ``kept``: the words left, joined by blanks.

    See ``remove_repeats`` for what counts and for odd rows.
    """
    chunks = materialize(_chunked(docs, chunk_bytes), "chunks")
    anchors = materialize(_anchor_rows(chunks, width), "anchors")
    shared = materialize(anchors.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("anchor"), "shared-anchors")
    marks = materialize(anchors.join(shared.hint("shuffle_hash"), "anchor").select("chunk", "anchor"), "marks")
    drop_table(anchors)
    drop_table(shared)
    windows = materialize(_window_rows(chunks, marks, width), "windows")
    drop_table(marks)
    near = "shiftleft(cast(before as long), 32) | (cast(after as long) & 4294967295L)"
    found = windows.withColumn("same", F.expr(near)).groupBy("window").agg(F.min("lo").alias("source"), F.max("hi").alias("last"), F.min_by("chunk", "lo").alias("chunk"), F.bit_and("same").alias("same"), F.bit_or(F.expr("same | varied")).alias("any"))
    recurring = materialize(found.where("source < last").select("chunk", "window", "source", F.expr("any ^ same").alias("varied")), "recurring")
    passages = materialize(_passages(chunks, recurring, width), "passages")
    drop_table(recurring)
    where = materialize(windows.select("window", "chunk", "hi").join(passages.hint("shuffle_hash"), "window").where("hi > source").select("chunk", "source", "passage"), "shards")
    drop_table(windows)
    drop_table(passages)
    return _strip(chunks, where)


def remove_repeats(docs: DataFrame, width: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of (doc_id, text).

    Words are runs without ASCII white space, unchanged.  A text with fewer than ``width`` words has no window; a null text no words.
    Ties cannot arise: only a smaller doc_id counts, so the rows of one doc_id do not shorten each other, and its
    passages are those of all its rows.  Rows without doc_id are returned whole.  Windows are judged on the input, not on what is left.
    """
    return stripped(docs, width).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
