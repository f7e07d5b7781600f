"""Bounded-space online packing of token sequences (operator 1).

Every partition keeps a fixed number of open windows.  Whole windows of a long
document are emitted at once; its tail goes to the open window that it fits
best.  When none fits, a new window is opened while the bound allows it;
otherwise the fullest window is emitted.  If that would leave more than
``max_waste`` ids of padding in it, the tail is cut so that it fills it exactly.
The open windows that each partition has left over (a bounded number) are
finally merged in groups of ``merge_partitions`` partitions, so the padding that remains
is at most ``max_waste`` ids in a window and one part-filled window in a group.

Only the left-over windows are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, materialize, rows_of
from .tokenizing import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, left int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("left", pa.int32())])
_ID = 4  # bytes of an id
#: sequence ids of the final merge start here; below are those of partitions, 2**32 for each
_MERGED = 1 << 62


class Packer:
    """Open windows of one partition.  A piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, seq_len: int, open_windows: int, max_waste: int, first_id: int):
        self.seq_len, self.bound, self.waste, self.next_id = seq_len, open_windows, max_waste, first_id
        self.fill: list[int] = []
        self.open: list[list[tuple]] = []

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc_id, start, total, ids in pieces:
            yield doc_id, start, total, ids, self.next_id, at
            at += len(ids) // _ID
        self.next_id += 1

    def add(self, doc_id: int, total: int, ids: bytes, start: int = 0) -> Iterator[tuple]:
        """Place ids start.. of a document; yields the pieces of windows that are finished by it."""
        size, at = self.seq_len * _ID, 0
        while len(ids) - at >= size:
            yield from self._emit([(doc_id, start + at // _ID, total, ids[at : at + size])])
            at += size
        while at < len(ids):
            n = (len(ids) - at) // _ID
            fits = [(f, k) for k, f in enumerate(self.fill) if f + n <= self.seq_len]
            if fits:
                k = max(fits)[1]
            elif len(self.fill) < self.bound:
                k = len(self.fill)
                self.fill.append(0)
                self.open.append([])
            else:
                k = max(range(len(self.fill)), key=self.fill.__getitem__)
                if self.seq_len - self.fill[k] > self.waste:
                    n = self.seq_len - self.fill[k]
                else:
                    yield from self._emit(self.open[k])
                    self.open[k], self.fill[k] = [], 0
            self.open[k].append((doc_id, start + at // _ID, total, ids[at : at + n * _ID]))
            self.fill[k] += n
            at += n * _ID
            if self.fill[k] == self.seq_len:
                yield from self._emit(self.open[k])
                del self.open[k], self.fill[k]

    def leftovers(self) -> list[list[tuple]]:
        """The windows still open, fullest first."""
        return [w for _, _, w in sorted(((-f, k, w) for k, (f, w) in enumerate(zip(self.fill, self.open, strict=True))), key=lambda x: x[:2])]


def _row(piece: tuple, keep: bool) -> tuple:
    doc_id, start, total, ids, sequence, offset = piece
    return doc_id, start, len(ids) // _ID, zlib.crc32(ids), total, sequence, offset, ids if keep else None, 0


def _batches(rows: Iterator[tuple], most: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, seq_len: int = 1024, open_windows: int = 32, max_waste: int = 8, merge_partitions: int = 32, with_ids: bool = True) -> DataFrame:
    """Pack all documents (doc_id, text) into windows of ``seq_len`` ids.

    ``tokenizer`` is the path of a ``tokenizers`` file; each document's ids are
    followed by ``end_id``.  One row for each piece: doc_id, start (ids of the document before it),
    length, ids_crc32 (of the ids as little-endian uint32), doc_tokens (with the end
    id), sequence_id, offset in it and, ``with_ids``, the ids as binary.

    A null or empty text gives one piece that holds the end id; repeated rows and rows
    of one doc_id are packed each for itself; a null doc_id stays null; an empty table gives no rows.
    Bounds: a task holds ``open_windows`` windows, a merge the left-over windows of
    ``merge_partitions`` partitions.  Sequence ids are unique, not dense.
    """
    end = end_id.to_bytes(_ID, "little")

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, enc = Packer(seq_len, open_windows, max_waste, part << 32), encoder(tokenizer)

        def rows() -> Iterator[tuple]:
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                ids = enc.encode(text) + end
                for piece in packer.add(doc_id, len(ids) // _ID, ids):
                    yield _row(piece, with_ids)
            for window in packer.leftovers():
                for doc_id, start, total, ids in window:
                    yield doc_id, start, len(ids) // _ID, zlib.crc32(ids), total, part, None, ids, 1

        return _batches(rows())

    def merge(pieces: pd.DataFrame) -> pd.DataFrame:
        group = int(pieces["sequence_id"].iloc[0]) // merge_partitions
        pieces = pieces.sort_values(["length", "doc_id", "start", "sequence_id"], ascending=[False, True, True, True], kind="stable")
        packer = Packer(seq_len, 1, 0, _MERGED | (group << 32))  # one window, always filled to the end
        out = [_row(p, with_ids) for r in pieces.itertuples() for p in packer.add(None if pd.isna(r.doc_id) else int(r.doc_id), int(r.doc_tokens), r.ids, int(r.start))]
        out += [_row(p, with_ids) for w in packer.leftovers() for p in packer._emit(w)]
        return pd.DataFrame(out, columns=_ARROW.names).astype({"doc_id": "Int64"})

    packed = materialize(doc_text(docs).mapInArrow(of_partition, PIECES), "packed")
    merged = packed.where("left = 1").groupBy((F.col("sequence_id") / merge_partitions).cast("long").alias("g")).applyInPandas(merge, PIECES)
    out = packed.where("left = 0").unionByName(merged).drop("left")
    return out if with_ids else out.drop("ids")


def digests(packed: DataFrame) -> DataFrame:
    """The pieces of a written table of ``pack`` without their ids: length and ids_crc32 are taken from the ids that it holds."""
    return packed.select("doc_id", "start", F.expr(f"cast(octet_length(ids) div {_ID} as bigint)").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
