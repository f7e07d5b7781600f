"""Compressed token-id files with a shared zstandard dictionary (operator 10).

A store is a folder of two Parquet tables, so that any file system Spark reaches can hold it:

* ``dictionary``: one row (dict_sha256, dictionary, id_bytes, end_id);
* ``blocks``: rows (shard, block, first_doc_id, last_doc_id, n_docs, start_in_shard,
  n_ids, dict_sha256, index, payload).  ``payload`` holds one zstandard frame for each
  document, ``index`` (doc_id int64, offset uint32, bytes uint32, n_tokens uint32, null
  uint32; little-endian, one such record for each document) says where.

Shards follow ascending doc_id.  A short document is read by one block lookup
(statistics of first_doc_id and last_doc_id prune files), one index search and the decompression of one frame.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_text, rows_of, shared_dir
from .tokenizing import encoder

INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u4"), ("bytes", "<u4"), ("n_tokens", "<u4"), ("null", "<u4")])
_BLOCKS = "shard long, block long, first_doc_id long, last_doc_id long, n_docs long, start_in_shard long, n_ids long, dict_sha256 string, index binary, payload binary"
_BLOCKS_ARROW = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("first_doc_id", pa.int64()), ("last_doc_id", pa.int64()), ("n_docs", pa.int64()), ("start_in_shard", pa.int64()), ("n_ids", pa.int64()), ("dict_sha256", pa.string()), ("index", pa.binary()), ("payload", pa.binary())])
_DOCS = "doc_id long, shard long, start_in_shard long, n_tokens long, ids binary"
_DOCS_ARROW = pa.schema([("doc_id", pa.int64()), ("shard", pa.int64()), ("start_in_shard", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, id_bytes: int, sample: int = 512, size: int = 65536) -> bytes:
    """Dictionary from the serialized ids of the ``sample`` documents with the smallest hashes of doc_id.

    The sample is bounded by ``sample`` and read whole.  Too few or too
    uniform samples, from which none can be trained, give the empty dictionary.
    """
    enc = encoder(tokenizer)
    # only every n-th hash can be among the smallest, so that tasks send the driver a few rows at most
    share = max(1, docs.count() // (8 * sample))
    texts = doc_text(docs).where(F.expr(f"shiftright(xxhash64(doc_id), 1) < {-(1 << 62)} + {(1 << 63) // share - 1}")).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample).collect()
    data = [_serialize(enc.encode(r.text) + end_id.to_bytes(4, "little"), id_bytes) for r in texts]
    try:
        return zstandard.train_dictionary(size, data).as_bytes()
    except zstandard.ZstdError:
        return b""


def _serialize(ids: bytes, id_bytes: int) -> bytes:
    return ids if id_bytes == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block_bytes: int = 1 << 22, level: int = 3, sample: int = 512) -> None:
    """Encode every whole text of (doc_id, text), end it with ``end_id`` and write the store at ``path``.

    Ascending doc_id; a null doc_id comes first; rows of one doc_id are ordered by text and all kept;
    a null text is empty (its only id is the end id); an empty table gives a store without blocks.
    A block is closed when it holds ``block_bytes`` of frames or more, so a task holds one block at a time.
    """
    spark = docs.sparkSession
    id_bytes = 2 if encoder(tokenizer).tok.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    raw = train_dictionary(docs, tokenizer, end_id, id_bytes, sample)
    sha = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(sha, bytearray(raw), id_bytes, end_id)], "dict_sha256 string, dictionary binary, id_bytes int, end_id int").coalesce(1).write.parquet(f"{path}/dictionary")
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_content_size=True, write_dict_id=False)
        index: list[tuple] = []
        frames: list[bytes] = []
        at = start = n_ids = block = 0

        def flush() -> pa.RecordBatch:
            known = [i[0] for i in index if not i[4]] or [None]
            row = (shard, block, known[0], known[-1], len(index), start, n_ids, sha, np.array(index, INDEX).tobytes(), b"".join(frames))
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, _BLOCKS_ARROW, strict=True)], schema=_BLOCKS_ARROW)

        for doc_id, text in rows_of(batches, "doc_id", "text"):
            ids = enc.encode(text) + end
            frame = press.compress(_serialize(ids, id_bytes))
            index.append((doc_id or 0, at, len(frame), len(ids) // 4, doc_id is None))
            frames.append(frame)
            at += len(frame)
            n_ids += len(ids) // 4
            if at >= block_bytes:
                yield flush()
                block, start = block + 1, start + n_ids
                index, frames, at, n_ids = [], [], 0, 0
        if index:
            yield flush()

    doc_text(docs).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(encode, _BLOCKS).write.parquet(f"{path}/blocks")


def _open(spark: SparkSession, path: str) -> tuple[bytes, str, int]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row.dictionary).hexdigest() != row.dict_sha256:
        raise ValueError(f"the dictionary in {path} is damaged")
    return bytes(row.dictionary), row.dict_sha256, row.id_bytes


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a store: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32)."""
    raw, sha, width = _open(spark, path)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        for batch in batches:
            for k in range(batch.num_rows):  # a block at a time
                row = {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}
                if row["dict_sha256"] != sha:
                    raise ValueError(f"block {row['shard']}/{row['block']} was written with another dictionary")
                index = np.frombuffer(row["index"], INDEX)
                starts = row["start_in_shard"] + np.cumsum(index["n_tokens"], dtype=np.int64) - index["n_tokens"]
                for lo in range(0, len(index), 1024):
                    some = index[lo : lo + 1024]
                    ids = [_wide(press.decompress(row["payload"][o : o + n]), width) for o, n in zip(some["offset"].tolist(), some["bytes"].tolist(), strict=True)]
                    columns = [pa.array(some["doc_id"], pa.int64(), mask=some["null"] != 0), pa.array([row["shard"]] * len(some), pa.int64()), pa.array(starts[lo : lo + 1024]), pa.array(some["n_tokens"].astype("i8")), pa.array(ids, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, schema=_DOCS_ARROW)

    # one row for each shard, of which there are as many as partitions wrote the store: bounded by the cluster's setting
    totals = sorted((r.shard, r.n) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    base, before = [], 0
    for shard, n in totals:
        base.append((shard, before))
        before += n
    bases = spark.createDataFrame(base, T.StructType([T.StructField("shard", T.LongType()), T.StructField("before", T.LongType())]))
    docs = blocks.select("shard", "block", "start_in_shard", "dict_sha256", "index", "payload").mapInArrow(decode, _DOCS)
    return docs.join(F.broadcast(bases), "shard").select("doc_id", (F.col("before") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """Ids of one document (one array for each row of that doc_id); other frames are not decompressed."""
    raw, _, width = _open(spark, path)
    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    found = []
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").where((F.col("first_doc_id") <= doc_id) & (F.col("last_doc_id") >= doc_id))
    for row in blocks.orderBy("shard", "block").select("index", "payload").toLocalIterator():
        index = np.frombuffer(row["index"], INDEX)
        for i in index[(index["doc_id"] == doc_id) & (index["null"] == 0)]:
            found.append(np.frombuffer(_wide(press.decompress(row["payload"][int(i["offset"]) : int(i["offset"]) + int(i["bytes"])]), width), "<u4"))
    return found


def _wide(data: bytes, width: int) -> bytes:
    return data if width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"


def digest(ids: str = "ids") -> F.Column:
    """Unsigned crc32 of the packed ids."""
    return F.crc32(F.col(ids))


__all__ = ["write", "read", "lookup", "train_dictionary", "new_path", "digest"]
