"""Shared pieces of the training-data operators: shared-folder tables, words and hashes.

Conventions of every operator in this package:

* only the columns named in its docstring are read; further columns of the
  input, whatever their names, are ignored unless the operator says otherwise;
* a null text counts as the empty text;
* an empty input gives an empty output with the same schema.
"""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only a session on one machine (tests) may lack it and then uses a folder under /tmp/checkpoints; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/") if base else f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Cuts lineage so that a lost executor costs a re-read of shared files, not a
    recomputation, and keeps several consumers from running a Python stage twice.
    The shuffle files of the step are deleted once the table is there: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    sc = spark.sparkContext._jsc.sc()
    first = sc.newShuffleId()
    df.write.option("compression", "zstd").parquet(path)
    if sc.cleaner().isDefined():
        for shuffle in range(first + 1, sc.newShuffleId()):
            sc.cleaner().get().doCleanupShuffle(shuffle, True)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and nothing needs any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.table_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most: int = 1 << 18) -> DataFrame:
    """A written table, marked for broadcast when it has ``most`` rows or fewer; a larger one is left to shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def rows_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of rows that the driver holds.  They go to the JVM as they are; ``createDataFrame(rows)`` would start Python workers on the executors for it."""
    fields = to_arrow_schema(T.StructType.fromDDL(schema))
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields))


def unused(names: list[str], name: str) -> str:
    """A column name like ``name`` that is none of ``names``."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a null text read as the empty one."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Python rows of Arrow batches, a few hundred at a time to bound memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """One object for each Python worker, made when it is first asked for.  Workers are used again by later stages; ``release`` drops it."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Drop what earlier stages left in this Python worker and give the memory back, before another operator needs its own."""
    if _kept:
        _kept.clear()
        gc.collect()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
            trim(0)


def limit_threads() -> None:
    """Native libraries run inside a task that owns one core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit integers (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BASE, _BACK = np.uint64(0x5851F42D4C957F2D), np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_powers: dict[np.uint64, np.ndarray] = {}


def power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; one table for each worker."""
    if len(_powers.get(base, ())) < n:
        with np.errstate(over="ignore"):
            _powers[base] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 1 << 20) + (n >> 2), base, np.uint64))])
    return _powers[base][:n]


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts``, and for each word its first and end byte in the
    texts joined by line feeds; last, the number of words of each text.  Equal words hash alike everywhere."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    ends = np.flatnonzero(blank & np.r_[False, ~blank[:-1]])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    counts = np.diff(np.searchsorted(starts, np.r_[0, np.cumsum(sizes)]))
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, counts
    with np.errstate(over="ignore"):
        # byte values times powers of their place; a word's sum is divided by the power of its first place
        sums = np.cumsum(_BYTE[data] * power(_BASE, len(data)))
        before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
        values = (sums[ends - 1] - before) * power(_BACK, len(data))[starts]
        return mix(values + (ends - starts).astype(np.uint64)), starts, ends, counts


def rolling(h: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hashes of all sequences of n words, from the words' hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    size = len(h) - n + 1
    with np.errstate(over="ignore"):
        sums = np.cumsum(h * power(_BASE, len(h)))
        total = sums[n - 1 :].copy()
        total[1:] -= sums[: size - 1]
        return mix(total * power(_BACK, size) + np.uint64(salt))
