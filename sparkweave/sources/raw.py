"""Facts from files and to files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .store import TRIPLES, new_path

#: 12-byte records: subject, predicate, object as little-endian unsigned 32-bit numbers
RECORD = np.dtype([("s", "<u4"), ("p", "<u4"), ("o", "<u4")])
_REIFIED = r"#(Statement|subject|predicate|object)>?$"


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of raw fact files; an incomplete last record is ignored.  A file is decoded in one task (up to 2 GB each)."""
    schema = pa.schema([("s", pa.int64()), ("p", pa.int32()), ("o", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                facts = np.frombuffer(data, RECORD, count=len(data) // RECORD.itemsize)
                for at in range(0, len(facts), 1 << 18):
                    part = facts[at : at + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(part["s"].astype("i8")), pa.array(part["p"].astype("i4")), pa.array(part["o"].astype("i8"))], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, TRIPLES)


def write_binary(triples: DataFrame, path: str) -> None:
    """One raw fact file; ids must be below 2**32.

    Executors write it in pieces of some ``ROWS`` facts, and the file system of the driver's JVM joins their bytes: no row is sent to the driver.
    """
    spark = triples.sparkSession
    pieces = new_path(spark, "facts")
    size = store.ROWS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        n = 0
        for batch in batches:
            facts = np.empty(batch.num_rows, RECORD)
            for c, column in zip("spo", batch.columns, strict=True):
                ids = column.to_numpy(zero_copy_only=False)
                if column.null_count or (len(ids) and (ids.min() < 0 or ids.max() >= 1 << 32)):
                    raise ValueError(f"{c} of a fact is null or not within 32 bits")
                facts[c] = ids
            held.append(facts.tobytes())
            n += len(facts)
            if n >= size:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)])], ["content"])
                held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)])], ["content"])

    packed = triples.select("s", "p", "o").mapInArrow(pack, "content binary")
    packed.select(F.col("content").cast("string")).write.option("maxRecordsPerFile", 1).text(pieces)  # a text is written byte for byte, and a line's end after it
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(pieces), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(conf)
    out = target.getFileSystem(conf).create(target, True)
    try:
        for f in sorted(fs.listStatus(source), key=lambda f: f.getPath().getName()):
            if f.getLen() and not f.getPath().getName().startswith("_"):
                part = fs.open(f.getPath())
                try:
                    jvm.org.apache.commons.io.IOUtils.copyLarge(part, out, 0, f.getLen() - 1)
                finally:
                    part.close()
    finally:
        out.close()
    fs.delete(source, True)


_LINE = r'^\s*<([0-9]+)>\s+<([0-9]+)>\s+"([0-9]+)"\s*\.\s*$'


def read_id_text(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of lines ``<s> <p> "o" .``; other lines are skipped."""
    lines = spark.read.text(path).where(F.col("value").rlike(_LINE))
    return lines.select(*[F.regexp_extract("value", _LINE, i).cast(TRIPLES[c].dataType).alias(c) for i, c in enumerate("spo", 1)])


def write_id_text(triples: DataFrame, path: str) -> None:
    triples.select(F.format_string('<%d> <%d> "%d" .', "s", "p", "o")).write.text(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) texts of tab-separated lines; carriage returns and empty fields are dropped, lines with fewer than three fields skipped."""
    fields = F.filter(F.split(F.translate("value", "\r", ""), "\t"), lambda x: x != "")
    rows = spark.read.text(path, lineSep="\n").select(fields.alias("f")).where(F.size("f") >= 3)
    return rows.select(*[F.col("f")[i].alias(c) for i, c in enumerate("spo")])


_NT = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*")(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?\s*\.\s*(?:#.*)?$'


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) texts of N-Triples lines: IRIs without brackets, literals without quotes, language and datatype; bad lines are skipped."""
    lines = spark.read.text(path).where(F.col("value").rlike(_NT))
    bare = lambda c: F.regexp_replace(c, r'^[<"]|[>"]$', "")
    return lines.select(*[_unescaped(bare(F.regexp_extract("value", _NT, i))).alias(c) for i, c in enumerate("spo", 1)])


def _unescaped(text: F.Column) -> F.Column:
    """Escapes of strings and IRIs read (quotes, controls, code points): a JSON reader knows all but two of them, and code points above FFFF as pairs."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\\\\", r"\\u005c"), r"\\'", "'")  # every backslash left begins an escape
    long = F.array_distinct(F.regexp_extract_all(plain, F.lit(r"\\U([0-9A-Fa-f]{8})"), F.lit(1)))
    plain = F.aggregate(long, plain, lambda t, h: F.replace(t, F.concat(F.lit("\\U"), h), _json_escape(h)))
    quoted = F.concat(F.lit('{"v":"'), F.regexp_replace(plain, "\t", r"\\t"), F.lit('"}'))
    return F.when(text.contains("\\"), F.coalesce(F.from_json(quoted, "v string")["v"], text)).otherwise(text)


def _json_escape(digits: F.Column) -> F.Column:
    """JSON's escape of a code point of eight hexadecimal digits; beyond 10FFFF it stays as it is."""
    point = F.conv(digits, 16, 10).cast("long")
    above = point - 0x10000
    pair = F.format_string("\\u%04x\\u%04x", F.shiftright(above, 10) + 0xD800, above.bitwiseAND(0x3FF) + 0xDC00)
    return F.when(above < 0, F.concat(F.lit("\\u"), F.right(digits, F.lit(4)))).when(point <= 0x10FFFF, pair).otherwise(F.concat(F.lit("\\U"), digits))


def drop_reified(facts: DataFrame) -> DataFrame:
    """Facts without the parts of reified statements."""
    return facts.where(~F.col("p").rlike(_REIFIED) & ~F.col("o").rlike(_REIFIED))


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) texts of Turtle files, each parsed as a whole; a bad statement is skipped up to its line's end."""
    from .turtle import parse

    schema = pa.schema([(c, pa.string()) for c in "spo"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                facts = list(parse(text, re.sub(r"\W", "", name.rpartition("/")[2])))
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in facts], pa.string()) for i in range(3)], schema=schema)

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("f"), "value").mapInArrow(each, "s string, p string, o string")
