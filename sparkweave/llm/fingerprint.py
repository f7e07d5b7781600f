"""Homomorphic multiset hash of a document's paragraphs (operator 3), DataFrame functions only.

A text is the multiset of its paragraphs (the parts between line feeds).  Each paragraph
hashes to a wide vector; a fingerprint is the sum of its paragraphs' vectors, so it does not
depend on their order, and ``insert`` / ``remove`` update it without the rest of the text.
A vector has 21 words:

* word 0: 1, so the sum is the number of paragraphs;
* words 1-8: 61 hash bits each, summed modulo 2**61 (488 bits: equality);
* words 9-20: four lanes of 15 bits each, summed lane by lane modulo 2**15; every clause of the paragraph (the
  parts that end in a punctuation mark and blanks) adds 1 or -1 to each of the 48 lanes, by the bits of its hash.

The mean square of the lanes estimates the squared norm of a multiset of clauses, that of the difference of two fingerprints' lanes how many clauses
are in one and not in the other; together they give the Jaccard likeness of the multisets (a clause that is repeated m times
weighs m squared).  The relative error of an
estimate is about a fifth, whatever the size, up to some 16 million clauses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

DENSE, SPARSE, LANES, BITS = 8, 12, 4, 15
WORDS = 1 + DENSE + SPARSE
_MOD = (1 << 61) - 1
_ONES = sum(1 << (BITS * k) for k in range(LANES))
_LOW, _HIGH = _ONES * ((1 << (BITS - 1)) - 1), _ONES << (BITS - 1)
#: bit k of four to the lowest bit of lane k
_SPREAD = sum(1 << ((BITS - 1) * k) for k in range(LANES))
_CLAUSES = r"(?<=[.!?,;:]) +"
_SMALLEST = -(1 << 63)


def _add_lanes(a: str, b: str) -> str:
    """SQL: lane by lane sum of two words, without carries between lanes."""
    return f"((({a} & {_LOW}L) + ({b} & {_LOW}L)) ^ (({a} ^ {b}) & {_HIGH}L))"


def _minus_lanes(a: str) -> str:
    """SQL: the lanes' negatives (complement and one more)."""
    return _add_lanes(f"({a} ^ {_LOW | _HIGH}L)", f"{_ONES}L")


def _add_word(a: str, b: str, i: str) -> str:
    """SQL for word ``i`` of a sum; no addition can overflow a bigint."""
    return f"CASE WHEN {i} = 0 THEN {a} + {b} WHEN {i} <= {DENSE} THEN ({a} + {b}) & {_MOD}L ELSE {_add_lanes(a, b)} END"


def _vector(text: str) -> str:
    """SQL for the fingerprint words of a text expression."""
    paragraphs = f"split({text}, '\\n', -1)"
    dense = f"aggregate({paragraphs}, array_repeat(0L, {DENSE}), (a, p) -> transform(a, (w, i) -> (w + (xxhash64(i, p) & {_MOD}L)) & {_MOD}L))"
    bits = f"shiftrightunsigned(h, {LANES} * i) & {(1 << LANES) - 1}L"
    signs = f"(((({bits}) * {_SPREAD}L) & {_ONES}L) * {(1 << BITS) - 2}L + {_ONES}L)"  # 1, or -1 where the bit is set
    sparse = f"aggregate(transform(split({text}, r'\n|{_CLAUSES}', -1), p -> xxhash64('lane', p)), array_repeat(0L, {SPARSE}), (a, h) -> transform(a, (w, i) -> {_add_lanes('w', signs)}))"
    return f"concat(array(cast(size({paragraphs}) as bigint)), {dense}, {sparse})"


def words(text: str) -> F.Column:
    """Fingerprint words (array of 21 longs) of the text in column ``text``; a null text counts as empty."""
    return F.expr(_vector(f"coalesce({text}, '')"))


def insert(fingerprint: str, paragraph: str) -> F.Column:
    """Words of a fingerprint column with one more paragraph."""
    return F.expr(f"transform({fingerprint}, (w, i) -> " + _add_word("w", f"element_at({_vector(paragraph)}, i + 1)", "i") + ")")


def remove(fingerprint: str, paragraph: str) -> F.Column:
    """Words of a fingerprint column with one paragraph, that is in it, less."""
    v = f"element_at({_vector(paragraph)}, i + 1)"
    minus = f"CASE WHEN i = 0 THEN -1L WHEN i <= {DENSE} THEN ({_MOD + 1}L - {v}) & {_MOD}L ELSE {_minus_lanes(v)} END"
    return F.expr(f"transform({fingerprint}, (w, i) -> " + _add_word("w", f"({minus})", "i") + ")")


def to_text(fingerprint: str) -> F.Column:
    """Words as hexadecimal text."""
    return F.expr(f"array_join(transform({fingerprint}, (w, i) -> lpad(lower(hex(w)), if(i = 0, 8, 16), '0')), '')")


def _norm(lanes: str) -> str:
    """SQL: mean square of the lanes, read as signed numbers, of an array of words."""
    half, all_ = 1 << (BITS - 1), (1 << BITS) - 1
    lane = [f"cast(((shiftright(w, {BITS * k}) & {all_}L) ^ {half}L) - {half}L as double)" for k in range(LANES)]
    return f"(aggregate({lanes}, 0d, (s, w) -> s + {' + '.join(f'{x} * {x}' for x in lane)}) / {SPARSE * LANES}d)"


def likeness(a: str, b: str) -> F.Column:
    """Estimated Jaccard likeness (0 to 1) of the multisets of clauses of two texts; 1 for equal fingerprints only."""
    lanes = lambda x: f"slice({x}, {DENSE + 2}, {SPARSE})"
    apart = _norm(f"zip_with({lanes(a)}, {lanes(b)}, (x, y) -> {_add_lanes('x', _minus_lanes('y'))})")
    both = f"({_norm(lanes(a))} + {_norm(lanes(b))})"
    return F.expr(f"CASE WHEN {a} = {b} THEN 1d ELSE greatest(0d, least(0.999999d, ({both} - {apart}) / ({both} + {apart}))) END")


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with columns ``fingerprint_words`` and ``fingerprint`` added; other columns stay."""
    return docs.withColumn("fingerprint_words", words(f"`{text}`")).withColumn("fingerprint", to_text("fingerprint_words"))


def _senders(docs: DataFrame) -> DataFrame:
    """(k, to, need): the row of k gives its first ``need`` code points to k's forerunner ``to`` in descending order.

    Ids only.  A range partitioning of them is written down with its partition
    number; within a range the forerunner comes from a window over that range, at its
    edge from the neighbouring range (one row for each range, as many as shuffle partitions).
    """
    ids = docs.groupBy("k").agg(F.max(F.floor(F.char_length("text") / 3)).alias("n"))
    ranged = materialize(ids.repartitionByRange(F.col("k").desc()).withColumn("b", F.spark_partition_id()), "doc-order")
    edges = ranged.groupBy("b").agg(F.min(F.struct("k", "n")).alias("last"))
    circle = edges.selectExpr("b", "lag(last) over (order by b) as before", "last_value(last) over (order by b rows between unbounded preceding and unbounded following) as end").selectExpr("b", "coalesce(before, end) as edge")
    inside = ranged.selectExpr("b", "k", "lag(struct(k, n)) over (partition by b order by k desc) as before")
    return inside.join(F.broadcast(circle), "b").selectExpr("k", "coalesce(before, edge).k as to", "coalesce(before, edge).n as need")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of (doc_id, text), of its edited text, and how alike they are.

    The edited text has its last floor(n_chars/3) code points replaced by the first as many (or all) of
    the next document in descending doc_id; after the last comes the first.  Columns: doc_id, n_chars, edited_sha256,
    fingerprint_words, edited_words, near_edited, near_next.

    A null text is empty (one empty paragraph).  A null doc_id counts as the smallest id.  Rows of one
    doc_id are all kept, have the same next document (that of the next smaller id), and stand for that id as
    next document by the row whose needed prefix, then fingerprint, is smallest.  A single id is its own next.
    """
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(_SMALLEST)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    linked = docs.join(_senders(docs).hint("merge"), "k")  # the same plan at every size
    gifts = linked.select("to", F.struct(F.expr("left(text, need)").alias("prefix"), words("text").alias("w")).alias("next"))
    gifts = materialize(gifts.groupBy("to").agg(F.min("next").alias("next")), "next-prefixes")
    own = docs.join(gifts, docs["k"] == gifts["to"]).withColumn("n_chars", F.char_length("text").cast("long"))
    own = own.withColumn("f", F.expr("cast(floor(n_chars / 3) as int)")).withColumn("edited", F.expr("concat(left(text, cast(n_chars as int) - f), left(next.prefix, f))"))
    own = own.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), words("text").alias("fingerprint_words"), words("edited").alias("edited_words"), F.col("next.w").alias("next_words"))
    return own.select("doc_id", "n_chars", "edited_sha256", "fingerprint_words", "edited_words", likeness("fingerprint_words", "edited_words").alias("near_edited"), likeness("fingerprint_words", "next_words").alias("near_next"))
