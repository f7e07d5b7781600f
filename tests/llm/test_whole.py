"""Cases in which an operator once did less than its whole job."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sparkweave.llm import langid, ngrams, perplexity, pii, queries, toxicity
from sparkweave.llm.tokenizing import TextEncoder

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_runs_of_line_feeds(path):
    tok, enc = Tokenizer.from_file(path), TextEncoder(path)
    for text in ["a b\n\n\nc d", "a b\n\n", "a\n\nb", "\n\n", "\n\n\n", "a\n\n\n\nb\n", "a b\n\n\n"]:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_pipeline_drops_copies_with_scattered_edits(spark):
    words = [f"w{k}" for k in range(52)]
    edited = [*words[:26], "other", *words[27:]]  # 5-word shingles 43 of 53, 3-word ones 47 of 53
    docs = spark.createDataFrame([(i, " ".join(w), "en", "src1", 0) for i, w in enumerate((words, edited, ["else"]))], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [0, 2]


def test_packed_ids_are_written(spark, tmp_path):
    spark.createDataFrame([(1, "a b c", "en", "src1", 5), (2, "d " * 3000, "en", "src1", 6000)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for out in (queries.op1_packing(spark, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))):
        [folder] = {f.rpartition("/")[0] for f in out.inputFiles()}  # the one table from which the digests come
        held = spark.read.parquet(folder).collect()
        assert sorted((r.doc_id, r.start, zlib.crc32(r.ids)) for r in held) == sorted((r.doc_id, r.start, r.ids_crc32) for r in out.collect()) and held
        assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_unseen_ngrams_stay_missing(spark):
    shape = ngrams.Shape(order=2, bits=8, slot_bits=4)
    keys = np.arange(3000)
    entries = spark.range(1000).selectExpr("3L as m", "id as key", "cast(id as double) as v", "1L as n")
    table = ngrams.HashArrays.gather(entries, "m", "key", "v", "n", shape.fitted(1000))
    got = table.find(3, keys, -1.0)
    assert (got[:1000] == keys[:1000]).mean() > 0.99 and (got[1000:] == -1).mean() > 0.99
    wide = ngrams.HashArrays.gather(entries, "m", "key", "v", "n", shape.fitted(1 << 24))
    assert wide.slots.dtype == np.uint64 and (wide.find(3, keys[:1000], -1.0) == keys[:1000]).all()


def test_models_take_their_slots_from_the_count(spark):
    texts = [" ".join(chr(a) + chr(b) for a in range(64, 130) for b in range(64, 130))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    small = lambda order: ngrams.Shape(order=order, bits=8, slot_bits=4)
    for model in (perplexity.train(docs, small(3)), toxicity.train(toxicity.labelled(docs, marks), small(3)), langid.train(docs, small(3))):
        assert 1 << model.shape.slot_bits >= 1024 * len(model.slots) > 1024 * 1000


def test_symbol_rich_documents_are_counted(spark):
    rows = [(i, f"if (a{i} < b) {{ x = a[{i}] | b; }} // # * $ % & and so on for all of it {i * 7}", "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = perplexity.perplexity_filter(docs).collect()
    assert all(r.log_ppl < 2 and 10 * r.n_symbols > r.n_words and not r.base_failed for r in out) and sum(r.kept for r in out) > 30


def test_personal_data_without_digits(spark):
    texts = ["write to jane.doe [at] example.org today", "ask jane (at) mail (dot) org about it", "then password = correcthorsebattery was set", "the version = stablerelease was out"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.t for r in pii.find(docs).select("doc_id", pii.redact("text", "spans").alias("t")).collect()}
    assert got == {0: "write to <EMAIL> today", 1: "ask <EMAIL> about it", 2: "then password = <SECRET> was set", 3: texts[3]}


def test_stretches_and_memo_change_nothing(monkeypatch):
    field = pii.Field.fit(pii.training_table())
    words = [w for s, _ in pii.training_table(400, seed=3) for w in s] + ["É", "ab", "Ab", "ABC", "Token", "key:", "中A", "..."]
    split = field.decode([words])
    monkeypatch.setattr(pii, "STRETCH", 1 << 20)
    monkeypatch.setattr(pii, "_kind", lambda w: tuple(pii._word_features(w)))
    plain = pii.Field(field.names, field.emit, field.move, field.start).decode([words])
    assert len(words) > 2000 and split == plain


def test_words_with_marks_go_through_the_model_alone():
    tok, enc, asked = Tokenizer.from_file(BYTE), TextEncoder(BYTE), []
    enc._whole = lambda text, real=enc._whole: asked.append(text) or real(text)
    for text in ["First word$$$ été&&& third!!\nfourth.%%% it's", "a-b c\" d`~ e_ f' g'. h--- (i) j1"]:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    assert asked == [" it's", "a-b", " f'", " g'.", " (i)", " j1"]
