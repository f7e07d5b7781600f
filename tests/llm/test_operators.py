"""Each operator against a plain version on a small table with odd rows, and on an empty table."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkweave.llm import common, fingerprint, langid, mixing, ngrams, packing, perplexity, pii, queries, repeats, shingle_join, token_store, toxicity
from sparkweave.llm.tokenizing import TextEncoder, encoder

DATA = "/root/testdata/sf0.001"
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [None, "", " \n\t ", "one", "two words", "a b c\n\na b c", "x" * 70_000 + " y\n", "again and again and\n" * 2_000, "é ü İ ΣΑΣ 🙂", "+1 (234) 555-0000 4111 1111 1111 1111 a@b.c_d@e.f 1.2.3.4.5 999.1.1.1", "<|endoftext|> it's 3.5%"]


@pytest.fixture(scope="module")
def docs(spark):
    some = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 90").select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(1000 + i, t, None if i % 3 == 0 else "en", None if i % 2 else "src0", len(t or "")) for i, t in enumerate(ODD)]
    long = some.where("doc_id = 5").first().text
    odd += [(2000, long, "es", "src0", len(long)), (2001, long + " end", "es", "src0", len(long)), (2001, long + " end", "es", "src0", len(long))]
    both = some.union(spark.createDataFrame(odd, some.schema))
    for name in ("score", "kept", "base", "spans", "epoch", "n", "k", "key", "leaf", "cls", "whole", "cut", "times", "row", "low", "low_", "n_tokens", "toxic", "top", "chunk", "kind", "anchor", "window", "source_", "passage", "m", "logp"):  # clashing names
        both = both.withColumn(name, F.lit("other"))
    return both.cache()


@pytest.fixture(scope="module")
def plain(docs):
    """[(doc_id, text)] with null as empty, in ascending order."""
    return sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(text):
    return text.encode().split()


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_is_the_tokenizer(path, plain):
    tok, enc = Tokenizer.from_file(path), TextEncoder(path, memo=50)
    rng = np.random.default_rng(2)
    bits = ["a", "word", " ", " ", "\n", "\n\n", "\n\n\n", "é", "1", ".", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "\t", "'s", "  "]
    random = ["".join(rng.choice(bits, rng.integers(1, 9))) for _ in range(20_000)]
    letters = [chr(c) for c in range(0xC0, 0x180)] + list("abzAZ.,")
    random += ["".join(rng.choice(letters, rng.integers(1, 7))) + rng.choice(["", ".", ",", " b"]) for _ in range(20_000)]
    for text in [t for _, t in plain] + random + ["a  b", " a", "a ", "\n", "a\nb", "a \nb", "a\t b", "\n\na", "1,2 b.", "a\x1cb", "A's"]:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_packing(docs, plain, empty):
    pieces = packing.pack(docs, BYTE, open_windows=4).collect()
    tok = Tokenizer.from_file(BYTE)
    want = Counter(np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes() for _, t in plain)
    by_window = defaultdict(list)
    for p in pieces:
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length > 0
        by_window[p.sequence_id].append((p.offset, p.length))
    for parts in by_window.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    used = sum(p.length for p in pieces)
    assert used == sum(len(x) // 4 * n for x, n in want.items()) and used / (1024 * len(by_window)) > 0.97
    unique = {i for i, n in Counter(i for i, _ in plain).items() if n == 1}
    texts = dict(plain)
    for i in unique:
        mine = sorted((p.start, bytes(p.ids)) for p in pieces if p.doc_id == i)
        joined = b"".join(x for _, x in mine)
        assert joined == np.array(tok.encode(texts[i], add_special_tokens=False).ids + [0], "<u4").tobytes()
    assert packing.pack(empty, BYTE).count() == 0


def test_token_store(spark, docs, plain, empty):
    path = token_store.new_path(spark)
    token_store.write(docs, path, WORD, end_id=1, block_bytes=2000)
    got = sorted(token_store.read(spark, path).collect(), key=lambda r: r.start)
    tok = Tokenizer.from_file(WORD)
    at = 0
    for r, (i, t) in zip(got, plain, strict=True):
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (i, at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert [x.tolist() for x in token_store.lookup(spark, path, 1003)] == [tok.encode("one", add_special_tokens=False).ids + [1]]
    assert len(token_store.lookup(spark, path, 2001)) == 2 and token_store.lookup(spark, path, 77777) == []
    path = token_store.new_path(spark)
    token_store.write(empty, path, WORD)
    assert token_store.read(spark, path).count() == 0


def test_fingerprint(spark, docs, plain, empty):
    got = defaultdict(list)
    for r in fingerprint.compare_with_next(docs).collect():
        got[r.doc_id].append(r)
    texts = dict(plain)
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        t, nxt = texts[i], texts[ids[(k + 1) % len(ids)]]
        f = len(t) // 3
        edited = t[: len(t) - f] + nxt[:f]
        for r in got[i]:
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            assert (r.fingerprint_words == r.edited_words) == (sorted(t.split("\n")) == sorted(edited.split("\n"))) == (r.near_edited == 1)
    prints = {tuple(r.fingerprint_words) for rs in got.values() for r in rs}
    assert len(prints) == len({tuple(sorted(t.split("\n"))) for _, t in plain})
    assert fingerprint.compare_with_next(empty).count() == 0

    def alike(x, y):  # by squared norms of the clauses' counts
        a, b = (Counter(re.split(r"\n|(?<=[.!?,;:]) +", t)) for t in (x, y))
        both, apart = sum(v * v for c in (a, b) for v in c.values()), sum((a[k] - b[k]) ** 2 for k in a | b)
        return (both - apart) / (both + apart)

    off = []
    for i, nxt in zip(ids, ids[1:], strict=False):
        f = len(texts[i]) // 3
        off += [got[i][0].near_edited - alike(texts[i], texts[i][: len(texts[i]) - f] + texts[nxt][:f]), got[i][0].near_next - alike(texts[i], texts[nxt])]
    assert np.abs(off).max() < 0.4 and np.abs(off).mean() < 0.08
    one = spark.createDataFrame([("a\nb\nc", "c\na", "b")], "x string, y string, p string").withColumns({"fx": fingerprint.words("x"), "fy": fingerprint.words("y")})
    r = one.select("fx", "fy", fingerprint.insert("fy", "p").alias("i"), fingerprint.remove("fx", "p").alias("d")).first()
    assert r.fx == r.i and r.fy == r.d


def test_base_rules():
    def brute(text):
        w = words(text)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        return len(w), sum(not re.match(r"[\x20\x09-\x0D]", c) for c in text), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)

    for text in [t or "" for t in ODD] + ["a b c d e a b c d e", "a a a a a a", "p q r s t u\x85v\n\n# | p q r s t u\x85v", "a b c d e f g h i j k l"]:
        assert perplexity.base_rules([text]) == [brute(text)]
    together = [t or "" for t in ODD] * 2
    assert perplexity.base_rules(together) == [brute(t) for t in together]


def test_kneser_ney_matches_plain_version(spark):
    shape = ngrams.Shape(order=3, bits=8, slot_bits=24)
    texts = ["abracadabra abra cadabra", "banana bandana", "abba baab"]
    counts = Counter(k for t in texts for k in shape.keys([t])[0].tolist())
    grams = spark.createDataFrame([(1, k, n) for k, n in counts.items()], "m long, key long, n long")

    def discount(c):
        t = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0
        return [min(k + 0.95, max(0.1, (k + 1) - (k + 2) * y * t[k + 1] / t[k])) if t[k] and t[k + 1] else (0.7, 1.1, 1.4)[k] for k in range(3)]

    def prob(c, n):
        d = discount(c)
        low = prob(Counter(k & shape.mask(n - 1) for k in c), n - 1) if n > 1 else None
        out = {}
        for key, v in c.items():
            around = [x for k, x in c.items() if k >> 8 == key >> 8]
            rest = sum(d[min(x, 3) - 1] for x in around) / sum(around)
            out[key] = (v - d[min(v, 3) - 1]) / sum(around) + rest * (low[key & shape.mask(n - 1)] if low else 1 / 256)
        return out

    want = prob(counts, 3)
    own = ngrams.discounted(grams, shape).withColumn("low", F.col("key").bitwiseAND(F.lit(shape.mask(2))))
    down = ngrams.lower(grams.select("m", "key"), shape, 2).selectExpr("m", "key as low", "p as q")
    got = {r.key: r.p for r in own.join(down, ["m", "low"]).selectExpr("key", "own + rest * q as p").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)

    def rest(c, context):
        around = [x for k, x in c.items() if k >> 8 == context]
        return sum(discount(c)[min(x, 3) - 1] for x in around) / sum(around) if around else 1.0

    def any_prob(key, c, n):  # of seen and unseen n-grams
        if key in (known := prob(c, n)):
            return known[key]
        down = Counter(k & shape.mask(n - 1) for k in c)
        return rest(c, key >> 8) * (any_prob(key & shape.mask(n - 1), down, n - 1) if n > 1 else 1 / 256)

    model = perplexity.train(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string"), shape)
    new = sorted({*counts, *shape.keys(["abnd cabr zaz zz q", "banana"])[0].tolist()})
    found = model.log_probability(-1, np.array(new, np.int64))
    assert len(new) > len(counts) and all(math.isclose(math.exp(x), any_prob(k, counts, 3), rel_tol=1e-5) for k, x in zip(new, found.tolist(), strict=True))
    keys = np.array([5, -7, 1 << 40, 0])
    hashed = spark.createDataFrame([(3, int(k)) for k in keys], "m long, key long").selectExpr("xxhash64(m, key) as h").collect()
    assert [r.h for r in hashed] == ngrams.hash_longs(keys, ngrams.hash_longs(np.array([3]), 42)).view(np.int64).tolist()


def test_word_keys():
    shape = ngrams.Shape(order=3, bits=8)
    keys, starts, first = shape.word_keys(["ab", "", "c d"])
    c = {x: ord(x) + 1 for x in "abcd "}
    pack = lambda *x: sum(v << (8 * k) for k, v in enumerate(reversed(x)))
    assert keys.tolist() == [pack(c["a"]), pack(c["a"], c["b"]), pack(c["a"], c["b"], c[" "]), pack(c[" "]), pack(c["c"]), pack(c["c"], c[" "]), pack(c["d"]), pack(c["d"], c[" "])]
    assert starts.tolist() == [0, 3, 4, 6] and first.tolist() == [0, 1, 2]


def test_perplexity(docs, plain, empty):
    out = perplexity.perplexity_filter(docs).collect()
    assert len(out) == len(plain) and all(not r.kept for r in out if r.base_failed) and any(r.kept for r in out)
    assert {r.doc_id for r in out if r.kept} <= {r.doc_id for r in out if not r.base_failed}
    assert perplexity.perplexity_filter(empty).count() == 0
    joined = {(r.doc_id, r.lang, round(r.log_ppl, 4), r.n_repeat_words) for r in perplexity.perplexity_filter(docs, most=0).collect()}  # a model too large to send
    assert joined == {(r.doc_id, r.lang, round(r.log_ppl, 4), r.n_repeat_words) for r in out}
    assert perplexity.language_key("zh-Hans-CN") != perplexity.language_key("zh-Hans-TW")


def brute_repeats(plain, width=13):
    first, out = {}, []
    for i, t in plain:
        w = words(t)
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    for i, t in plain:
        w = words(t)
        gone = {k + j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(width)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def test_repeats(spark, docs, plain, empty):
    assert sorted(map(tuple, repeats.remove_repeats(docs).collect())) == brute_repeats(plain)
    assert repeats.remove_repeats(empty).count() == 0
    passage = " ".join(f"w{k}" for k in range(60))
    made = [(1, passage), (2, f"x {passage} y {passage[:80]}"), (3, " ".join(["same"] * 300)), (4, " ".join(["same"] * 100) + " z"), (5, passage.replace("w30", "v")), (6, f"w1 {passage} {passage}"), (None, passage)]
    got = sorted(map(tuple, repeats.remove_repeats(spark.createDataFrame(made, "doc_id long, text string")).where("doc_id is not null").collect()))
    assert got == brute_repeats([x for x in made if x[0]])


def test_repeats_in_many_chunks(spark):
    rng = np.random.default_rng(3)
    pool = [[f"w{k}" for k in rng.integers(0, 30, n)] for n in (14, 20, 60, 200)]  # few words, so that windows follow each other in many ways
    made = []
    for i in range(150):
        w = []
        for _ in range(rng.integers(0, 4)):
            p = list(pool[rng.integers(0, 4)])
            a = rng.integers(0, len(p) - 12)
            p = p[a : a + rng.integers(12, len(p) + 1)]
            if rng.random() < 0.5:
                p[rng.integers(0, len(p))] = f"x{i}"
            w += p + [f"w{k}" for k in rng.integers(0, 30, rng.integers(0, 3))]
        made.append((int(rng.integers(0, 120)), " ".join(w)))  # some ids come twice
    docs = spark.createDataFrame([*made, (None, made[0][1]), (None, None)], "doc_id long, text string").repartition(3)
    for size in (1 << 22, 2000):
        got = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in repeats.stripped(docs, chunk_bytes=size).where("doc_id is not null").collect())
        assert got == brute_repeats(sorted(made))
        assert sorted((r.n_words, r.n_removed) for r in repeats.stripped(docs, chunk_bytes=size).where("doc_id is null").collect()) == sorted([(0, 0), (len(made[0][1].split()), 0)])
    found = repeats.automaton([(b"b c", 5), (b"b c", 3), ("é b".encode(), 1)])
    assert repeats.locate(b"a b c b".split(), found, 4).tolist() == [True, False, False, True] and repeats.locate(b"a b c".split(), found, 3) is None
    assert repeats.locate("é b c".encode().split(), found, 3).tolist() == [False, False, True]


def brute_components(plain):
    def shingles(t):
        w = t.encode().lower().split()
        return frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else frozenset([tuple(w)] if w else [])

    sets = [(i, shingles(t)) for i, t in plain]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a][1] & sets[b][1])
            if n and 100 * n >= 90 * (len(sets[a][1]) + len(sets[b][1]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), sets[find(k)][0]) for k, (i, s) in enumerate(sets))


def test_shingle_join(spark, docs, plain, empty):
    assert sorted(map(tuple, shingle_join.jaccard_components(docs).collect())) == brute_components(plain)
    assert shingle_join.jaccard_components(empty).count() == 0
    rng = np.random.default_rng(5)
    made, base = [], [f"w{k}" for k in rng.integers(0, 4000, 130)]
    for i in range(120):  # chains of copies with a few words changed, some linked only through others
        base = list(base) if i % 30 else [f"w{k}" for k in rng.integers(0, 4000, 40 + 3 * i)]
        for k in rng.integers(0, len(base), rng.integers(0, 4)):
            base[k] = f"v{rng.integers(0, 4000)}"
        made.append((i, " ".join(base)))
    got = shingle_join.jaccard_components(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute_components(made)


@pytest.mark.parametrize("leaf", [3, 512])
def test_large_blocks_are_cut_into_leaves(spark, monkeypatch, leaf):
    for name, value in (("LEAF", leaf), ("BOX", 2), ("FAN", 2), ("MANY", 1)):
        monkeypatch.setattr(shingle_join, name, value)
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(150)]
    made = []
    for i in range(40):
        w = list(base) + [f"z{k}" for k in range(i % 7)]
        for k in rng.integers(0, 150, 4):
            w[k] = f"v{i}{k}"
        made.append((i, " ".join(w)))
    got = shingle_join.jaccard_components(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute_components(made)


def test_shingle_join_keeps_little_on_disk(spark, monkeypatch):
    rng = np.random.default_rng(3)
    made = []
    for i in range(160):  # pairs of near copies: every set is needed
        base = base if i % 2 else [f"w{k}" for k in rng.integers(0, 4000, 400)]
        made.append((i, " ".join([*base, f"v{i}"])))
    held, most = {}, {}

    def materialize(df, tag, real=shingle_join.materialize):
        out = real(df, tag)
        held[out.table_path] = sum(f.stat().st_size for f in Path(out.table_path.removeprefix("file:")).glob("*.parquet"))
        most[tag] = max(most.get(tag, 0), sum(v for k, v in held.items() if f"/{tag}-" in k))
        return out

    def drop_table(df, real=shingle_join.drop_table):
        held.pop(df.table_path)
        real(df)

    monkeypatch.setattr(shingle_join, "materialize", materialize)
    monkeypatch.setattr(shingle_join, "drop_table", drop_table)
    got = shingle_join.jaccard_components(spark.createDataFrame(made, "doc_id long, text string"))
    assert not [k for k in held if "/sets-" in k or "/block" in k]  # gone before the result is joined
    assert most["sets"] < 5 * 400 * len(made)  # hashes of shingles take 8 bytes each
    assert sorted(map(tuple, got.collect())) == [(i, 399, i - i % 2) for i in range(160)]


@pytest.mark.parametrize("one_pass", [0, 1 << 24])
def test_shingle_join_passes(spark, monkeypatch, one_pass):
    rng, made, written = np.random.default_rng(7), [], Counter()
    for i in range(60):  # pairs of near copies, and three groups of them
        base = base if i % 2 or i % 20 > 9 else [f"w{k}" for k in rng.integers(0, 4000, 90)]
        made.append((i, " ".join([*base, f"v{i}"])))
    monkeypatch.setattr(shingle_join, "ONE_PASS", one_pass, raising=False)
    monkeypatch.setattr(shingle_join, "materialize", lambda df, tag, real=shingle_join.materialize: written.update([tag]) or real(df, tag))
    got = shingle_join.jaccard_components(spark.createDataFrame(made, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute_components(made)
    assert written["blocks"] == written["sets"] == (1 if one_pass else 4)  # a small table needs no four rounds of every step


def test_shingle_join_takes_passes_only_where_rows_are_many(spark, monkeypatch):
    rng, made, written = np.random.default_rng(7), [], Counter()
    for i in range(60):
        base = base if i % 2 or i % 20 > 9 else [f"w{k}" for k in rng.integers(0, 4000, 90)]
        made.append((i, " ".join([*base, f"v{i}"])))
    monkeypatch.setattr(shingle_join, "ONE_PASS", 500)
    monkeypatch.setattr(shingle_join, "WIDE", 1, raising=False)
    monkeypatch.setattr(shingle_join, "materialize", lambda df, tag, real=shingle_join.materialize: written.update([tag]) or real(df, tag))
    got = shingle_join.jaccard_components(spark.createDataFrame(made, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute_components(made)
    assert written["blocks"] == 4 and written["sets"] == 1  # some thousand keys, 60 sets
    assert written["near-pairs"] == written["links-of-pairs"] == 2  # of the stars, and of the trees
    assert not written["live-blocks"]  # keys are shuffled once


@pytest.mark.parametrize("n", [40, 370, 2000])
def test_unlike_sets_share_no_block_of_empty_groups(n):
    rng, bands = np.random.default_rng(n), shingle_join.Bands(80, 100)
    keys = [bands.keys(np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))) for _ in range(200)]
    often = Counter(k for ks in keys for k in set(ks.tolist()))
    assert sum(len(ks) for ks in keys) and sum(v for v in often.values() if v > 1) < 0.01 * sum(map(len, keys))


@pytest.mark.parametrize(("num", "den"), [(70, 100), (80, 100), (90, 100)])
def test_linked_sets_share_a_block(num, den):
    rng, bands = np.random.default_rng(num), shingle_join.Bands(num, den)
    for n in [*range(1, 40), *range(40, 1500, 37)]:
        s = rng.integers(0, 1 << 63, n).astype(np.uint64)
        k = n * (den - num) // (den + num)  # so many members replaced
        other = np.r_[s[k:], rng.integers(0, 1 << 63, k).astype(np.uint64)]
        for x, y in ((s, other), (s, s[: -(-n * num // den)])):
            x, y = np.unique(x), np.unique(y)
            if len(x) != len(y) or (x != y).any():
                assert np.intersect1d(bands.keys(x), bands.keys(y)).size, (n, len(y))


@pytest.mark.parametrize("size", [1, 2, 7, 10000])
def test_shared_blocks(spark, size):
    rng = np.random.default_rng(size)
    rows = [(int(k), int(c)) for k, c in zip(rng.integers(-60, 60, 400), rng.integers(-3, 3, 400), strict=True)] + [(99, c) for c in range(50)] + [(100, 7)] * 30
    classes = {k: sorted({c for x, c in rows if x == k}) for k, _ in rows}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = shingle_join._shared(spark.createDataFrame(rows, "key long, cls long")).select("key", "cls", "lo").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(map(tuple, got)) == sorted((k, c, cs[0]) for k, cs in classes.items() if len(cs) > 1 for c in cs)


def test_few_members_do_not_shuffle_all_sets(spark, monkeypatch):
    plans = {}

    def materialize(df, tag, real=shingle_join.materialize):
        plans.setdefault(tag, []).append(df._jdf.queryExecution().sparkPlan().toString())
        return real(df, tag)

    for name, value in (("LEAF", 3), ("BOX", 2), ("FAN", 2), ("MANY", 1), ("materialize", materialize)):
        monkeypatch.setattr(shingle_join, name, value)
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(150)]
    made = []
    for i in range(40):
        w = list(base) + [f"z{k}" for k in range(i % 7)]
        for k in rng.integers(0, 150, 4):
            w[k] = f"v{i}{k}"
        made.append((i, " ".join(w)))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if the sets were many
    try:
        got = shingle_join.jaccard_components(spark.createDataFrame(made, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted(map(tuple, got)) == brute_components(made)
    assert not [p for p in plans["links-between"] if "SortMergeJoin" in p]


def test_count_tree(monkeypatch):
    monkeypatch.setattr(shingle_join, "BOX", 4)
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 3, (150, 30)).astype("<u2")
    counts[75:] = counts[:75]
    counts[75:, :2] += rng.integers(0, 2, (75, 2)).astype("<u2")
    n, root, cls = counts.sum(axis=1).astype(np.int64), np.arange(150) // 2, np.arange(1000, 1150)

    def may(i, k):
        return root[i] != root[k] and 90 * max(n[i], n[k]) <= 100 * min(n[i], n[k]) and 190 * np.minimum(counts[i], counts[k]).sum(dtype=int) >= 90 * (n[i] + n[k])

    want = {(1000 + i, 1000 + k) for i in range(150) for k in range(i + 1, 150) if may(i, k)}
    whole = shingle_join.CountTree(counts, n, root, cls)
    assert set(whole.pairs(90, 100)) == want and len(want) > 20
    x, y = (shingle_join.CountTree(counts[p], n[p], root[p], cls[p]) for p in (slice(0, 75), slice(75, 150)))
    assert set(x.pairs(90, 100, y)) | set(x.pairs(90, 100)) | set(y.pairs(90, 100)) == want


def test_mixing_budgets():
    leaves = {("a", "x"): mixing.Leaf(10), ("a", "y"): mixing.Leaf(100), ("b", "x"): mixing.Leaf(1000)}
    assert mixing.share_out(leaves, {}, 100, 1) == 0
    assert {k: v.budget for k, v in leaves.items()} == {("a", "x"): 10, ("a", "y"): 40, ("b", "x"): 50}  # a sibling first
    mixing.share_out(leaves, {}, 400, 1)
    assert {k: v.budget for k, v in leaves.items()} == {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 290}  # then the ancestors' other children
    assert mixing.share_out(leaves, {}, 5000, 2) == 5000 - 2220


def test_mixing(docs, plain, empty):
    marked = docs.withColumn("domain", F.expr(queries.DOMAIN))
    weights = {("web",): 3.0}
    out = mixing.mix(marked, 0.7, weights, max_epochs=2, seed=4).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch").collect()
    tokens = {r.doc_id: r.n_tokens for r in out}
    texts = dict(plain)
    assert all(n == len(words(texts[i])) for i, n in tokens.items())
    keys = {(r.seed0, r.doc_id): r.k for s in range(3) for r in marked.selectExpr("doc_id", f"{s} as seed0", f"shiftrightunsigned(xxhash64(4, {s}, doc_id), 1) as k").collect()}
    leaves, rows = defaultdict(list), marked.select("doc_id", "text", "domain", "lang", "source").collect()
    for r in rows:
        leaves[r.domain, r.lang, r.source].append((r.doc_id, len(words(r.text or ""))))
    plan = {k: mixing.Leaf(sum(n for _, n in v)) for k, v in leaves.items()}
    mixing.share_out(plan, weights, 0.7 * sum(x.tokens for x in plan.values()), 2)
    want = Counter()
    for k, own in leaves.items():
        total = plan[k].tokens
        need = min(round(plan[k].budget), 2 * total)
        whole = need // total if total else 2
        for e in range(whole):
            want.update((i, e) for i, _ in own)
        left, cut = need - whole * total, -1
        for i, n in sorted(own, key=lambda x: keys[whole, x[0]]):
            if left > 0:
                cut, left = keys[whole, i], left - n
        want.update((i, whole) for i, _ in own if keys[whole, i] <= cut)
    assert Counter((r.doc_id, r.epoch) for r in out) == want
    assert mixing.mix(empty.withColumn("domain", F.lit("x")), 0.5).count() == 0


def test_toxicity(spark, docs, plain, empty):
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in plain] + [(None, 1), (99999, 1), (3, None)], "doc_id long, toxic int")
    marked = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("zzgrk vorple zzgrk. "), F.col("text"))).otherwise(F.col("text")))
    out = toxicity.score(marked, labels).collect()
    assert len(out) == len(plain) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    mean = lambda k: np.mean([r.score for r in out if (r.doc_id % 5 == 0) == k and r.text])
    assert mean(True) > mean(False) + 0.3
    assert toxicity.drop_toxic(marked, labels).columns == marked.columns
    assert toxicity.score(empty, labels).count() == 0
    assert toxicity.score(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_toxicity_sends_texts_to_python_once_and_none_back(spark, docs, plain):
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in plain], "doc_id long, toxic int")
    scored = toxicity.score(docs, labels)
    plan = scored.where("predicted = 0")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython [") == 1
    assert sorted(r.doc_id for r in scored.collect()) == [i for i, _ in plain]


def test_workers_drop_the_encoder_when_toxicity_begins():
    first = encoder(BYTE)
    assert encoder(BYTE) is first
    assert list(toxicity._chunks(iter(()), "toxic", "text")) == []
    assert not common._kept and encoder(BYTE) is not first


def test_small_tables_start_no_python_worker(spark):
    grams = spark.createDataFrame([(0, 7, 1), (0, 8, 2), (0, 9, 3)], "m long, key long, n long").localCheckpoint()
    plan = ngrams.discounted(grams, toxicity.SHAPE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "LocalRelation" in plan
    rows = [("a", 1, None), (None, 2, 1.5)]
    assert [tuple(r) for r in common.rows_table(spark, rows, "s string, n int, x double").collect()] == rows
    none = common.rows_table(spark, [], "s string, n int, x double")
    assert none.count() == 0 and none.dtypes == [("s", "string"), ("n", "int"), ("x", "double")]


def test_pii(docs, plain, empty):
    tests = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def brute(t):
        out = []
        for kind, p in zip(pii.BASE, tests, strict=True):
            for m in p.finditer(t):
                d = re.sub("[^0-9]", "", m[0])
                if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                    continue
                out.append((kind, *m.span()))
        return out

    for t in ["a@b.c@d.e", "@a.b x@.y q@w..e", "00256.1.1.1 0255.1.1.1", "a@b-.c.d.", "1 2 3", "+1 +2 234-555-0000."]:
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(t)] == brute(t)
    out = pii.find(docs.select("doc_id", "text", "lang", "base", "spans"))
    for r in out.collect():
        assert [tuple(s) for s in r.base] == brute(r.text) and set(map(tuple, r.base)) <= set(map(tuple, r.spans))
    red = {r.doc_id: r.t for r in out.select("doc_id", pii.redact("text", "spans").alias("t")).collect()}
    assert red[1009].startswith("<PHONE> <CARD> <EMAIL>_<EMAIL>" if False else "<PHONE> <CARD> <EMAIL>") and red[1003] == "one"
    assert pii.find(empty.select("doc_id", "text")).count() == 0
    field = pii.Field.fit(pii.training_table())
    unseen = pii.training_table(100, seed=5)
    tags = field.decode([w for w, _ in unseen])
    assert np.mean([pii.TAGS[x] == y for got, (_, want) in zip(tags, unseen, strict=True) for x, y in zip(got, want, strict=True)]) > 0.97
    long = "a b " * 5 + "1 " + "c d " * 50 + "x@y e"
    assert [[long[a:b] for a, b in s] for s in pii.neighbourhoods(long)] == [["a", "b", "1", "c", "d"], ["c", "d", "x@y", "e"]]


def test_langid(spark, docs):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    odd = spark.createDataFrame([(9001, None, None), (9002, "", ""), (9003, "not an address", "<p>the"), (9003, "not an address", "<p>the")], pages.schema)
    out = langid.identify(pages.unionByName(odd).withColumn("lang", F.lit("x")).withColumn("host", F.lit("y")), docs).collect()
    truth = {r.page_id: r.l for r in pages.selectExpr("page_id", "regexp_extract(url, '//[^/]*/([a-z]+)/', 1) as l").collect()}
    right = [r.lang == truth[r.page_id] for r in out if r.page_id in truth]
    assert len(out) == len(truth) + 4 and np.mean(right) > 0.95 and all(0 < r.confidence <= 1 for r in out)
    assert langid.identify(pages.limit(0), docs).count() == 0 and langid.identify(pages, docs.limit(0)).count() == 0
