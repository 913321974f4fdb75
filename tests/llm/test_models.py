"""BPE against the tokenizer library, SimHash and top-k against brute force, models on held-out rows."""

import base64
import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridspark.llm import bit_sliced, byte_bpe, language_id, simhash, toxicity
from gridspark.llm.common import split_of

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def hostile_texts():
    rng = random.Random(3)
    letters = ["abcdefgh", "aA", "é漢字ñ\U0001f600", "!?.,:;#%$", "0123456789", " \t\n\u00a0"]
    texts = ["".join(rng.choice(rng.choice(letters)) for _ in range(rng.randrange(400))) for _ in range(150)]
    runs = ["a" * 3000, "=" * 5001, "ab" * 2500, "\U0001f600" * 700, "".join(rng.choice("etaoin") for _ in range(4000)), " " * 900 + "x", "0" * 1111, "<|endoftext|>"]
    return texts + runs + ["", "x", "it's we'll"]


def test_bpe_equals_the_library(spark, documents):
    enc, texts = library(), hostile_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (1, texts[1]), (None, "null id")]
    got = byte_bpe.encode_decode(documents(*rows), RANKS, P.PATTERN, with_ids=True).collect()
    assert len(got) == len(rows)
    by_id = dict(rows)
    for r in got:
        text = by_id[r.id] or ""
        ids = enc.encode_ordinary(text)
        assert r.ids == ids, text[:80]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.identical
    assert byte_bpe.encode_decode(documents((1, "x")).where("false"), RANKS, P.PATTERN).count() == 0


def test_bpe_in_slices():
    vocab, enc = byte_bpe.vocabulary(byte_bpe.read_ranks(RANKS)), library()
    words = [w for t in hostile_texts() for w in t.split()]
    assert vocab.encode([w.encode() for w in words]) == [[i for i in enc._encode_single_piece(w)] for w in words]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark, documents):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(1, 250))]
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += ["", None, "\u00a0", "A b", "a\tB", " a  b ", "one"]
    rows = list(enumerate(texts, 100)) + [(100, texts[0])]
    got = simhash.near_dedup(documents(*rows)).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    label = plain_components(fps)
    want = {}
    for (i, _), k in zip(rows, label, strict=True):
        want[k] = min(want.get(k, i), i)
    assert sorted((r.id, r.fp % 2**64, r.component_id) for r in got) == sorted((i, f, want[k]) for (i, _), f, k in zip(rows, fps, label, strict=True))
    assert simhash.keep_one(documents(*rows)).count() == len(set(want.values()))
    assert simhash.near_dedup(documents(*rows).where("false")).count() == 0


def test_keep_one_where_ids_do_not_identify(spark, documents):
    rng = random.Random(6)
    unlike = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(60)) for _ in range(7)]
    far = 2**60 + 1  # no float holds it
    rows = [(None, unlike[0]), (None, unlike[1]), (None, unlike[2]), (None, unlike[2]), (far, unlike[3]), (far, unlike[4]), (far, unlike[4].upper())]
    rows += [(9, unlike[5]), (None, unlike[5]), (9, unlike[3]), (8, unlike[6]), (8, None), (8, "")]
    fps = [plain_fingerprint(t) for _, t in rows]
    want = {}
    for (i, t), f, k in zip(rows, fps, plain_components(fps), strict=True):
        digest = b"" if t is None else hashlib.sha256(t.encode()).digest()
        mine = (i is None, i or 0, f - 2**64 if f >> 63 else f, digest, t)
        want[k] = min(want.get(k, mine), mine, key=lambda x: x[:4])
    for parts in (1, 5):
        got = simhash.keep_one(documents(*rows).repartition(parts)).collect()
        assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(str((None if none else i, t)) for none, i, _, _, t in want.values())


@pytest.mark.parametrize("bucket", [512, 4])
def test_links_keep_components(spark, monkeypatch, bucket):
    """Balls of fingerprints around few centres: buckets are split when they are large, and no link is lost."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(8)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4))))
    chain = rng.getrandbits(64)
    for step in range(20):
        fps.add(chain)
        for b in (step * 3 % 64, (step * 3 + 1) % 64, (step * 3 + 2) % 64):
            chain ^= 1 << b
    fps = sorted(fps)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    found = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")))
    root = {r.node: r.root for r in found.collect()}
    got = {}
    for f in signed:
        got.setdefault(root.get(f, f), set()).add(f)
    want = {}
    for f, k in zip(signed, plain_components(fps), strict=True):
        want.setdefault(k, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_every_near_pair_shares_a_table():
    rng = random.Random(1)
    masks = simhash.covering_masks(3)
    for _ in range(5000):
        x, y = rng.getrandbits(64), 0
        y = x ^ sum(1 << b for b in rng.sample(range(64), 3))
        shared = [m for m in masks if x & m == y & m]
        assert shared
        for m in shared:
            assert any(x & p == y & p for p in simhash.split_masks(m, 3))


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(0, 0.125, (700, 16)).astype(np.float32)
    vectors[300:400] = vectors[17]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    rows += [(800, None, 0), (900, [None] * 16, 0), (1000, [float("nan")] * 16, 0), (1001, [float("inf")] * 16, 0), (1100, [], 0), (None, [0.5] * 16, 0), rows[17], (1200, [40.0] * 16, 0), (1201, [-3000.5] * 16, 0), (1300, [1.0] * 3, 0), (1301, [2.0] * 3, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(1)).withColumn("rank", F.lit(1))
    # A repeated row is a candidate as often as it is there: every row but the query's own is one.
    sound = [(i, np.floor(np.array(v, np.float32).astype(float) * 1024).astype(np.int64)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in sound:
        if q % 100 == 0:
            best = sorted((-int(a @ b), i) for i, b in sound if i != q and len(b) == len(a))[:10]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    for block in (16_384, 64):
        bit_sliced.BLOCK_ROWS = block
        assert sorted(map(tuple, bit_sliced.top_k(df).collect())) == sorted(want)
    bit_sliced.BLOCK_ROWS = 16_384
    assert bit_sliced.top_k(df.where("false")).count() == 0


def test_unlike_vectors_on_one_id_are_queries_of_their_own(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (100, [0.0, 1.0])] + [(i, [i / 64, (29 - i) / 64]) for i in range(1, 30)]
    got = bit_sliced.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = [(100, r + 1, i, 1024 * 16 * i) for r, i in enumerate(range(29, 19, -1))] + [(100, r + 1, i, 1024 * 16 * (29 - i)) for r, i in enumerate(range(1, 11))]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_takes_large_components(spark):
    rows = [(0, [0.001, 0.5]), (1, [2.0e15, 1.0]), (2, [-2.0e15, 1.0]), (3, [1.0, 1.0]), (4, [1e30, 0.0])]
    got = bit_sliced.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1024 * 2 * 10**15 + 512 * 1024), (3, 1024 + 512 * 1024), (2, -1024 * 2 * 10**15 + 512 * 1024)]


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.train(docs.where(split_of(F.col("doc_id"), 4) != 2))
    held_out = language_id.identify(docs.where(split_of(F.col("doc_id"), 4) == 2), model).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id").collect()
    assert np.mean([r.lang_pred == r.lang for r in held_out]) >= 0.97 and np.mean([r.accepted for r in held_out]) >= 0.99
    assert all(0 <= r.score <= 1 for r in held_out)


def test_language_edge_cases(spark, documents):
    rows = [(i, f"the {w} of and to the", "en") for i, w in enumerate(["house", "horse", "mouse"] * 5)] + [(50 + i, f"der {w} und das von", "de") for i, w in enumerate(["hund", "vogel", "fisch"] * 5)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "12 34 !!", "de"), (103, "the house", None), (103, "the house", None), (104, "und das\n" * 200_000, "de"), (None, "of the", "en")]
    docs = documents(*rows)
    got = language_id.identify(docs, language_id.train(docs)).collect()
    assert len(got) == len(rows)
    by_id = {r.id: r for r in got}
    assert [by_id[i].lang_pred for i in (100, 101, 102, 103, 104, None)] == ["und", "und", "und", "en", "de", "en"]
    assert not by_id[100].accepted and by_id[100].score == 0
    assert language_id.train(docs.where("false")) is None
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.identify(docs.where("false"), None).count() == 0


def test_languages_are_learned_beside_null_ids_and_texts(spark, documents):
    rows = [(i, "the house of and to the", "en") for i in range(8)] + [(None, "der hund und das von", "de")] * 30 + [(100 + i, None, "de") for i in range(40)] + [(50 + i, "der hund und das von", "de") for i in range(8)]
    assert language_id.train(documents(*rows), rows_per_language=8).languages == ["de", "en"]


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels.where(split_of(F.col("doc_id"), 5) != 0))
    held_out = toxicity.score(docs, model).join(labels.select(F.col("doc_id").alias("id"), "toxic"), "id").where(split_of(F.col("id"), 5) == 0).collect()
    positive, negative = [r.score for r in held_out if r.toxic], [r.score for r in held_out if not r.toxic]
    assert np.mean([p > n for p in positive for n in negative]) > 0.95
    assert np.mean([p >= 0.5 for p in positive]) > 0.85 and np.mean([n < 0.5 for n in negative]) > 0.98


def test_toxicity_finds_sentences(spark, documents):
    rows = [(i, f"A calm day {i}. The sky is blue.{' You utter gronk here!' if i % 3 == 0 else ''} Nice weather.") for i in range(90)]
    rows += [(200, None), (201, ""), (202, "..."), (203, "Fine. " * 3000 + "What a gronk. " + "Fine. " * 3000), (203, "x"), (None, "gronk"), (204, "Fine. " * 3000 + "You utter gronk here! " + "Fine. " * 3000), (205, "Fine. " * 6000)]
    docs = documents(*rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (201, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.id is not None and r.id < 90:
            assert (r.score >= 0.5) == (r.id % 3 == 0)
            assert all("gronk" in dict(rows)[r.id][s.start : s.end] for s in r.offending)
    assert [r.score for r in got if r.id in (200, 201, 202)] == [0, 0, 0]
    by_id = {r.id: r for r in got if r.id != 203}
    gronk = max(r.score for r in got if r.id == 203)
    assert by_id[204].score >= 0.5 and len(by_id[204].offending) == 1
    assert by_id[205].score < 0.5 and not by_id[205].offending and by_id[205].score < gronk
    assert toxicity.train(docs, labels.where("false")) is None
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_clean_texts_of_any_length_stay_clean(spark, documents):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(docs, labels.where(split_of(F.col("doc_id"), 5) != 0))
    plain = "It is a calm day by the sea. "
    rows = [(n, plain * n) for n in (1, 10, 100, 1000, 10_000)] + [(-1, plain * 10_000 + "You idiot and moron.")]
    got = {r.id: r for r in toxicity.score(documents(*rows), model).collect()}
    assert all(got[n].score < 0.5 and not got[n].offending for n, _ in rows if n > 0)
    assert got[-1].score >= 0.5 and len(got[-1].offending) == 1
