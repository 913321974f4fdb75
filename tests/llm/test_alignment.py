"""The tokenizer alignment against a plain version, text by text."""

import hashlib
import json
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridspark.llm import alignment, queries

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    names = {i: t for t, i in json.load(open(PATHS[0]))["model"]["vocab"].items()}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    out, links = [], []
    for text in texts:
        ids = [[], []]
        if text:
            ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
        spelt = [[bytes(byte[c] for c in names[i]) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]]
        if text and not b"".join(spelt[0]) == b"".join(spelt[1]) == (" " + text).encode():
            ids, spelt = [[], []], [[], []]
        ends = [[], []]
        for side in (0, 1):
            at = 0
            for t in spelt[side]:
                at += len(t)
                ends[side].append(at)
        groups, mine, at = [], [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            stop = [ends[s].index(cut, at[s]) + 1 for s in (0, 1)]
            groups.append("|".join(",".join(map(str, ids[s][at[s] : stop[s]])) for s in (0, 1)))
            mine.append((ids[0][stop[0] - 1], ids[1][stop[1] - 1]))
            at = stop
        links.append(mine)
        out.append([len(ids[0]), len(ids[1]), len(groups), len(mine), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    count = Counter(x for mine in links for x in mine)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(n, most.get(y, 0))
    return [(*o[:4], sum(count[x] == most[x[1]] for x in mine), sum(count[x] for x in mine), o[4]) for o, mine in zip(out, links, strict=True)]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

TEXTS = [
    "An ordinary text, with words.", None, "", " ", "  two  spaces ", "tab\there\nline\r\n", "<|endoftext|><s></s> <0x41>", "déjà vu naïve 東京タワー 🙂🙂", "a▁b", "▁",
    "An ordinary text, with words.", "\x00\x01", "é ﬁ", "123456 7890 1.5e-3", "don't I'll we're", "x" * 500, " nbsp  em",
]


@pytest.mark.parametrize("most", [1 << 20, 8, 0])
def test_alignment_equals_a_plain_one(spark, documents, monkeypatch, most):
    monkeypatch.setattr(alignment, "MOST_PAIRS", most)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "An ordinary text"), (None, "again An ordinary text"), (3, "An ordinary text")]
    docs = documents(*rows).withColumn("a.b", F.lit(1)).withColumn("n_a", F.lit("x")).withColumn("row", F.lit("x"))
    got = Counter((r.id, *(r[c] for c in COLUMNS)) for r in alignment.align(docs, *PATHS).collect())
    assert got == Counter((i, *w) for (i, _), w in zip(rows, plain([t for _, t in rows]), strict=True))


def test_long_texts_are_encoded_in_parts(spark, documents, monkeypatch):
    monkeypatch.setattr(alignment, "PART_BYTES", 32)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 64)
    rows = [(1, "word, and  more words-here " * 40), (2, "y" * 300 + " end "), (3, "Ünïcödé wörds “quoted”  10 000 \n" * 20), (4, "a " * 99), (5, "no.spaces" * 30)]
    got = {r.id: tuple(r[c] for c in COLUMNS) for r in alignment.align(documents(*rows), *PATHS).collect()}
    assert [got[i] for i, _ in rows] == plain([t for _, t in rows])


def test_aligned_has_the_groups(spark, documents):
    r = alignment.aligned(documents((1, "An ordinary text"), (2, None), (3, "more of it")), *PATHS).where("id = 3").first()
    assert r.a_ends[-1] == len(r.a_ids) and r.b_ends[-1] == len(r.b_ids) and r.byte_ends[-1] == len(" more of it") and len(r.byte_ends) == len(r.a_ends)


def test_empty_table(spark, documents):
    assert alignment.align(documents((1, "x")).where("false"), *PATHS).count() == 0


def test_query_on_whole_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op13_token_alignment(spark, path).collect()}
    assert got == {i: w for (i, _), w in zip(rows, plain([t for _, t in rows]), strict=True)}
