"""Line dedup against comparing every pair of lines."""

import random

import pytest
from pyspark.sql import functions as F

from gridspark.llm import line_dedup


def plain_removed(rows):
    lines = sorted((i, n, frozenset(x.encode().split())) for i, t in rows if i is not None for n, x in enumerate((t or "").split("\n")))
    out = {}
    for k, (i, n, words) in enumerate(lines):
        if words and any(9 * len(words & other) >= 4 * (len(words) + len(other)) for _, _, other in lines[:k] if other):
            out.setdefault(i, set()).add(n)
    return out


@pytest.mark.parametrize("short_list", [32, 1])
def test_equals_all_pairs(spark, documents, monkeypatch, short_list):
    monkeypatch.setattr(line_dedup, "SHORT_LIST", short_list)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + [f"rare{i}" for i in range(900)]
    bases = [[rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 8, 12, 25, 60]))] for _ in range(40)]
    rows = []
    for i in range(160):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                line[rng.randrange(len(line))] = rng.choice(words)
            if rng.random() < 0.3:
                rng.shuffle(line)
            lines.append(rng.choice([" ", "  ", "\t"]).join(line))
        rows.append((i, "\n".join(lines)))
    rows += [(900, None), (901, "\n\n"), (902, "a b c d e\na b c d\nx\nx"), (903, "common " * 20_000 + "\n" + "end"), (904, "common"), (None, "w1 w2 w3")]
    want = plain_removed(rows)
    docs = documents(*rows)
    got = line_dedup.line_dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert set(r.removed) == want.get(r.id, set()), r
        assert r.n_removed == len(r.removed) and r.n_lines == len((dict(rows)[r.id] or "").split("\n"))
    left = line_dedup.without_lines(docs)
    assert left.columns == docs.columns
    for r in left.collect():
        text = dict(rows)[r.doc_id]
        assert r.text == (text if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in want.get(r.doc_id, set())))


def test_long_lists_are_split(spark, documents, monkeypatch):
    """Template lines share a prefix word: no task gets the whole list, and the result is that of all pairs."""
    monkeypatch.setattr(line_dedup, "SPLIT", 16)
    monkeypatch.setattr(line_dedup, "SHORT_LIST", 4)
    largest, found = [], line_dedup._candidates

    def counted(postings, threshold, every):
        largest.append(postings.groupBy("key").count().agg(F.max("count")).first()[0])
        return found(postings, threshold, every)

    monkeypatch.setattr(line_dedup, "_candidates", counted)
    rng = random.Random(7)
    lines = [f"Order {rng.randrange(10**6)} was shipped to the customer on Monday" for _ in range(150)]
    lines += [f"Order {rng.randrange(10**6)} of {rng.randrange(10**6)} was sent to our customer on Friday" for _ in range(80)]
    lines += [f"Order a{i % 9} b{i % 7} c{i % 5} d{i % 11} e{i % 4}" for i in range(200)]
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(len(lines) // 3 + 1)]
    want = plain_removed(rows)
    got = line_dedup.line_dedup(documents(*rows)).collect()
    assert {r.id: set(r.removed) for r in got if r.removed} == want
    assert max(largest) <= 80


def test_repeated_and_no_rows(spark, documents):
    docs = documents((1, "a b\na b"), (1, "a b\na b"), (2, "b a"))
    assert sorted((r.id, r.removed) for r in line_dedup.line_dedup(docs).collect()) == [(1, [1]), (1, [1]), (2, [0])]
    assert line_dedup.line_dedup(docs.where("false")).count() == 0
