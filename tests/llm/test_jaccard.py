"""The n-gram Jaccard join against all pairs in plain Python."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from gridspark.llm import parity_join, queries


def plain(rows):
    """(id, set size, smallest id reachable) of rows (id, text)."""
    sets = []
    for _, text in rows:
        w = bytes((text or "").encode()).lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for j, y in enumerate(sets):
        for i, x in enumerate(sets[:j]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                label[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[top(k)] = min(i, low.get(top(k), i))
    return Counter((i, len(sets[k]), low.get(top(k))) for k, (i, _) in enumerate(rows))


def made(rng, count):
    """Texts of many lengths with near copies at about the threshold, chains of them, a passage in many, and templates."""
    word = lambda: f"w{rng.randrange(4000)}"
    passage, out = [word() for _ in range(40)], []
    while len(out) < count:
        base = [word() for _ in range(rng.choice([1, 3, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 60, 120, 300]))]
        if rng.random() < 0.3:
            at = rng.randrange(len(base) + 1)
            base[at:at] = passage
        out.append(base)
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            copy = list(rng.choice(out[-3:]))
            for _ in range(max(1, int(len(copy) * rng.choice([0.0, 0.01, 0.02, 0.03])))):
                k = rng.randrange(len(copy))
                if rng.random() < 0.5:
                    copy[k] = word()
                else:
                    copy[k : k + 1] = []
                if not copy:
                    copy = ["x"]
            out.append(copy)
    template = [word() for _ in range(100)]
    for k in range(count // 4):
        copy = list(template)
        copy[k % 90 : k % 90 + 1 + k % 3] = [word()]
        out.append(copy)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("settings", [{}, {"SHORT_LIST": 2, "LONG_LIST": 3, "BLOCK": 4, "HOT": 2, "FREQUENT": 3}, {"FREQUENT": 2}, {"SLICE_BYTES": 200, "MOST_BITS": 1 << 16, "SHORT_LIST": 3, "BLOCK": 2}])
def test_join_equals_all_pairs(spark, documents, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(parity_join, name, value)
    texts = made(random.Random(sum(map(len, settings))), 160)
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, " \n"), (None, texts[0]), (None, "all of its own kind here"), (3, texts[3]), (3, texts[8]), (903, texts[5].upper()), (904, texts[5] + "\t\n")]
    docs = documents(*rows).withColumn("a.b", F.lit(1)).withColumn("n", F.lit("x")).withColumn("sig", F.lit("x"))
    assert Counter(map(tuple, parity_join.near_join(docs).select("id", "n_shingles", "component_id").collect())) == plain(rows)


def test_other_thresholds_and_shingles(spark, documents):
    texts = made(random.Random(9), 60)
    rows = list(enumerate(texts))
    found = parity_join.near_join(documents(*rows), threshold=(9, 10), shingle=1)
    sets = [set(t.split()) for t in texts]
    near = {(i, j) for j in range(len(sets)) for i in range(j) if 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j])}
    got = {r.id: r.component_id for r in found.collect()}
    assert near and all(got[i] == got[j] for i, j in near)
    assert sum(got[i] != i for i in got) <= len({j for _, j in near})


def test_empty_table(spark, documents):
    assert parity_join.near_join(documents((1, "x")).where("false")).count() == 0


def test_query_equals_its_sql(spark):
    path = "/root/testdata/sf0.001"
    got = Counter(map(tuple, queries.op12_jaccard_join(spark, path).select("doc_id", "n_shingles", "component_id").collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet'")
    assert got == Counter(con.sql(f"select doc_id, n_shingles, component_id from ({queries.ORACLE_SQL['op12_jaccard_join']})").fetchall())


@pytest.mark.parametrize(("named", "block"), [(64, 1024), (2, 1024), (0, 1024), (2, 4), (64, 4)])
def test_a_pair_is_compared_in_its_first_list(spark, monkeypatch, named, block):
    """Near copies share many lists: a pair of them is written once, not once for each."""
    monkeypatch.setattr(parity_join, "NAMED", named, raising=False)
    monkeypatch.setattr(parity_join, "BLOCK", block)
    rng = random.Random(5)
    lists = [rng.sample(range(24), 22) for _ in range(30)] + [rng.sample(range(30), 2) for _ in range(20)]
    keys = [rng.randrange(-(2**63), 2**63) for _ in lists]
    members = [(key, x, x) for key, nodes in zip(keys, lists, strict=True) for x in nodes]
    sketches = spark.createDataFrame([(x, 10, bytes(8)) for x in range(30)], "node long, n long, marks binary")
    found = parity_join._cells(spark.createDataFrame(members, "key long, node long, root long"), sketches, parity_join.THRESHOLD, forest=False)
    got = Counter(map(tuple, found.collect()))
    want = {(a, b) for nodes in lists for a in nodes for b in nodes if a < b}
    assert set(got) == want
    if named == 64:
        assert got.total() == len(want)
    elif named:
        assert got.total() < 2 * len(want)


def test_cells_hold_a_member_no_oftener_than_pairs_need(spark, monkeypatch):
    """A list of two blocks is one cell; each pair of a list is compared in one cell, of about two blocks."""
    monkeypatch.setattr(parity_join, "BLOCK", 20)
    members = spark.createDataFrame([(size, x) for size in (2, 20, 40, 41, 100) for x in range(size)], "key long, node long")
    cells: dict[tuple[int, int, int], list] = {}
    for r in parity_join._dealt(members).collect():
        cells.setdefault(tuple(r.cell), []).append(r)
    held = Counter((r.key, r.node) for rows in cells.values() for r in rows)
    assert {size: {n for (key, _), n in held.items() if key == size} for size in (2, 20, 40, 41, 100)} == {2: {1}, 20: {1}, 40: {1}, 41: {2}, 100: {4}}
    pairs = Counter((a.key, a.node, b.node) for rows in cells.values() for a in rows for b in rows if a.node < b.node and (a.block != b.block or a.within))
    assert pairs == Counter((size, a, b) for size in (2, 20, 40, 41, 100) for b in range(size) for a in range(b))


@pytest.mark.parametrize("settings", [{"SHORT_LIST": 2, "NAMED": 1}, {"SHORT_LIST": 3, "BLOCK": 8, "NAMED": 3}])
def test_join_equals_all_pairs_with_few_names(spark, documents, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(parity_join, name, value)
    rows = list(enumerate(made(random.Random(sum(settings.values())), 120)))
    assert Counter(map(tuple, parity_join.near_join(documents(*rows)).select("id", "n_shingles", "component_id").collect())) == plain(rows)
