"""Hard negatives by the pivot table against all scores."""

import math
import random
from collections import Counter

import duckdb
import pytest

from gridspark.llm import pivot_table, queries

SCHEMA = "vec_id long, embedding array<double>, label int, anchor string, v string"


def plain(rows, every=100, positives=5, negatives=10):
    sound = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = Counter()
    for i, v, y in {(i, tuple(v), y) for i, v, y in sound if i % every == 0}:
        scored = [(-dot(v, w), j, z) for j, w, z in sound if j != i and len(w) == len(v)]
        for n, (ps, j, _) in enumerate(sorted(s[:2] + (0,) for s in scored if s[2] == y)[:positives], 1):
            inside = sorted(s[:2] for s in scored if s[2] != y and 30 * -ps <= 100 * -s[0] <= 90 * -ps)[:negatives]
            for rank, (ns, k) in enumerate(inside, 1):
                out[i, n, j, rank, k, -ps, -ns] += 1
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA)
    return Counter(map(tuple, pivot_table.hard_negatives(df, **more).collect()))


@pytest.mark.parametrize("block, pivots", [(16_384, 12), (37, 3), (50, 0)])
def test_equals_all_scores(spark, monkeypatch, block, pivots):
    monkeypatch.setattr(pivot_table, "BLOCK_ROWS", block)
    monkeypatch.setattr(pivot_table, "PIVOTS", pivots)
    monkeypatch.setattr(pivot_table, "BLOCK_ANCHORS", 4)
    rng = random.Random(block)
    centre = [[rng.gauss(0, 0.5) for _ in range(8)] for _ in range(4)]
    rows = []
    for i in range(300):
        y = rng.randrange(4)
        rows.append((i * 10, [round(c + rng.gauss(0, 0.4), 2) for c in centre[y]], y))
    rows += [(100, rows[11][1], 2), rows[20], rows[20], rows[21], (None, rows[3][1], 1), (5, None, 1), (6, [], 1), (7, [None] * 8, 1), (8, [math.nan] * 8, 1), (9, rows[4][1], None)]
    rows += [(200, [0.5, -0.5], 1), (201, [0.5, -0.25], 1), (202, [0.25, -0.25], 2), (203, [0.0, 0.0], 3), (5000, [0.0] * 8, 0), (5001, [1e9] * 8, 0)]
    assert found(spark, rows) == plain(rows)


def test_brackets_hold_every_score(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    values = rng.integers(-200, 200, (500, 16))
    largest = float((values**2).sum(axis=1).max())
    x = np.concatenate([values, np.sqrt(largest - (values**2).sum(axis=1))[:, None]], axis=1)
    table = pivot_table.Table(np.arange(500), np.zeros(500, np.int64), values, np.sqrt(((x[:, None] - x[None, :6]) ** 2).sum(axis=2)), x[:6], largest)
    for q in values[:20]:
        least, greatest = table.brackets(q)
        assert (least <= values @ q).all() and (values @ q <= greatest).all()
    assert (greatest - least).max() > 0


def test_no_rows(spark):
    assert not found(spark, [])
    assert not found(spark, [(7, [1.0, 2.0], 1)])
    assert not found(spark, [(100, [1.0, 2.0], 1)])


def test_query_equals_its_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/embeddings.parquet'")
    got = queries.op11_hard_negatives(spark, path)
    want = Counter(con.sql(f"select {', '.join(got.columns)} from ({queries.ORACLE_SQL['op11_hard_negatives']})").fetchall())
    assert want and Counter(map(tuple, got.collect())) == want
