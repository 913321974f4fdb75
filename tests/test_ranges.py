"""Sums, criteria and order statistics of many ranges at once, against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridspark.functions.criteria import criteria
from gridspark.functions.values import Value
from gridspark.operators import conditional_format as cf
from gridspark.operators import order_statistics, range_criteria, rectangles


def test_rectangles_equal_plain_sums(spark, monkeypatch):
    monkeypatch.setattr(rectangles, "SPAN", 2)
    rng = random.Random(4)
    cells = {(s, rng.randrange(500), rng.randrange(40)): (rng.randrange(-50, 50), 1) for s in "ab" for _ in range(600)}
    cells[("b", 70_000, 300)] = (7, 1)
    rows = [(*k, float(v), float(n)) for k, (v, n) in cells.items()]
    boxes = [(i, rng.choice("abc"), *(x for lo, hi in [sorted(rng.randrange(520) for _ in range(2))] for x in (lo, hi)), *(x for lo, hi in [sorted(rng.randrange(45) for _ in range(2))] for x in (lo, hi))) for i in range(150)]
    boxes += [(200, "b", 0, 1_000_000, 0, 16_000), (201, "b", 70_000, 70_000, 300, 300), (202, "b", 600, 69_000, 0, 400)]
    df = spark.createDataFrame(rows, "sheet string, row long, col long, total double, n double")
    ranges = spark.createDataFrame(boxes, "id long, sheet string, row long, end_row long, col long, end_col long")
    got = {r.id: (r.total, r.n) for r in rectangles.rectangle_sums(df, ranges, ["total", "n"]).collect()}
    for i, s, r1, r2, c1, c2 in boxes:
        inside = [v for (t, r, c), v in cells.items() if t == s and r1 <= r <= r2 and c1 <= c <= c2]
        assert got[i] == (sum(v for v, _ in inside), sum(n for _, n in inside)), i


CRITERIA = ["5", "=5", "<>5", ">2", ">=2", "<7", "<=7", "", "=", "<>", "<>x", "pear", "=PEAR", "<>pear", ">m", "<=pear", ">=zebra", "<", " > 3", None, "-1", "1e1", "<=", "> "]


@pytest.mark.parametrize("kind", ["number", "text"])
def test_criteria_as_rows_equal_constant_ones(spark, kind, monkeypatch):
    monkeypatch.setattr(range_criteria, "PARTS", 5)
    rng = random.Random(8)
    pool = [None, 0.0, 2.0, 5.0, 5.0, 7.0, 10.0, -1.0, 3.25] if kind == "number" else [None, "", "pear", "Pear", "PLUM", "5", " 5", "7", "zebra", "10", "x", "apple", "0"]
    data = [(g, rng.choice(pool), float(rng.randrange(9))) for g in ("a", "b") for _ in range(80)]
    values = spark.createDataFrame(data, f"g string, v {'double' if kind == 'number' else 'string'}, w double")
    asked = spark.createDataFrame([(i, g, c) for g in ("a", "b", "none") for i, c in enumerate(CRITERIA)], "i int, g string, c string")
    got = {(r.g, r.i): (r.n, r.total) for r in range_criteria.by_criteria(asked, values, by=["g"], criterion="c", value="v", summed="w").collect()}
    v = Value(F.col("v"), kind)
    met = [criteria(v, c) for c in CRITERIA]
    columns = [x for i, m in enumerate(met) for x in (F.count_if(m).alias(f"n{i}"), F.coalesce(F.sum(F.when(m, F.col("w"))), F.lit(0.0)).alias(f"s{i}"))]
    for r in values.groupBy("g").agg(*columns).collect():
        for i, c in enumerate(CRITERIA):
            assert got[r.g, i] == (r[f"n{i}"], r[f"s{i}"]), (r.g, c)
    assert all(got["none", i] == (0, 0.0) for i in range(len(CRITERIA)))


@pytest.mark.parametrize("most", [100_000, 3])
def test_order_statistics_of_ranges(spark, monkeypatch, most):
    monkeypatch.setattr(order_statistics, "SORTED", most)
    monkeypatch.setattr(order_statistics, "BANDS", 4)
    rng = random.Random(2)
    data = {g: [rng.choice([None, 1.0, 1.0, round(rng.gauss(0, 3), 1)]) for _ in range(n)] for g, n in (("hot", 400), ("b", 30), ("one", 1), ("same", 20))}
    data["one"], data["same"] = [2.5], [4.0] * 20
    rows = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double")
    places = [(g, p) for g in data for p in (0, 1, 2, 7, 19, 150, 399, 1000)]
    got = {(r.g, r.place): r.found for r in order_statistics.order_statistics(rows, spark.createDataFrame(places, "g string, place long"), by=["g"], value="v").collect()}
    for g, p in places:
        known = sorted(v for v in data[g] if v is not None)
        assert got[g, p] == (known[p - 1] if 1 <= p <= len(known) else None), (g, p)
    found = {r.g: (r.m, r.q) for r in order_statistics.percentiles(rows, by=["g"], value="v", shares={"m": 0.5, "q": 0.9}).collect()}
    exact = {r.g: (r.m, r.q) for r in rows.groupBy("g").agg(F.percentile("v", 0.5).alias("m"), F.percentile("v", 0.9).alias("q")).collect()}
    for g in data:
        assert found[g] == pytest.approx(exact[g])


def test_rules_of_ranges_equal_single_rules(spark):
    rng = random.Random(5)
    rules = {1: ("top10", 3, False, False), 2: ("top10", 30, True, True), 3: ("aboveAverage", None, None, None), 4: ("duplicateValues", None, None, None), 5: ("uniqueValues", None, None, None), 6: ("other", None, None, None), 7: ("top10", 10, True, False)}
    data = [(k, i, rng.choice([None, float(rng.randrange(12)), 3.0]), *rules[k], k == 3, None, None) for k in rules for i in range(60)]
    hits = spark.createDataFrame(data, "k int, i int, value double, type string, rank int, percent boolean, bottom boolean, below boolean, equal boolean, deviations double")
    got = Counter((r.k, r.i) for r in cf.holding_in_range(hits, by=["k"]).where("holds").collect())
    one = {
        1: lambda d: cf.top(d, "value", 3), 2: lambda d: cf.top(d, "value", 30, percent=True, bottom=True), 3: lambda d: cf.average_rule(d, "value", above=False),
        4: lambda d: cf.repeated(d, "value"), 5: lambda d: cf.repeated(d, "value", unique=True), 6: lambda d: d.withColumn("match", F.lit(False)), 7: lambda d: cf.top(d, "value", 10, percent=True),
    }
    want = Counter((k, r.i) for k, f in one.items() for r in f(hits.where(F.col("k") == k)).where("match").collect())
    assert got == want
