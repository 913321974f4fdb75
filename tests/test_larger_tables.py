"""Queries against their SQL on values and sizes that the small tables don't have."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspark.operators import outline, rectangles
from gridspark.operators import recalculate as rc
from gridspark.queries import ORACLE_SQL, QUERIES


def compared(spark, folder, name, **tables):
    """(rows of a query, rows of its SQL) over tables given as SQL."""
    con = duckdb.connect()
    for table, made in tables.items():
        con.execute(f"copy ({made}) to '{folder}/{table}.parquet' (format parquet)")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    got = QUERIES[name](spark, str(folder))
    columns = ", ".join(got.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted(map(tuple, got.collect()), key=key), sorted(con.sql(f"select {columns} from ({ORACLE_SQL[name]})").fetchall(), key=key)


def test_exact_halves_of_formats(spark, tmp_path):
    got, want = compared(spark, tmp_path, "numfmt_thousands_pct_neg", customer="select i as c_custkey, i * 12.5 :: double as c_acctbal from range(-80, 800) t(i)")
    assert len(got) == 880 and got == want


def test_negative_zeros_of_formats(spark, tmp_path):
    """Rounding a small debt to cents leaves -0.0, which the SQL's format shows with its sign."""
    made = "select i as c_custkey, [round(-0.004 :: double, 2), 0.0, -0.0, -0.001, 0.001, -0.01, null][i + 1] :: double as c_acctbal from range(7) t(i)"
    got, want = compared(spark, tmp_path, "numfmt_thousands_pct_neg", customer=made)
    assert got == want and ("0", "-0.00", "None", "0.0%") in {tuple(map(str, r)) for r in got}


LINES = """select i as l_orderkey, i % 5 + 1 :: integer as l_linenumber, 3 as l_partkey, 4 as l_suppkey, 900.0 + i % 77 as l_extendedprice, (i * 7 % 50) :: double as l_quantity, 0.05 as l_discount, (i % 9) / 100.0 as l_tax,
case when i % 10 < 8 then 'A' when i % 10 = 8 then 'N' else 'R' end as l_returnflag, 'O' as l_linestatus, timestamp '1996-01-01' as l_shipdate from range(3000) t(i)"""
PARTS = "select i as p_partkey, (i % 50 + 1) :: integer as p_size from range(60) t(i)"


@pytest.mark.parametrize("name", ["countif_row_ranges", "rectangle_totals", "outline_groups", "outline_hidden_rows"])
def test_rows_are_numbered_by_ranges(spark, tmp_path, name, monkeypatch):
    """Four fifths of the rows are one sheet: no window may hold it, and results are those of the SQL."""
    monkeypatch.setattr(outline, "BAND", 16)
    made = {"lineitem": LINES} | ({"part": PARTS} if name == "rectangle_totals" else {})
    got, want = compared(spark, tmp_path, name, **made)
    assert got and got == want
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "row_number(" not in plan


def test_runs_across_bands(spark, monkeypatch):
    monkeypatch.setattr(outline, "BAND", 8)
    rng = random.Random(6)
    level = {(s, r): rng.choice([0, 1, 1, 2, 2, 3]) if s == "a" else 2 for s in "ab" for r in range(100) if s == "b" or r % 31}
    rows = spark.createDataFrame([(s, r, n, r % 9 == 0) for (s, r), n in level.items()] + [("a", 40, 1, False)], "sheet string, row long, level int, collapsed boolean")
    wanted = set()
    for s in "ab":
        for k in (1, 2, 3):
            inside = [r for r in range(101) if level.get((s, r), 0) >= k]
            for first in (r for r in inside if r - 1 not in inside):
                last = next(r for r in range(first, 102) if r + 1 not in inside)
                wanted.add((s, k, first, last, (s, last + 1) in level and (last + 1) % 9 == 0))
    got = [tuple(r) for r in outline.groups(rows).collect()]
    assert len(got) == len(wanted) and set(got) == wanted


def test_stripes_that_span_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        cells = spark.range(1000).select(F.lit("s").alias("sheet"), F.col("id").alias("row"), (F.col("id") % 3).alias("col"), F.lit(1.0).alias("n"))
        ranges = spark.range(0, 900, 11).select(F.lit("s").alias("sheet"), F.col("id").alias("row"), F.lit(0).alias("col"), (F.col("id") + 80).alias("end_row"), F.lit(2).alias("end_col"))
        assert {r.n for r in rectangles.rectangle_sums(cells, ranges, ["n"]).collect()} == {81.0}
        assert "CoGroup" not in rectangles.rectangle_sums(cells, ranges, ["n"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("table", [1, 300, 1 << 20])
def test_stripes_are_added_up_together(monkeypatch, table):
    """One frame of sums for many stripes, whatever batches they come in; no more places at once than a table has."""
    monkeypatch.setattr(rectangles, "TABLE", table)
    rng = random.Random(table)
    rows = [(s, k, k * 64 + rng.randrange(64), rng.randrange(6), rng.random() < 0.4) for s in (None, "a", "b") for k in range(5) for _ in range(rng.randint(1, 20))]
    met = pd.DataFrame(rows, columns=["sheet", "stripe", "r", "c", "asked"])
    met["n"] = (~met["asked"]).astype(float)
    cells = [x for x in rows if not x[4]]
    wanted = [sum(x[:2] == (s, k) and x[2] <= r and x[3] <= c for x in cells) for s, k, r, c, asked in rows if asked]
    for size in (1, 3, 17, len(rows)):
        frames = list(rectangles._local(["n"])(met.iloc[i : i + size] for i in range(0, len(rows), size)))
        assert list(pd.concat(frames)["n"]) == wanted
    assert table < 1000 or len(frames) == 1


def test_recalculation_looks_no_further_than_the_sheet(spark, monkeypatch):
    """Ranges end with the sheet, equal lookups are made once, and nothing of a sheet's size is broadcast."""
    made = []
    striped = rc._striped
    monkeypatch.setattr(rc, "_striped", lambda *x: made.append(striped(*x)) or made[-1])
    cells = [("s", r, 0, "string", f"k{r % 3}", None) for r in range(200)] + [("s", r, 1, "number", str(r), None) for r in range(200)]
    cells += [("s", r, 2, "empty", "", f"=VLOOKUP(A{r + 1},$A$1:$B$900000,2)") for r in range(200)] + [("s", r, 3, "empty", "", f'=COUNTIF(A{r + 1}:A900000,"k1")') for r in range(200)]
    out = rc.recalculate(spark.createDataFrame(cells, "sheet string, row long, col long, kind string, value string, formula string"))
    got = {(r.row, r.col): r.value for r in out.where("col > 1").collect()}
    assert got == {(r, 2): str(r % 3) for r in range(200)} | {(r, 3): str(sum(q % 3 == 1 for q in range(r, 200))) for r in range(200)}
    assert sorted(x.count() for x in made) == [0, 0, 0, 3 * 4, sum(4 - r // 64 for r in range(200))]
