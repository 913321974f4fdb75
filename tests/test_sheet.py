"""The sheet as shown, rule expressions and graphics: the cases that tables don't have."""

import pytest
from pyspark.sql import functions as F

from gridspark.functions import number_format as nf
from gridspark.operators import conditional_format as cf
from gridspark.operators import grid, sheet
from gridspark.plans.rule_expression import Cell, rule_expression

CELLS = [("Total due", "string"), ("12.5", "number"), ("-3", "number"), ("TRUE", "boolean"), ("#REF!", "error"), ("", "empty"), ("7", "string"), (None, None)]


@pytest.mark.parametrize(
    ("formula", "want"),
    [
        ("A1>5", [False, True, False, False, False, False, True, False]),
        ("$B$9 <= 0", [False, False, True, False, False, True, False, True]),
        ("A1=1", [False, False, False, True, False, False, False, False]),
        ("A1<-2.5", [False, False, True, False, False, False, False, False]),
        ("NOT(A1>5)", [True, False, True, True, True, True, False, True]),
        ("ISODD(A1)", [False, False, True, True, False, False, True, False]),
        ("ISNUMBER(A1)", [False, True, True, True, False, False, False, False]),
        ("ISBLANK(A1)", [False, False, False, False, False, True, False, True]),
        ("iserror(A1)", [False, False, False, False, True, False, False, False]),
        ('SEARCH("TOTAL",A1)>0', [True] + [False] * 7),
        ('SEARCH("total",A1)=0', [False] * 8),
        ('ISNUMBER(SEARCH("a""b",A1))', [False] * 8),
        ('LEFT(A1,5)="Total"', [True] + [False] * 7),
        ('LEFT(A1,5)="total"', [False] * 8),
        ('RIGHT(A1,0)=""', [True] * 8),
        ("MOD(ROW(),3)=1", [True, False, False, True, False, False, True, False]),
        ("MOD(ROW(),-3)=-2", [True, False, False, True, False, False, True, False]),
        ("MOD(ROW(),0)=0", [False] * 8),
        ("AND()", [False] * 8),
        ("OR(A1>5,ISBLANK(A1),NOPE(A1))", [False, True, False, False, False, True, True, True]),
        ("A1:B2>3", [False] * 8),
        ("SUM(A1)>3", [False] * 8),
        ("((", [False] * 8),
        ("", [False] * 8),
    ],
)
def test_rule_expression(spark, formula, want):
    df = spark.createDataFrame([(i + 1, *c) for i, c in enumerate(CELLS)], "row long, value string, kind string")
    hit = rule_expression(formula, Cell(F.col("value"), F.col("kind"), F.col("row"), F.lit(1)))
    assert [r.hit for r in df.select("row", hit.alias("hit")).orderBy("row").collect()] == want


def test_dense_without_cells_merges_or_rows(spark):
    sheets = spark.createDataFrame([("a", 2, 2), ("b", 0, 5), ("c", 1, 0)], "sheet string, rows int, cols int")
    cells = spark.createDataFrame([("a", 1, 0, "x")], "sheet string, row int, col int, value string")
    got = sorted(map(tuple, sheet.dense(sheets, cells, by=["sheet"]).collect()))
    assert got == [("a", 0, 0, None), ("a", 0, 1, None), ("a", 1, 0, "x"), ("a", 1, 1, None)]
    assert sheet.dense(sheets.where("false"), cells, by=["sheet"]).count() == 0
    merges = spark.createDataFrame([("a", 0, 0, 1, 1)], "sheet string, row int, col int, end_row int, end_col int")
    assert [tuple(r) for r in sheet.dense(sheets, cells, by=["sheet"], merges=merges).collect()] == [("a", 0, 0, 2, 2, None)]


def test_spine_of_many_stripes(spark):
    sheets = spark.createDataFrame([(1, 2500, 3)], "sheet int, rows int, cols int")
    got = sheet.spine(sheets, by=["sheet"])
    assert got.count() == got.distinct().count() == 7500
    assert got.agg(F.max("row"), F.max("col")).first()[:] == (2499, 2)


def test_table_rows_span_and_escape(spark):
    places = spark.createDataFrame([("s", 0, 1, "a<b", 1, 1, ""), ("s", 0, 0, "x", 2, 3, "bold"), ("s", 2, 0, None, 1, 1, None)], "sheet string, row int, col int, text string, row_span int, col_span int, look string")
    got = dict(sheet.table_rows(places, by=["sheet"], classes=F.col("look")).select("row", "html").collect())
    assert got == {0: '<tr><td rowspan="2" colspan="3" class="bold">x</td><td>a&lt;b</td></tr>', 2: "<tr><td></td></tr>"}


def test_displayed(spark):
    rows = [("5", "number", None, "5.00"), ("5", "number", "A1", "5.00"), ("", "empty", "A1", None), (None, None, None, None), ("yes", "string", None, "0"), ("8", "number", None, None)]
    df = spark.createDataFrame(rows, "v string, k string, f string, s string")
    for formulas, want in ((False, ["5.00", "5.00", "=A1", "", "yes", "8"]), (True, ["5.00", "=A1", "=A1", "", "yes", "8"])):
        shown = sheet.displayed(F.col("v"), F.col("k"), F.col("f"), F.col("s"), formulas=formulas)
        assert [r[0] for r in df.select(shown["text"]).collect()] == want


def test_built_in_codes(spark):
    got = spark.range(1).select(*[nf.code_of(F.lit(i)) for i in (0, 14, 49, 23, None)], nf.code_of(F.lit(2), F.lit("0.000"))).first()
    assert list(got) == ["General", "mm-dd-yy", "@", None, None, "0.000"]


def test_hidden_visible_controls(spark):
    assert spark.sql("values ('x', 'hidden'), ('y', null), ('z', 'visible'), ('w', 'veryHidden') as t(n, state)").transform(sheet.visible).select("n").orderBy("n").collect() == [("y",), ("z",)]
    kinds = spark.createDataFrame([("Drop",), ("SPIN",), ("thing",), (None,)], "t string").select(sheet.control_kind(F.col("t"))).collect()
    assert [k[0] for k in kinds] == ["combo", "spinner", "unknown", "unknown"]


def test_ruby(spark):
    runs = "array<struct<start:int,end:int,phonetic:string>>"
    rows = [("東京都", [(0, 2, "とうきょう"), (1, 3, "x")]), ("ab", None), ("", [(0, 1, "x")]), (None, [(0, 1, "x")]), ("abc", [(2, 1, "x"), (1, 9, "y")])]
    df = spark.createDataFrame(rows, f"t string, r {runs}")
    got = [r[0] and [tuple(p) for p in r[0]] for r in df.select(sheet.ruby(F.col("t"), F.col("r"))).collect()]
    assert got == [[("東京", "とうきょう"), ("都", None)], [("ab", None)], [], None, [("a", None), ("bc", "y")]]


def test_last_graphic_ties(spark):
    hits = spark.createDataFrame([(1, "bar", 1, 0, "a"), (1, "bar", 2, 1, "b"), (1, "bar", 2, 2, "c"), (1, "icon", 0, 3, "d"), (2, "bar", 9, 0, None)], "cell int, kind string, priority int, place int, look string")
    assert sorted(cf.last_graphic(hits, by=["cell"]).select("cell", "kind", "look").collect()) == [(1, "bar", "c"), (1, "icon", "d"), (2, "bar", None)]


def test_bar_look(spark):
    df = spark.createDataFrame([(-1.0, 10.0), (2.0, 90.0), (3.0, None)], "v double, percent double")
    assert [r.bar_colour for r in cf.bar_look(df, "v", fill="#0f0", negative="#f00").collect()] == ["#f00", "#0f0", None]
    assert [r.bar_colour for r in cf.bar_look(df, "v", fill="#0f0").collect()] == ["#0f0", "#0f0", None]


def test_rules_that_rows_carry(spark):
    ranges = spark.createDataFrame([("s", 0, 0, 9, 0, "cellIs", "notBetween", "2", "4", None), ("s", 0, 0, 9, 0, "containsErrors", None, None, None, None), ("s", 0, 0, 9, 0, "endsWith", None, None, None, ""), ("s", 0, 0, 9, 0, "aboveAverage", None, None, None, None)], "sheet string, row int, col int, end_row int, end_col int, type string, operator string, first string, second string, text string")
    cells = spark.createDataFrame([("s", 0, 0, "3", "number"), ("s", 1, 0, "5", "number"), ("s", 2, 0, "TRUE", "boolean"), ("s", 3, 0, "#N/A", "error"), ("s", 4, 0, "word", "string")], "sheet string, row int, col int, value string, kind string")
    hits = grid.in_ranges(cells, ranges, by=["sheet"]).select("row", "value", "kind", *[F.col(f"range_{c}").alias(c) for c in ("type", "operator", "first", "second", "text")])
    got = sorted(map(tuple, hits.where(cf.holding(hits)).select("type", "row").collect()))
    assert got == [("cellIs", 1), ("cellIs", 2), ("containsErrors", 3)]
