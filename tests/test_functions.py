"""Formulas, criteria, formats, references, grids and workbooks on small tables."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from gridspark.functions import number_format as nf
from gridspark.functions.criteria import criteria
from gridspark.functions.references import a1_to_r1c1, column_index, column_letters, index_column, letters_column, parse_range, r1c1_to_a1
from gridspark.functions.values import number, text
from gridspark.operators import charts, grid, hierarchy
from gridspark.operators import conditional_format as cf
from gridspark.plans.formula import aggregate_formulas, formula
from gridspark.sources.xlsx import Workbooks, range_to_table

FORMULAS = [
    ("=IFERROR(7/0,-1)", -1.0), ('=SWITCH("b","a",10,"b",20)', 20.0), ("=ROUND(8.3462,3)", 8.346), ("=ROUND(8765.4,-3)", 9000.0), ("=ROUND(-4.5,0)", -4.0), ("=ROUND(2.155,2)", 2.15),
    ("=ROUNDUP(-0.41,1)", -0.5), ("=INT(-8.1)", -9.0), ("=3^2^2", 81.0), ("=-3^2", 9.0), ("=MOD(17,-5)", -3.0), ('=TRIM("   two   spaces  here ")', "two spaces here"), ('=UPPER("gRid")', "GRID"),
    ('=LEFT("sheet")', "s"), ('=RIGHT("sheet",0)', ""), ('=MID("workbook",5,4)', "book"), ("=9/0", "#DIV/0!"), ("=SQRT(-16)", "#NUM!"), ("=UNKNOWN(3)", "#NAME?"), ("=4*", "#VALUE!"), ("=Other!B7", "#VALUE!"),
    ('="seven"*2', "#VALUE!"), ('="12"-2', 10.0), ('="Row"="ROW"', True), ('=8="8"', False), ("=FALSE>99", True), ('="n"&2.25&FALSE', "n2.25FALSE"), ("=12.5%", 0.125), ("=IFNA(#N/A,6)", 6.0), ("=IFNA(3/0,6)", "#DIV/0!"),
    ("=IFS(FALSE,8)", "#N/A"), ("=AND(TRUE,3)", True), ("=OR(FALSE,0,0)", False), ('=0.7+0.1&""', "0.8"), ('=LEFT("y",-2)', "#VALUE!"), ("=POWER(0,-2)", "#NUM!"), ("=IF(1,4,1/0)", 4.0), ("=#REF!", "#REF!"), ("=Z1", "#REF!"),
    ("=IFS(TRUE,1/0)", "#DIV/0!"), ("=IFS(TRUE,1,1/0,2)", 1.0), ("=IFS(1/0,1,TRUE,2)", "#DIV/0!"), ('=IFS(FALSE,1,TRUE,"two")', "two"), ("=IFS()", "#VALUE!"), ("=IFS(TRUE)", "#VALUE!"), ("=SWITCH(1,1,1/0,5)", "#DIV/0!"),
    ('=SWITCH(3,1,"a",7)', "7"), ("=SWITCH(1,2)", "#VALUE!"), ("=SWITCH(2,1/0,1,2,3)", "#DIV/0!"), ("=SWITCH(9,1,2)", "#N/A"), ("=ROUND(1e20,0)", 1e20), ("=INT(1e20)", 1e20), ("=ROUNDUP(-1e20,0)", -1e20), ("=MOD(1e20,7)", 1e20 - 7 * float(10**20 // 7)),
    ('=0.00001&""', "0.00001"), ('=1e15&""', "1000000000000000"), ('=1.5e22&""', "1.5e+22"), ('=-1e-7&""', "-1e-7"), ('=123456.789&""', "123456.789"), ('=1e20&""', "100000000000000000000"), ('=0.00012345&""', "0.00012345"),
    ("=AND()", False), ("=OR()", "#VALUE!"), ("=A:B+1", "#VALUE!"), ("=A:B", "#VALUE!"), ("=ROUND(A:B,1)", "#VALUE!"),
]


def test_formulas(spark):
    df = spark.range(1)
    made = [formula(f, df) for f, _ in FORMULAS]
    row = df.select(*[v.plain().alias(f"v{i}") for i, v in enumerate(made)], *[(v.error if v.error is not None else F.lit(None)).cast("string").alias(f"e{i}") for i, v in enumerate(made)]).first()
    for i, (source, want) in enumerate(FORMULAS):
        got = row[f"e{i}"] or row[f"v{i}"]
        assert (got == pytest.approx(want) if isinstance(want, float) else got == want) or (want in (False, "") and row[f"v{i}"] == want), (source, got)


def test_aggregates_over_ranges(spark):
    rows = [(1, 1.0, 10.0, "x"), (2, -5.0, 20.0, "Y"), (3, 2.0, None, "x"), (4, None, 40.0, None), (5, -5.0, 50.0, "7")]
    df = spark.createDataFrame(rows, "n int, a double, b double, t string").select("a", "b", "t", "n")
    wanted = {
        "=SUM(A:B)": 113.0, "=SUM(A1:A2)": -4.0, "=SUM(B:A,A3:B3)": 115.0, "=SUM()": 0.0, "=AVERAGE(B2:B4)": 30.0, "=MAX(A2:B3)": 20.0, "=COUNT(A:C)": 8, "=COUNTA(C1:C4)": 3, '=SUMIF(A:A,">"&1)': 2.0, "=SUMIF(A:A,-5)": -10.0, "=COUNTIF(A:A,-5)": 2,
        "=COUNTIF(A:A,1+1)": 1, '=SUMIF(C:C,"x",B:B)': 10.0, '=COUNTIF(A:B,">=10")': 4, "=SUMIF(A:A)": "#VALUE!", "=COUNTIF(C:C,7)": 1, '=COUNTIF(C:C,"<>x")': 2, '=COUNTIF(C:C,"")': 1, "=AND(A:A)": True, "=OR(B:B)": True, "=CONCAT(C:C)": "xYx7",
        '=VLOOKUP(-5,A:C,3)': "Y", '=VLOOKUP("X",C:C,1)': "x", "=VLOOKUP(99,A:B,2)": "#N/A", "=VLOOKUP(1,A:B,3)": "#REF!", "=VLOOKUP(1,A:B,0)": "#VALUE!", "=VLOOKUP(1,A:B,2,FALSE)": "#VALUE!", "=VLOOKUP(1,A:B,2,TRUE)": 10.0, "=AVERAGE(C1:C2)": "#DIV/0!",
    }
    made = aggregate_formulas(df, {f"f{i}": f for i, f in enumerate(wanted)}, row="n").first().asDict()
    for i, (source, want) in enumerate(wanted.items()):
        assert (made.get(f"f{i}_error") or made[f"f{i}"]) == want, source
    no_rows = aggregate_formulas(df, {"x": "=SUM(A1:A2)", "y": "=SUM(A:A)"}).first()
    assert no_rows.x_error == "#VALUE!" and no_rows.y == -7.0


def test_trees_without_a_top_and_large_orders(spark):
    edges = spark.createDataFrame([("r", "b", 1000001), ("r", "a", 1000000), ("r", "c", 999999)], "src string, dst string, ord long")
    nodes = spark.createDataFrame([(x, "pt") for x in "rabc"], "id string, kind string")
    got = hierarchy.levels(nodes, edges).orderBy("path").collect()
    assert [(r.id, r.level) for r in got] == [("r", 0), ("c", 1), ("a", 1), ("b", 1)]
    topped = hierarchy.levels(nodes.union(spark.createDataFrame([("top", "doc")], nodes.schema)), edges.union(spark.createDataFrame([("top", "r", 3)], edges.schema)))
    assert [r.id for r in topped.orderBy("path").collect()] == ["r", "c", "a", "b"]


def test_ampersands_of_zones(spark):
    row = spark.range(1).select(grid.header_zones(F.lit("&LA&&Left&RB&&&C&&C")).alias("z")).first().z
    assert tuple(row) == ("A&&Left", "&&C", "B&&")


def test_order_statistics_of_few_values(spark, monkeypatch):
    monkeypatch.setattr(cf, "_SORTED", 50)
    df = spark.range(4000).select((F.col("id") % 2).cast("double").alias("v"))
    assert [cf.order_statistic(df, "v", k) for k in (1, 2000, 2001, 4000)] == [0.0, 0.0, 1.0, 1.0] and cf.order_statistic(df, "v", 2000, descending=True) == 1.0


@pytest.mark.parametrize(("criterion", "want"), [(">=11", [40, 11, 25]), ("<>8", [None, 2.5, 40, 11, 25]), ("<>bar", [2.5, 40, 11, 8, 25]), (8, [8]), ("8", [8]), ("", [None]), (None, [None])])
def test_number_criteria(spark, criterion, want):
    df = spark.createDataFrame([(x,) for x in (2.5, 40.0, 11.0, 8.0, 25.0, None)], "x double")
    got = [r.x for r in df.where(criteria(number(F.col("x")), criterion)).collect()]
    assert sorted(got, key=lambda x: x or 0) == sorted(want, key=lambda x: x or 0)


def test_text_criteria(spark):
    df = spark.createDataFrame([(x,) for x in ("oak", "ELM", "3", "", None)], "x string")
    got = lambda c: {r.x for r in df.where(criteria(text(F.col("x")), c)).collect()}
    assert got("OAK") == {"oak"} and got("<>oak") == {"ELM", "3", ""} and got("<>9") == {"oak", "ELM", "3", "", None} and got(">2") == {"3"} and got("") == {"", None}


@pytest.mark.parametrize(
    ("value", "code", "want"),
    [
        (9876.5, "#,##0.00", "9,876.50"), (0.475, "0.0%", "47.5%"), (45366, "yyyy-mm-dd", "2024-03-15"), (-71, "#,##0;(#,##0)", "(71)"), (98765.432, "##0.0E+0", "98.8E+3"), (0.125, "0.00", "0.13"),
        (-5, "0.0", "-5.0"), (0, '0;-0;"none"', "none"), (150, '[>100]"big";0', "big"), (7, '[>100]"big";0', "7"), (1.5, "[h]:mm", "36:00"), (0.75, "h:mm AM/PM", "6:00 PM"), (3, "[$€-2] 0", "€ 3"), (2.5, "_(0.0_)", " 2.5 "),
        (60, "General", "60"), (1088.415, "0.00", "1088.41"), (45292, "d-mmm-yy", "1-Jan-24"),
    ],
)
def test_number_formats(spark, value, code, want):
    assert spark.range(1).select(nf.format_code(F.lit(float(value)), code)[0]).first()[0] == want


def test_colours(spark):
    code = "[>=500][Blue]0;[<10][Red]0;0"
    got = [spark.range(1).select(nf.format_code(F.lit(float(v)), code)[1]).first()[0] for v in (600, 3, 50)]
    assert got == ["#0000ff", "#ff0000", None]


def test_references(spark):
    assert [a1_to_r1c1(f, r, c) for f, r, c in (("=C4", 1, 1), ("=D$9", 4, 3), ("=MAX(B2:B7)", 9, 2))] == ["=R[2]C[1]", "=R9C[0]", "=MAX(R[-8]C[-1]:R[-3]C[-1])"]
    assert r1c1_to_a1("=R[2]C[1]+R9C[0]", 1, 1) == "=C4+B$9"
    assert parse_range("$D$5:B2") == (1, 1, 3, 4)
    some = [0, 25, 26, 701, 702, 16383]
    df = spark.createDataFrame([(i,) for i in some], "i int").withColumn("s", letters_column(F.col("i")))
    assert [(r.s, r.k) for r in df.withColumn("k", index_column(F.col("s"))).collect()] == [(column_letters(i), i) for i in some]
    assert all(column_index(column_letters(i)) == i for i in range(20_000))


def test_order_statistics(spark, monkeypatch):
    monkeypatch.setattr(cf, "_SORTED", 50)
    df = spark.range(5000).select(((F.col("id") * 7919) % 997).cast("double").alias("v"))
    values = sorted((i * 7919) % 997 for i in range(5000))
    for place in (1, 2, 777, 2500, 4999, 5000):
        assert cf.order_statistic(df, "v", place) == values[place - 1]
        assert cf.order_statistic(df, "v", place, descending=True) == values[-place]
    assert cf.order_statistic(df, "v", 5001) is None


def test_rules(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (5.0,)], "v double")
    assert [r.v for r in cf.average_rule(df, "v", deviations=1).where("match").collect()] == [5.0]
    scale = cf.colour_scale(spark.createDataFrame([(float(x),) for x in (0, 25, 50, 75, 100)], "v double"), "v", [(cf.Stop("min"), "#ff0000"), (cf.Stop("percentile", 50), "#ffff00"), (cf.Stop("max"), "#00ff00")])
    assert {r.v: r.colour for r in scale.collect()} == {0: "#ff0000", 25: "#ff8000", 50: "#ffff00", 75: "#80ff00", 100: "#00ff00"}
    top = cf.top(spark.createDataFrame([(1.0,), (4.0,), (4.0,), (2.0,)], "v double"), "v", 1)
    assert [r.v for r in top.where("match").collect()] == [4.0, 4.0]


def test_grid(spark):
    cells = spark.createDataFrame([("w", r, c) for r in range(4) for c in range(4)], "sheet string, row int, col int")
    merges = spark.createDataFrame([("w", 1, 1, 2, 2)], "sheet string, col int, row int, end_col int, end_row int")
    left = {(r.row, r.col) for r in grid.without_merged(cells, merges, by=["sheet"]).collect()}
    assert left == {(r, c) for r in range(4) for c in range(4)} - {(1, 2), (2, 1), (2, 2)}
    big = spark.createDataFrame([(0, 2_000_000, 0, 1)], "row int, end_row int, col int, end_col int")
    assert grid.expanded(big).count() == 1
    links = spark.createDataFrame([("java\tscript:x",), ("https://a",), ("#Sheet1!A1",), (None,)], "h string")
    assert [r[0] for r in links.select(grid.safe_link(F.col("h"))).collect()] == [False, True, True, True]


def test_charts(spark):
    got = spark.createDataFrame([(x,) for x in (0.0, 3.0, 17.0, 51.0, -30.0, 100.0)], "v double").select(charts.nice(F.col("v")).alias("n")).collect()
    assert [r.n for r in got] == [1, 5, 20, 100, -50, 100]


def workbook() -> bytes:
    out = io.BytesIO()
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    files = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Dash" sheetId="1" r:id="rId1"/><sheet name="Hid" sheetId="2" state="hidden" r:id="rId2"/></sheets><definedNames><definedName name="Area">Dash!$A$1</definedName></definedNames></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml" Type="t"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml" Type="t"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>Region</t></si><si><r><t>No</t></r><r><t>rth</t></r></si></sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><cols><col min="1" max="2" width="12.5"/></cols><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Sales</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" s="1"><v>100</v></c><c r="AA2" t="b"><v>1</v></c><c r="D2" t="e"><v>#DIV/0!</v></c><c r="E2"><f>SUM(B2:B2)</f></c></row></sheetData><mergeCells><mergeCell ref="A5:C6"/></mergeCells><dataValidations><dataValidation type="list" sqref="C1 D1:D3"><formula1>"x,y"</formula1></dataValidation></dataValidations></worksheet>',
        "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{main}"><sheetData><row><c><v>7</v></c></row></sheetData></worksheet>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="164" formatCode="0.000"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>',
    }
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    (tmp_path / "b.xlsx").write_bytes(b"\xd0\xcf\x11\xe0rest")
    (tmp_path / "c.xlsx").write_bytes(b"no zip")
    books = Workbooks(spark, str(tmp_path))
    assert sorted(r.error for r in books.errors().collect()) == ["encrypted", "not a package"]
    assert [(r.sheet, r.state) for r in books.sheets().orderBy("sheet_index").collect()] == [("Dash", "visible"), ("Hid", "hidden")]
    cells = {(r.sheet, r.row, r.col): (r.kind, r.value, r.formula, r.style_index) for r in books.cells().collect()}
    assert cells == {
        ("Dash", 0, 0): ("string", "Region", None, 0), ("Dash", 0, 1): ("inlineStr", "Sales", None, 0), ("Dash", 1, 0): ("string", "North", None, 0), ("Dash", 1, 1): ("number", "100", None, 1),
        ("Dash", 1, 26): ("boolean", "TRUE", None, 0), ("Dash", 1, 3): ("error", "#DIV/0!", None, 0), ("Dash", 1, 4): ("empty", "", "SUM(B2:B2)", 0), ("Hid", 0, 0): ("number", "7", None, 0),
    }
    assert [tuple(r)[3:7] for r in books.merges().collect()] == [(0, 4, 2, 5)]
    assert sorted(tuple(r)[3:] for r in books.validations().collect()) == [(2, 0, 2, 0, ["x", "y"]), (3, 0, 3, 2, ["x", "y"])]
    assert [(r.style_index, r.format_code) for r in books.formats().orderBy("style_index").collect()] == [(0, None), (1, "0.000")]
    assert [(r.name, r.refers_to) for r in books.defined_names().collect()] == [("Area", "Dash!$A$1")]
    assert [(r.first, r.last, r.width) for r in books.widths().collect()] == [(0, 1, 12.5)]
    wide = range_to_table(books.cells().where("sheet = 'Dash'"), ["region", "sales"], first_row=1, last_row=1, first_col=0).collect()
    assert [(r.region, r.sales) for r in wide] == [("North", "100")]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
