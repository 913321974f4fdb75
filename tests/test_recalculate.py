"""Formulas in cells: one pass over a sheet, by joins."""

import random

import pytest

from gridspark.operators import recalculate as rc
from gridspark.operators.recalculate import recalculate

SCHEMA = "sheet string, row long, col long, kind string, value string, formula string, extra string"


def place(ref):
    col = 0
    letters = ref.rstrip("0123456789")
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(ref[len(letters) :]) - 1, col - 1


def sheet(spark, cells, name="s"):
    rows = []
    for ref, x in cells.items():
        r, c = place(ref)
        if isinstance(x, str) and x.startswith("="):
            rows.append((name, r, c, "empty", "", x, "e"))
        elif isinstance(x, bool):
            rows.append((name, r, c, "boolean", "1" if x else "0", None, "e"))
        elif isinstance(x, (int, float)):
            rows.append((name, r, c, "number", str(x), None, "e"))
        elif isinstance(x, tuple):
            rows.append((name, r, c, *x, "e"))
        else:
            rows.append((name, r, c, "error" if x.startswith("#") else "string", x, None, "e"))
    return spark.createDataFrame(rows, SCHEMA)


GRID = {
    "A1": 12, "A2": 30.5, "A3": -4, "A5": 7, "A6": 1e3,
    "B1": "pear", "B2": "Plum", "B3": "pear", "B4": "", "B5": "18", "B6": "fig",
    "C1": True, "C2": False, "C3": "#N/A", "C5": "TRUE",
    "D1": "red", "D2": "blue", "D3": "green", "D4": 5,
}

WANTED = {
    "=A1*2+A2": ("54.5", "number"), "=$A$1&\"-\"&B2": ("12-Plum", "string"), "=A1/A4": ("#DIV/0!", "error"), "=C3+1": ("#N/A", "error"), "=IFERROR(C3,\"A1\")": ("A1", "string"),
    "=SUM(A1:A6)": ("1045.5", "number"), "=SUM(A6:A1,5,B5)": ("1068.5", "number"), "=AVERAGE(A1:A3)": ("12.8333333333333", "number"), "=AVERAGE(B1:B3)": ("#DIV/0!", "error"),
    "=COUNT(A1:B6)": ("5", "number"), "=COUNTA(B1:B6)": ("5", "number"), "=COUNT(A1:C3)": ("0", "number"), "=COUNTA(C1:C3)": ("1", "number"), "=SUM(A1:C3)": ("#N/A", "error"),
    "=MIN(A1:A6)": ("-4", "number"), "=MAX(A1:A6,2000)": ("2000", "number"), "=MAX(F1:F9)": ("0", "number"), "=AND(C1:C2)": ("FALSE", "boolean"), "=OR(C1:C2)": ("TRUE", "boolean"), "=OR(F1:F2)": ("#VALUE!", "error"),
    "=CONCATENATE(D1:D4,\"!\")": ("redbluegreen5!", "string"), "=COUNTIF(A1:A7,\"<>30.5\")": ("6", "number"), "=COUNTIF(A1:A6,\">=\"&A1)": ("3", "number"), "=COUNTIF(B1:B6,\"PEAR\")": ("2", "number"),
    "=COUNTIF(B1:B7,\"\")": ("2", "number"), "=COUNTIF(A1:A6,A5)": ("1", "number"), "=SUMIF(B1:B6,\"pear\",A1:A6)": ("8", "number"), "=SUMIF(A1:A6,\">10\")": ("1042.5", "number"), "=SUMIF(B1:B3,\"pear\",A2:A3)": ("30.5", "number"),
    "=SUMIF(F1:F6,\"\",A1:A6)": ("1045.5", "number"), "=SUMIF(A1:A3,\"<>12\",D2:D4)": ("5", "number"), "=SUMIF(A1:A3,\">0\",C1:C3)": ("1", "number"), "=SUMIF(C1:C3,\"x\",A1:A3)": ("#N/A", "error"),
    "=VLOOKUP(\"PLUM\",B1:D3,3)": ("blue", "string"), "=VLOOKUP(18,B1:D6,1)": ("18", "string"), "=VLOOKUP(\"kiwi\",B1:D3,3)": ("#N/A", "error"), "=VLOOKUP(\"pear\",B1:D3,4)": ("#REF!", "error"),
    "=VLOOKUP(\"pear\",B1:D3,0)": ("#VALUE!", "error"), "=VLOOKUP(\"pear\",B1:D3,2,FALSE)": ("#VALUE!", "error"), "=LEN(VLOOKUP(B2,B1:D3,3))+COUNTIF(A1:A3,\"<0\")": ("5", "number"),
    "=IF(A3<0,\"minus\",A3)": ("minus", "string"), "=IF(A1<0,\"minus\",A1)": ("12", "number"), "=IF(C3,1,2)": ("#N/A", "error"), "=IFS(A1>20,\"x\",A1>10,A2)": ("30.5", "number"), "=IFS(A1>20,1)": ("#N/A", "error"), "=SWITCH(B1,\"x\",1,\"PEAR\",C1,9)": ("TRUE", "boolean"),
    "=SWITCH(A1,1,\"a\",\"none\")": ("none", "string"), "=IFNA(C3,0)+1": ("1", "number"), "=IFNA(A1/0,0)": ("#DIV/0!", "error"), "=SUM(IF(A1>1,A2,\"\"),1)": ("31.5", "number"), "=NOSUCH(A1)": ("#NAME?", "error"), "=A1+": ("#VALUE!", "error"), "=A4": ("", "string"), "=B1": ("pear", "string"), "=D1:D3": ("red", "string"), "=C1": ("TRUE", "boolean"),
    "=0.1+0.2": ("0.3", "number"), "=2^0.5^2": ("1.18920711500272", "number"), "=\"B2:C3 is text\"": ("B2:C3 is text", "string"), "=#NUM!": ("#NUM!", "error"), "=POWER(10,400)": ("#NUM!", "error"),
}


def test_every_kind_of_formula(spark):
    cells = GRID | {f"H{i}": f for i, f in enumerate(WANTED, 1)}
    got = {r.row: (r.value, r.kind) for r in recalculate(sheet(spark, cells)).where("col = 7").collect()}
    assert {f: got[i] for i, f in enumerate(WANTED)} == WANTED


def test_single_pass_and_force(spark):
    cells = {"A1": 2, "B1": "=A1+1", "C1": "=B1+1", "D1": ("number", "99", "=A1+5"), "E1": "=D1+1", "F1": ("string", "kept", None)}
    once = {r.col: (r.value, r.kind) for r in recalculate(sheet(spark, cells)).collect()}
    assert once == {0: ("2", "number"), 1: ("3", "number"), 2: ("1", "number"), 3: ("99", "number"), 4: ("100", "number"), 5: ("kept", "string")}
    forced = {r.col: r.value for r in recalculate(sheet(spark, cells), force=True).collect()}
    assert forced[3] == "7" and forced[4] == "100"


def test_sheets_are_apart_and_columns_stay(spark):
    both = sheet(spark, {"A1": 1, "B1": "=SUM(A1:A9)"}, "x").unionByName(sheet(spark, {"A1": 5, "B1": "=SUM(A1:A9)"}, "y"))
    out = recalculate(both)
    assert out.columns == both.columns
    assert {(r.sheet, r.value, r.extra) for r in out.where("col = 1").collect()} == {("x", "1", "e"), ("y", "5", "e")}


@pytest.mark.parametrize("cells", [{}, {"A1": 1}])
def test_without_formulas(spark, cells):
    assert recalculate(sheet(spark, cells)).count() == len(cells)


def test_sums_are_exact_beside_large_numbers(spark):
    cells = {"A1": 123456789.37, "A2": 98765432.11, "A3": 1e13, "B1": 0.1, "B2": 0.2, "B3": 1 / 3, "B4": 1e-12, "C1": 2.5, "C2": -2.5, "C3": 7}
    wanted = {"=SUM(B1:B2)": "0.3", "=SUM(C1:C3)": "7", "=SUM(A1:B2)": "222222221.78", "=SUM(B1:B4)": "0.633333333334333", "=AVERAGE(C2:C3)": "2.25", "=SUM(A3:C3)": "10000000000007.3", "=SUM(B4:B4)": "1e-12"}
    got = {r.row: r.value for r in recalculate(sheet(spark, cells | {f"F{i}": f for i, f in enumerate(wanted, 1)})).where("col = 5").collect()}
    assert {f: got[i] for i, f in enumerate(wanted)} == wanted


CRITERIA = ['">3"', '"<>3"', "3", '"x"', '"<>x"', '""', "TRUE", "A#", "F#", '"<=x"', "1/0"]
ASKS = ["=COUNTIF(A$1:A#,?)", "=COUNTIF(B@:C#,?)", "=SUMIF(A$1:A#,?)", "=SUMIF(A$2:A#,?,C@:C30)", "=SUMIF(D@:D#,?,A1:A9)", "=SUMIF(B@:C#,?,A@:A#)"]


def test_criteria_that_are_met_once_a_set(spark, monkeypatch):
    """What a criterion finds down a sheet is what comparing each range's cells finds."""
    rng = random.Random(3)
    values = [1, 3, 3.0, 4.25, 7, "3", "x", "X", "y", "", True, False, 0, -2.5]
    cells = {f"{c}{r}": rng.choice(values) for c in "ABCD" for r in range(1, 25) if rng.random() < 0.8}
    cells |= {"D17": "#N/A", "A21": "#REF!", "C19": 0.123456789}
    n = 0
    for ask in ASKS:
        for criterion in CRITERIA:
            for row in rng.sample(range(3, 30), 3):
                n += 1
                cells[f"H{n}"] = ask.replace("?", criterion).replace("@", str(rng.randint(1, row))).replace("#", str(row))
    read = lambda: {r.row: (r.value, r.kind) for r in recalculate(sheet(spark, cells)).where("col = 7").collect()}
    wanted = read()
    monkeypatch.setattr(rc, "NEAR", 0)
    monkeypatch.setattr(rc, "STRIPE", 2)
    monkeypatch.setattr(rc, "BLOCK", 8)
    got = read()
    assert len(wanted) == n and {cells[f"H{i + 1}"]: (got[i], wanted[i]) for i in range(n) if got[i] != wanted[i]} == {}


def test_criteria_grow_with_a_sheet_not_its_square(spark, monkeypatch):
    """Ranges that grow down a sheet meet none of its cells one by one, with few criteria or as many as rows."""
    made = []
    striped = rc._striped
    monkeypatch.setattr(rc, "_striped", lambda *x: made.append(striped(*x)) or made[-1])
    rows = 600
    cells = {f"A{r}": f"k{r % 3}" for r in range(1, rows + 1)} | {f"B{r}": r // 2 for r in range(1, rows + 1)} | {f"C{r}": 0.1 for r in range(1, rows + 1)}
    cells |= {f"D{r}": f"=COUNTIF(A$1:A{r},A{r})" for r in range(1, rows + 1)} | {f"E{r}": f"=SUMIF(B$1:B{r},B{r},C$1:C{r})" for r in range(1, rows + 1)}
    got = {(r.row + 1, r.col): r.value for r in recalculate(sheet(spark, cells)).where("col > 2").collect()}
    assert got == {(r, 3): str((r - r % 3) // 3 + (r % 3 > 0)) for r in range(1, rows + 1)} | {(r, 4): "0.2" if r % 2 and r > 1 else "0.1" for r in range(1, rows + 1)}
    assert made and not any(x.count() for x in made)
