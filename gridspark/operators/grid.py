"""The grid: offsets in pixels, merged and linked ranges, pages, HTML rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells that one range may expand to; beyond, only its first cell is returned.
MOST_CELLS = 1_048_576


def pixels(characters: Column) -> Column:
    """Width in pixels of a column of that many characters."""
    return F.floor((F.coalesce(characters, F.lit(8.43)) * 7 + 5)).cast("long")


def offsets(columns: DataFrame, size: str, *, by: list[str], order: str, hidden: str | None = None, into: str = "offset") -> DataFrame:
    """The sum of the sizes before each column or row of a sheet; hidden ones are 0 wide."""
    width = F.when(F.col(hidden), F.lit(0)).otherwise(F.col(size)) if hidden else F.col(size)
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return columns.withColumn(into, F.coalesce(F.sum(width).over(before), F.lit(0)))


def _stripes(ranges: DataFrame, height: int) -> DataFrame:
    """Ranges with every stripe of ``height`` rows that they touch: the key of a range join."""
    return ranges.withColumn("__stripe", F.explode(F.sequence(F.floor(F.col("row") / height), F.floor(F.col("end_row") / height))))


def in_ranges(cells: DataFrame, ranges: DataFrame, *, by: list[str], height: int = 1024, how: str = "inner") -> DataFrame:
    """Cells joined with the ranges (col, row, end_col, end_row) that hold them.

    Rows fall into stripes, so that Spark joins on sheet and stripe, and only
    then compares; ``how`` may also be left_semi or left_anti.
    """
    keyed = cells.withColumn("__stripe", F.floor(F.col("row") / height)).alias("c")
    spread = _stripes(ranges, height).alias("r")
    on = [F.col(f"c.{b}") == F.col(f"r.{b}") for b in by] + [F.col("c.__stripe") == F.col("r.__stripe"), F.col("c.row").between(F.col("r.row"), F.col("r.end_row")), F.col("c.col").between(F.col("r.col"), F.col("r.end_col"))]
    joined = keyed.join(spread, on, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("__stripe")
    return joined.select("c.*", *[F.col(f"r.{x}").alias(f"range_{x}") for x in ranges.columns if x not in by]).drop("__stripe")


def without_merged(cells: DataFrame, merges: DataFrame, *, by: list[str]) -> DataFrame:
    """Cells but those that a merge covers; its first cell stays."""
    m = merges.select(*by, F.col("col").alias("__c"), F.col("row").alias("__r")).distinct()
    on = [F.col("a." + b) == F.col("m." + b) for b in by] + [F.col("a.col") == F.col("m.__c"), F.col("a.row") == F.col("m.__r")]
    covered = in_ranges(cells, merges, by=by, how="left_semi").alias("a").join(m.alias("m"), on, "left_anti")
    keys = [*by, "row", "col"]
    return cells.join(covered.select(*keys), keys, "left_anti")


def expanded(ranges: DataFrame) -> DataFrame:
    """One row per cell of each range; only the first of a range beyond MOST_CELLS."""
    size = (F.col("end_row") - F.col("row") + 1) * (F.col("end_col") - F.col("col") + 1)
    last = lambda end, start: F.when(size > MOST_CELLS, F.col(start)).otherwise(F.col(end))
    rows = ranges.withColumn("cell_row", F.explode(F.sequence("row", last("end_row", "row"))))
    return rows.withColumn("cell_col", F.explode(F.sequence("col", last("end_col", "col"))))


def header_zones(code: Column) -> Column:
    """struct(left, center, right) of a header or footer code: what follows &L, &C and &R; centre by default."""
    paired = F.replace(code, F.lit("&&"), F.lit("\u0002"))  # a written &, which marks nothing
    marked = F.regexp_replace(paired, "&([LCR])", "\u0001$1")
    parts = F.split(F.when(paired.rlike("^&[LCR]"), marked).otherwise(F.concat(F.lit("\u0001C"), marked)), "\u0001")
    joined = lambda z: F.array_join(F.transform(F.filter(parts, lambda p: p.startswith(z)), lambda p: F.substring(p, F.lit(2), F.length(p))), "")
    zone = lambda z: F.replace(joined(z), F.lit("\u0002"), F.lit("&&"))
    return F.struct(zone("L").alias("left"), zone("C").alias("center"), zone("R").alias("right"))


def header_text(zone: Column, *, date: str, time: str, sheet: Column, page: Column, pages: Column, file: Column) -> Column:
    """A zone with its codes filled in."""
    hidden = F.replace(zone, F.lit("&&"), F.lit("\u0001"))
    for code, value in (("&D", F.lit(date)), ("&T", F.lit(time)), ("&A", sheet), ("&P", page), ("&N", pages), ("&F", file)):
        hidden = F.replace(hidden, F.lit(code), value.cast("string"))
    return F.replace(hidden, F.lit("\u0001"), F.lit("&"))


def escaped(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_rows(cells: DataFrame, *, by: list[str], value: str = "value", style: str | None = None) -> DataFrame:
    """(by, row, html): each row's cells as one table row, in column order.

    The unit is a row, so that a sheet of any length is written by many tasks.
    """
    attr = F.when(F.col(style).isNotNull() & (F.col(style) != ""), F.concat(F.lit(' style="'), escaped(F.col(style)), F.lit('"'))).otherwise(F.lit("")) if style else F.lit("")
    td = F.concat(F.lit("<td"), attr, F.lit(">"), escaped(F.col(value)), F.lit("</td>"))
    tds = F.array_sort(F.collect_list(F.struct(F.col("col"), td.alias("td"))))
    return cells.groupBy(*by, "row").agg(F.concat(F.lit("<tr>"), F.array_join(F.transform(tds, lambda t: t["td"]), ""), F.lit("</tr>")).alias("html"))


def safe_link(href: Column) -> Column:
    """Whether a link may be shown: http, https, mailto, tel, a place in the document or a relative path, and no control character anywhere.

    Nulls and blanks lead nowhere and may be shown.
    """
    bare = F.trim(href)
    foreign = bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & ~bare.rlike("(?i)^(https?|mailto|tel):")
    return F.coalesce(~href.rlike(r"[\x00-\x1f\x7f]") & ~foreign, F.lit(True))
