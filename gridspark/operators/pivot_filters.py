"""Slicer and timeline filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slicer(df: DataFrame, column: str, items: list[str]) -> DataFrame:
    """Rows whose trimmed text is among the items, case counting; blanks always stay.

    Items are a literal list, so the filter can reach the scan.
    """
    t = F.trim(F.col(column).cast("string"))
    return df.where(F.col(column).isNull() | (t == "") | t.isin(*items))


def timeline(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Rows whose moment lies between the bounds, inclusive, swapped ones put in order; what is no date stays.

    A bound that is missing or is no date leaves all rows.
    """
    bounds = df.sparkSession.range(1).select(F.try_to_timestamp(F.lit(start)).cast("string"), F.try_to_timestamp(F.lit(end)).cast("string")).first()
    if bounds[0] is None or bounds[1] is None:
        return df
    low, high = sorted(bounds)
    kind = dict(df.dtypes)[column]
    moment = F.col(column) if kind in ("timestamp", "date", "timestamp_ntz") else F.try_to_timestamp(column)
    return df.where(moment.isNull() | ((moment >= F.lit(low).cast("timestamp")) & (moment <= F.lit(high).cast("timestamp"))))


def find_column(df: DataFrame, header: str) -> str | None:
    """The first column of that name, trimmed and without case."""
    return next((c for c in df.columns if c.strip().lower() == header.strip().lower()), None)


def find_header_cell(cells: DataFrame, header: str) -> DataFrame:
    """The first cell (row, then column) whose text is the header, per workbook and sheet."""
    same = F.lower(F.trim("value")) == header.strip().lower()
    return cells.where(same).groupBy("workbook", "sheet").agg(F.min(F.struct("row", "col")).alias("at")).select("workbook", "sheet", "at.*")
