"""Sums over many rectangles of cells at once, by a summed-area table.

A sheet is cut into stripes of rows.  The sum of all cells above and left of a
place is that of the place's stripe up to it, and of the stripes before up to
its column; a rectangle is four such sums.  Ranges and cells never meet, so
that many large ranges over the same cells cost no more than small ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a stripe, and stripes that one task sums up before their totals are.
STRIPE = 64
SPAN = 4096
#: Places of stripes that a task adds up at once, unless one stripe has more.
TABLE = 1 << 20


def _local(layers: list[str]):
    # Inside, so that tasks need no module but this function's.
    def begins(rows: pd.DataFrame) -> np.ndarray:
        """Whether a row's stripe is another than that of the row before."""
        sheets, stripes = pd.factorize(rows["sheet"])[0], rows["stripe"].to_numpy(np.int64)
        return np.concatenate([[False], (sheets[1:] != sheets[:-1]) | (stripes[1:] != stripes[:-1])])

    def places(some: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """The sums of whole stripes up to each place asked for."""
        own = np.cumsum(begins(some))
        columns, at = np.unique(some["c"].to_numpy(np.int64), return_inverse=True)
        shape = (int(own[-1]) + 1, STRIPE, len(columns))
        if shape[0] > 1 and np.prod(shape) > TABLE:
            half = int(np.searchsorted(own, shape[0] // 2))
            yield from places(some.iloc[:half])
            yield from places(some.iloc[half:])
            return
        asked, rows = some["asked"].to_numpy(bool), some["r"].to_numpy(np.int64) % STRIPE
        out, cells = some.loc[asked, ["sheet", "stripe", "r", "c"]].copy(), ~asked
        flat = ((own * STRIPE + rows) * shape[2] + at)[cells]
        for name in layers:
            table = np.bincount(flat, weights=np.nan_to_num(some[name].to_numpy(np.float64)[cells]), minlength=int(np.prod(shape))).reshape(shape)
            out[name] = table.cumsum(axis=1).cumsum(axis=2)[own[asked], rows[asked], at[asked]]
        yield out

    def stripes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come in order of their stripes; of those that a batch ends, one is held."""
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            starts = np.flatnonzero(begins(batch))
            more = bool(held) and not begins(pd.concat([held[-1].iloc[-1:], batch.iloc[:1]], ignore_index=True))[1]
            if held and not (more and not len(starts)):
                cut = starts[-1] if len(starts) else 0
                yield from places(pd.concat([*held, batch.iloc[:cut]], ignore_index=True))
                held, batch = [], batch.iloc[cut:]
            held.append(batch)
        if held:
            yield from places(pd.concat(held, ignore_index=True))

    return stripes


def rectangle_sums(cells: DataFrame, ranges: DataFrame, layers: list[str]) -> DataFrame:
    """``ranges`` (sheet, row, col, end_row, end_col, ...) with the sum of each layer over the ``cells`` (sheet, row, col, layers) inside.

    Rows and columns count from 0, ends are included; no cells give 0.  Sums
    are differences of sums over the sheet: their rounding is that of the
    sheet's totals.
    """
    box = ["sheet", "row", "col", "end_row", "end_col"]
    rects = ranges.select(*[F.col(c).cast("string" if c == "sheet" else "long").alias(c) for c in box]).distinct()
    corner = lambda r, c, sign: F.struct(r.alias("r"), c.alias("c"), F.lit(sign).alias("sign"))
    first, last = [F.col(c) - 1 for c in ("row", "col")], [F.col(c) for c in ("end_row", "end_col")]
    four = F.array(corner(last[0], last[1], 1.0), corner(first[0], last[1], -1.0), corner(last[0], first[1], -1.0), corner(first[0], first[1], 1.0))
    corners = rects.select(*box, F.explode(four).alias("at")).select(*box, "at.*").where("r >= 0 AND c >= 0")
    stripe = lambda r: F.floor(F.col(r) / STRIPE).alias("stripe")
    points = corners.select("sheet", stripe("r"), "r", "c").distinct()
    some = cells.select(F.col("sheet").cast("string").alias("sheet"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *[F.col(c).cast("double").alias(c) for c in layers]).withColumn("stripe", F.floor(F.col("row") / STRIPE))
    schema = "sheet string, stripe long, r long, c long, " + ", ".join(f"{c} double" for c in layers)
    # Sums up to places within their stripe: only stripes that have places.
    near = some.join(points.select("sheet", "stripe").distinct(), ["sheet", "stripe"], "left_semi")
    met = near.select("sheet", "stripe", F.col("row").alias("r"), F.col("col").alias("c"), F.lit(False).alias("asked"), *layers)
    met = met.unionByName(points.withColumns({"asked": F.lit(True), **{c: F.lit(0.0) for c in layers}}))
    local = met.repartition("sheet", "stripe").sortWithinPartitions("sheet", "stripe").mapInPandas(_local(layers), schema)
    # Each stripe's own sums, at the columns that corners have.
    columns = some.groupBy("sheet", "stripe", F.col("col").alias("c")).agg(*[F.sum(c).alias(c) for c in layers])
    ends = columns.select("sheet", "stripe").distinct().join(points.select("sheet", "c").distinct(), "sheet")
    wide = columns.withColumn("asked", F.lit(False)).unionByName(ends.withColumns({"asked": F.lit(True), **{c: F.lit(0.0) for c in layers}}))
    upto = Window.partitionBy("sheet", "stripe").orderBy("c").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = wide.select("sheet", "c", "stripe", "asked", *[F.sum(c).over(upto).alias(c) for c in layers]).where("asked").drop("asked")
    rest = points.select("sheet", "c", "stripe", *[F.lit(0.0).alias(c) for c in layers])
    stripes = own.unionByName(rest).groupBy("sheet", "c", "stripe").agg(*[F.sum(c).alias(c) for c in layers]).withColumn("span", F.floor(F.col("stripe") / SPAN))
    before = (Window.unboundedPreceding, -1)
    inner = Window.partitionBy("sheet", "c", "span").orderBy("stripe").rowsBetween(*before)
    outer = Window.partitionBy("sheet", "c").orderBy("span").rowsBetween(*before)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    spans = stripes.groupBy("sheet", "c", "span").agg(*[F.sum(c).alias(c) for c in layers]).select("sheet", "c", "span", *[zero(F.sum(c).over(outer)).alias(f"{c}_ahead") for c in layers])
    above = stripes.select("sheet", "c", "span", "stripe", *[zero(F.sum(c).over(inner)).alias(f"{c}_above") for c in layers]).join(spans, ["sheet", "c", "span"])
    placed = corners.withColumn("stripe", F.floor(F.col("r") / STRIPE)).join(local, ["sheet", "stripe", "r", "c"], "left").join(above, ["sheet", "stripe", "c"], "left")
    sums = [F.sum(F.col("sign") * (zero(F.col(c)) + zero(F.col(f"{c}_above")) + zero(F.col(f"{c}_ahead")))).alias(c) for c in layers]
    # A rectangle has four corners at most: the sum of its group is short.
    found = placed.groupBy(*box).agg(*sums)
    named = found.select(*[F.col(c).alias(f"__{c}") for c in box], *layers)
    keys = [F.col(c).cast("string" if c == "sheet" else "long") == F.col(f"__{c}") for c in box]
    return ranges.join(named, keys, "left").select(*[F.col(c) for c in ranges.columns], *[zero(F.col(c)).alias(c) for c in layers])
