"""Mixes sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source has the same expected number of copies (target over
size).  Their prefix sums, taken in the order of size within the source and
shifted by one random offset, cross an integer as often as a document is taken.
Ordered by size, a source's taken words miss its target by about one document.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import WORD, as_row, cut, from_row, quoted

#: Expected copies are whole numbers of 2**-24: sums are exact, and fit a long up to 10**11 rows a source.
UNIT_BITS = 24
UNIT = 1 << UNIT_BITS

#: Rows that share a source and a size are numbered in groups of about this many.
GROUP_ROWS = 20_000


def source_key(source: Column) -> Column:
    """Orders sources by code point with null last, and has no null."""
    return F.coalesce(F.concat(F.lit("a"), source), F.lit("b"))


def targets(sources: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(src, source_size, target) for (src, source_size).

    All words are shared by weight; no target exceeds ``cap`` times its
    source's size, and the excess is shared by weight among the others.  With
    the sources in order of size over weight, the capped ones come first: the
    level is that of the first source that stays below its cap.  One task holds
    one small row a source, which is meant for up to millions of sources.
    """
    by_name = Window.orderBy("src")
    filled = Window.orderBy(F.col("source_size") / F.col("weight"), "src")
    before, after = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = (
        sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("left", F.sum("source_size").over(filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.coalesce(cap * F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(after))
        .withColumn("open", F.col("left") * F.col("weight") <= cap * F.col("source_size") * F.col("weight_left"))
    )
    # Below the level every later source is open too, so the first open one holds it.
    first = F.first(F.when(F.col("open"), F.struct("left", "weight_left")), ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, 0))
    target = F.when(first.isNull(), (cap * F.col("source_size")).cast("double")).otherwise((first["left"] * F.col("weight")).cast("double") / first["weight_left"])
    return ranked.withColumn("target", target).select("src", "source_size", "target")


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: (id, source, size, source_size, target, copies, taken).

    ``copies`` is how often the mix takes the row, at most ``cap`` times.
    Null texts have size 0; a null source is a source; rows equal in id, source
    and size are interchangeable; a null id is an id like any other, and long
    texts are counted whole; an empty table gives an empty result.  The
    outcome depends on the rows and the seed alone.
    """
    placed = _placed(docs, weights, cap, seed, id_col, text_col, source_col)
    return placed.select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _placed(docs: DataFrame, weights: tuple[int, ...], cap: int, seed: int, id_col: str, text_col: str, source_col: str, *, whole: bool = False) -> DataFrame:
    """The rows of ``mix``, with ``whole`` each with the row of ``docs`` it is for, as struct ``row``."""
    row = [as_row(docs).alias("row"), F.sha2(quoted(text_col), 256).alias("text_sha256")] if whole else []
    sized = cut(docs.select(*row, quoted(id_col).alias("id"), quoted(source_col).alias("source"), source_key(quoted(source_col)).alias("src"), F.regexp_count(F.coalesce(quoted(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size")))
    aims = targets(sized.groupBy("src").agg(F.sum("size").alias("source_size")), weights=weights, cap=cap)
    # Digits of the id's digest that split the rows of one source and size; more of them change no order.
    digits = max(1, math.ceil(math.log(max(1, sized.count()) / GROUP_ROWS, 16)))
    keyed = sized.withColumn("digest", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))).withColumn("part", F.substring("digest", 1, digits))
    cells = keyed.groupBy("src", "size", "part").agg(F.count("*").alias("rows"))
    before = (Window.unboundedPreceding, -1)
    per_size = cells.groupBy("src", "size").agg(F.sum("rows").alias("rows"))
    per_size = per_size.select("src", "size", F.coalesce(F.sum("rows").over(Window.partitionBy("src").orderBy("size").rowsBetween(*before)), F.lit(0)).alias("base"))
    cells = cells.withColumn("within", F.coalesce(F.sum("rows").over(Window.partitionBy("src", "size").orderBy("part").rowsBetween(*before)), F.lit(0)))
    cells = cells.join(per_size, ["src", "size"]).join(aims, "src").select("src", "size", "part", "source_size", "target", (F.col("base") + F.col("within")).alias("base"))
    placed = keyed.withColumn("place", F.row_number().over(Window.partitionBy("src", "size", "part").orderBy("digest", "id", *(["text_sha256"] if whole else [])))).join(cells, ["src", "size", "part"])

    expected = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(F.lit(0)).cast("long")
    offset = F.lit(random.Random(seed).randrange(UNIT)).cast("long")
    place = F.col("base") + F.col("place")
    crossed = F.shiftright(place * expected + offset, UNIT_BITS) - F.shiftright((place - 1) * expected + offset, UNIT_BITS)
    return placed.withColumn("copies", crossed.cast("long"))


def repeated(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, columns unchanged, each as often as the mix takes it, whether or not ids repeat."""
    dealt = _placed(docs, weights, cap, seed, id_col, text_col, source_col, whole=True).where("copies > 0")
    return from_row(dealt.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))), "row", docs.columns)
