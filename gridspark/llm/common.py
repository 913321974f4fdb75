"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Cells summed one by one inside a block of ``prefix_sums``.
_BLOCK = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="gridspark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset and Spark runs inside one process (tests), a temporary
    folder takes its place; on a cluster an unset folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder(spark.sparkContext.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    What follows no longer depends on executors that computed ``df``, is not
    computed again when read twice, and has a size that Spark knows.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_row(df: DataFrame) -> Column:
    """All columns in one struct, by place: names of theirs can't meet those beside it."""
    return F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(df.columns)])


def from_row(df: DataFrame, row: str, names: list[str]) -> DataFrame:
    """The columns that ``as_row`` has put into ``row``, under their names."""
    return df.select(*[F.col(f"{row}.c{i}").alias(c) for i, c in enumerate(names)])


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/gridspark/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


def drop(df: DataFrame) -> None:
    """Deletes the table that ``cut`` has written for ``df``: nothing that is still to be computed may read it."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes what this application has cut: results that are still to be computed can't be after that."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def filter_bits(rows: int, most: int, per_row: int = 12) -> int | None:
    """Bits of a filter of that many rows: a power of two, ``per_row`` a row at least; None where that exceeds ``most``."""
    bits = 1 << max(16, (per_row * max(rows, 1) - 1).bit_length())
    return bits if bits <= most else None


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("int"), lambda a, b: a + b)


def prefix_sums(values: Column) -> Column:
    """Sums of the elements before each element of an ``array<int>``.

    Sums run inside blocks and over block totals, so that an array of a million
    cells costs some hundred additions a cell, not a million.
    """

    def by_block(v: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")),
            lambda b: _total(F.slice(v, b * _BLOCK + 1, _BLOCK)),
        )
        starts = let(blocks, lambda t: F.transform(t, lambda _, i: _total(F.slice(t, F.lit(1), i))))
        return let(
            starts,
            lambda s: F.transform(
                v,
                lambda _, i: s[F.floor(i / _BLOCK).cast("int")]
                + _total(F.slice(v, (F.floor(i / _BLOCK) * _BLOCK + 1).cast("int"), (i % _BLOCK).cast("int"))),
            ),
        )

    return let(values, lambda v: F.when(F.size(v) > 0, by_block(v)).otherwise(F.array().cast("array<int>")))


def split_of(id_col: Column, parts: int) -> Column:
    """The part, by CRC-32 of the id written as text, that a row belongs to (null ids: 0)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts, F.lit(0))


def smallest_digests(rows: DataFrame, group_col: str, id_col: str, most: int) -> DataFrame:
    """The ``most`` rows of each group with the smallest id digests, numbered in column place.

    Groups are few (classes, languages).  Their counts give a digest that about
    twice as many rows stay under, so that a group meets in one task only after
    its rows are down to that; the choice is the same as without.  An id counts
    once in a group, however many of its rows there are.
    """
    rows = rows.select(group_col, id_col).distinct()
    digest = F.pmod(F.xxhash64(id_col), F.lit(1 << 40))
    sizes = {r[0]: r[1] for r in rows.groupBy(group_col).count().collect()}
    limit = F.coalesce(*[F.when(F.col(group_col) == g, F.lit(int(min(1.0, (2 * most + 100) / n) * (1 << 40)))) for g, n in sizes.items()], F.lit(0).cast("long"))
    order = Window.partitionBy(group_col).orderBy("__digest", id_col)
    few = rows.withColumn("__digest", digest).where(F.col("__digest") < limit)
    return few.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("__digest")
