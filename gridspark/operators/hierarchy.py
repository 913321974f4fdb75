"""Trees and threads: levels by a recursive query, replies under their starters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Digits of an order in a path: as many as a bigint has, so that paths sort as their orders do.
_DIGITS = 19


def levels(nodes: DataFrame, edges: DataFrame, *, root: str = "doc", depth: int = 32) -> DataFrame:
    """(id, level, path) from ``nodes`` (id, kind) and ``edges`` (src, dst, ord).

    Roots are the children of the nodes whose kind is ``root``, or, where there
    are none, the nodes that no edge leads to, with order 0.  Children come in
    the order of ``ord``, a whole number from 0.  A node met again on its own
    path is left out, and levels end at ``depth``.  One recursive query; each
    step is a join.  Spark ends it with an error beyond
    ``spark.sql.cteRecursionRowLimit`` rows (a million unless set).
    """
    top = edges.join(nodes.where(F.col("kind") == root).select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id"), F.col("ord").cast("long").alias("ord"))
    loose = nodes.where(F.col("kind") != root).join(edges.select(F.col("dst").alias("id")), "id", "left_anti").select("id", F.lit(0).cast("long").alias("ord"))
    counted = top.agg(F.count("*").alias("tops"))
    starts = top.unionByName(loose.join(F.broadcast(counted), F.col("tops") == 0).drop("tops"))
    step = lambda c: f"lpad(CAST({c} AS STRING), {_DIGITS}, '0')"
    return nodes.sparkSession.sql(
        f"""
        WITH RECURSIVE tree(id, level, path, seen) AS (
          SELECT id, 0, {step("ord")}, concat('/', id, '/') FROM {{starts}}
          UNION ALL
          SELECT e.dst, t.level + 1, concat(t.path, '.', {step("e.ord")}), concat(t.seen, e.dst, '/')
          FROM tree t JOIN {{edges}} e ON e.src = t.id
          WHERE t.level < {depth - 1} AND instr(t.seen, concat('/', e.dst, '/')) = 0)
        SELECT id, level, path FROM tree""",
        starts=starts,
        edges=edges,
    )


def threads(comments: DataFrame, by: list[str]) -> DataFrame:
    """One row per thread: starters with their replies by date; replies to replies are left out.

    ``comments`` has id, parent_id, date and text.  A comment whose parent is
    unknown is a starter.
    """
    c = comments
    known = c.select(*by, F.col("id").alias("parent_id")).distinct()
    starters = c.join(known, [*by, "parent_id"], "left_anti")
    replies = c.select(*by, "parent_id", F.struct("date", "id", "text").alias("reply"))
    gathered = replies.where("parent_id is not null").groupBy(*by, "parent_id").agg(F.array_sort(F.collect_list("reply")).alias("replies"))
    own = starters.select(*by, F.col("id"), "date", "text")
    return own.join(gathered.withColumnRenamed("parent_id", "id"), [*by, "id"], "left").withColumn("replies", F.coalesce("replies", F.array().cast("array<struct<date:string,id:string,text:string>>")))


def in_turn(rows: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """Each group's texts in order, one a line."""
    sorted_rows = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(by).agg(F.array_join(F.transform(sorted_rows, lambda r: r[text]), "\n").alias("thread"))
