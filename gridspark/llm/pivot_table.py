"""Hard negatives by a pivot table.

One more component, sqrt(M - |x|^2) for rows and 0 for anchors, turns the
inner product into a Euclidean distance: d^2 = |q|^2 + M - 2 q.x, where M is
the largest squared norm.  Each row's distances to some pivots are stored; by
the triangle inequality they bracket its distance to an anchor, and so its
score.  Only rows whose bracket can matter are multiplied out, in integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.bit_sliced import quantised
from gridspark.llm.common import cut

#: Pivots, rows of a block of the table, anchors of a block, and tasks that an anchor block's search is spread over at most.
PIVOTS = 12
BLOCK_ROWS = 16_384
BLOCK_ANCHORS = 4_096
SLOTS = 256


class Table:
    """Some rows in the order of label, with their distances to the pivots."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, distances: np.ndarray, pivots: np.ndarray, largest: float) -> None:
        self.ids, self.labels, self.values, self.distances = ids, labels, values, distances
        self.pivots, self.largest = pivots, largest

    def brackets(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) score of each row with the anchor, by its distances to the pivots alone."""
        q = anchor.astype(np.float64)
        span = float(q @ q) + self.largest
        if not len(self.pivots):
            return np.full(len(self.ids), -math.inf), np.full(len(self.ids), math.inf)
        own = np.sqrt(((self.pivots[:, :-1] - q) ** 2).sum(axis=1) + self.pivots[:, -1] ** 2)
        near, far = np.abs(self.distances - own).max(axis=1), (self.distances + own).min(axis=1)
        slack = 1e-9 * span + 1e-3  # more than rounding takes
        return (span - far**2) / 2 - slack, (span - near**2) / 2 + slack

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return self.values[rows].astype(np.int64) @ anchor

    def positives(self, anchor_id: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows of the label, the anchor's own left out."""
        rows = np.arange(*np.searchsorted(self.labels, [label, label + 1]))
        rows = rows[self.ids[rows] != anchor_id]
        if len(rows) > k:
            least, greatest = self.brackets(anchor)
            rows = rows[greatest[rows] >= np.partition(least[rows], -k)[-k]]
        scores = self.scores(rows, anchor)
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]

    def negatives(self, anchor_id: int, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores (ends included) the (ids, scores) of the k best rows of other labels."""
        least, greatest = self.brackets(anchor)
        other = (self.labels != label) & (self.ids != anchor_id)
        wanted = np.zeros(len(self.ids), bool)
        for low, high in windows:
            sure = least[other & (least >= low) & (greatest <= high)]
            floor = np.partition(sure, -k)[-k] if len(sure) > k else low
            wanted |= (greatest >= max(low, floor)) & (least <= high)
        rows = np.flatnonzero(wanted & other)
        scores = self.scores(rows, anchor)
        order = np.lexsort((self.ids[rows], -scores))
        rows, scores = rows[order], scores[order]
        for low, high in windows:
            inside = np.flatnonzero((scores >= low) & (scores <= high))[:k]
            yield self.ids[rows[inside]], scores[inside]


def _pivots(ready: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Some rows for each length of vectors: those with the smallest digests among all, ``count`` for a length at most."""
    found: dict[int, list[list[int]]] = {}
    for row in ready.select("v").orderBy(F.xxhash64("v"), "v").limit(16 * count).collect():
        some = found.setdefault(len(row.v), [])
        if len(some) < count and row.v not in some:
            some.append(row.v)
    return {dims: np.array(rows, np.float64) for dims, rows in found.items()}


def hard_negatives(
    vectors: DataFrame, *, positives: int = 5, negatives: int = 10, every: int = 100, window: tuple[int, int] = (30, 90), scale: int = 256,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_rank, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``; an anchor's
    positives its best other rows of its label.  For each, the best rows of
    other labels whose score is within ``window`` per cent of the positive's
    follow, the highest first, ties to the smaller id.  Rows with a null id,
    label or vector, an empty one, or a component that is null, not finite or
    beyond 64 bits when scaled take no part; only vectors of equal length are
    compared; rows with the anchor's id are no candidates of it.  A row that
    repeats another is a candidate as often as it is there, and an anchor once.
    No rows, no result; further columns are ignored.  Scores are exact below
    2**63.
    """
    spark = vectors.sparkSession
    column = lambda name: F.col(f"`{name}`")
    ready = cut(vectors.select(column(id_col).cast("long").alias("id"), column(label_col).cast("long").alias("label"), quantised(column(vector_col), scale).alias("v")).where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL"))
    anchors = cut(ready.where(F.col("id") % every == 0).distinct().withColumn("anchor", F.monotonically_increasing_id()))
    total, asked = ready.count(), anchors.count()
    if not asked:
        return spark.createDataFrame([], "anchor_id long, positive_rank int, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    largest = dict(ready.groupBy(F.size("v")).agg(F.max(squared)).collect())
    pivots = _pivots(ready, PIVOTS)

    def augmented(x: np.ndarray) -> np.ndarray:
        norms = (x**2).sum(axis=1)
        return np.concatenate([x, np.sqrt(np.maximum(0, largest[x.shape[1]] - norms))[:, None]], axis=1)

    shared = spark.sparkContext.broadcast({dims: augmented(p) for dims, p in pivots.items()})

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in zip(batch["id"], batch["label"], batch["v"], strict=True):
                rows = held.setdefault(len(row[2]), [])
                rows.append(row)
                if len(rows) == BLOCK_ROWS:
                    yield packed(held.pop(len(row[2])))
        for rows in held.values():
            yield packed(rows)

    def packed(rows: list[tuple]) -> pd.DataFrame:
        ids, labels, values = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        order = np.lexsort((ids, labels))
        ids, labels, values = ids[order], labels[order], values[order]
        own = shared.value.get(values.shape[1], np.zeros((0, values.shape[1] + 1)))
        x = augmented(values.astype(np.float64))
        distances = np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in own], axis=1) if len(own) else np.zeros((len(ids), 0))
        kind = np.int16 if values.min() >= -(2**15) and values.max() < 2**15 else np.int64
        return pd.DataFrame({"dims": [values.shape[1]], "width": [np.dtype(kind).itemsize], "ids": [ids.tobytes()], "labels": [labels.tobytes()], "data": [values.astype(kind).tobytes()], "distances": [distances.tobytes()]})

    count = max(1, math.ceil(total / BLOCK_ROWS))
    slots, parts = min(count, SLOTS), max(1, math.ceil(asked / BLOCK_ANCHORS))
    dealt = ready.repartition(count).mapInPandas(build, "dims int, width int, ids binary, labels binary, data binary, distances binary")
    blocks = cut(dealt.withColumn("slot", F.spark_partition_id() % slots))

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[Table, list]]:
        for batch in batches:
            for row in batch.itertuples():
                ids, labels = np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64)
                values = np.frombuffer(row.data, np.int16 if row.width == 2 else np.int64).reshape(len(ids), row.dims)
                own = shared.value.get(row.dims, np.zeros((0, row.dims + 1)))
                yield Table(ids, labels, values, np.frombuffer(row.distances).reshape(len(ids), len(own)), own, largest[row.dims]), row.asked

    def beside(asked_rows: DataFrame) -> DataFrame:
        """A stated query set against all rows, in blocks: every block of rows meets every block of anchors."""
        part = F.pmod(F.xxhash64("anchor"), F.lit(parts)).alias("part")
        packed_rows = asked_rows.select(part, F.size("v").alias("dims"), F.struct(*asked_rows.columns).alias("one")).groupBy("part", "dims").agg(F.collect_list("one").alias("asked"))
        spread = packed_rows.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        each = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        return each.join(spread, ["slot", "part", "dims"]).select("dims", "width", "ids", "labels", "data", "distances", "asked")

    def find_positives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, rows in tables(batches):
            out = []
            for q in rows:
                ids, scores = block.positives(q["id"], q["label"], np.array(q["v"], np.int64), positives)
                out.append(pd.DataFrame({"anchor": q["anchor"], "id": ids, "score": scores}))
            yield pd.concat(out)

    def find_negatives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high = window
        for block, rows in tables(batches):
            out = []
            for q in rows:
                scores = [int(s) for s in q["scores"]]
                bounds = [(-(-low * s // 100), high * s // 100) for s in scores]
                for place, (ids, found) in enumerate(block.negatives(q["id"], q["label"], np.array(q["v"], np.int64), bounds, negatives), 1):
                    out.append(pd.DataFrame({"anchor": q["anchor"], "place": place, "id": ids, "score": found}))
            yield pd.concat(out)

    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    met = beside(anchors).mapInPandas(find_positives, "anchor long, id long, score long")
    chosen = cut(met.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives))
    # At most ``positives`` scores for an anchor.
    scores = chosen.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("scores"))
    met = beside(anchors.join(scores, "anchor")).mapInPandas(find_negatives, "anchor long, place int, id long, score long")
    each = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    best = met.withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= negatives).select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    found = chosen.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(best, ["anchor", "place"]).join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return found.select("anchor_id", F.col("place").alias("positive_rank"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
