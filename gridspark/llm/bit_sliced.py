"""Exact top-k inner products over a bit-sliced index.

The index keeps, per block of rows and per component, one bitmap for each high
bit of the quantised value.  A query adds the slices, weighted by its own bits,
with bitmap arithmetic; the slices of the sums, read from the most significant
one down, give the rows that can be among the top k, and those at the boundary
are resolved by their exact integer products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import cut

#: Rows of an index block, queries of a query block, tasks that a query block's
#: search is spread over at most, and bits a component keeps as slices.
BLOCK_ROWS = 16_384
BLOCK_QUERIES = 4_096
SLOTS = 256
SLICES = 8

Bits = list[np.ndarray]


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as array<bigint>; null if a component is null or not finite, or its number no bigint."""
    x = F.transform(vector, lambda v: v.cast("double"))
    sound = vector.isNotNull() & (F.size(vector) > 0) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float(2**63) / scale), F.lit(False)))
    return F.when(sound, F.transform(x, lambda v: F.floor(v * scale)))


def digits(weight: int) -> list[tuple[int, bool]]:
    """(place, whether negative) of the non-adjacent binary digits of a weight: a third of its places at the mean, where plain binary has a half."""
    found, at = [], 0
    while weight:
        if weight & 1:
            digit = 2 - (weight & 3)
            found.append((at, digit < 0))
            weight -= digit
        weight >>= 1
        at += 1
    return found


def added(terms: dict[int, list[np.ndarray]]) -> Bits:
    """The slices of the sum of bitmaps, given by place as stacks of rows.

    At each place, thirds of the stack go through full adders at once, which
    leave a stack of sums and one of carries for the next place, until one
    bitmap is left.
    """
    total: Bits = []
    while terms:
        stacks = terms.pop(len(total), [])
        stack = np.concatenate(stacks) if stacks else None
        if stack is None:
            total.append(np.zeros_like(next(iter(terms.values()))[0][0]))
            continue
        carries = []
        while len(stack) > 2:
            n = len(stack) // 3
            a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
            half = a ^ b
            carries.append((a & b) | (half & c))
            stack = np.concatenate((half ^ c, stack[3 * n :]))
        if len(stack) == 2:
            carries.append(stack[:1] & stack[1:])
            stack = stack[:1] ^ stack[1:]
        total.append(stack[0])
        if carries:
            terms.setdefault(len(total), []).extend(carries)
    return total


def _count(words: np.ndarray) -> int:
    return int(np.bitwise_count(words).sum())


def top_rows(total: Bits, among: np.ndarray, k: int, slack: int) -> np.ndarray:
    """Bitmap of the rows of ``among`` whose sum is at least the k-th highest sum less ``slack``."""
    sure, equal = np.zeros_like(among), among.copy()
    threshold = 0
    for i in range(len(total) - 1, -1, -1):
        higher = equal & total[i]
        if _count(sure | higher) >= k:
            equal = higher
            threshold |= 1 << i
        else:
            sure |= higher
            equal &= ~total[i]
    threshold = max(0, threshold - slack)
    above, equal = np.zeros_like(among), among.copy()
    for i in range(len(total) - 1, -1, -1):
        if threshold >> i & 1:
            equal &= total[i]
        else:
            above |= equal & total[i]
            equal &= ~total[i]
    return above | equal


class Block:
    """The bit-sliced index of some rows: ids, exact values, and slices of every component."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.low = values.min(axis=0)
        span = max(int(h) - int(m) for h, m in zip(values.max(axis=0), self.low, strict=True))
        self.cut = max(0, span.bit_length() - SLICES)
        coarse = (self.values - self.low).view(np.uint64) >> np.uint64(self.cut)
        width = -(-len(ids) // 64) * 64
        bits = min(SLICES, max(1, span.bit_length()))
        padded = np.zeros((values.shape[1], width), np.uint64)
        padded[:, : len(ids)] = coarse.T
        plain = np.array([[np.packbits((c >> np.uint64(b) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64) for b in range(bits)] for c in padded])
        # Slice by slice, every component's bitmap and then every component's complement.
        self.slices = np.ascontiguousarray(np.concatenate((plain, ~plain)).transpose(1, 0, 2))
        self.rows = np.packbits(np.arange(width) < len(ids), bitorder="little").view(np.uint64)

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, the query's own left out, ties to the smaller id."""
        among = self.rows
        own = np.flatnonzero(self.ids == query_id)
        if len(own):
            among = among.copy()
            np.bitwise_and.at(among, own // 64, ~(np.uint64(1) << (own % 64).astype(np.uint64)))
        # For a negative digit the complement counts, which shifts all sums alike.
        places: dict[int, list[int]] = {}
        for c, q in enumerate(query.tolist()):
            for at, negative in digits(q):
                places.setdefault(at, []).append(c + len(query) * negative)
        terms: dict[int, list[np.ndarray]] = {}
        for at, components in places.items():
            for b, component in enumerate(self.slices):
                terms.setdefault(at + b, []).append(component[components])
        total = added(terms) or [np.zeros_like(among)]
        # The bits cut off change a sum by less than this, in units of what is kept.
        slack = int(np.abs(query).sum()) if self.cut else 0
        chosen = np.flatnonzero(np.unpackbits(top_rows(total, among, k, slack).view(np.uint8), bitorder="little"))
        scores = self.values[chosen] @ query
        best = np.lexsort((self.ids[chosen], -scores))[:k]
        return self.ids[chosen][best], scores[best]


def top_k(vectors: DataFrame, *, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates all
    rows but those with the query's id.  Vectors that are null, empty, hold a
    null or non-finite component (or one whose whole number no bigint holds)
    take no part, nor do null ids; only vectors of equal length are compared.
    A row that repeats another is a candidate as often as it is there, and a
    query once; unlike vectors on one id are queries of their own, each with
    its own ranks under that id.  No vectors, no rows; further columns are ignored.  Scores are
    exact below 2**63.
    """
    spark = vectors.sparkSession
    ready = vectors.select(F.col(id_col).alias("id"), quantised(F.col(vector_col), scale).alias("v")).where("id is not null and v is not null")
    total, asked = ready.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    query_blocks = math.ceil(asked / BLOCK_QUERIES)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for i, v in zip(batch["id"], batch["v"], strict=True):
                ids, rows = held.setdefault(len(v), ([], []))
                ids.append(i)
                rows.append(v)
                if len(ids) == BLOCK_ROWS:
                    yield packed(*held.pop(len(v)))
        for ids, rows in held.values():
            yield packed(ids, rows)

    def packed(ids: list, rows: list) -> pd.DataFrame:
        values = np.array(rows, np.int64)
        kind = np.int16 if values.min() >= -(2**15) and values.max() < 2**15 else np.int64
        return pd.DataFrame({"dims": [values.shape[1]], "width": [np.dtype(kind).itemsize], "ids": [np.array(ids, np.int64).tobytes()], "data": [values.astype(kind).tobytes()]})

    schema = "dims int, width int, ids binary, data binary"
    count = math.ceil(total / BLOCK_ROWS)
    slots = min(count, SLOTS)
    blocks = ready.repartition(count).mapInPandas(build, schema).withColumn("slot", F.spark_partition_id() % slots)
    part = F.pmod(F.xxhash64("id"), F.lit(query_blocks)).alias("part")
    asked_rows = cut(ready.where(F.col("id") % every == 0).distinct().withColumn("query", F.monotonically_increasing_id())).select(part, "query", "id", "v", F.size("v").alias("dims"))
    queries = asked_rows.groupBy("part", "dims").agg(F.collect_list(F.struct("query", "id", "v")).alias("queries"))
    queries = queries.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    # A stated query set against all rows, in blocks: every index block meets every query block.
    pairs = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long")))).join(queries, ["slot", "part", "dims"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                values = np.frombuffer(row.data, np.int16 if row.width == 2 else np.int64).reshape(-1, row.dims).astype(np.int64)
                block, out = Block(np.frombuffer(row.ids, np.int64), values), []
                for q in row.queries:
                    ids, scores = block.top(q["id"], np.array(q["v"], np.int64), k)
                    out.append(pd.DataFrame({"query": q["query"], "query_id": q["id"], "vec_id": ids, "score": scores}))
                yield pd.concat(out)

    found = pairs.select("dims", "width", "ids", "data", "queries").mapInPandas(search, "query long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
