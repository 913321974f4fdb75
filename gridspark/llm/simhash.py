"""SimHash near-dedup by covering locality-sensitive hashing.

Every bit of a fingerprint gets a nonzero vector of r + 1 bits; table v keeps
the bits whose vector has odd parity with v.  Any r vectors leave some v
orthogonal to all of them, so every pair within radius r agrees on all bits
that some table keeps: no pair is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import as_row, cut, from_row, quoted

BITS = 64
SEED = 42

#: Buckets with more distinct fingerprints are split by further bits.  Of the
#: bits that a table ignores, groups of SPLIT_GROUPS are formed; a pair within
#: radius r leaves SPLIT_GROUPS - r of them equal.  A part then has fingerprints
#: that differ in r groups only: at most 2**(r * bits of a group) of them.
BUCKET = 512
SPLIT_GROUPS = 6

#: Links of a graph that one task joins up at most.
FEW_LINKS = 1 << 16


def _fingerprint(text: str | None) -> int:
    import xxhash

    hash64 = xxhash.xxh64_intdigest
    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    if len(words) < 3:
        return hash64(b" ".join(words), SEED)
    ones = np.zeros(BITS, np.int64)
    total = len(words) - 2
    for at in range(0, total, 1 << 16):
        part = words[at : at + (1 << 16) + 2]
        hashes = np.array([hash64(b"%b %b %b" % x, SEED) for x in zip(part, part[1:], part[2:])], dtype=np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")


def _text_digest(text: Column) -> Column:
    """SHA-256 of a text; empty for a null one, which differs from an empty text."""
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id, fp): the 64-bit SimHash of 3-word shingles of each row, as a signed long; with ``digests`` (id, digest, fp).  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # as Arrow: pandas would turn ids beside nulls into floats
            fp = np.array([_fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            kept = ["id", "digest"] if digests else ["id"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(fp.view(np.int64))], names=[*kept, "fp"])

    more = [_text_digest(F.col(text_col)).alias("digest")] if digests else []
    schema = f"id {dict(docs.dtypes)[id_col]}, " + ("digest binary, " if digests else "") + "fp long"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *more).mapInArrow(run, schema)


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The 2**(radius + 1) - 1 bit masks of the tables."""
    size = 1 << (radius + 1)
    vector = [1 + i % (size - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, size)]


def split_masks(mask: int, radius: int, bits: int = BITS) -> list[int]:
    """Masks that extend ``mask`` by all but ``radius`` groups of the bits it ignores."""
    ignored = [i for i in range(bits) if not mask >> i & 1]
    groups = [sum(1 << i for i in ignored[g::SPLIT_GROUPS]) for g in range(SPLIT_GROUPS)]
    return [mask | sum(kept) for kept in combinations(groups, SPLIT_GROUPS - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _roots(fp: np.ndarray, radius: int) -> np.ndarray:
    """For one bucket's distinct fingerprints: each one's component, as the place of its first member."""
    label = np.arange(len(fp))
    left = np.arange(len(fp))
    while len(left):  # breadth first from the first that is left; rows compared in blocks
        front, left = left[:1], left[1:]
        root = front[0]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            step = max(1, (1 << 20) // len(left))
            for at in range(0, len(front), step):
                near |= (np.bitwise_count(fp[front[at : at + step], None] ^ fp[left]) <= radius).any(axis=0)
            label[left[near]] = root
            front, left = left[near], left[~near]
    return label


def _bucket_links(radius: int):
    """Reads buckets, sorted by (tab, key), and yields links that join each bucket's components: one less than members."""

    def links(tab: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        edge = np.flatnonzero((tab[1:] != tab[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(fp)]])
        size = ends - starts
        a, b = [], []
        two = starts[size == 2]
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
        a.append(fp[two[near]])
        b.append(fp[two[near] + 1])
        for lo, hi in zip(starts[size > 2], ends[size > 2], strict=True):
            root = _roots(fp[lo:hi], radius)
            other = np.flatnonzero(root != np.arange(hi - lo))
            a.append(fp[lo + root[other]])
            b.append(fp[lo + other])
        return pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch["tab"].to_numpy(), batch["key"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            # The last bucket may go on in the next batch.
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            if len(last):
                cut_at = last[-1] + 1
                yield links(*[x[:cut_at] for x in held])
                held = [x[cut_at:] for x in held]
        if held is not None and len(held[0]):
            yield links(*held)

    return run


def links(distinct: DataFrame, *, radius: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) with the components of all pairs within ``radius``.

    Not every pair is returned: inside a bucket, members that are connected
    there hang on one of them.
    """
    masks = covering_masks(radius)
    tables = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("tab"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for i, m in enumerate(masks)])).alias("t")).select("fp", "t.tab", "t.key")
    sizes = tables.groupBy("tab", "key").agg(F.count("*").alias("members")).where("members > 1")
    shared = tables.join(sizes, ["tab", "key"])
    small = shared.where(F.col("members") <= BUCKET).select("tab", "key", "fp")
    finer = F.lit(None).cast("array<struct<tab:int,key:bigint>>")
    for i, m in enumerate(masks):
        parts = F.array(*[F.struct(F.lit(len(masks) + i * 1000 + k).alias("tab"), F.col("fp").bitwiseAND(F.lit(_signed(x)).cast("long")).alias("key")) for k, x in enumerate(split_masks(m, radius))])
        finer = F.when(F.col("tab") == i, parts).otherwise(finer)
    large = shared.where(F.col("members") > BUCKET).select("fp", F.explode(finer).alias("t")).select("t.tab", "t.key", "fp")
    buckets = small.unionByName(large)
    parts = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = buckets.repartition(parts, "tab", "key").sortWithinPartitions("tab", "key", "fp")
    return dealt.mapInPandas(_bucket_links(radius), "a long, b long").distinct()


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, to) of every node of links (a, b), of which there are few: ``to`` is the same for connected nodes."""
    links = pa.Table.from_batches(list(batches))
    values = pa.concat_arrays([*links.column(0).chunks, *links.column(1).chunks])
    keys = zip(*[x.to_pylist() for x in values.flatten()], strict=True) if pa.types.is_struct(values.type) else values.to_pylist()
    at: dict[object, int] = {}
    number = [at.setdefault(key, len(at)) for key in keys]
    root = list(range(len(at)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(number[: len(links)], number[len(links) :], strict=True):
        root[top(a)] = top(b)
    places = np.unique(number, return_index=True)[1]
    tops = np.array([top(x) for x in range(len(root))])
    yield pa.RecordBatch.from_arrays([values.take(pa.array(places)), values.take(pa.array(places[tops]))], names=["node", "to"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): equal roots for connected nodes.

    Each round maps every node to the neighbour (or itself) that a random order
    of that round puts first, and contracts the graph along that map; nodes of
    a component fall by a constant factor a round, whatever its shape.  Rounds
    are written to the shared folder.  The last FEW_LINKS links are joined up
    in one task, since a round costs the driver as much for few as for many.
    """
    maps: list[DataFrame] = []
    edges = cut(edges.where("a != b").select("a", "b"))
    while (count := edges.count()) > FEW_LINKS:
        order = F.xxhash64(F.lit(len(maps)), F.col("b"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(order.alias("o"), F.col("b").alias("to"))).alias("best"))
        own = F.struct(F.xxhash64(F.lit(len(maps)), F.col("a")).alias("o"), F.col("a").alias("to"))
        step = cut(best.select(F.col("a").alias("node"), F.least(own, F.col("best"))["to"].alias("to")))
        maps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x != y")
        edges = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if count:
        kind = dict(edges.dtypes)["a"]
        maps.append(cut(edges.coalesce(1).mapInArrow(_joined_up, f"node {kind}, to {kind}")))
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = maps[-1].select("node", F.col("to").alias("root"))
    for step in reversed(maps[:-1]):
        above = roots.select(F.col("node").alias("to"), "root")
        roots = step.join(above, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return roots


def _placed(distinct: DataFrame, radius: int) -> DataFrame:
    """Rows of distinct fingerprints with the ``root`` of their component."""
    roots = components(links(distinct, radius=radius)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_dedup(docs: DataFrame, *, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, fp, component_id, component_size).

    Fingerprints at ``radius`` differing bits or fewer link; ``component_id``
    is the smallest id reachable by links, itself included.  Texts without a
    word, null ones too, have fingerprint 0 and link like any other; repeated
    rows share a fingerprint; null ids never are a component's id unless it has
    no other; an empty table gives an empty result; further columns are ignored.
    """
    marked = cut(fingerprints(docs, id_col=id_col, text_col=text_col))
    distinct = cut(marked.groupBy("fp").agg(F.min("id").alias("first_id"), F.count("*").alias("rows")))
    placed = _placed(distinct, radius)
    sums = placed.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("rows").alias("component_size"))
    known = placed.select("fp", "root").join(sums, "root").drop("root")
    return marked.join(known, "fp").select("id", "fp", "component_id", "component_size")


def keep_one(docs: DataFrame, *, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, columns unchanged, one of each component.

    It is the one with the smallest id (a null id only where the component has
    no other), then fingerprint, then digest of the text; ids need not be
    unique.  Of rows that repeat id and text, one.
    """
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), as_row(docs).alias("row"))
    marked = fingerprints(rows, id_col="id", text_col="text", digests=True)
    order = [F.col("id").isNull().alias("no_id"), F.col("id")]
    distinct = cut(marked.groupBy("fp").agg(F.min(F.struct(*order, F.col("digest"))).alias("best")))
    best = F.struct("best.no_id", "best.id", "fp", "best.digest")
    chosen = _placed(distinct, radius).groupBy("root").agg(F.min(best).alias("best"))
    kept = chosen.select(F.col("best.id").alias("kept_id"), F.col("best.digest").alias("kept_digest"))
    keyed = rows.withColumn("digest", _text_digest(F.col("text")))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest"))
    return from_row(keyed.join(kept.hint("shuffle_hash"), same).dropDuplicates(["id", "digest"]), "row", docs.columns)
