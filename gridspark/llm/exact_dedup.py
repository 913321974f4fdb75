"""Exact dedup over a log-structured merge index, in DataFrame functions only.

Documents' digests are gathered in memtables (one per run), each flushed as a
run sorted by digest, with a filter: a bitmap over hashed digests.  Compaction merges runs and keeps the smallest identifier of each
digest; digests that no other run's filter knows skip the merge.  Where a
digest was hit, the texts behind it are compared byte by byte.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import as_row, cut, filter_bits, from_row, quoted

#: White space runs that are not one plain space already; replacing them by a
#: space equals replacing every run by a space.
_UNEVEN_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"

#: Most bits of a filter, which is sized by the digests it holds: in 64-bit words, 2**20 rows.  This is what bounds the
#: broadcast; beyond, all digests take part in the merge, and all texts that occur in the verification.
MOST_BITS = 1 << 26


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _UNEVEN_SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _word(digest: Column, bits: int) -> Column:
    return F.shiftright(F.pmod(F.xxhash64(digest), F.lit(bits)), 6)


def _bit(digest: Column, bits: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (F.pmod(F.xxhash64(digest), F.lit(bits)) % 64).cast("int"))


def flush(manifest: DataFrame, runs: int) -> DataFrame:
    """Memtables to runs: (run, digest, first_id, rows), written sorted by digest.

    A memtable keeps one entry a digest; the map-side combine keeps copies of
    one text from meeting in a task.
    """
    tables = manifest.groupBy(F.pmod(F.xxhash64("id"), F.lit(runs)).cast("int").alias("run"), "digest").agg(F.min("id").alias("first_id"), F.count("*").alias("rows"))
    return cut(tables.sortWithinPartitions("run", "digest"))


def filters(flushed: DataFrame, runs: int, bits: int) -> DataFrame:
    """(word, f0, f1, ...): 64 bits of every run's filter a row; at most bits / 64 rows."""
    word, bit = _word(F.col("digest"), bits), _bit(F.col("digest"), bits)
    return flushed.groupBy(word.alias("word")).agg(*[F.coalesce(F.bit_or(F.when(F.col("run") == r, bit)), F.lit(0).cast("long")).alias(f"f{r}") for r in range(runs)])


def compact(flushed: DataFrame, runs: int) -> DataFrame:
    """One run of (digest, first_id, rows): the smallest identifier of each digest and its row count."""
    known, bits = F.lit(False), filter_bits(math.ceil(flushed.count() / runs), MOST_BITS)
    if bits is None:
        return flushed.groupBy("digest").agg(F.min("first_id").alias("first_id"), F.sum("rows").alias("rows"))
    for r in range(runs):
        known = known | ((F.col("run") != r) & (F.col(f"f{r}").bitwiseAND(_bit(F.col("digest"), bits)) != 0))
    probed = flushed.withColumn("word", _word(F.col("digest"), bits)).join(F.broadcast(filters(flushed, runs, bits)), "word").withColumn("known", known)
    merged = probed.where("known").groupBy("digest").agg(F.min("first_id").alias("first_id"), F.sum("rows").alias("rows"))
    return probed.where("not known").select("digest", "first_id", "rows").unionByName(merged)


def exact_dedup(
    docs: DataFrame,
    *,
    runs: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = normalised,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, digest, text_sha256).

    Texts are equal when their normal forms are; null texts count as empty.  Of
    equal texts the row with the smallest id stays (a null id only where no
    other has that text); of rows that repeat id and text, one.  An empty table
    gives an empty result; further columns are ignored.  ``digest`` may be any
    function of the normal form: texts that share a digest without being equal
    are told apart by their bytes.
    """
    texts = docs.select(quoted(id_col).alias("id"), normalise(quoted(text_col)).alias("norm")).withColumn("digest", digest(F.col("norm")))
    manifest = cut(texts.select("id", "digest", F.unhex(F.sha2("norm", 256)).alias("sha256")) if digest is not sha256 else texts.select("id", "digest"))
    if digest is sha256:
        manifest = manifest.withColumn("sha256", F.col("digest"))
    index = cut(compact(flush(manifest, runs), runs))

    # Byte verification of the hits: extremes of the texts behind a digest differ unless all are equal.
    repeated = index.where("rows > 1")
    bits, behind = filter_bits(repeated.count(), MOST_BITS), texts
    if bits is not None:
        hits = repeated.groupBy(_word(F.col("digest"), bits).alias("word")).agg(F.bit_or(_bit(F.col("digest"), bits)).alias("bits"))
        behind = texts.withColumn("word", _word(F.col("digest"), bits)).join(F.broadcast(hits), "word").where(F.col("bits").bitwiseAND(_bit(F.col("digest"), bits)) != 0)
    extremes = behind.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    collided = cut(extremes.where("low != high").select("digest"))

    groups = index.select("digest", F.lit(None).cast("binary").alias("exact"), F.col("first_id").alias("keep_id"), F.col("rows").alias("group_size"))
    members = manifest.groupBy("id", "digest", "sha256").agg(F.count("*").alias("repeats")).withColumn("exact", F.lit(None).cast("binary"))
    if not collided.isEmpty():
        # Rare: groups of these digests are those of the texts themselves, hashed by SHA-256.
        apart = members.join(collided, "digest", "left_semi").withColumn("exact", F.col("sha256"))
        groups = groups.join(collided, "digest", "left_anti").unionByName(apart.groupBy("digest", "exact").agg(F.min("id").alias("keep_id"), F.sum("repeats").alias("group_size")))
        members = members.join(collided, "digest", "left_anti").unionByName(apart)
        together = members.alias("m").join(groups.alias("g"), (F.col("m.digest") == F.col("g.digest")) & F.col("m.exact").eqNullSafe(F.col("g.exact")))
        found = together.select("id", "keep_id", "group_size", "repeats", "m.digest", "sha256")
    else:
        found = members.join(groups.drop("exact"), "digest").select("id", "keep_id", "group_size", "repeats", "digest", "sha256")
    return found.withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("long"), "repeats"))).select(
        "id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("repeat") == 1)).alias("kept"),
        "digest",
        F.lower(F.hex("sha256")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, columns unchanged, that ``exact_dedup`` keeps: one of each text."""
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), as_row(docs).alias("row"))
    kept = exact_dedup(rows, id_col="id", text_col="text").where("kept").select(F.col("id").alias("kept_id"), F.col("text_sha256").alias("kept_sha256"))
    keyed = rows.withColumn("sha256", F.sha2(normalised(F.col("text")), 256))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha256") == F.col("kept_sha256"))
    # Repeated rows share id and text; they meet in the join's own partitioning.
    return from_row(keyed.join(kept.hint("shuffle_hash"), same).dropDuplicates(["id", "sha256"]), "row", docs.columns)
