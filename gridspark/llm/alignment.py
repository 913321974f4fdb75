"""Alignment of two tokenizers over the bytes of each text.

Both tokenizers' token ends are bits of a packed bitset over the bytes.  Their
AND has the shared cuts; popcounts (rank) turn a cut into a range of tokens on
each side: a group.  The two tokens that end at a shared cut are linked, and
links are counted by pair of ids over the corpus.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import cut

#: Pairs of ids whose counts are broadcast at most, the most frequent ones; the counts of others are joined by key.
MOST_PAIRS = 1 << 20

#: Bytes of texts aligned at once, and bytes of a part that a longer text is encoded in.
SLICE_BYTES = 1 << 18
PART_BYTES = 1 << 16

_SPACE = "▁"  # fixed value: how pieces write a space


@dataclass(frozen=True)
class Side:
    """Ids, as one array for some texts, and where each text's end in it."""

    ids: np.ndarray
    ends: np.ndarray


class _Vocabulary:
    """Bytes, byte lengths and decimal digits of a tokenizer's ids."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        written = [str(i).encode() for i in range(len(tokens))]
        self.width = len(written[-1])
        self.digits = np.array(written, f"S{self.width}").view(np.uint8).reshape(len(tokens), self.width)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones as they are, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=1)
def _tools(a_path: str, b_path: str):
    """Both tokenizers and their vocabularies; a process loads them once."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    alphabet = _byte_alphabet()
    with open(a_path, encoding="utf-8") as file:
        known = json.load(file)
    names = {**{i: t for t, i in known["model"]["vocab"].items()}, **{t["id"]: t["content"] for t in known["added_tokens"]}}
    a_tokens = [bytes(alphabet[c] for c in names.get(i, "") if c in alphabet) for i in range(max(names) + 1)]
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    b_tokens = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
    # Where no piece goes on after a space, a text may be cut before one.
    parted = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
    return a, b, _Vocabulary(a_tokens), _Vocabulary(b_tokens), parted


def _parts(text: str, parted: bool) -> list[str]:
    """A text that starts with a space in parts that do so, each cut between a letter or digit and a space."""
    if not parted or len(text) <= PART_BYTES:
        return [text]
    out, at = [], 0
    while len(text) - at > PART_BYTES:
        stop = text.find(" ", at + PART_BYTES)
        while stop > 0 and not text[stop - 1].isalnum():
            stop = text.find(" ", stop + 1)
        if stop <= 0 or stop + 1 == len(text):
            break
        out.append(text[at:stop])
        at = stop
    return [*out, text[at:]]


def encode_both(texts: list[str | None], a_path: str, b_path: str) -> tuple[Side, Side]:
    """Ids of space + text by both tokenizers; none for texts that are null, empty or not covered by both sides' bytes."""
    a, b, a_words, b_words, parted = _tools(a_path, b_path)
    parts, owners = [], []
    for i, text in enumerate(texts):
        if text:
            some = _parts(" " + text, parted)
            parts += some
            owners += [i] * len(some)
    by_text: list[list[list[int]]] = [[[] for _ in texts] for _ in range(2)]
    for side, found in enumerate(([e.ids for e in a.encode_batch_fast(parts, add_special_tokens=False)], b.encode([p[1:] for p in parts], num_threads=1))):
        for i, ids in zip(owners, found, strict=True):
            by_text[side][i] += ids
    for i, text in enumerate(texts):
        if text and not a_words.joined(by_text[0][i]) == b_words.joined(by_text[1][i]) == (" " + text).encode():
            by_text[0][i], by_text[1][i] = [], []
    return tuple(Side(np.array([x for ids in some for x in ids], np.int64), np.cumsum([len(ids) for ids in some])) for some in by_text)


def bitset(places: np.ndarray, size: int) -> np.ndarray:
    """Words of 64 bits with the bits at ``places`` set."""
    flags = np.zeros(-(-size // 64) * 64, np.uint8)
    flags[places] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def ranks(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many bits are set up to each place, itself included."""
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    mask = ~np.uint64(0) >> (np.uint64(63) - (places & 63).astype(np.uint64))
    return before[places >> 6] + np.bitwise_count(words[places >> 6] & mask)


@dataclass(frozen=True)
class Groups:
    """Shared cuts of some texts: the byte each group ends at, how many tokens end up to there on both sides, groups up to each text's end."""

    cuts: np.ndarray
    a_upto: np.ndarray
    b_upto: np.ndarray
    ends: np.ndarray


def groups_of(a: Side, b: Side, a_lengths: np.ndarray, b_lengths: np.ndarray) -> Groups:
    a_ends, b_ends = np.cumsum(a_lengths[a.ids]), np.cumsum(b_lengths[b.ids])
    size = int(a_ends[-1]) if len(a_ends) else 0
    a_bits, b_bits = bitset(a_ends - 1, size), bitset(b_ends - 1, size)
    cuts = np.flatnonzero(np.unpackbits((a_bits & b_bits).view(np.uint8), bitorder="little"))
    a_upto, b_upto = ranks(a_bits, cuts), ranks(b_bits, cuts)
    return Groups(cuts, a_upto, b_upto, np.searchsorted(a_upto, a.ends, side="right"))


def _digests(a: Side, b: Side, found: Groups, a_words: _Vocabulary, b_words: _Vocabulary) -> list[str]:
    """SHA-256 of each text's groups as text; '' without tokens."""
    groups = np.arange(len(found.cuts))
    of_a, of_b = (np.repeat(groups, np.diff(x, prepend=0)) for x in (found.a_upto, found.b_upto))
    width = max(a_words.width, b_words.width)
    written = np.zeros((len(a.ids) + len(b.ids), width + 1), np.uint8)
    at_a = np.arange(len(a.ids)) + np.concatenate([[0], found.b_upto])[of_a]
    at_b = np.arange(len(b.ids)) + found.a_upto[of_b]
    for at, side, words, last, upto in ((at_a, a, a_words, b"|", found.a_upto), (at_b, b, b_words, b";", found.b_upto)):
        written[at, : words.width] = words.digits[side.ids]
        written[at, width] = ord(",")
        written[at[upto - 1], width] = last[0]
    stops = np.concatenate([[0], np.cumsum((written != 0).sum(axis=1))])[a.ends + b.ends]
    flat = written.ravel()
    raw, out, at = flat[flat != 0].tobytes(), [], 0
    for stop in stops.tolist():
        out.append(hashlib.sha256(raw[at : stop - 1]).hexdigest() if stop > at else "")
        at = stop
    return out


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values).cast(kind))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows whose texts (column 1) come to about SLICE_BYTES."""
    column = batch.column(1)
    sizes = np.cumsum([len(t) if t else 0 for t in column.to_pylist()])
    at = 0
    while at < len(sizes):
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + SLICE_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


def aligned(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with its whole alignment: ids of both sides, and where each group ends in bytes and in tokens.

    (id, a_ids, b_ids, byte_ends, a_ends, b_ends): group g has the tokens
    before ``a_ends[g]`` and ``b_ends[g]`` that are in no earlier group.  Byte
    offsets count the space in front.  Null, empty and uncovered texts have
    none; no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tools(a_path, b_path)[2:4]
        for batch in batches:
            for part in _slices(batch):
                a, b = encode_both(part.column(1).to_pylist(), a_path, b_path)
                found = groups_of(a, b, words[0].lengths, words[1].lengths)
                of = np.repeat(np.arange(len(a.ends)), np.diff(found.ends, prepend=0))
                bytes_before = np.concatenate([[0], np.cumsum(words[0].lengths[a.ids])])[np.concatenate([[0], a.ends[:-1]])[of]]
                own = [found.cuts + 1 - bytes_before, *(x - np.concatenate([[0], s.ends[:-1]])[of] for x, s in ((found.a_upto, a), (found.b_upto, b)))]
                columns = [part.column(0), _lists(a.ids, a.ends, pa.int32()), _lists(b.ids, b.ends, pa.int32()), *(_lists(x, found.ends, pa.int64()) for x in own)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "a_ids", "b_ids", "byte_ends", "a_ends", "b_ends"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, a_ids array<int>, b_ids array<int>, byte_ends array<bigint>, a_ends array<bigint>, b_ends array<bigint>")


def _linked(rows: DataFrame, a_path: str, b_path: str, base: int) -> DataFrame:
    """(id, n_a, n_b, n_groups, groups_sha256, codes, times) of rows (id, text): linked pairs as a_id * base + b_id, with how often a row has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_words, b_words = _tools(a_path, b_path)[2:4]
        for batch in batches:
            for part in _slices(batch):
                a, b = encode_both(part.column(1).to_pylist(), a_path, b_path)
                found = groups_of(a, b, a_words.lengths, b_words.lengths)
                counts = np.diff(found.ends, prepend=0)
                codes = a.ids[found.a_upto - 1] * base + b.ids[found.b_upto - 1]
                of = np.repeat(np.arange(len(counts)), counts)
                order = np.lexsort((codes, of))
                codes, of = codes[order], of[order]
                first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (of[1:] != of[:-1])])[: len(codes)])
                ends = np.searchsorted(of[first], np.arange(len(counts)), side="right")
                numbers = [pa.array(x) for x in (np.diff(a.ends, prepend=0), np.diff(b.ends, prepend=0), counts)]
                columns = [part.column(0), *numbers, pa.array(_digests(a, b, found, a_words, b_words)), _lists(codes[first], ends, pa.int64()), _lists(np.diff(np.append(first, len(codes))), ends, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_a", "n_b", "n_groups", "groups_sha256", "codes", "times"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_a long, n_b long, n_groups long, groups_sha256 string, codes array<bigint>, times array<int>")


def pair_counts(linked: DataFrame, base: int) -> DataFrame:
    """(code, n, best): how many links of the corpus hold each pair, and whether that is the highest of its b id."""
    pairs = linked.select(F.explode(F.arrays_zip("codes", "times")).alias("p")).groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.times").alias("n"))
    pairs = cut(pairs)
    # A row for each b id: no more than its vocabulary has.
    highest = pairs.groupBy((F.col("code") % base).alias("b")).agg(F.max("n").alias("most"))
    return cut(pairs.join(highest, F.col("code") % base == F.col("b")).select("code", "n", (F.col("n") == F.col("most")).alias("best")))


def _frequent(pairs: DataFrame, most: int) -> tuple[int, int]:
    """(least count of a broadcast pair, pairs below it): a power of two such that at most ``most`` pairs are at or above it."""
    sizes = pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("pairs")).collect()
    taken, least = 0, 62
    for k, n in sorted(((r.k, r.pairs) for r in sizes), reverse=True):
        if taken + n > most:
            break
        taken, least = taken + n, k
    return 1 << least, sum(r.pairs for r in sizes) - taken


def align(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    Byte offsets where tokens of both sides end cut them into groups; the
    tokens that end together are linked.  A pair's count is the number of links
    of the corpus that hold it: ``count_sum`` adds it up over a row's links,
    ``n_best`` counts those whose count is the highest of their b id, ties
    included.  Null and empty texts, and texts that a side's token bytes do not
    give back, have no tokens: zeros, and '' for the digest.  Rows that repeat
    others count as often as they are there; ids may be anything, also null; an
    empty table gives an empty result; further columns are ignored.

    Counts of the most frequent pairs, MOST_PAIRS at most, are broadcast; a
    rarer pair is joined by its code, of which no task then holds many.
    """
    spark = docs.sparkSession
    base = _tools(a_path, b_path)[1].get_piece_size()
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    linked = cut(_linked(named, a_path, b_path, base).withColumn("row", F.monotonically_increasing_id()))
    pairs = pair_counts(linked, base)
    least, rare = _frequent(pairs, MOST_PAIRS)
    frequent = pairs.where(F.col("n") >= least).sort("code").toArrow()
    known = spark.sparkContext.broadcast(tuple(frequent.column(c).to_numpy() for c in ("code", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = known.value
        for batch in batches:
            own, times = (batch.column(c).flatten().to_numpy() for c in ("codes", "times"))
            ends = np.cumsum(batch.column("codes").value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(codes, own), max(0, len(codes) - 1))
            hit = codes[at] == own if len(codes) else np.zeros(len(own), bool)
            sums = [np.concatenate([[0], np.cumsum(np.where(hit, x[at] * times if len(codes) else 0, 0))]) for x in (best, counts)]
            total = [pa.array(np.diff(s[np.concatenate([[0], ends])])) for s in sums]
            left = np.concatenate([[0], np.cumsum(~hit)])[ends] if len(ends) else ends
            columns = [*(batch.column(c) for c in ("row", "id", "n_a", "n_b", "n_groups", "groups_sha256")), *total, _lists(own[~hit], left, pa.int64()), _lists(times[~hit], left, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "n_a", "n_b", "n_groups", "groups_sha256", "n_best", "count_sum", "codes", "times"])

    kind = dict(linked.dtypes)["id"]
    scored = linked.mapInArrow(run, f"row long, id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long, codes array<bigint>, times array<int>")
    if rare:
        scored = cut(scored)
        open_ = scored.select("row", F.explode(F.arrays_zip("codes", "times")).alias("p")).select("row", F.col("p.codes").alias("code"), F.col("p.times").alias("times"))
        met = open_.join(pairs.where(F.col("n") < least), "code")
        more = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_count"))
        scored = scored.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_count", F.lit(0))})
    return scored.select("id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
