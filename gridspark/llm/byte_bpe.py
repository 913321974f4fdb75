"""Byte-level BPE: encoding by merges on padded numpy matrices, and decoding.

Pieces of the splitting pattern that a task has not met yet are put into
matrices by length, one row a piece, one column a byte.  Each round, every row
merges its leftmost pair of minimum rank: pairs are looked up in a hash table
of token pairs, rows close up, and rows without pairs leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a matrix, pieces a worker remembers, and characters split at once.
MATRIX_CELLS = 1 << 21
MEMO_PIECES = 400_000
SPLIT_CHARS = 1 << 21

#: Row length from which a round merges every occurrence of the minimum rank where that comes to the same: one pair a
#: round would take time with the square of the length, minutes for a piece of a hundred thousand letters.
LONG_ROW = 2048
_NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Token bytes by rank, and an open-addressing hash table from token pairs to the merged token."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        rank = {t: i for i, t in enumerate(tokens)}
        self.of_byte = np.array([rank[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {(rank[t[:i]], rank[t[i:]]): r for t, r in rank.items() for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank}
        keys = np.array([a << 32 | b for a, b in pairs], dtype=np.uint64)
        self.bits = max(4, int(len(pairs) * 2).bit_length())
        self.keys = np.full(1 << self.bits, 2**64 - 1, dtype=np.uint64)
        self.ranks = np.full(1 << self.bits, _NONE, dtype=np.int32)
        values, slots, pending = np.array(list(pairs.values()), dtype=np.int32), self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(pending):  # every key takes its slot if it is free, else the next
            self.probes += 1
            free = self.keys[slots[pending]] == np.uint64(2**64 - 1)
            _, first = np.unique(slots[pending[free]], return_index=True)
            won = pending[free][first]
            self.keys[slots[won]], self.ranks[slots[won]] = keys[won], values[won]
            pending = np.setdiff1d(pending, won, assume_unique=True)
            slots[pending] = (slots[pending] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged token of each pair; _NONE where there is none or a side is padding (-1)."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint32).astype(np.uint64)
        slots = self._slot(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.ranks[slots], _NONE)
        unsure = np.flatnonzero((held != keys) & (held != np.uint64(2**64 - 1)))
        for _ in range(self.probes):
            if not len(unsure):
                break
            slots[unsure] = (slots[unsure] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slots[unsure]]
            hit = held == keys[unsure]
            out[unsure[hit]] = self.ranks[slots[unsure[hit]]]
            unsure = unsure[~hit & (held != np.uint64(2**64 - 1))]
        out[(left < 0) | (right < 0)] = _NONE
        return out

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            buckets.setdefault(4 if len(piece) <= 4 else 1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, members in buckets.items():
            rows = max(1, MATRIX_CELLS // width)
            for at in range(0, len(members), rows):
                some = members[at : at + rows]
                for i, ids in zip(some, self._merge([pieces[i] for i in some], width), strict=True):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], width: int) -> list[list[int]]:
        lengths = np.array([len(p) for p in pieces])
        cells = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(len(pieces), width)
        ids = self.of_byte[cells]
        ids[np.arange(width) >= lengths[:, None]] = -1
        ranks = np.full(ids.shape, _NONE, dtype=np.int32)
        ranks[:, :-1] = self.rank_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), width - 1)
        where, done = np.arange(len(pieces)), [np.empty(0, np.int32)] * len(pieces)
        while len(ids):
            best = ranks.argmin(axis=1)  # the leftmost of the smallest
            least = ranks[np.arange(len(ids)), best]
            if (over := least == _NONE).any():
                for i in np.flatnonzero(over):
                    done[where[i]] = ids[i, : lengths[i]].copy()
                ids, ranks, lengths, where, best, least = ids[~over], ranks[~over], lengths[~over], where[~over], best[~over], least[~over]
                if not len(ids):
                    break
            if width >= LONG_ROW:
                for i in range(len(ids)):
                    lengths[i] = self._merge_all(ids[i], ranks[i], lengths[i], best[i], least[i])
            else:
                row, column = np.arange(len(ids)), np.arange(ids.shape[1] - 1)
                shift = column + (column > best[:, None])
                ids[row, best] = least
                ids[:, :-1] = np.take_along_axis(ids, shift, axis=1)
                ranks[:, :-1] = np.take_along_axis(ranks, shift, axis=1)
                ids[:, -1], ranks[:, -1] = -1, _NONE
                lengths -= 1
                last = ids.shape[1] - 1
                ranks[row, best] = np.where(best < last, self.rank_of(least, ids[row, np.minimum(best + 1, last)]), _NONE)
                left = np.maximum(best - 1, 0)
                ranks[row, left] = np.where(best > 0, self.rank_of(ids[row, left], least), ranks[row, left])
                if (longest := int(lengths.max())) < ids.shape[1] // 2:
                    ids, ranks = ids[:, :longest].copy(), ranks[:, :longest].copy()
        return [d.tolist() for d in done]

    def _merge_all(self, ids: np.ndarray, ranks: np.ndarray, length: int, best: int, least: int) -> int:
        """One round of a long row, in place: its new length.

        Every occurrence of the smallest rank is merged at once, from the left,
        unless a merge would create a pair of smaller rank, which one merge at a
        time would take first; then only the leftmost is.
        """
        at = np.flatnonzero(ranks[: length - 1] == least)
        if len(at) > 1:
            # Of occurrences that overlap in a chain, every other one is merged.
            chain_start = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - chain_start) % 2 == 0]
            merged = np.zeros(length, bool)
            merged[at] = True
            token = np.full(len(at), least, np.int32)
            right = np.where(at + 2 < length, ids[np.minimum(at + 2, length - 1)], -1)
            before = np.where(at > 0, ids[np.maximum(at - 1, 0)], -1)
            before = np.where((at > 1) & merged[np.maximum(at - 2, 0)], least, before).astype(np.int32)
            if min(self.rank_of(token, right.astype(np.int32)).min(), self.rank_of(before, token).min()) < least:
                at = at[:1]
        else:
            at = np.array([best])
        keep = np.ones(length, bool)
        keep[at + 1] = False
        ids[at] = least
        new = at - np.arange(len(at))
        size = length - len(at)
        ids[:size], ranks[:size] = ids[:length][keep], ranks[:length][keep]
        ids[size:length], ranks[size:length] = -1, _NONE
        ranks[size - 1] = _NONE
        touched = np.unique(np.concatenate([new, new - 1]))
        touched = touched[(touched >= 0) & (touched < size - 1)]
        ranks[touched] = self.rank_of(ids[touched], ids[touched + 1])
        return size


@lru_cache(maxsize=2)
def vocabulary(ranks: bytes) -> Vocabulary:
    by_rank = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    return Vocabulary([by_rank[i] for i in range(len(by_rank))])


def _pieces(pattern, text: str) -> Iterator[list[str]]:
    if len(text) <= SPLIT_CHARS:
        yield pattern.findall(text)
        return
    found = (m.group() for m in pattern.finditer(text))
    while some := list(islice(found, 1 << 18)):
        yield some


def read_ranks(path: str) -> bytes:
    """A rank file's content: bounded by the vocabulary, about a megabyte."""
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per input row: (id, n_tokens, ids_sha256, decoded_sha256, identical[, ids]).

    ``ids_sha256`` digests the decimal ids joined by one space, and
    ``decoded_sha256`` the bytes that the ids decode to; ``identical`` compares
    those with the text.  Null and empty texts have no tokens; repeated rows
    each have a row; an empty table gives an empty result; further columns are
    ignored.  The rank file is read on the driver and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    memo: dict[str, tuple[str, tuple[int, ...]]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        vocab, split = vocabulary(shared.value), regex.compile(pattern)
        token = vocab.tokens.__getitem__
        def learn(pieces: set[str]) -> None:
            new = [p for p in pieces if p not in memo]
            if len(memo) + len(new) > MEMO_PIECES:
                memo.clear()
                new = list(pieces)
            for piece, found in zip(new, vocab.encode([p.encode() for p in new]), strict=True):
                memo[piece] = (" ".join(map(str, found)), tuple(found))

        def coded(text: str, first: list[str] | None) -> tuple:
            ids_hash, byte_hash, count, ids, started = hashlib.sha256(), hashlib.sha256(), 0, [], False
            for pieces in [first] if first is not None else _pieces(split, text):
                if first is None:
                    learn(set(pieces))
                known = [memo[p] for p in pieces]
                flat = list(chain.from_iterable(c[1] for c in known))
                if flat:
                    ids_hash.update(((" " if started else "") + " ".join([c[0] for c in known])).encode())
                    started = True
                byte_hash.update(b"".join(map(token, flat)))
                count += len(flat)
                if with_ids:
                    ids += flat
            return count, ids_hash.hexdigest(), byte_hash.hexdigest(), byte_hash.digest() == hashlib.sha256(text.encode()).digest(), ids

        for batch in batches:  # ids stay as they came: pandas would turn those beside nulls into floats
            out, texts, at = [], [t or "" for t in batch.column(1).to_pylist()], 0
            while at < len(texts):
                # Texts whose new pieces are merged together: about SPLIT_CHARS, or one long text in slices.
                to, held = at + 1, len(texts[at])
                while to < len(texts) and held + len(texts[to]) <= SPLIT_CHARS:
                    held += len(texts[to])
                    to += 1
                if held > SPLIT_CHARS:
                    out.append(coded(texts[at], None))
                else:
                    pieces = [split.findall(t) for t in texts[at:to]]
                    learn(set(chain.from_iterable(pieces)))
                    out += [coded(t, p) for t, p in zip(texts[at:to], pieces, strict=True)]
                at = to
            kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int32())][: 4 + with_ids]
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "identical", "ids"][: 5 + with_ids])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, identical boolean" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema)
