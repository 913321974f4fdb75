"""N-gram Jaccard join over parity sketches.

Every token of a set (the hash of a shingle) flips one bit of a sketch, so two
sketches differ in at most as many bits as the sets differ in tokens.  Sets of
Jaccard similarity t differ in at most (1 - t) / (1 + t) of their sizes' sum.
For each band of sizes the tokens are dealt into as many parts as a difference
can spoil, and some more, each with the parity of its own bits (of 2**64, held
as the xor of the hashes of those that are set): a set hands on its first words
that are not zero, two more than can differ, and similar sets meet in two of those at
least.  Pairs that meet are
held against wider sketches, whose Hamming distance bounds the difference from
below, and what is left is verified on the sets.

Equal sets are one class from the start.  Sets that are linked already need no
further pairs: the members of each list meet its first one, and only lists that
still hold several components go on to all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import cut, drop, filter_bits
from gridspark.llm.simhash import components

THRESHOLD = (4, 5)
SHINGLE = 5

#: Words of a set's sketch that agree at least, of those that it hands on: a pair that meets in short lists alone meets
#: in as many, and a list that is too long is split by a second word.
AGREE = 2

#: Sets of a list up to which its pairs are written, and up to which it is not split by a second word; sets of a block of it.
SHORT_LIST = 32
LONG_LIST = 1 << 13
BLOCK = 1024

#: Lists that a set names, the smallest of its keys, for a pair to be compared in the first one that both name.
NAMED = 16

#: Postings of one key in one task from which the key counts as hot; its list never meets in one task.
HOT = 64
HOT_BITS = 1 << 22

#: Sets of one task that hold a token from which it counts as frequent: it goes into no word.
FREQUENT = 12

#: Bits of the filter that tells which sets are wanted: more wanted sets let more others through, which a join then drops.
MOST_BITS = 1 << 28

SLICE_BYTES = 1 << 20
SLICE_WORDS = 1 << 21

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], np.uint64)


def _mixed(x: np.ndarray, k: int = 0) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[k]
    return (x ^ (x >> np.uint64(29))) * _MIX[1 - k]


def _tops() -> np.ndarray:
    """The largest size of each band: a quarter more than the one before, so that a set has partners in its own and the next."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return np.array(out)


TOPS = _tops()


def room(sizes, threshold: tuple[int, int]):
    """How many tokens two sets whose sizes have this sum may differ in."""
    num, den = threshold
    return sizes * (den - num) // (den + num)


class Sets:
    """Distinct shingle hashes of some texts: ``tokens`` in ascending order text by text, ``sizes``, ``starts``."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray, shingle: int = SHINGLE) -> None:
        low = _LOWER[raw]
        begins = np.concatenate([[0], ends[:-1]])
        space = np.concatenate([_SPACE[low], [True]])
        after = np.concatenate([[True], space[:-1]])
        after[begins[begins < len(low)]] = True
        starts = np.flatnonzero(after[:-1] & ~space[:-1])
        before = space[1:].copy()
        before[ends[ends > 0] - 1] = True
        lengths = np.flatnonzero(before & ~space[:-1]) + 1 - starts
        words = self._words(low, starts, lengths)
        first = np.searchsorted(starts, begins)
        count = np.diff(np.append(first, len(starts)))
        # A shingle for each word that has enough after it; a shorter text is one as a whole.
        own = np.maximum(count - shingle + 1, np.minimum(count, 1))
        text = np.repeat(np.arange(len(ends)), own)
        at = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(own) - own, own)
        long_ = count[text] >= shingle
        hashes = np.minimum(count, shingle)[text].astype(np.uint64)
        for k in range(shingle):
            there = long_ | (k < count[text])
            hashes[there] = (hashes[there] ^ words[at[there] + k]) * _MIX[0]
            hashes[there] ^= hashes[there] >> np.uint64(29)
        hashes = _mixed(hashes, 1)
        edges = np.concatenate([[0], np.cumsum(own)])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            hashes[a:b].sort()
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        self.tokens, self.owner = hashes[new], text[new]
        self.sizes = np.bincount(self.owner, minlength=len(ends))
        self.starts = np.cumsum(self.sizes) - self.sizes

    @staticmethod
    def _words(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A 64-bit hash of every word, eight bytes at a time."""
        padded = np.concatenate([low, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(low) + 1, "<u8", padded, strides=(1,))
        out = lengths.astype(np.uint64) * _MIX[0]
        open_, at = np.arange(len(starts)), 0
        while len(open_):
            part = eight[starts[open_] + at] & _FIRST_BYTES[np.minimum(lengths[open_] - at, 8)]
            x = (out[open_] ^ part) * _MIX[1]
            x = (x ^ (x >> np.uint64(29))) * _MIX[0]
            out[open_] = x ^ (x >> np.uint64(32))
            at += 8
            open_ = open_[lengths[open_] > at]
        return out

    def sums(self, k: int) -> np.ndarray:
        """A 64-bit number of each whole set."""
        total = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(self.tokens, k), dtype=np.uint64)])
        return _mixed(total[self.starts + self.sizes] - total[self.starts] + self.sizes.astype(np.uint64), k).view(np.int64)

    def sketches(self) -> tuple[np.ndarray, np.ndarray]:
        """(words, ends): each set's parity in at least twice as many bits as it has tokens; the number of words is a power of two."""
        width = 1 << np.ceil(np.log2(np.maximum(1, 2 * self.sizes / 64))).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(width)])
        out = np.zeros(ends[-1], np.uint64)
        place = (self.tokens >> np.uint64(20)).astype(np.int64) & (64 * width - 1)[self.owner]
        np.bitwise_xor.at(out, ends[self.owner] + (place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        return out, ends

    def keys(self, threshold: tuple[int, int], frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, owners): what each set hands on, for its own band of sizes and the next one if a partner can be in it.

        Words are of rare tokens alone (of slots that ``frequent`` lacks): without
        the others two sets differ in no more, and a passage that many texts
        share makes no word of its own.
        """
        num, den = threshold
        common = frequent[_slot(self.tokens)]
        rank = np.empty(len(self.tokens), np.int64)  # rare tokens first, then by hash
        rank[np.lexsort((self.tokens, common, self.owner))] = np.arange(len(self.tokens))
        rank -= self.starts[self.owner]
        band = np.searchsorted(TOPS, self.sizes)
        reach = np.searchsorted(TOPS, self.sizes * den // num)
        keys, owners = [], []
        for step in range(int((reach - band).max(initial=0)) + 1):
            top = TOPS[band + step]
            differ = room(self.sizes + np.minimum(top, self.sizes * den // num), threshold)
            use = (reach >= band + step) & (differ > 0)
            need = np.where(use, differ + AGREE, 0)
            most = room(2 * top, threshold) + AGREE
            parts = np.where(use, most + 3 + most // 16, 0)
            base = np.cumsum(parts) - parts
            inside = use[self.owner] & ~common
            token, owner = self.tokens[inside], self.owner[inside]
            part = ((token >> np.uint64(40)).astype(np.int64) * parts[owner]) >> 24
            words = np.zeros(parts.sum(), np.uint64)
            np.bitwise_xor.at(words, base[owner] + part, _mixed(token, 1))
            of = np.repeat(np.arange(len(parts)), parts)
            filled = np.concatenate([[0], np.cumsum(words != 0)])
            taken = (words != 0) & (filled[:-1] - filled[base][of] < need[of])
            where = np.flatnonzero(taken)
            name = (top[of[where]].astype(np.uint64) << np.uint64(24)) + (where - base[of[where]]).astype(np.uint64)
            keys.append(_mixed(words[where] * _MIX[1] ^ _mixed(name)))
            owners.append(of[where])
            # Sets with too few words that are not zero hand on their rarest tokens too, and meet others of the kind there.
            few = use & (filled[base + parts] - filled[base] < need)
            single = few[self.owner] & (rank < need[self.owner])
            keys.append(_mixed(self.tokens[single] ^ _mixed(top[self.owner[single]].astype(np.uint64), 1), 1))
            owners.append(self.owner[single])
        all_, of = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(of, kind="stable")
        return all_[order].view(np.int64), of[order]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, ends) of texts (column 1) of about SLICE_BYTES together; null ones are empty."""
    for batch in batches:
        column = pc.fill_null(batch.column(1), "")
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw, at = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, side="right")) - 1)
            yield batch.slice(at, to - at), raw[ends[at] : ends[to]], ends[at + 1 : to + 1] - ends[at]
            at = to


def _binary(words: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(words))])


def _marked(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, n, sig, sig2, marks, new) of every row (id, text); ``new`` and a sketch where a task has a set for the first time.

    A last row of each task, with n = -1, has the slots of the tokens that FREQUENT of its sets hold.
    """
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        names, tally, id_kind = ["id", "n", "sig", "sig2", "marks", "new"], _Tally(), pa.null()
        for rows, raw, ends in _texts(batches):
            sets, id_kind = Sets(raw, ends, shingle), rows.column(0).type
            sigs = [sets.sums(k) for k in (0, 1)]
            words, at = sets.sketches()
            new = _unseen(sets, sigs, seen)
            tally.add(sets.tokens[new[sets.owner]])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sets.sizes), *map(pa.array, sigs), _binary(words, at), pa.array(new)], names=names)
        if not pa.types.is_null(id_kind):
            slots = np.unique(_slot(tally.at_least(FREQUENT)))
            none = pa.array([0], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_kind), pa.array([-1], pa.int64()), none, none, pa.array([slots.tobytes()], pa.binary()), pa.array([False])], names=names)

    return docs.mapInArrow(run, f"id {kind}, n long, sig long, sig2 long, marks binary, new boolean").withColumn("marks", F.when(F.col("new") | (F.col("n") < 0), F.col("marks")))


class _Tally:
    """Counts of numbers, kept as distinct ones."""

    def __init__(self) -> None:
        self.held, self.count, self.new = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def add(self, numbers: np.ndarray) -> None:
        self.new.append(numbers.view(np.uint64))
        if sum(map(len, self.new)) > max(1 << 22, len(self.held)):
            self._merge()

    def _merge(self) -> None:
        numbers = np.concatenate([self.held, *self.new])
        order = np.argsort(numbers)
        each = np.concatenate([self.count, np.ones(len(numbers) - len(self.count), np.int64)])[order]
        numbers = numbers[order]
        starts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])[: len(numbers)])
        self.held, self.count, self.new = numbers[starts], np.add.reduceat(each, starts) if len(starts) else each, []

    def at_least(self, least: int) -> np.ndarray:
        self._merge()
        return self.held[self.count >= least]


def _frequent(marked: DataFrame) -> np.ndarray:
    """Which slots have a token that is frequent in some task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x, np.int64) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64))], names=["slot"])

    out = np.zeros(HOT_BITS, bool)
    out[marked.where("n < 0").select("marks").mapInArrow(run, "slot long").distinct().toArrow().column(0).to_numpy()] = True
    return out


def _unseen(sets: Sets, sigs: list[np.ndarray], seen: set[tuple[int, int]]) -> np.ndarray:
    new = np.zeros(len(sets.sizes), bool)
    for i, both in enumerate(zip(*(x.tolist() for x in sigs), strict=True)):
        if sets.sizes[i] and both not in seen:
            seen.add(both)
            new[i] = True
    return new


def _keys(docs: DataFrame, frequent: np.ndarray, threshold: tuple[int, int], shingle: int) -> DataFrame:
    """(keys, node): what the sets of rows (id, text) hand on; a task gives those of each set once."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        common = np.unpackbits(shared.value).astype(bool)
        for _, raw, ends in _texts(batches):
            sets = Sets(raw, ends, shingle)
            sigs = [sets.sums(k) for k in (0, 1)]
            new = _unseen(sets, sigs, seen)
            keys, of = sets.keys(threshold, common)
            count = np.bincount(of[new[of]], minlength=len(ends))[new]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(keys[new[of]]))
            yield pa.RecordBatch.from_arrays([lists, pa.array(sigs[0][new])], names=["keys", "node"])

    return docs.mapInArrow(run, "keys array<bigint>, node long")


def _slot(key: np.ndarray) -> np.ndarray:
    return (_mixed(key.view(np.uint64)) & np.uint64(HOT_BITS - 1)).astype(np.int64)


def _keys_and_nodes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """A batch of (keys or key, node) as one row a key."""
    node = batch.column(1).to_numpy()
    if not pa.types.is_list(batch.column(0).type):
        return batch.column(0).to_numpy(), node
    return batch.column(0).flatten().to_numpy(), np.repeat(node, batch.column(0).value_lengths().to_numpy())


def _hot(keyed: DataFrame) -> np.ndarray:
    """Which slots of a bitmap have a key that one task of ``keyed`` (keys or key, node) has HOT times or more.

    With T tasks a key that is left out has fewer than HOT * T postings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            tally.add(_keys_and_nodes(batch)[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slot(tally.at_least(HOT))))], names=["slot"])

    out = np.zeros(HOT_BITS, bool)
    out[keyed.mapInArrow(run, "slot long").distinct().toArrow().column(0).to_numpy()] = True
    return out


def _split_hot(keyed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Postings (key, node) whose lists may meet in one task, and those of hot keys, if any."""
    hot = _hot(keyed)
    shared = keyed.sparkSession.sparkContext.broadcast(np.packbits(hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            key, node = _keys_and_nodes(batch)
            for at in range(0, len(key), SLICE_WORDS):
                part = key[at : at + SLICE_WORDS]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(node[at : at + SLICE_WORDS]), pa.array(bits[_slot(part)])], names=["key", "node", "hot"])

    postings = keyed.mapInArrow(run, "key long, node long, hot boolean")
    return postings.where("not hot").drop("hot"), postings.where("hot").select("key", "node").distinct() if hot.any() else None


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Whole lists, as columns, of rows sorted by their first column."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not len(batch):
            continue
        now = [c.to_numpy() for c in batch.columns]
        done = int(np.searchsorted(now[0], now[0][-1]))
        if held and (done or held[-1][0][-1] != now[0][0]):
            done = max(done, int(np.searchsorted(now[0], held[-1][0][-1], side="right"))) if held[-1][0][-1] == now[0][0] else done
            held.append([x[:done] for x in now])
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        elif done:
            yield [x[:done] for x in now]
        else:
            done = 0
        held.append([x[done:] for x in now])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads postings (key, node) sorted by both and yields (key, first, node, size) of lists with several sets; the first is the smallest."""
    for key, node in _by_key(batches):
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        key, node = key[new], node[new]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        kept = np.repeat(size > 1, size)
        columns = key[kept], np.repeat(node[start], size)[kept], node[kept], np.repeat(size, size)[kept]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "first", "node", "size"])


def _met(keyed: DataFrame) -> DataFrame:
    """(key, first, node, size) of the lists of postings ``keyed`` (keys or key, node) that have several sets."""
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain, hot = _split_hot(keyed)
    found = plain.repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(_lists, "key long, first long, node long, size long")
    if hot is not None:
        first = hot.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("size")).where("size > 1")
        found = found.unionByName(hot.join(first, "key").select("key", "first", "node", "size"))
    return cut(found)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads short lists (first, key, node) sorted by first and key and yields their pairs (a, b, n), counted over the lists with one first member.

    Copies meet in many lists, most of which begin with the same one of them.
    """
    for first, key, node in _by_key(batches):
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (first[1:] != first[:-1])]))
        size, found = np.diff(np.append(start, len(key))), []
        for m in np.unique(size[size > 1]):
            i, j = np.triu_indices(m, 1)
            lists = start[size == m][:, None]
            x, y = node[(lists + i).ravel()], node[(lists + j).ravel()]
            found.append((np.minimum(x, y), np.maximum(x, y)))
        if not found:
            continue
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(np.diff(np.append(new, len(a))))], names=["a", "b", "n"])


def _sketch_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, all words) of sketches."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 8
    return ends[:-1], np.diff(ends), np.frombuffer(data, np.uint64, ends[-1]) if len(column) else np.zeros(0, np.uint64)


def _folded(base: np.ndarray, width: np.ndarray, words: np.ndarray, i: np.ndarray, to: int) -> np.ndarray:
    """Sketches i as rows of ``to`` words: wider ones are folded, which gives what they are in that width."""
    out = words[base[i][:, None] + np.arange(to)]
    for k in range(1, int(width[i].max(initial=0)) // to):
        more = width[i] > k * to
        out[more] ^= words[base[i[more]][:, None] + k * to + np.arange(to)]
    return out


def _alike(left: tuple, right: tuple, i: np.ndarray, j: np.ndarray, n_i: np.ndarray, n_j: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Which pairs (i of left, j of right) have sizes and sketches that two similar sets can have."""
    num, den = threshold
    good = (den * np.minimum(n_i, n_j) >= num * np.maximum(n_i, n_j))
    both = np.minimum(left[1][i], right[1][j])
    for to in np.unique(both[good]):
        at = np.flatnonzero(good & (both == to))
        step = max(1, SLICE_WORDS // int(to))
        for lo in range(0, len(at), step):
            x = at[lo : lo + step]
            bits = np.bitwise_count(_folded(*left, i[x], to) ^ _folded(*right, j[x], to)).sum(axis=1, dtype=np.int64)
            good[x] = bits <= room(n_i[x] + n_j[x], threshold)
    return good


def _near(pairs: DataFrame, sketches: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that sizes and sketches leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (_sketch_parts(batch.column(c)) for c in ("marks_a", "marks_b"))
            every = np.arange(len(batch))
            good = _alike(left, right, every, every, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), threshold)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    side = lambda x: sketches.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("marks").alias(f"marks_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _wanted_sets(rows: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(sig, sig2, tokens) of the sets whose sig is among ``nodes``; a few others pass the filter."""
    bits = filter_bits(nodes.count(), MOST_BITS, 16) or MOST_BITS
    place = F.pmod(F.col("node"), F.lit(bits))
    words = nodes.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for _, raw, ends in _texts(batches):
            sets = Sets(raw, ends, shingle)
            sig, sig2 = (sets.sums(k) for k in (0, 1))
            slot = sig & (bits - 1)
            hit = (shared.value[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            chosen = []
            for i in np.flatnonzero(hit & (sets.sizes > 0)).tolist():
                both = (int(sig[i]), int(sig2[i]))
                if both not in seen:
                    seen.add(both)
                    chosen.append(i)
            tokens = [sets.tokens[sets.starts[i] : sets.starts[i] + sets.sizes[i]].tobytes() for i in chosen]
            yield pa.RecordBatch.from_arrays([pa.array(sig[chosen]), pa.array(sig2[chosen]), pa.array(tokens, pa.binary())], names=["sig", "sig2", "tokens"])

    found = rows.mapInArrow(run, "sig long, sig2 long, tokens binary").join(nodes.select(F.col("node").alias("sig")), "sig", "left_semi")
    return found.groupBy("sig", "sig2").agg(F.first("tokens").alias("tokens"))


def _similar(pairs: DataFrame, rows: DataFrame, threshold: tuple[int, int], shingle: int) -> DataFrame:
    """Links (a, b) between sets (sig, sig2) for the pairs whose sets are similar."""
    num, den = threshold
    nodes = cut(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    sets = cut(_wanted_sets(rows, nodes, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("tokens_a"), batch.column("tokens_b"), strict=True):
                x, y = (np.frombuffer(c.as_buffer(), np.uint64) for c in (a, b))
                shared = int(np.isin(x, y, assume_unique=True, kind="sort").sum())
                good.append(den * shared >= num * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda x: sets.select(F.col("sig").alias(x), F.struct("sig", "sig2").alias(f"set_{x}"), F.col("tokens").alias(f"tokens_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select(F.col("set_a").alias("a"), F.col("set_b").alias("b"), "tokens_a", "tokens_b")
    kind = "struct<sig:bigint,sig2:bigint>"
    return cut(joined.mapInArrow(run, f"a {kind}, b {kind}"))


def _roots(links: DataFrame) -> DataFrame:
    """(node, root) of linked nodes; equal components have equal roots."""
    return components(links).select(F.col("node.sig").alias("node"), F.xxhash64("root").alias("root")).groupBy("node").agg(F.min("root").alias("root"))


def _rooted(rows: DataFrame, roots: DataFrame, column: str, into: str) -> DataFrame:
    named = roots.select(F.col("node").alias(column), F.col("root").alias(into))
    return rows.join(named, column, "left").withColumn(into, F.coalesce(into, F.xxhash64(column)))


def _verified(pairs: DataFrame, rows: DataFrame, threshold: tuple[int, int], shingle: int) -> DataFrame:
    """Links with the components of all similar ``pairs``: first each set's with its smallest partner, then what those leave apart."""
    first = _similar(cut(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")), rows, threshold, shingle)
    roots = cut(_roots(first))
    apart = cut(_rooted(_rooted(pairs, roots, "a", "root_a"), roots, "b", "root_b").where("root_a != root_b").select("a", "b"))
    return first if apart.isEmpty() else cut(first.unionByName(_similar(apart, rows, threshold, shingle)))


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, flags): lists of keys as rows of numbers from 1, filled up with 0, and a flag for each number, none set."""
    size = column.value_lengths().to_numpy()
    keys, number = np.unique(column.flatten().to_numpy(), return_inverse=True)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = number + 1
    return out, np.zeros(len(keys) + 1, bool)


def _dealt(members: DataFrame) -> DataFrame:
    """Members (key, node, ...) of long lists by ``cell``, with their ``block`` and whether its own pairs are compared in the cell (``within``).

    A list is dealt into blocks, and each two blocks are a cell, one group of at
    most about twice BLOCK members; the next block's cell has a block's own
    pairs, too.  So a list of two blocks is one cell, and one of k blocks has
    each member k - 1 times.
    """
    sized = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = members.join(sized, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: (x != F.col("block")) | (F.col("blocks") == 1))
    cells = dealt.withColumn("other", F.explode(others)).withColumn("within", F.col("other") == (F.col("block") + 1) % F.col("blocks"))
    return cells.withColumn("cell", F.struct("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))).drop("blocks", "other")


def _cells(members: DataFrame, sketches: DataFrame, threshold: tuple[int, int], *, forest: bool) -> DataFrame:
    """Pairs (a, b) of unlike roots within long lists (key, node, root), which sizes and sketches leave.

    With ``forest`` those of a cell that join what is still apart in it: fewer than its members.

    Near copies share many lists; each set brings the names of its first ones,
    and a pair that has a smaller one in common is left to that.
    """
    names = members.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("key")), 1, NAMED).alias("names"))
    cells = _dealt(members).join(sketches, "node").join(names, "node").withColumn("names", F.filter("names", lambda x: x < F.col("key")))
    num, den = threshold

    def run(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().sort_by([("n", "ascending"), ("node", "ascending")]).to_batches()[0]
        node, n, root, block = (batch.column(c).to_numpy() for c in ("node", "n", "root", "block"))
        within = batch.column("within").to_numpy(zero_copy_only=False)
        parts = _sketch_parts(batch.column("marks"))
        names, named = _padded(batch.column("names"))
        label = np.unique(root, return_inverse=True)[1]
        low, out = np.searchsorted(n, -(-num * n // den)), [np.zeros((2, 0), np.int64)]
        for j in range(len(n)):
            i = np.arange(low[j], j)
            i = i[(label[i] != label[j]) & ((block[i] != block[j]) | within[j])]
            named[names[j]] = names[j] > 0
            i = i[~named[names[i]].any(axis=1)]
            named[names[j]] = False
            if len(i):
                good = i[_alike(parts, parts, i, np.full(len(i), j), n[i], n[np.full(len(i), j)], threshold)]
                if forest and len(good):
                    met, first = np.unique(label[good], return_index=True)
                    good = good[first]
                    label[np.isin(label, met)] = label[j]
                out.append(np.stack([node[good], np.full(len(good), node[j])]))
        a, b = np.concatenate(out, axis=1)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return cells.select("cell", "node", "n", "root", "block", "within", "marks", "names").groupBy("cell").applyInArrow(run, "a long, b long")


def similar_sets(rows: DataFrame, marked: DataFrame, keyed: DataFrame, frequent: np.ndarray, *, threshold: tuple[int, int] = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """Links (a, b) between sets, as structs of sig and sig2, with the components of all similar pairs; ``keyed``, a table of their own, goes."""
    first = marked.where("new")
    sketches = first.select(F.col("sig").alias("node"), "n", "marks").dropDuplicates(["node", "n", "marks"])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = _met(keyed)
    drop(keyed)

    def near(pairs: DataFrame) -> DataFrame:
        return cut(_near(pairs.select("a", "b"), sketches, threshold))

    def live(members: DataFrame, links: DataFrame) -> DataFrame:
        """Members (key, node, root) of the lists that hold several components."""
        placed = _rooted(members, _roots(links), "node", "root")
        several = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
        return cut(placed.join(several, "key").select("key", "node", "root"))

    # Pairs that short lists have are in AGREE of them, unless a long list has them too.  Members of long lists meet the first one.
    short = met.where(F.col("size") <= SHORT_LIST).select("first", "key", "node").repartition(parts, "first").sortWithinPartitions("first", "key")
    counted = short.mapInArrow(_pairs, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= AGREE)
    beside = met.where((F.col("size") > SHORT_LIST) & (F.col("first") != F.col("node"))).select(F.col("first").alias("a"), F.col("node").alias("b"))
    links = _verified(near(counted.select("a", "b").unionByName(beside).distinct()), rows, threshold, shingle)
    long_ = met.where(F.col("size") > SHORT_LIST).select("key", "node")
    if long_.isEmpty():
        return links
    long_ = live(long_, links)
    sized = long_.join(long_.groupBy("key").agg(F.count("*").alias("size")), "key")
    compared = sized.where(F.col("size") <= LONG_LIST).select("key", "node", "root")
    longest = cut(sized.where(F.col("size") > LONG_LIST).select("key", "node"))
    if not longest.isEmpty():
        # Similar sets of a list share one more word: the longest lists are split by it.
        again = _keys(rows, frequent, threshold, shingle).join(longest.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]).select("node", F.explode("keys").alias("second"))
        finer = longest.join(again, "node").where("second != key").select(F.xxhash64(F.least("key", "second"), F.greatest("key", "second")).alias("key"), "node").distinct()
        compared = compared.unionByName(live(_met(cut(finer.select("key", "node"))).select("key", "node"), links))
    compared = cut(compared)
    if compared.isEmpty():
        return links
    links = cut(links.unionByName(_similar(cut(_cells(compared, sketches, threshold, forest=True).distinct()), rows, threshold, shingle)))
    # What the sets themselves hold apart, or a pair that failed: all pairs of what is left.
    compared = live(compared.select("key", "node"), links)
    if compared.isEmpty():
        return links
    return cut(links.unionByName(_similar(cut(_cells(compared, sketches, threshold, forest=False).distinct()), rows, threshold, shingle)))


def near_join(docs: DataFrame, *, threshold: tuple[int, int] = THRESHOLD, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_shingles, component_id).

    A-Z count as lower case, words are runs of anything but ASCII white space;
    a row's set has its distinct shingles, or all its words as one where they
    are fewer.  Rows link at Jaccard ``threshold`` or more; ``component_id`` is
    the smallest id that links lead to, itself included.  Texts without a word,
    null ones too, have an empty set and are linked with nothing.  Repeated
    rows have equal sets and so are linked; a null id is a component's only
    where there is no other; an empty table gives an empty result; further
    columns are ignored.  Shingles are told apart by 64-bit hashes.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    marked = cut(_marked(rows, shingle))
    frequent = _frequent(marked)
    marked = marked.where("n >= 0")
    links = similar_sets(rows, marked, cut(_keys(rows, frequent, threshold, shingle)), frequent, threshold=threshold, shingle=shingle)
    roots = components(links)
    classes = marked.where("n > 0").groupBy("sig", "sig2").agg(F.min("id").alias("first_id")).withColumn("node", F.struct("sig", "sig2"))
    placed = cut(classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    known = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = placed.join(known, "root").select("sig", "sig2", "component_id")
    full = marked.where("n > 0").select("id", "n", "sig", "sig2").join(found, ["sig", "sig2"]).select("id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(marked.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
