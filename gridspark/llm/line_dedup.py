"""Line dedup by an exact set-similarity join.

Lines are sets of words.  Words are ordered by rarity; two sets of Jaccard
similarity t or more share a word among their first (rarest) few, so only lines
that meet in such a prefix are compared, and of those only pairs whose sizes
and prefix positions leave enough overlap.  What remains is verified on the
whole sets, and of two matching lines the later one goes.

Every occurrence of the same set of words is one class, so a line that a third
of all documents share is one entry of the join.  A line is dropped once one
earlier match is verified: round one tries each line's earliest candidates, and
only lines that this leaves open meet all of theirs in round two.

A word that very many lines have in their prefix has its list split into
blocks.  Round one looks inside blocks; the lines that are left then meet the
other blocks in cells of one block each, so that no task holds a whole list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import as_row, cut, filter_bits, quoted

#: Similarity at which lines match, as a fraction: exact in integers.
THRESHOLD = (4, 5)

#: Buckets of the word counts: a table of this size whatever the input.  All words are counted; a bucket's count
#: bounds the counts of its words.
COUNT_BUCKETS = 1 << 20
_BLOCK = 1 << 12

#: The most bits that a filter, which is sized by its rows, may have as a bitmap (32 MB) and as a joined table (2**20 rows).
#: Beyond, texts are joined with their wanted lines, and all rows meet.
MOST_BITS = 1 << 28
MOST_JOINED_BITS = 1 << 26

#: Bytes of text worked on at once, postings read at once, pairs compared at once, and rows of a posting list from
#: which lines look for partners in the order of places, which ends at the first one found.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 1 << 16
SLICE_PAIRS = 1 << 20
SHORT_LIST = 1 << 11

#: Lines from which a posting list is split, and about the lines of one of its blocks: what a task holds on average,
#: between these bounds.
LEAST_SPLIT = 1 << 9
SPLIT = 1 << 16

#: What a posting is in the task that reads it: a later line that looks for earlier ones, an earlier line, or both.
LATER, EARLIER = 1, 2

#: Sizes from which a line's parity is 2, 4, 8 and 16 words of 64 bits wide: about as many bits as words,
#: since with fewer the parities of unlike lines differ in no more bits than those of lines that match.
WIDER_FROM = (48, 112, 256, 512)

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], np.uint64)


def _rank(counts: np.ndarray) -> np.ndarray:
    """Counts in 255 steps of a logarithm: small ones are told apart exactly."""
    return np.minimum(255, np.round(8 * np.log2(counts + 1))).astype(np.uint8)


def _mixed(x: np.ndarray, k: int = 0) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[k]
    return (x ^ (x >> np.uint64(29))) * _MIX[1 - k]


class _Text:
    """Some texts as one array of bytes: ``ends[i]`` is where text i ends; ``number`` is the line number that each starts with."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, ends: np.ndarray, number: int = 0) -> None:
        self.ids, self.raw, self.ends, self.number = ids, raw, ends, number
        self.begins = np.concatenate([[0], ends[:-1]])

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(starts, lengths) of runs of anything but white space; none goes on into the next text."""
        space = np.concatenate([_SPACE[self.raw], [True]])
        after = np.concatenate([[True], space[:-1]])
        after[self.begins[self.begins < len(self.raw)]] = True
        starts = np.flatnonzero(after[:-1] & ~space[:-1])
        before = space[1:].copy()
        before[self.ends[self.ends > 0] - 1] = True
        return starts, np.flatnonzero(before & ~space[:-1]) + 1 - starts

    def hashes(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A 64-bit hash of every word, eight bytes at a time."""
        padded = np.concatenate([self.raw, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.raw) + 1, "<u8", padded, strides=(1,))
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

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, line number, start) of every line."""
        starts = np.concatenate([np.flatnonzero(self.raw == 10) + 1, self.begins])
        order = np.argsort(starts, kind="stable")  # of equal places a line feed's comes first
        heads = np.flatnonzero(order >= len(starts) - len(self.begins))
        text = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
        return self.ids[text], (np.arange(len(order)) - heads[text] + self.number).astype(np.int32), starts[order]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Text, pa.RecordBatch]]:
    """Texts (null ones empty) in slices of about SLICE_BYTES, with the rows they come from; a longer text is cut at line feeds."""
    for batch in batches:
        column = pc.fill_null(batch.column(1), "")
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw, ids = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), batch.column(0).to_numpy()
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, side="right")) - 1)
            low, high, rows = ends[at], ends[to], batch.slice(at, to - at)
            if high - low <= SLICE_BYTES:
                yield _Text(ids[at:to], raw[low:high], ends[at + 1 : to + 1] - low), rows
            else:
                feeds = np.concatenate([low + np.flatnonzero(raw[low:high] == 10) + 1, [high]])
                done = 0
                while done < len(feeds):
                    last = max(done, int(np.searchsorted(feeds, low + SLICE_BYTES, side="right")) - 1)
                    stop = feeds[last]
                    # The line feed at the end of a part is left out, or the part would have one more, empty line.
                    part = raw[low : stop - (last < len(feeds) - 1)]
                    yield _Text(ids[at:to], part, np.array([len(part)]), done), rows
                    low, done = stop, last + 1
            at = to


def word_ranks(docs: DataFrame) -> np.ndarray:
    """Ranks by count of all words, by hash bucket: a table of fixed size, a byte a bucket.

    Tasks hand on what they counted in blocks of buckets, which are summed on
    the executors; the driver gets the ranks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNT_BUCKETS, np.uint32)
        for text, _ in _texts(batches):
            np.add.at(total, (text.hashes(*text.words()) & np.uint64(COUNT_BUCKETS - 1)).astype(np.int64), np.uint32(1))
        for block, n in enumerate(total.reshape(-1, _BLOCK)):
            if len(some := np.flatnonzero(n)):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([some.astype("<u2").tobytes()]), pa.array([n[some].astype(np.int64).tobytes()])], names=["block", "at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total.setdefault(block, np.zeros(_BLOCK, np.int64))[np.frombuffer(at, "<u2")] += np.frombuffer(n, np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([_rank(n).tobytes() for n in total.values()])], names=["block", "ranks"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.mapInArrow(count, "block int, at binary, n binary").repartition(parts, "block")
    out = np.zeros((COUNT_BUCKETS // _BLOCK, _BLOCK), np.uint8)
    for row in dealt.mapInArrow(add, "block int, ranks binary").collect():
        out[row.block] = np.frombuffer(row.ranks, np.uint8)
    return out.ravel()


class _Sets:
    """Each line's distinct words as keys in the order of rarity: ``keys``, ``owner`` (the line, per key), ``starts`` and ``sizes`` per line.

    ``used`` tells which lines have words: only those count.  ``sums`` identify
    the set; ``parity`` is its parity in 64 bits: bit h is set if an odd number
    of words hash to h.  Parities of two sets differ in at most as many bits as
    the sets differ in words.
    """

    def __init__(self, text: _Text, lines: np.ndarray, rarity: np.ndarray) -> None:
        starts, lengths = text.words()
        hashes = text.hashes(starts, lengths)
        per_line = np.diff(np.append(np.searchsorted(starts, lines), len(starts)))
        self.used = np.flatnonzero(per_line)
        owner = np.repeat(np.arange(len(self.used)), per_line[self.used])
        rank = rarity[(hashes & np.uint64(len(rarity) - 1)).astype(np.int64)].astype(np.uint64)
        keys = rank << np.uint64(56) | hashes >> np.uint64(8)  # rarer first, then by hash
        bits = np.uint64(max(1, len(self.used).bit_length()))
        both = owner.astype(np.uint64) << (np.uint64(64) - bits) | keys >> bits
        order = np.argsort(both)
        both, ordered = both[order], keys[order]
        if ((both[1:] == both[:-1]) & (ordered[1:] != ordered[:-1])).any():  # bits that were left out matter
            ordered = keys[np.lexsort((keys, owner))]
        new = np.ones(len(ordered), bool)
        new[1:] = (ordered[1:] != ordered[:-1]) | (owner[1:] != owner[:-1])
        self.keys, self.owner = ordered[new], owner[new]
        self.sizes = np.bincount(self.owner, minlength=len(self.used))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.mixed = _mixed(self.keys)
        self.sums = [np.add.reduceat(x, self.starts).view(np.int64) for x in (self.mixed, _mixed(self.keys, 1))] if len(self.used) else [np.zeros(0, np.int64)] * 2
        bit = np.uint64(1) << (self.mixed >> np.uint64(58))
        self.parity = (np.bitwise_xor.reduceat(bit, self.starts) if len(self.used) else bit).view(np.int64)

    def marks(self) -> pa.Array:
        """Each line's parity in as many bits as its size asks for; its 64-bit words, combined by xor, give ``parity``."""
        width = 1 << np.searchsorted(WIDER_FROM, self.sizes, side="right")
        ends = np.concatenate([[0], np.cumsum(width)])
        out = np.zeros(ends[-1], np.uint64)
        out[ends[:-1][width == 1]] = self.parity.view(np.uint64)[width == 1]
        wide = width[self.owner] > 1
        owner, mixed = self.owner[wide], self.mixed[wide]
        word = (mixed >> np.uint64(48)).astype(np.int64) & (width - 1)[owner]
        np.bitwise_xor.at(out, ends[owner] + word, np.uint64(1) << (mixed >> np.uint64(58)))
        return pa.Array.from_buffers(pa.binary(), len(self.sizes), [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(out)])


def prefix_length(size: Column | np.ndarray, threshold: tuple[int, int] = THRESHOLD):
    num, den = threshold
    return size - (num * size + den - 1) // den + 1


def lines_of(docs: DataFrame, rarity, threshold: tuple[int, int]) -> DataFrame:
    """(id, line, sig, sig2, parity, n, marks, prefix) of every line that has a word."""
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, _ in _texts(batches):
            ids, numbers, at = text.lines()
            sets = _Sets(text, at, rarity.value)
            if not len(sets.used):
                continue
            length = prefix_length(sets.sizes, threshold)
            # Too small to match any other set: equal sets are one class already.
            length[(den * sets.sizes < num * (sets.sizes + 1)) & ((num + den) * (sets.sizes - 1) < 2 * num * sets.sizes)] = 0
            taken = np.arange(len(sets.keys)) - sets.starts[sets.owner] < length[sets.owner]
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(sets.keys[taken].view(np.int64)))
            columns = [pa.array(ids[sets.used], type=pa.int64()), pa.array(numbers[sets.used]), *map(pa.array, (*sets.sums, sets.parity, sets.sizes.astype(np.int32))), sets.marks(), prefix]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "line", "sig", "sig2", "parity", "n", "marks", "prefix"])

    return docs.mapInArrow(run, "id long, line int, sig long, sig2 long, parity long, n int, marks binary, prefix array<long>")


def _word(h: Column, bits: int) -> Column:
    return F.shiftright(F.pmod(h, F.lit(bits)), 6)


def _bit(h: Column, bits: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (F.pmod(h, F.lit(bits)) % 64).cast("int"))


def _filter(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """(word, bits): a filter over a column, at most bits / 64 rows whatever its input."""
    return rows.groupBy(_word(F.col(column), bits).alias("word")).agg(F.bit_or(_bit(F.col(column), bits)).alias("bits"))


def _marked(rows: DataFrame, column: str, known: DataFrame, count: int) -> DataFrame:
    """``rows`` with ``known``: whether a filter over ``known`` has the column's value; true for all where the filter would be too large."""
    bits = filter_bits(count, MOST_JOINED_BITS)
    if bits is None:
        return rows.withColumn("known", F.lit(True))
    joined = rows.withColumn("word", _word(F.col(column), bits)).join(F.broadcast(_filter(known, column, bits)), "word", "left")
    return joined.withColumn("known", F.coalesce(F.col("bits").bitwiseAND(_bit(F.col(column), bits)) != 0, F.lit(False))).drop("word", "bits")


def _bitmap(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """The same filter as an array of bits / 8 bytes."""
    words = _filter(rows, column, bits).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def _in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & (64 * len(bits) - 1)
    return bits[slot >> 6] >> (slot & 63) & 1 == 1


def _place_hash(i, number):
    """Hash of (id, line): the same for columns and arrays."""
    return (F.pmod(i, F.lit(1 << 40)) if isinstance(i, Column) else i % (1 << 40)) * 1_000_003 + number


def _words(marks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words per row, words) of wide parities."""
    _, offsets, data = marks.buffers()
    ends = np.frombuffer(offsets, np.int32)[marks.offset : marks.offset + len(marks) + 1].astype(np.int64) // 8
    words = np.frombuffer(data, np.uint64, ends[-1])[ends[0] :] if len(marks) else np.zeros(0, np.uint64)
    return ends[:-1] - ends[0], np.diff(ends), words


class _Postings:
    """Postings of whole lists: ``key``, ``id``, ``line``, ``parity``, size ``n``, words from their place on ``rest``, roles, wide parities."""

    def __init__(self, rows: pa.RecordBatch, threshold: tuple[int, int]) -> None:
        self.num, self.den = threshold
        self.key, self.id, self.line = (rows.column(k).to_numpy() for k in (0, 1, 2))
        self.base, self.width, self.words = _words(rows.column(3))
        self.parity = np.bitwise_xor.reduceat(self.words, self.base) if len(self.base) else self.words
        packed = rows.column(4).to_numpy()
        self.n = packed >> 33
        self.rest = self.n - (packed >> 2 & 0x7FFFFFFF)
        self.later, self.early = packed & LATER != 0, packed & EARLIER != 0

    def room(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words two sets that match may differ in."""
        return self.n[a] + self.n[b] - 2 * -(-self.num * (self.n[a] + self.n[b]) // (self.num + self.den))

    def folded(self, i: np.ndarray, to: int) -> np.ndarray:
        out = self.words[self.base[i][:, None] + np.arange(to)]
        for k in range(1, int(self.width[i].max()) // to):
            more = self.width[i] > k * to
            out[more] ^= self.words[self.base[i[more]][:, None] + k * to + np.arange(to)]
        return out

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of unlike lines have parities, in all their bits, that differ in few enough."""
        good = np.bitwise_count(self.parity[a] ^ self.parity[b]) <= self.room(a, b)
        # A line that is both earlier and later may be there twice.
        good[good] = (self.id[a[good]] != self.id[b[good]]) | (self.line[a[good]] != self.line[b[good]]) | (self.parity[a[good]] != self.parity[b[good]])
        both = np.minimum(self.width[a], self.width[b])
        for to in np.unique(both[good & (both > 1)]):
            at = np.flatnonzero(good & (both == to))
            for lo in range(0, len(at), 1 << 16):
                x, y = a[at[lo : lo + (1 << 16)]], b[at[lo : lo + (1 << 16)]]
                good[at[lo : lo + (1 << 16)]] = np.bitwise_count(self.folded(x, to) ^ self.folded(y, to)).sum(axis=1, dtype=np.int64) <= self.room(x, y)
        return good

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a comes first by id, line, parity."""
        same_id, same_line = self.id[a] == self.id[b], self.line[a] == self.line[b]
        return (self.id[a] < self.id[b]) | same_id & ((self.line[a] < self.line[b]) | same_line & (self.parity[a] < self.parity[b]))

    def by_size(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All candidates (earlier, later) of some lists: with a list in the order of size, each row meets those before it that are long enough."""
        order = rows[np.lexsort((self.n[rows], self.key[rows]))]
        key, n, rest = self.key[order], self.n[order], self.rest[order]
        which = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) << 32
        low = np.searchsorted(which + n, which - (-self.num * n // self.den))
        count = np.arange(len(order)) - low
        total = np.concatenate([[0], np.cumsum(count)])
        at = 0
        while at < len(order):
            to = max(at + 1, int(np.searchsorted(total, total[at] + SLICE_PAIRS, side="right")) - 1)
            j = np.repeat(np.arange(at, to), count[at:to])
            i = np.arange(len(j)) - np.repeat(total[at:to] - total[at] - low[at:to], count[at:to])
            fits = (self.num + self.den) * np.minimum(rest[i], rest[j]) >= self.num * (n[i] + n[j])
            a, b = order[i[fits]], order[j[fits]]
            good = self.alike(a, b)
            a, b = a[good], b[good]
            first = self.before(a, b)
            a, b = np.where(first, a, b), np.where(first, b, a)
            good = self.early[a] & self.later[b]
            yield a[good], b[good]
            at = to

    def by_place(self, rows: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(earlier, later, whether there may be more) of one list: all candidates, or each line's earliest, read from the list's start."""
        rows = rows[np.lexsort((self.parity[rows], self.line[rows], self.id[rows]))]
        early, open_ = np.flatnonzero(self.early[rows]), np.flatnonzero(self.later[rows])
        out: list[tuple[np.ndarray, ...]] = []
        from_, width = 0, SHORT_LIST
        while from_ < len(early) and len(open_):
            part = early[from_ : from_ + width]
            from_ += len(part)
            open_ = open_[open_ > part[0]]
            step, left = max(1, SLICE_PAIRS // len(part)), []
            for at in range(0, len(open_), step):
                b = open_[at : at + step]
                n_a, n_b, rest_a, rest_b = self.n[rows[part]], self.n[rows[b]][:, None], self.rest[rows[part]], self.rest[rows[b]][:, None]
                good = (self.den * np.minimum(n_a, n_b) >= self.num * np.maximum(n_a, n_b)) & ((self.num + self.den) * np.minimum(rest_a, rest_b) >= self.num * (n_a + n_b)) & (part < b[:, None])
                x, y = np.nonzero(good)
                good[x, y] = self.alike(rows[part[y]], rows[b[x]])
                if every:
                    x, y = np.nonzero(good)
                    out.append((rows[part[y]], rows[b[x]], np.zeros(len(x), bool)))
                    left.append(b)
                    continue
                any_ = good.any(axis=1)
                more = (good[any_].sum(axis=1) > 1) | (early[from_] < b[any_] if from_ < len(early) else False)
                out.append((rows[part[good[any_].argmax(axis=1)]], rows[b[any_]], more))
                left.append(b[~any_])
            open_, width = np.concatenate([*left, open_[:0]]), min(2 * width, 1 << 12)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (rows[:0], rows[:0], np.zeros(0, bool))

    def earliest(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The earliest candidate of each later line in each list, and whether it has more."""
        order = np.lexsort((self.parity[a], self.line[a], self.id[a], b))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])[: len(b)])
        return a[first], b[first], np.diff(np.append(first, len(b))) > 1


def _pairs(threshold: tuple[int, int], every: bool):
    """Reads postings sorted by key and yields candidate pairs, the earlier line (by id, line, parity) first.

    Round one (``every`` false): each line's earliest candidate of the list,
    with ``more`` set if it may have others.  Round two: all candidates of open
    lines.
    """

    def found(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key = rows.column(0).to_numpy()
        size = np.diff(np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]))
        several = np.repeat(size > 1, size)
        if not several.any():
            return
        size = size[size > 1]
        all_, kept = _Postings(rows.filter(pa.array(several)), threshold), []
        short = np.repeat(size <= SHORT_LIST, size)
        if short.any():
            a, b = (np.concatenate(x) for x in zip(*all_.by_size(np.flatnonzero(short)), strict=True))
            kept.append((a, b, np.zeros(len(a), bool)) if every else all_.earliest(a, b))
        starts = np.cumsum(size) - size
        kept += [all_.by_place(np.arange(at, at + m), every) for at, m in zip(starts[size > SHORT_LIST], size[size > SHORT_LIST], strict=True)]
        for a, b, more in kept:
            for lo in range(0, len(a), 1 << 16):
                x, y = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
                sides = [pa.array(c[i]) for i in (x, y) for c in (all_.id, all_.line, all_.parity.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*sides, pa.array(more[lo : lo + (1 << 16)])], names=["id_a", "line_a", "parity_a", "id_b", "line_b", "parity_b", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last list may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            key = batch.column(0).to_numpy()
            new = np.flatnonzero(key != key[-1])
            if sum(map(len, held)) < SLICE_ROWS or (not len(new) and held[0].column(0)[0].as_py() == key[-1]):
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = rows.column(0).to_numpy()
            new = np.flatnonzero(key != key[-1])
            if len(new):
                yield from found(rows.slice(0, new[-1] + 1))
                rows = rows.slice(new[-1] + 1)
            held = [rows]
        if held:
            yield from found(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _heavy(postings: DataFrame, count: Column, threshold: tuple[int, int], most_rows: int) -> DataFrame:
    """(key, n, blocks, most) of the words whose lists are split, by size of set.

    ``most`` is the last prefix place from which a line of that size can match
    another of the list, by the sizes and places that the list has; -1 if none.
    """
    num, den = threshold
    # A key starts with the rank of its word's count, which no list of it exceeds.
    least = int(_rank(np.array([most_rows]))[0]) - 1
    common = postings.where(F.shiftrightunsigned("key", 56) >= least)
    large = cut(common.groupBy("key").agg(count.alias("rows")).where(F.col("rows") > most_rows))
    if large.isEmpty():
        return large.select("key", F.lit(0).alias("n"), F.lit(0).cast("long").alias("blocks"), F.lit(0).alias("most"))
    sizes = cut(common.join(large, "key").groupBy("key", "n").agg(F.min("p").alias("p"), F.ceil(F.max("rows") / most_rows).alias("blocks")))
    other = sizes.select("key", F.col("n").alias("m"), F.col("p").alias("q"))
    need = F.ceil(num * (F.col("n") + F.col("m")) / (num + den))
    meets = (den * F.least("n", "m") >= num * F.greatest("n", "m")) & (F.col("m") - F.col("q") >= need)
    return cut(sizes.join(other, "key").groupBy("key", "n", "blocks").agg(F.coalesce(F.max(F.when(meets, F.col("n") - need)), F.lit(-1)).cast("int").alias("most")))


def _block(blocks: Column, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "id", "line", "parity"), blocks)


def _cell(*parts: Column) -> Column:
    """The key of a part of a list: a hash, as what meets by accident is verified like all else."""
    return F.xxhash64("key", *parts).alias("key")


_POSTING = ["id", "line", "parity", "marks", "n", "p"]


def _parted(postings: DataFrame, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of lists that stay whole, and those of split ones (with blocks) that can match anything."""
    joined = postings.join(heavy, ["key", "n"], "left")
    return joined.where("blocks IS NULL").select(postings.columns), joined.where("p <= most").drop("most")


def _cells(split: DataFrame, most_rows: int) -> DataFrame:
    """Postings of split lists, those that are open against all: each cell has one block of all and one of the open ones."""
    opened = split.where("open").groupBy("key").agg(F.ceil(F.count("*") / most_rows).alias("groups"))
    sized = split.join(opened, "key")
    first, until = F.lit(0).cast("long"), lambda c: F.col(c) - 1
    early = sized.withColumn("g", F.explode(F.sequence(first, until("groups")))).select(_cell(_block(F.col("blocks")), F.col("g")), *_POSTING, F.lit(EARLIER).cast("byte").alias("open"))
    late = sized.where("open").withColumn("b", F.explode(F.sequence(first, until("blocks")))).select(_cell(F.col("b"), _block(F.col("groups"), 1)), *_POSTING, F.lit(LATER).cast("byte").alias("open"))
    return early.unionByName(late)


def _whole(postings: DataFrame) -> DataFrame:
    return postings.withColumn("open", F.when(F.col("open"), F.lit(EARLIER + LATER)).otherwise(F.lit(EARLIER)).cast("byte"))


def _candidates(postings: DataFrame, threshold: tuple[int, int], every: bool) -> DataFrame:
    """Candidate pairs of postings whose ``open`` says what they are: EARLIER, LATER or both."""
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Size, place and role in one number: n has at most 30 bits, p fewer.
    packed = F.shiftleft(F.col("n").cast("long"), 33) + F.shiftleft(F.col("p").cast("long"), 2) + F.col("open")
    # Sorted by the key alone, which Spark sorts by its bytes; the rest of the order is made list by list.
    dealt = postings.select("key", "id", "line", "marks", packed.alias("packed")).repartition(parts, "key").sortWithinPartitions("key")
    pairs = dealt.mapInArrow(_pairs(threshold, every), "id_a long, line_a int, parity_a long, id_b long, line_b int, parity_b long, more boolean")
    return cut(pairs.groupBy("id_a", "line_a", "parity_a", "id_b", "line_b", "parity_b").agg(F.max("more").alias("more")))


def _verified(pairs: DataFrame, docs: DataFrame, rarity, threshold: tuple[int, int]) -> DataFrame:
    """(id, line, parity) of the later lines of pairs whose whole sets of words are similar enough."""
    num, den = threshold
    sides = pairs.select(F.col("id_a").alias("id"), F.col("line_a").alias("line")).unionByName(pairs.select(F.col("id_b").alias("id"), F.col("line_b").alias("line")))
    bits = filter_bits(2 * pairs.count(), MOST_BITS)
    if bits is None:
        docs = docs.join(sides.groupBy("id").agg(F.collect_set("line").alias("lines")), "id")
        shared = None
    else:
        shared = pairs.sparkSession.sparkContext.broadcast(_bitmap(sides.select(_place_hash(F.col("id"), F.col("line")).alias("h")), "h", bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, rows in _texts(batches):
            ids, numbers, starts = text.lines()
            if shared is not None:
                wanted = np.flatnonzero(_in_bitmap(shared.value, _place_hash(ids, numbers)))
            else:
                asked = {(i, n) for i, some in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), strict=True) for n in some}
                wanted = np.flatnonzero([x in asked for x in zip(ids.tolist(), numbers.tolist(), strict=True)])
            if not len(wanted):
                continue
            stops = np.append(starts[1:], len(text.raw))[wanted]
            written = [text.raw[a:b].tobytes() for a, b in zip(starts[wanted], stops, strict=True)]
            ends = np.cumsum([len(x) for x in written])
            sets = _Sets(_Text(ids[wanted], np.frombuffer(b"".join(written), np.uint8), ends), np.concatenate([[0], ends[:-1]]), rarity.value)
            words = pa.array([list(set(written[i].split())) for i in sets.used], pa.list_(pa.binary())).cast(pa.list_(pa.string()))
            used = wanted[sets.used]
            yield pa.RecordBatch.from_arrays([pa.array(ids[used], type=pa.int64()), pa.array(numbers[used]), pa.array(sets.parity), words], names=["id", "line", "parity", "words"])

    lines = cut(docs.mapInArrow(run, "id long, line int, parity long, words array<string>"))
    side = lambda x: lines.select(F.col("id").alias(f"id_{x}"), F.col("line").alias(f"line_{x}"), F.col("parity").alias(f"parity_{x}"), F.col("words").alias(f"words_{x}"))
    joined = pairs.join(side("b"), ["id_b", "line_b", "parity_b"]).join(side("a"), ["id_a", "line_a", "parity_a"])
    common = F.size(F.array_intersect("words_a", "words_b"))
    alike = (num + den) * common >= num * (F.size("words_a") + F.size("words_b"))
    return cut(joined.where(alike).select(F.col("id_b").alias("id"), F.col("line_b").alias("line"), F.col("parity_b").alias("parity")).distinct())


def removed_lines(docs: DataFrame, *, threshold: tuple[int, int] = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, first_id, first_line, removed) for every line with a word.

    A line is removed if an earlier one (by id, then line number) has a word
    set of Jaccard similarity ``threshold`` or more, whether or not that one
    stays.  ``first_id`` and ``first_line`` are where its set first occurs.
    """
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} must be a whole number")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spark = rows.sparkSession
    rarity = spark.sparkContext.broadcast(word_ranks(rows))
    lines = cut(lines_of(rows, rarity, threshold))
    # Sets that occur more than once meet to find their first occurrence; the others stay where they are.
    shared = cut(lines.groupBy("sig", "sig2").agg(F.count("*").alias("n")).where("n > 1").select("sig"))
    marked = _marked(lines, "sig", shared, shared.count())
    columns = ["sig", "sig2", "id", "line", "parity", "n", "marks", "prefix"]
    met = cut(marked.where("known").groupBy("sig", "sig2").agg(F.min(F.struct("id", "line")).alias("at"), *[F.first(c).alias(c) for c in columns[4:]]))
    classes = marked.where("not known").select(columns).unionByName(met.select("sig", "sig2", "at.*", *columns[4:]))
    place = ["id", "line", "parity"]
    opened = classes.select(*place, "n", "marks", F.posexplode("prefix").alias("p", "key"), F.lit(True).alias("open"))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most_rows = min(SPLIT, max(LEAST_SPLIT, (lines.agg(F.sum(F.size("prefix"))).first()[0] or 0) // parts))
    heavy = _heavy(lines.select("sig", "n", F.posexplode("prefix").alias("p", "key")), F.approx_count_distinct("sig"), threshold, most_rows)
    split = not heavy.isEmpty()
    if split:
        whole, apart = _parted(opened, heavy)
        blocks = apart.select(_cell(_block(F.col("blocks"))), *_POSTING, "open")
        tried = _candidates(_whole(whole.unionByName(blocks)), threshold, every=False)
    else:
        tried = _candidates(_whole(opened), threshold, every=False)
    gone = _verified(tried, rows, rarity, threshold)
    if split:
        # What has no match in its own block, against the other blocks.
        apart = cut(apart.drop("open").join(gone.withColumn("gone", F.lit(True)), place, "left").withColumn("open", F.col("gone").isNull()).drop("gone"))
        across = _candidates(_cells(apart, most_rows), threshold, every=False)
        gone = gone.unionByName(_verified(across, rows, rarity, threshold)).distinct()
        tried = tried.unionByName(across)
    later = [F.col(f"{c}_b").alias(c) for c in place]
    open_ = tried.groupBy(*later).agg(F.max("more").alias("more")).where("more").drop("more")
    open_ = cut(open_.join(gone, place, "left_anti"))
    left = open_.count()
    if left:
        is_open = classes.join(open_.withColumn("open", F.lit(True)), place, "left").withColumn("open", F.coalesce("open", F.lit(False)))
        keyed = is_open.select(*place, "n", "marks", F.posexplode("prefix").alias("p", "key"), "open")
        near = cut(_marked(keyed, "key", keyed.where("open"), 16 * left).where("known").select("key", *_POSTING, "open"))
        # Fewer postings than before: what is a long list among them may not have been one.
        most_rows = min(SPLIT, max(LEAST_SPLIT, near.count() // parts))
        heavy = _heavy(near, F.count("*"), threshold, most_rows)
        if not heavy.isEmpty():
            whole, apart = _parted(near, heavy)
            met_all = _whole(whole).select("key", *_POSTING, "open").unionByName(_cells(cut(apart), most_rows))
        else:
            met_all = _whole(near)
        second = _candidates(met_all, threshold, every=True)
        gone = gone.unionByName(_verified(second, rows, rarity, threshold)).distinct()
    gone = cut(gone.withColumn("late", F.lit(True)))
    late = F.coalesce("late", F.lit(False))
    # A set that occurs once has no earlier occurrence: only the others look for theirs.
    once = marked.where("not known").join(gone, place, "left").select("id", "line", F.col("id").alias("first_id"), F.col("line").alias("first_line"), late.alias("removed"))
    firsts = met.select("sig", "sig2", "at.*", "parity").join(gone, place, "left").select("sig", "sig2", F.col("id").alias("first_id"), F.col("line").alias("first_line"), late.alias("late"))
    again = (F.col("id") != F.col("first_id")) | (F.col("line") != F.col("first_line"))
    repeats = marked.where("known").select("id", "line", "sig", "sig2").join(firsts, ["sig", "sig2"])
    return once.unionByName(repeats.select("id", "line", "first_id", "first_line", (F.col("late") | again).alias("removed")))


def line_dedup(docs: DataFrame, *, threshold: tuple[int, int] = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_lines, n_removed, removed), the last an array of line numbers from 0.

    Lines end at line feeds; words are runs of anything but ASCII white space,
    as they stand.  Ids are whole numbers; others raise a ValueError.  Lines without a word stay.  Null texts are empty; rows with
    a null id lose no line and are no match for others; rows that repeat an id
    share their line numbers, the first of equal lines staying in each.  An
    empty table gives an empty result; further columns are ignored.
    """
    found = removed_lines(docs, threshold=threshold, id_col=id_col, text_col=text_col)
    per_doc = found.where("removed").groupBy("id").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    return rows.join(per_doc, "id", "left").select("id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def without_lines(docs: DataFrame, *, threshold: tuple[int, int] = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, columns unchanged, with the removed lines cut out of the texts."""
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), as_row(docs).alias("row"))
    per_doc = removed_lines(rows, threshold=threshold, id_col="id", text_col="text").where("removed").groupBy("id").agg(F.collect_set("line").alias("lines"))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("lines", i)), "\n")
    text = F.when(F.col("lines").isNull(), F.col("text")).otherwise(kept)
    joined = rows.join(per_doc, "id", "left").withColumn("text", text)
    return joined.select(*[(F.col("text") if c == text_col else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)])
