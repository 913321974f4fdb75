"""Language identification by interpolated Kneser-Ney character models.

One model a language, of character 4-grams over lower-cased letters with one
boundary character for whatever lies between words.  The n-grams of all
languages are kept as sorted arrays of hashes with a row of log-probabilities;
a text gets the language of the lowest cross-entropy per character, or is
rejected where even that exceeds what held-back texts of the language show.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import smallest_digests

ORDER = 4
BOUNDARY = 32

#: Rows learned from, per language: the bound of the training sample.  A fifth
#: of them is held back from the counts, for calibration.
ROWS_PER_LANGUAGE = 600

#: Standard deviations from the mean cross-entropy of its language, by length, within which a text is accepted in any case.
DEVIATIONS = 6

#: Characters of text worked on at once; a longer text is read in such slices.
SLICE_CHARS = 1 << 20

_ALPHABET = 2000  # characters that the lowest order shares its rest among
_PRIME = np.uint64(0x100000001B3)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


def windows(text: str) -> Iterator[np.ndarray]:
    """Each character with the ORDER - 1 before it, in slices of a long text that go on where the last one ended.

    Characters are the lower-cased letters; a run of others is one boundary,
    none at the start.  A text without letters has none.
    """
    lowered = text.lower()
    before, after_letter = np.full(ORDER - 1, BOUNDARY, np.uint32), False
    for at in range(0, len(lowered), SLICE_CHARS):
        points = np.frombuffer(lowered[at : at + SLICE_CHARS].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[points]
        keep = letter | np.concatenate([[after_letter], letter[:-1]])
        points, after_letter = np.where(letter, points, BOUNDARY)[keep].astype(np.uint32), letter[-1]
        if len(points):
            whole = np.concatenate([before, points])
            before = whole[len(whole) - ORDER + 1 :]
            yield np.lib.stride_tricks.sliding_window_view(whole, ORDER)


def _hash(grams: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every row of code points."""
    out = np.full(len(grams), 1469598103934665603, dtype=np.uint64)
    for k in range(grams.shape[1]):
        out = (out ^ grams[:, k].astype(np.uint64)) * _PRIME
        out ^= out >> np.uint64(29)
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


class _OneLanguage:
    """Counts and discounts of one language, per order: highest by occurrences, lower ones by distinct left neighbours."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.level: dict[int, tuple] = {}
        self.grams: dict[int, np.ndarray] = {}
        for n in range(ORDER, 0, -1):
            self.grams[n] = grams
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
            keys, context = _hash(grams), _hash(grams[:, :-1])
            order = np.argsort(keys)
            contexts, place = np.unique(context, return_inverse=True)
            total = np.bincount(place, weights=counts)
            rest = discount * np.bincount(place) / total
            self.level[n] = (keys[order], (np.maximum(counts - discount, 0) / total[place])[order], contexts, rest)
            _, first, types = np.unique(_hash(grams[:, 1:]), return_index=True, return_counts=True)
            grams, counts = grams[first, 1:], types

    def probability(self, grams: np.ndarray) -> np.ndarray:
        n = grams.shape[1]
        if n == 0:
            return np.full(len(grams), 1 / _ALPHABET)
        keys, share, _, _ = self.level[n]
        at, seen = _find(keys, _hash(grams))
        return np.where(seen, share[at], 0) + self.rest(grams[:, :-1]) * self.probability(grams[:, 1:])

    def rest(self, contexts: np.ndarray) -> np.ndarray:
        """What an order leaves to the next lower one; all of it after an unseen context."""
        _, _, keys, rest = self.level[contexts.shape[1] + 1]
        at, seen = _find(keys, _hash(contexts))
        return np.where(seen, rest[at], 1.0)


@dataclass
class Model:
    """languages; per order, sorted hashes of n-grams with a row of log-probabilities each, and sorted hashes of contexts with log rests."""

    languages: list[str]
    grams: dict[int, tuple[np.ndarray, np.ndarray]]
    rests: dict[int, tuple[np.ndarray, np.ndarray]]
    floor: np.ndarray
    limit: np.ndarray | None = None
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    sharpness: float = 1.0

    @classmethod
    def fit(cls, counted: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
        languages = sorted(counted)
        each = [_OneLanguage(*counted[x]) for x in languages]
        grams, rests = {}, {}
        for n in range(1, ORDER + 1):
            every = np.concatenate([m.grams[n] for m in each])
            keys, first = np.unique(_hash(every), return_index=True)
            grams[n] = keys, np.log(np.stack([m.probability(every[first]) for m in each], axis=1)).astype(np.float32)
            keys, first = np.unique(_hash(every[:, :-1]), return_index=True)
            rests[n] = keys, np.log(np.stack([m.rest(every[first, :-1]) for m in each], axis=1)).astype(np.float32)
        return cls(languages, grams, rests, np.full(len(languages), -np.log(_ALPHABET), np.float32))

    def log_probability(self, windows: np.ndarray) -> np.ndarray:
        """Rows of log-probabilities by language; n-grams no language has seen fall back to lower orders."""
        out = np.empty((len(windows), len(self.languages)), np.float32)
        open_rows, gone = np.arange(len(windows)), np.zeros((len(windows), len(self.languages)), np.float32)
        for n in range(ORDER, 0, -1):
            tail = windows[open_rows, ORDER - n :]
            keys, values = self.grams[n]
            at, seen = _find(keys, _hash(tail))
            out[open_rows[seen]] = gone[seen] + values[at[seen]]
            open_rows, gone, tail = open_rows[~seen], gone[~seen], tail[~seen]
            if not len(open_rows):
                return out
            keys, values = self.rests[n]
            at, seen = _find(keys, _hash(tail[:, :-1]))
            gone[seen] += values[at[seen]]
        out[open_rows] = gone + self.floor
        return out

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(characters, cross-entropy per character by language) of each text; no characters without a letter."""
        count, total = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)))
        waiting: list[tuple[int, np.ndarray]] = []

        def work() -> None:
            lengths = np.array([len(w) for _, w in waiting])
            found = self.log_probability(np.concatenate([w for _, w in waiting]))
            sums = np.add.reduceat(found, np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0, dtype=np.float64)
            for (i, w), s in zip(waiting, sums, strict=True):
                count[i] += len(w)
                total[i] -= s
            waiting.clear()

        held = 0
        for i, text in enumerate(texts):
            for some in windows(text or ""):
                waiting.append((i, some))
                held += len(some)
                if held >= SLICE_CHARS:
                    work()
                    held = 0
        if waiting:
            work()
        return count, total / np.maximum(count, 1)[:, None]

    def calibrate(self, texts: list[str], languages: list[str]) -> Model:
        """Sets the rejection limits and how sharply cross-entropies turn into scores, from held-back texts."""
        count, entropy = self.cross_entropies(texts)
        true = np.array([self.languages.index(x) for x in languages], dtype=int)
        own = entropy[np.arange(len(true)), true]
        overall = own[count > 0].max(initial=np.log(_ALPHABET) / 2)
        each = [(true == k) & (count > 0) for k in range(len(self.languages))]
        self.limit = np.array([own[x].max(initial=0) or overall for x in each]) + 0.5
        # The cross-entropy of n characters scatters around the language's own with the root of n: short texts may lie further out.
        self.mean = np.array([own[x].mean() if x.any() else overall for x in each])
        self.spread = np.array([max(1.0, np.sqrt(np.mean((own[x] - own[x].mean()) ** 2 * count[x]))) if x.any() else 1.0 for x in each])
        best = -np.inf
        for sharpness in (0.02, 0.05, 0.1, 0.2, 0.5, 1.0):
            score = np.log(self._scores(count, entropy, sharpness)[np.arange(len(true)), true] + 1e-9).sum()
            if score > best:
                best, self.sharpness = score, sharpness
        return self

    @staticmethod
    def _scores(count: np.ndarray, entropy: np.ndarray, sharpness: float) -> np.ndarray:
        z = -entropy * np.minimum(count, 400)[:, None] * sharpness
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        count, entropy = self.cross_entropies(texts)
        best = entropy.argmin(axis=1)
        some = count > 0
        row = np.arange(len(texts))
        return pd.DataFrame(
            {
                "lang_pred": np.where(some, np.array(self.languages, dtype=object)[best], "und"),
                "score": np.where(some, self._scores(count, entropy, self.sharpness)[row, best], 0.0),
                "cross_entropy": np.where(some, entropy[row, best], 0.0),
                "accepted": some & (entropy[row, best] <= np.maximum(self.limit[best], self.mean[best] + DEVIATIONS * self.spread[best] / np.sqrt(np.maximum(count, 1)))),
            }
        )


def train(labelled: DataFrame, *, rows_per_language: int = ROWS_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learns from at most ``rows_per_language`` rows of each language, those with the smallest id digests.

    The sample's ids are chosen without texts and broadcast (their number is
    the bound); n-grams are counted on the executors.  Null ids, texts and
    languages are passed over.  None if nothing is labelled.
    """
    labelled = labelled.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    chosen = smallest_digests(rows, "lang", "id", rows_per_language).groupBy("id").agg(F.min("place").alias("place"))
    texts = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), "id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                found = [w for t in group["text"] for w in windows(t)]
                if found:
                    grams, counts = np.unique(np.concatenate(found), axis=0, return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": [g.tobytes() for g in grams.astype("<u4")], "n": counts})

    counted = sample.where("place % 5 != 0").select("lang", "text").mapInPandas(count, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if counted.empty:
        return None
    by_lang = {x: (np.frombuffer(b"".join(map(bytes, g["gram"])), dtype="<u4").reshape(-1, ORDER), g["n"].to_numpy()) for x, g in counted.groupby("lang")}
    held_back = sample.where("place % 5 = 0").select("lang", "text").toPandas()
    held_back = held_back[held_back["lang"].isin(by_lang)]
    return Model.fit(by_lang).calibrate(list(held_back["text"]), list(held_back["lang"]))


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: (id, lang_pred, score, cross_entropy, accepted), or those columns of ``keep`` and the four in a struct ``__language``.

    ``und`` with score 0, not accepted, where the text is null or has no
    letter, and everywhere if there is no model.  Whole texts are read; no
    shuffle; repeated rows each have a row; an empty table gives an empty
    result; further columns are ignored unless kept, and then may have any
    names but ``__text`` and ``__language``.
    """
    kept = [F.col(id_col).alias("id")] if keep is None else [F.col(c) for c in keep]
    rows = docs.select(*kept, F.col(text_col).alias("__text"))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    fields = {"lang_pred": pa.string(), "score": pa.float64(), "cross_entropy": pa.float64(), "accepted": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # kept columns stay as they came: pandas would turn ids beside nulls into floats
            texts = batch.column(batch.num_columns - 1).to_pylist()
            if shared.value is None:
                found = pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "cross_entropy": 0.0, "accepted": False})
            else:
                found = shared.value.predict(texts)
            new = [pa.array(found[n], type=t) for n, t in fields.items()]
            if keep is not None:
                new = [pa.StructArray.from_arrays(new, names=list(fields))]
            names = [*batch.schema.names[:-1], *(fields if keep is None else ["__language"])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=names)

    given = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "__text")
    four = "lang_pred string, score double, cross_entropy double, accepted boolean"
    return rows.mapInArrow(run, f"{given}, {four}" if keep is None else f"{given}, __language struct<{four.replace(' ', ':').replace(',:', ',')}>")
