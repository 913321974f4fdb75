"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence that has a telling word or
word stem has a logistic score of them; noisy-or joins them: a document is
toxic unless every sentence is not, and unless a base chance does not hold,
which rises with the number of sentences to a level below a half.  Sentences
that tell nothing add nothing else, so that clean texts stay clean however long
they are.  Weights are learned from document labels alone, and the
sentence scores then tell which sentences made a document toxic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import smallest_digests

#: Labelled rows learned from, per class: the bound of the training sample.
ROWS_PER_CLASS = 2000

#: Features in fewer sampled documents are left out, and so are those whose
#: share of documents differs between the classes by fewer standard errors.
LEAST_DOCUMENTS = 4
LEAST_DIFFERENCE = 3.5
STEM = 6
ROUNDS = 150

#: Sentences that give half of the slope, and the most log-odds that a text without a feature can have.
HALF_SLOPE = 200.0
MOST_LEAK = -0.5
MEMO_WORDS = 300_000

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


def _features(word: str) -> tuple[str, ...]:
    return (word, f"{word[:STEM]}*") if len(word) > STEM else (word,)


@dataclass
class Model:
    """Log-odds of a sentence: bias plus the weights of its distinct features.

    A document without any feature has the log-odds ``leak``, and up to
    ``slope`` more with the number of its sentences.
    """

    weights: dict[str, float]
    bias: float
    leak: float = -40.0
    slope: float = 0.0

    def sentence_scores(self, text: str, memo: dict[str, tuple]) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Scores of the sentences with any feature, and their spans (code points, end exclusive)."""
        scores, spans = [], []
        for m in _SENTENCE.finditer(text):
            words = set(_WORD.findall(m.group().lower()))
            if not words:
                continue
            total, counted = self.bias, set()
            for w in words:
                if (known := memo.get(w)) is None:
                    known = memo[w] = tuple((f, self.weights[f]) for f in _features(w) if f in self.weights)
                for f, x in known:
                    if f not in counted:
                        counted.add(f)
                        total += x
            if counted:
                scores.append(total)
                spans.append((m.start(), m.end()))
        if len(memo) > MEMO_WORDS:
            memo.clear()
        return _sigmoid(np.array(scores)), spans

    def document_score(self, text: str, p: np.ndarray) -> float:
        """Noisy-or of the sentences and the base chance; 0 for a text without words."""
        if not _WORD.search(text):
            return 0.0
        leak = self.leak + self.slope * _rise(sum(1 for m in _SENTENCE.finditer(text) if _WORD.search(m.group())))
        return float(1 - (1 - _sigmoid(leak)) * np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _rise(sentences):
    return sentences / (sentences + HALF_SLOPE)


def fit(docs: list[list[list[str]]], labels: np.ndarray, weight: np.ndarray) -> Model:
    """Minimises the noisy-or log-loss of ``docs`` (features by sentence) by full-batch Adam."""
    seen: dict[str, list[int]] = {}
    for d, y in zip(docs, labels, strict=True):
        for f in {f for s in d for f in s}:
            seen.setdefault(f, [0, 0])[y] += 1
    ones, zeros = int(labels.sum()), int(len(labels) - labels.sum())

    def telling(without: int, with_: int) -> bool:
        share = (with_ + without + 1) / (ones + zeros + 2)
        return with_ + without >= LEAST_DOCUMENTS and abs(with_ / ones - without / zeros) >= LEAST_DIFFERENCE * (share * (1 - share) * (1 / ones + 1 / zeros)) ** 0.5

    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if telling(*n)))}
    cell, sentence, owner = [], [], []
    for k, d in enumerate(docs):
        for s in d:
            ids = [index[f] for f in s if f in index]
            if not ids:
                continue
            cell += ids
            sentence += [len(owner)] * len(ids)
            owner.append(k)
    cell, sentence, owner = np.array(cell, np.int64), np.array(sentence, np.int64), np.array(owner, np.int64)
    w, both = np.zeros(len(index)), np.array([-4.0, -4.0, 0.0])  # bias, leak and slope
    mean, square, mean_b, square_b = np.zeros(len(index)), np.zeros(len(index)), np.zeros(3), np.zeros(3)
    rise = _rise(np.array([len(d) for d in docs]))
    for t in range(1, ROUNDS + 1):
        z = both[0] + np.bincount(sentence, weights=w[cell], minlength=len(owner))
        p = _sigmoid(z)
        none = np.exp(-np.bincount(owner, weights=np.logaddexp(0, z), minlength=len(docs)) - np.logaddexp(0, both[1] + both[2] * rise))
        per_doc = np.where(labels == 1, -none / np.maximum(1 - none, 1e-6), 1.0) * weight
        pull = p * per_doc[owner]
        g = np.bincount(cell, weights=pull[sentence], minlength=len(index)) + 0.05 * w
        leaking = _sigmoid(both[1] + both[2] * rise) * per_doc
        gb = np.array([pull.sum(), leaking.sum(), (leaking * rise).sum()])
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        mean_b, square_b = 0.9 * mean_b + 0.1 * gb, 0.99 * square_b + 0.01 * gb * gb
        fix = np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= 0.1 * fix * mean / (np.sqrt(square) + 1e-8)
        both -= 0.05 * fix * mean_b / (np.sqrt(square_b) + 1e-8)
        both[1] = min(both[1], MOST_LEAK)
        both[2] = min(both[2], MOST_LEAK - both[1])
    return Model({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}, *(float(x) for x in both))


def train(docs: DataFrame, labels: DataFrame, *, rows_per_class: int = ROWS_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Learns from at most ``rows_per_class`` labelled documents of each class, those with the smallest id digests.

    ``labels`` may be cut to training rows beforehand.  Null labels and null
    texts are passed over; an id labelled twice counts with its larger label.
    The sample's ids are broadcast (their number is the bound), its features
    are taken on the executors.  Classes are weighted back to their share of
    ``labels``.  None if either class is missing.
    """
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label")).where("id is not null")
    size = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = smallest_digests(known, "label", "id", rows_per_class).select("label", "id")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    sample = texts.join(F.broadcast(chosen), "id").select("label", "text")

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bags = [[" ".join(sorted({f for w in _WORD.findall(m.group().lower()) for f in _features(w)})) for m in _SENTENCE.finditer(t)] for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "bag": [[s for s in b if s] for b in bags]})

    found = sample.mapInPandas(featured, "label int, bag array<string>").toPandas()
    if found["label"].nunique() < 2:
        return None
    found = found.sort_values(["label", "bag"], key=lambda c: c if c.name == "label" else c.map("\n".join))
    used = found["label"].value_counts()
    share = found["label"].map(lambda x: size[x] / used[x]).to_numpy(float)
    return fit([[s.split(" ") for s in bag] for bag in found["bag"]], found["label"].to_numpy(), share / share.min())


def score(docs: DataFrame, model: Model | None, *, offending: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, score, offending), the latter an array of struct(start, end, score).

    Whole texts are read; no shuffle.  A text without words, null ones too, has
    score 0, as has everything without a model; repeated rows each have a row;
    an empty table gives an empty result; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    memo: dict[str, tuple] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # ids stay as they came: pandas would turn those beside nulls into floats
            whole, found = [], []
            for text in batch.column(1).to_pylist():
                p, spans = shared.value.sentence_scores(text, memo) if shared.value is not None and text else (np.zeros(0), [])
                whole.append(shared.value.document_score(text, p) if shared.value is not None and text else 0.0)
                found.append([{"start": spans[i][0], "end": spans[i][1], "score": float(p[i])} for i in np.flatnonzero(p >= offending)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.float64()), pa.array(found, kind)], names=["id", "score", "offending"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, score double, offending array<struct<start:int,end:int,score:double>>")
