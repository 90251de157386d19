"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged, with a softmax on top, trained by stochastic gradient descent.

Words are what lies between ASCII white space. Features are each word and the byte 3- and 4-grams of a word between its blanks.
As the output is linear in the average, scoring needs one number per feature: its vector times the difference of the two output
vectors. Null and empty texts have no feature and get the score of the bias alone. Labels other than 0 and 1 are not used;
several labels of one document count as the least. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_arrow
from .langid import labelled_sample
from .linear_text import AHEAD, bucket, features, sums

#: Labelled rows the model is fitted on at most (expected number); their texts are read whole.
TRAIN_ROWS = 3000
#: Words of more than INLINE_WORD bytes are hashed one by one, the others together.
BITS, DIMENSIONS, INLINE_WORD = 16, 8, 64
PRIME = 0x100000001B3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
BLANKS = np.isin(np.arange(256), [32, *range(9, 14)])


def blanks(codes: np.ndarray) -> np.ndarray:
    return BLANKS[codes]


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[1], np.full(n - 1, PRIME)]).astype(np.uint64))


POWERS = powers(INLINE_WORD + 1)


def extract(codes: np.ndarray, blank: np.ndarray, n: int) -> list[np.ndarray]:
    room = n + AHEAD
    c = np.concatenate([codes, np.full(max(0, room - len(codes)), 32, codes.dtype)])[:room].astype(np.uint64)
    b = np.concatenate([blank, np.ones(max(0, room - len(blank)), bool)])[:room]
    inner1, inner2 = b[1 : n + 1], b[1 : n + 1] | b[2 : n + 2]
    three = c[:n] << np.uint64(16) | c[1 : n + 1] << np.uint64(8) | c[2 : n + 2]
    four = three << np.uint64(8) | c[3 : n + 3]
    # a word's first byte follows a blank; as each text begins with one, position p starts the word at p + 1
    starts = np.flatnonzero(b[:n] & ~b[1 : n + 1]) + 1
    ends_at = np.flatnonzero(b)
    stop = np.append(ends_at, room + INLINE_WORD)[np.searchsorted(ends_at, starts)]
    size = stop - starts
    short = size <= INLINE_WORD
    starts, size = starts[short], size[short]
    word = np.full(n, -1, np.int64)
    if len(starts):
        rows = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        place = np.arange(size.sum()) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        hashed = np.add.reduceat((c[rows] + np.uint64(1)) * POWERS[place], np.concatenate([[0], np.cumsum(size)[:-1]]))
        word[starts - 1] = bucket(hashed, 5, BITS)
    return [word, np.where(inner1, -1, bucket(three, 3, BITS)), np.where(inner2, -1, bucket(four, 4, BITS))]


def long_words(text: np.ndarray) -> np.ndarray:
    """Feature numbers of the words that `extract` leaves out."""
    at = np.flatnonzero(np.concatenate([[True], BLANKS[text], [True]]))
    far = np.flatnonzero(np.diff(at) > INLINE_WORD + 1)
    hashed = [xxhash.xxh3_64_intdigest(text[at[k] : at[k + 1] - 1].tobytes()) for k in far]
    return bucket(np.array(hashed, np.uint64), 6, BITS)


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their counts."""
    codes = np.frombuffer(text, np.uint8)
    at, count = features(codes, 32, blanks, extract)
    if len(more := long_words(codes)):
        at, place = np.unique(np.concatenate([at, more]), return_inverse=True)
        count = np.bincount(place, np.concatenate([count, np.ones(len(more))])).astype(np.int64)
    return at, count


@dataclass
class QualityModel:
    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def scorer(self) -> tuple[np.ndarray, float]:
        gain = self.vectors @ (self.output[1] - self.output[0])
        return np.append(gain, 0.0).astype(np.float32)[:, None], float(self.bias[1] - self.bias[0])


def scores(texts: list[bytes], gain: np.ndarray, bias: float) -> np.ndarray:
    codes = [np.frombuffer(t, np.uint8) for t in texts]
    total, n = sums(codes, 32, blanks, extract, gain)
    for k, text in enumerate(codes):
        if len(more := long_words(text)):
            total[k] += gain[more].sum(axis=0)
            n[k] += len(more)
    return 1 / (1 + np.exp(-(total[:, 0] / np.maximum(n, 1) + bias)))


def fit(rows: Iterable[tuple[bytes, int]], epochs: int = 6, rate: float = 0.5) -> QualityModel:
    """Stochastic gradient descent over (text, label) in an order that does not depend on theirs; only counts of features are held."""
    held = sorted(((label, *counted(text)) for text, label in rows), key=lambda row: (row[0], row[1].tobytes(), row[2].tobytes()))
    rows, found = [row[0] for row in held], [row[1:] for row in held]
    rng = np.random.default_rng(11)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS)).astype(np.float32)
    output, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, count = found[k]
            now = rate * (1 - done / steps)
            done += 1
            share = (count / max(count.sum(), 1)).astype(np.float32)
            hidden = share @ vectors[at] if len(at) else np.zeros(DIMENSIONS, np.float32)
            logit = output @ hidden + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[rows[k]] -= 1
            back = p @ output
            output -= now * np.outer(p, hidden)
            bias -= now * 0.1 * p
            if len(at):
                # vectors of one text share its gradient in proportion to their counts, scaled so that rare ones move too
                vectors[at] -= now * np.outer(share * np.float32(min(len(at), 200)), back)
    return QualityModel(vectors, output, bias)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> QualityModel:
    """Fit on labelled rows that may be learned from. The sample of ids is drawn before texts are joined to it."""
    marked = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = labelled_sample(marked, "quality", rows, alike=False).select("doc_id", "quality")
    chosen = {r["doc_id"]: r["quality"] for r in sample.collect()}  # about `rows` at any size of corpus
    texts = docs.select("doc_id", "text")
    got = texts.where(F.col("doc_id").isin([*chosen]) & F.col("text").isNotNull()) if chosen else texts.limit(0)
    return fit((r["text"].encode(), int(chosen[r["doc_id"]])) for r in got.toLocalIterator())


def predict(docs: DataFrame, model: QualityModel, least: float = 0.7) -> DataFrame:
    """Per document the probability of label 1."""
    gain, bias = model.scorer()

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = scores([x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()], gain, bias).round(9)
            ids = batch.column(0)
            return pa.record_batch([ids, pa.array([held_out(i) for i in ids.to_pylist()]), pa.array(p), pa.array((p >= least).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return each

    return map_arrow(docs.select("doc_id", "text"), make, SCHEMA)
