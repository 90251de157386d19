"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Training follows the regularised leader with elastic-net penalties over a bounded sample of labelled rows, with an equal share
for each language as far as its rows go; a temperature is then fitted on a part of the sample that the weights have not seen.
A prediction reads the whole text and nothing else. Null texts and texts without a letter are `und` with score 0. Ties between
languages go to the first in alphabetical order.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, is_held_out, map_arrow
from .linear_text import bucket, features, sums

#: Labelled rows the model is fitted on at most (expected number); their texts are read whole.
TRAIN_ROWS = 3000
BITS, BLANK = 17, 32
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@cache
def letters_only() -> np.ndarray:
    """For each code point, itself if it is a letter, else a blank."""
    points = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    letter = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, len(points))
    return np.where(letter, points, np.uint32(BLANK))


class Reader:
    """Text to letter codes."""

    def __init__(self) -> None:
        self.table = letters_only()

    def __call__(self, text: str | None) -> np.ndarray:
        codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
        return self.table[codes]


def blanks(codes: np.ndarray) -> np.ndarray:
    return codes == BLANK


def extract(codes: np.ndarray, blank: np.ndarray, n: int) -> list[np.ndarray]:
    """Character 1- to 3-grams without two blanks in a row."""
    c = np.concatenate([codes[: n + 2], np.full(max(0, n + 2 - len(codes)), BLANK, codes.dtype)]).astype(np.uint64)
    b = np.concatenate([blank[: n + 2], np.ones(max(0, n + 2 - len(blank)), bool)])
    two, shift = b[:-1] & b[1:], np.uint64(20)
    first, second = c[:n], (c[:n] << shift) | c[1 : n + 1]
    third = (second << shift) | c[2 : n + 2]
    masked = lambda value, order, bad: np.where(bad, -1, bucket(value, order, BITS))
    return [masked(first, 1, b[:n]), masked(second, 2, two[:n]), masked(third, 3, two[:n] | two[1 : n + 1])]


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # a row per feature: inverse document frequency times coefficients; the last row is zeros
    bias: np.ndarray
    temperature: float

    def scores(self, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each language, and whether there is a letter."""
        total, n = sums(codes, BLANK, blanks, extract, self.weights)
        return softmax((total / np.maximum(n, 1)[:, None] + self.bias) / self.temperature), n > 0


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: Iterable[tuple[int, str, str]], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.001) -> LanguageModel:
    """Follow the regularised leader per coordinate: z and n accumulate, weights are their closed form under the elastic net.

    Rows are (id, text, language) in any order. Only the counts of their features are held, at most 2^BITS a row. The bias is
    a coordinate like the others, of a feature that every text has once.
    """
    read = Reader()
    held = [(ident, lang, *features(read(text), BLANK, blanks, extract)) for ident, text, lang in rows]
    held.sort(key=lambda row: (row[0], row[1], row[2].tobytes(), row[3].tobytes()))
    languages = sorted({row[1] for row in held})
    if not languages:
        return LanguageModel(["und"], np.zeros(((1 << BITS) + 1, 1), np.float32), np.zeros(1), 1.0)
    known = {lang: k for k, lang in enumerate(languages)}
    found = [row[2:] for row in held]
    wanted = np.array([known[row[1]] for row in held])
    rows = held
    frequency = np.zeros(1 << BITS)
    for at, _ in found:
        frequency[at] += 1
    idf = np.log((1 + len(rows)) / (1 + frequency)) + 1
    z, n = (np.zeros(((1 << BITS) + 1, len(languages))) for _ in range(2))  # the last row is the bias
    order = np.random.default_rng(7).permutation(len(rows))
    learn, tune = order[len(order) // 5 :], order[: len(order) // 5]

    def closed(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    scale = 100.0  # tf is a share; this keeps gradients near one
    for _ in range(epochs):
        for k in learn:
            at, count = found[k]
            if not len(at):
                continue
            x = np.append(count / count.sum() * idf[at] * scale, 1.0)[:, None]
            at = np.append(at, 1 << BITS)
            w = closed(at)
            p = softmax((x * w).sum(axis=0)[None])[0]
            p[wanted[k]] -= 1
            g = x * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    weights = np.vstack([closed(np.arange(1 << BITS)) * idf[:, None] * scale, np.zeros((1, len(languages)))]).astype(np.float32)
    model = LanguageModel(languages, weights, closed(np.array([1 << BITS]))[0], 1.0)
    if len(tune):
        mean = [count @ weights[at] / max(count.sum(), 1) for at, count in (found[k] for k in tune)]
        logits, truth = np.stack(mean) + model.bias, wanted[tune]
        losses = {t: -np.log(softmax(logits / t)[np.arange(len(tune)), truth] + 1e-12).mean() for t in np.geomspace(0.1, 10, 61)}
        model.temperature = float(min(losses, key=losses.get))
    return model


def quotas(counts: dict, rows: int) -> dict:
    """So many rows of each label that none has more than another which is not taken whole; `rows` in all."""
    out, left = {}, rows
    for k, (label, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], str(x[0])))):
        out[label] = min(n, left // (len(counts) - k))
        left -= out[label]
    return out


def labelled_sample(docs: DataFrame, label: str, rows: int, alike: bool) -> DataFrame:
    """About `rows` rows with a label that may be learned from, of all labels alike or in their proportions, chosen by a hash of
    the id: the same at every run. Ids are expected to be unique; all rows of a chosen id are taken."""
    may = docs.where(F.col(label).isNotNull() & ~is_held_out() & F.col("doc_id").isNotNull())
    counts = {r[label]: r["n"] for r in may.groupBy(label).agg(F.count("*").alias("n")).collect()}  # a row per label
    if (total := sum(counts.values())) <= rows:
        return may
    wanted = quotas(counts, rows) if alike else {k: -(-n * rows // total) for k, n in counts.items()}
    steps = 1_000_003
    limit = F.create_map(*(F.lit(x) for k, n in wanted.items() for x in (k, min(steps, n * steps // counts[k] + 1))))
    return may.where(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < limit[F.col(label)])


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> LanguageModel:
    """A model of about `rows` labelled rows that are not held out."""
    sample = labelled_sample(docs.select("doc_id", "text", "lang"), "lang", rows, alike=True)
    return fit((r["doc_id"], r["text"], r["lang"]) for r in sample.select("doc_id", "text", "lang").toLocalIterator())


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Per document the language and the calibrated probability."""

    def make():
        read = Reader()
        names = np.array([*model.languages, "und"], object)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            p, letters = model.scores([read(t) for t in batch.column(1).to_pylist()])
            best = np.where(letters, p.argmax(axis=1), len(model.languages))
            ids = batch.column(0)
            return pa.record_batch([ids, pa.array([held_out(i) for i in ids.to_pylist()]), pa.array(names[best], pa.string()), pa.array(np.where(letters, p.max(axis=1), 0.0).round(9))], ["doc_id", "held_out", "lang_pred", "score"])

        return each

    return map_arrow(docs.select("doc_id", "text"), make, SCHEMA)


def accepted(model: LanguageModel, text: Column, least: float = 0.5) -> Column:
    """True for texts whose language the model names with at least this probability."""
    held: list[Reader] = []

    @F.arrow_udf("boolean")
    def sure(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Reader())
        p, letters = model.scores([held[0](t) for t in texts.to_pylist()])
        return pa.array(letters & (p.max(axis=1) >= least)) if len(p) else pa.array([], pa.bool_())

    return sure(text)
