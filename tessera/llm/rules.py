"""Quality rules with risk-controlled cutoffs.

Signals of a text are compared with cutoffs. A ladder fixes beforehand, from loose to strict, a cutoff for every signal on each rung. In each
stratum (a band of word counts) the rungs are tested in order on labelled good documents: a rung holds if the exact
(Clopper-Pearson) upper bound on the share of good documents that it rejects is at most `risk`. The last rung before the first that
fails is used. Testing in a fixed order keeps the error of a stratum at its level, and the level is split between strata
(Bonferroni), so with probability 1 - `error` every stratum's false rejection is within `risk`. Strata with too few labels use no cutoff.

Null texts have no words; a text without words fails the base rule. Labels other than 1 are not good; several labels of one
document count as the least. Repeated rows are judged alike.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_arrow, stored

RISK, ERROR = 0.05, 0.05
#: First word counts of the strata.
BANDS = (0, 150, 400)
#: Cutoffs by signal, loose to strict; a document is rejected if a signal is above its cutoff.
LADDER = {
    "symbol_rate": (1.0, 0.5, 0.3, 0.2, 0.1, 0.05, 0.03, 0.02),
    "dup_line_rate": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25),
    "repeat_rate": (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15),
    "capital_rate": (0.9, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15),
    "exclaim_rate": (1.0, 0.8, 0.5, 0.3, 0.2, 0.1, 0.08, 0.05),
    "long_words": (14.0, 12.0, 11.0, 10.0, 9.0, 8.5, 8.0, 7.5),
    "short_words": (-2.0, -2.2, -2.4, -2.6, -2.8, -3.0, -3.2, -3.4),
}
RUNGS = len(LADDER["symbol_rate"])
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclaims")
CAPITALS, SYMBOLS, CONTINUATION = bytes(range(65, 91)), b"#*$%&|<>", bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes]) -> int:
    """Positions of words that lie in a window of three words which the text holds twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    number = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    base = len(known)
    pair = number[:-1] * base + number[1:]
    if base >= 1 << 20:  # three numbers would not fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * base + number[2:]
    _, which, times = np.unique(window, return_inverse=True, return_counts=True)
    at = np.flatnonzero(times[which] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def counts(text: bytes) -> tuple[int, ...]:
    words = text.split()  # bytes split at exactly the six ASCII blanks
    lines = [x for x in text.split(b"\n") if x.strip()]
    joined = b"".join(words)
    code_points = len(joined) if joined.isascii() else len(joined.translate(None, CONTINUATION))
    return (
        len(words),
        code_points,
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(text) - len(text.translate(None, CAPITALS)),
        text.count(b"!"),
    )


def count_signals(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = zip(*map(counts, as_bytes(batch.column(1))), strict=True)
            return pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *COUNTS])

        return each

    return map_arrow(docs.select("doc_id", "text"), make, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def signals(of=F.col) -> dict[str, Column]:
    per = lambda a, b: of(a) / F.greatest(of(b), F.lit(1))
    return {
        "symbol_rate": per("n_symbols", "n_words"),
        "dup_line_rate": per("n_dup_lines", "n_lines"),
        "repeat_rate": per("n_repeat_words", "n_words"),
        "capital_rate": per("n_capitals", "word_chars"),
        "exclaim_rate": per("n_exclaims", "n_words"),
        "long_words": per("word_chars", "n_words"),
        "short_words": -per("word_chars", "n_words"),
    }


def base_failed(of=F.col) -> Column:
    return (of("n_words") < 50) | (100 * of("n_repeat_words") > 50 * of("n_words"))


def stratum(of=F.col) -> Column:
    return sum(((of("n_words") >= b).cast("int") for b in BANDS[1:]), F.lit(0))


def rejected(rung: Column | int, of=F.col) -> Column:
    """Whether a rung (from 1; 0 has no cutoffs) rejects."""
    over = [value > F.element_at(F.array(*map(F.lit, LADDER[name])), rung if isinstance(rung, Column) else F.lit(rung)) for name, value in signals(of).items()]
    return reduce(Column.__or__, over)


def at_most(k: int, n: int, p: float) -> float:
    """The probability that at most k of n are hit, each with probability p: the regularised incomplete beta function by its
    continued fraction, whose length does not grow with n but for its square root."""
    if k >= n:
        return 1.0

    def fraction(x: float, a: float, b: float) -> float:
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
        tiny = 1e-300
        value = c = 1.0
        d = 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
        value = d
        for m in range(1, 10_000_000):
            for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + term * d) or tiny)
                c = (1 + term / c) or tiny
                value *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return front * value

    a, b, x = n - k, k + 1, 1 - p  # the probability is the function of x at (a, b)
    return fraction(x, a, b) if x < (a + 1) / (a + b + 2) else 1 - fraction(p, b, a)


def binomial_upper(k: int, n: int, level: float) -> float:
    """The exact one-sided upper bound on a share of which k of n were seen: the p at which so few have probability `level`."""
    low, high = k / n if n else 0.0, 1.0
    if k >= n:
        return 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if at_most(k, n, middle) > level else (low, middle)
    return high


def select_rungs(counted: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> list[int]:
    """The rung of each stratum. All labelled good documents that pass the base rule are the holdout; only sums reach the driver."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("__quality")).where(F.col("__quality") == 1).select("doc_id")
    sums = counted.where(~base_failed()).join(good, "doc_id", "left_semi").groupBy(stratum().alias("s")).agg(F.count("*").alias("n"), *(F.sum(rejected(r).cast("long")).alias(f"r{r}") for r in range(1, RUNGS + 1)))
    seen = {r["s"]: r for r in sums.collect()}  # a row per stratum
    return [choose(seen[s]["n"], [seen[s][f"r{r}"] for r in range(1, RUNGS + 1)], risk, error / len(BANDS)) if s in seen else 0 for s in range(len(BANDS))]


def choose(n: int, false_rejections: list[int], risk: float, level: float) -> int:
    """The strictest rung before the first whose bound is above the risk; so it is where so few have more than `level` at that risk."""
    for rung, k in enumerate(false_rejections):
        if at_most(k, n, risk) > level:
            return rung
    return len(false_rejections)


def verdict(rungs: list[int], of=F.col) -> Column:
    """True if the base rule and the rung of the stratum both pass."""
    rung = F.element_at(F.array(*map(F.lit, rungs)), stratum(of) + 1)
    return ~base_failed(of) & F.when(rung == 0, True).otherwise(~rejected(F.greatest(rung, F.lit(1)), of))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Counts, base verdict and verdict of each document."""
    counted = stored(count_signals(docs), "signals")
    rungs = select_rungs(counted, labels, risk, error)
    return counted.select("doc_id", *COUNTS[:5], base_failed().alias("base_failed"), verdict(rungs).alias("kept"), stratum().alias("stratum"))


def accepted(text: Column, rungs: list[int]) -> Column:
    """The verdict as an expression on a text column, for filters that keep a table's own columns."""

    @F.arrow_udf("struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">")
    def counted(texts: pa.Array) -> pa.Array:
        columns = list(zip(*map(counts, as_bytes(texts)), strict=True)) or [()] * len(COUNTS)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(COUNTS))

    # one call of the function serves all the fields
    return F.transform(F.array(counted(text)), lambda x: verdict(rungs, lambda name: x[name]))[0]
