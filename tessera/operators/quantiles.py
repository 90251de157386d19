"""Exact interpolated quantiles with bounded state.

An exact percentile keeps all distinct values in one buffer. That is used up to `WHOLE` rows only. Beyond it, sketches bracket each quantile, every scan
narrows the brackets to a few ten-thousandths of what they held, and once a bracket holds few values the exact percentile of those is the quantile. No scan
shuffles rows; the driver sees two numbers and two counts for each quantile.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which one buffer may hold all distinct values, and the accuracy of a sketch: ranks are off by rows / ACCURACY at most.
WHOLE, ACCURACY = 1_000_000, 10_000


@dataclass
class Bracket:
    """Closed range of values around a quantile; `rank` counts from 0 among the values inside."""

    name: str
    rank: float
    inside: int
    low: float | None = None
    high: float | None = None
    done: bool = False

    def values(self, x: Column) -> Column:
        return x if self.low is None else F.when(x.between(self.low, self.high), x)

    def around(self) -> Column:
        middle, slack = self.rank / max(self.inside - 1, 1), 3 / ACCURACY
        return F.array(*(F.lit(min(max(v, 0.0), 1.0)) for v in (middle - slack, middle + slack)))


def quantile_arrays(df: DataFrame, values: dict[str, Column], probabilities: tuple[float, ...], whole: int = WHOLE, rows: int | None = None) -> dict[str, Column]:
    """For each named expression an expression for the aggregation of `df`: the array of its quantiles, null where it has no value."""
    if not values:
        return {}
    if (df.count() if rows is None else rows) <= whole:
        return {name: F.percentile(x, F.array(*map(F.lit, probabilities))) for name, x in values.items()}
    doubles = {name: x.cast("double") for name, x in values.items()}
    counts = df.agg(*(F.count(x).alias(f"n{k}") for k, x in enumerate(doubles.values()))).first()
    held = dict(zip(doubles, counts, strict=True))
    brackets = [Bracket(name, p * (n - 1), n, done=n <= whole) for name, n in held.items() for p in probabilities]
    while open_ := [b for b in brackets if not b.done]:
        narrow(df, doubles, open_, whole)
    found = df.agg(*(F.percentile(b.values(doubles[b.name]), F.lit(min(max(b.rank / max(b.inside - 1, 1), 0.0), 1.0))).alias(f"q{k}") for k, b in enumerate(brackets))).first()
    by_name = {name: [v for b, v in zip(brackets, found, strict=True) if b.name == name] for name in doubles}
    return {name: F.array(*map(F.lit, v)) if held[name] else F.lit(None).cast("array<double>") for name, v in by_name.items()}


def narrow(df: DataFrame, doubles: dict[str, Column], brackets: list[Bracket], whole: int) -> None:
    """Shrink brackets by a sketch of what they hold; one that does not shrink holds few distinct values and is done."""
    ends = df.agg(*(F.percentile_approx(b.values(doubles[b.name]), b.around(), ACCURACY).alias(f"e{k}") for k, b in enumerate(brackets))).first()
    counted = []
    for k, (b, (low, high)) in enumerate(zip(brackets, ends, strict=True)):
        x = b.values(doubles[b.name])
        counted += [F.count_if(x < low).alias(f"b{k}"), F.count_if(x.between(low, high)).alias(f"m{k}")]
    row = df.agg(*counted).first()
    for k, (b, (low, high)) in enumerate(zip(brackets, ends, strict=True)):
        below, inside = row[f"b{k}"], row[f"m{k}"]
        if not below <= b.rank <= below + inside - 1:
            b.done = True  # a sketch of few values may be off by one place; the wider bracket is exact
            continue
        b.done = inside <= whole or inside == b.inside or low == high
        b.rank, b.inside, b.low, b.high = b.rank - below, inside, low, high


#: Rows that are sorted on the driver at the end of a search for the k-th smallest key.
FEW, DIGITS = 4096, 3


def among_smallest(rows: DataFrame, k: int, key: Column, tie: Column) -> Column:
    """Whether a row is among the k with the smallest (key, tie). `rows` has them as columns key, a text of hexadecimal digits, and tie.

    The k-th smallest is found by counting rows by the next digits of their key, at most 16^DIGITS counts a pass, until FEW are left;
    what comes back is a comparison, so taking the rows needs no sort, join or limit. Equal (key, tie) are taken together.
    """
    prefix, left = "", k
    while True:
        next_digits = F.substring("key", len(prefix) + 1, DIGITS)
        counts = rows.where(F.col("key").startswith(prefix)).groupBy(next_digits.alias("at")).agg(F.count("*").alias("n"))
        for at, n in sorted((r["at"], r["n"]) for r in counts.collect()):
            if left <= n:
                break
            left -= n
        else:
            return F.lit(True)
        prefix += at
        if n <= FEW or not at:
            last = rows.where(F.col("key").startswith(prefix)).orderBy("key", "tie").limit(left).collect()[-1]
            return (key < last["key"]) | ((key == last["key"]) & (tie <= F.lit(last["tie"])))
