"""Rank correlation and association at scale.

A global window without partitions would sort everything in one task. Values are first counted, which collapses ties; distinct values are then dealt
to range partitions, whose sizes give each partition its offset, so ranks need no single task.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

LEAST_ROWS = 3


def ranked_values(df: DataFrame, column: str) -> DataFrame:
    """(value, average rank) for each distinct non-null value of a column."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    dealt = stored(counted.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "dealt")  # dealt once: borders are sampled
    sizes = dealt.groupBy("part").agg(F.sum("n").alias("rows"))
    before = sizes.withColumn("before", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("upto", upto).join(F.broadcast(before.select("part", "before")), "part")
    return placed.select("value", (F.col("before") + F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))


def with_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Average ranks r0, r1, ... of complete rows."""
    whole = df.select(*(F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(columns)))
    for k in range(len(columns)):
        ranks = ranked_values(whole, f"v{k}").select(F.col("value").alias(f"v{k}"), F.col("rank").alias(f"r{k}"))
        whole = whole.join(ranks, f"v{k}", "left")
    return whole.select(*(f"r{k}" for k in range(len(columns))))


def spearman_pairs(df: DataFrame, columns: list[str], least: int = LEAST_ROWS) -> DataFrame:
    """(a, b, rho) over rows where both are there, null for fewer than `least`; columns without nulls are ranked once for all their pairs."""
    nulls = df.agg(*(F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in columns)).first()
    full = [c for c in columns if not nulls[c]]
    clean = df.select(*(F.when(~F.isnan(F.col(c).cast("double")), F.col(c)).alias(c) for c in columns))
    out = None

    def add(part: DataFrame) -> None:
        nonlocal out
        out = part if out is None else out.unionAll(part)

    if len(full) > 1:
        index = {c: k for k, c in enumerate(full)}
        ranked = with_ranks(clean.select(*full), full)
        pairs = list(combinations(full, 2))
        row = ranked.agg(F.count("*").alias("n"), *(F.corr(f"r{index[a]}", f"r{index[b]}").alias(f"p{k}") for k, (a, b) in enumerate(pairs)))
        add(row.select("n", F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{k}").alias("rho")) for k, (a, b) in enumerate(pairs))))))
    for a, b in combinations(columns, 2):
        if a in full and b in full:
            continue
        both = with_ranks(clean.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b), [a, b])
        add(both.agg(F.count("*").alias("n"), F.corr("r0", "r1").alias("rho")).select("n", F.lit(a).alias("a"), F.lit(b).alias("b"), "rho"))
    return out.select("a", "b", F.when((F.col("n") >= least) & ~F.isnan("rho"), F.round("rho", 6)).alias("rho"))


def spearman_matrix(df: DataFrame, columns: list[str]) -> list[list[float | None]]:
    index = {c: k for k, c in enumerate(columns)}
    matrix: list[list[float | None]] = [[1.0 if a == b else None for b in columns] for a in columns]
    for r in spearman_pairs(df, columns).collect():  # a row per pair of columns
        rho = None if r["rho"] is None or math.isnan(r["rho"]) else r["rho"]
        matrix[index[r["a"]]][index[r["b"]]] = matrix[index[r["b"]]][index[r["a"]]] = rho
    return matrix


def cramers_v(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, v) over complete pairs, from chi squared = n (sum o^2 / (row x column) - 1), without the dense table."""
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in combinations(columns, 2)))
    cells = df.select(F.inline(pairs)).where("x is not null and y is not null").groupBy("a", "b", "x", "y").agg(F.count("*").alias("o"))
    by = lambda *c: F.sum("o").over(Window.partitionBy("a", "b", *c))
    shares = cells.select("a", "b", "x", "y", "o", by("x").alias("r"), by("y").alias("c"))
    sums = shares.groupBy("a", "b").agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"), F.count_distinct("x").alias("nx"), F.count_distinct("y").alias("ny"))
    v = F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / (F.least("nx", "ny") - 1))
    return sums.select("a", "b", F.when(F.least("nx", "ny") >= 2, F.round(F.least(v, F.lit(1.0)), 6)).alias("v"))
