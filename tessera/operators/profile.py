"""Profiles: aggregates of a table, and nothing that names a single row.

One wide aggregation gives counts, moments, quantiles and lengths of all columns; histograms, category counts and
calendar counts come from one unpivoted aggregation each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pii
from ..plans.model import NUMERIC, TEXT, ColumnProfile, DatetimeStats, LogicalType, NumericStats, Profile, Table, TextStats
from . import correlate
from .guard import build_guard, new_salt
from .quantiles import quantile_arrays

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
TOP_K, CATEGORY_LIMIT, BINS, SHORT = 20, 50, 10, 64


def finite(value: Column) -> Column:
    """As a double, null where it is no finite number."""
    x = value.try_cast("double") if isinstance(value, Column) else value
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def text_of(value: Column, kind: LogicalType) -> Column:
    return F.initcap(value.cast("string")) if kind is LogicalType.BOOLEAN else value.cast("string")


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: count, nulls, distinct, min, max, mean, std and exact interpolated quantiles."""
    x = finite(F.col(column))
    q = quantile_arrays(df, {column: x}, QUANTILES)[column]
    one = df.agg(F.count(column).alias("n"), F.count_if(F.col(column).isNull()).alias("n_null"), F.count_distinct(column).alias("n_distinct"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), q.alias("q"))
    return one.select("*", *(F.col("q")[k].alias(f"q{int(p * 100):02d}") for k, p in enumerate(QUANTILES))).drop("q")


def histogram_bin(value: Column, low: Column | float, high: Column | float, bins: int = BINS) -> Column:
    """Equal-width bin with a closed last one; a single value gets a range of one around it."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    flat = low == high
    start = F.when(flat, low - 0.5).otherwise(low)
    width = F.when(flat, F.lit(1.0)).otherwise(high - low) / bins
    return F.least(F.floor((value - start) / width), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """(bin, n) of the finite values; the range comes from one aggregate that is joined as a single row."""
    x = df.select(finite(F.col(column)).alias("x")).where("x is not null")
    span = x.agg(F.min("x").alias("low"), F.max("x").alias("high"))  # always one row
    return x.join(F.broadcast(span)).groupBy(histogram_bin(F.col("x"), F.col("low"), F.col("high"), bins).alias("bin")).agg(F.count("*").alias("n"))


def top_categories(df: DataFrame, column: str, k: int = TOP_K) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def calendar_counts(df: DataFrame, column: str) -> DataFrame:
    """(part, value, n): days of the week from Monday 0, and months."""
    parts = F.array(F.struct(F.lit("dow").alias("part"), F.weekday(column).alias("value")), F.struct(F.lit("month").alias("part"), F.month(column).alias("value")))
    return df.where(F.col(column).isNotNull()).select(F.explode(parts).alias("p")).groupBy("p.part", "p.value").agg(F.count("*").alias("n"))


def text_lengths(df: DataFrame, column: str) -> DataFrame:
    size = F.char_length(F.col(column).cast("string"))
    return df.agg(F.count(column).alias("n"), F.min(size).alias("min_length"), F.max(size).alias("max_length"), F.avg(size).alias("mean_length"))


def classify_sensitive_columns(table: Table, least_rate: float = 0.5) -> dict[str, str]:
    """Kinds of personal data by name, else by values; all rates come from one aggregation."""
    if not 0 < least_rate <= 1:
        raise ValueError("a rate lies above 0 and goes up to 1")
    found: dict[str, str] = {}
    for c in table.schema.columns:
        if c.logical_type in TEXT | {LogicalType.DATETIME} and (hint := pii.name_hint(c.name)):
            found[c.name] = hint
    texts = [c.name for c in table.schema.columns if c.logical_type in TEXT and c.name not in found]
    if texts:
        rates = pii_rates(table.df, texts).collect()  # a row per column and kind
        for kind in pii.validators(F.lit("")):
            found |= {r["column"]: kind for r in rates if r["kind"] == kind and r["n"] and r["matched"] / r["n"] >= least_rate and r["column"] not in found}
    return found


def pii_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, kind, n, matched) from a single pass."""
    kinds = list(pii.validators(F.lit("")))
    sums = df.agg(*(F.count(c).alias(f"{c}__n") for c in columns), *(F.coalesce(F.sum(pii.validators(F.col(c).cast("string"))[k].cast("long")), F.lit(0)).alias(f"{c}__{k}") for c in columns for k in kinds))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(f"{c}__n").alias("n"), F.col(f"{c}__{k}").alias("matched")) for c in columns for k in kinds))
    return sums.select(F.inline(rows))


def profile_table(table: Table, top_k: int = TOP_K, category_limit: int = CATEGORY_LIMIT, bins: int = BINS, sensitive: tuple[str, ...] = (), not_sensitive: tuple[str, ...] = (), classify_pii: bool = False, salt: str | None = None, least_rate: float = 0.5, whole: Table | None = None) -> Profile:
    """Profile all columns in a bounded number of jobs. Sensitive columns keep counts only, and a guard over all rows: of `whole`, where the table is a sample of it."""
    schema, df = table.schema, table.df
    marked = {*sensitive, *(classify_sensitive_columns(table, least_rate) if classify_pii else ())} - set(not_sensitive)
    for name in marked:
        schema.column(name)
    wanted = []
    quantiles = quantile_arrays(df, {c.name: finite(F.col(c.name)) for c in schema.columns if c.logical_type in NUMERIC and c.name not in marked}, QUANTILES)
    for c in schema.columns:
        x, col = finite(F.col(c.name)), F.col(c.name)
        wanted += [F.count(col).alias(f"{c.name}__n"), F.count_distinct(col).alias(f"{c.name}__d")]
        if c.name in marked:
            continue
        if c.logical_type in NUMERIC:
            wanted += [F.struct(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), quantiles[c.name].alias("q")).alias(f"{c.name}__s")]
        elif c.logical_type is LogicalType.DATETIME:
            wanted += [F.struct(F.min(col).cast("string").alias("min"), F.max(col).cast("string").alias("max")).alias(f"{c.name}__s")]
        elif c.logical_type in TEXT:
            size = F.char_length(col.cast("string"))
            wanted += [F.struct(F.min(size).alias("min"), F.max(size).alias("max"), F.avg(size).alias("mean")).alias(f"{c.name}__s")]
    row = df.agg(F.count("*").alias("__rows"), *wanted).first()
    columns, numeric, categorical = [], [], []
    for c in schema.columns:
        p = ColumnProfile(c.name, c.logical_type, row[f"{c.name}__n"], row["__rows"] - row[f"{c.name}__n"], row[f"{c.name}__d"])
        columns.append(p)
        s = None if c.name in marked or c.logical_type is LogicalType.BOOLEAN else row[f"{c.name}__s"]
        if c.name in marked or not p.count:
            continue
        if c.logical_type in NUMERIC and s["min"] is not None:
            p.numeric = NumericStats(s["min"], s["max"], s["mean"], s["std"], {f"{q:g}": v for q, v in zip(QUANTILES, s["q"], strict=True)})
            numeric.append(p)
        elif c.logical_type is LogicalType.DATETIME:
            p.datetime = DatetimeStats(s["min"], s["max"])
        elif c.logical_type in (LogicalType.BOOLEAN, LogicalType.CATEGORICAL) or c.logical_type is LogicalType.STRING and p.distinct_count <= category_limit and s["max"] <= SHORT:
            categorical.append(p)
        elif c.logical_type is LogicalType.STRING:
            p.text = TextStats(s["min"], s["max"], s["mean"])
    fill_histograms(df, numeric, bins)
    fill_categories(df, categorical, top_k)
    fill_calendar(df, [p for p in columns if p.datetime])
    moving = [p.name for p in numeric if p.numeric.min < p.numeric.max]
    profile = Profile(schema, row["__rows"], columns, sensitive=tuple(sorted(marked)), salt=(salt or new_salt()) if marked else None)
    if marked:
        profile.guard = build_guard(whole or table, sorted(marked), profile.salt)
    if len(moving) > 1:
        profile.numeric_columns, profile.spearman = moving, correlate.spearman_matrix(df, moving)
    few = [p.name for p in categorical if 2 <= p.distinct_count <= category_limit]
    if len(few) > 1:
        profile.cramers_v = {f"{r['a']}|{r['b']}": r["v"] for r in correlate.cramers_v(df, few).collect()}
    return profile


def fill_histograms(df: DataFrame, numeric: list[ColumnProfile], bins: int) -> None:
    if not numeric:
        return
    parts = F.array(*(F.struct(F.lit(k).alias("c"), histogram_bin(finite(F.col(p.name)), p.numeric.min, p.numeric.max, bins).alias("bin")) for k, p in enumerate(numeric)))
    rows = df.select(F.inline(parts)).where("bin is not null").groupBy("c", "bin").agg(F.count("*").alias("n")).collect()  # columns x bins rows
    for k, p in enumerate(numeric):
        s = p.numeric
        low, high = (s.min - 0.5, s.max + 0.5) if s.min == s.max else (s.min, s.max)
        s.edges = [low + (high - low) * i / bins for i in range(bins)] + [high]
        s.counts = [0] * bins
        for r in rows:
            if r["c"] == k:
                s.counts[r["bin"]] = r["n"]


def fill_categories(df: DataFrame, categorical: list[ColumnProfile], top_k: int) -> None:
    if not categorical:
        return
    parts = F.array(*(F.struct(F.lit(k).alias("c"), text_of(F.col(p.name), p.logical_type).alias("value")) for k, p in enumerate(categorical)))
    counted = df.select(F.inline(parts)).where("value is not null").groupBy("c", "value").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("n"), "value"))
    rows = counted.withColumn("r", rank).where(F.col("r") <= top_k).collect()  # columns x top_k rows
    for k, p in enumerate(categorical):
        p.categories = [(r["value"], r["n"]) for r in sorted((r for r in rows if r["c"] == k), key=lambda r: r["r"])]


def fill_calendar(df: DataFrame, moments: list[ColumnProfile]) -> None:
    if not moments:
        return
    rows = reduce(DataFrame.unionAll, (calendar_counts(df, p.name).withColumn("c", F.lit(p.name)) for p in moments)).collect()
    for r in rows:
        p = next(p for p in moments if p.name == r["c"])
        (p.datetime.day_of_week if r["part"] == "dow" else p.datetime.month)[r["value"]] = r["n"]
