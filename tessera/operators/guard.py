"""Leakage guard: salted digests of sensitive values, the gate that checks generated tables, and privacy filters."""

from __future__ import annotations

import secrets
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import NUMERIC, GatedTable, LeakageError, LogicalType, Profile, Table
from .quantiles import quantile_arrays

ALGORITHM = "sha2-256"
ATTEMPTS = 100


def new_salt() -> str:
    return secrets.token_hex(16)


def canonical(value: Column, kind: LogicalType) -> Column:
    """One spelling of a value by its logical type, the same when it is profiled and when it is checked."""
    if kind is LogicalType.INTEGER:
        return value.cast("decimal(38,0)").cast("string")
    if kind is LogicalType.FLOAT:
        return value.cast("double").cast("string")
    if kind is LogicalType.DATETIME:
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return value.cast("string")


def digest(value: Column, salt: str, kind: LogicalType = LogicalType.STRING) -> Column:
    """Salted SHA-256; the salt is delimited by its length."""
    return F.when(value.isNotNull(), F.sha2(F.concat(F.lit(f"{len(salt)}:{salt}"), canonical(value, kind)).cast("binary"), 256))


def build_guard(table: Table, sensitive: list[str], salt: str) -> DataFrame:
    """(column, digest) of all distinct sensitive values; it stays distributed."""
    parts = F.array(*(F.struct(F.lit(c).alias("column"), digest(F.col(c), salt, table.schema.column(c).logical_type).alias("digest")) for c in sensitive))
    return table.df.select(F.inline(parts)).where("digest is not null").distinct()


def guard_of(spark: SparkSession, profile: Profile) -> DataFrame | None:
    """The guard of a profile, from memory or from where it is stored."""
    if profile.guard is not None or profile.guard_path is None:
        return profile.guard
    try:
        return spark.read.parquet(profile.guard_path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise LeakageError(f"the guard of {profile.schema.table} is missing: {profile.guard_path}") from e
        raise


def collisions(table: Table, guard: DataFrame, columns: list[str], salt: str) -> DataFrame:
    """(column, n, leaked): non-null cells, and those whose digest the guard has."""
    parts = F.array(*(F.struct(F.lit(c).alias("column"), digest(F.col(c), salt, table.schema.column(c).logical_type).alias("digest")) for c in columns))
    cells = table.df.select(F.inline(parts)).where("digest is not null").groupBy("column", "digest").agg(F.count("*").alias("n"))
    known = guard.select("column", "digest", F.lit(1).alias("hit")).distinct()
    return cells.join(known, ["column", "digest"], "left").groupBy("column").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)).alias("leaked"))


def enforce_leakage_gate(table: Table, guard: DataFrame, columns: list[str], salt: str, redraw: Callable[[str, Column], Column], attempts: int = ATTEMPTS) -> Table:
    """Redraw colliding cells, and only those, until none is left; fail closed otherwise. `redraw` gives a column's value at an attempt number."""
    df = table.df
    for attempt in range(1, attempts + 1):
        for c in columns:
            own = guard.where(F.col("column") == c).select(F.col("digest").alias("__d"), F.lit(True).alias("__hit"))
            kind = table.schema.column(c).logical_type
            df = df.withColumn("__d", digest(F.col(c), salt, kind)).join(own, "__d", "left").withColumn(c, F.when(F.col("__hit"), redraw(c, F.lit(attempt))).otherwise(F.col(c))).drop("__d", "__hit").select(*table.df.columns)
        left = {r["column"]: r["leaked"] for r in collisions(table.with_df(df), guard, columns, salt).collect()}
        if not any(left.values()):
            return table.with_df(df)
        df = df.checkpoint() if table.df.sparkSession.sparkContext.getCheckpointDir() else df
    raise LeakageError(f"real values remain after {attempts} attempts in {sorted(c for c, n in left.items() if n)}")


def gate(table: Table, guard: DataFrame | None, columns: list[str], salt: str | None, structural: tuple[str, ...] = ()) -> GatedTable:
    """Seal a table without collisions in guarded, non-structural columns; never redraws. Sensitive columns without a guard are refused."""
    checked = [c for c in columns if c not in structural]
    if columns and guard is None:
        raise LeakageError(f"{table.schema.table}: no guard for {sorted(columns)}")
    if checked:
        leaked = {r["column"]: r["leaked"] for r in collisions(table, guard, checked, salt).collect() if r["leaked"]}
        if leaked:
            raise LeakageError(f"real values in {sorted(leaked)}")
    return GatedTable(GatedTable._key, table, tuple(checked))


def scan_and_gate(table: Table, guard: DataFrame | None, columns: list[str], salt: str | None, structural: tuple[str, ...], classify: Callable[[Table, float], dict[str, str]]) -> GatedTable:
    """gate() for a table with a column is_fixture: pinned rows are checked in all guarded columns, keys included, and refused where a single
    value (or the name) of a column without guard is personal data."""
    pinned = table.with_df(table.df.where("is_fixture").drop("is_fixture"))
    gate(pinned, guard, columns, salt)
    if n := pinned.df.count():
        found = {c: kind for c, kind in classify(pinned, 1 / n).items() if c not in columns}
        if found:
            raise LeakageError(f"{table.schema.table}: fixtures hold personal data in columns without guard: {found}")
    return gate(table.with_df(table.df.drop("is_fixture")), guard, columns, salt, structural)


# ---------------------------------------------------------------- privacy filters


def robust_limits(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: median, median absolute deviation and mean absolute deviation of each column."""
    rows = df.count()
    middle = quantile_arrays(df, {c: F.col(c) for c in columns}, (0.5,), rows=rows)
    apart = df.join(F.broadcast(df.agg(*(middle[c][0].alias(f"med_{c}") for c in columns))))  # one row
    gap = {c: F.abs(F.col(c) - F.col(f"med_{c}")) for c in columns}
    spread = quantile_arrays(apart, gap, (0.5,), rows=rows)
    return apart.agg(*(x for c in columns for x in (F.first(f"med_{c}").alias(f"med_{c}"), spread[c][0].alias(f"mad_{c}"), F.avg(gap[c]).alias(f"dev_{c}"))))


def outlier_filter(df: DataFrame, columns: list[str], threshold: float = 4.0) -> DataFrame:
    """Rows without a robust z score above the threshold; columns that do not vary are skipped."""
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    if not columns:
        return df
    limits = robust_limits(df, columns)
    score = lambda c: F.when(F.col(f"mad_{c}") > 0, 0.6745 * F.abs(F.col(c) - F.col(f"med_{c}")) / F.col(f"mad_{c}")).when(F.col(f"dev_{c}") > 0, 0.7979 * F.abs(F.col(c) - F.col(f"med_{c}")) / F.col(f"dev_{c}")).otherwise(0.0)
    bad = reduce(Column.__or__, (F.coalesce(score(c) > threshold, F.lit(False)) for c in columns))
    return df.join(F.broadcast(limits)).where(~bad).select(*df.columns)


def nearest_reference_distance(table: Table, reference: DataFrame, key: str, columns: list[str], within: float | None = None) -> DataFrame:
    """(key, distance) to the nearest reference row: standardised numeric gaps and mismatches, combined as Euclidean.

    With `within`, only distances below it are found, by an equi-join on grid cells of that width of the numeric column with the largest spread, so both
    sides are shuffled once; without it, and for tables without a numeric column, each row is held against the whole reference.
    """
    kinds = {c: table.schema.column(c).logical_type for c in columns}
    numeric = [c for c in columns if kinds[c] in NUMERIC]
    ref = reference.select(*(F.col(c).alias(f"r_{c}") for c in columns))
    scale = ref.agg(*(F.coalesce(F.nullif(F.stddev_pop(f"r_{c}"), F.lit(0.0)), F.lit(1.0)).alias(f"s_{c}") for c in numeric)) if numeric else None
    own = table.df.select(key, *columns)
    if scale is not None:
        own, ref = own.join(F.broadcast(scale)), ref.join(F.broadcast(scale.select(*(F.col(f"s_{c}").alias(f"t_{c}") for c in numeric))))
    if within is not None and numeric:
        widths = reference.agg(*((F.max(c) - F.min(c)).cast("double").alias(c) for c in numeric)).join(scale).first()  # one row
        c = max(numeric, key=lambda c: (widths[c] or 0.0) / widths[f"s_{c}"])
        cell = lambda x, s: F.coalesce(F.floor(x / s / within), F.lit(-(2**62)))  # noqa: E731  nulls meet nulls
        own = own.withColumn("__cell", F.explode(F.when(F.col(c).isNull(), F.array(cell(F.col(c), F.col(f"s_{c}")))).otherwise(F.sequence(cell(F.col(c), F.col(f"s_{c}")) - 1, cell(F.col(c), F.col(f"s_{c}")) + 1))))
        ref = ref.withColumn("__cell", cell(F.col(f"r_{c}"), F.col(f"t_{c}")))
        pairs = own.join(ref, "__cell", "left")
        matched = F.col("__cell").isNotNull() & reduce(Column.__or__, (F.col(f"r_{x}").isNotNull() for x in columns))
    else:
        pairs, matched = own.join(ref, how="left"), F.lit(True)

    def part(c: str) -> Column:
        a, b = F.col(c), F.col(f"r_{c}")
        one = F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull() | b.isNull(), 1.0)
        return one.otherwise(F.pow((a - b) / F.col(f"s_{c}"), F.lit(2.0))) if kinds[c] in NUMERIC else one.otherwise((a != b).cast("double"))

    return pairs.groupBy(key).agg(F.min(F.when(matched, F.sqrt(reduce(Column.__add__, map(part, columns))))).alias("distance"))


def similarity_filter(table: Table, reference: DataFrame, key: str, columns: list[str], threshold: float = 0.1) -> DataFrame:
    """Rows at least so far from every reference row."""
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    near = nearest_reference_distance(table, reference, key, columns, within=threshold).where(F.col("distance") < threshold)
    return table.df.join(near.select(key), key, "left_anti").select(*table.df.columns)


def similar_rows_removed(table: Table, reference: DataFrame, threshold: float) -> DataFrame:
    """similarity_filter() over all columns of a table that has no key: equal rows share their distance, so a digest of the row is the key."""
    names = table.schema.names
    keyed = table.df.withColumn("__row", F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).cast("binary"), 256))
    return similarity_filter(table.with_df(keyed), reference, "__row", names, threshold).select(*names)
