"""Rows from a profile, as one narrow projection over a range of positions: no shuffle, and the same bytes under any partitioning."""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.random import normal, phi, uniform
from ..plans.model import ColumnProfile, GatedTable, GenerationError, LogicalType, NumericStats, Profile, Table
from .conditions import Between, Condition, Equals, Members, typed, validate_conditions
from .guard import enforce_leakage_gate, gate, guard_of

# fixed values: column names whose text gets a format, in order
FORMATS = {"email": ("email", "e_mail", "mail"), "phone": ("phone", "telephone", "mobile", "cell"), "uuid": ("uuid", "guid")}
NAMES = ("name", "surname", "fullname")
FIRST = ("Ada", "Ben", "Cleo", "Dina", "Emil", "Faye", "Gus", "Hana", "Ivo", "Jana", "Kai", "Lena", "Milo", "Nora", "Otto", "Pia")
LAST = ("Abel", "Brandt", "Castro", "Dahl", "Evans", "Fischer", "Grant", "Haas", "Ibsen", "Jensen", "Kent", "Lopez", "Meyer", "Nilsen", "Owens", "Peters")
HOSTS = ("example.com", "example.org", "example.net")


def cumulative(stats: NumericStats) -> list[float]:
    """Distribution function at the bin edges."""
    total = sum(stats.counts)
    return [0.0] + [x / total for x in accumulate(stats.counts)] if total else [k / len(stats.counts) for k in range(len(stats.counts) + 1)]


def array(values: list) -> Column:
    return F.array(*map(F.lit, values))


def numeric_from_uniform(u: Column, stats: NumericStats) -> Column:
    """Inverse of the piecewise-linear distribution function, kept within the observed range."""
    edges, cdf = array([float(e) for e in stats.edges]), array(cumulative(stats))
    k = F.least(F.greatest(F.size(F.filter(cdf, lambda c: c <= u)) - 1, F.lit(0)), F.lit(len(stats.counts) - 1))
    low, high, start, stop = F.get(cdf, k), F.get(cdf, k + 1), F.get(edges, k), F.get(edges, k + 1)
    share = F.when(high > low, (u - low) / (high - low)).otherwise(0.0)
    return F.least(F.greatest(start + share * (stop - start), F.lit(float(stats.min))), F.lit(float(stats.max)))


def cdf_at(value: float, stats: NumericStats) -> float:
    cdf = cumulative(stats)
    if value <= stats.edges[0]:
        return 0.0
    if value >= stats.edges[-1]:
        return 1.0
    k = bisect_right(stats.edges, value) - 1
    return cdf[k] + (cdf[k + 1] - cdf[k]) * (value - stats.edges[k]) / (stats.edges[k + 1] - stats.edges[k])


def categorical_from_uniform(u: Column, labels: list[str], weights: list[float]) -> Column:
    total = sum(weights)
    upto = [x / total for x in accumulate(weights)]
    upto[-1] = 1.0
    return F.get(array(labels), F.least(F.size(F.filter(array(upto), lambda c: c <= u)), F.lit(len(labels) - 1)))


MICROS = 1_000_000
NTZ_ZERO = "timestamp_ntz'1970-01-01'"


def micros(value: str) -> int:
    import datetime

    t = datetime.datetime.fromisoformat(value)
    return round((t - datetime.datetime(1970, 1, 1)).total_seconds() * MICROS)


def datetime_from_uniform(u: Column, low: int, high: int) -> Column:
    """Uniform between two instants in microseconds, without a time zone."""
    offset = F.least(F.lit(low) + F.floor(u * float(high - low + 1)).cast("long"), F.lit(high))
    return F.expr(NTZ_ZERO) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (offset / MICROS).cast("decimal(18,6)"))


def letters(length: Column, *parts: object) -> Column:
    """A word of a-z that depends on the parts alone."""
    digits = F.md5(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)).cast("binary"))
    letter = lambda i: F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.conv(F.substring(F.md5(F.concat(digits, i.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % 26 + 1).cast("int"), F.lit(1))
    return F.when(length <= 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), letter), ""))


def as_boolean(label: Column) -> Column:
    return F.lower(F.trim(label)).isin("true", "1", "t", "yes", "y")


def column_value(p: ColumnProfile, u: Column, condition: Condition | None, parts: tuple) -> Column:
    """A column's value from its uniform."""
    kind = p.logical_type
    whole = (lambda x: F.rint(x).cast("long")) if kind is LogicalType.INTEGER else (lambda x: x)
    if isinstance(condition, Equals):
        value = typed(condition.value, kind)
        if kind is LogicalType.INTEGER and not float(condition.value).is_integer():
            raise GenerationError(f"{p.name} holds whole numbers")
        return whole(value)
    if isinstance(condition, Members):
        labels = list(dict.fromkeys(condition.values))
        if p.categories and kind is not LogicalType.BOOLEAN:
            seen = dict(p.categories)
            return categorical_from_uniform(u, labels, [seen.get(v, 0) + 1.0 for v in labels])
        return whole(F.get(F.array(*(typed(v, kind) for v in labels)), F.least(F.floor(u * len(labels)), F.lit(len(labels) - 1)).cast("int")))
    if isinstance(condition, Between) and kind is LogicalType.DATETIME:
        low, high = sorted((micros(condition.low), micros(condition.high)))
        if p.datetime and max(low, micros(p.datetime.min)) <= min(high, micros(p.datetime.max)):
            low, high = max(low, micros(p.datetime.min)), min(high, micros(p.datetime.max))
        return datetime_from_uniform(u, low, high)
    if isinstance(condition, Between):
        low, high = sorted((float(condition.low), float(condition.high)))
        if kind is LogicalType.INTEGER:
            low, high = math.ceil(low), math.floor(high)
            if low > high:
                raise GenerationError(f"no whole number for {p.name} in its range")
        a, b = (cdf_at(low, p.numeric), cdf_at(high, p.numeric)) if p.numeric else (0.0, 0.0)
        drawn = numeric_from_uniform(a + u * (b - a), p.numeric) if b > a else low + u * (high - low)
        return whole(F.least(F.greatest(drawn, F.lit(float(low))), F.lit(float(high))))
    if p.numeric:
        return whole(numeric_from_uniform(u, p.numeric))
    if p.categories:
        label = categorical_from_uniform(u, [v for v, _ in p.categories], [float(n) for _, n in p.categories])
        return as_boolean(label) if kind is LogicalType.BOOLEAN else label
    if p.datetime:
        return datetime_from_uniform(u, micros(p.datetime.min), micros(p.datetime.max))
    if p.text:
        span = p.text.max_length - p.text.min_length + 1
        return letters((F.lit(p.text.min_length) + F.floor(u * span)).cast("int"), *parts)
    from ..plans.model import SPARK_TYPES

    return F.lit(None).cast(SPARK_TYPES[kind])


def spearman_to_pearson(rho: np.ndarray) -> np.ndarray:
    return 2 * np.sin(np.pi * rho / 6)


def nearest_psd(matrix: np.ndarray, least: float = 1e-8) -> np.ndarray:
    """Eigenvalues lifted off zero, diagonal scaled back to one."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    lifted = vectors @ np.diag(np.maximum(values, least)) @ vectors.T
    scale = 1 / np.sqrt(np.diag(lifted))
    return lifted * np.outer(scale, scale)


def copula_uniforms(df: DataFrame, profile: Profile, seed: int, skip: set[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Uniforms of correlated numeric columns: independent normals times a Cholesky factor, through the normal distribution function.

    Normals and uniforms are columns of projections of their own, as the next step refers to each of them many times.
    """
    names = [c for c in profile.numeric_columns if c not in skip]
    if len(names) < 2:
        return df, {}
    at = [profile.numeric_columns.index(c) for c in names]
    rho = np.array([[0.0 if profile.spearman[i][j] is None else profile.spearman[i][j] for j in at] for i in at])
    rho = np.clip(np.nan_to_num(rho), -1, 1)
    np.fill_diagonal(rho, 1.0)
    factor = np.linalg.cholesky(nearest_psd(spearman_to_pearson(rho))).round(12)
    df = df.select(POSITION, *(normal(seed, profile.schema.table, c, "copula", F.col(POSITION)).alias(f"__z{i}") for i, c in enumerate(names)))
    z = [F.col(f"__z{i}") for i in range(len(names))]
    df = df.select(POSITION, *(sum((z[j] * float(factor[i][j]) for j in range(1, i + 1)), z[0] * float(factor[i][0])).alias(f"__m{i}") for i in range(len(names))))
    df = df.select(POSITION, *(F.least(phi(F.col(f"__m{i}")), F.lit(1 - 2.0**-53)).alias(f"__u{i}") for i in range(len(names))))
    return df, {c: F.col(f"__u{i}") for i, c in enumerate(names)}


def formatted_kind(column: str) -> str | None:
    lowered = column.lower()
    for kind, marks in FORMATS.items():
        if any(m in lowered for m in marks):
            return kind
    if lowered == "id" or lowered.endswith("_id"):
        return "uuid"
    return "name" if any(m in lowered for m in NAMES) else None


def formatted(kind: str, *parts: object) -> Column:
    """An invented value of a kind, from the parts alone."""
    pick = lambda values, what: F.get(array(list(values)), F.floor(uniform(*parts, what) * len(values)).cast("int"))
    hexed = F.md5(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)).cast("binary"))
    if kind == "uuid":
        cut = lambda a, n: F.substring(hexed, a, n)
        return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("4"), cut(14, 3)), F.concat(F.lit("a"), cut(18, 3)), cut(21, 12))
    if kind == "email":
        return F.concat(F.lower(pick(FIRST, "f")), F.lit("."), F.lower(pick(LAST, "l")), F.lit("."), F.substring(hexed, 1, 6), F.lit("@"), pick(HOSTS, "h"))
    if kind == "phone":
        return F.concat(F.lit("+1-555-"), F.lpad(F.floor(uniform(*parts, "a") * 1000).cast("string"), 3, "0"), F.lit("-"), F.lpad(F.floor(uniform(*parts, "b") * 10000).cast("string"), 4, "0"))
    return F.concat(pick(FIRST, "f"), F.lit(" "), pick(LAST, "l"))


def draw(profile: Profile, name: str, seed: int, position: Column, attempt: Column | int = 0, uniforms: dict[str, Column] | None = None, condition: Condition | None = None, formats: bool = True) -> Column:
    """The value of a column at a position; an attempt above 0 is another draw."""
    p = profile.column(name)
    table = profile.schema.table
    again = attempt if isinstance(attempt, Column) else F.lit(attempt)
    parts = (seed, table, name, "value", again, position)
    u = (uniforms or {}).get(name)
    value = column_value(p, uniform(*parts) if u is None else u, condition, parts)
    if condition is None and formats and p.logical_type is LogicalType.STRING and p.count and (kind := formatted_kind(name)):
        value = formatted(kind, *parts)
    total = p.count + p.null_count
    if condition is None and p.null_count and total:
        value = F.when(uniform(seed, table, name, "null", position) >= p.null_count / total, value)
    return value


POSITION = "__position"
#: Rows that a task draws, as long as there are not too many tasks; values do not depend on it.
ROWS_A_TASK = 65_536


def positions(spark: SparkSession, rows: int, partitions: int | None = None, start: int = 0) -> DataFrame:
    if rows < 0:
        raise GenerationError("rows must not be negative")
    return spark.range(start, start + rows, 1, partitions or max(1, min(-(-rows // ROWS_A_TASK), 20_000))).withColumnRenamed("id", POSITION)


def synthesize(spark: SparkSession, profile: Profile, rows: int, seed: int = 0, conditions: dict[str, Condition] | None = None, copula: bool = True, formats: bool = True, keep_position: bool = False, partitions: int | None = None, start: int = 0) -> Table:
    """Rows at the positions from `start` on."""
    return rows_at(positions(spark, rows, partitions, start), profile, seed, conditions, copula, formats, keep_position)


def rows_at(at: DataFrame, profile: Profile, seed: int = 0, conditions: dict[str, Condition] | None = None, copula: bool = True, formats: bool = True, keep_position: bool = False) -> Table:
    """The rows of these positions, of a table or of a stream."""
    conditions = conditions or {}
    validate_conditions(conditions, profile.schema)
    keys = {c for c in profile.schema.primary_key} | {c for f in profile.schema.foreign_keys for c in f.columns}
    df, uniforms = copula_uniforms(at, profile, seed, keys) if copula else (at, {})
    place = F.col(POSITION)
    columns = [draw(profile, c.name, seed, place, 0, uniforms, conditions.get(c.name), formats).alias(c.name) for c in profile.schema.columns]
    return Table(df.select(*([place] if keep_position else []), *columns), profile.schema)


def generate_marginals(spark: SparkSession, profile: Profile, rows: int, seed: int = 0) -> Table:
    return synthesize(spark, profile, rows, seed, copula=False, formats=False)


def generate_faithful(spark: SparkSession, profile: Profile, rows: int, seed: int = 0, conditions: dict[str, Condition] | None = None, guard: DataFrame | None = None) -> GatedTable:
    """Generate, redraw cells that collide with the guard (the profile's own by default), and seal."""
    guard = guard_of(spark, profile) if guard is None else guard
    made = synthesize(spark, profile, rows, seed, conditions, keep_position=True)
    guarded = [c for c in profile.sensitive if c not in (conditions or {})]
    if guard is not None and guarded:
        redraw = lambda c, attempt: draw(profile, c, seed, F.col(POSITION), attempt)
        made = enforce_leakage_gate(made, guard, guarded, profile.salt or "", redraw)
    table = made.with_df(made.df.drop(POSITION))
    return gate(table, guard, [*profile.sensitive], profile.salt)


