"""Controlled faults: mutators that change cells, rows or the schema of a table and list all they did in a manifest.

Cells are chosen by a digest of seed, mutator, column and row, so a choice does not depend on partitions; exactly k are taken by a threshold on
the k-th smallest digest, so a mutator is a projection of the table and never joins it. A manifest is a DataFrame (mutator, row, column, fault_type, value); structural faults have no row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import model
from ..plans.model import NUMERIC, TEXT, ChaosError, LogicalType, Table
from .quantiles import among_smallest

ROW = "row_id"
MANIFEST = "mutator string, row long, column string, fault_type string, value string"
SHOWN = 80

# fixed values: what faulty cells hold
NUMBER_TOKENS = ("N/A", "null", "oops", "#ERROR", "not_a_number")
DATE_TOKENS = ("2021-13-45", "0000-00-00", "not-a-date", "31/02/2021", "10000-01-01")
ENCODING_TOKENS = ("\x00\x01\x02", "Ã©Ã¨Ã¼", "���", "â€œbrokenâ€\u009d")
ORPHAN_GAP = 1_000_000_001


def cell_count(proportion: float, available: int) -> int:
    """Half to even, one at least if any is wanted."""
    if not 0 <= proportion <= 1:
        raise ChaosError("a proportion lies between 0 and 1")
    return min(available, max(1, round(proportion * available))) if proportion > 0 and available else 0


def order_key(*parts: object) -> Column:
    return F.md5(F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts)).cast("binary"))


def chosen(df: DataFrame, where: Column, k: int, available: int, *parts: object) -> Column:
    """Whether a row is one of the k with the smallest digests among those that qualify, of which so many are available."""
    if k >= available:
        return where
    key = order_key(*parts, F.col(ROW).cast("string"))
    return where & among_smallest(df.where(where).select(key.alias("key"), F.col(ROW).alias("tie")), k, key, F.col(ROW))


def pick(tokens: tuple[str, ...], *parts: object) -> Column:
    n = F.conv(F.substring(order_key(*parts, "token", F.col(ROW).cast("string")), 1, 8), 16, 10).cast("long")
    return F.get(F.array(*map(F.lit, tokens)), (n % len(tokens)).cast("int"))


@dataclass(frozen=True)
class Mutator:
    """A mutator: name, proportion of cells and target columns; `structural` ones change the schema."""

    name: str = ""
    proportion: float = 0.05
    columns: tuple[str, ...] = ()
    structural: bool = False
    types: frozenset[LogicalType] | None = None

    def targets(self, table: Table) -> list[str]:
        names = list(self.columns) or [c.name for c in table.schema.columns if self.types is None or c.logical_type in self.types]
        for n in names:
            if n not in table.schema.names:
                raise ChaosError(f"{self.name}: no column {n}")
            if self.types is not None and table.schema.column(n).logical_type not in self.types:
                raise ChaosError(f"{self.name}: {n} has another type")
        return names

    def apply(self, table: Table, seed: int) -> tuple[Table, DataFrame]:
        raise NotImplementedError


def empty_manifest(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], MANIFEST)


def entry_of(rows: DataFrame, mutator: str, column: str, value: Column) -> DataFrame:
    shown = F.substring(value.cast("string"), 1, SHOWN)
    return rows.select(F.lit(mutator).alias("mutator"), F.col(ROW).alias("row"), F.lit(column).alias("column"), F.lit(mutator).alias("fault_type"), shown.alias("value"))


def union_all(parts: list[DataFrame], df: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else empty_manifest(df)


@dataclass(frozen=True)
class CellMutator(Mutator):
    """Replaces chosen non-null cells; faulty text in a column of another type turns the column into text."""

    textual: bool = True

    def value(self, table: Table, column: str, seed: int) -> Column:
        raise NotImplementedError

    def prepare(self, table: Table, columns: list[str]) -> dict:
        return {}

    def apply(self, table: Table, seed: int) -> tuple[Table, DataFrame]:
        names = self.targets(table)
        if not names:
            return table, empty_manifest(table.df)
        facts = table.df.agg(*(F.count(c).alias(c) for c in names)).first()
        self.__dict__["facts"] = self.prepare(table, names)
        df, entries = table.df, []
        for c in names:
            k = cell_count(self.proportion, facts[c])
            if not k:
                continue
            hit = chosen(table.df, F.col(c).isNotNull(), k, facts[c], seed, self.name, c)
            new = self.value(table, c, seed)
            old = F.col(c).cast("string") if self.textual else F.col(c)
            df = df.withColumn(c, F.when(hit, new).otherwise(old))
            entries.append(entry_of(table.df.where(hit), self.name, c, new))
        return table.with_df(df.select(ROW, *table.schema.names)), union_all(entries, table.df)


@dataclass(frozen=True)
class Outlier(CellMutator):
    name: str = "outlier"
    types: frozenset = frozenset(NUMERIC | {LogicalType.DATETIME})
    textual: bool = False
    multiplier: float = 3.0

    def prepare(self, table: Table, columns: list[str]) -> dict:
        row = table.df.agg(*(F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in columns)).first()
        return {c: (row[c]["low"], row[c]["high"]) for c in columns}

    def value(self, table: Table, column: str, seed: int) -> Column:
        low, high = self.facts[column]
        up = F.conv(F.substring(order_key(seed, self.name, column, "side", F.col(ROW).cast("string")), 1, 1), 16, 10).cast("int") < 8
        kind = table.schema.column(column).logical_type
        if kind is LogicalType.DATETIME:
            import datetime

            span = (high - low) or datetime.timedelta(days=1)
            clip = lambda t: max(min(t, 8e9), -8e9)  # noqa: E731  within what timestamps hold
            step = F.make_dt_interval(secs=F.lit(clip(span.total_seconds() * self.multiplier)))
            return F.when(up, F.lit(high).cast("timestamp_ntz") + step).otherwise(F.lit(low).cast("timestamp_ntz") - step)
        span = (high - low) or abs(high) or 1
        a, b = high + self.multiplier * span, low - self.multiplier * span
        if kind is LogicalType.INTEGER:
            a, b = min(max(round(a), high + 1), 2**63 - 1), max(min(round(b), low - 1), -(2**63))
            return F.when(up, F.lit(int(a)).cast("long")).otherwise(F.lit(int(b)).cast("long"))
        return F.when(up, F.lit(float(a))).otherwise(F.lit(float(b)))


@dataclass(frozen=True)
class Tokens(CellMutator):
    tokens: tuple[str, ...] = ()

    def value(self, table: Table, column: str, seed: int) -> Column:
        return pick(self.tokens, seed, self.name, column)


def text_in_numeric(**k) -> Mutator:
    return Tokens(**{"name": "text_in_numeric", "types": frozenset(NUMERIC), "tokens": NUMBER_TOKENS} | k)


def invalid_date(**k) -> Mutator:
    return Tokens(**{"name": "invalid_date", "types": frozenset({LogicalType.DATETIME}), "tokens": DATE_TOKENS} | k)


def broken_encoding(**k) -> Mutator:
    return Tokens(**{"name": "broken_encoding", "types": frozenset(TEXT), "tokens": ENCODING_TOKENS} | k)


@dataclass(frozen=True)
class OversizedString(CellMutator):
    name: str = "oversized_string"
    types: frozenset = frozenset(TEXT)
    size: int = 10_000

    def value(self, table: Table, column: str, seed: int) -> Column:
        if not 0 < self.size <= 10_000_000:
            raise ChaosError("a size lies between 1 and 10,000,000")
        return F.repeat(F.lit("A"), F.lit(self.size))


@dataclass(frozen=True)
class IllegalNull(CellMutator):
    name: str = "illegal_null"
    textual: bool = False

    def targets(self, table: Table) -> list[str]:
        return super().targets(table) if self.columns else [c.name for c in table.schema.columns if not c.nullable]

    def value(self, table: Table, column: str, seed: int) -> Column:
        return F.lit(None)


def structural_entry(table: Table, name: str, column: str, value: str | None = None) -> DataFrame:
    return table.df.sparkSession.createDataFrame([(name, None, column, name, value)], MANIFEST)


def without(schema: model.TableSchema, name: str) -> model.TableSchema:
    return replace(
        schema, columns=tuple(c for c in schema.columns if c.name != name), primary_key=() if name in schema.primary_key else schema.primary_key, foreign_keys=tuple(f for f in schema.foreign_keys if name not in f.columns),
        unique_constraints=tuple(u for u in schema.unique_constraints if name not in u), indexes=tuple(i for i in schema.indexes if name not in i.columns),
    )


def renamed(schema: model.TableSchema, old: str, new: str) -> model.TableSchema:
    swap = lambda names: tuple(new if n == old else n for n in names)
    refer = lambda f: replace(f, columns=swap(f.columns), referred_columns=swap(f.referred_columns) if f.referred_table == schema.table else f.referred_columns)
    return replace(
        schema, columns=tuple(replace(c, name=new) if c.name == old else c for c in schema.columns), primary_key=swap(schema.primary_key), foreign_keys=tuple(map(refer, schema.foreign_keys)),
        unique_constraints=tuple(map(swap, schema.unique_constraints)), indexes=tuple(replace(i, columns=swap(i.columns)) for i in schema.indexes),
    )


@dataclass(frozen=True)
class Structural(Mutator):
    structural: bool = True

    def first(self, table: Table) -> list[str]:
        return self.targets(table) if self.columns else table.schema.names[:1]


@dataclass(frozen=True)
class MissingField(Structural):
    name: str = "missing_field"

    def apply(self, table: Table, seed: int) -> tuple[Table, DataFrame]:
        out, entries = table, []
        for c in self.first(table):
            out = Table(out.df.drop(c), without(out.schema, c))
            entries.append(structural_entry(table, self.name, c))
        return out, union_all(entries, table.df)


@dataclass(frozen=True)
class ExtraField(Structural):
    name: str = "extra_field"
    field: str = "chaos_extra"
    content: str = "chaos"

    def apply(self, table: Table, seed: int) -> tuple[Table, DataFrame]:
        if self.field in table.schema.names:
            raise ChaosError(f"{self.field} exists already")
        schema = replace(table.schema, columns=(*table.schema.columns, model.Column(self.field, LogicalType.STRING)))
        return Table(table.df.withColumn(self.field, F.lit(self.content)), schema), structural_entry(table, self.name, self.field, self.content)


@dataclass(frozen=True)
class RenamedColumn(Structural):
    name: str = "renamed_column"

    def apply(self, table: Table, seed: int) -> tuple[Table, DataFrame]:
        out, entries = table, []
        for c in self.first(table):
            new = f"{c}__renamed"
            if new in out.schema.names:
                raise ChaosError(f"{new} exists already")
            out = Table(out.df.withColumnRenamed(c, new), renamed(out.schema, c, new))
            entries.append(structural_entry(table, self.name, c, new))
        return out, union_all(entries, table.df)


@dataclass(frozen=True)
class ChangedType(Structural):
    """Changes what the schema says, not the data."""

    name: str = "changed_type"

    def apply(self, table: Table, seed: int) -> tuple[Table, DataFrame]:
        schema, entries = table.schema, []
        for c in self.first(table):
            kind = LogicalType.STRING if schema.column(c).logical_type in NUMERIC else LogicalType.INTEGER
            schema = replace(schema, columns=tuple(replace(x, logical_type=kind) if x.name == c else x for x in schema.columns))
            entries.append(structural_entry(table, self.name, c, kind.value))
        return Table(table.df, schema), union_all(entries, table.df)


@dataclass(frozen=True)
class DuplicateKeys(Mutator):
    """The key of the first row with a whole key is copied into k other rows, for each key and unique group."""

    name: str = "duplicate_keys"
    proportion: float = 0.1

    def groups(self, table: Table) -> list[tuple[str, ...]]:
        s = table.schema
        return [self.columns] if self.columns else [g for g in (s.primary_key, *s.unique_constraints) if g] or [tuple(s.names[:1])]

    def apply(self, table: Table, seed: int) -> tuple[Table, DataFrame]:
        df, entries, rows = table.df, [], table.df.count()
        for g in self.groups(table):
            self.targets(Table(table.df, table.schema))
            whole = reduce(Column.__and__, (F.col(c).isNotNull() for c in g))
            source = table.df.where(whole).agg(F.min_by(F.struct(ROW, *g), ROW).alias("s")).first()["s"]
            k = cell_count(self.proportion, rows - 1)
            if source is None or not k:
                continue
            hit = chosen(table.df, F.col(ROW) != source[ROW], k, rows - 1, seed, self.name, *g)
            for c in g:
                df = df.withColumn(c, F.when(hit, F.lit(source[c])).otherwise(F.col(c)))
                entries.append(entry_of(table.df.where(hit), self.name, c, F.lit(str(source[c]))))
        return table.with_df(df.select(ROW, *table.schema.names)), union_all(entries, table.df)


@dataclass(frozen=True)
class OrphanFk(Mutator):
    """Foreign keys that point to nothing: beyond the largest number, or a text that no parent has."""

    name: str = "orphan_fk"
    proportion: float = 0.1

    def apply(self, table: Table, seed: int) -> tuple[Table, DataFrame]:
        names = list(self.columns) or [c for f in table.schema.foreign_keys for c in f.columns] or table.schema.names[:1]
        replace(self, columns=tuple(names)).targets(table)
        facts = table.df.agg(*(F.struct(F.count(c).alias("n"), F.max(c).alias("high")).alias(c) for c in names)).first()
        df, entries = table.df, []
        for c in names:
            k, high = cell_count(self.proportion, facts[c]["n"]), facts[c]["high"]
            if not k:
                continue
            numeric = table.schema.column(c).logical_type in NUMERIC
            value = F.lit(min(high + ORPHAN_GAP, 2**63 - 1) if isinstance(high, int) else high + 1e9) if numeric else F.concat(F.lit("__ORPHAN__"), F.col(ROW).cast("string"))
            hit = chosen(table.df, F.col(c).isNotNull(), k, facts[c]["n"], seed, self.name, c)
            df = df.withColumn(c, F.when(hit, value).otherwise(F.col(c)))
            entries.append(entry_of(table.df.where(hit), self.name, c, value))
        return table.with_df(df.select(ROW, *table.schema.names)), union_all(entries, table.df)


REGISTRY: dict[str, Callable[..., Mutator]] = {
    "outlier": Outlier, "text_in_numeric": text_in_numeric, "invalid_date": invalid_date, "broken_encoding": broken_encoding, "oversized_string": OversizedString, "illegal_null": IllegalNull,
    "missing_field": MissingField, "extra_field": ExtraField, "renamed_column": RenamedColumn, "changed_type": ChangedType, "duplicate_keys": DuplicateKeys, "orphan_fk": OrphanFk,
}


def resolve_mutators(specs: list[tuple[str, dict]], registry: dict[str, Callable[..., Mutator]] | None = None, proportion: float | None = None) -> list[Mutator]:
    known = registry or REGISTRY
    out = []
    for name, params in specs:
        if name not in known:
            raise ChaosError(f"no mutator {name}")
        params = {k: tuple(v) if isinstance(v, list) else v for k, v in params.items()}
        if proportion is not None:
            params["proportion"] = proportion
        try:
            out.append(known[name](**params))
        except TypeError as e:
            raise ChaosError(f"{name}: {e}") from e
    return out


def with_row_ids(table: Table, order: list[str]) -> Table:
    """Row numbers from 0 in the given order, by range partitions and their sizes."""
    from .relate import global_rank

    return table.with_df(global_rank(table.df, order, "__n").withColumn(ROW, F.col("__n") - 1).select(ROW, *table.schema.names))


def apply_chaos(table: Table, mutators: list[Mutator], seed: int) -> tuple[Table, DataFrame]:
    """A chain of mutators; the input is never changed. The table has the column row_id."""
    manifests = []
    for k, m in enumerate(mutators):
        table, manifest = m.apply(table, seed * 1000 + k)
        manifests.append(manifest)
    return table, union_all(manifests, table.df)


def apply_policy(table: Table, specs: list[tuple[str, dict]], seed: int, mode: str = "mixed", rate: float = 0.1, confirmed: bool = False) -> tuple[Table, DataFrame]:
    """`mixed` corrupts a share of the rows, `fully_chaotic` all; with foreign keys the latter wants a confirmation. At rate 0 nothing is corrupted."""
    if mode not in ("mixed", "fully_chaotic"):
        raise ChaosError(f"no mode {mode}")
    mutators = resolve_mutators(specs, proportion=1.0)
    if mode == "fully_chaotic":
        if table.schema.foreign_keys and not confirmed:
            raise ChaosError("a table with foreign keys is corrupted as a whole only when that is confirmed")
        return apply_chaos(table, mutators, seed)
    if any(m.structural for m in mutators):
        raise ChaosError("mixed chaos keeps the schema")
    made, manifest = apply_chaos(table, mutators, seed)
    k = round(rate * table.df.count())
    if rate <= 0 or not k:
        return table, empty_manifest(table.df)
    rows = manifest.select(F.col("row").alias(ROW)).distinct()
    kept = rows.where(chosen(rows, F.lit(True), k, rows.count(), seed, "policy")).withColumn("__kept", F.lit(True))
    types = {f.name: f.dataType for f in made.df.schema}
    base = table.df.select(ROW, *(F.col(c).cast(types[c]).alias(f"__{c}") for c in table.schema.names))
    mixed = made.df.join(base, ROW).join(kept, ROW, "left").select(ROW, *(F.when(F.col("__kept"), F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in table.schema.names))
    return table.with_df(mixed), manifest.join(kept.select(F.col(ROW).alias("row")), "row", "left_semi").select("mutator", "row", "column", "fault_type", "value")


def cells_of(base: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """(row, column, same, value) of all cells of rows that both have: whether they are the same, nulls being equal to nulls, and the later text."""
    right = other.select(ROW, *(F.col(c).cast("string").alias(f"__{c}") for c in columns))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").eqNullSafe(F.col(f"__{c}")).alias("same"), F.col(f"__{c}").alias("value")) for c in columns))
    return base.join(right, ROW).select(F.col(ROW).alias("row"), F.inline(cells))


def changed_cells(base: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """(row, column, value) of cells that differ."""
    return cells_of(base, other, columns).where(~F.col("same")).select("row", "column", "value")


@dataclass(frozen=True)
class Audit:
    valid: bool
    unlisted: int
    absent: int
    rows_changed: bool
    structural: tuple[str, ...]


def audit_manifest(base: Table, other: Table, manifest: DataFrame) -> Audit:
    """Whether the manifest lists all changes and only changes, in both directions; a listed cell is excused if it holds the recorded value."""
    before, after = set(base.schema.names), set(other.schema.names)
    listed = {(r["fault_type"], r["column"]) for r in manifest.where("row is null").select("fault_type", "column").collect()}  # a row per column
    told = {c for _, c in listed} | {f"{c}__renamed" for t, c in listed if t == "renamed_column"}
    retyped = {c for c in before & after if base.schema.column(c).logical_type is not other.schema.column(c).logical_type}
    wrong = sorted(((before ^ after) | retyped) - told) + sorted(c for t, c in listed if t == "changed_type" and c not in retyped)
    common = [c for c in base.schema.names if c in after]
    cells = manifest.where("row is not null").select("row", "column", F.col("value").alias("recorded")).distinct().withColumn("listed", F.lit(True))
    seen = cells_of(base.df, other.df, common).withColumn("now", F.substring("value", 1, SHOWN)).select("row", "column", "same", "now")
    # a row for each changed cell and for each listed one that is there; listed cells that are not there come with nulls
    held = seen.join(cells, ["row", "column"], "full").where(~F.col("same") | F.col("listed"))
    held = held.groupBy("row", "column").agg(F.max("listed").alias("listed"), F.max(~F.col("same")).alias("changed"), F.max(F.col("listed") & F.col("same").isNotNull() & F.col("now").eqNullSafe(F.col("recorded"))).alias("excused"))
    listed_not = ~F.coalesce("listed", F.lit(False))
    untouched = ~F.coalesce("changed", F.lit(False)) & ~F.coalesce("excused", F.lit(False))
    sums = held.agg(F.count_if(listed_not).alias("unlisted"), F.count_if(~listed_not & untouched).alias("absent")).first()
    unlisted, missing = sums["unlisted"], sums["absent"]
    rows = base.df.count() != other.df.count()
    return Audit(not (unlisted or missing or rows or wrong), unlisted, missing, rows, tuple(wrong))
