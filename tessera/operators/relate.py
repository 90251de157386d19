"""Related tables: topological order, keys, foreign keys by position, shared keys, fixtures, cross-table correlation, subsets and delta refresh."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.random import normal, phi_inverse, uniform
from ..plans.model import SPARK_TYPES, EngineError, FixtureError, GenerationError, KeyspaceError, LogicalType, Profile, Table, TableSchema
from ..sources.scratch import stored
from .generate import POSITION, synthesize
from .quantiles import among_smallest


def topological_order(schemas: dict[str, TableSchema]) -> list[str]:
    """Parents before children, ties by name; self references and references to other sets don't count."""
    parents = {t: {f.referred_table for f in s.foreign_keys if f.referred_table in schemas and f.referred_table != t} for t, s in schemas.items()}
    order: list[str] = []
    while parents:
        ready = sorted(t for t, p in parents.items() if not p)
        if not ready:
            raise GenerationError(f"foreign keys form a cycle: {sorted(parents)}")
        order += ready
        parents = {t: p - set(ready) for t, p in parents.items() if t not in ready}
    return order


def fk_orphans(child: DataFrame, columns: list[str], parent: DataFrame, referred: list[str]) -> DataFrame:
    """Child rows whose key has no parent; a null key is no orphan."""
    keys = parent.select(*(F.col(r).alias(f"__p{k}") for k, r in enumerate(referred)))
    present = reduce(Column.__and__, (F.col(c).isNotNull() for c in columns))
    return child.where(present).join(keys, [F.col(c) == F.col(f"__p{k}") for k, c in enumerate(columns)], "left_anti")


def duplicate_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def position_key(position: Column, base: int = 0) -> Column:
    return position + F.lit(base)


def parent_position(seed: int, child: str, key: str, position: Column, parent_rows: int) -> Column:
    """The parent that a child row refers to: any, by its own position. Parents are never read."""
    return F.floor(uniform(seed, child, key, "fk", position) * parent_rows).cast("long")


def coprime_step(capacity: int, seed: int) -> int:
    """A step near the golden section of the capacity that has no factor in common with it."""
    step = max(1, int(capacity * 0.6180339887) + seed % 97)
    while math.gcd(step, capacity) != 1:
        step += 1
    return step


def junction_positions(position: Column, sizes: list[int], rows: int, seed: int = 0) -> list[Column]:
    """Distinct tuples of parent positions for distinct positions: an affine bijection of all slots, read as digits of mixed radix."""
    capacity = math.prod(sizes)
    if rows > capacity:
        raise GenerationError(f"{rows} rows do not fit {capacity} distinct key tuples")
    slot = F.pmod(position.cast("decimal(38,0)") * F.lit(coprime_step(capacity, seed)).cast("decimal(19,0)") + seed, F.lit(capacity).cast("decimal(19,0)")).cast("long")
    out = []
    for n in reversed(sizes):
        out.append(F.pmod(slot, F.lit(n)))
        slot = ((slot - F.pmod(slot, F.lit(n))).cast("decimal(20,0)") / F.lit(n).cast("decimal(20,0)")).cast("long")  # exact, whatever the capacity
    return out[::-1]


def unique_values(df: DataFrame, column: str, order: str) -> DataFrame:
    """The first of equal values stays, later ones get -1, -2, ...; suffixes that meet a real value are numbered on until nothing repeats."""
    for _ in range(20):
        nth = F.row_number().over(Window.partitionBy(column).orderBy(order)) - 1
        repeated = df.withColumn("__nth", F.when(F.col(column).isNotNull(), nth).otherwise(0))
        df = repeated.withColumn(column, F.when(F.col("__nth") > 0, F.concat(F.col(column).cast("string"), F.lit("-"), F.col("__nth").cast("string"))).otherwise(F.col(column).cast("string"))).drop("__nth")
        if duplicate_keys(df.where(F.col(column).isNotNull()), [column]).isEmpty():
            return df
    raise GenerationError(f"{column} could not be made unique")


def key_value(position: Column, kind: LogicalType) -> Column:
    return position.cast(SPARK_TYPES[kind])


def generate_related(spark: SparkSession, profiles: dict[str, Profile], rows: dict[str, int] | int, seed: int = 0, bases: dict[str, int] | None = None, keep_position: bool = False, block: tuple[str, int, int] | None = None) -> dict[str, Table]:
    """A lazy table for each profile. Single-column parent keys are arithmetic on positions, so a foreign key needs no join.

    With a block (table, first position, rows) that table has those positions alone, the same rows as in the whole.
    """
    count = {t: rows if isinstance(rows, int) else rows[t] for t in profiles}
    schemas = {t: p.schema for t, p in profiles.items()}
    bases = bases or {}
    made: dict[str, Table] = {}
    for name in topological_order(schemas):
        schema, at = schemas[name], F.col(POSITION)
        start, size = block[1:] if block and block[0] == name else (0, count[name])
        df = synthesize(spark, profiles[name], size, seed, keep_position=True, start=start).df
        referring = {c for f in schema.foreign_keys if f.referred_table in schemas for c in f.columns}
        own = [c for c in schema.primary_key if c not in referring]
        if own:
            df = df.withColumn(own[-1], key_value(position_key(at, bases.get(name, 0)), schema.column(own[-1]).logical_type))
        junction = [f for f in schema.foreign_keys if f.referred_table in schemas and set(f.columns) <= set(schema.primary_key)] if schema.primary_key and not own else []
        places = dict(zip([f.columns for f in junction], junction_positions(at, [count[f.referred_table] for f in junction], count[name], seed), strict=True)) if junction else {}
        for f in sorted((f for f in schema.foreign_keys if f.referred_table in schemas), key=lambda f: f.referred_table == name):
            parent, n = schemas[f.referred_table], count[f.referred_table]
            if not n:
                continue
            where = places.get(f.columns, parent_position(seed, name, f.columns[0], at, n))
            parent_keys = [c for c in parent.primary_key if c not in {x for g in parent.foreign_keys if g.referred_table in schemas for x in g.columns}]
            if len(f.columns) == 1 and parent_keys and f.referred_columns[0] == parent_keys[-1]:
                df = df.withColumn(f.columns[0], key_value(position_key(where, bases.get(f.referred_table, 0)), schema.column(f.columns[0]).logical_type))
            else:  # composite or natural keys: look the parent's row up by position
                if block and block[0] == f.referred_table == name:
                    raise GenerationError(f"{name} refers to itself by a key that no position gives and can't be made in blocks")
                lookup = (df if f.referred_table == name else made[f.referred_table].df).select(F.col(POSITION).alias("__at"), *(F.col(r).alias(f"__{c}") for c, r in zip(f.columns, f.referred_columns, strict=True)))
                df = df.withColumn("__at", where).join(lookup, "__at").drop("__at")
                for c in f.columns:
                    df = df.withColumn(c, F.col(f"__{c}")).drop(f"__{c}")
        for u in schema.unique_constraints:
            if len(u) == 1 and u[0] not in {*schema.primary_key, *referring} and schema.column(u[0]).logical_type is LogicalType.STRING:
                df = unique_values(df, u[0], POSITION)
        made[name] = Table(df.select(POSITION, *schema.names), schema)
    return made if keep_position else {t: v.with_df(v.df.drop(POSITION)) for t, v in made.items()}


def shared_key_bases(tables: dict[str, tuple[list[str], int, int]]) -> dict[tuple[str, str], int]:
    """First key of each shared column of (columns, reserved block, rows): columns of a table take disjoint ranges above its block."""
    out = {}
    for name, (columns, reserved, rows) in tables.items():
        if reserved < 0:
            raise KeyspaceError(f"{name}: negative block")
        for k, c in enumerate(columns):
            out[name, c] = reserved + k * rows
    return out


def remap_keys(child: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace a key by (old, new); a non-null key without a new one is an error."""
    joined = child.join(mapping.select(F.col("old").alias("__old"), F.col("new").alias("__new")), F.col(column) == F.col("__old"), "left")
    if not joined.where(F.col(column).isNotNull() & F.col("__new").isNull()).isEmpty():
        raise KeyspaceError(f"{column} has keys without a new one")
    return joined.select(*(F.col("__new").alias(c) if c == column else F.col(c) for c in child.columns))


def overlay_fixtures(table: Table, fixtures: list[dict], reserved: int = 0, parents: dict[str, DataFrame] | None = None) -> Table:
    """Rows that are pinned word for word, ahead of generated ones; a column is_fixture tells them apart."""
    schema = table.schema
    for row in fixtures:
        if unknown := set(row) - set(schema.names):
            raise FixtureError(f"{schema.table} has no columns {sorted(unknown)}")
    single = schema.primary_key[0] if len(schema.primary_key) == 1 else None
    if single and schema.column(single).logical_type is LogicalType.INTEGER:
        for row in fixtures:
            if row.get(single) is None or not 0 <= int(row[single]) < reserved:
                raise FixtureError(f"{schema.table}.{single} of a fixture lies outside [0, {reserved})")
    spark = table.df.sparkSession
    raw = spark.createDataFrame([tuple(None if r.get(c) is None else str(r[c]) for c in schema.names) for r in fixtures], ", ".join(f"`{c}` string" for c in schema.names))
    cast = raw.select(*(F.col(c.name).try_cast(table.df.schema[c.name].dataType).alias(c.name) for c in schema.columns))
    for c in schema.names:
        if any(r.get(c) is not None for r in fixtures) and cast.where(F.col(c).isNotNull()).count() != sum(r.get(c) is not None for r in fixtures):
            raise FixtureError(f"{schema.table}.{c} of a fixture has another type")
    whole = cast.withColumn("is_fixture", F.lit(True)).unionByName(table.df.withColumn("is_fixture", F.lit(False)))
    if schema.primary_key and not duplicate_keys(whole, list(schema.primary_key)).isEmpty():
        raise FixtureError(f"{schema.table}: a fixture repeats a key")
    for f in schema.foreign_keys:
        parent = (parents or {}).get(f.referred_table)
        if parent is not None and not fk_orphans(cast, list(f.columns), parent, list(f.referred_columns)).isEmpty():
            raise FixtureError(f"{schema.table}: a fixture refers to no row of {f.referred_table}")
    return table.with_df(whole)


def induce_rank_correlation(child: DataFrame, order: str, column: str, reference: str, rho: float, seed: int, name: str) -> DataFrame:
    """The column's values dealt anew so that their ranks follow the reference at about rho; which values there are does not change.

    Ranks are by row number over the whole column, dealt by range partitions; null targets stay where they are, null references count as noise alone.
    """
    if not -1 <= rho <= 1:
        raise GenerationError("rho lies between -1 and 1")
    present = child.where(F.col(column).isNotNull())
    share = global_rank(present.where(F.col(reference).isNotNull()).select(order, F.col(reference).alias("x")), ["x", order], "k")
    n = share.agg(F.count("*").alias("__n"))
    latent = present.select(order, column).join(share.select(order, "k"), order, "left").join(F.broadcast(n))
    noise = normal(seed, name, column, "noise", F.col(order))
    score = F.when(F.col("k").isNull(), noise).otherwise(rho * phi_inverse((F.col("k") - 0.5) / F.col("__n")) + math.sqrt(1 - rho * rho) * noise)
    wanted = global_rank(latent.select(order, score.alias("x")), ["x", order], "k").select(order, "k")
    values = global_rank(present.select(order, F.col(column).alias("__value")), ["__value", order], "k").select("k", "__value")
    dealt = wanted.join(values, "k").select(order, "__value")
    return child.join(dealt, order, "left").select(*(F.col("__value").alias(c) if c == column else F.col(c) for c in child.columns))


def global_rank(df: DataFrame, by: list[str], out: str) -> DataFrame:
    """Row number over the whole table in two passes: range partitions, written once, and the number of rows in earlier ones.

    The borders of range partitions are sampled, so that computing them twice may deal rows differently.
    """
    dealt = stored(df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__rows"))
    before = sizes.select("__part", F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return dealt.withColumn("__k", F.row_number().over(Window.partitionBy("__part").orderBy(*by))).join(F.broadcast(before), "__part").withColumn(out, F.col("__k") + F.col("__before")).drop("__part", "__k", "__before")


# ---------------------------------------------------------------- subsets


@dataclass(frozen=True)
class Edge:
    child: str
    column: str
    parent: str
    referred: str


def edges_of(schemas: dict[str, TableSchema]) -> list[Edge]:
    out = []
    for t, s in schemas.items():
        for f in s.foreign_keys:
            if f.referred_table in schemas:
                if len(f.columns) != 1:
                    raise EngineError(f"{t}: subsets need single-column foreign keys")
                out.append(Edge(t, f.columns[0], f.referred_table, f.referred_columns[0]))
    return out


def sample_root(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """round(n * fraction) rows, one at least, by the digest of seed and key."""
    if not 0 < fraction <= 1:
        raise EngineError("a fraction lies above 0 and goes up to 1")
    n = df.count()
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return df.where(among_smallest(df.select(digest.alias("key"), F.col(key).alias("tie")), max(1, round(n * fraction)), digest, F.col(key)))


class Closure:
    """Rows of tables that key values select: for each table and column, a written set of distinct values. A row is kept if any of its
    table's sets holds its value, so equal rows stay as many as they are, and tables need no key of their own."""

    def __init__(self, tables: dict[str, Table]) -> None:
        self.tables = tables
        self.sets: dict[str, dict[str, tuple[DataFrame, int]]] = {t: {} for t in tables}
        self.version = dict.fromkeys(tables, 0)
        self.seen: dict[tuple, int] = {}

    def rows(self, name: str) -> DataFrame:
        df, sets = self.tables[name].df, list(self.sets[name].items())
        if len(sets) == 1:
            return df.join(sets[0][1][0], F.col(sets[0][0]) == F.col("__key"), "left_semi")
        for k, (column, (keys, _)) in enumerate(sets):
            df = df.join(keys.select(F.col("__key").alias(f"__key{k}")), F.col(column) == F.col(f"__key{k}"), "left")
        any_set = reduce(Column.__or__, (F.col(f"__key{k}").isNotNull() for k in range(len(sets))))
        return df.where(any_set).select(*self.tables[name].df.columns)

    def add(self, name: str, column: str, values: DataFrame) -> None:
        """Let these values of a column select rows as well."""
        keys = values.toDF("__key").where("__key is not null")
        old = self.sets[name].get(column)
        keys = stored((keys if old is None else keys.unionAll(old[0])).distinct(), "keys")
        if (n := keys.count()) > (old[1] if old else 0):
            self.sets[name][column] = (keys, n)
            self.version[name] += 1

    def follow(self, source: str, taken: str, name: str, column: str) -> bool:
        """Select by the values that kept rows of the source have, if these rows may have changed since the last time."""
        step = (source, taken, name, column)
        if not self.sets[source] or self.seen.get(step) == self.version[source]:
            return False
        self.seen[step] = self.version[source]
        before = self.version[name]
        self.add(name, column, self.rows(source).select(taken))
        return self.version[name] > before


def subset_tables(tables: dict[str, Table], root: str, fraction: float, seed: int = 0) -> dict[str, DataFrame]:
    """The sampled root rows, all that hangs on them, and all that those refer to, to a fixpoint.

    Downwards, rows of the root's descendants are kept that refer to a kept row of the root or of a descendant; upwards, every row
    that a kept row refers to. Rows that are kept for being referred to bring their own children only within descendants.
    """
    schemas = {t: v.schema for t, v in tables.items()}
    if root not in tables:
        raise EngineError(f"no table {root}")
    if len(schemas[root].primary_key) != 1:
        raise EngineError(f"{root}: subsets need a primary key of one column")
    order, edges = topological_order(schemas), edges_of(schemas)
    below: set[str] = set()
    for t in order:
        below |= {t} if any(e.child == t != e.parent and e.parent in below | {root} for e in edges) else set()
    closure = Closure(tables)
    key = schemas[root].primary_key[0]
    closure.add(root, key, sample_root(tables[root].df, key, fraction, seed).select(key))
    grows = True
    while grows:
        grows = False
        for t in order:
            for e in (e for e in edges if e.child == t and t in below and e.parent in below | {root}):
                grows |= closure.follow(e.parent, e.referred, t, e.column)
        for t in reversed(order):
            for e in (e for e in edges if e.child == t):
                # rows that only this reference selects refer to rows that are kept
                if set(closure.sets[t]) != {e.column} or t not in below or e.parent not in below | {root}:
                    grows |= closure.follow(t, e.column, e.parent, e.referred)
    return {t: closure.rows(t) for t in order if closure.sets[t]}


# ---------------------------------------------------------------- delta refresh


def dirty_tables(old: dict[str, str], new: dict[str, str], schemas: dict[str, TableSchema], keys_changed: set[str], correlated: dict[str, set[str]]) -> set[str]:
    """Tables to make anew: changed ones, children of those whose keys changed, and what is correlated with a dirty table, until nothing is added."""
    dirty = {t for t in new if old.get(t) != new[t]}
    dirty |= {t for t, s in schemas.items() if any(f.referred_table in keys_changed for f in s.foreign_keys)}
    while more := {t for t, parents in correlated.items() if parents & dirty} - dirty:
        dirty |= more
    return dirty & set(new)
