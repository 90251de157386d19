"""Whole databases from a specification: generate, correlate, key, pin, check, seal, load and report."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, relate
from ..operators.generate import POSITION, draw
from ..operators.guard import enforce_leakage_gate, gate, guard_of, scan_and_gate
from ..operators.profile import classify_sensitive_columns
from ..sources.tables import load_stream
from .model import EngineError, GatedTable, GenerationError, KeyspaceError, LeakageError, LogicalType, Profile, Table, TableSchema, require_gated
from .spec import DENIED, Spec, assert_affirmed_place, assert_nonprod_destination, consistency_fingerprint, spec_profiles


def key_bases(spec: Spec, profiles: dict[str, Profile]) -> dict[str, int]:
    """First shared primary key of each table that shares one."""
    bases: dict[str, int] = {}
    for t, s in spec.tables.items():
        for c in s.shared_keys:
            if c not in profiles[t].schema.names:
                raise KeyspaceError(f"{t} has no column {c}")
            if any(c in f.columns for f in profiles[t].schema.foreign_keys):
                raise KeyspaceError(f"{t}.{c} is a foreign key; share the key that it refers to")
        first = relate.shared_key_bases({t: (s.shared_keys, s.reserved_key_block, s.rows)})
        bases |= {t: v for (_, c), v in first.items() if c in profiles[t].schema.primary_key}
    return bases


def with_shared_keys(table: Table, name: str, spec: Spec) -> Table:
    """Shared columns beside the primary key, by position; the position goes."""
    s, df = spec.tables[name], table.df
    for (_, c), base in relate.shared_key_bases({name: (s.shared_keys, s.reserved_key_block, s.rows)}).items():
        if c not in table.schema.primary_key:
            df = df.withColumn(c, relate.key_value(F.col(POSITION) + base, table.schema.column(c).logical_type))
    return table.with_df(df.drop(POSITION))


def structural(schema: TableSchema, shared: Iterable[str] = ()) -> tuple[str, ...]:
    """Keys and shared columns: they hold numbers of positions in generated rows."""
    return (*schema.primary_key, *(c for f in schema.foreign_keys for c in f.columns), *shared)


def spec_guards(spark: SparkSession, spec: Spec, profiles: dict[str, Profile], guards: dict[str, DataFrame] | None) -> dict[str, DataFrame | None]:
    """Given guards, and those of the profiles; a column that the specification alone names needs a given one."""
    out = {}
    for t, p in profiles.items():
        out[t] = (guards or {}).get(t)
        if out[t] is None and (bare := set(spec.tables[t].sensitive_columns) - set(p.sensitive)):
            raise LeakageError(f"{t}: no guard for {sorted(bare)}")
        out[t] = guard_of(spark, p) if out[t] is None else out[t]
    return out


def sensitive(spec: Spec, profile: Profile, name: str) -> list[str]:
    return sorted({*profile.sensitive, *spec.tables[name].sensitive_columns})


def redrawn(table: Table, name: str, spec: Spec, profiles: dict[str, Profile], guard: DataFrame | None) -> Table:
    """Colliding cells drawn anew by position. Columns that others refer to stay, so the gate refuses them where they collide."""
    p = profiles[name]
    fixed = {*structural(p.schema, spec.tables[name].shared_keys), *(c for q in profiles.values() for f in q.schema.foreign_keys if f.referred_table == name for c in f.referred_columns)}
    columns = [c for c in sensitive(spec, p, name) if c not in fixed]
    if guard is None or not columns:
        return table
    made = enforce_leakage_gate(table, guard, columns, p.salt or "", lambda c, attempt: draw(p, c, spec.seed, F.col(POSITION), attempt))
    df = made.df
    for u in p.schema.unique_constraints:
        if len(u) == 1 and u[0] in columns and p.schema.column(u[0]).logical_type is LogicalType.STRING:
            df = relate.unique_values(df, u[0], POSITION)
    return made.with_df(df)


def generate_from_spec(spark: SparkSession, spec: Spec, guards: dict[str, DataFrame] | None = None) -> dict[str, GatedTable]:
    """Lazy sealed tables. Shared keys are arithmetic on positions, for children as well, so no key is ever looked up."""
    profiles = spec_profiles(spec)
    known = spec_guards(spark, spec, profiles, guards)
    made = relate.generate_related(spark, profiles, {t: s.rows for t, s in spec.tables.items()}, spec.seed, key_bases(spec, profiles), keep_position=True)
    made = {t: redrawn(v, t, spec, profiles, known[t]) for t, v in made.items()}
    for t, s in spec.tables.items():
        for x in s.cross_correlations:
            made[t] = correlate(made, spec, t, x)
    plain = {t: with_shared_keys(v, t, spec) for t, v in made.items()}
    sealed = {}
    for t in relate.topological_order({t: v.schema for t, v in plain.items()}):
        if spec.tables[t].fixtures:
            over = relate.overlay_fixtures(plain[t], spec.tables[t].fixtures, spec.tables[t].reserved_key_block, {p: v.df for p, v in plain.items()})
            plain[t] = over.with_df(over.df.drop("is_fixture"))
        checked = known[t], sensitive(spec, profiles[t], t), profiles[t].salt or "", structural(plain[t].schema, spec.tables[t].shared_keys)
        sealed[t] = scan_and_gate(over, *checked, classify_sensitive_columns) if spec.tables[t].fixtures else gate(plain[t], *checked)
    return sealed


def stream_from_spec(spark: SparkSession, spec: Spec, guards: dict[str, DataFrame] | None = None) -> Iterator[tuple[str, GatedTable]]:
    """(table, sealed block) of at most `chunk_rows` rows each, parents first, at least one block a table. The blocks of a table hold the
    rows of generate_from_spec(). What needs a whole table can't be made in blocks and is refused before the first one: fixtures, correlations
    with a parent, and unique texts, which are repaired by their occurrences."""
    profiles = spec_profiles(spec)
    known = spec_guards(spark, spec, profiles, guards)
    bases, rows = key_bases(spec, profiles), {t: s.rows for t, s in spec.tables.items()}
    for t, s in spec.tables.items():
        schema = profiles[t].schema
        texts = [u[0] for u in schema.unique_constraints if len(u) == 1 and u[0] not in structural(schema) and schema.column(u[0]).logical_type is LogicalType.STRING]
        if s.fixtures or s.cross_correlations or texts:
            raise GenerationError(f"{t} has fixtures, correlations or unique texts and can't be made in blocks")
    for t in relate.topological_order({t: p.schema for t, p in profiles.items()}):
        for start in range(0, max(rows[t], 1), spec.chunk_rows):
            size = min(spec.chunk_rows, rows[t] - start)
            made = relate.generate_related(spark, profiles, rows, spec.seed, bases, keep_position=True, block=(t, start, size))[t]
            made = with_shared_keys(redrawn(made, t, spec, profiles, known[t]), t, spec)
            yield t, gate(made, known[t], sensitive(spec, profiles[t], t), profiles[t].salt or "", structural(made.schema, spec.tables[t].shared_keys))


def correlate(made: dict[str, Table], spec: Spec, child: str, x) -> Table:
    table = made[child]
    f = next((f for f in table.schema.foreign_keys if f.referred_table == x.parent_table and len(f.columns) == 1), None)
    if x.parent_table not in made or x.parent_table == child or f is None:
        raise EngineError(f"{child}.{x.column}: no parent {x.parent_table} by a single key")
    parent = made[x.parent_table].df.select(F.col(f.referred_columns[0]).alias("__pk"), F.col(x.parent_column).cast("double").alias("__ref"))
    joined = table.df.join(parent, F.col(f.columns[0]) == F.col("__pk"), "left").drop("__pk")
    return table.with_df(relate.induce_rank_correlation(joined, POSITION, x.column, "__ref", x.rho, spec.seed, child).drop("__ref"))


@dataclass
class ProvisionReport:
    rows: dict[str, int] = field(default_factory=dict)
    fidelity: dict[str, bool] = field(default_factory=dict)
    fingerprint: str = ""

    def render(self) -> str:
        said = {True: ", fidelity passed", False: ", fidelity not passed", None: ""}
        return "\n".join([f"{t}: {n} rows{said[self.fidelity.get(t)]}" for t, n in self.rows.items()] + [f"fingerprint {self.fingerprint}"])


def provision(spark: SparkSession, spec: Spec, sink, deny: tuple[str, ...] = DENIED, guards: dict[str, DataFrame] | None = None, score: bool = True, stream: bool = False) -> ProvisionReport:
    """Check the destination and that it is the sink's, then build and check all tables, and only then write the first. With `stream`, blocks are checked and written
    one by one, the first of a table replacing what was there, and tables are not scored."""
    assert_nonprod_destination(spec.destination, deny)
    if not hasattr(sink, "load"):
        raise EngineError("this destination can't be written")
    if hasattr(sink, "place"):
        assert_affirmed_place(spec.destination, sink.place, deny)
    report = ProvisionReport(fingerprint=consistency_fingerprint(spec))
    if stream:
        for t, blocks in groupby(stream_from_spec(spark, spec, guards), key=lambda x: x[0]):
            report.rows[t] = load_stream((b for _, b in blocks), t, sink)
        return report
    tables = generate_from_spec(spark, spec, guards)
    profiles = spec_profiles(spec)
    for t, table in tables.items():
        sink.load(require_gated(table), t)
        report.rows[t] = spec.tables[t].rows + len(spec.tables[t].fixtures)
        if score:
            report.fidelity[t] = evaluate.fidelity_report(profiles[t], Table(table.df, table.schema), spec.tolerance).passed
    return report


def subset_from_spec(spark: SparkSession, spec: Spec, root: str, fraction: float) -> dict[str, GatedTable]:
    tables = generate_from_spec(spark, spec)
    kept = relate.subset_tables({t: Table(v.df, v.schema) for t, v in tables.items()}, root, fraction, spec.seed)
    return {t: gate(Table(df, tables[t].schema), None, [], None) for t, df in kept.items()}


def delta_refresh(spark: SparkSession, old: Spec, new: Spec) -> dict[str, GatedTable]:
    """Plans of the tables that a changed specification changes; the others are not built."""
    dump = lambda s: {t: x.model_dump_json() for t, x in s.tables.items()}
    schemas = {t: p.schema for t, p in spec_profiles(new).items()}
    if old.seed != new.seed:
        dirty = set(new.tables)
    else:
        keys = {t for t, s in new.tables.items() if t not in old.tables or (old.tables[t].rows, old.tables[t].shared_keys, old.tables[t].reserved_key_block) != (s.rows, s.shared_keys, s.reserved_key_block)}
        dirty = relate.dirty_tables(dump(old), dump(new), schemas, keys, {t: {x.parent_table for x in s.cross_correlations} for t, s in new.tables.items()})
    return {t: v for t, v in generate_from_spec(spark, new).items() if t in dirty} if dirty else {}
