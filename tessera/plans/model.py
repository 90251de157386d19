"""Tables with a schema of constraints, profiles of tables, and the errors of the engine."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class EngineError(Exception):
    """Base of all errors."""


class ConfigError(EngineError):
    pass


class VersionError(ConfigError):
    pass


class ProfileError(EngineError):
    pass


class GenerationError(EngineError):
    pass


class KeyspaceError(GenerationError):
    pass


class LeakageError(EngineError):
    pass


class FixtureError(EngineError):
    pass


class GuardrailError(EngineError):
    pass


class ChaosError(EngineError):
    pass


class ConditionError(GenerationError):
    pass


class ExportError(EngineError):
    pass


class SourceError(EngineError):
    pass


class TableNotFoundError(SourceError):
    pass


class LogicalType(str, Enum):
    INTEGER = "integer"
    FLOAT = "float"
    BOOLEAN = "boolean"
    STRING = "string"
    DATETIME = "datetime"
    CATEGORICAL = "categorical"


NUMERIC = {LogicalType.INTEGER, LogicalType.FLOAT}
TEXT = {LogicalType.STRING, LogicalType.CATEGORICAL}
SPARK_TYPES: dict[LogicalType, T.DataType] = {
    LogicalType.INTEGER: T.LongType(), LogicalType.FLOAT: T.DoubleType(), LogicalType.BOOLEAN: T.BooleanType(),
    LogicalType.STRING: T.StringType(), LogicalType.CATEGORICAL: T.StringType(), LogicalType.DATETIME: T.TimestampNTZType(),
}


def map_logical_type(kind: T.DataType) -> LogicalType:
    """The logical type of a physical one; whatever has no type of its own is text."""
    if isinstance(kind, T.BooleanType):
        return LogicalType.BOOLEAN
    if isinstance(kind, T.IntegralType):
        return LogicalType.INTEGER
    if isinstance(kind, T.FractionalType):
        return LogicalType.FLOAT
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return LogicalType.DATETIME
    return LogicalType.STRING


@dataclass(frozen=True)
class Column:
    name: str
    logical_type: LogicalType
    nullable: bool = True
    primary_key: bool = False


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    referred_table: str
    referred_columns: tuple[str, ...]


@dataclass(frozen=True)
class Index:
    name: str
    columns: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class TableSchema:
    table: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    unique_constraints: tuple[tuple[str, ...], ...] = ()
    indexes: tuple[Index, ...] = ()

    def column(self, name: str) -> Column:
        found = next((c for c in self.columns if c.name == name), None)
        if found is None:
            raise EngineError(f"{self.table} has no column {name}")
        return found

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, default=str)


def schema_of(df: DataFrame, table: str, primary_key: tuple[str, ...] = (), foreign_keys: tuple[ForeignKey, ...] = (), unique: tuple[tuple[str, ...], ...] = ()) -> TableSchema:
    columns = tuple(Column(f.name, map_logical_type(f.dataType), f.nullable and f.name not in primary_key, f.name in primary_key) for f in df.schema)
    return TableSchema(table, columns, primary_key, foreign_keys, unique)


@dataclass(frozen=True)
class Table:
    """A lazy DataFrame and its schema; every stage hands both on."""

    df: DataFrame
    schema: TableSchema

    def with_df(self, df: DataFrame) -> Table:
        return replace(self, df=df)


class GatedTable:
    """A table that has passed the leakage gate; only the gate makes one, and only such a table is loaded anywhere."""

    __slots__ = ("_table", "checked")
    _key = object()

    def __init__(self, key: object, table: Table, checked: tuple[str, ...]) -> None:
        if key is not GatedTable._key:
            raise LeakageError("only the gate seals tables")
        self._table, self.checked = table, checked

    @property
    def df(self) -> DataFrame:
        return self._table.df

    @property
    def schema(self) -> TableSchema:
        return self._table.schema

    def __repr__(self) -> str:
        return f"GatedTable({self.schema.table})"


def require_gated(value: Any) -> GatedTable:
    if not isinstance(value, GatedTable):
        raise TypeError("this table has not passed the gate")
    return value


@dataclass
class NumericStats:
    min: float
    max: float
    mean: float
    std: float
    quantiles: dict[str, float]
    edges: list[float] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)


@dataclass
class DatetimeStats:
    min: str
    max: str
    day_of_week: dict[int, int] = field(default_factory=dict)
    month: dict[int, int] = field(default_factory=dict)


@dataclass
class TextStats:
    min_length: int
    max_length: int
    mean_length: float


@dataclass
class ColumnProfile:
    name: str
    logical_type: LogicalType
    count: int
    null_count: int
    distinct_count: int
    numeric: NumericStats | None = None
    categories: list[tuple[str, int]] | None = None
    datetime: DatetimeStats | None = None
    text: TextStats | None = None


@dataclass
class Profile:
    schema: TableSchema
    row_count: int
    columns: list[ColumnProfile]
    numeric_columns: list[str] = field(default_factory=list)
    spearman: list[list[float | None]] = field(default_factory=list)
    cramers_v: dict[str, float] = field(default_factory=dict)
    sensitive: tuple[str, ...] = ()
    salt: str | None = None
    schema_version: str = "1.0.0"
    #: Digests of the real values of sensitive columns, lazy; where they are stored. Values of the first are never part of the dictionary.
    guard: DataFrame | None = field(default=None, repr=False, compare=False)
    guard_path: str | None = field(default=None, compare=False)

    def column(self, name: str) -> ColumnProfile:
        return next(c for c in self.columns if c.name == name)

    def to_dict(self) -> dict[str, Any]:
        made = json.loads(json.dumps(asdict(replace(self, guard=None)), default=str))
        del made["guard"]
        return made

    @staticmethod
    def from_dict(data: dict[str, Any]) -> Profile:
        if str(data.get("schema_version", "")).split(".")[0] != "1":
            raise VersionError(f"profile version {data.get('schema_version')} is not supported")
        s = data["schema"]
        schema = TableSchema(
            s["table"], tuple(Column(c["name"], LogicalType(c["logical_type"]), c["nullable"], c["primary_key"]) for c in s["columns"]), tuple(s["primary_key"]),
            tuple(ForeignKey(tuple(f["columns"]), f["referred_table"], tuple(f["referred_columns"])) for f in s["foreign_keys"]), tuple(tuple(u) for u in s["unique_constraints"]),
            tuple(Index(i["name"], tuple(i["columns"]), i["unique"]) for i in s["indexes"]),
        )
        keyed = lambda d: {int(k): v for k, v in d.items()}
        columns = [
            ColumnProfile(
                c["name"], LogicalType(c["logical_type"]), c["count"], c["null_count"], c["distinct_count"], c["numeric"] and NumericStats(**c["numeric"]), c["categories"] and [tuple(x) for x in c["categories"]],
                c["datetime"] and DatetimeStats(c["datetime"]["min"], c["datetime"]["max"], keyed(c["datetime"]["day_of_week"]), keyed(c["datetime"]["month"])), c["text"] and TextStats(**c["text"]),
            )
            for c in data["columns"]
        ]
        return Profile(schema, data["row_count"], columns, data["numeric_columns"], data["spearman"], data["cramers_v"], tuple(data["sensitive"]), data["salt"], data["schema_version"], guard_path=data.get("guard_path"))
