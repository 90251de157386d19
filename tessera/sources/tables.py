"""Sources and sinks: files and databases behind one protocol, normalised exports, reproducible samples."""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, replace
from urllib.parse import quote_plus

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import ExportError, ForeignKey, GatedTable, Index, LogicalType, SourceError, Table, TableNotFoundError, TableSchema, require_gated, schema_of


def scrub(text: str, *secrets: str | None) -> str:
    """A message without secrets, plain or URL-encoded."""
    for s in filter(None, secrets):
        text = text.replace(s, "***").replace(quote_plus(s), "***")
    return text


def sample_rows(df: DataFrame, rows: int, seed: int, key: list[str] | None = None) -> DataFrame:
    """Exactly so many rows (or all), the same at every run: a top-n by digest."""
    if isinstance(rows, bool) or not isinstance(rows, int) or rows <= 0:
        raise SourceError("rows must be a positive whole number")
    parts = [F.col(c).cast("string") for c in key or df.columns]
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary")), *(key or df.columns)).limit(rows)


@dataclass(frozen=True)
class FileSource:
    """Parquet, ORC, CSV or JSON tables in a folder, one each."""

    spark: SparkSession
    folder: str
    format: str = "parquet"
    constraints: dict[str, TableSchema] | None = None

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}.{self.format}"

    def read(self, table: str) -> DataFrame:
        try:
            return self.spark.read.format(self.format).load(self.path(table))
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                raise TableNotFoundError(table) from e
            raise

    @property
    def place(self) -> tuple[str | None, str | None]:
        """Host and database that are written to; a folder has no host."""
        return None, self.folder

    def test_connection(self) -> None:
        try:
            self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.folder).limit(0)
        except Exception as e:
            raise SourceError(f"{self.folder} can't be read") from e

    def introspect(self, table: str) -> TableSchema:
        return (self.constraints or {}).get(table) or schema_of(self.read(table), table)

    def sample(self, table: str, rows: int, seed: int = 0) -> Table:
        return Table(sample_rows(self.read(table), rows, seed), self.introspect(table))

    def load(self, gated: GatedTable, table: str, append: bool = False) -> None:
        require_gated(gated)
        normalize_for_export(Table(gated.df, gated.schema)).write.mode("append" if append else "overwrite").format(self.format).save(self.path(table))


#: Engine, default port, URL prefix and the query that samples a table.
DIALECTS = {
    "postgresql": (5432, "jdbc:postgresql://{host}:{port}/{database}", "SELECT * FROM {table} ORDER BY md5('{seed}' || t::text) LIMIT {rows}"),
    "mysql": (3306, "jdbc:mysql://{host}:{port}/{database}", "SELECT * FROM {table} ORDER BY RAND({seed}) LIMIT {rows}"),
    "starrocks": (9030, "jdbc:mysql://{host}:{port}/{database}", "SELECT * FROM {table} ORDER BY RAND() LIMIT {rows}"),
    "mssql": (1433, "jdbc:sqlserver://{host}:{port};databaseName={database};encrypt={encrypt};trustServerCertificate={trust}", "SELECT TOP ({rows}) * FROM {table} ORDER BY NEWID()"),
}
#: The schema of a table that names none.
HERE = {"postgresql": "current_schema()", "mysql": "DATABASE()", "starrocks": "DATABASE()", "mssql": "SCHEMA_NAME()"}
COLUMNS_SQL = "SELECT column_name AS col, is_nullable AS nullable FROM information_schema.columns WHERE table_schema = {schema} AND table_name = {table}"
#: Rows (constraint, kind, place, column, referred table, referred column).
REFERRED_BY_NAME = """SELECT c.constraint_name AS name, c.constraint_type AS kind, k.ordinal_position AS place, k.column_name AS col, u.table_name AS ref_table, u.column_name AS ref_col
FROM information_schema.table_constraints c
JOIN information_schema.key_column_usage k ON k.constraint_schema = c.constraint_schema AND k.constraint_name = c.constraint_name AND k.table_name = c.table_name
LEFT JOIN information_schema.referential_constraints r ON r.constraint_schema = c.constraint_schema AND r.constraint_name = c.constraint_name AND c.constraint_type = 'FOREIGN KEY'
LEFT JOIN information_schema.key_column_usage u ON u.constraint_schema = r.unique_constraint_schema AND u.constraint_name = r.unique_constraint_name AND u.ordinal_position = {position}
WHERE c.table_schema = {schema} AND c.table_name = {table} AND c.constraint_type IN ('PRIMARY KEY', 'UNIQUE', 'FOREIGN KEY')"""
REFERRED_IN_PLACE = """SELECT c.constraint_name AS name, c.constraint_type AS kind, k.ordinal_position AS place, k.column_name AS col, k.referenced_table_name AS ref_table, k.referenced_column_name AS ref_col
FROM information_schema.table_constraints c
JOIN information_schema.key_column_usage k ON k.table_schema = c.table_schema AND k.table_name = c.table_name AND k.constraint_name = c.constraint_name
WHERE c.table_schema = {schema} AND c.table_name = {table} AND c.constraint_type IN ('PRIMARY KEY', 'UNIQUE', 'FOREIGN KEY')"""
KEYS_SQL = {
    "postgresql": REFERRED_BY_NAME.replace("{position}", "COALESCE(k.position_in_unique_constraint, k.ordinal_position)"),
    "mssql": REFERRED_BY_NAME.replace("{position}", "k.ordinal_position"),
    "mysql": REFERRED_IN_PLACE,
    "starrocks": REFERRED_IN_PLACE,
}
STATISTICS = "SELECT index_name AS name, CASE WHEN non_unique = 0 THEN 1 ELSE 0 END AS is_unique, seq_in_index AS place, column_name AS col FROM information_schema.statistics WHERE table_schema = {schema} AND table_name = {table} AND index_name <> 'PRIMARY'"
#: Rows (index, 1 if unique, place, column), without indexes of primary keys. Expressions are no columns and left out.
INDEXES_SQL = {
    "postgresql": """SELECT n.relname AS name, CASE WHEN i.indisunique THEN 1 ELSE 0 END AS is_unique, p.place AS place, a.attname AS col
FROM pg_index i JOIN pg_class n ON n.oid = i.indexrelid JOIN pg_class t ON t.oid = i.indrelid JOIN pg_namespace s ON s.oid = t.relnamespace
CROSS JOIN LATERAL unnest(i.indkey::int2[]) WITH ORDINALITY AS p(attnum, place) JOIN pg_attribute a ON a.attrelid = t.oid AND a.attnum = p.attnum
WHERE s.nspname = {schema} AND t.relname = {table} AND NOT i.indisprimary AND p.place <= i.indnkeyatts""",
    "mysql": STATISTICS,
    "starrocks": STATISTICS,
    "mssql": """SELECT i.name AS name, CAST(i.is_unique AS int) AS is_unique, k.key_ordinal AS place, c.name AS col
FROM sys.indexes i JOIN sys.index_columns k ON k.object_id = i.object_id AND k.index_id = i.index_id JOIN sys.columns c ON c.object_id = k.object_id AND c.column_id = k.column_id
JOIN sys.tables t ON t.object_id = i.object_id
WHERE SCHEMA_NAME(t.schema_id) = {schema} AND t.name = {table} AND i.is_primary_key = 0 AND k.key_ordinal > 0""",
}
DDL_TYPES = {LogicalType.INTEGER: "BIGINT", LogicalType.FLOAT: "DOUBLE", LogicalType.BOOLEAN: "BOOLEAN", LogicalType.DATETIME: "TIMESTAMP", LogicalType.STRING: "STRING", LogicalType.CATEGORICAL: "STRING"}


@dataclass(frozen=True)
class JdbcSource:
    """A database; credentials are named by environment variables and read when they are used. Needs the engine's driver on the class path."""

    spark: SparkSession
    engine: str
    host: str
    port: int | None = None
    database: str | None = None
    user_env: str = "DB_USER"
    password_env: str = "DB_PASSWORD"
    encrypt: bool = True
    trust_server_certificate: bool = True

    def url(self) -> str:
        if self.engine not in DIALECTS:
            raise SourceError(f"no engine {self.engine}")
        port, shape, _ = DIALECTS[self.engine]
        return shape.format(host=self.host, port=self.port or port, database=self.database or "", encrypt=str(self.encrypt).lower(), trust=str(self.trust_server_certificate).lower())

    def credentials(self) -> tuple[str, str]:
        missing = [e for e in (self.user_env, self.password_env) if e not in os.environ]
        if missing:
            raise SourceError(f"environment variables {missing} are not set")
        return os.environ[self.user_env], os.environ[self.password_env]

    def query(self, sql: str) -> DataFrame:
        user, password = self.credentials()
        try:
            return self.spark.read.format("jdbc").options(url=self.url(), query=sql, user=user, password=password).load()
        except Exception as e:
            raise SourceError(scrub(str(e), user, password)) from None

    def rows(self, sql: str) -> list:
        """All rows of a query whose result is small: of a catalog, about one table."""
        df = self.query(sql)
        try:
            return df.collect()
        except Exception as e:
            raise SourceError(scrub(str(e), *self.credentials())) from None

    @property
    def place(self) -> tuple[str | None, str | None]:
        return self.host, self.database

    def test_connection(self) -> None:
        self.rows("SELECT 1 AS one")

    def read(self, table: str) -> DataFrame:
        return self.query(f"SELECT * FROM {table}")

    def introspect(self, table: str) -> TableSchema:
        """Columns, keys, unique constraints and indexes, as the catalog has them. The table may be named with its schema."""
        if self.engine not in DIALECTS:
            raise SourceError(f"no engine {self.engine}")
        literal = lambda x: "'" + x.replace("'", "''") + "'"
        schema, _, name = table.rpartition(".")
        named = {"schema": literal(schema) if schema else HERE[self.engine], "table": literal(name)}
        nullable = {col: said.upper() == "YES" for col, said in self.rows(COLUMNS_SQL.format(**named))}
        if not nullable:
            raise TableNotFoundError(table)
        keys, indexes = defaultdict(list), defaultdict(list)
        for constraint, kind, place, *columns in self.rows(KEYS_SQL[self.engine].format(**named)):
            keys[kind, constraint].append((place, *columns))
        for index, unique, place, col in self.rows(INDEXES_SQL[self.engine].format(**named)):
            indexes[index, bool(unique)].append((place, col))
        of = lambda kind: [list(zip(*sorted(v), strict=True))[1:] for (k, _), v in sorted(keys.items()) if k == kind]
        found = schema_of(
            self.query(f"SELECT * FROM {table} WHERE 1 = 0"), table, next((columns for columns, *_ in of("PRIMARY KEY")), ()),
            foreign_keys=tuple(ForeignKey(columns, tables[0], referred) for columns, tables, referred in of("FOREIGN KEY")), unique=tuple(columns for columns, *_ in of("UNIQUE")),
        )
        columns = tuple(replace(c, nullable=c.nullable and nullable.get(c.name, True)) for c in found.columns)
        return replace(found, columns=columns, indexes=tuple(Index(index, tuple(col for _, col in sorted(v)), unique) for (index, unique), v in sorted(indexes.items())))

    def sample_sql(self, table: str, rows: int, seed: int = 0) -> str:
        if isinstance(rows, bool) or not isinstance(rows, int) or rows <= 0:
            raise SourceError("rows must be a positive whole number")
        return DIALECTS[self.engine][2].format(table=f"{table} t" if self.engine == "postgresql" else table, rows=rows, seed=seed)

    def sample(self, table: str, rows: int, seed: int = 0) -> Table:
        return Table(self.query(self.sample_sql(table, rows, seed)), self.introspect(table))

    def load(self, gated: GatedTable, table: str, append: bool = False) -> None:
        require_gated(gated)
        user, password = self.credentials()
        columns = ", ".join(f"{c.name} {DDL_TYPES[c.logical_type]}" for c in gated.schema.columns)
        writer = normalize_for_export(Table(gated.df, gated.schema)).write.mode("append" if append else "overwrite").format("jdbc")
        try:
            writer.options(url=self.url(), dbtable=table, user=user, password=password, createTableColumnTypes=columns, truncate="false").save()
        except Exception as e:
            raise SourceError(scrub(str(e), user, password)) from None


def load_stream(blocks: Iterable[GatedTable], table: str, sink: FileSource | JdbcSource) -> int:
    """Load blocks in turn, each a commit of its own: the first replaces the table, the others append. Returns the rows."""
    rows = 0
    for k, block in enumerate(blocks):
        sink.load(block, table, append=k > 0)
        rows += block.df.count()
    return rows


def normalized(value: Column, kind: LogicalType) -> Column:
    """A value as its logical type says, null where it can't be."""
    if kind is LogicalType.INTEGER:
        return F.coalesce(value.try_cast("bigint"), F.rint(value.try_cast("double")).try_cast("bigint"))
    if kind is LogicalType.FLOAT:
        x = value.try_cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    if kind is LogicalType.BOOLEAN:
        return value.try_cast("boolean")
    return value.try_cast("timestamp_ntz") if kind is LogicalType.DATETIME else value.cast("string")


def normalize_for_export(table: Table) -> DataFrame:
    """Columns in the order and of the types of the schema, as one projection."""
    return table.df.select(*(normalized(F.col(c.name), c.logical_type).alias(c.name) for c in table.schema.columns))


EXPORTERS = {"csv": {"header": "true", "encoding": "UTF-8"}, "json": {"ignoreNullFields": "false"}, "parquet": {}, "orc": {}}


def export(table: Table, format: str, target: str, single_file: bool = False) -> None:
    """Write a table; many files unless one is asked for."""
    if format not in EXPORTERS:
        raise ExportError(f"no format {format}")
    df = normalize_for_export(table)
    try:
        (df.coalesce(1) if single_file else df).write.mode("overwrite").format(format).options(**EXPORTERS[format]).save(target)
    except Exception as e:
        raise ExportError(f"{target} can't be written as {format}") from e
