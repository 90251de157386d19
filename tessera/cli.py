"""Command line: exit 0 on success, 1 when a gate or a check says no or the work fails, 2 on wrong use (options, configuration, conditions, a destination that is not affirmed)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .operators import chaos, conditions, evaluate, generate, guard, profile
from .plans import provision, spec
from .plans.model import ConditionError, ConfigError, EngineError, GuardrailError, Table
from .sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple[str, dict]) -> None:
        c = sub.add_parser(name)
        for flag, kind in options:
            c.add_argument(flag, **kind)

    where = (("--folder", {}), ("--config", {}), ("--engine", {"choices": sorted(tables.DIALECTS)}))
    table, rows, seed = ("--table", {}), ("--rows", {"type": int, "default": 1000}), ("--seed", {"type": int, "default": 0})
    loaded, out = ("--profile", {"required": True}), ("--out", {"required": True})
    command("test-connection", *where)
    command("schema", *where, table)
    command("sample", *where, table, rows, seed)
    command("profile", *where, table, rows, seed, out, ("--sensitive", {"nargs": "*", "default": []}), ("--not-sensitive", {"nargs": "*", "default": []}), ("--classify", {"action": "store_true"}))
    command("generate", loaded, rows, seed, out, ("--format", {"default": "parquet"}), ("--where", {"nargs": "*", "default": []}), ("--outlier", {"type": float}), ("--similarity", {"type": float}), ("--reference", {}))
    command("report", loaded, ("--data", {"required": True}), ("--tolerance", {"type": float, "default": 0.9}))
    command("chaos", loaded, rows, seed, out, ("--mutator", {"nargs": "+", "default": ["outlier"]}), ("--mode", {"default": "mixed"}), ("--rate", {"type": float, "default": 0.1}), ("--confirm", {"action": "store_true"}), ("--audit", {"action": "store_true"}))
    command("provision", ("--spec", {"required": True}), *where, ("--stream", {"action": "store_true"}))
    return p


def source_of(args: argparse.Namespace, spark: SparkSession, config: spec.Config) -> tables.FileSource | tables.JdbcSource:
    """The folder, or the database that the configuration connects to."""
    if args.folder and args.config:
        raise ConfigError("name a --folder or a --config, not both")
    if args.folder:
        return tables.FileSource(spark, args.folder)
    engine, c = args.engine or config.source.engine, config.source.connection
    if c is None or engine not in tables.DIALECTS:
        raise ConfigError("name a --folder, or a --config with a connection and an engine")
    return tables.JdbcSource(spark, engine, c.host, c.port, c.database, c.user_env, c.password_env, c.encrypt, c.trust_server_certificate)


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    show = lambda x: print(json.dumps(x, indent=1, default=str))
    config = spec.load_config(args.config) if getattr(args, "config", None) else spec.Config()
    source = source_of(args, spark, config) if "folder" in args else None
    if "table" in args and not (args.table or config.source.table):
        raise ConfigError("name a --table")
    table = getattr(args, "table", None) or config.source.table
    if args.command == "test-connection":
        source.test_connection()
    elif args.command == "schema":
        print(source.introspect(table).to_json())
    elif args.command == "sample":
        source.sample(table, args.rows, args.seed).df.show(args.rows, truncate=False)
    elif args.command == "profile":
        part = source.sample(table, args.rows, args.seed)
        named, cleared = {*args.sensitive, *config.source.sensitive_columns}, {*args.not_sensitive, *config.source.not_sensitive_columns}
        made = profile.profile_table(part, sensitive=tuple(sorted(named)), not_sensitive=tuple(sorted(cleared)), classify_pii=args.classify, whole=Table(source.read(table), part.schema))
        spec.save_profile(made, args.out)
    elif args.command == "generate":
        known = spec.load_profile(args.profile)
        made = generate.generate_faithful(spark, known, args.rows, args.seed, conditions.parse_conditions(args.where))
        df = guard.outlier_filter(made.df, known.numeric_columns, args.outlier) if args.outlier and known.numeric_columns else made.df
        if args.similarity:
            if not args.reference:
                raise ConfigError("--similarity needs --reference, a Parquet table of real rows")
            df = guard.similar_rows_removed(Table(df, made.schema), spark.read.parquet(args.reference), args.similarity)
        tables.export(Table(df, made.schema), args.format, args.out)
    elif args.command == "report":
        known = spec.load_profile(args.profile)
        report = evaluate.quality_privacy_report(known, Table(spark.read.parquet(args.data), known.schema), tolerance=args.tolerance)
        print(report.to_json())
        return 0 if report.passed else 1
    elif args.command == "chaos":
        known = spec.load_profile(args.profile)
        base = generate.synthesize(spark, known, args.rows, args.seed, keep_position=True)
        base = base.with_df(base.df.withColumnRenamed(generate.POSITION, chaos.ROW))
        made, manifest = chaos.apply_policy(base, [(m, {}) for m in args.mutator], args.seed, args.mode, args.rate, args.confirm)
        made.df.drop(chaos.ROW).write.mode("overwrite").parquet(args.out)
        manifest.write.mode("overwrite").json(f"{args.out}.manifest")
        if args.audit:
            audit = chaos.audit_manifest(base, made, manifest)
            show(audit.__dict__)
            return 0 if audit.valid else 1
    elif args.command == "provision":
        print(provision.provision(spark, spec.load_spec(args.spec), source, stream=args.stream).render())
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        return run(args, spark)
    except EngineError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2 if isinstance(e, (ConfigError, ConditionError, GuardrailError)) else 1


if __name__ == "__main__":
    sys.exit(main())
