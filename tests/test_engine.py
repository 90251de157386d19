"""Queries against DuckDB, and invariants of generation, relations and chaos."""

import dataclasses
import glob
import json
import os
import shutil

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import chaos, conditions, evaluate, generate, guard, profile, quantiles, relate
from tessera import cli
from tessera.plans import provision, registry, spec
from tessera.plans.model import ChaosError, ConfigError, EngineError, ExportError, ForeignKey, GenerationError, GuardrailError, LeakageError, Profile, SourceError, Table, TableNotFoundError, require_gated, schema_of
from tessera.sources import tables
from tessera.sources.tables import FileSource, JdbcSource, normalize_for_export

SF = "/root/testdata/sf0.001"
SAMPLE = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(t)[:-8]} as select * from '{t}'")
    return c


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        numeric = pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c])
        df[c] = df[c].astype(float).round(6) if numeric else df[c].astype(str)
    return df.fillna(-1e99).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    got, want = normal(registry.queries()[name](spark, SF).toPandas()), normal(duck.sql(registry.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.fixture(scope="module")
def known(spark):
    return {t: profile.profile_table(registry.table(spark, SF, t)) for t in ("customer", "orders")}


def test_profile_round_trip(known, tmp_path):
    spec.save_profile(known["orders"], tmp_path / "p.yaml")
    assert spec.load_profile(tmp_path / "p.yaml").to_dict() == known["orders"].to_dict()
    assert Profile.from_dict(known["customer"].to_dict()) .schema == known["customer"].schema


def test_partitions_do_not_change_rows(spark, known):
    rows = [generate.synthesize(spark, known["orders"], 300, 5, partitions=n).df.orderBy(*known["orders"].schema.names).collect() for n in (1, 7)]
    assert rows[0] == rows[1]


def test_related_tables_refer_to_parents(spark, known):
    made = relate.generate_related(spark, known, {"customer": 40, "orders": 200}, 3)
    assert relate.duplicate_keys(made["customer"].df, ["c_custkey"]).isEmpty()
    assert relate.fk_orphans(made["orders"].df, ["o_custkey"], made["customer"].df, ["c_custkey"]).isEmpty()


def test_conditions_hold(spark, known):
    wanted = conditions.parse_conditions(["o_totalprice in [20000, 60000]", "o_orderstatus = 'F'"])
    made = require_gated(generate.generate_faithful(spark, known["orders"], 500, 1, wanted))
    assert conditions.satisfies(made.df, wanted, made.schema) and made.df.count() == 500


def test_generated_values_follow_the_source(spark, known):
    report = evaluate.fidelity_report(known["customer"], generate.synthesize(spark, known["customer"], 1000, 2))
    assert report.columns["c_acctbal"] > 0.9 and report.columns["c_mktsegment"] > 0.9


def test_mixed_chaos_hits_the_rate_and_is_listed(spark):
    t = registry.orders_table(spark, SF)
    made, manifest = chaos.apply_policy(t, [("outlier", {"columns": ["o_totalprice"]})], 1, rate=0.25)
    assert chaos.audit_manifest(t, made, manifest).valid
    assert chaos.changed_cells(t.df, made.df, t.schema.names).select("row").distinct().count() == round(0.25 * t.df.count())
    assert not chaos.audit_manifest(t, made, chaos.empty_manifest(t.df)).valid
    assert chaos.apply_policy(t, [("outlier", {})], 1, rate=0.0)[0] is t
    with pytest.raises(ChaosError):
        chaos.apply_policy(t, [("outlier", {})], 1, mode="fully_chaotic")


def test_production_is_refused():
    spec.assert_nonprod_destination(spec.DestinationSpec(environment="nonprod", host="db1"))
    for d in (None, spec.DestinationSpec(environment="prod"), spec.DestinationSpec(environment="nonprod", host="PROD-db")):
        with pytest.raises(GuardrailError):
            spec.assert_nonprod_destination(d)


def test_whole_database_from_a_spec(spark, known):
    whole = spec.bootstrap_spec(known, seed=4)
    whole.tables["customer"].shared_keys, whole.tables["customer"].reserved_key_block = ["c_custkey"], 1000
    made = provision.generate_from_spec(spark, whole)
    assert made["customer"].df.agg({"c_custkey": "min"}).first()[0] == 1000
    assert relate.fk_orphans(made["orders"].df, ["o_custkey"], made["customer"].df, ["c_custkey"]).isEmpty()
    assert Table(made["orders"].df, schema_of(made["orders"].df, "orders")).schema.names == known["orders"].schema.names


def test_bracketed_quantiles_are_exact(spark):
    draw = np.random.default_rng(3)
    n = 30_000
    columns = {"even": draw.normal(size=n), "ties": np.round(draw.exponential(size=n), 1), "one": np.full(n, 4.0), "mostly": np.where(draw.random(n) < 0.7, 1.0, draw.random(n))}
    df = spark.createDataFrame(pd.DataFrame(columns)).withColumn("none", F.lit(None).cast("double")).repartition(5)
    names = [*columns, "none"]
    for whole in (20, 500, 10**6):
        made = quantiles.quantile_arrays(df, {c: F.col(c) for c in names}, profile.QUANTILES, whole)
        row = df.agg(*(made[c].alias(c) for c in names)).first()
        assert row["none"] is None
        for c, x in columns.items():
            np.testing.assert_allclose(row[c], np.quantile(x, profile.QUANTILES), rtol=1e-9)


def test_filters_by_spread(spark):
    flat = spark.createDataFrame([(i, float(x), 7.0) for i, x in enumerate([0, 0, 0, 0, 3])], "id long, x double, same double")
    assert guard.outlier_filter(flat, ["x", "same"], 1.5).count() == 4
    assert guard.outlier_filter(flat, [], 1.5).count() == 5
    nulls = flat.unionAll(spark.createDataFrame([(9, None, None)], "id long, x double, same double"))
    assert guard.outlier_filter(nulls, ["x"], 1.5).count() == 5


def test_blocks_hold_the_rows_of_the_whole(spark, known, tmp_path):
    whole = spec.bootstrap_spec(known, seed=4)
    whole.tables["customer"].shared_keys, whole.tables["customer"].reserved_key_block = ["c_custkey"], 1000
    whole.tables["customer"].rows, whole.tables["orders"].rows, whole.chunk_rows = 70, 100, 30
    whole.destination = spec.DestinationSpec(environment="nonprod", host="db1")
    blocks = list(provision.stream_from_spec(spark, whole))
    assert [(t, b.df.count()) for t, b in blocks] == [("customer", 30), ("customer", 30), ("customer", 10), ("orders", 30), ("orders", 30), ("orders", 30), ("orders", 10)]
    for chunk_rows in (30, 1000):
        whole.chunk_rows = chunk_rows
        sink = FileSource(spark, str(tmp_path))
        assert provision.provision(spark, whole, sink, stream=True).rows == {"customer": 70, "orders": 100}
        for t, table in provision.generate_from_spec(spark, whole).items():
            names = table.schema.names
            assert sorted(map(str, sink.read(t).select(names).collect())) == sorted(map(str, normalize_for_export(Table(table.df, table.schema)).collect()))
    whole.tables["orders"].rows = 0
    assert [(t, b.df.count()) for t, b in provision.stream_from_spec(spark, whole)][-1] == ("orders", 0)
    whole.tables["customer"].fixtures = [{"c_custkey": 1}]
    with pytest.raises(GenerationError):
        next(provision.stream_from_spec(spark, whole))


def test_command_line(spark, tmp_path, capsys):
    profiled, out = str(tmp_path / "p.yaml"), str(tmp_path / "made")
    run = lambda *words: cli.run(cli.parser().parse_args(list(words)), spark)
    assert run("profile", "--folder", SF, "--table", "supplier", "--out", profiled) == 0
    assert run("generate", "--profile", profiled, "--rows", "50", "--out", out, "--similarity", "0.05", "--reference", f"{SF}/supplier.parquet") == 0
    assert 0 < spark.read.parquet(out).count() <= 50
    assert run("report", "--profile", profiled, "--data", f"{SF}/supplier.parquet", "--tolerance", "0.1") in (0, 1)
    assert "quality" in capsys.readouterr().out
    with pytest.raises(EngineError):
        run("generate", "--profile", profiled, "--out", out, "--similarity", "0.05")


def test_similar_rows_are_removed(spark):
    reference = spark.createDataFrame([(0.0, "a"), (5.0, "b"), (10.0, "c")], "x double, cat string")
    made = spark.createDataFrame([(0.001, "a"), (50.0, "z"), (50.0, "z"), (None, None)], "x double, cat string")
    table = Table(made, schema_of(made, "t"))
    assert sorted(r["x"] or -1 for r in guard.similar_rows_removed(table, reference, 0.5).collect()) == [-1, 50.0, 50.0]


def test_numeric_draws_follow_the_bins(spark):
    from tessera.plans.model import NumericStats

    at = spark.range(1001).select((F.col("id") / 1000).alias("u"))
    for edges, counts in (([0.0, 1.0, 2.0, 4.0], [1, 0, 3]), ([2.0, 6.0], [5]), ([0.0, 1.0, 2.0], [3, 0])):
        stats = NumericStats(edges[0], edges[-1], 1.0, 1.0, {}, edges, counts)
        got = [r[0] for r in at.select(generate.numeric_from_uniform(F.col("u"), stats)).collect()]
        cdf = np.cumsum([0, *counts]) / sum(counts)
        for u, x in zip(np.arange(1001) / 1000, got, strict=True):
            assert min(abs(x - v) for v in edges) < 1e-9 if u in cdf else abs(x - np.interp(u, cdf, edges)) < 1e-9


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    """A folder with a table whose names are an eighth of those that a generator can invent."""
    folder = str(tmp_path_factory.mktemp("people"))
    names = [f"{a} {b}" for a in generate.FIRST for b in generate.LAST][::8]
    spark.createDataFrame([(i, names[i % len(names)], float(i)) for i in range(128)], "k long, full_name string, x double").write.parquet(f"{folder}/people.parquet")
    return folder


def real_names(spark, folder, made):
    real = {r["full_name"] for r in spark.read.parquet(f"{folder}/people.parquet").collect()}
    return sum(r["full_name"] in real for r in made.collect())


def test_commands_run_the_leakage_gate(spark, people, tmp_path, capsys):
    profiled, out = str(tmp_path / "p.yaml"), str(tmp_path / "made")
    run = lambda *words: cli.run(cli.parser().parse_args(list(words)), spark)
    # the profiled sample holds 10 rows, the guard all
    assert run("profile", "--folder", people, "--table", "people", "--rows", "10", "--sensitive", "full_name", "--out", profiled) == 0
    known = spec.load_profile(profiled)
    assert real_names(spark, people, generate.synthesize(spark, known, 100, 3).df) > 0
    assert run("generate", "--profile", profiled, "--rows", "100", "--seed", "3", "--out", out) == 0
    made = spark.read.parquet(out)
    assert made.count() == 100 and real_names(spark, people, made) == 0 and made.where("full_name is null").count() == 0
    capsys.readouterr()
    assert run("report", "--profile", profiled, "--data", out, "--tolerance", "0") == 0
    assert json.loads(capsys.readouterr().out)["membership"] == 0
    assert run("report", "--profile", profiled, "--data", f"{people}/people.parquet", "--tolerance", "0") == 1
    said = json.loads(capsys.readouterr().out)
    assert said["membership"] == 1 and said["failed"] == ["membership"]
    shutil.rmtree(f"{profiled}.guard")
    with pytest.raises(LeakageError):
        run("generate", "--profile", profiled, "--rows", "10", "--out", out)


def test_provision_runs_the_leakage_gate(spark, people, tmp_path):
    whole = spec.bootstrap_from_source(FileSource(spark, people), ["people"], 10, 3, sensitive={"people": ["full_name"]}, guards=str(tmp_path / "guards"))
    whole.tables["people"].rows, whole.destination, whole.chunk_rows = 100, spec.DestinationSpec(environment="nonprod"), 40
    rows = []
    for stream in (False, True):
        sink = FileSource(spark, str(tmp_path / f"sink{stream}"))
        provision.provision(spark, whole, sink, score=False, stream=stream)
        made = sink.read("people")
        assert made.count() == 100 and real_names(spark, people, made) == 0
        rows.append(sorted(map(str, made.select("k", "full_name", "x").collect())))
    assert rows[0] == rows[1]
    whole.tables["people"].profile["guard_path"] = None
    with pytest.raises(LeakageError):
        provision.generate_from_spec(spark, whole)


def test_the_gate_fails_closed(spark, people):
    t = FileSource(spark, people).sample("people", 200)
    known = guard.build_guard(t, ["full_name"], "s")
    with pytest.raises(LeakageError):
        guard.gate(t, known, ["full_name"], "s")
    with pytest.raises(LeakageError):
        guard.gate(t, None, ["full_name"], "s")
    with pytest.raises(LeakageError):
        guard.enforce_leakage_gate(t, known, ["full_name"], "s", lambda c, attempt: F.lit("Ada Abel"), attempts=2)
    made = guard.enforce_leakage_gate(t, known, ["full_name"], "s", lambda c, attempt: F.when(attempt == 2, "new").otherwise("Ada Abel"), attempts=2)
    assert real_names(spark, people, made.df) == 0 and guard.gate(made, known, ["full_name"], "s").checked == ("full_name",)


def test_fixtures_are_scanned(spark):
    rows = [(100 + i, f"https://a.example/{i}", 1000 + i, f"note {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "k long, link string, code long, notes string")
    t = Table(df, schema_of(df, "things", ("k",)))
    known = profile.profile_table(t, sensitive=("k", "link", "code"), salt="s")
    whole = spec.bootstrap_spec({"things": known}, seed=1)
    s = whole.tables["things"]
    s.rows, s.shared_keys, s.reserved_key_block = 5, ["k", "code"], 900

    def made(*fixtures):
        s.fixtures = list(fixtures)
        return provision.generate_from_spec(spark, whole, {"things": known.guard})["things"]

    fine = {"k": 1, "link": "https://b.example/", "code": 7, "notes": "pinned"}
    assert made(fine).df.where("k = 1 and code = 7").count() == 1
    others = [fine | {"k": k} for k in (2, 3, 4)]
    for bad in ({"k": 101}, {"code": 1003}, {"link": "https://a.example/3"}, {"notes": "ada@example.com"}, {"notes": "DE89370400440532013000"}, {"notes": "4111 1111 1111 1111"}):
        with pytest.raises(LeakageError):
            made(fine | bad, *others)
    s.rows, s.reserved_key_block = 150, 0  # generated keys may equal real ones
    assert made().df.where("k between 100 and 119").count() == 20


@pytest.mark.parametrize("profiled", [99_999, 100_000])
@pytest.mark.parametrize("rows,wanted", [(500, 2000), (3000, 3000)])
def test_scores_use_as_many_reference_rows_as_the_table(spark, known, monkeypatch, profiled, rows, wanted):
    drawn = []
    real = evaluate.generate_marginals
    monkeypatch.setattr(evaluate, "generate_marginals", lambda s, p, n, seed: drawn.append(n) or real(s, p, n, seed))
    large = dataclasses.replace(known["customer"], row_count=profiled)
    assert evaluate.fidelity_report(large, generate.synthesize(spark, large, rows, 2)).columns["c_acctbal"] > 0.9
    assert drawn == [wanted]


class Catalog(JdbcSource):
    """A database whose queries DuckDB answers, but for the catalogs that it lacks."""

    answers = {}

    def query(self, sql):
        for part, rows in self.answers.items():
            if part in sql:
                return self.spark.createDataFrame(*rows)
        return self.spark.createDataFrame(self.db.execute(sql).to_arrow_table())


@pytest.fixture
def catalog(spark):
    db = duckdb.connect()
    db.execute("create table parent (a int, b int, name varchar not null unique, primary key (a, b))")
    db.execute("create table child (k bigint primary key, second int, first int, x double, foreign key (first, second) references parent (a, b))")
    indexes = ([("by_x", 0, 2, "k"), ("by_x", 0, 1, "x"), ("one", 1, 1, "second")], "name string, is_unique int, place int, col string")
    return type("DuckCatalog", (Catalog,), {"db": db, "answers": {"pg_index": indexes}})(spark, "postgresql", "db1", database="shop")


def test_introspection_of_a_database_finds_keys(catalog):
    found = catalog.introspect("child")
    assert found.primary_key == ("k",) and found.names == ["k", "second", "first", "x"]
    assert found.foreign_keys == (ForeignKey(("first", "second"), "parent", ("a", "b")),)
    assert [(i.name, i.columns, i.unique) for i in found.indexes] == [("by_x", ("x", "k"), False), ("one", ("second",), True)]
    assert [c.name for c in found.columns if not c.nullable] == ["k"]
    parent = catalog.introspect("main.parent")
    assert parent.primary_key == ("a", "b") and parent.unique_constraints == (("name",),) and not parent.column("name").nullable
    with pytest.raises(TableNotFoundError):
        catalog.introspect("it's not there")


def test_introspection_reads_referred_columns_in_place(spark):
    rows = ([("PRIMARY", "PRIMARY KEY", 1, "k", None, None), ("f", "FOREIGN KEY", 2, "y", "p", "b"), ("f", "FOREIGN KEY", 1, "x", "p", "a")], "name string, kind string, place int, col string, t string, c string")
    answers = {
        "information_schema.columns": ([("k", "NO"), ("x", "YES"), ("y", "yes")], "col string, nullable string"),
        "key_column_usage": rows,
        "information_schema.statistics": ([("u", 1, 1, "x")], "name string, is_unique int, place int, col string"),
        "WHERE 1 = 0": ([], "k long, x int, y int"),
    }
    found = type("Answers", (Catalog,), {"answers": answers})(spark, "mysql", "db1").introspect("t")
    assert found.primary_key == ("k",) and found.foreign_keys == (ForeignKey(("x", "y"), "p", ("a", "b")),)
    assert found.indexes[0].unique and [c.nullable for c in found.columns] == [False, True, True]
    with pytest.raises(SourceError):
        JdbcSource(spark, "none", "db1").introspect("t")


def test_guardrail_is_bound_to_the_sink(spark, catalog):
    nonprod = lambda **x: spec.DestinationSpec(environment="nonprod", **x)
    assert catalog.place == ("db1", "shop")
    for d in (nonprod(), nonprod(host="db1"), nonprod(host="db1", database="shop")):
        spec.assert_affirmed_place(d, catalog.place)
    for d, place in ((nonprod(host="db2"), catalog.place), (nonprod(host="db1", database="other"), catalog.place), (nonprod(host="db1", database="shop"), ("db1", None)), (nonprod(), ("prod-db", None)), (nonprod(), (None, "/data/production"))):
        with pytest.raises(GuardrailError):
            spec.assert_affirmed_place(d, place)
    written = spec.Spec(destination=nonprod(host="db2"))
    with pytest.raises(GuardrailError):
        provision.provision(spark, written, catalog)


def test_exit_codes(spark, tmp_path, capsys):
    config, broken, out = tmp_path / "c.yaml", tmp_path / "b.yaml", str(tmp_path / "out")
    config.write_text("source: {engine: mysql, table: t, connection: {host: db1, user_env: TESSERA_NONE, password_env: TESSERA_NONE}}")
    broken.write_text("source: [")
    assert cli.main(["test-connection", "--folder", SF]) == 0
    assert cli.main(["schema", "--folder", SF, "--table", "nation"]) == 0
    assert cli.main(["schema", "--folder", SF, "--table", "none"]) == 1
    assert cli.main(["test-connection", "--folder", out]) == 1
    # the configuration leads to a database whose credentials aren't there
    assert cli.main(["test-connection", "--config", str(config)]) == 1 and "TESSERA_NONE" in capsys.readouterr().err
    for words in (["schema", "--folder", SF], ["schema", "--table", "t"], ["sample", "--config", str(broken)], ["sample", "--config", out], ["schema", "--folder", SF, "--config", str(config)]):
        assert cli.main(words) == 2, words
    database = cli.source_of(cli.parser().parse_args(["schema", "--config", str(config), "--engine", "postgresql"]), spark, spec.load_config(config))
    assert database.url() == "jdbc:postgresql://db1:5432/"
    with pytest.raises(ConfigError):
        spec.load_spec(tmp_path / "missing.yaml")
    blocked = tmp_path / "file"
    blocked.write_text("")
    with pytest.raises(ExportError):
        tables.export(Table(spark.range(1), schema_of(spark.range(1), "t")), "parquet", f"{blocked}/below")

