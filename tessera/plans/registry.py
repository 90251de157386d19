"""All registered queries of the engine, and the SQL that they equal."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pii
from ..functions.random import uniform, uniform_sql
from ..operators import chaos, correlate, evaluate, generate, guard, profile, relate
from ..sources.tables import normalized, sample_rows
from ..streaming.blocks import event_monitor
from .model import ColumnProfile, ForeignKey, LogicalType, NumericStats, Profile, Table, schema_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# the tables' keys
KEYS = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",)}
REFERENCES = {
    "nation": [("n_regionkey", "region", "r_regionkey")],
    "customer": [("c_nationkey", "nation", "n_nationkey")],
    "supplier": [("s_nationkey", "nation", "n_nationkey")],
    "orders": [("o_custkey", "customer", "c_custkey")],
    "lineitem": [("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"), ("l_suppkey", "supplier", "s_suppkey")],
    "events": [("user_id", "customer", "c_custkey")],
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> Table:
    df = read(spark, sf_dir, name)
    return Table(df, schema_of(df, name, KEYS.get(name, ()), tuple(ForeignKey((c,), p, (r,)) for c, p, r in REFERENCES.get(name, ()))))


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir) and the SQL it equals."""

    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return keep


def select_rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# ---------------------------------------------------------------- profiles

for _table, _column in (("orders", "o_totalprice"), ("lineitem", "l_extendedprice"), ("customer", "c_acctbal"), ("events", "value")):
    query(
        f"""SELECT count({_column})::BIGINT AS n, count(*) FILTER (WHERE {_column} IS NULL)::BIGINT AS n_null, count(DISTINCT {_column})::BIGINT AS n_distinct, round(min({_column}), 6) AS min, round(max({_column}), 6) AS max,
        round(avg({_column}), 4) AS mean, round(coalesce(stddev_samp({_column}), 0), 4) AS std, {", ".join(f"round(quantile_cont({_column}, {q}), 6) AS q{int(q * 100):02d}" for q in profile.QUANTILES)} FROM {_table}""",
        f"profile_numeric_{_table}",
    )(lambda s, d, t=_table, c=_column: select_rounded(profile.numeric_summary(read(s, d, t), c)).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)}))

for _table, _column in (("lineitem", "l_extendedprice"), ("orders", "o_totalprice")):
    query(f"WITH s AS (SELECT min({_column}) AS low, max({_column}) AS high FROM {_table}) SELECT least(floor(({_column} - low) / ((high - low) / 10)), 9)::INT AS bin, count(*)::BIGINT AS n FROM {_table}, s GROUP BY 1", f"profile_histogram_{_table}")(
        lambda s, d, t=_table, c=_column: profile.histogram(read(s, d, t), c)
    )
for _table, _column in (("orders", "o_orderpriority"), ("events", "event_type"), ("documents", "lang"), ("part", "p_type")):
    query(f"SELECT {_column} AS value, count(*)::BIGINT AS n FROM {_table} WHERE {_column} IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 20", f"profile_categories_{_table}")(lambda s, d, t=_table, c=_column: profile.top_categories(read(s, d, t), c))
for _table, _column in (("orders", "o_orderdate"), ("events", "ts")):
    query(f"SELECT 'dow' AS part, (isodow({_column}) - 1)::INT AS value, count(*)::BIGINT AS n FROM {_table} GROUP BY 2 UNION ALL SELECT 'month', month({_column})::INT, count(*)::BIGINT FROM {_table} GROUP BY 2", f"profile_calendar_{_table}")(
        lambda s, d, t=_table, c=_column: profile.calendar_counts(read(s, d, t), c)
    )
for _table, _column in (("documents", "text"), ("part", "p_name")):
    query(f"SELECT count({_column})::BIGINT AS n, min(length({_column}))::INT AS min_length, max(length({_column}))::INT AS max_length, round(avg(length({_column})), 6) AS mean_length FROM {_table}", f"profile_text_lengths_{_table}")(
        lambda s, d, t=_table, c=_column: select_rounded(profile.text_lengths(read(s, d, t), c))
    )


@query("SELECT column_name AS \"column\", n::BIGINT AS n, n_distinct::BIGINT AS n_distinct FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, count(DISTINCT {c}) AS n_distinct FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")) + ")")
def profile_nulls_distinct(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    row = df.agg(*(x for c in df.columns for x in (F.count(c).alias(f"{c}__n"), F.count_distinct(c).alias(f"{c}__d"))))
    return row.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("n"), F.col(f"{c}__d").alias("n_distinct")) for c in df.columns))))


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "WITH r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in MEASURES) + " FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS rho FROM r" for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :])
)
def spearman_matrix(spark, sf_dir):
    return correlate.spearman_pairs(read(spark, sf_dir, "lineitem").select(*MEASURES), MEASURES)


def _cramer_sql(table: str, pairs: list[tuple[str, str]]) -> str:
    one = """SELECT '{a}' AS a, '{b}' AS b, round(sqrt(greatest(sum(o * o / (r * c)) - 1, 0) / (least(count(DISTINCT x), count(DISTINCT y)) - 1)), 6) AS v
    FROM (SELECT x, y, o, sum(o) OVER (PARTITION BY x) AS r, sum(o) OVER (PARTITION BY y) AS c FROM (SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS o FROM {t} GROUP BY 1, 2))"""
    return " UNION ALL ".join(one.format(a=a, b=b, t=table) for a, b in pairs)


@query(_cramer_sql("lineitem", [("l_returnflag", "l_linestatus")]))
def cramers_v_lineitem(spark, sf_dir):
    return correlate.cramers_v(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query(_cramer_sql("orders", [("o_orderstatus", "o_orderpriority")]))
def cramers_v_orders(spark, sf_dir):
    return correlate.cramers_v(read(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


# ---------------------------------------------------------------- sources, keys, samples


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5(concat_ws('|', '7', c_custkey::VARCHAR)), c_custkey LIMIT 100")
def sample_top_n(spark, sf_dir):
    return sample_rows(read(spark, sf_dir, "customer"), 100, 7, ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT s, CASE WHEN regexp_full_match(s, '-?[0-9]+') THEN try_cast(s AS BIGINT) ELSE round_even(try_cast(s AS DOUBLE), 0)::BIGINT END AS as_integer, try_cast(s AS DOUBLE) AS as_float FROM (VALUES ('5'), ('2.5'), ('3.5'), ('-0.5'), ('1e3'), ('abc'), ('9007199254740993'), (NULL)) t(s)")
def normalize_export(spark, sf_dir):
    df = spark.createDataFrame([(x,) for x in ("5", "2.5", "3.5", "-0.5", "1e3", "abc", "9007199254740993", None)], "s string")
    return df.select("s", normalized(F.col("s"), LogicalType.INTEGER).alias("as_integer"), normalized(F.col("s"), LogicalType.FLOAT).alias("as_float"))


@query(" UNION ALL ".join(f"SELECT '{t}.{c}' AS edge, count(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {r} FROM {p}))::BIGINT AS orphans FROM {t}" for t, e in REFERENCES.items() for c, p, r in e))
def fk_orphans(spark, sf_dir):
    one = lambda t, c, p, r: relate.fk_orphans(read(spark, sf_dir, t), [c], read(spark, sf_dir, p), [r]).agg(F.count("*").alias("orphans")).select(F.lit(f"{t}.{c}").alias("edge"), "orphans")
    return reduce(DataFrame.unionAll, (one(t, *x) for t, e in REFERENCES.items() for x in e))


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def pk_duplicates(spark, sf_dir):
    return relate.duplicate_keys(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT * FROM (VALUES (0, 'part'), (1, 'region'), (2, 'nation'), (3, 'customer'), (4, 'supplier'), (5, 'events'), (6, 'orders'), (7, 'lineitem')) t(place, \"table\")")
def topological_levels(spark, sf_dir):
    order = relate.topological_order({t: table(spark, sf_dir, t).schema for t in (*KEYS, "lineitem", "events")})
    return spark.createDataFrame(list(enumerate(order)), "place int, table string")


# ---------------------------------------------------------------- generation

GEN = 5000


@query(f"SELECT i AS position, {uniform_sql("'7'", "'t'", "'c'", "'value'", "'0'", 'i::VARCHAR')} AS u FROM range({GEN}) t(i)")
def gen_uniform(spark, sf_dir):
    return spark.range(GEN).select(F.col("id").alias("position"), uniform(7, "t", "c", "value", 0, F.col("id")).alias("u"))


def price_profile(spark, sf_dir) -> ColumnProfile:
    """Range and histogram of order prices."""
    df = read(spark, sf_dir, "orders")
    row = df.agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.count("o_totalprice").alias("n")).first()
    p = ColumnProfile("o_totalprice", LogicalType.FLOAT, row["n"], 0, row["n"], NumericStats(row["low"], row["high"], 0.0, 0.0, {}))
    profile.fill_histograms(df, [p], profile.BINS)
    return p


def one_column(p: ColumnProfile) -> Profile:
    from .model import Column, TableSchema

    return Profile(TableSchema("t", (Column(p.name, p.logical_type),)), p.count + p.null_count, [p])


def draw_one(spark, p: ColumnProfile, condition=None) -> DataFrame:
    return spark.range(GEN).select(F.col("id").alias("position"), generate.draw(one_column(p), p.name, 7, F.col("id"), condition=condition, formats=False).alias("v"))


U = lambda c: uniform_sql("'7'", "'t'", f"'{c}'", "'value'", "'0'", "i::VARCHAR")
PRICE_CDF = """WITH s AS (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS n FROM orders),
h AS (SELECT least(floor((o_totalprice - low) / ((high - low) / 10)), 9)::INT AS bin, count(*) AS c FROM orders, s GROUP BY 1),
b AS (SELECT k.k AS bin, low + (high - low) * k.k / 10 AS e0, CASE WHEN k.k = 9 THEN high ELSE low + (high - low) * (k.k + 1) / 10 END AS e1, coalesce(c, 0) AS c, n, low, high FROM range(10) k(k) CROSS JOIN s LEFT JOIN h ON h.bin = k.k),
f AS (SELECT *, coalesce(sum(c) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / n AS c0, (sum(c) OVER (ORDER BY bin))::DOUBLE / n AS c1 FROM b)"""


@query(f"{PRICE_CDF}, u AS (SELECT i, {U('o_totalprice')} AS u FROM range({GEN}) t(i)) SELECT i AS position, round(least(greatest(e0 + (u - c0) / (c1 - c0) * (e1 - e0), low), high), 6) AS v FROM u JOIN f ON u >= c0 AND u < c1")
def gen_numeric(spark, sf_dir):
    return select_rounded(draw_one(spark, price_profile(spark, sf_dir)))


@query(f"WITH u AS (SELECT i, {U('c')} AS u FROM range({GEN}) t(i)) SELECT i AS position, [ 'a', 'b', 'c' ][CASE WHEN u < 0.5 THEN 1 WHEN u < 0.75 THEN 2 ELSE 3 END] AS v FROM u")
def gen_categorical(spark, sf_dir):
    return draw_one(spark, ColumnProfile("c", LogicalType.CATEGORICAL, 4, 0, 3, categories=[("a", 2), ("b", 1), ("c", 1)]))


@query(f"WITH u AS (SELECT i, {U('d')} AS u FROM range({GEN}) t(i)) SELECT i AS position, TIMESTAMP '2024-01-01' + to_microseconds(least(floor(u * (86400000000.0::DOUBLE * 31 + 1)), 86400000000 * 31)::BIGINT) AS v FROM u")
def gen_datetime(spark, sf_dir):
    from .model import DatetimeStats

    return draw_one(spark, ColumnProfile("d", LogicalType.DATETIME, 1, 0, 1, datetime=DatetimeStats("2024-01-01 00:00:00", "2024-02-01 00:00:00")))


@query(f"WITH u AS (SELECT i, {U('n')} AS u, {uniform_sql("'7'", "'t'", "'n'", "'null'", 'i::VARCHAR')} AS z FROM range({GEN}) t(i)) SELECT i AS position, CASE WHEN z >= 0.25 THEN CASE WHEN u < 0.5 THEN 'x' ELSE 'y' END END AS v FROM u")
def gen_nulls(spark, sf_dir):
    return draw_one(spark, ColumnProfile("n", LogicalType.CATEGORICAL, 3, 1, 2, categories=[("x", 1), ("y", 1)]))


@query(f"""WITH u AS (SELECT i, md5(concat_ws('|', '7', 't', 'w', 'value', '0', i::VARCHAR)) AS h, (3 + floor({U('w')} * 6))::INT AS n FROM range({GEN}) t(i))
SELECT i AS position, list_aggregate(list_transform(range(1, n + 1), lambda k: chr((97 + ('0x' || substr(md5(h || k::VARCHAR), 1, 8))::BIGINT % 26)::INT)), 'string_agg', '') AS v FROM u""")
def gen_text(spark, sf_dir):
    from .model import TextStats

    return draw_one(spark, ColumnProfile("w", LogicalType.STRING, 1, 0, 1, text=TextStats(3, 8, 5.0)))


@query(f"SELECT i AS position, 42.5::DOUBLE AS v FROM range({GEN}) t(i)")
def gen_where_equals(spark, sf_dir):
    return draw_one(spark, price_profile(spark, sf_dir), generate.Equals("o_totalprice", "42.5"))


@query(f"{PRICE_CDF}, a AS (SELECT max(CASE WHEN 50000 >= e0 AND 50000 < e1 THEN c0 + (c1 - c0) * (50000 - e0) / (e1 - e0) END) AS a, max(CASE WHEN 90000 >= e0 AND 90000 < e1 THEN c0 + (c1 - c0) * (90000 - e0) / (e1 - e0) END) AS b FROM f), u AS (SELECT i, a + {U('o_totalprice')} * (b - a) AS u FROM range({GEN}) t(i), a) SELECT i AS position, round(least(greatest(e0 + (u - c0) / (c1 - c0) * (e1 - e0), 50000), 90000), 4) AS v FROM u JOIN f ON u >= c0 AND u < c1")
def gen_where_between(spark, sf_dir):
    return select_rounded(draw_one(spark, price_profile(spark, sf_dir), generate.Between("o_totalprice", "50000", "90000")), 4)


@query(f"WITH u AS (SELECT i, {U('c')} AS u FROM range({GEN}) t(i)) SELECT i AS position, CASE WHEN u < 0.75 THEN 'a' ELSE 'z' END AS v FROM u")
def gen_where_members(spark, sf_dir):
    return draw_one(spark, ColumnProfile("c", LogicalType.CATEGORICAL, 4, 0, 3, categories=[("a", 2), ("b", 1), ("c", 1)]), generate.Members("c", ("a", "z", "a")))


@query()
def gen_copula(spark, sf_dir):
    """Rows that follow the rank correlations of a profile of line items."""
    known = profile.profile_table(Table((d := read(spark, sf_dir, "lineitem").select(*MEASURES)), schema_of(d, "lineitem")))
    return generate.synthesize(spark, known, GEN, 7).df


@query()
def gen_formatted(spark, sf_dir):
    return spark.range(GEN).select("id", *(generate.formatted(k, 7, k, F.col("id")).alias(k) for k in ("email", "phone", "uuid", "name")))


# ---------------------------------------------------------------- relations


@query(f"SELECT i AS o_orderkey, floor({uniform_sql("'7'", "'orders'", "'o_custkey'", "'fk'", 'i::VARCHAR')} * 1500)::BIGINT AS o_custkey FROM range({GEN}) t(i)")
def rel_fk_position(spark, sf_dir):
    return spark.range(GEN).select(F.col("id").alias("o_orderkey"), relate.parent_position(7, "orders", "o_custkey", F.col("id"), 1500).alias("o_custkey"))


@query(f"WITH s AS (SELECT i, ((i::HUGEINT * {relate.coprime_step(2000 * 100, 7)} + 7) % 200000)::BIGINT AS slot FROM range({GEN}) t(i)) SELECT i AS position, slot // 100 AS partkey, slot % 100 AS suppkey FROM s")
def rel_junction_pk(spark, sf_dir):
    part, supplier = relate.junction_positions(F.col("id"), [2000, 100], GEN, 7)
    return spark.range(GEN).select(F.col("id").alias("position"), part.alias("partkey"), supplier.alias("suppkey"))


@query(f"SELECT i AS position, 1000 + i AS a, 1000 + {GEN} + i AS b FROM range({GEN}) t(i)")
def rel_shared_keys(spark, sf_dir):
    bases = relate.shared_key_bases({"t": (["a", "b"], 1000, GEN)})
    return spark.range(GEN).select(F.col("id").alias("position"), *(relate.position_key(F.col("id"), v).alias(c) for (_, c), v in bases.items()))


@query("SELECT c_custkey, c_mktsegment || CASE WHEN k > 1 THEN '-' || (k - 1)::VARCHAR ELSE '' END AS c_mktsegment FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS k FROM customer)")
def rel_unique_dedupe(spark, sf_dir):
    return relate.unique_values(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey")


@query("SELECT o_orderkey, o_custkey + 1000000 AS o_custkey FROM orders")
def rel_remap_keys(spark, sf_dir):
    mapping = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1_000_000).alias("new"))
    return relate.remap_keys(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", mapping)


_LINEITEM = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@query(f"SELECT row_number() OVER (ORDER BY {', '.join(_LINEITEM)}) - 1 AS row_id, {', '.join(_LINEITEM[:3])} FROM lineitem")
def row_numbers_lineitem(spark, sf_dir):
    made = chaos.with_row_ids(table(spark, sf_dir, "lineitem"), list(_LINEITEM))
    return made.df.select(chaos.ROW, *_LINEITEM[:3])


@query()
def xcorr_reorder(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    joined = orders.join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey", "left")
    return relate.induce_rank_correlation(joined, "o_orderkey", "o_totalprice", "c_acctbal", 0.8, 7, "orders")


SUBSET = """WITH c0 AS (SELECT c_custkey, c_nationkey FROM customer ORDER BY md5(concat_ws('|', '7', c_custkey::VARCHAR)), c_custkey LIMIT (SELECT greatest(1, round_even(count(*) * 0.1, 0))::BIGINT FROM customer)),
o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c0)), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
SELECT 'customer' AS "table", count(*)::BIGINT AS n FROM c0 UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM l
UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c0)
UNION ALL SELECT 'region', count(*) FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c0))"""


@query(SUBSET)
def subset_down_up(spark, sf_dir):
    names = ("region", "nation", "customer", "orders", "lineitem")
    kept = relate.subset_tables({t: table(spark, sf_dir, t) for t in names}, "customer", 0.1, 7)
    return reduce(DataFrame.unionAll, (df.agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "n") for t, df in kept.items()))


@query("SELECT c_custkey + 10 AS c_custkey, c_mktsegment, FALSE AS is_fixture FROM customer UNION ALL VALUES (1::BIGINT, 'PINNED', TRUE), (2::BIGINT, NULL, TRUE)")
def fixtures_overlay(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select((F.col("c_custkey") + 10).alias("c_custkey"), "c_mktsegment")
    return relate.overlay_fixtures(Table(df, schema_of(df, "customer", ("c_custkey",))), [{"c_custkey": 1, "c_mktsegment": "PINNED"}, {"c_custkey": 2}], 10).df


# ---------------------------------------------------------------- guard and filters


@query("""WITH g AS (SELECT DISTINCT sha256('2:s1' || c_name) AS d FROM customer WHERE c_custkey % 3 = 0), x AS (SELECT sha256('2:s1' || c_name) AS d FROM customer)
SELECT 'c_name' AS "column", count(*)::BIGINT AS n, count(*) FILTER (WHERE d IN (SELECT d FROM g))::BIGINT AS leaked FROM x""")
def guard_membership(spark, sf_dir):
    t = table(spark, sf_dir, "customer")
    known = guard.build_guard(t.with_df(t.df.where("c_custkey % 3 = 0")), ["c_name"], "s1")
    return guard.collisions(t, known, ["c_name"], "s1")


_PII_SQL = {
    "email": f"regexp_matches(text, '{pii.EMAIL}')", "ssn": f"regexp_matches(text, '{pii.SSN}')", "iban": f"regexp_matches(text, '{pii.IBAN}')",
    "phone": f"regexp_matches(text, '{pii.PHONE}') AND regexp_matches(text, '{pii.PHONE_MARK}')",
}
_WORDS = "(SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS text FROM documents)"


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, count(*)::BIGINT AS n, count(*) FILTER (WHERE {x})::BIGINT AS matched FROM {_WORDS}" for k, x in _PII_SQL.items()))
def pii_match_rates(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \n]+")).alias("text"))
    return guard_rates(words).where(F.col("kind").isin(*_PII_SQL)).select("kind", "n", "matched")


def guard_rates(words: DataFrame) -> DataFrame:
    return profile.pii_rates(words, ["text"])


@query()
def pii_card_ip_rates(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \n]+")).alias("text"))
    return guard_rates(words).where(F.col("kind").isin("credit_card", "ip"))


@query("SELECT * FROM (VALUES ('c_name', 'name'), ('c_phone', 'phone'), ('zip_code', 'postal_code'), ('c_acctbal', NULL)) t(\"column\", hint)")
def pii_name_hints(spark, sf_dir):
    return spark.createDataFrame([(c, pii.name_hint(c)) for c in ("c_name", "c_phone", "zip_code", "c_acctbal")], "column string, hint string")


@query("WITH m AS (SELECT median(value) AS med FROM events), a AS (SELECT median(abs(value - med)) AS mad, any_value(med) AS med FROM events, m) SELECT event_id, round(value, 6) AS value FROM events, a WHERE 0.6745 * abs(value - med) / mad <= 4")
def outlier_filter(spark, sf_dir):
    return select_rounded(guard.outlier_filter(read(spark, sf_dir, "events").select("event_id", "value"), ["value"], 4.0))


_NEAR = "WITH s AS (SELECT stddev_pop(c_acctbal) AS s FROM customer), p AS (SELECT s_suppkey, min(abs((s_acctbal - c_acctbal) / s)) AS d FROM supplier, customer, s GROUP BY 1)"


def _balances(spark, sf_dir) -> tuple[Table, DataFrame]:
    df = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"))
    return Table(df, schema_of(df, "supplier")), read(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("balance"))


@query(f"{_NEAR} SELECT s_suppkey, round(d, 9) AS distance FROM p")
def nearest_real_distance(spark, sf_dir):
    t, ref = _balances(spark, sf_dir)
    return select_rounded(guard.nearest_reference_distance(t, ref, "s_suppkey", ["balance"]), 9)


@query(f"{_NEAR} SELECT supplier.s_suppkey, s_acctbal AS balance FROM supplier JOIN p ON p.s_suppkey = supplier.s_suppkey WHERE d >= 0.001")
def similarity_filter(spark, sf_dir):
    t, ref = _balances(spark, sf_dir)
    return guard.similarity_filter(t, ref, "s_suppkey", ["balance"], 0.001)


# ---------------------------------------------------------------- chaos


def orders_table(spark, sf_dir) -> Table:
    t = table(spark, sf_dir, "orders")
    return t.with_df(t.df.withColumn(chaos.ROW, F.col("o_orderkey")).select(chaos.ROW, *t.schema.names))


def _chosen(mutator: str, column: str, share: float) -> str:
    return f"(SELECT o_orderkey FROM orders WHERE {column} IS NOT NULL ORDER BY md5(concat_ws('|', '7', '{mutator}', '{column}', o_orderkey::VARCHAR)), o_orderkey LIMIT (SELECT greatest(1, round_even({share} * count({column}), 0))::BIGINT FROM orders))"


def _token(mutator: str, column: str, tokens: tuple[str, ...]) -> str:
    return f"[{', '.join(repr(t) for t in tokens)}][('0x' || substr(md5(concat_ws('|', '7', '{mutator}', '{column}', 'token', o_orderkey::VARCHAR)), 1, 8))::BIGINT % {len(tokens)} + 1]"


def _cells(name: str, column: str, value: str, old: str, share: float = 0.05) -> str:
    return f"SELECT o_orderkey, CASE WHEN o_orderkey IN {_chosen(name, column, share)} THEN {value} ELSE {old} END AS v FROM orders"


def _mutated(spark, sf_dir, mutator: chaos.Mutator, column: str) -> DataFrame:
    made, _ = mutator.apply(orders_table(spark, sf_dir), 7)
    return made.df.select("o_orderkey", F.col(column).alias("v"))


_SIDE = "('0x' || substr(md5(concat_ws('|', '7', 'outlier', 'o_totalprice', 'side', o_orderkey::VARCHAR)), 1, 1))::INT < 8"


@query(_cells("outlier", "o_totalprice", f"round(CASE WHEN {_SIDE} THEN (SELECT max(o_totalprice) + 3 * (max(o_totalprice) - min(o_totalprice)) FROM orders) ELSE (SELECT min(o_totalprice) - 3 * (max(o_totalprice) - min(o_totalprice)) FROM orders) END, 4)", "round(o_totalprice, 4)"))
def chaos_outlier(spark, sf_dir):
    return select_rounded(_mutated(spark, sf_dir, chaos.Outlier(columns=("o_totalprice",)), "o_totalprice"), 4)


@query(_cells("text_in_numeric", "o_custkey", _token("text_in_numeric", "o_custkey", chaos.NUMBER_TOKENS), "o_custkey::VARCHAR"))
def chaos_text_in_numeric(spark, sf_dir):
    return _mutated(spark, sf_dir, chaos.text_in_numeric(columns=("o_custkey",)), "o_custkey")


@query(_cells("invalid_date", "o_orderdate", _token("invalid_date", "o_orderdate", chaos.DATE_TOKENS), "strftime(o_orderdate, '%Y-%m-%d')"))
def chaos_invalid_date(spark, sf_dir):
    return _mutated(spark, sf_dir, chaos.invalid_date(columns=("o_orderdate",)), "o_orderdate").withColumn("v", F.regexp_replace("v", " [0-9:.]+$", ""))


@query(f"SELECT o_orderkey, o_orderkey IN {_chosen('broken_encoding', 'o_orderpriority', 0.05)} AS broken FROM orders")
def chaos_broken_encoding(spark, sf_dir):
    t = orders_table(spark, sf_dir)
    made, _ = chaos.broken_encoding(columns=("o_orderpriority",)).apply(t, 7)
    return made.df.join(t.df.select("o_orderkey", F.col("o_orderpriority").alias("old")), "o_orderkey").select("o_orderkey", (F.col("o_orderpriority") != F.col("old")).alias("broken"))


@query(_cells("oversized_string", "o_orderpriority", "repeat('A', 1000)", "o_orderpriority"))
def chaos_oversized_string(spark, sf_dir):
    return _mutated(spark, sf_dir, chaos.OversizedString(columns=("o_orderpriority",), size=1000), "o_orderpriority")


@query(_cells("illegal_null", "o_orderstatus", "NULL", "o_orderstatus"))
def chaos_illegal_null(spark, sf_dir):
    return _mutated(spark, sf_dir, chaos.IllegalNull(columns=("o_orderstatus",)), "o_orderstatus")


@query("WITH s AS (SELECT min(o_orderkey) AS k FROM orders), h AS (SELECT o_orderkey FROM orders, s WHERE o_orderkey <> k ORDER BY md5(concat_ws('|', '7', 'duplicate_keys', 'o_orderkey', o_orderkey::VARCHAR)), o_orderkey LIMIT (SELECT greatest(1, round_even(0.1 * (count(*) - 1), 0))::BIGINT FROM orders)) SELECT o_orderkey AS row_id, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM h) THEN k ELSE o_orderkey END AS o_orderkey FROM orders, s")
def chaos_duplicate_keys(spark, sf_dir):
    made, _ = chaos.DuplicateKeys().apply(orders_table(spark, sf_dir), 7)
    return made.df.select("row_id", "o_orderkey")


@query(_cells("orphan_fk", "o_custkey", "(SELECT max(o_custkey) + 1000000001 FROM orders)", "o_custkey", 0.1))
def chaos_orphan_fk(spark, sf_dir):
    return _mutated(spark, sf_dir, chaos.OrphanFk(), "o_custkey")


@query("SELECT r_name AS r_name__renamed, 'chaos' AS chaos_extra FROM region")
def chaos_structural(spark, sf_dir):
    t = table(spark, sf_dir, "region")
    made, _ = chaos.apply_chaos(t, [chaos.MissingField(), chaos.ExtraField(), chaos.RenamedColumn(), chaos.ChangedType(columns=("chaos_extra",))], 7)
    return made.df


_POLICY = [("outlier", {"columns": ["o_totalprice"]}), ("illegal_null", {"columns": ["o_orderpriority"]})]


@query("SELECT 'rows' AS what, round_even(0.1 * count(*), 0)::BIGINT AS n FROM orders UNION ALL SELECT 'cells', (2 * round_even(0.1 * count(*), 0))::BIGINT FROM orders")
def chaos_mixed_policy(spark, sf_dir):
    t = orders_table(spark, sf_dir)
    made, _ = chaos.apply_policy(t, _POLICY, 7, rate=0.1)
    cells = chaos.changed_cells(t.df, made.df, t.schema.names)
    return cells.agg(F.count_distinct("row").alias("n")).select(F.lit("rows").alias("what"), "n").unionAll(cells.agg(F.count("*").alias("n")).select(F.lit("cells").alias("what"), "n"))


@query("SELECT TRUE AS valid, 0::BIGINT AS unlisted, 0::BIGINT AS absent")
def manifest_audit(spark, sf_dir):
    t = orders_table(spark, sf_dir)
    made, manifest = chaos.apply_policy(t, _POLICY, 7, rate=0.1)
    audit = chaos.audit_manifest(t, made, manifest)
    return spark.createDataFrame([(audit.valid, audit.unlisted, audit.absent)], "valid boolean, unlisted long, absent long")


# ---------------------------------------------------------------- evaluation

_KS = "WITH b AS (SELECT l_extendedprice AS x, count(*) AS a, count(*) FILTER (WHERE l_quantity > 10) AS b FROM lineitem GROUP BY 1), c AS (SELECT sum(a) OVER (ORDER BY x) AS a, sum(b) OVER (ORDER BY x) AS b, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM b)"


@query(f"{_KS} SELECT round(1 - max(abs(a::DOUBLE / na - b::DOUBLE / nb)), 9) AS score FROM c")
def ks_complement(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    return select_rounded(evaluate.ks_complement(df.select(F.col("l_extendedprice").alias("x")), df.where("l_quantity > 10").select(F.col("l_extendedprice").alias("x"))), 9)


@query("WITH v AS (SELECT l_returnflag, count(*)::DOUBLE / (SELECT count(*) FROM lineitem) AS a, count(*) FILTER (WHERE l_quantity > 25)::DOUBLE / (SELECT count(*) FROM lineitem WHERE l_quantity > 25) AS b FROM lineitem GROUP BY 1) SELECT round(1 - sum(abs(a - b)) / 2, 9) AS score FROM v")
def tv_complement(spark, sf_dir):
    count = lambda df: df.groupBy(F.col("l_returnflag").alias("value")).agg(F.count("*").alias("n"))
    df = read(spark, sf_dir, "lineitem")
    return select_rounded(evaluate.tv_complement(count(df), count(df.where("l_quantity > 25"))), 9)


@query("WITH c AS (SELECT l_linestatus, l_returnflag, count(*) AS c FROM lineitem GROUP BY 1, 2) SELECT sum(n)::BIGINT AS n, round(sum(best)::DOUBLE / sum(n), 9) AS accuracy FROM (SELECT max(c) AS best, sum(c) AS n FROM c GROUP BY l_linestatus)")
def attribute_inference_mode(spark, sf_dir):
    return select_rounded(evaluate.mode_accuracy(read(spark, sf_dir, "lineitem"), "l_linestatus", "l_returnflag"), 9)


_BIN = "least(floor((l_extendedprice - 1000) / 4900.0::DOUBLE), 9)::INT"


@query(f"SELECT b.b::INT AS bin, round((SELECT count(*) FROM lineitem WHERE l_extendedprice BETWEEN 1000 AND 50000 AND {_BIN} = b.b)::DOUBLE / (SELECT count(*) FROM lineitem), 9) AS source, round((SELECT count(*) FROM lineitem WHERE l_quantity > 10 AND l_extendedprice BETWEEN 1000 AND 50000 AND {_BIN} = b.b)::DOUBLE / (SELECT count(*) FROM lineitem WHERE l_quantity > 10), 9) AS made FROM range(10) b(b)")
def compare_histograms(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("x"), "l_quantity")
    return select_rounded(evaluate.histogram_comparison(df, df.where("l_quantity > 10"), 1000, 50000), 9)


@query()
def fidelity_of_generated(spark, sf_dir):
    """Scores of a generated customer table."""
    t = table(spark, sf_dir, "customer")
    known = profile.profile_table(t)
    report = evaluate.fidelity_report(known, generate.synthesize(spark, known, 2000, 7))
    return spark.createDataFrame([(c, s, s >= report.tolerance) for c, s in report.columns.items()], "column string, score double, passed boolean")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*)::BIGINT AS n, 0::BIGINT AS n_null, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return select_rounded(event_monitor(read(spark, sf_dir, "events")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile customers and orders, generate related tables, and score them: (table, column, score, passed)."""
    tables = {t: table(spark, sf_dir, t) for t in ("customer", "orders")}
    known = {t: profile.profile_table(v) for t, v in tables.items()}
    made = relate.generate_related(spark, known, {"customer": 1000, "orders": 5000}, 7)
    rows = []
    for t, v in made.items():
        report = evaluate.fidelity_report(known[t], v)
        rows += [(t, c, s, s >= report.tolerance) for c, s in report.columns.items()]
    return spark.createDataFrame(rows, "table string, column string, score double, passed boolean")
