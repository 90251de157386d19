"""Fidelity, quality and privacy of generated tables."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.model import NUMERIC, LogicalType, Profile, Table
from ..sources.scratch import stored
from . import correlate
from .generate import generate_marginals
from .guard import collisions, guard_of
from .profile import finite, text_of


def ks_complement(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row `score`: 1 - the largest gap between two distribution functions of a column `x`; null if a side is empty.

    Values are counted, dealt to range partitions and summed up within them; earlier partitions come in by their totals.
    """
    both = left.select(F.col("x").cast("double").alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(right.select(F.col("x").cast("double").alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    counted = both.where("x is not null and not isnan(x)").groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    dealt = stored(counted.repartitionByRange("x").withColumn("part", F.spark_partition_id()), "dealt")  # dealt once: borders are sampled
    sizes = dealt.groupBy("part").agg(F.sum("a").alias("pa"), F.sum("b").alias("pb"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    before = sizes.select("part", F.coalesce(F.sum("pa").over(w), F.lit(0)).alias("pa"), F.coalesce(F.sum("pb").over(w), F.lit(0)).alias("pb"))
    total = sizes.agg(F.sum("pa").alias("na"), F.sum("pb").alias("nb"))
    v = Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    upto = dealt.select("part", F.sum("a").over(v).alias("a"), F.sum("b").over(v).alias("b")).join(F.broadcast(before), "part").join(F.broadcast(total))
    gap = F.max(F.abs((F.col("a") + F.col("pa")) / F.col("na") - (F.col("b") + F.col("pb")) / F.col("nb")))
    ok = (F.min("na") > 0) & (F.min("nb") > 0)
    return upto.agg(F.when(ok, 1 - gap).alias("score"))


def tv_complement(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row `score`: 1 - half the sum of differences between two shares by category; inputs are (value, n)."""
    a, b = left.select("value", F.col("n").alias("a")), right.select("value", F.col("n").alias("b"))
    both = a.join(b, "value", "full_outer").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    totals = both.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    out = both.join(F.broadcast(totals)).agg(F.sum(F.abs(F.col("a") / F.col("ta") - F.col("b") / F.col("tb"))).alias("gap"), F.max("ta").alias("ta"), F.max("tb").alias("tb"))
    return out.select(F.when((F.col("ta") > 0) & (F.col("tb") > 0), 1 - F.col("gap") / 2).alias("score"))


@dataclass
class FidelityReport:
    columns: dict[str, float]
    correlation: float | None
    tolerance: float
    passed: bool
    failed: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def correlation_similarity(profile: Profile, df: DataFrame) -> float | None:
    """Mean of 1 - half the difference of rank correlations over pairs that the profile has."""
    names = [c for c in profile.numeric_columns if c in df.columns]
    if len(names) < 2:
        return None
    made = {(r["a"], r["b"]): r["rho"] for r in correlate.spearman_pairs(df, names).collect()}
    at = {c: k for k, c in enumerate(profile.numeric_columns)}
    scores = [1 - abs(profile.spearman[at[a]][at[b]] - (rho or 0.0)) / 2 for (a, b), rho in made.items() if profile.spearman[at[a]][at[b]] is not None]
    return round(sum(scores) / len(scores), 6) if scores else None


def fidelity_report(profile: Profile, table: Table, tolerance: float = 0.9, reference_rows: int = 2000) -> FidelityReport:
    """Score each column against what the profile itself generates, as many rows as the table has and `reference_rows` at least; a report that
    could compare nothing fails."""
    df = table.df
    reference = generate_marginals(df.sparkSession, profile, max(reference_rows, df.count()), 0).df
    scores: dict[str, float] = {}
    for p in profile.columns:
        if p.name not in df.columns:
            continue
        x = (lambda c: F.unix_micros(F.col(c).cast("timestamp"))) if p.logical_type is LogicalType.DATETIME else (lambda c: finite(F.col(c)))
        if p.numeric or p.datetime:
            got = ks_complement(reference.select(x(p.name).alias("x")), df.select(x(p.name).alias("x"))).first()["score"]
        elif p.categories:
            counted = df.where(F.col(p.name).isNotNull()).groupBy(text_of(F.col(p.name), p.logical_type).alias("value")).agg(F.count("*").alias("n"))
            got = tv_complement(counted, df.sparkSession.createDataFrame(p.categories, "value string, n long")).first()["score"]
        else:
            continue
        if got is not None:
            scores[p.name] = round(got, 6)
    similarity = correlation_similarity(profile, df)
    failed = [c for c, s in scores.items() if s < tolerance] + (["correlation"] if similarity is not None and similarity < tolerance else [])
    return FidelityReport(scores, similarity, tolerance, bool(scores) and not failed, failed)


def quality_score(report: FidelityReport) -> float | None:
    parts = [*report.columns.values(), *([report.correlation] if report.correlation is not None else [])]
    return sum(parts) / len(parts) if parts else None


def membership_risk(table: Table, guard: DataFrame | None, columns: list[str], salt: str | None) -> float | None:
    """The largest share of a column's non-null cells whose value the guard has."""
    if guard is None or not columns:
        return None
    shares = [r["leaked"] / r["n"] for r in collisions(table, guard, columns, salt or "").collect() if r["n"]]
    return max(shares) if shares else None


def mode_accuracy(df: DataFrame, predictor: str, target: str, most: int = 50) -> DataFrame:
    """(n, accuracy) of guessing a target by the most frequent value beside each predictor value; null beyond `most` predictor values or below twice as many rows."""
    cells = df.where(F.col(predictor).isNotNull() & F.col(target).isNotNull()).groupBy(predictor, target).agg(F.count("*").alias("c"))
    best = cells.groupBy(predictor).agg(F.max("c").alias("best"), F.sum("c").alias("n"))
    sums = best.agg(F.sum("n").alias("n"), F.sum("best").alias("hits"), F.count("*").alias("card"))
    return sums.select("n", F.when((F.col("card") <= most) & (F.col("n") >= 2 * F.col("card")), F.col("hits") / F.col("n")).alias("accuracy"))


def attribute_inference_risk(table: Table, sensitive: list[str]) -> float | None:
    """How well another column tells a sensitive one: absolute rank correlation over five rows or more, or accuracy of the conditional mode."""
    kinds = {c.name: c.logical_type for c in table.schema.columns}
    numeric = [c for c, k in kinds.items() if k in NUMERIC]
    few = [c for c, k in kinds.items() if k in (LogicalType.STRING, LogicalType.CATEGORICAL, LogicalType.BOOLEAN)]
    risks: list[float] = []
    if len(numeric) > 1 and any(s in numeric for s in sensitive):
        risks += [abs(r["rho"]) for r in correlate.spearman_pairs(table.df, numeric, 5).collect() if r["rho"] is not None and (r["a"] in sensitive or r["b"] in sensitive)]
    for p, t in permutations(few, 2):
        if t in sensitive and (a := mode_accuracy(table.df, p, t).first()["accuracy"]) is not None:
            risks.append(a)
    return round(max(risks), 6) if risks else None


@dataclass
class QualityPrivacyReport:
    quality: float | None
    membership: float | None
    attribute: float | None
    passed: bool
    failed: list[str]

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def quality_privacy_report(profile: Profile, table: Table, guard: DataFrame | None = None, tolerance: float = 0.9, membership_threshold: float = 0.0, attribute_threshold: float = 1.0) -> QualityPrivacyReport:
    """Membership is held against the profile's own guard by default; sensitive columns without a guard fail."""
    guard = guard_of(table.df.sparkSession, profile) if guard is None else guard
    quality = quality_score(fidelity_report(profile, table, tolerance))
    member = membership_risk(table, guard, list(profile.sensitive), profile.salt)
    attribute = attribute_inference_risk(table, list(profile.sensitive)) if profile.sensitive else None
    failed = [n for n, bad in (("quality", quality is None or not quality >= tolerance), ("membership", (guard is None and bool(profile.sensitive)) or (member is not None and member > membership_threshold)), ("attribute", attribute is not None and attribute > attribute_threshold)) if bad]
    return QualityPrivacyReport(quality, member, attribute, not failed, failed)


def evaluate(table: Table, run_mode: str, profile: Profile | None = None, baseline: Table | None = None, manifest: DataFrame | None = None, tolerance: float = 0.9):
    """Fidelity of faithful tables, the audit of chaotic ones."""
    from .chaos import audit_manifest

    if run_mode == "faithful" and profile is not None:
        return fidelity_report(profile, table, tolerance)
    if run_mode == "chaos" and baseline is not None and manifest is not None:
        return audit_manifest(baseline, table, manifest)
    raise ValueError(f"{run_mode} lacks what it is evaluated against")


def histogram_comparison(source: DataFrame, made: DataFrame, low: float, high: float, bins: int = 10) -> DataFrame:
    """(bin, source, made): shares of a column `x` by bin; what lies out of range counts in the total only."""
    from .profile import histogram_bin

    share = lambda df, out: df.where("x is not null").select(F.when(F.col("x").between(low, high), histogram_bin(F.col("x"), low, high, bins)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    total = lambda df: df.agg(F.count("x").alias("t"))
    every = source.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every
    for df, name in ((source, "source"), (made, "made")):
        out = out.join(share(df, name).withColumnRenamed("n", f"n_{name}"), "bin", "left").join(F.broadcast(total(df).withColumnRenamed("t", f"t_{name}")))
    return out.select("bin", *(F.coalesce(F.col(f"n_{n}") / F.col(f"t_{n}"), F.lit(0.0)).alias(n) for n in ("source", "made")))
