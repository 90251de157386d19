"""Line dedup with levelled sorted runs of line hashes.

Documents come in batches, each made of whole partitions of the table. The distinct line keys of a batch are hashed and counted; the batch
is merge-anti-joined with keys that the runs already hold often enough (nothing more is to be learned about them), and what is left becomes
a sorted run of level 0. Where that would fill a level with `fan_out` runs, the batch and those runs become one run of the next level at
once, so a key lies in few runs and is rewritten a logarithmic number of times; what the last batch has left is counted with all runs and
never written. Runs are bucketed and sorted tables, so joins read old runs without a shuffle.

Few files are made, as Hadoop starts a process for the permissions of each file that it makes in a local folder without native code.

Every row of the input counts as a document. A null or empty text is one empty line; empty keys are never dropped. Rows with one
id, or a null id, lose the lines that any row of that id is to lose. Runs are removed when the frequent keys are known.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, map_arrow, scratch, stored, temporary

BATCHES, FAN_OUT, MIN_DOCUMENTS = 4, 2, 10


def line_key(line: bytes) -> bytes:
    """ASCII lower case (bytes know no other) without blanks at the ends, hashed to 16 bytes; empty for an empty key."""
    key = line.strip(SPACES).lower()
    return xxhash.xxh3_128_digest(key) if key else b""


def keyed_lines(docs: DataFrame, batches: int) -> DataFrame:
    """(doc_id, batch, key) for each distinct key of each row. A partition is of one batch, so a task writes one file for it."""

    def make():
        number = TaskContext.get().partitionId() % batches

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, at = [], []
            for k, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                own = {line_key(x) for x in (text or b"").split(b"\n")} - {b""}
                keys += own
                at += [k] * len(own)
            return pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.binary()), pa.array([number] * len(keys), pa.int32())], ["doc_id", "key", "batch"])

        return each

    return map_arrow(docs.select("doc_id", "text"), make, "doc_id long, key binary, batch int")


class SortedRuns:
    """Levels of runs (key, n), each a table that is bucketed and sorted by key."""

    def __init__(self, spark: SparkSession, fan_out: int) -> None:
        self.spark, self.fan_out, self.levels = spark, fan_out, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.made: list[str] = []

    def _write(self, counted: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        dealt = counted.repartition(self.buckets, "key")
        dealt.write.bucketBy(self.buckets, "key").sortBy("key").option("path", scratch(self.spark, "run")).saveAsTable(name)
        self.made.append(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def unsettled(self, counted: DataFrame, settled: int) -> DataFrame:
        """What a batch has of keys that no run holds `settled` times."""
        for run in self.runs():
            counted = counted.join(run.where(F.col("n") >= settled), "key", "left_anti")
        return counted

    def add(self, counted: DataFrame) -> None:
        """Write a batch as a run, together with the runs of all levels that it would fill."""
        merged, level = [counted], 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fan_out - 1:
            merged += [self.spark.table(x) for x in self.levels[level]]
            self.levels[level] = []
            level += 1
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(self._write(self._total(merged)))

    @staticmethod
    def _total(runs: list[DataFrame]) -> DataFrame:
        """Counts of all runs, by merge joins: a union of bucketed scans must not be aggregated, as Spark takes it to be dealt by
        key where its columnar form is not."""
        merged = runs[0]
        for run in runs[1:]:
            both = F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))
            merged = merged.join(run.select("key", F.col("n").alias("more")), "key", "full").select("key", both.alias("n"))
        return merged

    def frequent(self, counted: DataFrame, least: int) -> DataFrame:
        """Keys that a last batch and all runs together hold so often."""
        return self._total([counted, *self.runs()]).where(F.col("n") >= least).select("key")

    def drop(self) -> None:
        """Forget all runs; their files lie in scratch."""
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def frequent_keys(lines: DataFrame, batches: int, least: int, fan_out: int) -> DataFrame:
    """Written once, so that a join with lines reads both sides from shuffles, where a very common key can be split."""
    runs = SortedRuns(lines.sparkSession, fan_out)
    with temporary(lines.sparkSession):
        for b in range(batches):
            fresh = runs.unsettled(lines.where(F.col("batch") == b).groupBy("key").agg(F.count("*").alias("n")), least)
            if b < batches - 1:
                runs.add(fresh)
        found = stored(runs.frequent(fresh, least).hint("rebalance"), "frequent", keep=True)
        runs.drop()
    return found


def drop_frequent_lines(docs: DataFrame, least: int = MIN_DOCUMENTS, batches: int = BATCHES, fan_out: int = FAN_OUT) -> DataFrame:
    """The table with each text rid of lines whose key occurs in so many documents, and the columns __n_lines and __n_dropped."""
    spark = docs.sparkSession
    path = scratch(spark, "lines")
    keyed_lines(docs, batches).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, key binary, batch int").parquet(path)
    hits = lines.join(frequent_keys(lines, batches, least, fan_out), "key", "left_semi").groupBy(F.col("doc_id").alias("__hit_id")).agg(F.collect_set("key").alias("__keys"))
    kind = T.StructType().add("text", T.StringType()).add("n_lines", T.LongType()).add("n_dropped", T.LongType())

    @F.arrow_udf(kind)
    def rewrite(texts: pa.Array, keys: pa.Array) -> pa.Array:
        out, total, dropped = [], [], []
        for text, bad in zip(texts.cast(pa.binary()).to_pylist(), keys.to_pylist(), strict=True):
            own = (text or b"").split(b"\n")
            bad = set(bad or ())
            left = [x for x in own if line_key(x) not in bad] if bad else own
            out.append(text if len(left) == len(own) else b"\n".join(left))
            total.append(len(own))
            dropped.append(len(own) - len(left))
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], ["text", "n_lines", "n_dropped"])

    joined = docs.join(hits, docs["doc_id"].eqNullSafe(hits["__hit_id"]), "left")
    made = joined.withColumn("__new", rewrite(F.col("text"), F.col("__keys")))
    return made.select(*(F.col("__new.text").alias("text") if c == "text" else docs[c] for c in docs.columns), F.col("__new.n_lines").alias("__n_lines"), F.col("__new.n_dropped").alias("__n_dropped"))


def line_digests(docs: DataFrame, **options: int) -> DataFrame:
    """Per document: its lines, the dropped ones and a digest of what is left."""
    made = drop_frequent_lines(docs.select("doc_id", "text"), **options)
    return made.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
