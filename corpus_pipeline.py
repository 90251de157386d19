"""A corpus pipeline: quality rules, language identification, line dedup, near-duplicate removal and packing.

Each stage takes (spark, docs, sf_dir) and works on every row that the one before kept. All but the last return the columns that they were
given; rows with nulls are judged as the operators state. Columns beyond those of `documents` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, lines, near, packing, rules
from tessera.llm.common import prepare, scratch, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rule or the risk-controlled cutoffs reject."""
    prepare(spark)
    rungs = rules.select_rungs(stored(rules.count_signals(docs), "signals"), table(spark, sf_dir, "labels"))
    return docs.where(rules.accepted(docs["text"], rungs))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language the model can't name with a probability of a half."""
    prepare(spark)
    return docs.where(langid.accepted(langid.train(docs), docs["text"]))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that ten documents or more share; the character count follows the text."""
    prepare(spark)
    made = lines.drop_frequent_lines(docs).drop("__n_lines", "__n_dropped")
    return made.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else made


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class of near duplicates (five words, 0.8)."""
    prepare(spark)
    gone = near.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens: a row per piece."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("best_fit_packing", best_fit_packing)]
#: SQL can't express a fitted language model; tests hold run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
