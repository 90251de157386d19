"""What the operators of this subpackage share: tables, scratch storage, Arrow batches and the label split."""

from __future__ import annotations

import tempfile
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch, stored, temporary  # noqa: F401  the operators take them from here

#: ASCII white space of the word and line rules: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; operators take another one as a parameter."""
    return public_tokenizers.path(name)


def prepare(spark: SparkSession) -> SparkSession:
    """Ship this package to the executors once a session, and bound the Arrow batches by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", None) is None:
        top = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp()) / "tessera_src.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        context.addPyFile(str(target))
        context._tessera_shipped = str(target)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, whole."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a worker that is made once a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                yield each(batch)

    return df.mapInArrow(run, schema)


def is_held_out(doc_id: str = "doc_id"):
    """True where crc32 of the decimal id is 2 modulo 4: rows that no model may learn from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2
