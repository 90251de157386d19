"""Tables in the shared store of a session, for what must be computed once and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Scratch folders of the innermost `temporary` block, which removes them at its end.
_IN_BLOCK: ContextVar[list[str] | None] = ContextVar("in_block", default=None)


def scratch(spark: SparkSession, tag: str, keep: bool = False) -> str:
    """A fresh folder name in the shared store that the session names; a machine-local one only on a local master that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        kept = getattr(context, "_tessera_scratch", None)
        if kept is None:
            kept = context._tessera_scratch = tempfile.mkdtemp(prefix="tessera-")
        base = f"file://{kept}"
    path = f"{base.rstrip('/')}/tessera-{tag}-{uuid.uuid4().hex}"
    if not keep and (block := _IN_BLOCK.get()) is not None:
        block.append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Scratch made inside is removed at the end, but for what is made with `keep`: nothing that outlives the block may read it."""
    paths: list[str] = []
    token = _IN_BLOCK.set(paths)
    try:
        yield
    finally:
        _IN_BLOCK.reset(token)
        jvm = spark.sparkContext._jvm
        for path in paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write a result to the shared store and read it back: cuts lineage and survives lost executors.

    Zstandard streams, whereas the default codec holds direct buffers for each column until a garbage collection.
    """
    path = scratch(df.sparkSession, tag, keep)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
