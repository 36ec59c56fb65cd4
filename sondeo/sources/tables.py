"""Tables between the steps of a flow, and the batches of a task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).  Where the session names
    none: a temporary one if Spark runs on this machine alone, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: the boundary between the
    steps of a flow, and a way to compute once what several branches of a plan read."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], text: str, rows: int = 1000, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches of a task in slices of up to ``rows`` rows and ``most`` bytes of text, or of
    one row.  They are views: only what is read of one becomes Python objects, so the memory of
    these follows the bound and not the batch."""
    for b in batches:
        first, held = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(b[text]), 0).to_pylist()):
            if i > first and (i - first == rows or held + n > most):
                yield b.slice(first, i - first)
                first, held = i, 0
            held += n
        if first < b.num_rows:
            yield b.slice(first)


def record_batch(rows: Iterable[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    """Rows with the columns ``kinds``; a float that is no number is null, as pandas has it."""
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k, from_pandas=True) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))
