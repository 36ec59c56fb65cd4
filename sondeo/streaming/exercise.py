"""The exercise filter and theme counts over files that arrive bit by bit.

Both read new files only, go on from their checkpoint, and give what the batch operators give
over all files.  An event may come again, and out of order by up to ``delay``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class LateRowsError(ValueError):
    """Rows came later than the delay allows, so the streaming result lacks them."""


def arriving(spark: SparkSession, path: str, ddl: str, files_at_once: int = 1000) -> DataFrame:
    """New Parquet files of a folder, as a stream."""
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files_at_once).parquet(path)


def once_each(events: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Events without repetitions that come within ``delay`` of event time.  State holds
    the keys of that span only."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def exercise_stream(events: DataFrame, out: str, checkpoint: str, unit: str | None, form: str, days: list[str], ids: list[int] = (), *, unit_col: str, form_col: str, ts_col: str, id_col: str, delay: str = "2 days") -> StreamingQuery:
    """Writes events of the exercise to ``out``: ``kind=kept``, and ``kind=late`` for those of
    its unit and form on other days, until all files present are read.

    A batch's folder is named by its number and overwritten when the batch is run again after
    a failure, so each event is there once.  Raises :class:`LateRowsError` where events came
    later than ``delay``; they are neither in one output nor the other."""
    from ..operators.survey import slug_text
    from ..functions import text as T

    slug = lambda c: F.coalesce(T.slug_spaces(F.col(c)), F.lit(""))
    mine = (F.lit(True) if unit is None else slug(unit_col).contains(slug_text(unit))) & (slug(form_col) == slug_text(form))
    chosen = F.coalesce(F.date_format(ts_col, "yyyy-MM-dd").isin(*days) | F.col(id_col).isin(*ids), F.lit(False))
    rows = once_each(events, id_col, ts_col, delay).filter(mine).withColumn("kind", F.when(chosen, "kept").otherwise("late"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{out}/batch={number}")

    return finished(rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def counts_stream(events: DataFrame, out: str, checkpoint: str, label: str, ts: str, key: str, width: str = "1 day", delay: str = "2 days") -> StreamingQuery:
    """Writes ``(from, label, n)`` to ``out``: events of each label by window of event time,
    once no further one can come.  Windows within ``delay`` of the last event stay open."""
    n = once_each(events, key, ts, delay).groupBy(F.window(ts, width).alias("w"), label).agg(F.count("*").alias("n"))
    rows = n.select(F.col("w.start").alias("from"), label, "n")
    return finished(rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def finished(query: StreamingQuery) -> StreamingQuery:
    """The query after its last batch, if no row came too late."""
    query.awaitTermination()
    late = sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
    if late:
        raise LateRowsError(f"{late} rows came later than the delay")
    return query


def outcome(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """The kept and the late events of :func:`exercise_stream` so far."""
    rows = spark.read.parquet(out).drop("batch")
    return rows.filter("kind = 'kept'").drop("kind"), rows.filter("kind = 'late'").drop("kind")
