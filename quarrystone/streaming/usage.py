"""Usage batches as a stream: contract check, daily rollup, sequence de-duplication, last-good cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.incremental import last_good
from quarrystone.operators.predicates import usage_errors


def split_stream(batches: DataFrame, schema: str, events: list[str], accepted: Callable, rejected: Callable):
    """A query that hands each micro-batch's valid and rejected rows to two sinks (functions of rows and batch number)."""

    def hand(rows: DataFrame, number: int) -> None:
        checked = usage_errors(rows, schema, events).persist()
        try:
            accepted(checked.where("error is null").drop("error"), number)
            rejected(checked.where("error is not null"), number)
        finally:
            checked.unpersist()

    return batches.writeStream.foreachBatch(hand)


def once_per_sequence(batches: DataFrame, at: str, delay: str = "1 day") -> DataFrame:
    """Each (session, sequence) once within the watermark."""
    return batches.withWatermark(at, delay).dropDuplicatesWithinWatermark(["session_id", "sequence"])


def daily_rollup(batches: DataFrame, at: str, counters: list[str], delay: str = "2 days") -> DataFrame:
    """Per day: approximate visitors and sessions (a stream cannot count exactly; the batch rollup does) and counter sums."""
    days = batches.withWatermark(at, delay).groupBy(F.window(at, "1 day").alias("w"))
    out = days.agg(F.approx_count_distinct("visitor_id", 0.01).alias("visitors"), F.approx_count_distinct("session_id", 0.01).alias("sessions"), *[F.sum(c).alias(c) for c in counters])
    return out.select(F.to_date("w.start").alias("usage_date"), "visitors", "sessions", *counters)


def keep_last_good(attempts: DataFrame, path: str, key: str, values: list[str]):
    """A query that merges attempts into the cache table at ``path``, a new version per micro-batch."""

    def merge(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        try:
            cache = spark.read.parquet(f"{path}/version={number - 1}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            cache = spark.createDataFrame([], f"{key} {dict(rows.dtypes)[key]}, {', '.join(f'{v} {dict(rows.dtypes)[v]}' for v in values)}, last_attempted_at timestamp, last_success_at timestamp, last_error string")
        newest = rows.groupBy(key).agg(F.max_by(F.struct("at", "ok", "error", *values), "at").alias("x")).select(key, "x.*")
        last_good(cache, newest, key, values).write.mode("overwrite").parquet(f"{path}/version={number}")

    return attempts.writeStream.foreachBatch(merge)
