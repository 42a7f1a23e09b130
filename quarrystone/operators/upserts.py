"""Daily rollups that input batches can be replayed into, in any order and however late.

Rows are landed by day and batch, so landing a batch again replaces its own rows only. The
days that a batch touches, now or when it was landed before, are rolled up anew from all
their rows and replace their partitions; other days are not read. A manifest of batches, each
with a fingerprint and its days, is written last: a batch that is there unchanged is skipped,
and one that broke off before is done again from the start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators.incremental import fingerprint


def _found(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, None if there is none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at) else None


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def upsert_days(batch: DataFrame, batch_id: str, day: Column, path: str, rollup: Callable[[DataFrame], DataFrame]) -> list[str]:
    """Land ``batch`` and roll its days up; the days that were written, none if the batch is there unchanged.

    ``rollup`` gets rows with ``usage_date`` and gives rows with ``usage_date``, each from rows of
    its own day alone. Rows without a day are left out. ``path`` gets ``landed``, ``daily`` and
    ``manifest``. One writer at a time; days of a batch, a bounded number, pass the driver.
    """
    spark = batch.sparkSession
    rows = batch.withColumn("usage_date", day.cast("date")).where("usage_date is not null")
    mark = "/".join(map(str, fingerprint(rows).first()))
    manifest = _found(spark, f"{path}/manifest")
    known = manifest.where(F.col("batch_id") == batch_id).first() if manifest is not None else None
    if known and known["mark"] == mark:
        return []
    days = [r[0] for r in rows.select(F.col("usage_date").cast("string")).distinct().collect()]
    old = list(known["days"]) if known else []
    if not known and (landed := _found(spark, f"{path}/landed")) is not None:  # one that broke off
        old = [r[0] for r in landed.where(F.col("batch_id") == batch_id).select(F.col("usage_date").cast("string")).distinct().collect()]
    dynamic = {"partitionOverwriteMode": "dynamic"}
    rows.withColumn("batch_id", F.lit(batch_id)).write.partitionBy("usage_date", "batch_id").options(**dynamic).mode("overwrite").parquet(f"{path}/landed")
    for gone in set(old) - set(days):
        _drop(spark, f"{path}/landed/usage_date={gone}/batch_id={batch_id}")
    touched = sorted({*days, *old})
    if touched:
        landed = spark.read.option("basePath", f"{path}/landed").schema(rows.withColumn("batch_id", F.lit("")).schema).parquet(f"{path}/landed")
        done = rollup(landed.where(F.col("usage_date").isin([F.lit(d).cast("date") for d in touched])).drop("batch_id"))
        done.write.partitionBy("usage_date").options(**dynamic).mode("overwrite").parquet(f"{path}/daily")
        for gone in set(touched) - set(days):
            if not landed.where(F.col("usage_date") == F.lit(gone).cast("date")).limit(1).count():
                _drop(spark, f"{path}/daily/usage_date={gone}")
    entry = spark.createDataFrame([(batch_id, mark, days)], "batch_id string, mark string, days array<string>")
    entry.withColumn("entry", F.col("batch_id")).coalesce(1).write.partitionBy("entry").options(**dynamic).mode("overwrite").parquet(f"{path}/manifest")
    return touched
