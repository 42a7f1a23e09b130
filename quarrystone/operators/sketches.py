"""Sketches stored a day and merged into any period: distinct counts and quantiles in bounded space, with a stated error.

A day's row is small however many rows the day has, and a period is made from its days'
rows alone. Exact counts and percentiles are in ``aggregates``; these are for periods over
so many rows that keeping every distinct value is what they can't afford.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_error(lg_k: int = 14, deviations: float = 3.0) -> float:
    """Relative error of distinct counts that holds but for the chance of so many standard deviations."""
    return deviations * 1.04 / (1 << lg_k) ** 0.5


def rank_error(k: int = 400) -> float:
    """Error of a quantile's rank, as a part of all values, with a confidence of 99 %."""
    return 2.296 / k**0.9021


def day_sketches(rows: DataFrame, day: Column, distinct: list[str], measured: list[str], lg_k: int = 14, k: int = 400) -> DataFrame:
    """``(usage_date, n, <column>_seen..., <column>_spread...)`` per day: sketches of the distinct values of ``distinct`` and of the values of ``measured``.

    Null values are in none; rows without a day are left out. Sketches of days can be written
    and read again like other columns.
    """
    seen = [F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(f"{c}_seen") for c in distinct]
    spread = [F.kll_sketch_agg_double(F.col(c).cast("double"), k).alias(f"{c}_spread") for c in measured]
    return rows.withColumn("usage_date", day.cast("date")).where("usage_date is not null").groupBy("usage_date").agg(F.count(F.lit(1)).alias("n"), *seen, *spread)


def merged(sketches: DataFrame, period: Column, quantiles: tuple[float, ...] = (0.5, 0.9, 0.95)) -> DataFrame:
    """Per ``period`` (a column over ``usage_date``) days, rows, estimated distinct values, and each quantile as ``<column>_p<percent>``, null without values."""
    names = lambda end: [c.removesuffix(end) for c in sketches.columns if c.endswith(end)]
    distinct, measured = names("_seen"), names("_spread")
    whole = sketches.groupBy(period.alias("period")).agg(
        F.count(F.lit(1)).alias("days"), F.sum("n").alias("n"), *[F.hll_union_agg(f"{c}_seen").alias(f"{c}_seen") for c in distinct], *[F.kll_merge_agg_double(f"{c}_spread").alias(f"{c}_spread") for c in measured]
    )
    some = lambda c: F.kll_sketch_get_n_double(f"{c}_spread") > 0
    points = [F.when(some(c), F.kll_sketch_get_quantile_double(f"{c}_spread", F.lit(q))).alias(f"{c}_p{round(100 * q)}") for c in measured for q in quantiles]
    return whole.select("period", "days", "n", *[F.hll_sketch_estimate(f"{c}_seen").alias(c) for c in distinct], *points)
