"""Set operations over snapshots and sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.text import message_template, signature


def ordered_union(sources: list[DataFrame]) -> DataFrame:
    """All sources in configured order, ``source_order`` saying which; missing columns are null."""
    numbered = [s.withColumn("source_order", F.lit(i)) for i, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def persistent_failures(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Sources that failed in both snapshots, by family and masked cause. Both: key, family, error."""
    both = current.join(previous.select("key").distinct(), "key", "left_semi").withColumn("cause", message_template(F.col("error")))
    return both.groupBy("family", "cause").agg(F.array_sort(F.collect_set("key")).alias("keys")).withColumn("signature", signature(F.col("family"), F.col("cause")))


def differences(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys expected and missing, and keys that were not expected."""
    e, a = expected.select(key).distinct(), actual.select(key).distinct()
    return e.join(a, key, "left_anti").select(F.lit("missing").alias("side"), key).unionByName(a.join(e, key, "left_anti").select(F.lit("unexpected").alias("side"), key))


def choose_snapshot(snapshots: DataFrame, now: Column, rich_hours: float) -> DataFrame:
    """One snapshot: the newest rich one not older than ``rich_hours``, else the newest valid one; never one from the future."""
    young = F.col("rich") & (F.col("at").cast("double") >= now.cast("double") - rich_hours * 3600)
    return snapshots.where(F.col("valid") & (F.col("at") <= now)).withColumn("_young", young).orderBy(F.desc("_young"), F.desc("at")).limit(1).drop("_young")


def changed_fields(old: DataFrame, new: DataFrame, key: str, groups: dict[str, list[str]]) -> DataFrame:
    """``(key, changed)``: the field groups in which two versions differ, null-safe."""
    cols = sorted({c for g in groups.values() for c in g})
    both = old.select(key, *cols).join(new.select(key, *[F.col(c).alias(f"_{c}") for c in cols]), key)
    differ = lambda g: reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in g])
    return both.select(key, F.array_compact(F.array(*[F.when(differ(g), F.lit(n)) for n, g in groups.items()])).alias("changed"))
