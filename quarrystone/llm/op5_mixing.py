"""Mixing sources to target weights by hash-threshold histograms.

Each source's budget is reached by whole passes over the source plus one partial
pass, which takes the documents whose hash lies below a threshold. Thresholds of
all sources are found together: sum tokens by source and hash bucket, find the
bucket in which the budget falls, and look into that bucket only, until it is a
single hash. A larger budget's threshold is never below a smaller one's, so the
mixes nest. Documents are then filtered by comparing hashes; nothing is sorted.

Defined results: null text counts 0 words and takes 0; a null source is a source
of its own, last in order; rows with the same identity share a hash and are taken
together, and so are rows without an identity; an empty table gives no rows; texts are
counted whole; other columns pass through, but ``source_size``, ``target`` and ``takes``
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import fresh, materialize, read_table, word_count

#: Hashes have 48 bits, read in three steps of 16.
BITS, STEP = 48, 16


def mix_hash(identity: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(identity.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, max_repeats: int) -> DataFrame:
    """``(source, source_size)`` to targets that share all sizes by weights 1, 2, 3, repeating.

    A target stops at ``max_repeats`` times its source; the rest is shared anew by
    weight. That ends at one water level L with target = min(cap, weight * L): the
    sources by cap per weight, the first ones capped. One row per source is read.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rows = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * float(max_repeats))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    upto = level.rowsBetween(Window.unboundedPreceding, -1)
    ahead = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(ahead))
    # the first source whose cap is not below its share sets the level
    open_level = F.min(F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    return rows.withColumn("target", F.when(open_level.isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * open_level))).select("source", "source_size", "weight", "target")


def hash_thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """``(source, full, threshold)``: take each document ``full`` times, and once more if its hash is below ``threshold``.

    ``rows`` has source, size, hash; ``budgets`` source, source_size, target.
    """
    state = budgets.select(
        "source",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int").alias("full"),
        "source_size", "target",
    ).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("bigint"))
    state = state.select("source", "full", "rest", "prefix")
    shift = BITS
    while shift > 0:
        shift -= STEP
        inside = rows.join(state.select(F.col("source").alias("s"), "prefix"), F.col("source").eqNullSafe(F.col("s"))).where(F.shiftright("hash", shift + STEP) == F.col("prefix"))
        cells = inside.groupBy("source", F.shiftright("hash", shift).alias("cell")).agg(F.sum("size").alias("w"))
        run = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("before", F.coalesce(F.sum("w").over(run), F.lit(0)))
        near = cells.join(state.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        # the last cell that begins at or before the budget holds the boundary
        edge = near.where(F.col("before") <= F.col("rest")).groupBy("source").agg(F.max_by(F.struct("cell", "before", "w"), "cell").alias("e"))
        state = state.alias("a").join(edge.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select(
            "a.source", "full", (F.col("rest") - F.coalesce("e.before", F.lit(0))).alias("rest"), F.coalesce("e.cell", F.col("prefix") * (1 << STEP)).alias("prefix"), F.coalesce("e.w", F.lit(0)).alias("w"),
        )
        state = materialize(state, "mix-state") if shift else state
        if shift:
            state = state.drop("w")
    # the boundary is one hash: take it if that comes nearer to the budget
    nearer = F.col("w") - F.col("rest") < F.col("rest")
    return state.select("source", "full", (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("threshold"))


def mix_sources(rows: DataFrame, max_repeats: int = 3) -> DataFrame:
    """``rows`` (source, size, hash and more) with source_size, target and ``takes``, the times a document is taken."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    budgets = materialize(source_targets(sizes, max_repeats), "mix-budgets")
    plan = hash_thresholds(rows.select("source", "size", "hash"), budgets)
    rules = materialize(budgets.alias("a").join(plan.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select(F.col("a.source").alias("_s"), "source_size", "target", "full", "threshold"), "mix-rules")
    names = fresh(rows.columns, "_s", "_source_size", "_target", "_full", "_threshold")
    s, own_size, target, full, threshold = map(F.col, names)
    takes = full + F.when((F.col("hash") < threshold) & (full < max_repeats), 1).otherwise(0)
    kept = [c for c in rows.columns if c.lower() not in ("source_size", "target", "takes")]
    return rows.join(rules.toDF(*names), F.col("source").eqNullSafe(s)).select(*kept, own_size.alias("source_size"), target.alias("target"), takes.alias("takes"))


def measured(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), mix_hash(F.col("doc_id")).alias("hash"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(measured(read_table(spark, sf_dir, "documents")), "mix-rows")
    return mix_sources(rows).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("takes")).cast("bigint").alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (a row taken twice comes twice)."""
    held = docs.select(F.struct(*docs.columns).alias("_row"), "source", word_count(F.col("text")).alias("size"), mix_hash(F.col("doc_id")).alias("hash"))
    rows = materialize(held.select("source", "size", "hash"), "mix-rows")
    budgets = materialize(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), 3), "mix-budgets")
    plan = materialize(hash_thresholds(rows, budgets), "mix-plan").toDF("_s", "full", "threshold")
    takes = F.col("full") + F.when((F.col("hash") < F.col("threshold")) & (F.col("full") < 3), 1).otherwise(0)
    mixed = held.join(plan, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_n", F.explode(F.array_repeat(F.lit(1), takes)))
    return mixed.select("_row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0 AS cap,
             sum(source_size) OVER () AS total FROM s),
lev AS (SELECT *, (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
lv AS (SELECT arg_min(level, cap / weight) AS level FROM lev WHERE cap >= weight * level),
t AS (SELECT lev.source, source_size, least(cap, weight * lv.level) AS target FROM lev, lv),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t),
hs AS (SELECT source, h, sum(size) AS w FROM d GROUP BY source, h),
c AS (SELECT hs.*, coalesce(sum(w) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hs),
e AS (SELECT c.source, max(c.h) AS h, arg_max(c.before, c.h) AS before, arg_max(c.w, c.h) AS w
      FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source WHERE c.before <= b.target - b.passes * b.source_size GROUP BY c.source),
r AS (SELECT b.*, e.h + CASE WHEN e.w - (target - passes * source_size - e.before) < (target - passes * source_size - e.before) THEN 1 ELSE 0 END AS threshold
      FROM b JOIN e ON b.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN h < threshold AND passes < 3 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
