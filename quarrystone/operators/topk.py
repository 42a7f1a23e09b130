"""The best postings of every profile, without meeting all pairs.

What a posting scores for a profile is a sum of points for what it asks and of what it is
worth to anybody (its date, its place in the market). So postings that ask the same are one
block, of which no more than the first k can be among anybody's best k; and a block's most
possible score is known before any profile is. Profiles that hold the same are one class.
Blocks are walked from the highest bound down: each round meets some times as many blocks
as all before, and a class goes on only while its k-th best score leaves room under the
bounds to come. Gates that are equalities (region, type, term) are keys of the join; the
rest are judged on classes and blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quarrystone.plans.shared import folder, stored


@dataclass
class Ranked:
    """``ranking(profile_id, posting_id, score, rank)``, how many pairs of class and block were judged, and of how many that share keys."""

    ranking: DataFrame
    judged: int
    possible: int


def top_postings(postings: DataFrame, profiles: DataFrame, keys: list[str], block: list[str], traits: list[str], judge: Callable[[DataFrame], DataFrame], most: Column, order: list[tuple[str, bool]], k: int = 10, step: float = 0.5, first: int = 64, grow: int = 4) -> Ranked:
    """For each profile its ``k`` best postings: by score, then ``order`` (columns, and whether they ascend; nulls last), then posting_id.

    postings: posting_id, ``keys``, ``block`` (all that ``judge`` reads of a posting), static (its own
    part of the score) and what ``order`` reads. profiles: profile_id, ``keys`` (a row for each that
    a profile admits) and ``traits`` (all that ``judge`` reads of a profile, equal in its rows).
    ``judge`` gives pairs a column ``points``; pairs that it drops, or whose points are null, are
    excluded. ``most`` is an upper bound of points over block columns; a lower one than points
    loses rows. Scores are static + points. Null keys meet nothing; a posting without a static
    part is left out.

    No task holds a key's blocks or a profile's pairs: bounds are dealt into bands of ``step``,
    and bands are counted. Results do not depend on ``step``, ``first`` and ``grow``.
    """
    spark = postings.sparkSession
    ties = {f"_o{i}": c for i, (c, _) in enumerate(order)}
    then = [F.asc_nulls_last(n) if up else F.desc_nulls_last(n) for n, (_, up) in zip(ties, order, strict=True)] + [F.asc("posting_id")]
    rows = postings.where("static is not null").select("posting_id", *keys, *block, F.col("static").cast("double").alias("static"), *[F.col(c).alias(n) for n, c in ties.items()])
    own = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, *block).orderBy(F.desc("static"), *then))).where(F.col("_n") <= k)
    blocks = own.groupBy(*keys, *block).agg(F.collect_list(F.struct("posting_id", "static", *ties)).alias("_own"), F.max("static").alias("_top"))
    blocks = stored(blocks.withColumn("_bound", F.col("_top") + most).withColumn("_band", F.floor(F.col("_bound") / step).cast("bigint")))
    counts = blocks.groupBy(*keys, "_band").agg(F.count(F.lit(1)).alias("_c"))
    above = Window.partitionBy(*keys).orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_c").over(above), F.lit(0))
    turn = F.when(before < first, 0).otherwise(F.floor(F.log(before / first) / F.log(F.lit(float(grow)))) + 1).cast("int")
    turns = counts.withColumn("_round", turn).select(*keys, "_band", "_round")
    at = folder(spark)
    blocks.join(turns, [*keys, "_band"]).write.partitionBy("_round").parquet(at)
    walk = spark.read.schema(blocks.withColumn("_round", F.lit(0)).schema).parquet(at)
    bounds = stored(walk.groupBy(*keys, "_round").agg(F.max("_bound").alias("_next"), F.count(F.lit(1)).alias("_blocks")))
    rounds = bounds.agg(F.coalesce(F.max("_round") + 1, F.lit(0))).first()[0]

    admits = profiles.groupBy("profile_id").agg(F.sort_array(F.collect_set(F.struct(*keys))).alias("_keys"), *[F.first(t).alias(t) for t in traits])
    admits = stored(admits)
    classes = admits.groupBy("_keys", *traits).agg(F.min("profile_id").alias("_class"))
    same = reduce(and_, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("_keys", *traits)])
    members = admits.alias("a").join(classes.alias("b"), same).select("a.profile_id", "b._class")
    walkers = stored(classes.select("_class", *traits, F.explode("_keys").alias("_k")).select("_class", *traits, "_k.*"))
    possible = walkers.select("_class", *keys).join(bounds, keys).agg(F.coalesce(F.sum("_blocks"), F.lit(0))).first()[0]

    top, judged = None, 0
    for r in range(rounds):
        active = walkers
        if top is not None:
            room = bounds.where(F.col("_round") >= r).groupBy(*keys).agg(F.max("_next").alias("_next"))
            kth = top.where(F.col("rank") == k).select("_class", F.col("score").alias("_kth"))
            active = walkers.join(room, keys).join(kth, "_class", "left").where("_kth is null or _next >= _kth").drop("_next", "_kth")
            if not active.limit(1).count():
                break
        seen = Observation()
        pairs = active.join(walk.where(F.col("_round") == r), keys).observe(seen, F.count(F.lit(1)).alias("n"))
        rows = judge(pairs).where("points is not null").select("_class", "points", F.explode("_own").alias("_p"))
        rows = rows.select("_class", "_p.*", (F.col("_p.static") + F.col("points")).alias("score")).drop("static")
        rows = rows if top is None else top.drop("rank").unionByName(rows)
        top = stored(rows.withColumn("rank", F.row_number().over(Window.partitionBy("_class").orderBy(F.desc("score"), *then))).where(F.col("rank") <= k))
        judged += seen.get["n"]
    if top is None:
        top = rows.select(F.lit(None).cast(dict(profiles.dtypes)["profile_id"]).alias("_class"), "posting_id", F.col("static").alias("score"), F.lit(0).alias("rank")).limit(0)
    return Ranked(top.join(members, "_class").select("profile_id", "posting_id", "score", "rank"), judged, possible)
