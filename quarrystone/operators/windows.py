"""Rankings, queues, samples and bounds: one window each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.plans.shared import dealt


def rank_postings(scored: DataFrame, top: int | None = None) -> DataFrame:
    """``scored`` with ``rank`` per profile: guaranteed minimum, maximum, newest, company, id."""
    w = Window.partitionBy("profile_id").orderBy(F.desc("score_min"), F.desc("score_max"), F.desc_nulls_last("posted_at"), F.asc_nulls_last("company"), "posting_id")
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= top) if top else ranked


def inspection_queue(postings: DataFrame, url: str, provider: str, reference: Column, pending: Column, caps: int, bands: tuple[int, ...] = (3, 7, 14, 30), term: str | None = None, target: Column | None = None) -> DataFrame:
    """Per provider the first ``caps`` URLs to inspect: fresh bands before old, never inspected before stale, high scores, newest.

    With ``term`` and ``target``, URLs whose postings all name another term come last of
    all, and within a band the target term comes before unknown ones.
    """
    named = F.lower(F.trim(F.coalesce(F.col(term), F.lit("")))) if term else F.lit("")
    wanted = F.lower(F.trim(target)) if target is not None else F.lit("")
    fits = F.max(F.when(named == wanted, 2).when(named == "", 1).otherwise(0))
    rows = postings.select(url, provider, "posted_at", "score", pending.cast("int").alias("_pending"), *([term] if term else []))
    groups = dealt(rows, url, provider).groupBy(url, provider).agg(F.max("posted_at").alias("newest"), F.max("score").alias("score"), F.max("_pending").alias("pending"), (2 - fits).alias("term_band"))
    age = F.floor((reference.cast("double") - F.col("newest").cast("double")) / 86400)
    band = F.when(age.isNotNull(), F.lit(len(bands))).otherwise(len(bands) + (1 if term else 0))
    for i, days in reversed(list(enumerate(bands))):
        band = F.when(age <= days, i).otherwise(band)
    w = Window.partitionBy(provider).orderBy((F.col("term_band") == 2).cast("int"), F.desc("pending"), "band", "term_band", F.desc_nulls_last("score"), F.desc_nulls_last("newest"), url)
    return groups.withColumn("band", band).withColumn("position", F.row_number().over(w)).where(F.col("position") <= caps)


def budget_queue(rows: DataFrame, order: list[Column], cost: str, budget: float, within: list[str]) -> DataFrame:
    """Rows in order while the running cost stays within the budget of their group."""
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def quota_interleave(rows: DataFrame, dated: Column, order: list[Column], limit: int, share: float = 0.75) -> DataFrame:
    """``limit`` rows of which ``share`` are dated while both kinds last; then whatever is left, in order.

    Only the first ``limit`` rows of each kind can be taken, so each kind is cut by a
    top-k before any numbering.
    """
    kinds = []
    for kind in (True, False):
        kinds.append(rows.where(F.coalesce(dated, F.lit(False)) == kind).orderBy(*order).limit(limit).withColumn("_dated", F.lit(kind)))
    both = kinds[0].unionByName(kinds[1])
    w = Window.partitionBy("_dated").orderBy(*order)
    quota = F.when(F.col("_dated"), F.ceil(F.lit(limit * share))).otherwise(limit - F.ceil(F.lit(limit * share)))
    placed = both.withColumn("_n", F.row_number().over(w)).withColumn("_late", (F.col("_n") > quota).cast("int"))
    return placed.orderBy("_late", F.desc("_dated"), "_n").limit(limit).drop("_dated", "_n", "_late")


def stratified_sample(rows: DataFrame, key: str, labels: str, limit: int) -> DataFrame:
    """Round-robin over labels in hash order, each row once: the n-th row of every label before the (n+1)-th of any.

    A label needs no more than its first ``limit`` rows; what remains is at most
    labels times ``limit`` rows.
    """
    held = rows.select(key, F.explode(labels).alias("label"), F.sha2(F.col(key).cast("string"), 256).alias("h"))
    w = Window.partitionBy("label").orderBy("h", key)
    turn = held.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= limit)
    once = turn.groupBy(key).agg(F.min(F.struct("turn", "label")).alias("t")).select(key, "t.turn", "t.label")
    return once.orderBy("turn", "label").limit(limit)


def hash_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` rows of least key hash."""
    return rows.orderBy(F.sha2(F.col(key).cast("string"), 256), key).limit(limit)


SORTS = {
    "newest": lambda: [F.desc_nulls_last("posted_at"), F.asc_nulls_last("company"), F.asc("id")],
    "oldest": lambda: [F.asc_nulls_last("posted_at"), F.asc_nulls_last("company"), F.asc("id")],
    "company": lambda: [F.asc_nulls_last("company"), F.desc_nulls_last("posted_at"), F.asc("id")],
    "closest": lambda: [F.asc_nulls_last("distance"), F.desc_nulls_last("posted_at"), F.asc("id")],
}


def sorted_by(rows: DataFrame, mode: str) -> DataFrame:
    return rows.orderBy(*SORTS[mode]())


def prune_by_bound(scored: DataFrame, gain: str, k: int, per: str = "profile_id", floor: str = "score_min", top: str = "score_max") -> DataFrame:
    """Rows whose best total (``top`` + ``gain``) reaches the k-th largest sure total (``floor``) of their profile."""
    w = Window.partitionBy(per).orderBy(F.desc(floor))
    cutoff = scored.select(per, floor, F.row_number().over(w).alias("_n")).where(F.col("_n") <= k).groupBy(per).agg(F.min(floor).alias("cutoff"), F.count(F.lit(1)).alias("_c"))
    return scored.join(cutoff, per).where((F.col("_c") < k) | (F.col(top) + F.col(gain) >= F.col("cutoff"))).drop("_c")


def rerank(ranked: DataFrame, changed: DataFrame, ids: DataFrame) -> DataFrame:
    """Old scores without the changed ids, with the new scores, ranked again."""
    keys = ["profile_id", "posting_id"]
    kept = ranked.drop("rank").join(ids, keys, "left_anti")
    return rank_postings(kept.unionByName(changed.select(kept.columns)))


def latest_non_null(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Per key the newest value of each field that is not null."""
    newest = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    return rows.groupBy(key).agg(*newest)


def best_base(pairs: DataFrame) -> DataFrame:
    """Per posting and profile the base of the best score, then the nearest, then the first; and the least distance."""
    best = F.max(F.struct("score", F.negative("distance").alias("d"), F.negative("position").alias("p"), "base"))
    return pairs.groupBy("profile_id", "posting_id").agg(best["base"].alias("base"), F.min("distance").alias("nearest"))


def order_locations(places: DataFrame) -> DataFrame:
    """Per posting its places by distance to the first base, then to any base, then as given. ``places``: posting_id, pos, value, first_distance, least_distance."""
    far = F.lit(float("inf"))
    item = F.struct(F.coalesce("first_distance", far).alias("a"), F.coalesce("least_distance", far).alias("b"), "pos", "value")
    return places.groupBy("posting_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["value"]).alias("places"))


def freshness_sla(observations: DataFrame, group: str, reference: Column, evidence: DataFrame, days: int = 3, target: float = 0.9) -> DataFrame:
    """Share of fresh posting groups that have evidence, against a target."""
    fresh = F.max((F.col("posted_at").cast("double") >= reference.cast("double") - days * 86400).cast("int"))
    groups = observations.groupBy(group).agg(fresh.alias("f")).where("f = 1").join(evidence.select(group).distinct().withColumn("has", F.lit(1)), group, "left")
    out = groups.agg(F.count(F.lit(1)).alias("fresh_groups"), F.count("has").alias("covered")).withColumn("ratio", F.when(F.col("fresh_groups") > 0, F.col("covered") / F.col("fresh_groups")))
    return out.withColumn("met", F.coalesce(F.col("ratio") >= target, F.lit(False)))
