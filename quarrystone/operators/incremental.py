"""Work that depends on what was done before: caches, cooldowns, carry-over, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_hash(df: DataFrame, exclude: list[str] = ()) -> Column:
    return F.xxhash64(*[F.col(c) for c in sorted(df.columns) if c not in exclude])


def fingerprint(df: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """One row that equal tables share, whatever their order: count, xor and sum of row hashes, without volatile columns."""
    h = row_hash(df, exclude)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"))


def write_if_changed(df: DataFrame, path: str, exclude: list[str] = ()) -> bool:
    """Write ``df`` unless what lies at ``path`` has the same fingerprint; says whether it wrote."""
    spark = df.sparkSession
    try:
        old = spark.read.parquet(path)
        same = fingerprint(old, exclude).first() == fingerprint(df, exclude).first() and set(old.columns) == set(df.columns)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        same = False
    if not same:
        df.write.mode("overwrite").parquet(path)
    return not same


def last_good(cache: DataFrame, attempts: DataFrame, key: str, values: list[str]) -> DataFrame:
    """A success replaces the cached values; a failure keeps them and notes error and time. attempts: key, at, ok, error, values."""
    a = attempts.select(key, F.col("at").alias("_at"), "ok", F.col("error").alias("_error"), *[F.col(v).alias(f"_{v}") for v in values])
    both = cache.join(a, key, "full_outer")
    new = F.coalesce("ok", F.lit(False))
    return both.select(
        key, *[F.when(new, F.col(f"_{v}")).otherwise(F.col(v)).alias(v) for v in values], F.coalesce("_at", "last_attempted_at").alias("last_attempted_at"),
        F.when(new, F.col("_at")).otherwise(F.col("last_success_at")).alias("last_success_at"), F.when(F.col("_at").isNull(), F.col("last_error")).when(~new, F.col("_error")).alias("last_error"),
    )


def queue_state(supported: Column, success_at: Column, attempt_at: Column, failed: Column, reference: Column, ttl_days: float, cooldown_hours: float) -> Column:
    """``unsupported``, ``cached`` within its time to live, ``retry_cooldown`` after a failure, else ``queued``."""
    age = lambda c: reference.cast("double") - c.cast("double")
    fresh = age(success_at) <= ttl_days * 86400
    cooling = failed & (age(attempt_at) < cooldown_hours * 3600)
    return F.when(~supported, "unsupported").when(F.coalesce(fresh, F.lit(False)), "cached").when(F.coalesce(cooling, F.lit(False)), "retry_cooldown").otherwise("queued")


def freshness_verdict(runs: DataFrame, generated_at: Column, reference: Column, threshold_hours: float, progress_minutes: float, by: list[str] | None = None) -> DataFrame:
    """Whether a snapshot is stale, unless a run that began a moment ago is at it. runs: status, started_at.

    With ``by`` a verdict for each key, as of the latest ``reference`` of its runs. What was
    never generated has no age and is stale unless a run is at it; a run that begins after the
    reference is at it.
    """
    started = lambda status: F.max(F.when(F.col("status") == status, F.col("started_at")))
    keys = list(by or [])
    s = runs.groupBy(*keys).agg(started("in_progress").alias("_running"), F.max(generated_at).alias("_generated"), F.max(reference).alias("_reference"))
    now = F.col("_reference").cast("double")
    hours = (now - F.col("_generated").cast("double")) / 3600
    busy = now - F.col("_running").cast("double") <= progress_minutes * 60
    verdict = F.when(hours <= threshold_hours, "fresh").when(F.coalesce(busy, F.lit(False)), "in_progress").otherwise("stale")
    return s.select(*keys, hours.alias("age_hours"), verdict.alias("verdict"))


def carry_link_status(current: DataFrame, previous: DataFrame) -> DataFrame:
    """A posting whose URL is unchanged keeps its link status and the time it was checked."""
    p = previous.select("id", F.col("url").alias("_url"), F.col("link_status").alias("_s"), F.col("link_checked_at").alias("_c"))
    same = F.col("url").eqNullSafe(F.col("_url")) & F.col("_s").isNotNull()
    return current.join(p, "id", "left").withColumn("link_status", F.coalesce("link_status", F.when(same, F.col("_s")))).withColumn("link_checked_at", F.coalesce("link_checked_at", F.when(same, F.col("_c")))).drop("_url", "_s", "_c")


def validation_work(postings: DataFrame, reference: Column, ttl_hours: float, limit: int) -> DataFrame:
    """Links due for a check: never checked first, then the longest unchecked."""
    age = reference.cast("double") - F.col("link_checked_at").cast("double")
    due = F.col("url").isNotNull() & (F.col("link_checked_at").isNull() | (age > ttl_hours * 3600))
    return postings.where(due).orderBy(F.asc_nulls_first("link_checked_at"), "id").limit(limit)


def downgrade_dead(kind: Column, status: Column) -> Column:
    """Kind of a link after its check: a dead direct link is only a source."""
    return F.when((status == "dead") & kind.isin("direct", "employer_job"), "source").otherwise(kind)


def reuse_by_fingerprint(rows: DataFrame, cache: DataFrame, evidence: list[str], version: int, least: float) -> dict[str, DataFrame]:
    """``reused`` rows with the cached label of the same evidence, version and enough confidence; ``misses`` go on. cache: fp, version, confidence, label."""
    fp = rows.withColumn("fp", F.sha2(F.to_json(F.struct(*sorted(evidence))), 256))
    good = cache.where((F.col("version") == version) & (F.col("confidence") >= least)).groupBy("fp").agg(F.max_by("label", "confidence").alias("label"))
    return {"reused": fp.join(good, "fp"), "misses": fp.join(good, "fp", "left_anti")}


def migration_plan(cache: DataFrame, version: int, oldest: int) -> DataFrame:
    """Entries as ``current``, ``migrate`` (re-extract), ``invalidate`` (too old) or ``ignore`` (nothing to extract)."""
    plan = F.when(~F.col("has_text"), "ignore").when(F.col("version") == version, "current").when(F.col("version") >= oldest, "migrate").otherwise("invalidate")
    return cache.withColumn("plan", plan)


def resolution_summary(employers: DataFrame, attempts: DataFrame) -> DataFrame:
    """Employers by the outcome of their last attempt. attempts: employer_id, at, status, requests."""
    w = Window.partitionBy("employer_id").orderBy(F.desc("at"), F.desc("requests"), "status")
    last = attempts.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("employer_id", "status")
    total = attempts.groupBy("employer_id").agg(F.sum("requests").alias("requests"))
    rows = employers.select("employer_id").join(last, "employer_id", "left").join(total, "employer_id", "left")
    return rows.groupBy(F.coalesce("status", F.lit("not_attempted")).alias("outcome")).agg(F.count(F.lit(1)).alias("employers"), F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"))
