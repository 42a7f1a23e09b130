"""Reports over postings, sources and usage: one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """Percentage; 0 of nothing is 0."""
    return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)


def link_bucket(kind: Column, url: Column) -> Column:
    return (
        F.when(kind == "direct", "direct_employer_ats").when(kind == "listing", "aggregator_intermediary")
        .when(kind == "source", "unresolved_non_authoritative").when(url.isNotNull() & (url != ""), "employer_careers_page")
        .otherwise("unresolved_non_authoritative")
    )


BUCKETS = ["direct_employer_ats", "aggregator_intermediary", "unresolved_non_authoritative", "employer_careers_page"]


def source_contribution(postings: DataFrame) -> DataFrame:
    """Per source: postings, unique and overlapping ones, links by bucket, share of the feed."""
    total = postings.agg(F.count(F.lit(1)).alias("feed"))
    rows = postings.select(F.size("source_keys").alias("n"), link_bucket(F.col("link_kind"), F.col("url")).alias("b"), F.explode("source_keys").alias("source_key"))
    counted = rows.groupBy("source_key").agg(
        F.count(F.lit(1)).alias("final_jobs"), F.count_if(F.col("n") == 1).alias("unique_jobs"),
        *[F.count_if(F.col("b") == b).alias(b) for b in BUCKETS],
    )
    counted = counted.crossJoin(F.broadcast(total))  # one row
    return counted.select(
        "source_key", "final_jobs", "unique_jobs", (F.col("final_jobs") - F.col("unique_jobs")).alias("overlap_jobs"), *BUCKETS,
        share(F.col("unique_jobs"), F.col("feed")).alias("unique_percent_of_feed"), share(F.col("direct_employer_ats"), F.col("final_jobs")).alias("direct_link_percent"),
    )


def pairwise_overlap(postings: DataFrame) -> DataFrame:
    """Postings that two sources share; pairs come from each posting's own sorted array, so there is no self-join."""
    keys = F.array_sort("source_keys")
    pairs = F.flatten(F.transform(keys, lambda a, i: F.transform(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), lambda b: F.struct(a.alias("left"), b.alias("right")))))
    return postings.where(F.size("source_keys") > 1).select(F.explode(pairs).alias("p")).groupBy("p.left", "p.right").agg(F.count(F.lit(1)).alias("canonical_jobs"))


def zero_contribution(postings: DataFrame, health: DataFrame) -> DataFrame:
    """Working sources without a posting in the feed."""
    used = postings.select(F.explode("source_keys").alias("key")).distinct()
    return health.where(F.col("status").isin("healthy", "degraded")).join(used, "key", "left_anti").select("key")


def contribution_summary(postings: DataFrame) -> DataFrame:
    many = F.size("source_keys") > 1
    return postings.agg(
        F.count(F.lit(1)).alias("final_feed_jobs"), F.count_if(~many).alias("single_source_jobs"), F.count_if(many).alias("multi_source_jobs"),
        F.count_if(F.col("link_kind") == "direct").alias("direct_link_jobs"),
    ).withColumn("multi_source_percent", share(F.col("multi_source_jobs"), F.col("final_feed_jobs")))


def age_days(posted_at: Column, reference: Column) -> Column:
    return F.floor((reference.cast("double") - posted_at.cast("double")) / 86400)


def stale_report(postings: DataFrame, health: DataFrame, unavailable: DataFrame, reference: Column) -> DataFrame:
    """Counts of postings at risk: all sources failed, dead or unknown links, unavailable evidence, old or undated.

    ``unavailable`` holds ids of postings whose evidence is gone.
    """
    status = health.select("key", "status")
    exploded = postings.select("id", F.explode_outer("source_keys").alias("key")).join(status, "key", "left")
    failed = exploded.groupBy("id").agg((F.count_if(F.coalesce(F.col("status") == "failed", F.lit(False))) == F.count(F.lit(1))).alias("all_failed"))
    rows = postings.join(failed, "id").join(unavailable.select("id").distinct().withColumn("gone", F.lit(True)), "id", "left")
    dead, unknown = F.col("link_status") == "dead", (F.col("link_kind") == "direct") & (F.col("link_status") == "unknown")
    gone, age = F.coalesce("gone", F.lit(False)), age_days(F.col("posted_at"), reference)
    return rows.agg(
        F.count(F.lit(1)).alias("total_jobs"), F.count_if(F.col("all_failed")).alias("failed_source_only"), F.count_if(dead).alias("known_dead_links"),
        F.count_if(unknown).alias("unknown_direct_links"), F.count_if(gone).alias("unavailable_evidence"), F.count_if(age >= 90).alias("age_review_90d"),
        F.count_if(F.col("posted_at").isNull()).alias("missing_posted_at"), F.count_if(F.col("all_failed") | dead | unknown | gone).alias("at_risk_jobs"),
    )


def date_report(postings: DataFrame, observations: DataFrame, reference: Column) -> DataFrame:
    """Date provenance: missing and future dates, observations 7 days apart, aggregator dates newer than an authority's."""
    spread = observations.where(F.col("posted_at").isNotNull()).groupBy("posting_id").agg(
        F.min("posted_at").alias("oldest"), F.max("posted_at").alias("newest"), F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("posted_date_provenance").startswith("authoritative_"), F.col("posted_at"))).alias("authority"),
    )
    rows = postings.join(spread, postings["id"] == spread["posting_id"], "left")
    apart = F.col("newest").cast("double") - F.col("oldest").cast("double") >= 7 * 86400
    named = F.coalesce(F.col("posted_date_provenance") != "", F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("total_jobs"), F.count_if(F.col("posted_at").isNull()).alias("missing_date"),
        F.count_if(F.col("posted_at").isNotNull() & ~named).alias("missing_provenance"), F.count_if(F.col("posted_at") > reference).alias("future_dates"),
        F.count_if((F.col("n") >= 2) & apart).alias("conflicting"),
        F.count_if((F.col("posted_date_provenance") == "aggregator") & (F.col("posted_at") > F.col("authority"))).alias("aggregator_over_authority"),
    )


def count_by(df: DataFrame, *keys: str | Column, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def duplicate_rate(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """For each named key: rows, duplicates (rows beyond a key's first) and their rate. One pass: the keys are stacked."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("key"), c.cast("string").alias("value")) for n, c in keys.items()])).alias("k")).where("k.value is not null")
    groups = stacked.groupBy("k.key", "k.value").agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy("key").agg(F.sum("n").alias("keyed_rows"), F.sum(F.col("n") - 1).alias("duplicates")).withColumn("rate", share(F.col("duplicates"), F.col("keyed_rows")))


def largest_families(df: DataFrame, keys: list[Column], limit: int = 5) -> DataFrame:
    names = [f"k{i}" for i in range(len(keys))]
    return df.groupBy(*[k.alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), *names).limit(limit)


def gates(metrics: DataFrame, thresholds: dict[str, tuple[str, float]], required: dict[str, bool] | None = None) -> DataFrame:
    """Named checks over a one-row ``metrics``: gate, actual, target, measurable, passed, and ready over all.

    ``thresholds``: gate -> ("min" or "max", target). A gate without a measurement fails, unless ``required`` says it need not be measured: then it passes.
    """
    required = required or {}
    rows = F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).cast("double").alias("actual"), F.lit(float(t)).alias("target"), F.lit(way).alias("way"), F.lit(required.get(g, True)).alias("must")) for g, (way, t) in thresholds.items()])
    x = metrics.select(F.explode(rows).alias("x")).select("x.*")
    ok = F.when(F.col("way") == "min", F.col("actual") >= F.col("target")).otherwise(F.col("actual") <= F.col("target"))
    out = x.select("gate", "actual", "target", (F.col("actual").isNotNull() | ~F.col("must")).alias("measurable"), F.coalesce(ok, ~F.col("must")).alias("passed"))
    return out.withColumn("ready", F.min("passed").over(Window.partitionBy()))  # as many rows as gates


def distribution(df: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """Count and share of each value in each dimension, in one pass over stacked values; ``top`` marks the largest share."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.coalesce(c.cast("string"), F.lit("unknown")).alias("value")) for n, c in dims.items()])).alias("d"))
    counted = stacked.groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("n"))
    # one row per dimension, joined back, so that no task holds all values of one
    whole = counted.groupBy("dimension").agg(F.sum("n").alias("_all"), F.max("n").alias("_most"))
    return counted.join(whole, "dimension").select("dimension", "value", "n", (F.col("n") / F.col("_all")).alias("share"), (F.col("n") == F.col("_most")).alias("top"))


def latency_summary(timings: DataFrame) -> DataFrame:
    """Count, median, p90, p95, maximum of ``ms`` per stage (exact, linear interpolation), and the success rate."""
    return timings.groupBy("stage").agg(
        F.count(F.lit(1)).alias("n"), F.expr("percentile(ms, 0.5)").alias("median_ms"), F.expr("percentile(ms, 0.9)").alias("p90_ms"),
        F.expr("percentile(ms, 0.95)").alias("p95_ms"), F.max("ms").alias("max_ms"), F.avg(F.col("ok").cast("double")).alias("success_rate"),
    )


def daily_usage(batches: DataFrame, day: Column, counters: list[str]) -> DataFrame:
    """Distinct visitors, returning visitors, sessions and feature sessions, and counter sums per day (exact)."""
    return batches.groupBy(day.alias("usage_date")).agg(
        F.countDistinct("visitor_id").alias("unique_visitors"), F.countDistinct(F.when(F.col("returning"), F.col("visitor_id"))).alias("returning_visitors"),
        F.countDistinct("session_id").alias("sessions"), F.countDistinct(F.when(F.col("feature_open") > 0, F.col("session_id"))).alias("feature_sessions"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters],
    )


def retained(batches: DataFrame, at: Column, reference: Column, days: int = 90) -> DataFrame:
    return batches.where(at >= reference - F.make_dt_interval(F.lit(days)))


def company_directory(postings: DataFrame, key: Column) -> DataFrame:
    """Openings, newest date and shortest display name per company."""
    rows = postings.withColumn("_key", key).where((F.col("_key") != "") & (F.trim("company") != ""))
    name = F.trim("company")
    return rows.groupBy(F.col("_key").alias("company_key")).agg(F.count(F.lit(1)).alias("openings"), F.max("posted_at").alias("newest"), F.min(F.struct(F.length(name).alias("l"), name.alias("name")))["name"].alias("name"))


def health_groups(health: DataFrame) -> DataFrame:
    """Sources of one display name together: counts per status, distinct errors, worst status."""
    status = F.when(F.col("status") == "failed", "failed").when(F.col("status").isin("degraded", "quarantined"), "degraded").otherwise("healthy")
    worst = F.max(F.when(status == "failed", 2).when(status == "degraded", 1).otherwise(0))
    return health.groupBy(F.lower("name").alias("name")).agg(
        F.count(F.lit(1)).alias("sources"), *[F.count_if(status == s).alias(s) for s in ("healthy", "degraded", "failed")],
        F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("errors"), worst.alias("w"),
    ).select("name", "sources", "healthy", "degraded", "failed", "errors", F.element_at(F.array(F.lit("healthy"), F.lit("degraded"), F.lit("failed")), F.col("w") + 1).alias("worst"))


def competition_context(postings: DataFrame, employer: Column, title: Column, role: Column, posting: Column) -> DataFrame:
    """Each posting with the distinct titles of its employer and the distinct postings of its employer and role."""
    rows = postings.withColumns({"_e": employer, "_t": title, "_r": role, "_p": posting})
    titles = rows.groupBy("_e").agg(F.countDistinct("_t").alias("employer_titles"))
    demand = rows.groupBy("_e", "_r").agg(F.countDistinct("_p").alias("role_postings"))
    return rows.join(demand, ["_e", "_r"]).join(titles, "_e").drop("_e", "_t", "_r", "_p")


def demand_bonus(role_postings: Column) -> Column:
    """More openings of one role at one employer: 0 for one, up to 3."""
    return F.least(F.lit(3), F.greatest(F.lit(0), role_postings - 1))


def multilabel_scores(pairs: DataFrame) -> DataFrame:
    """Per label and over all (label ``*``): precision, recall and F2 of ``expected`` and ``predicted`` arrays."""
    rows = pairs.select(F.array_distinct("expected").alias("e"), F.array_distinct("predicted").alias("p"))
    labels = rows.select("e", "p", F.explode(F.array_union("e", "p")).alias("label"))
    hit = F.array_contains("e", F.col("label")) & F.array_contains("p", F.col("label"))
    per = labels.groupBy("label").agg(F.count_if(hit).alias("tp"), F.count_if(~F.array_contains("e", F.col("label"))).alias("fp"), F.count_if(~F.array_contains("p", F.col("label"))).alias("fn"))
    micro = per.agg(F.lit("*").alias("label"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = per.unionByName(micro).withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f2", ratio(5 * F.col("precision") * F.col("recall"), 4 * F.col("precision") + F.col("recall")))


def exact_set_rate(pairs: DataFrame) -> DataFrame:
    same = (F.size(F.array_except("expected", "predicted")) == 0) & (F.size(F.array_except("predicted", "expected")) == 0)
    return pairs.agg(F.count(F.lit(1)).alias("rows"), F.count_if(same).alias("exact"), F.count_if(F.size("predicted") > 0).alias("covered"))


def conversion(ranked: DataFrame, actions: DataFrame, top: int = 10) -> DataFrame:
    """Per profile: what became of its first ``top`` postings. ``actions``: profile_id, posting_id, action."""
    first = ranked.where(F.col("rank") <= top)
    done = actions.groupBy("profile_id", "posting_id").agg(*[F.max((F.col("action") == a).cast("int")).alias(a) for a in ("applied", "saved", "hidden")])
    rows = first.join(done, ["profile_id", "posting_id"], "left")
    return rows.groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("eligible"), *[F.coalesce(F.sum(a), F.lit(0)).alias(a) for a in ("applied", "saved", "hidden")],
        F.count_if(F.coalesce(F.greatest("applied", "saved", "hidden"), F.lit(0)) == 0).alias("no_action"),
    ).withColumn("conversion_rate", F.col("applied") / F.col("eligible"))


def feedback(ranked: DataFrame, notes: DataFrame, top: int = 10) -> DataFrame:
    """Good and bad verdicts among the first ``top``, with bad reasons counted."""
    rows = ranked.where(F.col("rank") <= top).join(notes, ["profile_id", "posting_id"])
    bad = rows.where("type = 'bad'").groupBy("profile_id", F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    reasons = bad.groupBy("profile_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "reason", F.col("n").cast("string")))), ",").alias("reasons"))
    rated = rows.groupBy("profile_id").agg(F.count_if(F.col("type") == "good").alias("good"), F.count_if(F.col("type") == "bad").alias("bad"))
    return rated.join(reasons, "profile_id", "left").withColumn("good_rate", F.when(F.col("good") + F.col("bad") > 0, F.col("good") / (F.col("good") + F.col("bad"))).otherwise(0.0))


def centroids(zips: DataFrame, weighted: bool) -> DataFrame:
    """City centroids, by population if ``weighted`` (plain where nobody lives); ``unique_name`` if no other state has the city."""
    people = F.sum("population")
    mean = lambda c: F.when(F.lit(weighted) & (people > 0), F.sum(F.col(c) * F.col("population")) / people).otherwise(F.avg(c)).alias(c)
    cities = zips.groupBy("state", "city").agg(mean("latitude"), mean("longitude"), F.count(F.lit(1)).alias("zips"))
    names = cities.groupBy("city").agg((F.countDistinct("state") == 1).alias("unique_name"))
    return cities.join(names, "city")


def employer_coverage(employers: DataFrame, listings: DataFrame) -> DataFrame:
    """Per employer: listings and reachable ones; ``miss`` says why there are none."""
    got = listings.groupBy("employer_id").agg(F.count(F.lit(1)).alias("listings"), F.count_if(F.col("link_status") == "ok").alias("reachable"))
    rows = employers.join(got, "employer_id", "left").withColumn("listings", F.coalesce("listings", F.lit(0))).withColumn("reachable", F.coalesce("reachable", F.lit(0)))
    miss = F.when(~F.col("resolved"), "unresolved").when(F.col("listings") == 0, "no_listings").when(F.col("reachable") == 0, "unreachable")
    return rows.withColumn("miss", miss)


def gap_candidates(employers: DataFrame, weights: dict[str, float], default: float = 1.0) -> DataFrame:
    """Unresolved employers by provider family, scored by count and the family's weight."""
    weight = F.lit(default)
    for family, w in weights.items():
        weight = F.when(F.col("family") == family, F.lit(w)).otherwise(weight)
    rows = employers.where("not resolved").select("employer_id", F.explode("families").alias("family"))
    return rows.groupBy("family").agg(F.countDistinct("employer_id").alias("employers")).withColumn("score", F.col("employers") * weight)


def link_quality(postings: DataFrame, family: Column) -> DataFrame:
    """Links per provider family: direct, intermediary, dead, unknown and unverified."""
    kind, status = F.coalesce("link_kind", F.lit("legacy")), F.coalesce("link_status", F.lit(""))
    dead, unknown = status == "dead", (kind == "direct") & (status == "unknown")
    loose = kind.isin("direct", "employer_job", "listing") & ~status.isin("ok", "dead", "unknown")
    return postings.groupBy(F.coalesce(family, F.lit("unknown")).alias("family")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(kind.isin("direct", "employer_job")).alias("direct"), F.count_if(~kind.isin("direct", "employer_job")).alias("intermediary"),
        F.count_if(dead).alias("dead"), F.count_if(~dead & unknown).alias("unknown_direct"), F.count_if(~dead & loose).alias("unverified"),
    )


def top_values(df: DataFrame, value: Column, limit: int = 20) -> DataFrame:
    return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def extraction_outcomes(evidence: DataFrame) -> DataFrame:
    """Evidence by provider and outcome."""
    outcome = F.when(F.col("status") == "unavailable", "unavailable").when(F.col("last_error").isNotNull(), "failed").when(F.col("facts") > 0, "extracted").otherwise("empty")
    return evidence.groupBy("provider").pivot("outcome", ["extracted", "empty", "failed", "unavailable"]).agg(F.count(F.lit(1))).na.fill(0) if "outcome" in evidence.columns else extraction_outcomes(evidence.withColumn("outcome", outcome))


def profile_grid(postings: DataFrame, reference: Column, region: Column) -> DataFrame:
    """Per profile: postings anywhere, in the region, and in the region within 7 days."""
    rows = postings.select(F.explode("profiles").alias("profile"), region.alias("near"), (age_days(F.col("posted_at"), reference) <= 7).alias("new"))
    return rows.groupBy("profile").agg(F.count(F.lit(1)).alias("all_locations"), F.count_if("near").alias("region_any_age"), F.count_if(F.col("near") & F.col("new")).alias("region_7d"))


def registry(urls: DataFrame) -> DataFrame:
    """Tenants with their sets of (host, site); ``urls`` has tenant, host, site."""
    return urls.groupBy("tenant").agg(F.array_sort(F.collect_set(F.concat_ws("/", "host", "site"))).alias("sites"))


def stage_history(stages: DataFrame, runs: int = 30) -> DataFrame:
    """Latest runs with total time, dominant stage and first failed stage. ``stages``: run, started, position, stage, seconds, ok."""
    per = stages.groupBy("run").agg(
        F.min("started").alias("started"), F.sum("seconds").alias("total_s"), F.max(F.struct("seconds", F.negative("position").alias("p"), "stage"))["stage"].alias("dominant"),
        F.min(F.when(~F.col("ok"), F.struct("position", "stage")))["stage"].alias("first_failed"),
    )
    return per.orderBy(F.desc("started"), F.desc("run")).limit(runs)


def daily_quota(events: DataFrame, client: str, at: str, tie: str, limit: int) -> DataFrame:
    """Events with the client's running count of the day and whether it exceeds ``limit``."""
    w = Window.partitionBy(client, F.to_date(at)).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("used", F.count(F.lit(1)).over(w)).withColumn("over", F.col("used") > limit)


def view_stats(postings: DataFrame, reference: Column) -> DataFrame:
    direct = F.count_if(F.col("link_kind") == "direct")
    return postings.agg(
        F.count(F.lit(1)).alias("shown"), F.count_if(age_days(F.col("posted_at"), reference) <= 7).alias("last_7_days"),
        share(direct, F.count(F.lit(1))).alias("direct_percent"), F.countDistinct("company").alias("companies"),
    )
