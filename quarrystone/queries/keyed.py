"""Streams with keyed state, replayed batches, writes that are skipped, incremental components."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.operators import aggregates as A
from quarrystone.operators import incremental as INC
from quarrystone.operators import sketches as SK
from quarrystone.operators.upserts import upsert_days
from quarrystone.plans.shared import folder, stored
from quarrystone.plans.snapshots import first_snapshot, next_snapshot
from quarrystone.queries.evidence import _drained, event_stream
from quarrystone.queries.registry import query
from quarrystone.queries.reports import usage
from quarrystone.sources.listings import table
from quarrystone.streaming.attempts import PROVIDER, attempt_states, latest_states


@query("t5_stream_states", """WITH e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, event_id % 3 = 0 AS ok FROM events), w AS (SELECT max(ms) - 86400000 AS w FROM e), g AS (SELECT user_id, max({'ms': ms, 'v': event_id::VARCHAR}) FILTER (ok) AS good, max(ms) AS latest, max({'ms': ms, 'ok': ok}) AS l FROM e GROUP BY 1),
s AS (SELECT user_id, good.v AS v, NOT l.ok AS failed, greatest(latest, w) - good.ms <= 2 * 86400000 AS fresh, greatest(latest, w) - latest < 12 * 3600000 AS cooling FROM g, w)
SELECT user_id, v, CASE WHEN failed THEN 'failed' END AS last_error, CASE WHEN fresh THEN 'cached' WHEN failed AND cooling THEN 'retry_cooldown' ELSE 'queued' END AS state FROM s""")
def t5_stream(spark, sf):
    """Events as attempts of their users, every third good: states with a time to live of two days and cooldowns of twelve hours, as of the watermark or the user's last attempt."""
    ok = F.col("event_id") % 3 == 0
    attempts = event_stream(spark, sf).select("user_id", F.col("ts").alias("at"), ok.alias("ok"), F.when(ok, F.col("event_id").cast("string")).alias("v"), F.when(~ok, "failed").alias("error"))
    was = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        told = _drained(attempt_states(attempts, "user_id", "v", 2, 12), "update")
    finally:
        spark.conf.set(PROVIDER[0], was)
    return latest_states(told, "user_id").select("user_id", "v", "last_error", "state")


@query("a1_upserted_usage", """SELECT ts::DATE AS usage_date, count(DISTINCT user_id) AS unique_visitors, count(DISTINCT CASE WHEN user_id % 3 = 0 THEN user_id END) AS returning_visitors, count(DISTINCT user_id) AS sessions,
 count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS feature_sessions, count_if(event_type = 'click')::BIGINT AS apply_clicked, count_if(event_type = 'purchase')::BIGINT AS saved FROM events GROUP BY 1""")
def a1_upserted(spark, sf):
    """Usage batches out of order, with replays, one of them first landed with half of its rows: the days are those of all events."""
    path = folder(spark)
    rows = usage(spark, sf).withColumn("batch", F.pmod(F.xxhash64("session_id"), F.lit(4)))
    rollup = lambda r: A.daily_usage(r, F.col("usage_date"), ["apply_clicked", "saved"])
    for n, part in ((2, None), (0, "feature_open = 0"), (3, None), (2, None), (0, None), (1, None), (3, None)):
        own = rows.where(F.col("batch") == n)
        upsert_days(own.where(part) if part else own, f"b{n}", F.to_date("ts"), path, rollup)
    daily = spark.read.parquet(f"{path}/daily")
    return daily.select(F.col("usage_date").cast("date").alias("usage_date"), "unique_visitors", "returning_visitors", "sessions", "feature_sessions", "apply_clicked", "saved")


@query("s11_skipped_writes", "SELECT i AS step, i IN (1, 3) AS wrote, n FROM range(1, 5) t(i), (SELECT count(*) AS n FROM orders) o")
def s11_writes(spark, sf):
    """Orders written four times: new, in another order with another volatile column, with one value changed, unchanged."""
    path = folder(spark) + "/orders"
    o = table(spark, sf, "orders").withColumn("seen_at", F.lit(1))
    other = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") == o.agg(F.min("o_orderkey")).first()[0], F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    steps = [o, o.orderBy(F.desc("o_orderkey")).withColumn("seen_at", F.lit(2)), other, other.withColumn("seen_at", F.lit(3))]
    wrote = [INC.write_if_changed(x, path, ["seen_at"]) for x in steps]
    said = F.array(*[F.struct(F.lit(i).cast("bigint").alias("step"), F.lit(w).alias("wrote")) for i, w in enumerate(wrote, 1)])
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).select(F.explode(said).alias("x"), "n").select("x.*", "n")


def _linked(spark, sf):
    """Links between neighbouring customers, from some orders, with what decides in which snapshots they stand."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").where(k % 20 == 0).select(c.alias("a"), (c + 1 + (k / 20).cast("bigint") % 3).alias("b"), ((k / 20).cast("bigint") % 8).alias("turn"))


LINKS = "SELECT DISTINCT o_custkey AS a, o_custkey + 1 + o_orderkey // 20 % 3 AS b FROM orders WHERE o_orderkey % 20 = 0 AND o_orderkey // 20 % 8 NOT IN (1, 3)"


@query("d3_snapshot_components", f"""WITH RECURSIVE e AS ({LINKS}), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, seen) AS (SELECT a, a FROM g UNION SELECT r.node, g.b FROM r JOIN g ON g.a = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def d3_snapshots(spark, sf):
    """Components over four snapshots: links come and go, and each snapshot is made from the one before."""
    links = _linked(spark, sf)
    of = lambda *turns: links.where(F.col("turn").isin(list(turns)))
    # a link of several orders stands while any of them does
    without = lambda gone, left: of(*gone).select("a", "b").distinct().join(of(*left).select("a", "b").distinct(), ["a", "b"], "left_anti")
    now = first_snapshot(of(0, 1, 2, 3))
    now = next_snapshot(now, of(4), without([1], [0, 2, 3]))
    now = next_snapshot(now, of(5, 6), without([3], [0, 2, 4]))
    now = next_snapshot(now, of(7), of().select("a", "b"))
    return now.labels.select("node", "component")


@query("a7_merged_sketches", "SELECT date_trunc('week', ts)::DATE AS period, count(DISTINCT ts::DATE) AS days, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT event_id) AS events, true AS users_within, true AS events_within, true AS quantiles_within FROM events GROUP BY 1")
def a7_sketches(spark, sf):
    """Weeks merged from stored sketches of days, beside the exact figures and whether each estimate lies within its stated error."""
    e = table(spark, sf, "events")
    days = stored(SK.day_sketches(e, F.to_date("ts"), ["user_id", "event_id"], ["value"]))
    weeks = SK.merged(days, F.trunc("usage_date", "week"))
    exact = e.groupBy(F.trunc(F.to_date("ts"), "week").alias("p")).agg(F.countDistinct("user_id").alias("users"), F.countDistinct("event_id").alias("events"))
    near = lambda got, want: F.abs(F.col(got) - F.col(want)) <= 1 + F.lit(SK.distinct_error()) * F.col(want)
    ranks = e.select(F.trunc(F.to_date("ts"), "week").alias("p"), "value").where("value is not null").join(weeks.select("period", "value_p50", "value_p90", "value_p95"), F.col("p") == F.col("period"))
    off = lambda q: F.greatest(F.lit(q) - F.avg((F.col("value") <= F.col(f"value_p{round(100 * q)}")).cast("double")), F.avg((F.col("value") < F.col(f"value_p{round(100 * q)}")).cast("double")) - q)
    # a rank is told in steps of one value
    told = ranks.groupBy("p").agg((F.greatest(*[off(q) for q in (0.5, 0.9, 0.95)]) <= SK.rank_error() + 1 / F.count(F.lit(1))).alias("quantiles_within"))
    both = weeks.join(exact, F.col("period") == F.col("p")).drop("p").join(told, F.col("period") == F.col("p"), "left")
    return both.select("period", "days", "n", "users", "events", near("user_id", "users").alias("users_within"), near("event_id", "events").alias("events_within"), F.coalesce("quantiles_within", F.lit(True)).alias("quantiles_within"))
