"""Joins over snapshots that lie in buckets (J1, J2, I1, U3)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from quarrystone.operators import incremental as INC
from quarrystone.operators import joins as J
from quarrystone.plans.bucketed import PriorIds, Snapshots, snapshot_changes
from quarrystone.plans.shared import folder
from quarrystone.queries.registry import query
from quarrystone.sources.listings import table

MONDAY, TUESDAY = datetime.date(2026, 1, 5), datetime.date(2026, 1, 6)


def _listing(spark, sf):
    """Orders as postings: id, url, link_status, link_checked_at, posted_at."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    status = F.when(k % 4 == 0, "dead").when(k % 4 < 3, "ok")
    return o.select(k.alias("id"), F.concat(F.lit("https://jobs.example.com/"), k.cast("string")).alias("url"), status.alias("link_status"), F.when(status.isNotNull(), F.col("o_orderdate")).alias("link_checked_at"), F.col("o_orderdate").alias("posted_at"))


def two_days(spark, sf) -> Snapshots:
    """Monday without every seventh order; Tuesday without every ninth, each fifth with another URL, none of its links checked."""
    rows = _listing(spark, sf)
    store = Snapshots.create(spark, folder(spark), "id", rows.schema)
    store.add(rows.where("id % 7 <> 0"), MONDAY)
    moved = F.when(F.col("id") % 5 == 0, F.concat("url", F.lit("/new"))).otherwise(F.col("url"))
    fresh = rows.where("id % 9 <> 0").withColumns({"url": moved, "link_status": F.lit(None).cast("string"), "link_checked_at": F.lit(None).cast("timestamp")})
    store.add(fresh, TUESDAY)
    return store


@query("i1_bucketed_carry_over", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'dead' WHEN o_orderkey % 4 < 3 THEN 'ok' END END AS link_status,
 CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 4 < 3 THEN o_orderdate END AS link_checked_at FROM orders WHERE o_orderkey % 9 <> 0""")
def i1_bucketed(spark, sf):
    """Tuesday's links take over what Monday knows of unchanged URLs."""
    days = two_days(spark, sf)
    return INC.carry_link_status(days.at(TUESDAY), days.at(MONDAY)).select("id", "link_status", "link_checked_at")


@query("j1_bucketed_evidence", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'inspected' END AS evidence_status, CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP '2001-01-01' ELSE o_orderdate END AS posted_at FROM orders WHERE o_orderkey % 7 <> 0")
def j1_bucketed(spark, sf):
    """Monday's postings with the evidence of their pages; bridge and evidence are one narrow table in the postings' buckets."""
    days = two_days(spark, sf)
    o, k = table(spark, sf, "orders").where("o_orderkey % 2 = 0"), F.col("o_orderkey")
    url = F.concat(F.lit("u"), k.cast("string"))
    bridge = o.select(k.alias("posting_id"), url.alias("canonical_url"))
    evidence = o.select(url.alias("canonical_url"), F.lit("inspected").alias("status"), F.when(k % 4 == 0, F.to_timestamp(F.lit("2001-01-01 00:00:00"))).alias("posted_at"))
    return J.attach_evidence_by_posting(days.at(MONDAY), bridge, evidence).select("id", "evidence_status", "posted_at")


@query("j2_bucketed_match", """WITH k AS (SELECT o_orderkey, 'a' || (o_orderkey % 1000) AS a, o_custkey || '/' || o_orderpriority AS b, o_orderdate < TIMESTAMP '1997-01-01' AS old FROM orders),
ua AS (SELECT a, min(o_orderkey) AS v FROM k WHERE old GROUP BY 1 HAVING count(DISTINCT o_orderkey) = 1), ub AS (SELECT b, min(o_orderkey) AS v FROM k WHERE old GROUP BY 1 HAVING count(DISTINCT o_orderkey) = 1)
SELECT o_orderkey, coalesce(ua.v, ub.v) AS prior_id, CASE WHEN ua.v IS NOT NULL THEN 1 WHEN ub.v IS NOT NULL THEN 2 END AS rung FROM k LEFT JOIN ua USING (a) LEFT JOIN ub USING (b) WHERE NOT old""")
def j2_bucketed(spark, sf):
    """New orders matched with the old by keys that are written once."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.concat(F.lit("a"), (F.col("o_orderkey") % 1000).cast("string")).alias("a"), F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority").alias("b"))
    old = o.where("o_orderdate < '1997-01-01'").withColumn("prior_id", F.col("o_orderkey"))
    known = PriorIds.create(old, folder(spark), ["a", "b"], "prior_id")
    known.add(old, MONDAY)
    return known.match(o.where("o_orderdate >= '1997-01-01'"), MONDAY).select("o_orderkey", "prior_id", "rung")


@query("u3_snapshot_changes", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'added' WHEN o_orderkey % 9 = 0 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE (o_orderkey % 7 = 0) <> (o_orderkey % 9 = 0) OR o_orderkey % 7 <> 0 AND o_orderkey % 9 <> 0 AND o_orderkey % 5 = 0")
def u3_changes(spark, sf):
    """What Tuesday adds, drops and changes against Monday."""
    days = two_days(spark, sf)
    return snapshot_changes(days.at(MONDAY), days.at(TUESDAY), "id", ["url", "posted_at"])
