"""Qualification fit of the pairs that gates leave, met by keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import scoring as S
from quarrystone.queries.evidence import GATES, RANKED, fit_of, gated_postings, with_nation
from quarrystone.queries.registry import query
from quarrystone.sources.listings import table


def gated_pairs(spark, sf):
    """``(profile_id, posting_id)`` that pass every gate. Region, type and term are keys of the join; no other pair is made."""
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"))
    posts = gated_postings(spark, sf).where("available").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).drop("n_nationkey")
    posts = posts.withColumnRenamed("o_orderkey", "posting_id").withColumn("term_key", F.coalesce(F.lower("term"), F.lit("")))
    people = with_nation(nation.withColumnRenamed("n_nationkey", "profile_id"), F.col("profile_id"))
    people = people.withColumn("opportunity_type", F.explode("allowed_types"))
    people = people.withColumn("term_key", F.explode(F.array(F.lower("target_term"), F.right("target_term", F.lit(4)), F.lit(""))))
    return S.eligibility(posts.join(people, ["region", "opportunity_type", "term_key"])).where("reason is null").select("profile_id", "posting_id")


@query("c15_gated_fit", RANKED.partition("\nz AS")[0].rstrip(",").replace("{GATES}", GATES) + "\nSELECT p AS profile_id, g AS posting_id, fit::DOUBLE AS fit FROM t")
def c15_gated(spark, sf):
    """Fit of every pair under gates: as ``c15_qualification_fit``, without the pairs that nobody asks for."""
    return fit_of(spark, sf, table(spark, sf, "customer"), gated_pairs(spark, sf))
