"""The sample tables seen as listings: observations, postings, source health.

A line item is one source's observation of the order it belongs to; see the README
for the whole mapping. Each function has its SQL counterpart in ``SQL``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A sample table; times without a zone are read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    times = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.simpleString() == "timestamp_ntz"}
    return df.withColumns(times) if times else df


def provenance_rank(provenance: Column) -> Column:
    """Employers and governments 3, other authorities 2, anything named 1, nothing 0."""
    return (
        F.when(provenance.isNull() | (provenance == ""), 0)
        .when(provenance.isin("authoritative_employer", "authoritative_government"), 3)
        .when(provenance.startswith("authoritative_"), 2)
        .otherwise(1)
    )


def link_kind_rank(kind: Column) -> Column:
    return F.when(kind == "direct", 4).when(kind == "employer_job", 3).when(kind == "listing", 2).when(kind == "source", 1).otherwise(0)


def observations(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """One row per line item. ``deal``: orders are dealt into the session's number of shuffle partitions.

    Spark leaves a number that is asked for as it is. Else it puts as many partitions into
    a task as compress to its advisory size, and keys in order compress so well that one
    task sorts millions of rows, for every join and group that shares its stage.
    """
    line, orders, part, supplier, nation = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part", "supplier", "nation"))
    if deal:
        orders = orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    joined = (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    number = F.col("l_suppkey") % 25
    return joined.select(
        (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("ordinal"),
        F.col("l_orderkey").alias("posting_id"),
        F.concat(F.lit("src-"), number.cast("string")).alias("source_key"),
        F.concat(F.lit("Source "), number.cast("string")).alias("source_name"),
        F.concat(F.lit("https://source"), number.cast("string"), F.lit(".example.com")).alias("source_url"),
        F.concat(F.lit("Company "), (F.col("o_custkey") % 400).cast("string")).alias("company"),
        F.col("p_type").alias("title"),
        F.col("n_name").alias("location"),
        F.when(F.col("l_linenumber") == 6, F.lit(None)).otherwise(F.concat(F.lit("https://jobs.example.com/"), F.col("l_orderkey").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, "/apply?utm_source=x").otherwise("/view/"))).alias("url"),
        F.col("l_shipdate").alias("posted_at"),
        F.when(F.col("l_returnflag") == "R", "authoritative_employer").otherwise("aggregator").alias("posted_date_provenance"),
        F.when(F.col("l_returnflag") == "R", "direct").when(F.col("l_returnflag") == "A", "listing").otherwise("source").alias("link_kind"),
        F.when(F.col("l_linestatus") == "O", "ok").otherwise("dead").alias("link_status"),
        F.col("p_retailprice").alias("salary_min"),
        (F.col("p_retailprice") + F.col("p_size")).alias("salary_max"),
    )


def postings(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """Observations of one order merged: sets of sources and states, best link, preferred date; ``deal`` as in ``observations``."""
    dated = F.struct(provenance_rank(F.col("posted_date_provenance")).alias("r"), "posted_at")
    first = F.struct("ordinal", "company", "title", "location", "url")
    grouped = observations(spark, sf_dir, deal).groupBy(F.col("posting_id").alias("id")).agg(
        F.min(first).alias("f"), F.max(dated).alias("d"),
        F.array_sort(F.collect_set("source_key")).alias("source_keys"),
        F.array_sort(F.collect_set("location")).alias("states"),
        F.max(link_kind_rank(F.col("link_kind"))).alias("k"), F.max("link_status").alias("link_status"),
        F.max("salary_max").alias("salary_max"),
    )
    return grouped.select(
        "id", "f.company", "f.title", "f.location", "f.url", "source_keys", "states", F.col("d.posted_at").alias("posted_at"),
        F.when(F.col("d.r") == 3, "authoritative_employer").otherwise("aggregator").alias("posted_date_provenance"),
        F.when(F.col("k") == 4, "direct").when(F.col("k") == 2, "listing").otherwise("source").alias("link_kind"), "link_status", "salary_max",
    )


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status for each supplier as a source; those numbered under 25 contribute."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n"))
    return rows.select(
        F.concat(F.lit("src-"), F.col("n").cast("string")).alias("key"),
        F.concat(F.lit("Source "), (F.col("n") % 12).cast("string")).alias("name"),
        F.when(F.col("n") % 7 == 3, "failed").when(F.col("n") % 7 == 5, "degraded").otherwise("healthy").alias("status"),
        F.when(F.col("n") % 7 == 3, F.concat(F.lit("HTTPError: 50"), (F.col("n") % 4).cast("string"), F.lit(" at https://x.example.com/"), F.col("n").cast("string"))).alias("error"),
    )


SQL = {
    "obs": r"""obs AS (
  SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS ordinal, l_orderkey AS posting_id, 'src-' || (l_suppkey % 25) AS source_key,
    'Source ' || (l_suppkey % 25) AS source_name, 'https://source' || (l_suppkey % 25) || '.example.com' AS source_url,
    'Company ' || (o_custkey % 400) AS company, p_type AS title, n_name AS location,
    CASE WHEN l_linenumber = 6 THEN NULL ELSE 'https://jobs.example.com/' || l_orderkey || CASE WHEN l_linenumber % 3 = 0 THEN '/apply?utm_source=x' ELSE '/view/' END END AS url,
    l_shipdate AS posted_at, CASE l_returnflag WHEN 'R' THEN 'authoritative_employer' ELSE 'aggregator' END AS posted_date_provenance,
    CASE l_returnflag WHEN 'R' THEN 'direct' WHEN 'A' THEN 'listing' ELSE 'source' END AS link_kind,
    CASE l_linestatus WHEN 'O' THEN 'ok' ELSE 'dead' END AS link_status, p_retailprice AS salary_min, p_retailprice + p_size AS salary_max
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)""",
    "post": r"""post AS (
  SELECT posting_id AS id, arg_min(company, ordinal) AS company, arg_min(title, ordinal) AS title, arg_min(location, ordinal) AS location,
    (list(url ORDER BY ordinal))[1] AS url, list_sort(list(DISTINCT source_key)) AS source_keys, list_sort(list(DISTINCT location)) AS states,
    coalesce(max(posted_at) FILTER (posted_date_provenance <> 'aggregator'), max(posted_at)) AS posted_at,
    CASE WHEN bool_or(posted_date_provenance <> 'aggregator') THEN 'authoritative_employer' ELSE 'aggregator' END AS posted_date_provenance,
    CASE max(CASE link_kind WHEN 'direct' THEN 4 WHEN 'listing' THEN 2 ELSE 1 END) WHEN 4 THEN 'direct' WHEN 2 THEN 'listing' ELSE 'source' END AS link_kind,
    max(link_status) AS link_status, max(salary_max) AS salary_max
  FROM obs GROUP BY posting_id)""",
    "health": r"""health AS (
  SELECT 'src-' || n AS key, 'Source ' || (n % 12) AS name, CASE WHEN n % 7 = 3 THEN 'failed' WHEN n % 7 = 5 THEN 'degraded' ELSE 'healthy' END AS status,
    CASE WHEN n % 7 = 3 THEN 'HTTPError: 50' || (n % 4) || ' at https://x.example.com/' || n END AS error FROM (SELECT s_suppkey AS n FROM supplier))""",
}


def with_sql(*parts: str) -> str:
    """``WITH`` clause of the named views."""
    need = [p for p in ("obs", "post", "health") if p in parts or p == "obs" and "post" in parts]
    return "WITH " + ",\n".join(SQL[p] for p in need) + "\n"
