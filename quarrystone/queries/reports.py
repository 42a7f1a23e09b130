"""Queries of the report operators (A)."""

from pyspark.sql import functions as F

from quarrystone.functions.text import company_key, host, norm
from quarrystone.operators import aggregates as A
from quarrystone.queries.registry import query
from quarrystone.sources.listings import observations, postings, source_health, table, with_sql

REF = "2000-06-01"


def reference():
    return F.to_timestamp(F.lit(REF + " 00:00:00"))


AGE = f"floor(epoch(TIMESTAMP '{REF}' - posted_at) / 86400)"


@query("a2_source_contribution", with_sql("obs", "post") + """, x AS (SELECT unnest(source_keys) AS source_key, len(source_keys) AS n, CASE link_kind WHEN 'direct' THEN 'direct_employer_ats' WHEN 'listing' THEN 'aggregator_intermediary' ELSE 'unresolved_non_authoritative' END AS b FROM post)
SELECT source_key, count(*) AS final_jobs, count_if(n = 1)::BIGINT AS unique_jobs, count_if(n <> 1)::BIGINT AS overlap_jobs,
 count_if(b = 'direct_employer_ats')::BIGINT AS direct_employer_ats, count_if(b = 'aggregator_intermediary')::BIGINT AS aggregator_intermediary,
 count_if(b = 'unresolved_non_authoritative')::BIGINT AS unresolved_non_authoritative, 0::BIGINT AS employer_careers_page,
 100.0 * count_if(n = 1) / (SELECT count(*) FROM post) AS unique_percent_of_feed, 100.0 * count_if(b = 'direct_employer_ats') / count(*) AS direct_link_percent FROM x GROUP BY source_key""")
def a2(spark, sf):
    return A.source_contribution(postings(spark, sf))


@query("a2_pairwise_overlap", with_sql("obs", "post") + """, x AS (SELECT id, unnest(source_keys) AS k FROM post)
SELECT a.k AS "left", b.k AS "right", count(*) AS canonical_jobs FROM x a JOIN x b ON a.id = b.id AND a.k < b.k GROUP BY 1, 2""")
def a2_pairs(spark, sf):
    return A.pairwise_overlap(postings(spark, sf))


@query("a2_zero_contribution", with_sql("obs", "health") + "SELECT key FROM health WHERE status IN ('healthy', 'degraded') AND key NOT IN (SELECT source_key FROM obs)")
def a2_zero(spark, sf):
    return A.zero_contribution(postings(spark, sf), source_health(spark, sf))


@query("a2_contribution_summary", with_sql("obs", "post") + """SELECT count(*) AS final_feed_jobs, count_if(len(source_keys) <= 1)::BIGINT AS single_source_jobs, count_if(len(source_keys) > 1)::BIGINT AS multi_source_jobs,
 count_if(link_kind = 'direct')::BIGINT AS direct_link_jobs, 100.0 * count_if(len(source_keys) > 1) / count(*) AS multi_source_percent FROM post""")
def a2_summary(spark, sf):
    return A.contribution_summary(postings(spark, sf))


@query("a3_stale_report", with_sql("obs", "post", "health") + f""", x AS (SELECT post.*, (SELECT bool_and(coalesce(h.status = 'failed', false)) FROM (SELECT unnest(post.source_keys) AS k) LEFT JOIN health h ON h.key = k) AS all_failed, id % 97 = 0 AS gone FROM post)
SELECT count(*) AS total_jobs, count_if(all_failed)::BIGINT AS failed_source_only, count_if(link_status = 'dead')::BIGINT AS known_dead_links, count_if(link_kind = 'direct' AND link_status = 'unknown')::BIGINT AS unknown_direct_links,
 count_if(gone)::BIGINT AS unavailable_evidence, count_if({AGE} >= 90)::BIGINT AS age_review_90d, count_if(posted_at IS NULL)::BIGINT AS missing_posted_at, count_if(all_failed OR link_status = 'dead' OR gone)::BIGINT AS at_risk_jobs FROM x""")
def a3(spark, sf):
    rows = postings(spark, sf)
    return A.stale_report(rows, source_health(spark, sf), table(spark, sf, "orders").where("o_orderkey % 97 = 0").select(F.col("o_orderkey").alias("id")), reference())


@query("a4_date_report", with_sql("obs", "post") + f""", s AS (SELECT posting_id, min(posted_at) AS o, max(posted_at) AS n, count(*) AS c, max(posted_at) FILTER (posted_date_provenance LIKE 'authoritative_%') AS au FROM obs GROUP BY 1)
SELECT count(*) AS total_jobs, count_if(posted_at IS NULL)::BIGINT AS missing_date, 0::BIGINT AS missing_provenance, count_if(posted_at > TIMESTAMP '{REF}')::BIGINT AS future_dates,
 count_if(c >= 2 AND epoch(n - o) >= 7 * 86400)::BIGINT AS conflicting, count_if(posted_date_provenance = 'aggregator' AND posted_at > au)::BIGINT AS aggregator_over_authority FROM post JOIN s ON id = posting_id""")
def a4(spark, sf):
    return A.date_report(postings(spark, sf), observations(spark, sf), reference())


GATES = {"unique_jobs": ("min", 200), "capture_rate": ("min", 0.95), "oldest_age_hours": ("max", 168), "median_latency": ("max", 6)}


@query("a5_quality_gates", with_sql("obs", "post") + """, m AS (SELECT count(*)::DOUBLE AS unique_jobs, avg((link_kind = 'direct')::INT) AS capture_rate, NULL::DOUBLE AS oldest_age_hours, 5.0 AS median_latency FROM post),
g AS (SELECT 'unique_jobs' AS gate, unique_jobs AS actual, 200.0 AS target, unique_jobs >= 200 AS p FROM m UNION ALL SELECT 'capture_rate', capture_rate, 0.95, capture_rate >= 0.95 FROM m
 UNION ALL SELECT 'oldest_age_hours', oldest_age_hours, 168, oldest_age_hours <= 168 FROM m UNION ALL SELECT 'median_latency', median_latency, 6, median_latency <= 6 FROM m)
SELECT gate, actual, target, actual IS NOT NULL AS measurable, coalesce(p, false) AS passed, (SELECT bool_and(coalesce(p, false)) FROM g) AS ready FROM g""")
def a5(spark, sf):
    m = postings(spark, sf).agg(F.count(F.lit(1)).alias("unique_jobs"), F.avg((F.col("link_kind") == "direct").cast("int")).alias("capture_rate"), F.lit(None).cast("double").alias("oldest_age_hours"), F.lit(5.0).alias("median_latency"))
    return A.gates(m, GATES)


@query("a6_concentration", with_sql("obs") + """, x AS (SELECT 'source' AS dimension, source_key AS value FROM obs UNION ALL SELECT 'state', location FROM obs UNION ALL SELECT 'employer', company FROM obs UNION ALL SELECT 'kind', link_kind FROM obs),
c AS (SELECT dimension, value, count(*) AS n FROM x GROUP BY 1, 2)
SELECT *, n / sum(n) OVER (PARTITION BY dimension) AS share, n = max(n) OVER (PARTITION BY dimension) AS top FROM c""")
def a6(spark, sf):
    return A.distribution(observations(spark, sf), {"source": F.col("source_key"), "state": F.col("location"), "employer": F.col("company"), "kind": F.col("link_kind")})


@query("a7_latency_summary", """SELECT event_type AS stage, count(*) AS n, quantile_cont(value, 0.5) AS median_ms, quantile_cont(value, 0.9) AS p90_ms, quantile_cont(value, 0.95) AS p95_ms, max(value) AS max_ms, avg((user_id % 10 > 0)::INT) AS success_rate FROM events GROUP BY 1""")
def a7(spark, sf):
    return A.latency_summary(table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"), (F.col("user_id") % 10 > 0).alias("ok")))


def usage(spark, sf):
    """Events as usage batches: a session is a user's day."""
    e = table(spark, sf, "events")
    return e.select(
        "ts", F.col("user_id").alias("visitor_id"), F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("session_id"), (F.col("user_id") % 3 == 0).alias("returning"),
        (F.col("event_type") == "view").cast("bigint").alias("feature_open"), (F.col("event_type") == "click").cast("bigint").alias("apply_clicked"), (F.col("event_type") == "purchase").cast("bigint").alias("saved"),
    )


@query("a1_daily_usage", """SELECT ts::DATE AS usage_date, count(DISTINCT user_id) AS unique_visitors, count(DISTINCT CASE WHEN user_id % 3 = 0 THEN user_id END) AS returning_visitors, count(DISTINCT user_id) AS sessions,
 count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS feature_sessions, count_if(event_type = 'click')::BIGINT AS apply_clicked, count_if(event_type = 'purchase')::BIGINT AS saved
FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY GROUP BY 1""")
def a1(spark, sf):
    kept = A.retained(usage(spark, sf), F.col("ts"), F.to_timestamp(F.lit("2024-01-31 00:00:00")), 20)
    return A.daily_usage(kept, F.to_date("ts"), ["apply_clicked", "saved"])


@query("a11_company_directory", with_sql("obs", "post") + """SELECT lower(company) AS company_key, count(*) AS openings, max(posted_at) AS newest, company AS name FROM post GROUP BY 1, 4""")
def a11(spark, sf):
    return A.company_directory(postings(spark, sf), norm(F.col("company")))


@query("a12_health_groups", with_sql("health") + """SELECT lower(name) AS name, count(*) AS sources, count_if(status = 'healthy')::BIGINT AS healthy, count_if(status = 'degraded')::BIGINT AS degraded, count_if(status = 'failed')::BIGINT AS failed,
 coalesce(string_agg(DISTINCT error, '; ' ORDER BY error), '') AS errors, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'degraded') THEN 'degraded' ELSE 'healthy' END AS worst FROM health GROUP BY 1""")
def a12(spark, sf):
    return A.health_groups(source_health(spark, sf))


@query("a13_competition", with_sql("obs", "post") + """, t AS (SELECT company, count(DISTINCT title) AS employer_titles FROM post GROUP BY 1), r AS (SELECT company, split_part(title, ' ', 1) AS role, count(DISTINCT id) AS role_postings FROM post GROUP BY 1, 2)
SELECT id, employer_titles, role_postings, least(3, greatest(0, role_postings - 1)) AS bonus FROM post JOIN t USING (company) JOIN r ON r.company = post.company AND r.role = split_part(title, ' ', 1)""")
def a13(spark, sf):
    rows = A.competition_context(postings(spark, sf), F.col("company"), F.col("title"), F.split("title", " ")[0], F.col("id"))
    return rows.select("id", "employer_titles", "role_postings", A.demand_bonus(F.col("role_postings")).alias("bonus"))


def labelled(spark, sf):
    """Quality and toxicity as label sets, predicted from length and source."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    e = F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")))
    p = F.array_compact(F.array(F.when(F.col("n_chars") > 400, "good"), F.when(F.col("source").isin("src1", "src2"), "toxic")))
    return d.select("doc_id", e.alias("expected"), p.alias("predicted"))


LABELLED = """WITH l AS (SELECT doc_id, list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS e,
 list_filter([CASE WHEN n_chars > 400 THEN 'good' END, CASE WHEN source IN ('src1', 'src2') THEN 'toxic' END], lambda x: x IS NOT NULL) AS p FROM documents JOIN labels USING (doc_id))
"""


@query("a14_multilabel_scores", LABELLED + """, u AS (SELECT unnest(['good', 'toxic']) AS label, e, p FROM l), c AS (SELECT label, count_if(list_contains(e, label) AND list_contains(p, label))::BIGINT AS tp, count_if(NOT list_contains(e, label) AND list_contains(p, label))::BIGINT AS fp, count_if(list_contains(e, label) AND NOT list_contains(p, label))::BIGINT AS fn FROM u GROUP BY 1),
a AS (SELECT * FROM c UNION ALL SELECT '*', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM c),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM a)
SELECT *, CASE WHEN 4 * precision + recall > 0 THEN 5 * precision * recall / (4 * precision + recall) ELSE 0 END AS f2 FROM r""")
def a14(spark, sf):
    return A.multilabel_scores(labelled(spark, sf))


@query("a14_exact_sets", LABELLED + "SELECT count(*) AS rows, count_if(list_sort(e) = list_sort(p))::BIGINT AS exact, count_if(len(p) > 0)::BIGINT AS covered FROM l")
def a14_exact(spark, sf):
    return A.exact_set_rate(labelled(spark, sf))


def ranked_events(spark, sf):
    """Users as profiles; an order is ranked by price among a customer's."""
    from pyspark.sql import Window

    o = table(spark, sf, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.select(F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("posting_id"), F.row_number().over(w).alias("rank"), "o_orderstatus", "o_orderpriority")


RANKED = "WITH k AS (SELECT o_custkey AS profile_id, o_orderkey AS posting_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderstatus, o_orderpriority FROM orders)\n"


@query("a15_conversion", RANKED + """SELECT profile_id, count(*) AS eligible, count_if(o_orderstatus = 'F')::BIGINT AS applied, count_if(o_orderstatus = 'O')::BIGINT AS saved, 0::BIGINT AS hidden, count_if(o_orderstatus NOT IN ('F', 'O'))::BIGINT AS no_action, count_if(o_orderstatus = 'F') / count(*) AS conversion_rate FROM k WHERE rank <= 10 GROUP BY 1""")
def a15(spark, sf):
    r = ranked_events(spark, sf)
    actions = r.where("o_orderstatus in ('F', 'O')").select("profile_id", "posting_id", F.when(F.col("o_orderstatus") == "F", "applied").otherwise("saved").alias("action"))
    return A.conversion(r.select("profile_id", "posting_id", "rank"), actions)


@query("a15_feedback", RANKED + """, f AS (SELECT profile_id, CASE WHEN o_orderstatus = 'F' THEN 'good' ELSE 'bad' END AS type, o_orderpriority AS reason FROM k WHERE rank <= 10 AND o_orderstatus IN ('F', 'O')), b AS (SELECT profile_id, reason || '=' || count(*) AS x FROM f WHERE type = 'bad' GROUP BY profile_id, reason)
SELECT profile_id, count_if(type = 'good')::BIGINT AS good, count_if(type = 'bad')::BIGINT AS bad, (SELECT string_agg(x, ',' ORDER BY x) FROM b WHERE b.profile_id = f.profile_id) AS reasons, count_if(type = 'good') / count(*) AS good_rate FROM f GROUP BY profile_id""")
def a15_feedback(spark, sf):
    r = ranked_events(spark, sf)
    notes = r.where("o_orderstatus in ('F', 'O')").select("profile_id", "posting_id", F.when(F.col("o_orderstatus") == "F", "good").otherwise("bad").alias("type"), F.col("o_orderpriority").alias("reason"))
    return A.feedback(r.select("profile_id", "posting_id", "rank"), notes)


def zips(spark, sf):
    """Customers as postal areas: nation as state, a made-up city, coordinates from keys."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    return c.select(k.cast("string").alias("zip_code"), F.col("n_name").alias("state"), F.concat(F.lit("City "), (k % 60).cast("string")).alias("city"), (25 + (k * 37 % 2400) / 100).alias("latitude"), (-120 + (k * 53 % 5000) / 100).alias("longitude"), (k % 7 * 1000).alias("population"))


ZIPS = "WITH z AS (SELECT c_custkey::VARCHAR AS zip_code, n_name AS state, 'City ' || (c_custkey % 60) AS city, 25 + (c_custkey * 37 % 2400) / 100 AS latitude, -120 + (c_custkey * 53 % 5000) / 100 AS longitude, c_custkey % 7 * 1000 AS population FROM customer JOIN nation ON c_nationkey = n_nationkey)\n"


@query("a16_centroids", ZIPS + """, c AS (SELECT state, city, CASE WHEN sum(population) > 0 THEN sum(latitude * population) / sum(population) ELSE avg(latitude) END AS latitude, CASE WHEN sum(population) > 0 THEN sum(longitude * population) / sum(population) ELSE avg(longitude) END AS longitude, count(*) AS zips FROM z GROUP BY 1, 2)
SELECT *, count(*) OVER (PARTITION BY city) = 1 AS unique_name FROM c""")
def a16(spark, sf):
    return A.centroids(zips(spark, sf), True)


@query("a16_plain_centroids", ZIPS + "SELECT state, city, avg(latitude) AS latitude, avg(longitude) AS longitude, count(*) AS zips, (SELECT count(DISTINCT state) FROM z b WHERE b.city = z.city) = 1 AS unique_name FROM z GROUP BY 1, 2")
def a16_plain(spark, sf):
    return A.centroids(zips(spark, sf), False)


def employers(spark, sf):
    c = table(spark, sf, "customer")
    families = F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("alpha"), F.lit("beta"))).otherwise(F.array(F.concat(F.lit("f"), (F.col("c_custkey") % 5).cast("string"))))
    return c.select(F.col("c_custkey").alias("employer_id"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("resolved"), families.alias("families"), "c_mktsegment")


EMP = "WITH e AS (SELECT c_custkey AS employer_id, c_name AS name, c_acctbal > 0 AS resolved, CASE WHEN c_custkey % 4 = 0 THEN ['alpha', 'beta'] ELSE ['f' || (c_custkey % 5)] END AS families, c_mktsegment FROM customer)\n"


@query("a8_employer_coverage", EMP + """, l AS (SELECT o_custkey AS employer_id, count(*) AS listings, count_if(o_orderstatus = 'O')::BIGINT AS reachable FROM orders GROUP BY 1)
SELECT employer_id, name, resolved, families, c_mktsegment, coalesce(listings, 0) AS listings, coalesce(reachable, 0) AS reachable, CASE WHEN NOT resolved THEN 'unresolved' WHEN coalesce(listings, 0) = 0 THEN 'no_listings' WHEN reachable = 0 THEN 'unreachable' END AS miss FROM e LEFT JOIN l USING (employer_id)""")
def a8(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("employer_id"), F.when(F.col("o_orderstatus") == "O", "ok").otherwise("dead").alias("link_status"))
    return A.employer_coverage(employers(spark, sf), orders)


@query("a9_unresolved_impact", "SELECT c_mktsegment AS value, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal <= 0 GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def a9(spark, sf):
    missed = table(spark, sf, "orders").join(employers(spark, sf).where("not resolved"), F.col("o_custkey") == F.col("employer_id"))
    return A.top_values(missed, F.col("c_mktsegment"))


@query("a10_gap_candidates", EMP + "SELECT family, count(DISTINCT employer_id) AS employers, count(DISTINCT employer_id) * CASE family WHEN 'alpha' THEN 3.0 WHEN 'f1' THEN 0.5 ELSE 1.0 END AS score FROM (SELECT employer_id, unnest(families) AS family FROM e WHERE NOT resolved) GROUP BY 1")
def a10(spark, sf):
    return A.gap_candidates(employers(spark, sf), {"alpha": 3.0, "f1": 0.5})


@query("a17_employer_seed", with_sql("obs") + """SELECT lower(company) AS employer, list_sort(list(DISTINCT location)) AS states, count(*) AS evidence, count_if(link_kind = 'direct')::BIGINT AS authoritative, arg_min(title, ordinal) AS first_title FROM obs GROUP BY 1""")
def a17(spark, sf):
    o = observations(spark, sf)
    return o.groupBy(company_key(F.col("company")).alias("employer")).agg(F.array_sort(F.collect_set("location")).alias("states"), F.count(F.lit(1)).alias("evidence"), F.count_if(F.col("link_kind") == "direct").alias("authoritative"), F.min_by("title", "ordinal").alias("first_title"))


@query("a18_freshness_sla", with_sql("obs") + f""", g AS (SELECT posting_id, bool_or(posted_at >= TIMESTAMP '{REF}' - INTERVAL 30 DAY) AS fresh FROM obs GROUP BY 1)
SELECT count_if(fresh)::BIGINT AS fresh_groups, count_if(fresh AND posting_id % 3 > 0)::BIGINT AS covered, count_if(fresh AND posting_id % 3 > 0) / nullif(count_if(fresh), 0) AS ratio, coalesce(count_if(fresh AND posting_id % 3 > 0) / nullif(count_if(fresh), 0) >= 0.9, false) AS met FROM g""")
def a18(spark, sf):
    from quarrystone.operators.windows import freshness_sla

    o = observations(spark, sf)
    evidence = table(spark, sf, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("posting_id"))
    return freshness_sla(o, "posting_id", reference(), evidence, days=30)


@query("a19_rank_coverage", RANKED + """SELECT CASE WHEN rank <= 10 THEN 'top 10' WHEN rank <= 50 THEN 'top 50' ELSE 'rest' END AS pool, count(*) AS postings, count_if(o_orderstatus = 'F')::BIGINT AS with_evidence FROM k GROUP BY 1""")
def a19(spark, sf):
    r = ranked_events(spark, sf)
    pool = F.when(F.col("rank") <= 10, "top 10").when(F.col("rank") <= 50, "top 50").otherwise("rest")
    return r.groupBy(pool.alias("pool")).agg(F.count(F.lit(1)).alias("postings"), F.count_if(F.col("o_orderstatus") == "F").alias("with_evidence"))


@query("a22_link_quality", with_sql("obs", "post") + """SELECT CASE WHEN url LIKE '%/apply%' THEN 'apply' WHEN url IS NULL THEN 'unknown' ELSE 'view' END AS family, count(*) AS total, count_if(link_kind = 'direct')::BIGINT AS direct, count_if(link_kind <> 'direct')::BIGINT AS intermediary, count_if(link_status = 'dead')::BIGINT AS dead, 0::BIGINT AS unknown_direct, 0::BIGINT AS unverified FROM post GROUP BY 1""")
def a22(spark, sf):
    return A.link_quality(postings(spark, sf), F.when(F.col("url").contains("/apply"), "apply").when(F.col("url").isNotNull(), "view"))


@query("a22_top_hosts", r"SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS value, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def a22_hosts(spark, sf):
    return A.top_values(table(spark, sf, "pages"), host(F.col("url")))


@query("a23_extraction_outcomes", """SELECT event_type AS provider, count_if(o = 'extracted')::BIGINT AS extracted, count_if(o = 'empty')::BIGINT AS empty, count_if(o = 'failed')::BIGINT AS failed, count_if(o = 'unavailable')::BIGINT AS unavailable
FROM (SELECT event_type, CASE WHEN user_id % 11 = 0 THEN 'unavailable' WHEN user_id % 7 = 0 THEN 'failed' WHEN value > 20 THEN 'extracted' ELSE 'empty' END AS o FROM events) GROUP BY 1""")
def a23(spark, sf):
    e = table(spark, sf, "events")
    u = F.col("user_id")
    return A.extraction_outcomes(e.select(F.col("event_type").alias("provider"), F.when(u % 11 == 0, "unavailable").otherwise("ok").alias("status"), F.when(u % 7 == 0, "timeout").alias("last_error"), (F.col("value") > 20).cast("int").alias("facts")))


@query("a24_profile_grid", with_sql("obs", "post") + f"""SELECT profile, count(*) AS all_locations, count_if(list_contains(states, 'NATION_12'))::BIGINT AS region_any_age, count_if(list_contains(states, 'NATION_12') AND {AGE} <= 7)::BIGINT AS region_7d FROM (SELECT *, unnest(string_split(title, ' ')) AS profile FROM post) GROUP BY 1""")
def a24(spark, sf):
    p = postings(spark, sf).withColumn("profiles", F.split("title", " "))
    return A.profile_grid(p, reference(), F.array_contains("states", "NATION_12"))


@query("a25_seed_audit", EMP + """SELECT CASE WHEN s_suppkey IS NULL THEN 'absent' WHEN resolved THEN 'matched' ELSE 'can_enrich' END AS outcome, count(*) AS employers FROM e LEFT JOIN supplier ON employer_id = s_suppkey GROUP BY 1""")
def a25(spark, sf):
    e, s = employers(spark, sf), table(spark, sf, "supplier")
    outcome = F.when(F.col("s_suppkey").isNull(), "absent").when(F.col("resolved"), "matched").otherwise("can_enrich")
    return A.count_by(e.join(s, F.col("employer_id") == F.col("s_suppkey"), "left"), outcome.alias("outcome"), name="employers")


@query("a26_tenant_registry", r"""SELECT list_extract(string_split(h, '.'), -2) AS tenant, list_sort(list(DISTINCT h || '/' || p)) AS sites FROM (SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS h, regexp_extract(url, '^[A-Za-z]+://[^/?#]*/([^/?#]*)', 1) AS p FROM pages) GROUP BY 1""")
def a26(spark, sf):
    h = host(F.col("url"))
    urls = table(spark, sf, "pages").select(F.element_at(F.split(h, r"\."), -2).alias("tenant"), h.alias("host"), F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*/([^/?#]*)", 1).alias("site"))
    return A.registry(urls)


@query("a27_stage_history", """WITH s AS (SELECT ts::DATE AS run, ts AS started, event_id AS position, event_type AS stage, value AS seconds, user_id % 9 > 0 AS ok FROM events),
g AS (SELECT run, min(started) AS started, sum(seconds) AS total_s, (list(stage ORDER BY seconds DESC, position))[1] AS dominant, arg_min(stage, position) FILTER (NOT ok) AS first_failed FROM s WHERE seconds IS NOT NULL GROUP BY run)
SELECT * FROM g ORDER BY started DESC LIMIT 30""")
def a27(spark, sf):
    e = table(spark, sf, "events").where("value is not null")
    return A.stage_history(e.select(F.to_date("ts").alias("run"), F.col("ts").alias("started"), F.col("event_id").alias("position"), F.col("event_type").alias("stage"), F.col("value").alias("seconds"), (F.col("user_id") % 9 > 0).alias("ok")))


@query("a28_daily_quota", """SELECT event_id, user_id, count(*) OVER w AS used, count(*) OVER w > 3 AS over FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def a28(spark, sf):
    return A.daily_quota(table(spark, sf, "events"), "user_id", "ts", "event_id", 3).select("event_id", "user_id", "used", "over")


@query("a29_label_distribution", LABELLED + "SELECT label, count(*) AS n, count_if(list_contains(e, label))::BIGINT AS confident FROM (SELECT unnest(p) AS label, e FROM l) GROUP BY 1")
def a29(spark, sf):
    x = labelled(spark, sf).select("expected", F.explode("predicted").alias("label"))
    return x.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("expected", F.col("label"))).alias("confident"))


@query("a30_view_stats", with_sql("obs", "post") + f"SELECT count(*) AS shown, count_if({AGE} <= 7)::BIGINT AS last_7_days, 100.0 * count_if(link_kind = 'direct') / count(*) AS direct_percent, count(DISTINCT company) AS companies FROM post WHERE list_contains(states, 'NATION_12')")
def a30(spark, sf):
    return A.view_stats(postings(spark, sf).where(F.array_contains("states", "NATION_12")), reference())


@query("d10_duplicate_rate", with_sql("obs") + """, k AS (SELECT 'url' AS key, CASE WHEN url IS NULL THEN '' ELSE url END AS v FROM obs UNION ALL SELECT 'posting', posting_id::VARCHAR FROM obs UNION ALL SELECT 'company_title', lower(company) || '|' || lower(title) FROM obs),
g AS (SELECT key, v, count(*) AS n FROM k GROUP BY 1, 2) SELECT key, sum(n)::BIGINT AS keyed_rows, sum(n - 1)::BIGINT AS duplicates, 100.0 * sum(n - 1) / sum(n) AS rate FROM g GROUP BY 1""")
def d10(spark, sf):
    o = observations(spark, sf)
    return A.duplicate_rate(o, {"url": F.coalesce("url", F.lit("")), "posting": F.col("posting_id"), "company_title": F.concat_ws("|", norm(F.col("company")), norm(F.col("title")))})


@query("d10_largest_families", with_sql("obs") + "SELECT lower(company) AS k0, lower(title) AS k1, count(*) AS n FROM obs GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY n DESC, k0, k1 LIMIT 5")
def d10_families(spark, sf):
    return A.largest_families(observations(spark, sf), [norm(F.col("company")), norm(F.col("title"))])
