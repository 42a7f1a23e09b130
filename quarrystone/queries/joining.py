"""Queries of joins (J) and predicates (P)."""

from pyspark.sql import functions as F

from quarrystone.functions.text import host
from quarrystone.operators import joins as J
from quarrystone.operators import predicates as P
from quarrystone.queries.registry import query
from quarrystone.queries.reports import AGE, REF, ZIPS, employers, reference, zips
from quarrystone.sources.listings import observations, postings, source_health, table, with_sql


@query("j1_attach_evidence", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'inspected' END AS evidence_status, CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP '2001-01-01' ELSE o_orderdate END AS posted_at FROM orders")
def j1(spark, sf):
    o = table(spark, sf, "orders")
    p = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("posted_at"))
    even = o.where("o_orderkey % 2 = 0")
    url = F.concat(F.lit("u"), F.col("o_orderkey").cast("string"))
    bridge = even.select(F.col("o_orderkey").alias("posting_id"), url.alias("canonical_url"))
    evidence = even.select(url.alias("canonical_url"), F.lit("inspected").alias("status"), F.when(F.col("o_orderkey") % 4 == 0, F.to_timestamp(F.lit("2001-01-01 00:00:00"))).alias("posted_at"))
    return J.attach_evidence(p, bridge, evidence).select("id", "evidence_status", "posted_at")


@query("j2_prior_match", """WITH k AS (SELECT o_orderkey, 'a' || (o_orderkey % 1000) AS a, o_custkey || '/' || o_orderpriority AS b, o_orderdate < TIMESTAMP '1997-01-01' AS old FROM orders),
ua AS (SELECT a, min(o_orderkey) AS v FROM k WHERE old GROUP BY 1 HAVING count(DISTINCT o_orderkey) = 1), ub AS (SELECT b, min(o_orderkey) AS v FROM k WHERE old GROUP BY 1 HAVING count(DISTINCT o_orderkey) = 1)
SELECT o_orderkey, coalesce(ua.v, ub.v) AS prior_id, CASE WHEN ua.v IS NOT NULL THEN 1 WHEN ub.v IS NOT NULL THEN 2 END AS rung FROM k LEFT JOIN ua USING (a) LEFT JOIN ub USING (b) WHERE NOT old""")
def j2(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.concat(F.lit("a"), (F.col("o_orderkey") % 1000).cast("string")).alias("a"), F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority").alias("b"))
    old, new = o.where("o_orderdate < '1997-01-01'"), o.where("o_orderdate >= '1997-01-01'")
    return J.match_prior(new, old.withColumn("prior_id", F.col("o_orderkey")), ["a", "b"], "prior_id").select("o_orderkey", "prior_id", "rung")


@query("j3_carry_forward", with_sql("obs", "post", "health") + ", f AS (SELECT id, min(k) AS carried_from FROM (SELECT id, unnest(source_keys) AS k FROM post WHERE id % 2 = 0 AND link_status <> 'dead') WHERE k IN (SELECT key FROM health WHERE status = 'failed') GROUP BY 1) SELECT id, carried_from FROM f WHERE id NOT IN (SELECT id FROM post WHERE id % 6 = 0)")
def j3(spark, sf):
    p = postings(spark, sf, deal=True)
    return J.carry_forward(p.where("id % 6 = 0"), p.where("id % 2 = 0"), source_health(spark, sf).where("status = 'failed'")).select("id", "carried_from")


@query("j4_link_repair", with_sql("obs", "post") + """, d AS (SELECT company, title, location, url FROM post WHERE link_kind = 'direct' AND url IS NOT NULL), a AS (SELECT company, title, min(url) AS u FROM d GROUP BY 1, 2 HAVING count(DISTINCT url) = 1), b AS (SELECT title, location, min(url) AS u FROM d GROUP BY 1, 2 HAVING count(DISTINCT url) = 1)
SELECT id, coalesce(a.u, b.u) AS url, CASE WHEN a.u IS NOT NULL THEN 1 WHEN b.u IS NOT NULL THEN 2 END AS rung FROM post LEFT JOIN a USING (company, title) LEFT JOIN b ON b.title = post.title AND b.location = post.location WHERE link_kind <> 'direct'""")
def j4(spark, sf):
    p = postings(spark, sf)
    d = p.where("link_kind = 'direct'")
    rungs = [(["company", "title"], J.unique_lookup(d, ["company", "title"], "url")), (["title", "location"], J.unique_lookup(d, ["title", "location"], "url"))]
    return J.ladder_join(p.where("link_kind <> 'direct'").drop("url"), rungs, "url").select("id", "url", "rung")


@query("j5_candidate_ladder", with_sql("obs") + """, t AS (SELECT ordinal % 5000 AS k, posting_id AS v, 1 AS tier FROM obs WHERE link_kind = 'direct' UNION ALL SELECT ordinal % 5000, posting_id, 2 FROM obs WHERE link_kind = 'listing'), f AS (SELECT k, min(tier) AS tier FROM t GROUP BY 1)
SELECT DISTINCT obs.ordinal % 5000 AS k, g.tier, g.v FROM obs LEFT JOIN (SELECT k, tier, min(v) AS v FROM t JOIN f USING (k, tier) GROUP BY 1, 2 HAVING min(v) = max(v)) g ON g.k = obs.ordinal % 5000""")
def j5(spark, sf):
    o = observations(spark, sf).select((F.col("ordinal") % 5000).alias("k"), F.col("posting_id").alias("v"), "link_kind")
    return J.best_tier(o.select("k").distinct(), "k", [o.where("link_kind = 'direct'"), o.where("link_kind = 'listing'")], "v").select("k", "tier", "v")


@query("j6_containment_match", "WITH s AS (SELECT s_nationkey AS k, s_name AS loc, s_suppkey AS v FROM supplier) SELECT c_custkey, min(v) AS v FROM customer JOIN s ON k = c_nationkey WHERE (c_name = '' OR position(right(c_name, 2) IN loc) > 0) GROUP BY 1 HAVING count(DISTINCT v) = 1")
def j6(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.right("c_name", F.lit(2)).alias("a"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("b"), F.col("s_suppkey").alias("v"))
    return J.containment_match(c, s, ["k"], "a", "b", "v", "c_custkey")


@query("j9_alias_match", "WITH a AS (SELECT s_nationkey || '/' || (s_suppkey % 3) AS k, min(s_suppkey) AS e FROM supplier GROUP BY 1 HAVING count(*) = 1) SELECT c_custkey, coalesce(s_suppkey, e) AS employer_id FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey * 3 LEFT JOIN a ON a.k = c_nationkey || '/' || (c_custkey % 3)")
def j9(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("employer_id"), F.concat_ws("/", F.col("s_nationkey").cast("string"), (F.col("s_suppkey") % 3).cast("string")).alias("name_key"))
    c = table(spark, sf, "customer").select("c_custkey", F.concat_ws("/", F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 3).cast("string")).alias("name_key"), F.when(F.col("c_custkey") % 3 == 0, (F.col("c_custkey") / 3).cast("bigint")).alias("employer_hint"))
    return J.alias_match(c, s, s).select("c_custkey", "employer_id")


PLACES = ZIPS + ", c AS (SELECT state, city, avg(latitude) AS latitude, avg(longitude) AS longitude, count(*) OVER (PARTITION BY city) = 1 AS u FROM z GROUP BY 1, 2), l AS (SELECT o_orderkey AS id, 'city ' || (o_custkey % 70) AS city, 'NATION_' || (o_orderkey % 27) AS state FROM orders)\n"


@query("j10_place_resolution", PLACES + """SELECT id, city || ', ' || state AS value, CASE WHEN a.city IS NOT NULL THEN 2 ELSE 3 END AS tier, coalesce(a.latitude, b.latitude) AS latitude, coalesce(a.longitude, b.longitude) AS longitude
FROM l LEFT JOIN c a ON lower(a.city) = l.city AND a.state = l.state LEFT JOIN c b ON lower(b.city) = l.city AND b.u WHERE a.city IS NOT NULL OR b.city IS NOT NULL""".replace("city || ', ' || state AS value", "l.city || ', ' || l.state AS value"))
def j10(spark, sf):
    from quarrystone.operators.aggregates import centroids

    z = zips(spark, sf)
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("city "), (F.col("o_custkey") % 70).cast("string"), F.lit(", NATION_"), (F.col("o_orderkey") % 27).cast("string")).alias("value"))
    return J.resolve_places(o, z, centroids(z, False)).select("id", "value", "tier", "latitude", "longitude")


@query("j11_radius_join", ZIPS + """, b AS (SELECT state AS base, avg(latitude) AS y, avg(longitude) AS x FROM z GROUP BY 1), d AS (SELECT zip_code AS id, base, 2 * 3958.7613 * asin(least(1, sqrt(sin(radians(y - latitude) / 2) ** 2 + cos(radians(latitude)) * cos(radians(y)) * sin(radians(x - longitude) / 2) ** 2))) AS distance FROM z, b)
SELECT * FROM d WHERE distance <= 150""")
def j11(spark, sf):
    z = zips(spark, sf)
    bases = z.groupBy(F.col("state").alias("base")).agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
    return J.radius_join(z.select(F.col("zip_code").alias("id"), "latitude", "longitude"), bases, 150.0)


@query("j12_provider_family", r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS h FROM pages), f AS (SELECT page_id, (h LIKE '%.example.com')::INT AS a, (h LIKE '%.example.net' OR h = 'example.net')::INT AS b, (h LIKE 'm.%.example.com')::INT * 0 AS c FROM h)
SELECT page_id, CASE WHEN a + b = 1 THEN CASE WHEN a = 1 THEN 'commercial' ELSE 'network' END ELSE 'custom_unknown' END AS family, CASE WHEN a + b = 1 THEN 'resolved' ELSE 'unresolved' END AS status FROM f""")
def j12(spark, sf):
    rules = spark.createDataFrame([("example.com", "commercial"), ("example.net", "network")], "suffix string, family string")
    return J.provider_family(table(spark, sf, "pages"), "page_id", F.col("url"), F.broadcast(rules))


@query("j13_upsert", with_sql("obs", "post") + """, a AS (SELECT * FROM post WHERE id % 3 > 0), b AS (SELECT id, company, CASE WHEN id % 2 = 0 THEN title END AS title, ['new'] AS source_keys FROM post WHERE id % 3 < 2)
SELECT coalesce(a.id, b.id) AS id, coalesce(a.company, b.company) AS company, coalesce(a.title, b.title) AS title, list_sort(list_distinct(list_concat(coalesce(a.source_keys, []), coalesce(b.source_keys, [])))) AS source_keys FROM a FULL JOIN b ON a.id = b.id""")
def j13(spark, sf):
    p = postings(spark, sf).select("id", "company", "title", "source_keys")
    b = p.where("id % 3 < 2").select("id", "company", F.when(F.col("id") % 2 == 0, F.col("title")).alias("title"), F.array(F.lit("new")).alias("source_keys"))
    return J.upsert(p.where("id % 3 > 0"), b, "id", ["company", "title"], ["source_keys"])


@query("j13_merge_providers", with_sql("obs", "post") + """, b AS (SELECT id, 'https://x.example.com/' || id AS url, company, title, source_keys, posted_at FROM post WHERE id % 3 > 0), n AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'https://y.example.com/' ELSE 'https://x.example.com/' END || id AS url, 'P ' || company AS company, id % 2 = 0 AS direct, posted_at + INTERVAL 1 DAY AS posted_at FROM post WHERE id % 3 < 2)
SELECT coalesce(b.id, n.id)::VARCHAR AS id, CASE WHEN n.direct THEN n.company ELSE coalesce(b.company, n.company) END AS company, b.title AS title, coalesce(n.posted_at, b.posted_at) AS posted_at, list_sort(list_distinct(list_concat(coalesce(b.source_keys, []), CASE WHEN n.id IS NULL THEN [] ELSE ['new'] END))) AS source_keys FROM b FULL JOIN n ON b.id = n.id""")
def j13_providers(spark, sf):
    """Postings as a base, and some of them again as what a provider reports under another id, which meet by URL."""
    p = postings(spark, sf)
    own = lambda host_: F.concat(F.lit(f"https://{host_}.example.com/"), F.col("id").cast("string"))
    cols = ["company", "title", "source_keys", "posted_at"]
    base = p.where("id % 3 > 0").select(F.col("id").cast("string").alias("id"), own("x").alias("url"), *cols, F.lit(False).alias("direct_employer"))
    said = p.where("id % 3 < 2").select(F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise(F.concat(F.lit("other "), F.col("id").cast("string"))).alias("id"), F.when(F.col("id") % 3 == 0, own("y")).otherwise(F.concat(own("X"), F.lit("/?utm_source=z"))).alias("url"), F.concat(F.lit("P "), "company").alias("company"), F.lit("").alias("title"), F.array(F.lit("new")).alias("source_keys"), (F.col("posted_at") + F.expr("INTERVAL 1 DAY")).alias("posted_at"), (F.col("id") % 2 == 0).alias("direct_employer"), F.lit(0).alias("priority"))
    return J.merge_providers(base, said, ["title"], ["source_keys"]).select("id", "company", "title", "posted_at", "source_keys")


@query("j13_merge_sources", "SELECT 'auto-lever-' || c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS status FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'manual-' || c_custkey, 'old' FROM customer UNION ALL SELECT 'auto-ashby-' || c_custkey, 'old' FROM customer")
def j13_sources(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("k"), F.col("c_custkey").alias("n"))
    base = c.select(F.explode(F.array(*[F.concat(F.lit(x), "k") for x in ("auto-lever-", "manual-", "auto-ashby-")])).alias("key"), F.lit("old").alias("status"))
    said = c.where("n % 2 = 0").select(F.lit("lever").alias("provider"), F.concat(F.lit("auto-lever-"), "k").alias("key"), F.lit("new").alias("status"))
    return J.merge_sources(base, said)


@query("j14_new_drafts", "SELECT event_id FROM events WHERE NOT EXISTS (SELECT 1 FROM events o WHERE o.ts < TIMESTAMP '2024-01-10' AND o.user_id = events.user_id AND o.event_type = events.event_type) QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def j14(spark, sf):
    e = table(spark, sf, "events")
    return J.new_drafts(e, e.where("ts < '2024-01-10'"), ["user_id", "event_type"], "event_id").select("event_id")


@query("j15_board_discovery", r"""WITH e AS (SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS board, url, page_id FROM pages) SELECT board, min(url) AS url, count(*) AS evidence FROM e WHERE board NOT LIKE 'm.%' AND board NOT LIKE 'www.%' GROUP BY 1""")
def j15(spark, sf):
    p = table(spark, sf, "pages").select(host(F.col("url")).alias("board"), F.lit("").alias("company"), "url")
    return J.discover_boards(p, p.where("board like 'm.%'"), p.where("board like 'www.%'")).select("board", "url", "evidence")


@query("j16_plausible_domains", r"""WITH d AS (SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS domain FROM pages), l AS (SELECT domain, regexp_extract(domain, '([^.]+)\.[^.]+$', 1) AS l FROM d)
SELECT DISTINCT p_partkey AS employer_id, domain FROM l, part WHERE left(l, 4) = 'exam'""")
def j16(spark, sf):
    return domains_of(spark, sf, table(spark, sf, "part"))


def domains_of(spark, sf, parts):
    names = parts.select(F.col("p_partkey").alias("employer_id"), F.concat(F.lit("Example "), F.col("p_partkey").cast("string")).alias("name"))
    return J.plausible_domains(names, table(spark, sf, "pages").select(host(F.col("url")).alias("domain")).distinct())


@query("j17_brand_override", with_sql("obs") + "SELECT ordinal, CASE WHEN url IS NOT NULL AND ordinal % 2 = 0 THEN 'Brand ' || posting_id ELSE company END AS company FROM obs WHERE url LIKE '%/view/'")
def j17(spark, sf):
    o = observations(spark, sf).where("url like '%/view/'")
    boards = o.groupBy("url").agg(F.min("posting_id").alias("p")).select("url", F.lit("tok-en").alias("token"), F.concat(F.lit("Brand "), F.col("p").cast("string")).alias("brand"))
    return J.brand_override(o.withColumn("company", F.when(F.col("ordinal") % 2 == 0, "Tok En").otherwise(F.col("company"))), boards).select("ordinal", "company")


@query("j18_apply_observations", "WITH o AS (SELECT o_custkey, min('f' || (o_orderkey % 3)) AS f FROM orders GROUP BY 1 HAVING count(*) = 1) SELECT c_custkey AS employer_id, coalesce(f, c_mktsegment) AS family FROM customer LEFT JOIN o ON o_custkey = c_custkey")
def j18(spark, sf):
    e = table(spark, sf, "customer").select(F.col("c_custkey").alias("employer_id"), F.col("c_mktsegment").alias("family"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("employer_id"), F.concat(F.lit("f"), (F.col("o_orderkey") % 3).cast("string")).alias("family"))
    return J.apply_observations(e, o)["updated"].select("employer_id", "family")


@query("p1_normalised_observations", with_sql("obs") + """SELECT ordinal, lower(title) || 's' AS title, CASE WHEN ordinal % 9 = 0 THEN 'Company not listed' ELSE company END AS company, CASE WHEN ordinal % 7 = 0 THEN 'Location not listed' ELSE location END AS location FROM obs WHERE ordinal % 11 > 0""")
def p1(spark, sf):
    k = F.col("ordinal")
    raw = observations(spark, sf).select(
        "ordinal", F.when(k % 11 == 0, "Role").otherwise(F.concat(F.lit("![x](y) ["), F.lower("title"), F.lit("](https://z)s "))).alias("title"), F.when(k % 9 == 0, "↳").otherwise(F.concat(F.lit("<b>"), "company", F.lit("</b>"))).alias("company"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), "location")).alias("location"), "url", F.lit(None).cast("string").alias("section"),
    )
    return P.normalize_observations(raw).select("ordinal", "title", "company", "location")


@query("p2_admission", with_sql("obs", "post") + "SELECT id FROM post WHERE (regexp_matches(title, '(?i)standard|promo|economy')) AND (title LIKE '%A%' OR regexp_matches(title, '(?i)promo')) AND list_contains(states, 'NATION_12')")
def p2(spark, sf):
    return P.admitted(postings(spark, sf), "standard|promo|economy", "promo", "A", ["NATION_12"]).select("id")


@query("p3_default_eligible", with_sql("obs", "post") + "SELECT id FROM post WHERE title <> 'PROMO' AND link_kind IN ('direct', 'listing')")
def p3(spark, sf):
    p = postings(spark, sf)
    return p.where(P.default_eligible(F.when(F.col("title") == "PROMO", "graduate-only"), F.col("link_kind"), ["direct", "listing"])).select("id")


@query("p4_browse", with_sql("obs", "post") + f"SELECT id FROM post WHERE contains(lower(concat_ws(' ', company, title, location)), 'company') AND contains(lower(concat_ws(' ', company, title, location)), '1') AND posted_at >= TIMESTAMP '1996-01-01' AND list_has_any(states, ['NATION_12', 'NATION_13']) AND id % 5 > 0")
def p4(spark, sf):
    p = postings(spark, sf)
    return P.browse(p, None, "company 1", F.to_timestamp(F.lit("1996-01-01 00:00:00")), ["NATION_12", "NATION_13"], p.where("id % 5 = 0")).select("id")


@query("p4_browse_near", """SELECT c_custkey AS id FROM customer WHERE c_nationkey = 3 OR (c_custkey % 97 < 90 AND 2 * 3958.7613 * asin(least(1.0, sqrt(sin(radians(40.5 - (c_custkey % 97 - 20)) / 2) ** 2 + cos(radians(c_custkey % 97 - 20)) * cos(radians(40.5)) * sin(radians(-73.5 - (c_custkey % 89 - 100)) / 2) ** 2))) <= 900)""")
def p4_near(spark, sf):
    """Customers as postings with a point, those of one nation remote."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    rows = c.select(k.alias("id"), F.when(F.col("c_nationkey") == 3, F.array(F.lit("Remote"))).otherwise(F.array(F.lit("NY"))).alias("states"))
    points = c.where(k % 97 < 90).select(k.alias("id"), (k % 97 - 20).cast("double").alias("latitude"), (k % 89 - 100).cast("double").alias("longitude"))
    return P.browse(rows, near=(points, 40.5, -73.5, 900.0)).select("id")


@query("p5_suitable", with_sql("obs", "post") + f"SELECT id FROM post WHERE url IS NOT NULL AND location <> 'NATION_13' AND link_kind = 'direct' AND title IN ('PROMO', 'STANDARD') AND posted_at >= TIMESTAMP '{REF}' - INTERVAL 900 DAY")
def p5(spark, sf):
    p = postings(spark, sf).withColumn("profiles", F.array("title"))
    return P.suitable(p, reference(), 900, ["direct"], ["PROMO", "STANDARD"], "^nation_13$").select("id")


@query("p6_candidate_pool", "SELECT o_custkey AS profile_id, o_orderkey AS posting_id FROM orders o WHERE o_orderpriority NOT LIKE '2%' AND o_orderkey % 10 > 0 AND NOT EXISTS (SELECT 1 FROM orders a WHERE a.o_orderkey % 10 = 0 AND a.o_custkey = o.o_custkey AND a.o_orderpriority = o.o_orderpriority)")
def p6(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("posting_id"), F.col("o_orderpriority").alias("canonical_key"))
    terms = F.when(F.col("canonical_key").like("2%"), F.array(F.lit("spring"))).otherwise(F.expr("CAST(array() AS array<string>)"))
    return P.candidate_pool(o, o.where("posting_id % 10 = 0"), terms, F.lit("summer")).select("profile_id", "posting_id")


@query("p7_fresh_funnel", with_sql("obs", "post") + f"SELECT count(*) AS ranked, count_if(coalesce({AGE} <= 900, false))::BIGINT AS fresh, count_if(link_kind = 'direct')::BIGINT AS qualified, count_if(coalesce({AGE} <= 900, false) AND link_kind = 'direct')::BIGINT AS fresh_qualified, count_if(posted_at IS NULL)::BIGINT AS undated FROM post")
def p7(spark, sf):
    from quarrystone.operators.aggregates import age_days

    return P.fresh_funnel(postings(spark, sf), age_days(F.col("posted_at"), reference()), F.col("link_kind") == "direct", 900)


@query("p8_quarantine", with_sql("obs") + """, r AS (SELECT ordinal, posting_id, list_filter([CASE WHEN url IS NULL THEN 'url' END, CASE WHEN title = 'PROMO' THEN 'title' END, CASE WHEN row_number() OVER (PARTITION BY posting_id ORDER BY ordinal) > 1 THEN 'duplicate id' END], lambda x: x IS NOT NULL) AS hard, list_filter([CASE WHEN link_status = 'dead' THEN 'dead link' END], lambda x: x IS NOT NULL) AS soft FROM obs)
SELECT ordinal, CASE WHEN len(hard) > 0 THEN 'quarantined' WHEN len(soft) > 0 THEN 'downgraded' ELSE 'valid' END AS verdict, array_to_string(CASE WHEN len(hard) > 0 THEN hard ELSE soft END, ',') AS reasons FROM r""")
def p8(spark, sf):
    parts = P.split_by_rules(observations(spark, sf), "posting_id", "ordinal", {"url": F.col("url").isNull(), "title": F.col("title") == "PROMO"}, {"dead link": F.col("link_status") == "dead"})
    out = None
    for name, df in parts.items():
        part = df.select("ordinal", F.lit(name).alias("verdict"), F.array_join("reasons", ",").alias("reasons"))
        out = part if out is None else out.unionByName(part)
    return out


@query("p9_usage_contract", """SELECT event_id, CASE WHEN user_id % 13 = 0 THEN 'unsupported_schema' WHEN user_id % 7 = 0 THEN 'invalid_visitor' WHEN event_id % 50 = 0 THEN 'invalid_sequence' WHEN value > 90 THEN 'invalid_time_order' WHEN event_type = 'error' THEN 'invalid_events' END AS error FROM events""")
def p9(spark, sf):
    return P.usage_errors(usage_batches(table(spark, sf, "events")), "usage-1", ["click", "view", "signup", "purchase"]).select("event_id", "error")


def usage_batches(e):
    """Events as usage batches, some of which break the contract."""
    u = F.col("user_id")
    return e.select(
        "event_id", "ts", F.when(u % 13 == 0, "old").otherwise("usage-1").alias("schema"), F.concat(F.when(u % 7 == 0, "x").otherwise("visitor-"), u.cast("string")).alias("visitor_id"), F.concat(F.lit("session-"), u.cast("string")).alias("session_id"),
        (F.col("event_id") % 50).alias("sequence"), F.col("ts").alias("started_at"), F.when(F.col("value") > 90, F.col("ts") - F.expr("INTERVAL 1 MINUTE")).otherwise(F.col("ts")).alias("ended_at"), F.lit("abc123").alias("build_sha"),
        F.create_map(F.col("event_type"), F.lit(1).cast("bigint")).alias("events"),
    )


@query("p10_record_search", "SELECT * FROM (SELECT * FROM (SELECT 'customer' AS kind, c_custkey::VARCHAR AS key FROM customer WHERE lower(c_name || '|' || c_mktsegment) LIKE '%auto%' ORDER BY 2 LIMIT 25) UNION ALL SELECT * FROM (SELECT 'part', p_partkey::VARCHAR FROM part WHERE lower(p_name || '|' || p_type) LIKE '%auto%' ORDER BY 2 LIMIT 25)) ORDER BY kind, key LIMIT 25")
def p10(spark, sf):
    return P.search({"customer": (table(spark, sf, "customer"), "c_custkey", ["c_name", "c_mktsegment"]), "part": (table(spark, sf, "part"), "p_partkey", ["p_name", "p_type"])}, "AUTO", 25)


@query("p11_pii_scan", r"""WITH h AS (SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS value FROM documents
UNION ALL SELECT doc_id, 'phone', unnest(regexp_extract_all(text, '(^|[^0-9])((\+?1[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(\b|$)', 2)) FROM documents) SELECT doc_id, 'text' AS path, kind, value FROM h""")
def p11(spark, sf):
    return P.pii_hits(table(spark, sf, "documents"), "doc_id", ["text"])


@query("p12_verification", "WITH v AS (SELECT page_id, CASE WHEN url LIKE 'https%' THEN 'verified' ELSE 'unknown' END AS a, CASE WHEN length(html) > 3000 THEN 'verified' WHEN length(html) < 800 THEN 'rejected' ELSE 'unknown' END AS b FROM pages) SELECT page_id, CASE WHEN a = 'rejected' OR b = 'rejected' THEN 'rejected' WHEN a = 'verified' AND b = 'verified' THEN 'verified' ELSE 'unknown' END AS decision FROM v")
def p12(spark, sf):
    n = F.length("html")
    dims = {"url_ok": F.when(F.col("url").like("https%"), "verified").otherwise("unknown"), "size_ok": F.when(n > 3000, "verified").when(n < 800, "rejected").otherwise("unknown")}
    return P.verification(table(spark, sf, "pages"), dims).select("page_id", "decision")


@query("p13_expectations", with_sql("obs", "post") + """SELECT id, list_concat(list_concat(CASE WHEN title = 'PROMO' THEN [] ELSE ['missing expected profile PROMO'] END, CASE WHEN list_contains(states, 'NATION_12') THEN [] ELSE ['missing expected state NATION_12'] END), CASE WHEN link_kind = 'source' THEN ['hidden type source'] ELSE [] END) AS issues FROM post""")
def p13(spark, sf):
    one = lambda x: F.array(F.lit(x))
    issues = P.expectation_issues(F.array("title"), F.col("states"), F.col("link_kind"), F.lit(""), one("PROMO"), one("NATION_12"), ["direct", "listing"])
    return postings(spark, sf).select("id", issues.alias("issues"))
