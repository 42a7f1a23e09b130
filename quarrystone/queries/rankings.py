"""Queries of windows (W), deduplication (D) and sets (U)."""

from pyspark.sql import functions as F

from quarrystone.functions import text as TX
from quarrystone.functions.text import canonical_url, message_template, norm
from quarrystone.operators import dedupe as D
from quarrystone.operators import sets as U
from quarrystone.operators import windows as W
from quarrystone.plans.shared import dealt
from quarrystone.queries.registry import query
from quarrystone.queries.reports import REF, reference
from quarrystone.sources.listings import observations, postings, source_health, table, with_sql


def scored(spark, sf):
    """Orders as scored postings of the customer's segment, a profile."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(
        F.col("c_mktsegment").alias("profile_id"), F.col("o_orderkey").alias("posting_id"), (F.col("o_orderkey") % 61).alias("score_min"), (F.col("o_orderkey") % 61 + F.col("o_custkey") % 13).alias("score_max"),
        F.col("o_orderdate").alias("posted_at"), F.col("c_name").alias("company"), (F.col("o_custkey") % 5).alias("gain"),
    )


SCORED = "WITH s AS (SELECT c_mktsegment AS profile_id, o_orderkey AS posting_id, o_orderkey % 61 AS score_min, o_orderkey % 61 + o_custkey % 13 AS score_max, o_orderdate AS posted_at, c_name AS company, o_custkey % 5 AS gain FROM orders JOIN customer ON o_custkey = c_custkey)\n"


@query("w1_final_ranking", SCORED + "SELECT * FROM (SELECT profile_id, posting_id, score_min, score_max, row_number() OVER (PARTITION BY profile_id ORDER BY score_min DESC, score_max DESC, posted_at DESC NULLS LAST, company, posting_id) AS rank FROM s) WHERE rank <= 50")
def w1(spark, sf):
    return W.rank_postings(scored(spark, sf), 50).select("profile_id", "posting_id", "score_min", "score_max", "rank")


@query("w2_inspection_queue", with_sql("obs") + f""", g AS (SELECT posting_id AS url, source_key AS provider, max(posted_at) AS newest, max(salary_max) AS score, max((link_status = 'dead')::INT) AS pending FROM obs GROUP BY 1, 2),
b AS (SELECT *, floor(epoch(TIMESTAMP '{REF}' - newest) / 86400) AS age FROM g), c AS (SELECT *, CASE WHEN age <= 3 THEN 0 WHEN age <= 7 THEN 1 WHEN age <= 14 THEN 2 WHEN age <= 30 THEN 3 ELSE 4 END AS band FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY pending DESC, band, score DESC NULLS LAST, newest DESC NULLS LAST, url) AS position FROM c) SELECT url, provider, pending, band, position FROM d WHERE position <= 25""")
def w2(spark, sf):
    o = observations(spark, sf).select(F.col("posting_id").alias("url"), F.col("source_key").alias("provider"), "posted_at", F.col("salary_max").alias("score"), "link_status")
    return W.inspection_queue(o, "url", "provider", reference(), F.col("link_status") == "dead", 25).select("url", "provider", "pending", "band", "position")


@query("w2_term_queue", with_sql("obs") + f""", t AS (SELECT *, CASE ordinal % 3 WHEN 0 THEN 'summer 1997' WHEN 1 THEN '' ELSE 'fall 1997' END AS term FROM obs), g AS (SELECT posting_id AS url, source_key AS provider, max(posted_at) AS newest, max(salary_max) AS score, max((link_status = 'dead')::INT) AS pending, min(CASE term WHEN 'summer 1997' THEN 0 WHEN '' THEN 1 ELSE 2 END) AS term_band FROM t GROUP BY 1, 2),
b AS (SELECT *, floor(epoch(TIMESTAMP '{REF}' - newest) / 86400) AS age FROM g), c AS (SELECT *, CASE WHEN age <= 3 THEN 0 WHEN age <= 7 THEN 1 WHEN age <= 14 THEN 2 WHEN age <= 30 THEN 3 ELSE 4 END AS band FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY (term_band = 2)::INT, pending DESC, band, term_band, score DESC NULLS LAST, newest DESC NULLS LAST, url) AS position FROM c) SELECT url, provider, term_band, position FROM d WHERE position <= 25""")
def w2_terms(spark, sf):
    n = F.col("ordinal") % 3
    o = observations(spark, sf).select(F.col("posting_id").alias("url"), F.col("source_key").alias("provider"), "posted_at", F.col("salary_max").alias("score"), "link_status", F.when(n == 0, "Summer 1997").when(n == 2, "Fall 1997").alias("term"))
    return W.inspection_queue(o, "url", "provider", reference(), F.col("link_status") == "dead", 25, term="term", target=F.lit("Summer 1997")).select("url", "provider", "term_band", "position")


@query("w3_budget_queue", "SELECT o_custkey, o_orderkey, spent FROM (SELECT o_custkey, o_orderkey, sum(o_orderkey % 7 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey ROWS UNBOUNDED PRECEDING) AS spent FROM orders) WHERE spent <= 20")
def w3(spark, sf):
    o = table(spark, sf, "orders").withColumn("cost", F.col("o_orderkey") % 7 + 1)
    return W.budget_queue(o, [F.asc("o_orderpriority"), F.asc("o_orderkey")], "cost", 20, ["o_custkey"]).select("o_custkey", "o_orderkey", "spent")


@query("w4_quota_interleave", """WITH k AS (SELECT event_id, value IS NOT NULL AND value > 10 AS d, value FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY value DESC NULLS LAST, event_id) AS n FROM k)
SELECT event_id FROM n ORDER BY CASE WHEN n > CASE WHEN d THEN 75 ELSE 25 END THEN 1 ELSE 0 END, d DESC, n LIMIT 100""")
def w4(spark, sf):
    return W.quota_interleave(table(spark, sf, "events"), F.col("value") > 10, [F.desc_nulls_last("value"), F.asc("event_id")], 100).select("event_id")


@query("w5_stratified_sample", """WITH t AS (SELECT doc_id, lang AS label, sha256(doc_id::VARCHAR) AS h FROM documents UNION ALL SELECT doc_id, source, sha256(doc_id::VARCHAR) FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, doc_id) AS turn FROM t), o AS (SELECT doc_id, min({'turn': turn, 'label': label}) AS t FROM n WHERE turn <= 40 GROUP BY 1)
SELECT doc_id, t.turn AS turn, t.label AS label FROM o ORDER BY t.turn, t.label LIMIT 40""")
def w5(spark, sf):
    d = table(spark, sf, "documents").withColumn("labels", F.array("lang", "source"))
    return W.stratified_sample(d, "doc_id", "labels", 40)


@query("w6_hash_sample", "SELECT doc_id, lang FROM documents ORDER BY sha256(doc_id::VARCHAR), doc_id LIMIT 50")
def w6(spark, sf):
    return W.hash_sample(table(spark, sf, "documents"), "doc_id", 50).select("doc_id", "lang")


@query("w7_sort_modes", with_sql("obs", "post") + "SELECT 'newest' AS mode, id FROM (SELECT id FROM post ORDER BY posted_at DESC NULLS LAST, company, id LIMIT 20) UNION ALL SELECT 'oldest', id FROM (SELECT id FROM post ORDER BY posted_at NULLS LAST, company, id LIMIT 20) UNION ALL SELECT 'company', id FROM (SELECT id FROM post ORDER BY company, posted_at DESC NULLS LAST, id LIMIT 20)")
def w7(spark, sf):
    p = postings(spark, sf)
    out = None
    for mode in ("newest", "oldest", "company"):
        part = W.sorted_by(p, mode).limit(20).select(F.lit(mode).alias("mode"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("w8_bound_pruning", SCORED + ", n AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score_min DESC) AS n FROM s), c AS (SELECT profile_id, min(score_min) AS cutoff FROM n WHERE n <= 20 GROUP BY 1) SELECT profile_id, posting_id, cutoff FROM s JOIN c USING (profile_id) WHERE score_max + gain >= cutoff")
def w8(spark, sf):
    return W.prune_by_bound(scored(spark, sf), "gain", 20).select("profile_id", "posting_id", "cutoff")


@query("w9_incremental_rerank", SCORED + ", m AS (SELECT profile_id, posting_id, score_min + CASE WHEN posting_id % 10 = 0 THEN 40 ELSE 0 END AS score_min, score_max + CASE WHEN posting_id % 10 = 0 THEN 40 ELSE 0 END AS score_max, posted_at, company FROM s) SELECT profile_id, posting_id, score_min, row_number() OVER (PARTITION BY profile_id ORDER BY score_min DESC, score_max DESC, posted_at DESC NULLS LAST, company, posting_id) AS rank FROM m")
def w9(spark, sf):
    old = W.rank_postings(scored(spark, sf))
    new = scored(spark, sf).where("posting_id % 10 = 0").withColumn("score_min", F.col("score_min") + 40).withColumn("score_max", F.col("score_max") + 40)
    return W.rerank(old, new, new.select("profile_id", "posting_id")).select("profile_id", "posting_id", "score_min", "rank")


@query("w10_latest_non_null", "SELECT user_id, arg_max(value, event_id) FILTER (value IS NOT NULL) AS value, arg_max(props, event_id) FILTER (props IS NOT NULL) AS props FROM events GROUP BY 1")
def w10(spark, sf):
    return W.latest_non_null(table(spark, sf, "events"), "user_id", "event_id", ["value", "props"])


def base_pairs(spark, sf):
    line = table(spark, sf, "lineitem")
    k = F.col("l_suppkey")
    return line.select((F.col("l_partkey") % 20).alias("profile_id"), F.col("l_orderkey").alias("posting_id"), (k % 4).alias("score"), (k * 13 % 97).cast("double").alias("distance"), F.col("l_linenumber").alias("position"), k.alias("base"))


@query("w11_best_base", """WITH p AS (SELECT l_partkey % 20 AS profile_id, l_orderkey AS posting_id, l_suppkey % 4 AS score, (l_suppkey * 13 % 97)::DOUBLE AS distance, l_linenumber AS position, l_suppkey AS base FROM lineitem)
SELECT profile_id, posting_id, (list(base ORDER BY score DESC, distance, position, base DESC))[1] AS base, min(distance) AS nearest FROM p GROUP BY 1, 2""")
def w11(spark, sf):
    return W.best_base(base_pairs(spark, sf))


@query("w12_order_locations", with_sql("obs") + ", d AS (SELECT DISTINCT posting_id, location, CASE WHEN length(location) % 2 = 0 THEN length(location)::DOUBLE END AS a, (ascii(right(location, 1)) % 5)::DOUBLE AS b FROM obs) SELECT posting_id, list(location ORDER BY a NULLS LAST, b, location) AS places FROM d GROUP BY 1")
def w12(spark, sf):
    from pyspark.sql import Window

    d = dealt(observations(spark, sf).select("posting_id", F.col("location").alias("value")), "posting_id").distinct()
    pos = F.row_number().over(Window.partitionBy("posting_id").orderBy("value"))
    n = F.length("value")
    return W.order_locations(d.withColumn("pos", pos).withColumn("first_distance", F.when(n % 2 == 0, n.cast("double"))).withColumn("least_distance", (F.ascii(F.right("value", F.lit(1))) % 5).cast("double")))


@query("d1_observation_groups", with_sql("obs") + r""", k AS (SELECT ordinal, CASE WHEN url IS NULL THEN 'row ' || ordinal ELSE regexp_replace(regexp_replace(url, '\?.*', ''), '/$', '') END AS key, lower(company) || '|' || lower(title) || '|' || regexp_replace(lower(location), '[^a-z0-9]+', ' ', 'g') AS sig FROM obs),
e AS (SELECT *, first_value(sig) OVER w AS eff, row_number() OVER w = 1 AS first FROM k WINDOW w AS (PARTITION BY key ORDER BY ordinal))
SELECT ordinal, min(CASE WHEN first THEN ordinal END) OVER (PARTITION BY eff) AS group_id FROM e""")
def d1(spark, sf):
    return D.group_observations(observations(spark, sf)).select("ordinal", "group_id")


@query("d2_field_merge", with_sql("obs") + """SELECT posting_id AS group_id, list_sort(list(DISTINCT source_key)) AS source_keys, count(*) AS observations,
 (list(url ORDER BY (url IS NOT NULL) DESC, CASE link_kind WHEN 'direct' THEN 4 WHEN 'listing' THEN 2 ELSE 1 END DESC, ordinal))[1] AS url,
 (list(posted_at ORDER BY (posted_date_provenance <> 'aggregator') DESC, posted_at DESC))[1] AS posted_at, (list(salary_max ORDER BY (salary_min <> salary_max) DESC, ordinal))[1] AS salary_max, arg_min(title, ordinal) AS title FROM obs GROUP BY 1""")
def d2(spark, sf):
    merged = D.merge_groups(observations(spark, sf).withColumn("group_id", F.col("posting_id")), ["aggregator.example.com"])
    return merged.select("group_id", "source_keys", "observations", "url", "posted_at", "salary_max", "title")


def dated_postings(spark, sf):
    return postings(spark, sf).withColumn("first_seen", F.col("posted_at"))


@query("d3_reconciliation", with_sql("obs", "post") + """, k AS (SELECT *, coalesce(CASE WHEN id % 5 > 0 THEN company || title END, 'row ' || id) AS i FROM post)
SELECT (list(id ORDER BY (link_kind = 'direct') DESC, CASE link_kind WHEN 'direct' THEN 4 WHEN 'listing' THEN 2 ELSE 1 END DESC, len(source_keys) DESC, posted_at DESC, id DESC))[1] AS id, list_sort(list_distinct(flatten(list(source_keys)))) AS source_keys, min(posted_at) AS first_seen, count(*) AS merged FROM k GROUP BY i""")
def d3(spark, sf):
    identity = F.when(F.col("id") % 5 > 0, F.concat("company", "title"))
    return D.reconcile(dated_postings(spark, sf), identity, keep=["id", "source_keys", "first_seen"]).select("id", "source_keys", "first_seen", "merged")


@query("d4_reconcile_stats", with_sql("obs", "post") + """, g AS (SELECT CASE WHEN id % 5 > 0 THEN company || title END AS i, count(*) AS n FROM post GROUP BY 1)
SELECT sum(n) FILTER (i IS NOT NULL)::BIGINT AS identified, count(i) AS groups, sum(n - 1) FILTER (i IS NOT NULL)::BIGINT AS merged_rows, sum(n) FILTER (i IS NULL)::BIGINT AS passed FROM g""")
def d4(spark, sf):
    return D.reconcile_stats(postings(spark, sf), F.when(F.col("id") % 5 > 0, F.concat("company", "title")))


@query("d4_group_merge", with_sql("obs") + """, r AS (SELECT *, posting_id AS i, max(CASE link_kind WHEN 'direct' THEN 4 WHEN 'listing' THEN 2 ELSE 1 END) OVER (PARTITION BY posting_id) AS k FROM obs)
SELECT i AS posting, (list(company || '/' || title ORDER BY (link_kind = 'direct') DESC, CASE link_kind WHEN 'direct' THEN 4 WHEN 'listing' THEN 2 ELSE 1 END DESC, posted_at DESC, ordinal DESC))[1] AS named,
 CASE WHEN bool_or(link_status = 'ok') THEN 'ok' ELSE 'dead' END AS link_status, max(posted_at) AS posted_at, list_sort(list(DISTINCT source_key)) AS source_keys, (list(url ORDER BY ordinal) FILTER (url IS NOT NULL))[1] IS NOT NULL AS has_url, count(*) AS merged FROM r GROUP BY i""")
def d4_merge(spark, sf):
    o = observations(spark, sf).withColumn("source_keys", F.array("source_key")).withColumnRenamed("ordinal", "id").withColumn("direct_employer", F.col("link_kind") == "direct")
    merged = D.reconcile(o.select("id", "posting_id", "company", "title", "location", "url", "link_kind", "link_status", "posted_at", "source_keys", "direct_employer"), F.col("posting_id").cast("string"), fill=["url"])
    return merged.select(F.col("posting_id").alias("posting"), F.concat_ws("/", "company", "title").alias("named"), "link_status", "posted_at", "source_keys", F.col("url").isNotNull().alias("has_url"), "merged")


@query("d3_fallback_identities", with_sql("obs") + r"""SELECT ordinal, CASE WHEN link_kind = 'direct' AND url IS NOT NULL THEN CASE WHEN regexp_matches(regexp_replace(url, '\?.*', ''), '[0-9]{8,}') THEN 'direct-posting-url' ELSE 'direct-url' END END AS kind FROM obs""")
def d3_fallbacks(spark, sf):
    o = observations(spark, sf)
    return o.select("ordinal", F.substring_index(D.reconciliation_identity(o), "|", 1).alias("kind"))


@query("d5_pool_dedupe", with_sql("obs", "post") + """, c AS (SELECT *, company || title || location AS ck, company || title AS s, id % 4 = 0 AS strong FROM post),
a AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY ck ORDER BY posted_at DESC, id) = 1), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY CASE WHEN strong THEN s || chr(1) || ck ELSE s END ORDER BY posted_at DESC, id) = 1)
SELECT id FROM b QUALIFY strong OR NOT bool_or(strong) OVER (PARTITION BY s)""")
def d5(spark, sf):
    rows = D.pool_dedupe(postings(spark, sf), F.concat("company", "title", "location"), F.concat("company", "title"), F.col("id") % 4 == 0, [F.desc("posted_at"), F.asc("id")])
    return rows.select("id")


@query("d6_discovery_entities", r"""WITH RECURSIVE p AS (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '\?.*$', '') AS u, md5(html) AS m FROM pages), k AS (SELECT page_id, u AS k FROM p UNION ALL SELECT page_id, m FROM p),
e AS (SELECT DISTINCT a.page_id AS a, b.page_id AS b FROM k a JOIN k b USING (k) WHERE a.page_id <> b.page_id), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT page_id, least(page_id, coalesce((SELECT min(b) FROM r WHERE r.a = page_id), page_id)) AS entity FROM p""")
def d6(spark, sf):
    p = table(spark, sf, "pages")
    bare = F.regexp_replace(F.regexp_replace("url", "#.*$", ""), r"\?.*$", "")
    return D.merge_by_keys(p, "page_id", F.array(bare, F.md5("html"))).select("page_id", "entity")


@query("d6_representatives", "SELECT c_nationkey AS g, arg_max(c_custkey, {'q': c_acctbal, 'o': -c_custkey}) AS c_custkey, count(*) AS rows, list_sort(list(DISTINCT c_mktsegment)) AS sources FROM customer GROUP BY 1")
def d6_best(spark, sf):
    c = table(spark, sf, "customer").withColumn("source", F.col("c_mktsegment"))
    return D.best_representative(c, "c_nationkey", F.col("c_acctbal"), "c_custkey").select(F.col("c_nationkey").alias("g"), "c_custkey", "rows", "sources")


@query("d7_stable_ids", """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'old-' || (o_orderkey % 900) END AS prior, left(sha1('b|' || (o_orderkey % 1100)), 16) AS h FROM orders),
f AS (SELECT *, prior IS NOT NULL AND row_number() OVER (PARTITION BY prior ORDER BY o_orderkey) = 1 AS keeps FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY keeps, h ORDER BY o_orderkey) - 1 AS no FROM f)
SELECT o_orderkey, CASE WHEN keeps THEN prior WHEN no = 0 THEN h ELSE left(sha1(h || '|' || no), 16) END AS stable_id FROM n""")
def d7(spark, sf):
    k = F.col("o_orderkey")
    rows = D.stable_ids(table(spark, sf, "orders"), F.when(k % 3 == 0, F.concat(F.lit("old-"), (k % 900).cast("string"))), F.concat(F.lit("b|"), (k % 1100).cast("string")), "o_orderkey")
    return rows.select("o_orderkey", "stable_id")


@query("d8_unique_listings", with_sql("obs") + "SELECT ordinal FROM obs QUALIFY row_number() OVER (PARTITION BY coalesce(url, company || title) ORDER BY ordinal) = 1")
def d8(spark, sf):
    return D.unique_listings(observations(spark, sf), [F.col("url"), F.concat("company", "title")], ["ordinal"]).select("ordinal")


@query("d9_employer_merge", """WITH RECURSIVE k AS (SELECT c_custkey AS n, 'phone ' || (c_custkey % 97) || '/' || c_nationkey AS k FROM customer UNION ALL SELECT c_custkey, 'seg ' || c_mktsegment || (c_custkey % 211) FROM customer),
e AS (SELECT DISTINCT a.n AS a, b.n AS b FROM k a JOIN k b USING (k) WHERE a.n <> b.n), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT c_custkey, least(c_custkey, coalesce(m, c_custkey)) AS entity FROM customer LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY 1) ON a = c_custkey""")
def d9(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    keys = F.array(F.concat(F.lit("phone "), (k % 97).cast("string"), F.lit("/"), F.col("c_nationkey").cast("string")), F.concat(F.lit("seg "), "c_mktsegment", (k % 211).cast("string")))
    return D.merge_by_keys(c, "c_custkey", keys).select("c_custkey", "entity")


@query("d9_key_collisions", "SELECT p_brand || p_size AS key, count(DISTINCT p_type) AS entities FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def d9_collisions(spark, sf):
    return D.key_collisions(table(spark, sf, "part"), "p_type", F.array(F.concat("p_brand", F.col("p_size").cast("string"))))


@query("d11_keep_first", "SELECT event_id FROM (SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1) ORDER BY event_id LIMIT 200")
def d11(spark, sf):
    return D.keep_first(table(spark, sf, "events"), F.concat_ws("|", F.col("user_id").cast("string"), "event_type"), "event_id", 200).select("event_id")


@query("d12_location_pieces", with_sql("obs") + """, l AS (SELECT posting_id, unnest(list_sort(list(DISTINCT replace(lower(location), '_', ' ')))) AS piece FROM obs GROUP BY 1)
SELECT posting_id, piece FROM l QUALIFY row_number() OVER (PARTITION BY posting_id, left(split_part(piece, ' ', 1), 1) || left(split_part(piece, ' ', 2), 1) ORDER BY piece) = 1""")
def d12(spark, sf):
    text = F.array_join(F.array_sort(F.collect_set(F.replace(F.lower("location"), F.lit("_"), F.lit(" ")))), "; ")
    rows = dealt(observations(spark, sf).select("posting_id", "location"), "posting_id").groupBy("posting_id").agg(text.alias("all"))
    return D.location_pieces(rows, "posting_id", F.col("all")).select("posting_id", "piece")


@query("u1_ordered_union", "SELECT 0 AS source_order, s_name AS name, s_acctbal AS balance FROM supplier UNION ALL SELECT 1, c_name, c_acctbal FROM customer")
def u1(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("extra"))
    return U.ordered_union([a, b]).select("source_order", "name", "balance")


@query("u2_persistent_failures", """WITH a AS (SELECT user_id, min(event_id) AS e FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-15' GROUP BY 1), b AS (SELECT user_id, max(event_id) AS e FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT 'fam' || (user_id % 3) AS family, 'timeout <n> at <url>' AS cause, list_sort(list('u' || user_id)) AS keys, left(sha256('fam' || (user_id % 3) || '|timeout <n> at <url>'), 16) AS signature FROM a JOIN b USING (user_id) GROUP BY 1""")
def u2(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'")
    cause = F.concat(F.lit("Timeout "), F.max("event_id").cast("string"), F.lit(" at https://x.example.com/"), F.max("event_id").cast("string"))
    part = lambda t: t.groupBy("user_id").agg(cause.alias("error")).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.concat(F.lit("fam"), (F.col("user_id") % 3).cast("string")).alias("family"), "error")
    return U.persistent_failures(part(e.where("ts < '2024-01-15'")), part(e.where("ts >= '2024-01-15'")))


@query("u3_set_differences", "SELECT 'missing' AS side, c_nationkey AS key FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier) GROUP BY 2 UNION ALL SELECT 'unexpected', s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer) GROUP BY 2")
def u3(spark, sf):
    return U.differences(table(spark, sf, "customer").select(F.col("c_nationkey").alias("key")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("key")), "key")


@query("u4_snapshot_choice", "WITH s AS (SELECT ts::DATE AS day, max(ts) AS t, count(*) > (SELECT avg(n) FROM (SELECT count(*) AS n FROM events GROUP BY ts::DATE)) AS rich FROM events WHERE ts <= TIMESTAMP '2024-01-29 12:00:00' GROUP BY 1) SELECT day FROM s ORDER BY (rich AND t >= TIMESTAMP '2024-01-29 12:00:00' - INTERVAL 48 HOUR) DESC, t DESC LIMIT 1")
def u4(spark, sf):
    e = table(spark, sf, "events")
    days = e.where("ts <= '2024-01-29 12:00:00'").groupBy(F.to_date("ts").alias("day")).agg(F.max("ts").alias("at"), F.count(F.lit(1)).alias("n"))
    mean = e.groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n").alias("mean"))
    snapshots = days.crossJoin(F.broadcast(mean)).select("day", "at", (F.col("n") > F.col("mean")).alias("rich"), F.lit(True).alias("valid"))
    return U.choose_snapshot(snapshots, F.to_timestamp(F.lit("2024-01-29 12:00:00")), 48).select("day")


@query("u5_changed_fields", "SELECT a.c_custkey, list_filter([CASE WHEN a.c_mktsegment IS DISTINCT FROM b.c_mktsegment THEN 'goals' END, CASE WHEN a.c_nationkey IS DISTINCT FROM b.c_nationkey THEN 'location' END], lambda x: x IS NOT NULL) AS changed FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1")
def u5(spark, sf):
    c = table(spark, sf, "customer")
    return U.changed_fields(c, c.withColumn("c_custkey", F.col("c_custkey") - 1), "c_custkey", {"goals": ["c_mktsegment"], "location": ["c_nationkey"]})


@query("c1_canonical_url", r"""WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), q AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS s, lower(regexp_extract(u, '^[A-Za-z]+://([^/?]*)', 1)) AS h, regexp_replace(regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/?]*([^?]*)', 1), '/+', '/', 'g'), '/$', '') AS p,
 list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT (split_part(lower(x), '=', 1) IN ('source', 'ref', 'referrer', 'gh_src', 'lever-source', 'src')) AND NOT starts_with(lower(x), 'utm_')) AS ks FROM p)
SELECT page_id, s || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(ks) = 0 THEN '' ELSE '?' || array_to_string(ks, '&') END AS canonical FROM q""")
def c1(spark, sf):
    return table(spark, sf, "pages").select("page_id", canonical_url(F.col("url")).alias("canonical"))


@query("c2_key_normalisers", r"SELECT doc_id, trim(regexp_replace(replace(lower(text), '&amp;', ' and '), '[^a-z0-9]+', ' ', 'g')) AS spaced FROM documents")
def c2(spark, sf):
    return table(spark, sf, "documents").select("doc_id", norm(F.col("text")).alias("spaced"))


NORMED = "trim(regexp_replace(replace(lower({}), '&amp;', ' and '), '[^a-z0-9]+', ' ', 'g'))"
FOLDED = NORMED.format(f"translate(text, '{TX.FOLD_FROM}', '{TX.FOLD_TO}')")


@query("c2_name_keys", f"""SELECT doc_id, replace({NORMED.format('text')}, ' ', '') AS compact, trim(regexp_replace(lower(text), '[^a-z0-9+#.]+', ' ', 'g')) AS skill,
 regexp_replace(regexp_replace({FOLDED}, '\\bsaint\\b', 'st', 'g'), '\\bmount\\b', 'mt', 'g') AS place, trim(regexp_replace({FOLDED}, '( ({'|'.join(TX.COMPANY_SUFFIXES)}))+$', '')) AS company FROM documents""")
def c2_names(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", TX.compact(t).alias("compact"), TX.skill_key(t).alias("skill"), TX.place_key(t).alias("place"), TX.company_key(t).alias("company"))


@query("c19_message_templates", "SELECT 'v <n>.<n>' AS template, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def c19(spark, sf):
    e = table(spark, sf, "events").where("value is not null").select(message_template(F.format_string("V %.1f", "value")).alias("template"))
    return e.groupBy("template").agg(F.count(F.lit(1)).alias("n"))
