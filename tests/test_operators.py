"""Operators against plain loops, on files, and on awkward rows."""

import json
import random
import re
from datetime import datetime, timezone

import oracle
import pytest
from pyspark.sql import functions as F

from quarrystone.catalog import QUERIES
from quarrystone.functions import classify, facts, identity, pay, scoring, text
from quarrystone.operators import coverage, dedupe, incremental, joins, predicates, windows
from quarrystone.plans.components import components
from quarrystone.sources import snapshots


def values(spark, column, items, schema="x string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, {schema}")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_observation_groups_equal_the_loop(spark):
    rng = random.Random(1)
    for _ in range(4):
        rows = [(i, rng.choice([None, *[f"https://x.com/{j}" for j in range(6)]]), rng.choice("abcd"), "t", "l") for i in range(60)]
        by_url, by_sig, want = {}, {}, {}
        for i, u, c, *_ in rows:
            g = by_url.get(u) if u else None
            g = by_sig.get(c) if g is None else g
            if g is None:
                g = by_sig[c] = i
            if u:
                by_url.setdefault(u, g)
                by_url[u] = g
            want[i] = g
        df = spark.createDataFrame(rows, "ordinal long, url string, company string, title string, location string").repartition(3)
        assert {r.ordinal: r.group_id for r in dedupe.group_observations(df).collect()} == want


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 160)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1] or x in got}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_stable_ids_are_unique_and_kept(spark):
    rows = [(1, "p1", "b1"), (2, "p1", "b1"), (3, None, "b1"), (4, None, "b2"), (5, None, "b1")]
    got = {r.o: r.stable_id for r in dedupe.stable_ids(spark.createDataFrame(rows, "o int, prior string, basis string"), F.col("prior"), F.col("basis"), "o").collect()}
    assert got[1] == "p1" and len(set(got.values())) == 5


def test_canonical_urls(spark):
    got = values(spark, text.canonical_url(F.col("x")), ["HTTPS://A.com//b///c/?utm_source=1&q=2&ref=x#top", "http://a.com", None, "nonsense", "http://a.com/?REF=1", "https://a.com/x?b&c="])
    assert got == ["https://a.com/b/c?q=2", "http://a.com/", "", "nonsense", "http://a.com/", "https://a.com/x?b&c="]


def test_posted_dates(spark):
    ref = F.to_timestamp(F.lit("2026-01-10 15:30:00"))
    day = lambda m, d, y=2026, h=0, mi=0: datetime(y, m, d, h, mi)
    got = values(spark, text.parse_posted(F.col("x"), ref), ["12h", "3 days", "2w", "1mo", "today", "2025-12-01", "12/31/2025", "Dec 25", "January 5, 2026", "unknown", None, "45 min"])
    assert got == [day(1, 10, h=3, mi=30), day(1, 7), day(12, 27, 2025), day(12, 11, 2025), day(1, 10, h=15, mi=30), day(12, 1, 2025), day(12, 31, 2025), day(12, 25, 2025), day(1, 5), None, None, day(1, 10, h=14, mi=45)]
    assert values(spark, text.parse_posted(F.col("x"), ref, strict_reference=True), ["12h", "3h"]) == [None, day(1, 10, h=12, mi=30)]


def test_states(spark):
    got = values(spark, text.states(F.col("x")), ["Remote in USA", "New York, NY", "West Virginia", "Arkansas or Kansas", "Washington, DC", "Portland (OR)", None])
    assert got == [["Remote", "US"], ["NY"], ["WV"], ["AR", "KS"], ["DC"], ["OR"], []]
    assert values(spark, text.states(F.col("x"), True), ["work in Ohio"]) == [["IN", "OH"]]


def test_keys(spark):
    assert values(spark, text.company_key(F.col("x")), ["The Acmé Co., Inc.", "Group Nine LLC", None]) == ["the acme", "group nine", ""]
    assert values(spark, text.identity_keys(F.col("x")), ["The Acme Corp"]) == [["the acme corp", "acme corp", "the acme", "acme"]]
    assert values(spark, text.skill_key(F.col("x")), ["C++ / .NET"]) == ["c++ .net"]


def test_pay(spark):
    df = spark.createDataFrame([("$20.50 - $30/hr",), ("CA$60k to 50k per year",), ("stipend of £1,200",), ("$900 hourly",), ("no pay",), (None,)], "t string")
    got = [tuple(r.salary)[:4] if r.salary else None for r in pay.extract_pay(df, "t").collect()]
    assert got == [(20.5, 30.0, "hour", "USD"), (50000.0, 60000.0, "year", "CAD"), (1200.0, 1200.0, "stipend", "GBP"), None, None, None]


def test_identity(spark):
    urls = ["https://acme.wd5.myworkdayjobs.com/en-US/Ext/job/Town/Intern_R-123?x=1", "https://boards.greenhouse.io/Acme/jobs/42", "https://jobs.ashbyhq.com/acme/0a0b0c0d-1111-2222-3333-444455556666/application", "https://c.icims.com/jobs/77/x/job", "https://other.com/a", None]
    got = values(spark, identity.identity_key(F.col("x")), urls)
    assert got == ["workday|acme|ext|r-123", "greenhouse|acme|42", "ashby|acme|0a0b0c0d-1111-2222-3333-444455556666", "icims|c.icims.com|77", "url|https://other.com/a", None]


def test_classes(spark):
    assert values(spark, classify.education(F.col("x")), ["PhD Intern", "Sophomore Intern", "Analyst", "Intern (M.S.)"]) == ["graduate-only", "undergrad", "unspecified", "graduate-only"]
    assert values(spark, classify.opportunity_type(F.col("x")), ["Software Co-op", "Internal audit intern", "Fellow", "Manager", None]) == ["co-op", "internship", "fellowship", "other", "other"]
    w = values(spark, classify.term_window(F.col("x")), ["Summer 2027", "nothing"])
    assert str(w[0].start) == "2027-05-01" and str(w[0].end) == "2027-08-31" and w[1] is None


def test_requirement_facts(spark):
    html = "<h2>Requirements:</h2><ul><li>Experience with Python and SQL. Master's degree not required.</li></ul><h2>Nice to have</h2><p>At least 2 courses using C++</p><h2>Benefits</h2><p>Free lunch</p>"
    lines = spark.createDataFrame([(1, html)], "d int, h string").select("d", F.posexplode(facts.html_lines(F.col("h"))).alias("pos", "line"))
    got = {(r.field, r.level, tuple(r.technologies), r.negated) for r in facts.extract_facts(lines, "d", "pos", "line").collect()}
    assert got == {("skills", "required", ("Python", "SQL"), False), ("education", "not_required", (), True), ("skills", "preferred", ("C++",), False)}


def test_freshness_anchors(spark):
    got = values(spark, scoring.freshness(F.col("x")), [0.0, 2.0, 4.5, 7.0, 30.0, 45.0, 90.0, 400.0, None], "x double")
    assert got == [10, 10, 9, 8, 3, 2, 0, 0, 3]
    with pytest.raises(ValueError):
        scoring.compose(spark.range(1), {"fit": ("ranking", 50)})


def test_radius_join_equals_all_pairs(spark):
    rng = random.Random(7)
    points = [(i, rng.uniform(-85, 85), rng.uniform(-180, 180)) for i in range(300)] + [(900, 10.0, 179.9), (901, 89.5, 0.0)]
    bases = [(f"b{i}", rng.uniform(-85, 85), rng.uniform(-180, 180)) for i in range(40)] + [("line", 10.0, -179.9), ("pole", 89.0, 170.0)]
    p, b = spark.createDataFrame(points, "id long, latitude double, longitude double"), spark.createDataFrame(bases, "base string, latitude double, longitude double")
    got = {(r.id, r.base) for r in joins.radius_join(p, b, 400.0).collect()}
    every = p.crossJoin(b.withColumnsRenamed({"latitude": "y", "longitude": "x"}))
    want = {(r.id, r.base) for r in every.where(joins.miles(F.col("latitude"), F.col("longitude"), F.col("y"), F.col("x")) <= 400).collect()}
    assert got == want and (900, "line") in got and (901, "pole") in got


def test_containment_match_equals_all_pairs(spark):
    rng = random.Random(31)
    place = lambda: rng.choice(["", None, "Ab", "Saint Abel", "St. Abel", "abel, NY", *("".join(rng.choice("abn ") for _ in range(rng.randint(1, 6))) for _ in range(4))])
    key = lambda: rng.choice([1, 2, 3, 4, 5, 6, None])
    a, b = [(i % 70, key(), place()) for i in range(90)], [(rng.choice([None, i % 9]), key(), place()) for i in range(24)]
    left, right = spark.createDataFrame(a, "id long, k long, a string"), spark.createDataFrame(b, "v long, k long, b string")
    x, y = joins.place_key(F.col("a")), joins.place_key(F.col("b"))
    both = left.join(right, "k").where((x == y) | F.contains(x, y) | F.contains(y, x))
    want = {(r.id, r.v) for r in both.groupBy("id").agg(F.min("v").alias("v"), F.countDistinct("v").alias("n")).where("n = 1").collect()}
    got = joins.containment_match(left, right, ["k"], "a", "b", "v", "id")
    assert {(r.id, r.v) for r in got.collect()} == want and len(want) > 10
    plan = got._jdf.queryExecution().executedPlan().toString()
    # no row is compared with every row of its key: all joins of the two sides have the place among their keys
    assert "contains" not in plan.lower()


def test_similarity_join_is_salted_without_loss(spark):
    rng = random.Random(9)
    words = ["data", "software", "intern", "engineer", "summer", "analyst"]
    title = lambda: " ".join(rng.sample(words, 3))
    s = spark.createDataFrame([(i, "e", title(), "Albany, NY") for i in range(20)], "d long, emp string, title string, location string")
    p = spark.createDataFrame([(i, "e", title(), rng.choice(["Albany", "Albany NY", "Boston"])) for i in range(60)], "id long, emp string, title string, location string")
    get = lambda hot: sorted((r.d, r.id, round(r.score, 9)) for r in coverage.similarity_join(s, p, "emp", "d", "id", 5, hot).collect())
    assert get(10) == get(10_000) and get(10)


@pytest.mark.parametrize("name", ["w2_inspection_queue", "w2_term_queue", "w12_order_locations", "d12_location_pieces"])
def test_rows_are_dealt_out_before_they_are_grouped(spark, name):
    plan = QUERIES[name](spark, oracle.SF_DIR)._jdf.queryExecution().executedPlan().toString()
    # from the top down, the scans come after the last exchange; nothing is added up below it
    below = plan[plan.rindex("REPARTITION_BY_COL") :]
    assert "Aggregate(" not in below and "Window" not in below


def test_first_tier_is_found_without_its_rows(spark):
    rng = random.Random(5)
    tiers = [[(rng.choice([None, *range(12)]), rng.choice([None, 1, 2, 3])) for _ in range(n)] for n in (8, 20)]
    left = spark.createDataFrame([(i,) for i in [*range(14), None]], "k int")
    got = joins.best_tier(left, "k", [spark.createDataFrame(t, "k int, v int") for t in tiers], "v")
    want = {}
    for k in [*range(14), None]:
        i, held = next(((i, [v for x, v in t if x == k]) for i, t in enumerate(tiers, 1) if k is not None and any(x == k for x, _ in t)), (None, []))
        values = {v for v in held if v is not None}
        want[k] = (i, *values) if len(values) == 1 else (None, None)
    assert {r.k: (r.tier, r.v) for r in got.collect()} == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_quarantine_orders_only_keys_and_verdicts(spark):
    plan = QUERIES["p8_quarantine"](spark, oracle.SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    ordered = re.search(r"Window \[.*\n.*Project \[(.*)\]", plan)[1]
    assert "_h0" in ordered and " AS url#" not in ordered


def test_plausible_domains_are_dealt_out(spark):
    names = [(i % 30, n) for i, n in enumerate(["Acme Tools", "acme-tools", "Acm", "Beta Works", "Be", "Works", "", None, "acme", "Example 1"] * 9)] + [(None, "Acme"), (None, "Acme")]
    hosts = ["acme.com", "www.acmetools.com", "acmetoolsplus.org", "acm.edu", "betaworks.io", "example.com", "a.example.com", "acme.com", None]
    n, d = spark.createDataFrame(names, "employer_id long, name string"), spark.createDataFrame([(h,) for h in hosts], "domain string")
    want = set()
    for e, name in names:
        w, c = re.split("[^a-z0-9]+", (name or "").lower())[0], re.sub("[^a-z0-9]+", "", (name or "").lower())
        for h in filter(None, hosts):
            label = h.split(".")[-2]
            if len(w[:4]) >= 3 and w[:4] == label[:4] and (label.startswith(w) or label in c):
                want.add((e, h))
    got = joins.plausible_domains(n, d)
    rows = [(r.employer_id, r.domain) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) > 10
    # the pairs themselves are neither gathered nor compared
    assert "employer_id" in got._jdf.queryExecution().optimizedPlan().toString() and not re.search(r"Aggregate \[employer_id#\d+L?, domain#", got._jdf.queryExecution().optimizedPlan().toString())


def test_similarity_links_count_every_pair_of_the_join(spark):
    rng = random.Random(12)
    words = ["data", "software", "intern", "engineer", "summer", "analyst"]
    title = lambda: rng.choice([None, "", " ".join(rng.sample(words, 3))])
    rows = lambda n: [(i, rng.choice(["e", "f", None]), title(), rng.choice(["Albany", "Albany, NY", "Boston", None])) for i in range(n)] * 1
    s = spark.createDataFrame(rows(60) + [(100 + i, "e", "Data Intern", "Albany") for i in range(40)], "d long, emp string, title string, location string")
    p = spark.createDataFrame(rows(80) + [(100 + i, "e", "data intern", "Albany") for i in range(50)], "id long, emp string, title string, location string")
    pairs = coverage.similarity_join(s, p, "emp", "d", "id").collect()
    want = {}
    for r in pairs:
        n, best = want.get(r.d, (0, (9.0, 0)))
        want[r.d] = (n + 1, min(best, (-r.score, r.id)))
    got = coverage.similarity_links(s, p, "emp", "d", "id").collect()
    assert len(got) == 100 and {r.d: (r.links, (-r.score, r.id)) for r in got if r.links} == want
    assert {(r.class_id, r.links) for r in got if r.d >= 100} == {(100, want[100][0])} and want[100][0] >= 50
    assert {(r.d, -r.score, r.id) for r in coverage.best_similar(s, p, "emp", "d", "id").collect()} == {(d, *b) for d, (_, b) in want.items()}


def test_coverage_tiers_give_one_match_a_row(spark):
    s = spark.createDataFrame([(i, "Acme", "Data Intern", "Albany", "https://x.example.com/1") for i in range(5)], "k long, company string, title string, location string, url string")
    p = s.withColumnRenamed("k", "posting_id").unionByName(s.withColumnRenamed("k", "posting_id").withColumn("posting_id", F.col("posting_id") + 7))
    tiers = dict(coverage.coverage_tiers(s, p, "k"))
    assert {name: sorted((r.k, r.posting_id) for r in tiers[name].collect()) for name in ("url", "signature", "fuzzy")} == {name: [(i, 0) for i in range(5)] for name in ("url", "signature", "fuzzy")}


def test_last_good_keeps_values_through_failures(spark):
    t = datetime(2026, 1, 1, tzinfo=timezone.utc)
    cache = spark.createDataFrame([("a", 1, t, t, None), ("b", 2, t, t, None)], "k string, v int, last_attempted_at timestamp, last_success_at timestamp, last_error string")
    tries = spark.createDataFrame([("a", t, False, "boom", None), ("c", t, True, None, 5)], "k string, at timestamp, ok boolean, error string, v int")
    got = {r.k: (r.v, r.last_error) for r in incremental.last_good(cache, tries, "k", ["v"]).collect()}
    assert got == {"a": (1, "boom"), "b": (2, None), "c": (5, None)}


def test_fingerprint_ignores_order_and_volatile_columns(spark, tmp_path):
    df = spark.range(50).select("id", F.lit("x").alias("seen"))
    path = str(tmp_path / "t")
    assert incremental.write_if_changed(df, path, ["seen"]) and not incremental.write_if_changed(df.orderBy(F.desc("id")).withColumn("seen", F.lit("y")), path, ["seen"])
    assert incremental.write_if_changed(df.where("id > 0"), path, ["seen"])


def test_quarantine_splits_every_row(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 3, None), (3, 4, "dead")], "id int, o int, x string")
    parts = predicates.split_by_rules(df, "id", "o", {"missing": F.col("x").isNull()}, {"dead": F.col("x") == "dead"})
    assert {n: [(r.o, r.reasons) for r in p.collect()] for n, p in parts.items()} == {"valid": [(1, [])], "quarantined": [(2, ["duplicate id"]), (3, ["missing"])], "downgraded": [(4, ["dead"])]}


def test_bound_pruning_loses_no_top_row(spark):
    rng = random.Random(3)
    rows = [("p", i, lo, lo + rng.randint(0, 5), rng.randint(0, 10)) for i in range(200) for lo in [rng.randint(0, 60)]]
    df = spark.createDataFrame(rows, "profile_id string, posting_id long, score_min int, score_max int, gain int")
    kept = {r.posting_id for r in windows.prune_by_bound(df, "gain", 10).collect()}
    cutoff = sorted((r[2] for r in rows), reverse=True)[9]
    assert kept == {r[1] for r in rows if r[3] + r[4] >= cutoff}


def test_snapshot_and_sample_readers(spark, tmp_path):
    doc = {"generated_at": "2026-01-01T00:00:00Z", "jobs": [{"id": "1", "company": "A", "source_keys": ["s"]}, {"id": "2"}], "sources": {"s": {"status": "healthy", "count": 2}}}
    (tmp_path / "s.json").write_text(json.dumps(doc, indent=1))
    postings, health = snapshots.load_snapshot(spark, str(tmp_path / "s.json"))
    assert [(r.ordinal, r.id, r.source_keys) for r in postings.orderBy("ordinal").collect()] == [(0, "1", ["s"]), (1, "2", None)] and health.first().status == "healthy"
    (tmp_path / "d.json").write_text(json.dumps({"listings": [{"employer": "A", "role": " ", "title": "T"}]}))
    (tmp_path / "d.csv").write_text("company,position,link\nB,Dev,http://x\n")
    (tmp_path / "d.jsonl").write_text('{"company": "C", "title": "X"}\n{"company": "D", "title": "Y"}\n')
    assert snapshots.load_sample(spark, str(tmp_path / "d.json"), "json").first()[:2] == ("A", "T")
    assert snapshots.load_sample(spark, str(tmp_path / "d.csv"), "csv").first()[:4] == ("B", "Dev", None, "http://x")
    assert snapshots.load_sample(spark, str(tmp_path / "d.jsonl"), "jsonl").count() == 2
    (tmp_path / "z.csv").write_text("zip_code,city,state,latitude,longitude,population\n501,Holtsville,NY,40.8,-73.0,0\n1,Nowhere,NY,,,\n")
    assert [r.zip_code for r in snapshots.load_zips(spark, str(tmp_path / "z.csv")).collect()] == ["00501"]


def test_plans_push_filters_and_prune_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = df.where("o_orderkey > 10").groupBy("o_custkey").agg(F.count(F.lit(1)))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,10)]" in plan and "o_totalprice" not in plan.split("ReadSchema")[-1]
