"""Work and memory of steps that larger tables showed to be too dear."""

import re

from pyspark.sql import functions as F

from quarrystone.functions import identity, text
from quarrystone.operators import dedupe, joins


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_places_are_cleaned_once(spark):
    rows = [["Albany, NY, USA", "Town 5, CA", "albany, ny"], ["US - Remote", "Ohio - Remote Office", "12 MAIN NY"], ["Ohio - Remote Office", None, ""], [], None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x array<string>").select("i", text.authoritative_places(F.col("x")).alias("p"))
    assert {r.i: r.p for r in df.collect()} == {0: ["Albany, NY", "Town 5, CA"], 1: ["Remote", "Main, NY"], 2: ["Remote (OH)"], 3: [], 4: None}
    assert plan(df).count("remote office") == 1


def test_identities_read_a_url_once(spark):
    rows = [
        ("https://Jobs.example.com//x/12345678/?utm_source=a#top", "direct"), ("https://jobs.example.com/x?reqid=99999999&ref=1", "direct"), ("https://jobs.example.com/x", "direct"), ("https://jobs.example.com/x", "listing"), (None, "direct"),
        ("https://job-boards.greenhouse.io/Acme/jobs/42?gh_src=x", "listing"), ("https://acme.wd1.myworkdayjobs.com/en-US/Ext/job/Albany/Engineer_R-7/apply", None),
    ]
    df = spark.createDataFrame([(i, "Acme &amp; Co", "Engineer", "Albany", u, k) for i, (u, k) in enumerate(rows)], "i int, company string, title string, location string, url string, link_kind string")
    got = df.select("i", dedupe.reconciliation_identity(df).alias("x"))
    assert [r.x for r in got.orderBy("i").collect()] == [
        "direct-posting-url|https://jobs.example.com/x/12345678", "direct-posting-url|https://jobs.example.com/x?reqid=99999999", "direct-url|https://jobs.example.com/x|acme and co|engineer|albany", None, None,
        "greenhouse|acme|42", "workday|acme|ext|r-7",
    ]
    assert plan(got).count("#.*$") == 1


def test_observations_meet_by_distinct_urls(spark, monkeypatch):
    urls = ["https://x.com/1", "https://x.com/1/", "https://X.com/1?utm_source=a", "https://x.com/2", None, ""]
    df = spark.createDataFrame([(i, urls[i % 6], "ab"[i // 3 % 2], "t", "l") for i in range(120)], "ordinal long, url string, company string, title string, location string").repartition(3)
    kept, stored = [], dedupe.stored
    monkeypatch.setattr(dedupe, "stored", lambda x: kept.append(stored(x)) or kept[-1])
    got = {r.ordinal: r.group_id for r in dedupe.group_observations(df).collect()}
    # rows 0 and 3 open a group for each company; URLs follow their first row, rows without one their company
    assert got == {i: 0 if i % 6 < 3 else 3 for i in range(120)}
    assert [k.count() for k in kept] == [4 + 40]


def test_places_are_looked_up_once_a_value(spark):
    said = ["Apt 7, 12345", "Salem, OR", "Boise", "near Boise today", "Nowhere", None]
    zips = spark.createDataFrame([("12345", 1.0, 2.0)], "zip_code string, latitude double, longitude double")
    cities = spark.createDataFrame([("OR", "Salem", 3.0, 4.0, False), ("ID", "Boise", 5.0, 6.0, True)], "state string, city string, latitude double, longitude double, unique_name boolean")
    got = joins.resolve_places(spark.createDataFrame([(i % 60, said[i % 6]) for i in range(120)], "id int, value string"), zips, cities)
    want = {0: (1, 1.0, 2.0), 1: (2, 3.0, 4.0), 2: (3, 5.0, 6.0), 3: (4, 5.0, 6.0)}
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, said[i % 6], *want[i % 6]) for i in range(60) if i % 6 in want)
    assert re.search(r"Aggregate \[value#\d+\], \[value#\d+\]\n", plan(got))


def test_native_identity_reads_a_host_once(spark):
    df = spark.createDataFrame([(0, "https://Jobs.ashbyhq.com/Acme/0000ABCD-0000-0000-0000-000000000012/application"), (1, "https://careers-acme.icims.com/jobs/7/job"), (2, "https://careers-acme.icims.com/about"), (3, None)], "i int, url string")
    got = df.select("i", identity.posting_identity(F.col("url")).alias("x"))
    want = {0: ("ashby", ["acme", "0000abcd-0000-0000-0000-000000000012"]), 1: ("icims", ["careers-acme.icims.com", "7"]), 2: None, 3: None}
    assert {r.i: r.x and tuple(r.x) for r in got.collect()} == want
    assert plan(got).count("://(?:[^/?#@]*@)?") == 1


def test_reconciled_rows_are_slim_and_identities_compiled(spark):
    from quarrystone.catalog import QUERIES

    rows = [
        ("https://Jobs.example.com//x/12345678/?utm_source=a#top", "direct"), ("https://jobs.example.com/x/12345678", "direct"), ("https://jobs.example.com/x", "direct"), ("https://jobs.example.com/x", "listing"), (None, "direct"), ("", None), ("no url", "direct"),
        ("https://job-boards.greenhouse.io/Acme/jobs/42?gh_src=x", "listing"), ("https://u@boards.greenhouse.io:443/acme/jobs/42/", "direct"), ("https://boards.greenhouse.io/a b/jobs/42", "direct"), ("https://boards.greenhouse.io/acme", "direct"),
        ("https://acme.wd1.myworkdayjobs.com/en-US/Ext/job/Albany/Engineer_R-7/apply", None), ("https://x.fa.us2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX/job/A1", "source"),
    ]
    df = spark.createDataFrame([(i, "Acme &amp; Co", "Engineer", "Albany", u, k, i // 2, [f"s{i % 3}"]) for i, (u, k) in enumerate(rows)], "id int, company string, title string, location string, url string, link_kind string, posted_at int, source_keys array<string>")
    both = dedupe.identified(df).withColumn("want", dedupe.reconciliation_identity(df))
    assert both.where("NOT identity <=> want").count() == 0 and both.where("identity IS NOT NULL").count() == 10
    assert plan(dedupe.identified(df)).count("RLIKE(_host#") == len(identity.RULES)
    cols = ["id", "posted_at", "source_keys", "merged"]
    slim = dedupe.reconcile(dedupe.identified(df), F.col("identity"), keep=cols[:3]).select(cols)
    assert sorted(map(tuple, slim.collect())) == sorted(map(tuple, dedupe.reconcile(df, dedupe.reconciliation_identity(df)).select(cols).collect()))
    for got in (slim, QUERIES["d3_native_reconciliation"](spark, "/root/testdata/sf0.001")):
        assert not re.search(r"title|url#", re.search(r"Aggregate [^\n]*", plan(got)).group())


def test_previous_postings_are_read_once(spark):
    from quarrystone.catalog import QUERIES

    rows = [(1, "ok", ["b", "a", "z"], "x"), (1, "ok", ["b"], "y"), (2, "dead", ["a"], "x"), (3, None, ["c", "b"], "x"), (4, "ok", ["z"], "x"), (5, "ok", ["a"], "x"), (None, "ok", ["a"], "x"), (6, "ok", [], "x"), (7, "ok", None, "x"), (8, "ok", ["a", "a"], None)]
    previous = spark.createDataFrame(rows, "id long, link_status string, source_keys array<string>, url string")
    current, failed = spark.createDataFrame([(5,), (9,), (None,)], "id long"), spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "key string")
    got = joins.carry_forward(current, previous, failed)
    assert got.columns == [*previous.columns, "carried_from", "carried_forward"]
    assert sorted((r.id, r.link_status, r.source_keys, r.url, r.carried_from) for r in got.where("id <> 3 AND id <> 8").collect()) == [(1, "ok", ["b"], "y", "b"), (1, "ok", ["b", "a", "z"], "x", "a")]
    assert [(r.id, r.link_status, r.url, r.carried_from, r.carried_forward) for r in got.where("id = 3 OR id = 8").orderBy("id").collect()] == [(3, None, "x", "b", True), (8, "ok", None, "a", True)]
    j3 = plan(QUERIES["j3_carry_forward"](spark, "/root/testdata/sf0.001"))
    assert j3.count("Relation [l_orderkey") == 2 and j3.count("RepartitionByExpression [o_orderkey") == 2


def test_reconciled_observations_are_dealt_by_order(spark):
    from quarrystone.catalog import QUERIES

    assert plan(QUERIES["d3_native_reconciliation"](spark, "/root/testdata/sf0.001")).count("RepartitionByExpression [o_orderkey") == 1
