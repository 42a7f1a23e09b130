"""Snapshots in buckets: plans without exchanges, replaced dates, later sessions."""

import datetime
import re

import oracle
import pytest
from pyspark.sql import functions as F

from quarrystone.operators import incremental as INC
from quarrystone.operators import joins as J
from quarrystone.plans.bucketed import PriorIds, Snapshots, snapshot_changes
from quarrystone.plans.shared import folder
from quarrystone.queries.bucketed import MONDAY, TUESDAY, two_days

D = [datetime.date(2026, 1, d) for d in (1, 2, 3)]


@pytest.fixture
def sorted_joins(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return re.findall(r"Exchange \w+\([^)]*\)", plan)


def test_two_dates_meet_without_an_exchange(spark, sorted_joins):
    days = two_days(spark, oracle.SF_DIR)
    a, b = days.at(MONDAY), days.at(TUESDAY)
    for df in (INC.carry_link_status(b, a), snapshot_changes(a, b, "id", ["url"]), b.join(a, "id", "left_anti"), a.groupBy("id").count()):
        assert df.count() and not exchanges(df)
    plan = a.where("url is not null").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "2026-01-05" in plan and "link_status" not in plan  # one partition, two columns


def test_only_the_other_side_is_moved(spark, sorted_joins):
    days = two_days(spark, oracle.SF_DIR)
    bridge = spark.range(0, 500, 2).selectExpr("id AS posting_id", "'u' || id AS canonical_url")
    evidence = bridge.selectExpr("canonical_url", "'x' AS status", "CAST(null AS timestamp) AS posted_at")
    moved = exchanges(J.attach_evidence_by_posting(days.at(MONDAY), bridge, evidence))
    # bridge and evidence to each other by URL, what comes of it to the buckets
    assert sorted(re.sub(r"#\d+L?", "", x).split(",")[0] for x in moved) == ["Exchange hashpartitioning(canonical_url", "Exchange hashpartitioning(canonical_url", "Exchange hashpartitioning(id"]

    old = spark.range(2000).selectExpr("id AS prior_id", "'a' || id % 1500 AS a", "'b' || id AS b")
    known = PriorIds.create(old, folder(spark), ["a", "b"], "prior_id")
    known.add(old, D[0])
    new = spark.createDataFrame([(1, "a7", "b9"), (2, "a1400", "b3"), (3, "none", "b1999"), (4, None, "none")], "k int, a string, b string")
    got = known.match(new, D[0])
    assert {r.k: (r.prior_id, r.rung) for r in got.collect()} == {1: (9, 2), 2: (1400, 1), 3: (1999, 2), 4: (None, None)}
    assert {(r.k, r.prior_id, r.rung) for r in J.match_prior(new, old, ["a", "b"], "prior_id").collect()} == {(r.k, r.prior_id, r.rung) for r in got.collect()}
    assert len(exchanges(got)) == 2  # the new rows, once for each key


def test_dates_are_replaced_and_found_again(spark):
    rows = lambda *ids: spark.createDataFrame([(i, f"v{i}", [i]) for i in ids], "id int, v string, xs array<int>")
    path = folder(spark)
    s = Snapshots.create(spark, path, "id", rows(1).schema, 5)
    assert s.dates() == [] and s.at(D[0]).count() == 0
    assert s.add(rows(1, 2, 3), D[0]) == 3 and s.add(rows(2, 3, 4, None), D[1]) == 4
    # other order of columns, and rows that come from another date of the store
    assert s.add(s.at(D[0]).where("id > 1").select("xs", "v", "id"), D[2]) == 2
    ids = lambda d, t=s: sorted((r.id for r in t.at(d).collect()), key=str)
    assert (ids(D[0]), ids(D[1]), ids(D[2])) == ([1, 2, 3], [2, 3, 4, None], [2, 3])
    assert s.add(rows(9), D[1]) == 1 and ids(D[1]) == [9] and ids(D[0]) == [1, 2, 3]
    assert s.add(rows(9).where("id < 0"), D[1]) == 0 and ids(D[1]) == [] and s.dates() == [D[0], D[2]]
    files = s.at(D[0]).select(F.input_file_name().alias("f")).distinct().count()
    assert files <= 3  # a file a bucket at most
    # as a later session would: the catalog knows nothing of the store
    spark.sql(f"DROP TABLE {s.name}")
    again = Snapshots.open(spark, path)
    assert (again.buckets, again.key, again.dates(), ids(D[2], again)) == (5, "id", [D[0], D[2]], [2, 3])
    assert again.at(D[0]).schema == rows(1).schema
    with pytest.raises(ValueError, match="extra"):
        again.add(rows(1).withColumn("extra", F.lit(1)), D[0])
    with pytest.raises(ValueError, match="own column"):
        Snapshots.create(spark, folder(spark), "id", rows(1).withColumn("snapshot_date", F.lit(1)).schema)


def test_changes(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", None), (None, "n", 0)], "id int, v string, w int")
    b = spark.createDataFrame([(2, "y", None), (3, "z", None), (4, "q", 1), (None, "m", 0)], "id int, v string, w int")
    assert {(r.id, r.change) for r in snapshot_changes(a, b, "id", ["v", "w"]).collect()} == {(1, "removed"), (2, "changed"), (4, "added")}
    assert {(r.id, r.change) for r in snapshot_changes(a, b, "id", ["v"]).collect()} == {(1, "removed"), (4, "added")}
    assert snapshot_changes(a.limit(0), b.limit(0), "id", ["v"]).count() == 0
