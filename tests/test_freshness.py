"""Freshness verdicts: of one snapshot, and of many sources at once."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarrystone.operators.incremental import freshness_verdict

NOW = datetime(2024, 3, 1, 12)
SCHEMA = "source string, status string, started_at timestamp, seen timestamp"
RUNS = [
    ("late", "success", timedelta(hours=50)), ("late", "failed", timedelta(minutes=1)),
    ("edge", "success", timedelta(hours=48)),
    ("busy", "success", timedelta(hours=60)), ("busy", "in_progress", timedelta(minutes=30)),
    ("stuck", "success", timedelta(hours=60)), ("stuck", "in_progress", timedelta(minutes=31)),
    ("never", "failed", timedelta(hours=1)), ("new", "in_progress", timedelta(minutes=5)),
    (None, "success", timedelta(hours=1)), (None, "success", timedelta(hours=1)),
]


def verdicts(spark, runs, by=None):
    rows = [(source, status, None if ago is None else NOW - ago, NOW) for source, status, ago in runs]
    df = spark.createDataFrame(rows, SCHEMA)
    generated = F.when(F.col("status") == "success", F.col("started_at"))
    return freshness_verdict(df, generated, F.col("seen"), 48, 30, by)


def test_each_source_has_its_own_verdict(spark):
    got = {r["source"]: r["verdict"] for r in verdicts(spark, RUNS, ["source"]).collect()}
    assert got == {"late": "stale", "edge": "fresh", "busy": "in_progress", "stuck": "stale", "never": "stale", "new": "in_progress", None: "fresh"}


def test_a_source_alone_is_judged_as_among_others(spark):
    together = {r["source"]: (r["age_hours"], r["verdict"]) for r in verdicts(spark, RUNS, ["source"]).collect()}
    for source in {r[0] for r in RUNS}:
        alone = verdicts(spark, [r for r in RUNS if r[0] == source]).first()
        assert (alone["age_hours"], alone["verdict"]) == together[source]


def test_without_runs_or_times(spark):
    assert verdicts(spark, [], ["source"]).collect() == []
    assert [tuple(r) for r in verdicts(spark, []).collect()] == [(None, "stale")]
    assert [r["verdict"] for r in verdicts(spark, [("a", "success", None), ("a", None, timedelta(0))], ["source"]).collect()] == ["stale"]
