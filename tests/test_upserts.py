"""Days that batches are replayed into, late, out of order and changed, against one rollup of what is left."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from quarrystone.operators.upserts import upsert_days

SCHEMA = "at timestamp, who int"


def rollup(rows):
    return rows.groupBy("usage_date").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("who").alias("people"))


def test_replays_reorders_and_changes(spark, tmp_path):
    rng = random.Random(5)
    make = lambda days: [(datetime(2024, 1, rng.choice(days), rng.randrange(24)), rng.randrange(9)) for _ in range(rng.randint(1, 30))]
    final = {}
    steps = [("a", make([1, 2])), ("b", make([2, 3])), ("a", None), ("c", make([1, 9])), ("b", make([3])), ("c", make([4])), ("d", []), ("a", None), ("d", make([2]) + [(None, 1)])]
    wrote = []
    for name, rows in steps:
        final[name] = final[name] if rows is None else rows
        df = spark.createDataFrame(final[name], SCHEMA).repartition(2)
        wrote.append(upsert_days(df, name, F.to_date("at"), str(tmp_path), rollup))
    days = {}
    for rows in final.values():
        for at, who in rows:
            if at:
                days.setdefault(at.date(), []).append(who)
    got = {date.fromisoformat(str(r.usage_date)): (r.n, r.people) for r in spark.read.parquet(f"{tmp_path}/daily").collect()}
    assert got == {d: (len(w), len(set(w))) for d, w in days.items()}
    assert wrote[2] == [] and wrote[7] == [] and wrote[6] == []
    assert "2024-01-02" in wrote[4] and "2024-01-03" in wrote[4]  # a day that the batch has left is rolled up as well
    assert not (tmp_path / "daily" / "usage_date=2024-01-09").exists()


def test_a_batch_that_broke_off_is_done_again(spark, tmp_path):
    rows = [(datetime(2024, 1, 1) + timedelta(days=d), d) for d in range(3)]
    broken = spark.createDataFrame(rows, SCHEMA).withColumn("usage_date", F.to_date("at")).withColumn("batch_id", F.lit("x"))
    broken.write.partitionBy("usage_date", "batch_id").parquet(f"{tmp_path}/landed")  # landed, but neither rolled up nor noted
    assert upsert_days(spark.createDataFrame(rows[:2], SCHEMA), "x", F.to_date("at"), str(tmp_path), rollup) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert sorted(str(r.usage_date) for r in spark.read.parquet(f"{tmp_path}/daily").collect()) == ["2024-01-01", "2024-01-02"]
