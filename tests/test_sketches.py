"""Sketches of days merged into periods against exact figures."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarrystone.operators import sketches

SCHEMA = "at timestamp, who bigint, ms double"


def test_merged_periods_lie_within_the_stated_error(spark, tmp_path):
    rng = random.Random(7)
    rows = [(datetime(2024, 1, 1) + timedelta(days=rng.randrange(20)), rng.randrange(30000), rng.choice([None, rng.lognormvariate(3, 1)])) for _ in range(40000)]
    rows += [(None, 1, 1.0), (datetime(2024, 3, 1), None, None)]
    sketches.day_sketches(spark.createDataFrame(rows, SCHEMA), F.to_date("at"), ["who"], ["ms"]).write.parquet(f"{tmp_path}/days")
    days = spark.read.parquet(f"{tmp_path}/days")
    assert days.count() == 21
    for period, of in ((F.trunc("usage_date", "month"), lambda d: d.replace(day=1)), (F.to_date(F.lit("2024-01-01")), lambda d: datetime(2024, 1, 1))):
        for r in sketches.merged(days, period).collect():
            mine = [x for x in rows if x[0] and of(x[0]).date() == r.period]
            who, ms = {x[1] for x in mine} - {None}, sorted(x[2] for x in mine if x[2] is not None)
            assert r.n == len(mine) and abs(r.who - len(who)) <= 1 + sketches.distinct_error() * len(who)
            for q, got in ((0.5, r.ms_p50), (0.9, r.ms_p90), (0.95, r.ms_p95)):
                if not ms:
                    assert got is None
                    continue
                low, high = (sum(x < got for x in ms) / len(ms), sum(x <= got for x in ms) / len(ms))
                assert low - sketches.rank_error() <= q <= high + sketches.rank_error()
