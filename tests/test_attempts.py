"""Keyed attempt states in a stream against plain Python and the batch operators, over restarts and late rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarrystone.streaming.attempts import PROVIDER, attempt_states, latest_states

START = datetime(2024, 1, 1)
SCHEMA = "k bigint, at timestamp, ok boolean, v string, error string"


def expected(rows, now, ttl, cooldown):
    out = {}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        good = max(((r[1], r[3]) for r in mine if r[2]), default=None)
        last = max(r[1] for r in mine)
        at_last = [r for r in mine if r[1] == last]
        failed = not any(r[2] for r in at_last)
        fresh = good and now - good[0] <= ttl
        state = "cached" if fresh else "retry_cooldown" if failed and now - last < cooldown else "queued"
        out[k] = (good[1] if good else None, good[0] if good else None, last, max(r[4] for r in at_last) if failed else None, state)
    return out


@pytest.fixture
def store(spark):
    was = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    yield
    spark.conf.set(PROVIDER[0], was)


def test_states_over_restarts_and_late_rows(spark, store, tmp_path):
    rng = random.Random(3)
    rows = []
    for k in range(40):
        for _ in range(rng.randint(1, 8)):
            ok = rng.random() < 0.5
            rows.append((k, START + timedelta(hours=rng.randrange(240)), ok, f"v{rng.randrange(99)}" if ok else None, None if ok else f"e{rng.randrange(9)}"))
    # in batches by time, with rows up to a day late in the next one
    batches = [[] for _ in range(6)]
    for r in sorted(rows, key=lambda r: r[1]):
        n = min(4, int((r[1] - START).total_seconds() // 3600 // 48))
        late = rng.random() < 0.3 and (START + timedelta(hours=48 * (n + 1)) - r[1]) < timedelta(hours=20)
        batches[min(5, n + late)].append(r)
    end = START + timedelta(days=30)
    batches.append([(-1, end, True, "last", None)])  # moves the watermark past every timer
    seen = []

    def keep(df, n):
        df.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")

    for b in batches:  # each batch is a restart of the stream
        if b:
            seen += b
            spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        q = attempt_states(stream, "k", "v", 3, 30).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    told = latest_states(spark.read.parquet(f"{tmp_path}/out").drop("batch"), "k").collect()
    want = expected(rows, end - timedelta(days=1), timedelta(days=3), timedelta(hours=30))
    got = {r.k: (r.v, r.last_success_at, r.last_attempted_at, r.last_error, r.state) for r in told if r.k >= 0}
    assert got == want
    assert {x[4] for x in want.values()} == {"queued"}
    # on the way, keys were cached and cooling
    assert {r.state for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"cached", "retry_cooldown", "queued"}
