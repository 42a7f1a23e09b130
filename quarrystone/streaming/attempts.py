"""Attempts at keys as a stream with keyed state: last good values, times to live and cooldowns that end by event time.

Each key's state is its last success, its last attempt and its last error. Timers in event
time say when a success grows old and when a cooldown after a failure ends, so a key's state
changes although nothing arrives for it, and work per batch grows with the batch and the
timers that are due, not with all keys. Attempts may arrive in any order within the watermark;
the state is that of all attempts seen, by their own times.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Streams with timers keep their state in this store; a session names it before such a stream starts.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_EPOCH = pd.Timestamp(0)


def _millis(at) -> int:
    return int((pd.Timestamp(at) - _EPOCH) // pd.Timedelta(milliseconds=1))


class KeyedAttempts(StatefulProcessor):
    """One key's attempts: what its state is after each batch and whenever one of its timers is due."""

    def __init__(self, key: str, value: str, ttl_ms: int, cooldown_ms: int):
        self.key, self.value, self.ttl, self.cooldown = key, value, ttl_ms, cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "success_at bigint, value string, attempt_at bigint, failed boolean, error string")

    def told(self, key, at: int) -> pd.DataFrame:
        """The key's row as of ``at``, in milliseconds."""
        success, value, attempt, failed, error = self.state.get()
        fresh = success is not None and at - success <= self.ttl
        cooling = failed and at - attempt < self.cooldown
        return pd.DataFrame({
            self.key: [key[0]], self.value: [value], "last_success_at": [None if success is None else pd.Timestamp(success, unit="ms")], "last_attempted_at": [pd.Timestamp(attempt, unit="ms")],
            "last_error": [error if failed else None], "state": ["cached" if fresh else "retry_cooldown" if cooling else "queued"], "as_of": [pd.Timestamp(at, unit="ms")],
        })

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        success, value, attempt, failed, error = self.state.get() if self.state.exists() else (None, None, None, False, None)
        for batch in rows:
            for at, ok, new, why in zip(batch["at"], batch["ok"], batch[self.value], batch["error"], strict=True):
                ms = _millis(at)
                good = bool(ok)
                # of attempts at one time a success comes last, and of those the greatest value
                if good and (success is None or (ms, str(new)) > (success, str(value))):
                    success, value = ms, None if new is None or new is pd.NA else str(new)
                if attempt is None or ms > attempt or ms == attempt and failed and good:
                    attempt, failed, error = ms, not good, None if good else why
                elif ms == attempt and failed and not good:
                    error = max(error or "", why or "") or None
        self.state.update((success, value, attempt, failed, error))
        now = max(timerValues.getCurrentWatermarkInMs(), attempt, success or 0)
        for due in ([success + self.ttl + 1] if success is not None else []) + ([attempt + self.cooldown] if failed else []):
            if due > now:
                self.handle.registerTimer(due)
        yield self.told(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            yield self.told(key, max(expiredTimerInfo.getExpiryTimeInMs(), self.state.get()[2]))


def attempt_states(attempts: DataFrame, key: str, value: str, ttl_days: float, cooldown_hours: float, delay: str = "1 day") -> DataFrame:
    """A stream of a key's states: ``cached`` within the time to live of its last success, ``retry_cooldown`` after a failure, else ``queued``.

    attempts: ``key``, at (timestamp), ok, ``value`` (string, of a success), error. A row is given
    for a key whose attempts arrive and again when a state ends; the latest by ``as_of`` counts.
    Attempts later than the watermark are dropped, and null keys are one key.
    """
    kept = attempts.select(key, F.col("at").cast("timestamp_ntz").alias("at"), "ok", F.col(value).cast("string").alias(value), "error")
    out = f"{key} {dict(attempts.dtypes)[key]}, {value} string, last_success_at timestamp_ntz, last_attempted_at timestamp_ntz, last_error string, state string, as_of timestamp_ntz"
    kept = kept.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay)
    return kept.groupBy(key).transformWithStateInPandas(KeyedAttempts(key, value, int(ttl_days * 86_400_000), int(cooldown_hours * 3_600_000)), outputStructType=out, outputMode="Update", timeMode="EventTime")


def latest_states(states: DataFrame, key: str) -> DataFrame:
    """The last told state of each key."""
    w = Window.partitionBy(key).orderBy(F.desc("as_of"), F.desc("_batch"))
    return states.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_batch", "as_of")
