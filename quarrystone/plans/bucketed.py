"""Snapshots kept in buckets of a key, so that joins by the key do not move their rows."""

from __future__ import annotations

import datetime
import hashlib

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.operators.joins import ladder_join, unique_lookup

#: The column that tells a row's snapshot.
DATE = "snapshot_date"


class Snapshots:
    """Rows of many dates under ``path``: a partition for each date, in it a file for each bucket of ``key``, sorted by it.

    Two dates join and group by ``key`` without an exchange. A side that has no buckets
    is moved to the buckets of the other, as long as there are at least
    ``spark.sql.shuffle.partitions`` of them; with fewer, Spark moves both. A bucket is
    one task's work, so there should be one for every few hundred megabytes of a
    snapshot. The layout lies beside the rows: ``open`` finds it in any later session.
    Rows with a null key are kept, all in one bucket, and meet nothing.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, buckets: int):
        if DATE in schema.names:
            raise ValueError(f"{DATE} is the snapshots' own column")
        if key not in schema.names:
            raise ValueError(f"no column {key}")
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets
        self.name = "snapshots_" + hashlib.sha256(self.path.encode()).hexdigest()[:24]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, {DATE} DATE) USING parquet OPTIONS (partitionOverwriteMode 'dynamic') "
            f"PARTITIONED BY ({DATE}) CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{self.path}/rows'"
        )

    @classmethod
    def create(cls, spark: SparkSession, path: str, key: str, schema: T.StructType, buckets: int | None = None) -> Snapshots:
        """A new store; as many buckets as shuffles have partitions unless told otherwise."""
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.createDataFrame([(key, buckets, schema.json())], "key string, buckets int, columns string").coalesce(1).write.json(path.rstrip("/") + "/layout")
        return cls(spark, path, key, schema, buckets)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Snapshots:
        """The store at ``path`` with all dates that any session has added."""
        said = spark.read.schema("key string, buckets int, columns string").json(path.rstrip("/") + "/layout").first()
        out = cls(spark, path, said.key, T._parse_datatype_json_string(said.columns), said.buckets)
        spark.catalog.recoverPartitions(out.name)
        return out

    def add(self, rows: DataFrame, date: datetime.date) -> int:
        """Make ``rows`` the snapshot of ``date``, in place of what was there; says how many rows it has.

        ``rows`` may come from other dates of the store. Columns go by name; one too many
        or too few is an error.
        """
        if set(rows.columns) != set(self.schema.names):
            raise ValueError(f"columns {sorted(set(rows.columns) ^ set(self.schema.names))} are on one side only")
        seen = Observation()
        typed = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema])
        dated = typed.repartition(self.buckets, F.col(f"`{self.key}`")).withColumn(DATE, F.lit(date)).observe(seen, F.count(F.lit(1)).alias("n"))
        dated.write.insertInto(self.name, overwrite=True)
        n = seen.get["n"]
        if not n:  # no rows, so no partition was replaced
            self._remove(date)
        return n

    def _remove(self, date: datetime.date) -> None:
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({DATE} = DATE'{date}')")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/{DATE}={date}")
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        self.spark.catalog.refreshTable(self.name)

    def at(self, date: datetime.date) -> DataFrame:
        """The snapshot of ``date``; empty if there is none."""
        return self.spark.table(self.name).where(F.col(DATE) == F.lit(date)).drop(DATE)

    def dates(self) -> list[datetime.date]:
        """The dates that have rows, in order."""
        said = self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()
        return sorted(datetime.date.fromisoformat(r[0].split("=", 1)[1]) for r in said)


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """``(key, change)`` of every row that is ``added``, ``removed`` or ``changed`` in one of ``compared`` between two snapshots.

    Keys are unique within a snapshot and not null. Two dates of one store need no exchange.
    """
    tell = lambda df, own: df.where(F.col(key).isNotNull()).select(key, F.struct(*compared).alias(own))
    both = tell(before, "_was").join(tell(after, "_is"), key, "full_outer")
    change: Column = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(~F.col("_was").eqNullSafe(F.col("_is")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


class PriorIds:
    """For each tier of keys, which of them tell one posting of a snapshot: stores in buckets of the key.

    Made once for each snapshot, so that matching the next one moves the new rows alone.
    """

    def __init__(self, stores: dict[str, Snapshots], value: str):
        self.stores, self.value = stores, value

    @classmethod
    def create(cls, previous: DataFrame, path: str, tiers: list[str], value: str, buckets: int | None = None) -> PriorIds:
        types = {f.name: f for f in previous.schema}
        stores = {t: Snapshots.create(previous.sparkSession, f"{path.rstrip('/')}/{i}", t, T.StructType([types[t], types[value]]), buckets) for i, t in enumerate(tiers)}
        return cls(stores, value)

    def add(self, previous: DataFrame, date: datetime.date) -> None:
        for tier, store in self.stores.items():
            store.add(unique_lookup(previous, [tier], self.value), date)

    def match(self, postings: DataFrame, date: datetime.date) -> DataFrame:
        """``postings`` with the prior id and the number of the first tier that knows it."""
        return ladder_join(postings, [([tier], store.at(date)) for tier, store in self.stores.items()], self.value)
