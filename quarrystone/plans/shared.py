"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_own: dict[str, str] = {}


def folder(spark) -> str:
    """A new folder in ``spark.checkpoint.dir``; on one machine a temporary folder stands in where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-tables-")
        base = _own[app]
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` before it is grouped by them.

    Where nearly every row is a group of its own, adding up before the shuffle saves
    nothing, and holds the groups of a whole split of a file in one task's memory.
    """
    return df.repartition(*keys)


def discard(df: DataFrame) -> None:
    """Remove a stored table that no later plan reads."""
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
