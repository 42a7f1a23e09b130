"""Helpers that the training-data operators share.

Nothing here holds data of its own: shared tables go to the folder that the
cluster names in ``spark.checkpoint.dir``; only where that is unset and Spark runs
on one machine (tests) does a temporary folder take its place.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _LOCAL[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage: a lost executor costs a reread, not a recomputation, and
    values such as ``monotonically_increasing_id`` are fixed from here on.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a materialised table that no later plan reads."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._shared_path)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names for helper columns, lengthened until none clashes with ``columns``, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lookup(key: Column, table: dict, default=None, kind: str = "bigint") -> Column:
    """``table[key]`` as a native expression; for tables of a proven small size."""
    if not table:
        return F.lit(default).cast(kind)
    out = F.when(F.lit(False), F.lit(default).cast(kind))
    for k, v in table.items():
        out = out.when(key == F.lit(k), F.lit(v).cast(kind))
    return out.otherwise(F.lit(default).cast(kind))


def text_bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; null counts 0."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(squeezed == "", F.lit(0)).otherwise(F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def number_rows(df: DataFrame, groups: list[str], order: list[str], out: str, blocks: int) -> DataFrame:
    """Gapless numbers from 0 within each group, without one task per group.

    Every group is cut into ``blocks`` hash blocks of its rows. A row's number is
    the size of the blocks before its own plus its place in its block, so the
    largest sort is a block, however large a group is. ``order`` must identify
    rows up to identical ones; the order is by block, then by ``order``.
    """
    keys = [*groups, "_block"]
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    on = [placed[k].eqNullSafe(counts[k]) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = placed.join(counts, cond, "left").select(*[placed[c] for c in df.columns], (placed["_place"] + counts["_before"]).cast("bigint").alias(out))
    return joined


def min_label_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, comp)``, comp the least node.

    Alternates large-star and small-star steps, so the rounds grow with the
    logarithm of the longest path and no task holds a component. Each round is
    written to the shared folder, after which the one before it is removed; the loop
    ends when every edge points to a node that points nowhere itself.
    """
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        ends = cur.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(cur.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        if not ends.where("out > 1 or (out = 1 and into = 1)").limit(1).count():
            break
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        tops = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(tops, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        before, cur = cur, materialize(small.union(tops.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(before)
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(cur.select("v", "v").distinct())


#: In SQL that has no CRC-32: a table ``bytes`` of the remainders of single bytes, worked out bit by bit.
CRC_TABLE = """bytes AS (SELECT list(v ORDER BY i) AS bytes FROM (SELECT i, list_reduce([i::BIGINT] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda s, b: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END) AS v FROM range(256) t(i)))"""


def crc_sql(number: str) -> str:
    """The unsigned CRC-32 of a number's decimal digits, beside the table of CRC_TABLE."""
    digits = f"list_transform(string_split({number}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {digits}, lambda s, b: xor(s >> 8, bytes[(xor(s, b) & 255) + 1])), 4294967295)"
