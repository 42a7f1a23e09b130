"""Conversation prefix trie by van Emde Boas recursion.

A node of depth d is a distinct sequence of a conversation's first d turns. All
sequences are cut at half the greatest depth: prefixes above the cut make the upper
trie, and the rests below each cut prefix make a lower forest. Upper trie and forests
are cut at half their own depth in the same job, and so on, so a trie of depth D takes
log2(D) rounds, however deep one conversation is:

1. ``blocks`` names the aligned blocks of 2, 4, 8, ... turns, each from its two halves.
2. ``prefixes`` goes down: in a block that begins under the prefix P, the upper half
   begins under P as well, and the lower half under the name of (P, upper half).
3. ``graft`` goes up: once all blocks of 2^k turns have their totals, the total of each
   root of a lower half is added to the nodes above it in the upper half.

A name is 128 bits of a SHA-256 over the two names that it is made of. Each round holds
a row per turn at most, each conversation's rows are apart, and counts and sums are
combined before they are shuffled, so neither a long conversation nor a node that many
share meets in one task. Turns are numbered by a range partitioning with offsets, not in
one window per conversation. The one thing that is made in order is a node's digest of
conversation ids: ids are joined to strings for each 4096 neighbouring ids, and these run
through one task per node as a stream, of which only the digest's state is held.

Defined results: turns are ordered by turn (null first), then role, then text; null roles
and texts are empty; repeated rows are turns of their own; rows without a conversation
are left out; ``c - c % 100`` takes the remainder's sign from c, as SQL does; turnless
conversations are members of the root alone; texts of any length are read whole; an empty
table has no nodes, not even a root; other columns are left out.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import CRC_TABLE, crc_sql, discard, materialize, read_table


def _named(*parts: Column) -> Column:
    """128 bits that stand for the parts in this order; each part is of a fixed length, but for the last."""
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, at, role, text)``: a conversation's turns from 0, in order.

    Rows are dealt by ranges of the whole order, so a conversation may lie in many
    partitions; its turns before a partition are summed from counts.
    """
    clean = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    dealt = clean.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
    dealt = materialize(dealt.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "turns")
    counts = dealt.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("conv_id", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return dealt.join(counts, ["conv_id", "_part"]).select("conv_id", (F.col("_row") + F.col("_shift")).alias("at"), "role", "text")


def blocks(tokens: DataFrame, most: int) -> list[DataFrame]:
    """Names of the aligned blocks of 2^k turns, for each k: ``(conv_id, block, name)``, whole blocks only."""
    out = [tokens.select("conv_id", F.col("at").alias("block"), "name")]
    while 2 << len(out) - 1 <= most:
        half = F.col("block") % 2
        pair = out[-1].groupBy("conv_id", F.expr("block div 2").alias("block")).agg(F.max(F.when(half == 0, F.col("name"))).alias("a"), F.max(F.when(half == 1, F.col("name"))).alias("b"))
        out.append(materialize(pair.where("b is not null").select("conv_id", "block", _named(F.col("a"), F.col("b")).alias("name")), "blocks"))
    return out


def prefixes(ids: DataFrame, named: list[DataFrame]) -> DataFrame:
    """``(conv_id, depth, name)`` of every prefix of every sequence, the empty one too."""
    out = ids.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(bytes(16)).alias("name"))
    for k in range(len(named) - 1, -1, -1):
        size = 1 << k
        upper = named[k].where("block % 2 = 0").select("conv_id", (F.col("block") * size).alias("depth"), F.col("name").alias("half"))
        lower = out.join(upper, ["conv_id", "depth"]).select("conv_id", (F.col("depth") + size).alias("depth"), _named(F.col("name"), F.col("half")).alias("name"))
        before, out = out, materialize(out.union(lower), "prefixes")
        if k < len(named) - 1:
            discard(before)
    return out


def _grafted(own: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """``(node, depth, values)`` with each column of ``own(node, conv_id, depth, values...)`` summed over the node's subtree.

    ``conv_id`` is a member that no other node of the depth has; ``paths(conv_id, depth, node)`` are members' nodes.
    """
    values = [c for c in own.columns if c not in ("node", "conv_id", "depth")]
    now = own
    place = F.col("depth") - 1  # the root stands above all blocks
    for k in range(levels):
        size = 1 << k
        half = lambda c: F.floor(c / size).cast("bigint")
        roots = now.where((place >= 0) & (half(place) % 2 == 1) & (place % size == 0)).select("conv_id", (half(place) - 1).alias("half"), *[F.col(v).alias(f"_{v}") for v in values])
        above = paths.where((place >= 0) & (half(place) % 2 == 0)).select("conv_id", half(place).alias("half"), F.col("node").alias("_node"))
        more = above.join(roots, ["conv_id", "half"]).groupBy("_node").agg(*[F.sum(f"_{v}").alias(f"_{v}") for v in values])
        grown = now.join(more, F.col("node") == F.col("_node"), "left").select("node", "conv_id", "depth", *[(F.col(v) + F.coalesce(F.col(f"_{v}"), F.lit(0))).alias(v) for v in values])
        before, now = now, materialize(grown, "totals")
        if k:
            discard(before)
    root = now.where("depth = 1").agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values]).select(F.lit(bytes(24)).alias("node"), *values)
    return now.select("node", *values).unionByName(root).groupBy("node").agg(*[F.sum(v).alias(v) for v in values])


def _digests(ends: DataFrame) -> DataFrame:
    """``(node, sha)`` of ends(node, conv_id): SHA-256 of the ids in order, joined by commas."""
    near = ends.groupBy("node", F.floor(F.col("conv_id") / 4096).cast("bigint").alias("part"))
    joined = near.agg(F.array_join(F.transform(F.sort_array(F.collect_set("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches):
        node, state = None, None
        for b in batches:
            done = ([], [])
            for n, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if n != node:
                    if state:
                        done[0].append(node), done[1].append(state.hexdigest())
                    node, state = n, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], ["node", "sha"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "sha"])

    return joined.repartition("node").sortWithinPartitions("node", "part").select("node", "ids").mapInArrow(run, "node binary, sha string")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns(conv_id, at, role, text)``, ``at`` gapless from 0, over all of ``convs(conv_id)``.

    A node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and ``name``. The last turn of a node is turn
    depth - 1 of its conv_id.
    """
    length = lambda c: F.lpad(F.length(c).cast("string"), 12, "0")
    token = _named(F.encode(length(F.col("role")), "UTF-8"), F.encode("role", "UTF-8"), F.encode("text", "UTF-8"))
    tokens = materialize(turns.select("conv_id", "at", token.alias("name"), F.length("text").cast("bigint").alias("chars")), "tokens")
    ids = materialize(convs.select("conv_id").distinct(), "ids")
    most = tokens.agg(F.coalesce(F.max("at") + 1, F.lit(0))).first()[0]
    named = blocks(tokens.select("conv_id", "at", "name"), most) if most else []
    paths = prefixes(ids, named).withColumn("node", F.concat(F.unhex(F.lpad(F.hex("depth"), 16, "0")), "name")).select("conv_id", "depth", "node")
    sizes = tokens.groupBy("conv_id").agg((F.max("at") + 1).alias("n"))
    ends = ids.join(sizes, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("depth")).join(paths, ["conv_id", "depth"]).select("node", "conv_id")
    nodes = materialize(paths.groupBy("node", "depth").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")), "nodes")
    up = nodes.select("node", "conv_id", (F.col("depth") - 1).alias("depth")).join(paths.withColumnRenamed("node", "parent"), ["conv_id", "depth"]).select("node", "parent")
    up = materialize(up, "parents")
    heads = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    children = up.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    last = tokens.select("conv_id", (F.col("at") + 1).alias("depth"), "chars")
    full = nodes.join(children, "node", "left").join(last, ["conv_id", "depth"], "left")
    full = full.select("node", "conv_id", "depth", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), ((F.col("n_convs") - 1) * F.coalesce("chars", F.lit(0))).alias("own"))
    full = materialize(full, "nodes")
    own = full.select("node", "conv_id", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("n_leaves"), F.col("own").alias("saved_tokens"))
    totals = _grafted(own, paths, len(named))
    out = full.drop("own").join(up.join(heads, "parent").select("node", "parent_conv_id"), "node", "left").join(totals, "node").join(_digests(ends), "node", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), F.hex("node").alias("name"),
    )


def spliced(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with some turns of their block's first one: ``(convs, turns)``.

    Conversation c has the first h = crc32(c) % most turns of conversation c - c % block, then its own after its first h.
    """
    head = F.crc32(F.col("conv_id").cast("string")) % most
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = sizes.select("conv_id", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = materialize(convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))), "convs")
    first = turns.where(F.col("at") < most - 1).withColumnRenamed("conv_id", "base")
    taken = convs.join(first, "base").where("at < h").select("conv_id", "at", "role", "text")
    own = turns.where(F.col("at") >= head).join(convs, "conv_id").select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "role", "text")
    return convs.select("conv_id"), taken.unionByName(own)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialize(numbered_turns(read_table(spark, sf_dir, "conversations")), "numbered")
    return prefix_trie(*spliced(turns)).drop("name")


ORACLE = f"""
WITH {CRC_TABLE},
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY pos) AS ts FROM t GROUP BY conv_id),
c AS (SELECT conv_id, ts, {crc_sql("conv_id")} % 6 AS h FROM own, bytes),
s AS (SELECT c.conv_id, list_concat(coalesce(list_slice(b.ts, 1, h), []), list_slice(c.ts, h + 1, len(c.ts))) AS ts FROM c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
p AS (SELECT conv_id, d AS depth, list_slice(ts, 1, d) AS path, len(ts) = d AS ends FROM s, UNNEST(range(len(ts) + 1)) u(d)),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ids FROM p GROUP BY path, depth),
k AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.depth = n.depth + 1 AND list_slice(m.path, 1, n.depth) = n.path) AS n_children FROM n),
up AS (SELECT p.path AS above, p.depth AS d, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(CASE WHEN k.depth = 0 THEN 0 ELSE (k.n_convs - 1) * length(k.path[k.depth].t) END) AS saved FROM k JOIN p ON p.conv_id = k.conv_id AND p.depth <= k.depth GROUP BY ALL)
SELECT k.conv_id, k.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, k.n_convs, k.n_children, up.n_leaves::BIGINT AS n_leaves, up.saved::BIGINT AS saved_tokens, sha256(k.ids) AS ends_sha256
FROM k JOIN up ON up.above = k.path AND up.d = k.depth LEFT JOIN n q ON q.depth = k.depth - 1 AND q.path = list_slice(k.path, 1, k.depth - 1)
"""
