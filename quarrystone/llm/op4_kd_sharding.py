"""Sharding by a k-d tree over metadata (native).

The tree splits the rows again and again at a weighted median along the widest
metadata dimension until each leaf holds its share of the bytes. All open nodes
of a level split in the same passes: a pass sums weights in equal-width cells of
each node's value range, and the cell that holds the wanted weight becomes the
next range, so a cut is found in a few passes over narrow metadata and no row is
sorted. Nodes, ranges and cuts are tables, read and written by executors; the driver
learns the ends of the dimensions, and after each pass whether a cut is still open.
So there may be any number of leaves: a level costs its passes over the metadata
(one or two a dimension's range, and as many for a cut within one value), and the
rows themselves are read once, at the end, past one narrow table of cuts a level.

Defined results: a null text has weight ``overhead`` only; equal metadata is told
apart by a hash of the row identity, so a dimension with one value still splits; identical rows
share every value and stay together, and so do rows whose metadata and hash are equal; of
two neighbouring cuts the one whose weight is nearer to the wanted one is taken, the
greater if both are as near; rows without a value in a dimension count as 0
there, as rows without a weight weigh nothing; very long texts are one weight each; an
empty table gives no rows; other columns of the input pass through, whatever
their names, but ``shard`` is replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import discard, materialize, number_rows, read_table

#: Cells of one pass: of a node, and of all nodes together.
CELLS, ALL_CELLS = 1 << 16, 1 << 22
#: Tables of cuts of at most as many nodes (about 40 bytes each) go to every task.
SMALL = 1 << 17
#: Bits of a dimension that are told apart, and of the hash.
WIDE, HASH = 52, 24


def _spread(c: Column, low: int, high: int) -> Column:
    """A dimension from 0 up; of one that spans more than WIDE bits the lowest bits are left out."""
    cut = max(0, (high - low).bit_length() - WIDE)
    return F.shiftright(c, cut) - F.lit(low >> cut)


def _with_node(rows: DataFrame, table: DataFrame, nodes: int) -> DataFrame:
    return rows.join(F.broadcast(table) if nodes <= SMALL else table, "_node", "left")


def _value(dims: int) -> Column:
    """The row's value along its node's axis; 0 where only the hash divides."""
    return reduce(lambda e, i: e.when(F.col("_axis") == i, F.col(f"_d{i}")), range(dims), F.when(F.lit(False), F.lit(0).cast("bigint"))).otherwise(0)


def _open_nodes(base: DataFrame, whole: list[int], cells: int) -> DataFrame:
    """The nodes of more than one leaf: axis, wanted weight and the first range of each."""
    dims = len(whole)
    seen = base.where("_k > 1").groupBy("_node", "_k").agg(F.sum("_weight").cast("double").alias("w"), *[f(f"_d{i}").alias(f"{f.__name__}{i}") for i in range(dims) for f in (F.min, F.max)])
    spread = [(F.col(f"max{i}") - F.col(f"min{i}")) / F.lit(float(whole[i])) for i in range(dims)]
    widest = F.greatest(F.lit(0.0), F.lit(0.0), *spread)
    axis = reduce(lambda e, i: e.when((widest > 0) & (spread[i] == widest), i), range(dims), F.when(F.lit(False), 0)).otherwise(dims)
    low, high = (reduce(lambda e, i, f=f: e.when(F.col("_axis") == i, F.col(f"{f}{i}")), range(dims), F.when(F.lit(False), F.lit(0).cast("bigint"))).otherwise(end) for f, end in (("min", 0), ("max", (1 << HASH) - 1)))
    at = seen.select("*", axis.alias("_axis"))
    by_hash = F.col("_axis") == dims
    return at.select(
        "_node", "_k", "_axis", (F.col("w") * F.floor(F.col("_k") / 2) / F.col("_k")).alias("_want"), by_hash.alias("_hashed"), F.when(by_hash, F.lit(0).cast("bigint")).alias("_v_cut"),
        F.lit(None).cast("bigint").alias("_h_cut"), low.alias("_lo"), F.ceil((high - low + 1) / F.lit(cells)).alias("_width"), F.lit(0.0).alias("_below"),
    )


def _narrowed(base: DataFrame, state: DataFrame, dims: int, nodes: int, cells: int) -> DataFrame:
    """One pass: every open node's range becomes the cell in which its wanted weight is reached, or its cut is found."""
    open_ = state.where("_h_cut IS NULL")
    at = _with_node(base.where("_k > 1").drop("_k"), open_, nodes).where("_want IS NOT NULL").withColumn("_v", _value(dims))
    x = F.when(F.col("_hashed"), F.col("_h")).otherwise(F.col("_v"))
    cell = F.floor((x - F.col("_lo")) / F.col("_width"))
    inside = (~F.col("_hashed") | (F.col("_v") == F.col("_v_cut"))) & (x >= F.col("_lo")) & (x < F.col("_lo") + F.col("_width") * cells)
    sums = at.where(inside).groupBy("_node", cell.alias("cell")).agg(F.sum("_weight").cast("double").alias("w"), (F.max("_h") > F.min("_h")).alias("many"))
    run = Window.partitionBy("_node").orderBy("cell")
    upto = _with_node(sums, open_.select("_node", "_want", "_below"), nodes).withColumn("upto", F.col("_below") + F.sum("w").over(run))
    here = F.struct("cell", "w", "upto", "many")
    found = upto.groupBy("_node").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("_want"), here)), F.max(here)).alias("f"))
    both = _with_node(state, found, nodes)
    c = {n: F.col(n) for n in ("_want", "_hashed", "_v_cut", "_h_cut", "_lo", "_width", "_below")}
    value, under = c["_lo"] + F.col("f.cell") * c["_width"], F.col("f.upto") - F.col("f.w")
    take = F.col("f.upto") - c["_want"] <= c["_want"] - under
    live, last = F.col("f").isNotNull(), c["_width"] == 1
    # a value whose rows the hash tells apart is divided by it; any other is taken or left whole
    divide, done_v, done_h = live & last & ~c["_hashed"] & F.col("f.many"), live & last & ~c["_hashed"] & ~F.col("f.many"), live & last & c["_hashed"]
    return both.select(
        "_node", "_k", "_axis", "_want", (c["_hashed"] | divide).alias("_hashed"),
        F.when(divide | done_v, value).otherwise(c["_v_cut"]).alias("_v_cut"),
        F.when(done_v, F.when(take, (1 << HASH) - 1).otherwise(-1)).when(done_h, F.when(take, value).otherwise(value - 1)).otherwise(c["_h_cut"]).cast("bigint").alias("_h_cut"),
        F.when(divide, F.lit(0)).when(live & ~last, value).otherwise(c["_lo"]).cast("bigint").alias("_lo"),
        F.when(divide, F.lit(-(-(1 << HASH) // cells))).when(live & ~last, F.ceil(c["_width"] / F.lit(cells))).otherwise(c["_width"]).cast("bigint").alias("_width"),
        F.when(live & (~last | divide), under).otherwise(c["_below"]).alias("_below"),
    )


def _written(state: DataFrame) -> tuple[DataFrame, int]:
    """The table of nodes, and how many of them have no cut yet."""
    seen = Observation()
    out = materialize(state.observe(seen, F.count_if(F.col("_h_cut").isNull()).alias("open")), "kd-state")
    return out, seen.get["open"]


def _descend(rows: DataFrame, cuts: DataFrame, dims: int, nodes: int) -> DataFrame:
    """``rows`` with the child of their node; a leaf's node is its number, a node's that of its first leaf."""
    at = _with_node(rows, cuts.select("_node", "_axis", "_v_cut", "_h_cut"), nodes).withColumn("_v", _value(dims))
    stay = F.col("_axis").isNull() | (F.col("_v") < F.col("_v_cut")) | ((F.col("_v") == F.col("_v_cut")) & (F.col("_h") <= F.col("_h_cut")))
    left = F.floor(F.col("_k") / 2)
    return at.withColumns({"_node": F.when(stay, F.col("_node")).otherwise(F.col("_node") + left), "_k": F.when(F.col("_axis").isNull(), F.col("_k")).when(stay, left).otherwise(F.col("_k") - left)}).drop("_axis", "_v_cut", "_h_cut", "_v")


def kd_shards(df: DataFrame, dims: dict[str, Column], weight: Column, identity: Column, leaves: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``df`` with ``shard`` (0 to leaves - 1).

    ``dims`` are integral metadata columns. Give the number of ``leaves`` or the
    bytes a leaf shall hold at most on average. A dimension's width is its spread
    in a node against its spread in the table. ``df`` is read three times: its ends,
    its metadata and, at last, its rows.
    """
    d = [F.coalesce(c.cast("bigint"), F.lit(0)) for c in dims.values()]
    heavy = F.coalesce(weight.cast("bigint"), F.lit(0))
    total, *ends = df.agg(F.sum(heavy), *[f(c) for c in d for f in (F.min, F.max)]).first()
    if total is None:
        return df.drop("shard").withColumn("shard", F.lit(0))
    leaves = leaves or max(1, math.ceil(total / target_bytes))
    whole = [max(1, ends[2 * i + 1] - ends[2 * i]) for i in range(len(d))]
    # a spread is told against the whole in the same units
    whole = [w >> max(0, w.bit_length() - WIDE) for w in whole]
    # the row travels in one column, so that no name of it clashes with those of the tree
    place = [_spread(c, ends[2 * i], ends[2 * i + 1]).alias(f"_d{i}") for i, c in enumerate(d)]
    own = [*place, F.shiftrightunsigned(F.xxhash64(identity, F.lit(29)), 64 - HASH).alias("_h"), F.lit(0).cast("bigint").alias("_node"), F.lit(leaves).cast("bigint").alias("_k")]
    narrow = ["_weight", *[f"_d{i}" for i in range(len(d))], "_h", "_node", "_k"]
    base = materialize(df.select(heavy.alias("_weight"), *own).groupBy(*narrow[1:]).agg(F.sum("_weight").alias("_weight")).select(*narrow), "kd-level")
    levels = []
    for level in range((leaves - 1).bit_length()):
        nodes = min(1 << level, leaves)
        cells = max(64, min(CELLS, ALL_CELLS // nodes))
        state, open_ = _written(_open_nodes(base, whole, cells))
        while open_:
            before = state
            state, open_ = _written(_narrowed(base, state, len(d), nodes, cells))
            discard(before)
        levels.append((state, nodes))
        if level + 1 < (leaves - 1).bit_length():
            before, base = base, materialize(_descend(base, state, len(d), nodes).select(*narrow), "kd-level")
            discard(before)
    discard(base)
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *own)
    for cuts, nodes in levels:
        out = _descend(out, cuts, len(d), nodes)
    return out.select(*[F.col("_row")[c].alias(c) for c in df.columns if c.lower() != "shard"], F.col("_node").cast("int").alias("shard"))


def alphabetical(c: Column) -> Column:
    """The place of a word among all words, as far as its first four bytes tell."""
    head = F.substring(F.concat(F.coalesce(c, F.lit("")).cast("binary"), F.unhex(F.lit("00000000"))), 1, 4)
    return F.conv(F.hex(head), 16, 10).cast("bigint")


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint")
    meta = materialize(docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), alphabetical(F.col("lang")).alias("lang_code")), "shard-meta")
    sharded = kd_shards(meta, {"doc_id": F.col("doc_id"), "size": F.col("size"), "lang": F.col("lang_code")}, F.col("size"), F.struct("doc_id", "text_crc32"), leaves=24)
    fixed = materialize(sharded.select("doc_id", "size", "text_crc32", "shard"), "shards")
    blocks = max(1, fixed.count() // (24 * 20_000))
    return number_rows(fixed, ["shard"], ["doc_id", "text_crc32"], "slot", blocks).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
