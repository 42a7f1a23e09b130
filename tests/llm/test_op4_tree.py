"""The k-d tree against one that sorts plain rows."""

import random
from fractions import Fraction
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from quarrystone.llm import op4_kd_sharding as op4


def tree(rows, dims, leaves):
    """``rows``: (id, values, hash, weight). Shards by id, each node sorted whole."""
    whole = [max(1, max(r[1][i] for r in rows) - min(r[1][i] for r in rows)) for i in range(dims)]
    out, todo = {}, [(0, leaves, rows)]
    while todo:
        first, k, part = todo.pop()
        if k == 1 or not part:
            out |= {r[0]: first for r in part}
            continue
        spread = [Fraction(max(r[1][i] for r in part) - min(r[1][i] for r in part), whole[i]) for i in range(dims)]
        best = max(spread, default=0)
        axis = spread.index(best) if best else None
        at = lambda r, axis=axis: (r[1][axis] if axis is not None else 0, r[2])
        want, under, stay = Fraction(sum(r[3] for r in part) * (k // 2), k), 0, []
        ordered = [list(g) for _, g in groupby(sorted(part, key=at), key=at)]
        for g in ordered:
            upto = under + sum(r[3] for r in g)
            if upto < want and g is not ordered[-1]:
                stay += g
                under = upto
                continue
            if upto - want <= want - under:
                stay += g
            break
        held = {id(r) for r in stay}
        todo += [(first, k // 2, stay), (first + k // 2, k - k // 2, [r for r in part if id(r) not in held])]
    return out


@pytest.mark.parametrize("leaves", [1, 2, 7, 24, 150])
def test_equals_a_sorted_tree(spark, monkeypatch, leaves):
    rng = random.Random(leaves)
    rows = [(i, rng.choice([rng.randint(0, 10**6), 5, 5, 9]), rng.randint(0, 3), rng.choice([0, 1, rng.randint(1, 500), 4000])) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, a int, b int, w int")
    h = {r.id: r.h for r in df.select("id", F.shiftrightunsigned(F.xxhash64("id", F.lit(29)), 64 - op4.HASH).alias("h")).collect()}
    want = tree([(i, (a, b), h[i], w) for i, a, b, w in rows], 2, leaves)
    monkeypatch.setattr(op4, "CELLS", 64)  # more passes for a range
    got = op4.kd_shards(df, {"a": F.col("a"), "b": F.col("b")}, F.col("w"), F.col("id"), leaves=leaves)
    assert {r.id: r.shard for r in got.collect()} == want
    assert len(set(want.values())) == leaves


def test_wide_values_nulls_ties_and_clashes(spark):
    far = [-(2**63), 2**63 - 1, 0, None]
    rows = [(i, far[i % 4], 10, "x", i) for i in range(200)] + [(7, 0, None, "y", 1)] * 30
    df = spark.createDataFrame(rows, "id int, a bigint, w int, _node string, Shard int")
    got = op4.kd_shards(df, {"a": F.col("a")}, F.col("w"), F.struct("id", "_node"), target_bytes=250).collect()
    assert sorted(got[0].asDict()) == ["_node", "a", "id", "shard", "w"] and len(got) == 230
    assert {r.shard for r in got} == set(range(8)) and len({r.shard for r in got if r._node == "y"}) == 1
    load = [sum(r.w or 0 for r in got if r.shard == s) for s in range(8)]
    assert max(load) - min(load) <= 20
    assert op4.kd_shards(df.limit(0), {"a": F.col("a")}, F.col("w"), F.col("id"), leaves=5).count() == 0


def test_the_large_tables_are_joined_when_there_are_many_nodes(spark, monkeypatch):
    df = spark.range(3000).select("id", (F.col("id") * 7919 % 3001).alias("a"), F.lit(3).alias("w"))
    shards = lambda: {(r.id, r.shard) for r in op4.kd_shards(df, {"id": F.col("id"), "a": F.col("a")}, F.col("w"), F.col("id"), leaves=12).collect()}
    by_broadcast = shards()
    monkeypatch.setattr(op4, "SMALL", 2)
    assert shards() == by_broadcast
