"""Components carried over ten snapshots, with edges that come and go, against union-find over all edges."""

import random

from quarrystone.plans.snapshots import first_snapshot, next_snapshot


def found(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {x: root(x) for x in up}


def test_ten_snapshots(spark):
    rng = random.Random(12)
    make = lambda n: [(rng.randrange(300), rng.randrange(300)) for _ in range(n)]
    df = lambda rows: spark.createDataFrame(rows, "a bigint, b bigint").repartition(2)
    edges = {tuple(sorted(e)) for e in make(110) if e[0] != e[1]}
    now = first_snapshot(df([*edges, (5, 5)]))
    redone = []
    for step in range(10):
        removed = rng.sample(sorted(edges), min(len(edges), [0, 3, 25, 1][step % 4])) + make(2)
        added = make([6, 0, 12, 30][step % 4]) + removed[:1] * (step == 5) + [(7, 7)]
        now = next_snapshot(now, df(added), df([(b, a) for a, b in removed]))
        edges -= {tuple(sorted(e)) for e in removed}
        edges |= {tuple(sorted(e)) for e in added if e[0] != e[1]}
        assert {r.node: r.component for r in now.labels.collect()} == found(edges), step
        assert {tuple(r) for r in now.edges.collect()} == edges
        redone.append(now.redone)
    assert redone[0] < 20 and min(redone) < max(redone)  # few edges gone, little walked


def test_all_edges_go(spark):
    df = lambda rows: spark.createDataFrame(rows, "a bigint, b bigint")
    now = next_snapshot(first_snapshot(df([(1, 2), (2, 3)])), df([]), df([(1, 2), (2, 3)]))
    assert now.labels.collect() == [] and now.edges.collect() == []
    again = next_snapshot(now, df([(9, 8), (8, 7)]), df([]))
    assert {tuple(r) for r in again.labels.collect()} == {(9, 7), (8, 7), (7, 7)}
