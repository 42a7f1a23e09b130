"""Connected components carried from snapshot to snapshot: work for what has changed, not for all edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.plans.components import components
from quarrystone.plans.shared import stored


@dataclass
class Snapshot:
    """Edges ``(a, b)``, each once with a < b, and ``(node, component)`` of all nodes that have one; a component is named by its least node."""

    edges: DataFrame
    labels: DataFrame
    redone: int = 0  #: nodes of components that lost an edge, whose part of the graph was walked anew


def _edges(rows: DataFrame) -> DataFrame:
    return rows.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def first_snapshot(edges: DataFrame) -> Snapshot:
    own = stored(_edges(edges))
    return Snapshot(own, stored(components(own)))


def next_snapshot(before: Snapshot, added: DataFrame, removed: DataFrame) -> Snapshot:
    """The snapshot after ``removed(a, b)`` and then ``added(a, b)``; edges that are not there, or are there already, change nothing.

    Components that lost an edge are walked anew, alone, and may split; of all others only
    names are needed, since each new edge joins two names: the graph of these names is as
    large as what was added. Old labels are read once and meet small tables; rounds run over
    small graphs only. A component named by its least node keeps that name where it does not split.
    """
    gone = stored(_edges(removed).join(before.edges, ["a", "b"], "left_semi"))
    kept = before.edges.join(gone, ["a", "b"], "left_anti")
    new = stored(_edges(added).join(kept, ["a", "b"], "left_anti"))
    ends = lambda e: e.select(F.col("a").alias("node")).union(e.select("b"))
    broken = before.labels.join(ends(gone).distinct(), "node", "left_semi").select("component").distinct()
    loose = stored(before.labels.join(broken, "component", "left_semi").select("node"))
    # both ends of an edge are in one component, so its first end tells
    inside = kept.join(loose.withColumnRenamed("node", "a"), "a", "left_semi")
    whole = before.labels.join(broken, "component", "left_anti").select("node", "component")
    labels = stored(whole.unionByName(components(inside).select("node", "component")))
    named = lambda e, side, out: e.join(labels.select(F.col("node").alias(side), F.col("component").alias(out)), side, "left").withColumn(out, F.coalesce(out, side))
    joins = named(named(new, "a", "_a"), "b", "_b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    renamed = components(joins).select(F.col("node").alias("component"), F.col("component").alias("_into"))
    fresh = ends(new).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
    after = labels.unionByName(fresh).join(renamed, "component", "left").select("node", F.coalesce("_into", "component").alias("component"))
    return Snapshot(stored(kept.unionByName(new)), stored(after), loose.count())
