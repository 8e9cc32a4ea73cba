"""Connected components by alternating large-star and small-star steps over a frame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sealfold.llm.common import discard, drop_garbage, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v. Each node links its larger (or smaller) neighbours and itself to its least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = both.join(least, "u")
    linked = linked.where("v > u") if large else linked
    out = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select("u", F.col("m").alias("v")))
    out = out.where("u > v")
    return out if large else out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node that has an edge; a component is named by its least node.

    ``edges`` has columns a and b; loops, repeated and reversed edges don't matter, nulls are no nodes. Each round's
    edges are stored in the shared folder; the rounds end when one changes nothing, after about log(nodes) of them.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before, stored = None, None
    while True:
        seen = Observation()  # counted while the round is written, without a job of its own
        now = materialize(_star(_star(now, True), False).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark")), "stars")
        if stored is not None:
            discard(stored)
        stored = now
        drop_garbage(edges.sparkSession)
        mark = tuple(seen.get[k] for k in ("n", "mark"))
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components of what labels (node, component) and links (a, b) connect; the links' ends are contracted to their components first.

    A few more links therefore cost a run over their few components, and none cost nothing.
    """
    ends = links.select("a", "b")
    for end in ("a", "b"):
        named = labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
        ends = ends.join(named, end, "left").withColumn(f"{end}_in", F.coalesce(f"{end}_in", end))
    apart = materialize(ends.where("a_in <> b_in").select(F.col("a_in").alias("a"), F.col("b_in").alias("b")).distinct(), "apart")
    if apart.isEmpty():
        return labels
    merged = components(apart).select(F.col("node").alias("component"), F.col("component").alias("into"))
    out = labels.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    single = merged.join(labels.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("into").alias("component"))
    return materialize(out.unionByName(single), "labels")
