"""Connected components of a graph that is too large for one machine, by contraction.

Each round every node hooks to its smallest neighbour if that is smaller than itself, pointers are
followed twice, and the edges are rewritten to the roots; edges inside a root vanish.  Every node that
isn't the smallest of its neighbourhood hooks, so edges shrink quickly; stars take one round.  Tables
between rounds are written to the shared folder, so no round depends on the lineage of the last.
`small` edges that are left, counted, are contracted in one task: the last rounds of a long chain move
few rows and would cost as much time as the first ones.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridia.storage import materialise, remove

ROUNDS = 60


def smallest(pairs) -> dict:
    """Each node of an iterable of edges, with the smallest node that it reaches."""
    up: dict = {}

    def root(x):
        while (above := up.setdefault(x, x)) != x:
            up[x] = x = up[above]
        return x

    for u, v in pairs:
        a, b = root(u), root(v)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def _contracted(edges: DataFrame) -> DataFrame:
    """node, component: all edges in one task."""

    def run(batches):
        found = smallest(p for b in batches for p in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], ["node", "component"])

    return edges.select("u", "v").repartition(1).mapInArrow(run, "node bigint, component bigint")


def connected_components(edges: DataFrame, small: int = 0) -> DataFrame:
    """node, component (the smallest node reachable) for all nodes that have an edge (u, v)."""
    rest = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    rest = materialise(rest, "edges")
    labels = None
    for _ in range(ROUNDS):
        if small and rest.count() <= small:
            done = _contracted(rest)
            if labels is None:
                new = materialise(done, "labels")
            else:
                done = done.select(F.col("node").alias("component"), F.col("component").alias("up"))
                new = materialise(labels.join(done, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
                remove(labels)
            remove(rest)
            return new
        both = rest.union(rest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("up"))
        hook = materialise(hook, "hook")
        if hook.isEmpty():
            remove(rest)
            remove(hook)
            break
        up = hook.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        jump = hook.join(up, "up").select("node", F.col("up2").alias("up"))
        jump = materialise(jump.join(up, "up").select("node", F.col("up2").alias("up")), "jump")
        to = jump.select(F.col("node").alias("u"), F.col("up").alias("new_u")), jump.select(F.col("node").alias("v"), F.col("up").alias("new_v"))
        left = rest.join(to[0], "u").join(to[1], "v").where("new_u != new_v")
        left = materialise(left.select(F.greatest("new_u", "new_v").alias("u"), F.least("new_u", "new_v").alias("v")).distinct(), "edges")
        if labels is None:
            new = jump.select("node", F.col("up").alias("component"))
        else:
            moved = jump.select(F.col("node").alias("component"), "up")
            new = labels.join(moved, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        new = materialise(new, "labels")
        for old in (rest, hook, jump, *([labels] if labels is not None else [])):
            remove(old)
        labels, rest = new, left
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node bigint, component bigint")
    return labels
