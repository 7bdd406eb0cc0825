"""Embedding near-dedup (operator 5): exact threshold pairs by dual traversal of cover trees.

Only vectors with equal labels (and dimensions) are compared, by cosine in double precision.  Unit
vectors at cosine c are sqrt(2 - 2c) apart, so the threshold is a radius and the triangle inequality
prunes.

1. Equal vectors of a label become one class with a count.
2. Over a whole label the tree's upper levels are columns of a table: a node that is too large is dealt
   to the nearest of up to FANOUT pivots from among its members, more than half the node's radius apart; each node
   keeps the largest distance to a member as measured.  There are as many levels as the largest label needs.
3. The traversal goes down these levels as joins: pairs of nodes whose children are farther apart than
   both covering radii and the threshold are dropped at each level.  Leaves are cut into blocks; pairs of blocks
   are rows, made where the pairs of leaves are, and meet in tasks of bounded size.
4. In a task each block is a cover tree: levels with halving radii, centers nested, nodes with the
   largest distance to a member.  Pairs of nodes are descended together, each once: those out of
   reach are pruned, those that lie wholly within the threshold link entirely, the rest go down.
5. Links are counted for each class and thinned to a spanning forest in the task; components are
   found over the classes.

Without structure in the vectors (all far from each other) nothing can be pruned above the leaves and
the work of a label grows with the square of its classes; blocks bound the memory, not that work.

Defined results: vectors that are null, zero, empty or hold null or non-finite numbers, and vectors
without a label, have no links and are their own component; equal vectors are links of each other;
rows that repeat an id are vectors of their own; a null id names no component unless it's alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridia.operators.components import connected_components

from .common import lean, materialise, remove

THRESHOLD = 0.93
BLOCK = 2048
#: Children of a node at most, and members from among which they are chosen.
FANOUT, CANDIDATES = 64, 256
LEAF = 96
#: Slack for rounding where a bound, not the cosine itself, decides.
EPSILON = 1e-9


class Node:
    """scale: the radius of its level, which bounds its own."""

    __slots__ = ("center", "members", "radius", "scale", "children")

    def __init__(self, center: int, members: np.ndarray, radius: float, scale: float):
        self.center, self.members, self.radius, self.scale, self.children = center, members, radius, scale, None


class CoverTree:
    """Over unit vectors. Each level's radius is half of that above; the first child of a node keeps its center
    (nesting). Levels at which a node would be its own only child are passed over."""

    def __init__(self, x: np.ndarray):
        self.x = x
        everything = np.arange(len(x))
        far = float(self._apart(0, everything).max()) if len(x) > 1 else 0.0
        self.root = Node(0, everything, far, 2.0)

    def _apart(self, center: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (self.x[members] @ self.x[center])))

    def children(self, node: Node) -> list[Node]:
        """The node's net on the next level; split on first use."""
        if node.children is None:
            node.children, rest, center, bound = [], node.members, node.center, node.scale / 2
            while node.radius <= bound:
                bound /= 2
            while len(rest):
                d = self._apart(center, rest)
                near = (d <= bound) | (rest == center)
                mine = rest[near]
                node.children.append(Node(center, mine, float(d[near].max()) if len(mine) > 1 else 0.0, bound))
                rest = rest[~near]
                if len(rest):
                    center = int(rest[0])
        return node.children


def dual_traversal(a: CoverTree, b: CoverTree, threshold: float = THRESHOLD):
    """Yields pairs of index arrays (i, j) with cosine >= threshold, each pair once; a tree with itself: i and j differ."""
    reach = float(np.sqrt(2 - 2 * threshold))
    todo = [(a.root, b.root)]
    while todo:
        p, q = todo.pop()
        same = p is q
        down = [n.radius > 0 and len(n.members) > LEAF for n in (p, q)]
        if not any(down):
            near = a.x[p.members] @ b.x[q.members].T >= threshold
            i, j = np.nonzero(np.triu(near, 1) if same else near)
            yield p.members[i], q.members[j]
            continue
        ps = a.children(p) if down[0] else [p]
        qs = ps if same else b.children(q) if down[1] else [q]
        dots = a.x[[n.center for n in ps]] @ b.x[[n.center for n in qs]].T
        apart = np.sqrt(np.maximum(0, 2 - 2 * dots))
        rp, rq = np.array([n.radius for n in ps])[:, None], np.array([n.radius for n in qs])[None, :]
        lone = np.array([len(n.members) == 1 for n in ps])[:, None] & np.array([len(n.members) == 1 for n in qs])[None, :]
        open_ = np.triu(np.ones(dots.shape, dtype=bool)) if same else np.ones(dots.shape, dtype=bool)
        own = np.eye(len(ps), dtype=bool) if same else np.zeros(dots.shape, dtype=bool)
        i, j = np.nonzero(open_ & lone & ~own & (dots >= threshold))
        if len(i):
            yield np.array([ps[k].center for k in i]), np.array([qs[k].center for k in j])
        inside = open_ & ~lone & ~own & (apart + rp + rq <= reach - 1e-6)
        for k, m in zip(*np.nonzero(inside)):
            yield np.repeat(ps[k].members, len(qs[m].members)), np.tile(qs[m].members, len(ps[k].members))
        for k, m in zip(*np.nonzero(open_ & ~lone & ~inside & (apart - rp - rq <= reach + EPSILON))):
            todo.append((ps[k], qs[m]))


def unit(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), dtype="<f8").reshape(len(rows), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n points is joined to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _pack(batches):
    """vec (64-bit numbers as bytes) or null for vectors that link with nothing."""
    for batch in batches:
        out = []
        for x in batch.column(2).to_pylist():
            if not x or any(v is None for v in x):
                out.append(None)
                continue
            v = np.array(x, dtype="<f8")
            big = np.abs(v).max()
            ok = np.isfinite(v).all() and big > 0
            if ok and not 1e-100 < big < 1e100:
                v = v / big  # its square neither vanishes nor overflows
            out.append((v + 0.0).tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "label", "vec"])


def _pivots(block: int):
    """From rows (label, dim, cell, size, far, candidates): the node's pivots, concatenated; the candidates come in order of a hash."""

    def run(batches):
        for batch in batches:
            out = []
            for size, far, joined, dim in zip(*(batch.column(c).to_pylist() for c in ("size", "far", "candidates", "dim"))):
                step, want = 8 * dim, min(FANOUT, -(-size // block))
                x = unit([joined[k : k + step] for k in range(0, len(joined), step)])
                kept, near = [0], 2 - 2 * (x @ x[0])
                while len(kept) < want:  # the next candidate that is farther than half the radius from all so far
                    rest = np.flatnonzero(near > (far / 2) ** 2)
                    if not len(rest):
                        break
                    kept.append(int(rest[0]))
                    near = np.minimum(near, 2 - 2 * (x @ x[kept[-1]]))
                out.append(b"".join(joined[k * step : (k + 1) * step] for k in kept))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "dim", "cell")), pa.array(out, pa.binary())], names=["label", "dim", "cell", "pivots"])

    return run


def _nearest(batches):
    """The child node and the distance to its pivot of each class, from the pivots of its node (concatenated)."""
    for batch in batches:
        cells, far, centers = [], [], []
        last, pivots = None, None
        for cell, vec, joined in zip(*(batch.column(c).to_pylist() for c in ("cell", "vec", "pivots"))):
            if joined is not last and joined != last:
                last, pivots = joined, unit([joined[k : k + len(vec)] for k in range(0, len(joined), len(vec))])
            d = np.sqrt(np.maximum(0, 2 - 2 * (pivots @ unit([vec])[0])))
            k = int(d.argmin())
            cells.append(f"{cell}.{k}")
            far.append(float(d[k]))
            centers.append(joined[k * len(vec) : (k + 1) * len(vec)])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "label", "dim", "vec", "n")), pa.array(cells, pa.string()), pa.array(far), pa.array(centers, pa.binary())], names=["rid", "label", "dim", "vec", "n", "cell", "far", "center"])


def _in_reach(threshold: float):
    """Of pairs of nodes those that can have members within the threshold."""
    reach = float(np.sqrt(2 - 2 * threshold))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y, far, other in zip(*(batch.column(c).to_pylist() for c in ("center", "other_center", "far", "other_far"))):
                u = unit([x, y])
                keep.append(float(np.sqrt(max(0.0, 2 - 2 * u[0] @ u[1]))) <= far + other + reach + EPSILON)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def _linked(threshold: float):
    """Rows sorted by (label, dim, pair): counts of links of each class and edges that span them."""

    def finish(rows):
        sides = [[r for r in rows if r[0] == s] for s in (0, 1)]
        a, same = sides[0], not sides[1]
        b = a if same else sides[1]
        if not a or not b:
            return [], [], [], []
        ra, rb = (np.array([r[1] for r in s], dtype=np.int64) for s in (a, b))
        na, nb = (np.array([r[2] for r in s], dtype=np.int64) for s in (a, b))
        ta = CoverTree(unit([r[3] for r in a]))
        tb = ta if same else CoverTree(unit([r[3] for r in b]))
        la, lb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        label = np.arange(len(a) + len(b))
        held_i, held_j, held = [], [], 0

        def thin():
            nonlocal label, held_i, held_j, held
            if held:
                i, j = np.concatenate(held_i), np.concatenate(held_j) + (0 if same else len(a))
                label = spanning(len(label), np.concatenate([np.arange(len(label)), i]), np.concatenate([label, j]))
                held_i, held_j, held = [], [], 0

        for i, j in dual_traversal(ta, tb, threshold):
            la += np.bincount(i, weights=nb[j], minlength=len(a)).astype(np.int64)
            other = la if same else lb
            other += np.bincount(j, weights=na[i], minlength=len(other)).astype(np.int64)
            held_i.append(i)
            held_j.append(j)
            held += len(i)
            if held > 4_000_000:
                thin()
        thin()
        node = ra if same else np.concatenate([ra, rb])
        label = label[: len(node)]
        moved = np.flatnonzero(label != np.arange(len(node)))
        rid = ra[la > 0].tolist() + (rb[lb > 0].tolist() if not same else [])
        links = la[la > 0].tolist() + (lb[lb > 0].tolist() if not same else [])
        return rid, links, node[moved].tolist(), node[label[moved]].tolist()

    def batch_of(found):
        rid, links, u, v = ([x for f in found for x in f[k]] for k in range(4))
        return pa.RecordBatch.from_arrays(
            [pa.array(rid + u, pa.int64()), pa.array(links + [None] * len(u), pa.int64()), pa.array([None] * len(rid) + v, pa.int64())], names=["rid", "links", "other"]
        )

    def run(batches):
        at, rows, found = None, [], []
        for batch in batches:
            for label, dim, pair, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (label, dim, pair) != at and rows:
                    found.append(finish(rows))
                    rows = []
                at = (label, dim, pair)
                rows.append(row)
            if found:
                yield batch_of(found)
                found = []
        if rows:
            yield batch_of([finish(rows)])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """For each row: id_col, n_links, component_id, kept."""
    id_kind, label_kind = (vectors.schema[c].dataType.simpleString() for c in (id_col, label_col))
    source = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    packed = materialise(source.mapInArrow(lean(_pack), f"id {id_kind}, label {label_kind}, vec binary"), "vectors")
    able = packed.where("vec is not null and label is not null")
    classes = able.groupBy("label", "vec").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("rid"), "id", "label", (F.length("vec") / 8).cast("int").alias("dim"), "vec", "n"), "classes")

    # the upper levels, over whole labels: a node's members go to the nearest of its pivots
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    levels = 1
    while FANOUT**levels * block < largest:
        levels += 1
    nodes = classes.groupBy("label", "dim").agg(F.count("*").alias("size")).select("label", "dim", F.lit("").alias("cell"), "size", F.lit(2.0).alias("far"))
    placed = classes.select("rid", "label", "dim", "vec", "n", F.lit("").alias("cell"))
    pairs = nodes.select("label", "dim", "cell", F.col("cell").alias("other"))
    wide = f"rid bigint, label {label_kind}, dim int, vec binary, n bigint, cell string, far double, center binary"
    used = []
    for level in range(levels):
        hashed = F.struct(F.xxhash64("vec").alias("h"), "vec")
        few = placed.groupBy("label", "dim", "cell", F.pmod(F.xxhash64("vec", F.lit(level)), F.lit(CANDIDATES)).alias("slot")).agg(F.min(hashed).alias("first"))
        few = few.groupBy("label", "dim", "cell").agg(F.sort_array(F.collect_list("first")).alias("all"))
        joined = F.aggregate("all", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["vec"]))
        few = few.select("label", "dim", "cell", joined.alias("candidates")).join(nodes.select("label", "dim", "cell", "size", "far"), ["label", "dim", "cell"])
        pivots = materialise(few.mapInArrow(lean(_pivots(block)), f"label {label_kind}, dim int, cell string, pivots binary"), "pivots")
        dealt = placed.select("rid", "label", "dim", "vec", "n", "cell").join(pivots, ["label", "dim", "cell"])
        placed = materialise(dealt.mapInArrow(lean(_nearest), wide), "cells")
        nodes = placed.groupBy("label", "dim", "cell").agg(F.first("center").alias("center"), F.max("far").alias("far"), F.count("*").alias("size"))
        nodes = materialise(nodes.withColumn("above", F.regexp_replace("cell", r"\.[0-9]+$", "")), "nodes")
        # the traversal: pairs of nodes of this level from the pairs of the level above that are in reach
        one = nodes.select("label", "dim", F.col("above").alias("cell"), F.col("cell").alias("down"), "center", "far")
        two = nodes.select("label", "dim", F.col("above").alias("other"), F.col("cell").alias("other_down"), F.col("center").alias("other_center"), F.col("far").alias("other_far"))
        below = pairs.join(one, ["label", "dim", "cell"]).join(two, ["label", "dim", "other"]).where((F.col("cell") != F.col("other")) | (F.col("down") <= F.col("other_down")))
        below = below.select("label", "dim", F.col("down").alias("cell"), F.col("other_down").alias("other"), "center", "other_center", "far", "other_far")
        pairs = materialise(below.mapInArrow(lean(_in_reach(threshold)), below.schema).select("label", "dim", "cell", "other"), "pairs")
        used += [pivots, placed, nodes, pairs]

    blocks = nodes.select("label", "dim", "cell", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    sized = pairs.join(blocks, ["label", "dim", "cell"]).join(blocks.select("label", "dim", F.col("cell").alias("other"), F.col("blocks").alias("other_blocks")), ["label", "dim", "other"])
    every = sized.select("label", "dim", "cell", "other", "other_blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"))
    every = every.select("label", "dim", "cell", "other", "x", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)).alias("y")).where("cell != other or x <= y")
    pair = F.concat_ws("-", "cell", "x", "other", "y").alias("pair")
    left = F.struct(F.col("cell").alias("cell"), F.col("x").alias("block"), F.lit(0).alias("side"))
    right = F.when((F.col("cell") != F.col("other")) | (F.col("x") != F.col("y")), F.struct(F.col("other").alias("cell"), F.col("y").alias("block"), F.lit(1).alias("side")))
    asked = every.select("label", "dim", pair, F.explode(F.filter(F.array(left, right), lambda s: s.isNotNull())).alias("s")).select("label", "dim", "pair", "s.*")
    dealt = placed.join(blocks, ["label", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    met = dealt.join(asked, ["label", "dim", "cell", "block"]).select("label", "dim", "pair", "side", "rid", "n", "vec")
    found = met.repartition("label", "dim", "pair").sortWithinPartitions("label", "dim", "pair", "side").mapInArrow(lean(_linked(threshold)), "rid bigint, links bigint, other bigint")
    found = materialise(found, "links")
    for t in used:
        remove(t)
    links = found.where("links is not null").groupBy("rid").agg(F.sum("links").alias("links"))
    whole = connected_components(found.where("other is not null").select(F.col("rid").alias("u"), F.col("other").alias("v")))

    named = classes.select("rid", "id", "label", "vec", "n").join(links, "rid", "left").join(whole.withColumnRenamed("node", "rid"), "rid", "left")
    named = named.withColumn("component", F.coalesce("component", "rid"))
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    named = named.join(least, "component").select(F.col("label").alias("c_label"), F.col("vec").alias("c_vec"), "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = packed.join(named, (F.col("label") == F.col("c_label")) & (F.col("vec") == F.col("c_vec")), "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("least"))
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


REPORT_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
             AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
      WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a),
c AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m.least, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(m.least, vec_id)) AS kept
FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN m ON m.a = e.vec_id
"""
