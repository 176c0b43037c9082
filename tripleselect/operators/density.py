"""Density clusters: the hierarchy of the mutual-reachability graph, and the
clusters of it that live longest.

1. *Folding*: equal vectors become one node with a weight, so copies cost
   nothing and count as often as they occur.
2. *Core distances*: how far a node must reach for ``min_samples`` rows, itself
   included, from its nearest nodes.  Two nodes reach each other at the largest
   of both core distances and their distance ``sqrt(2 - 2 cos)``.
3. *Spanning tree* (Boruvka): every round each component takes its shortest
   edge out.  The lists of nearest nodes are tried first.  What is not listed
   is at least as far as a list's last entry, so a component whose shortest
   listed edge is longer than that for some member searches the rows of other
   components for a shorter one, in blocks, from those members only.  The tree
   is that of the whole graph, whatever the length of the lists.
4. *Hierarchy*: components grow along the tree's edges, shortest first.  One
   of ``min_cluster_size`` rows or more is a cluster; smaller ones that join it
   are points that fall out at that distance, and two clusters that join end
   there and found a new one.  A cluster's stability is the sum over its rows
   of how long (in 1 / distance) they stay; it is selected if that is at least
   the sum of the best below it.  The whole data set is no cluster.  Edges are
   taken in bands of ``BAND_EDGES`` (and those as long as the last); within a band every tree is a group of its
   own, bounded by the band, and what a later band needs of it is one row.

Rows under a selected cluster get its number, all others -1 (noise).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleselect.functions.vectors import with_l2_normalized
from tripleselect.operators.components import Forest, connected_components
from tripleselect.operators.neighbors import block_join, finite, in_single, matrix, products
from tripleselect.session import cut_estimates, ensure_checkpoint_dir

BAND_EDGES = 200_000
#: Shortest distance that is told apart from 0 in 1 / distance.  Without one, a group of copies would be a cluster of
#: infinite stability that nothing next to it could ever join.
SHORTEST = 0.01
#: Rows of a tile's sides, edges whose length is taken exactly at once, more than what single precision rounds off a square.
SIDE, EDGES_AT_ONCE, ROUNDING = 1024, 1 << 16, 1e-5
#: Edges of a round that one task unites.
ROUND_EDGES = 1_000_000
EDGE = "comp long, w double, lo long, hi long, other long"


def folded(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """``nodes(node, vec, weight)``, one per different unit vector, and
    ``members(id, node)``; a node is named by its smallest id."""
    x = with_l2_normalized(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")), "vec")
    x = cut_estimates(x)
    # rows are dealt and sorted by a hash of the vector; vectors are compared where it is equal, and only those of copies are joined
    h = F.xxhash64("vec").alias("h")
    nodes = cut_estimates(x.groupBy(h, "vec").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("weight")))
    alone = (F.col("weight") == 1) & F.col("vec").isNotNull()
    members = nodes.where(alone).select(F.col("node").alias("id"), "node").unionByName(
        x.withColumn("h", h).join(nodes.where("weight > 1").drop("weight"), ["h", "vec"]).select("id", "node"))
    return nodes.drop("h"), members


def core_distances(nodes: DataFrame, lists: DataFrame, min_samples: int) -> DataFrame:
    """``(node, core, reach)``: the core distance, and a distance below which
    no unlisted node is (infinite when all others are listed).
    ``lists(src, dst, dist, rank)`` are the nearest other nodes."""
    total = nodes.count()
    near = lists.join(nodes.select(F.col("node").alias("dst"), F.col("weight").alias("w")), "dst")
    near = near.join(nodes.select(F.col("node").alias("src"), F.col("weight").alias("own")), "src")
    rows = F.col("own") + F.sum("w").over(Window.partitionBy("src").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    near = near.select("src", "dist", "rank", rows.alias("rows"))
    got = near.groupBy("src").agg(F.min(F.when(F.col("rows") >= min_samples, F.col("dist"))).alias("enough"),
                                  F.max("dist").alias("far"), F.count(F.lit(1)).alias("listed"))
    core = F.when(F.col("weight") >= min_samples, 0.0).otherwise(F.coalesce("enough", "far", F.lit(0.0)))
    return nodes.join(got, F.col("node") == F.col("src"), "left").select(
        "node", core.alias("core"),
        F.when(F.coalesce("listed", F.lit(0)) >= total - 1, float("inf")).otherwise(F.greatest(core, "far")).alias("reach"))


class Outside:
    """Of each component of the rows ``q`` the shortest edge to a row of
    another one, met block after block; ties by the ends, so that every block agrees."""

    def __init__(self, q: pa.RecordBatch):
        at, self.x = finite(np.arange(q.num_rows), _vectors(q))
        self.node, self.comp, self.core, bound = (q.column(c).to_numpy()[at] for c in ("node", "comp", "core", "bound"))
        self.single, self.scale = in_single(self.x, True)
        self.names, self.own = np.unique(self.comp, return_inverse=True)
        self.least = np.full(len(self.names), np.inf)       # by component: its shortest edge is no longer
        np.minimum.at(self.least, self.own, bound)
        self.best: dict[int, tuple] = {}                    # by component: w, lo, hi, other

    def meet(self, r: pa.RecordBatch) -> None:
        at, y = finite(np.arange(r.num_rows), _vectors(r))
        node, comp, core = (r.column(c).to_numpy()[at] for c in ("node", "comp", "core"))
        single, scale = in_single(y, False)
        for c in range(0, len(node), SIDE):
            part = slice(c, c + SIDE)
            for i in range(0, len(self.node), SIDE):
                self.tile(i, single[part], scale * self.scale, node[part], comp[part], core[part], y[part])

    def tile(self, at: int, single: np.ndarray, scale: float, node: np.ndarray, comp: np.ndarray, core: np.ndarray, y: np.ndarray) -> None:
        q, own = self.single[at:at + SIDE], self.own[at:at + SIDE]
        # in squares: no edge is shorter than ``low``, whatever the rounding, none longer than it and ``room``
        low = q @ single.T
        low *= -2 * scale
        low += 2
        np.maximum(low, (core * core).astype(np.float32), out=low)
        low[self.comp[at:at + SIDE, None] == comp[None, :]] = np.inf
        room = 4 * scale * float(q[:, -1].max()) * float(single[:, -1].max()) + ROUNDING
        high = np.maximum(np.sqrt(np.maximum(low.min(axis=1).astype(np.float64) + room, 0.0)), self.core[at:at + SIDE])
        np.minimum.at(self.least, own, high)
        most = self.least[own]
        most = np.where(self.core[at:at + SIDE] <= most, most ** 2 + ROUNDING, -np.inf)
        hit = np.flatnonzero((low <= most.astype(np.float32)[:, None]) & np.isfinite(low))
        for k in range(0, len(hit), EDGES_AT_ONCE):
            i, j = at + hit[k:k + EDGES_AT_ONCE] // len(node), hit[k:k + EDGES_AT_ONCE] % len(node)
            w = np.sqrt(np.maximum(np.round(2 - 2 * products(self.x, y, i, j), 12), 0.0))
            w = np.maximum(np.maximum(w, self.core[i]), core[j])
            ok = w <= self.least[self.own[i]]
            i, j, w = i[ok], j[ok], w[ok]
            own, lo, hi = self.own[i], np.minimum(self.node[i], node[j]), np.maximum(self.node[i], node[j])
            order = np.lexsort((hi, lo, w, own))
            for f in order[np.unique(own[order], return_index=True)[1]]:
                edge = (float(w[f]), int(lo[f]), int(hi[f]), int(comp[j[f]]))
                if own[f] not in self.best or edge < self.best[own[f]]:
                    self.best[own[f]] = edge
                    self.least[own[f]] = edge[0]

    def found(self) -> pa.RecordBatch | None:
        if not self.best:
            return None
        rows = [(int(self.names[c]), *edge) for c, edge in self.best.items()]
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=["comp", "w", "lo", "hi", "other"])


def _vectors(b: pa.RecordBatch) -> np.ndarray:
    if b.column("vec").null_count:
        raise ValueError("a row without a vector has no distance")
    return matrix(b.column("vec"))


def search_outside(asking: DataFrame, rows: DataFrame) -> DataFrame:
    """``EDGE``: for components with ``asking(node, comp, core, bound, vec)``,
    the shortest edge up to ``bound`` to ``rows(node, comp, core, vec)`` of
    other components, one or none per task."""
    dims = rows.agg(F.max(F.size("vec"))).first()[0] or 1

    def meet(left: pa.RecordBatch, rights: Iterator[pa.RecordBatch]) -> pa.RecordBatch | None:
        out = Outside(left)
        for right in rights:
            out.meet(right)
        return out.found()

    return block_join(asking, rows, 8 * dims + 40, meet, EDGE, held=True)


def spanning_tree(nodes: DataFrame, lists: DataFrame, core: DataFrame) -> DataFrame:
    """``(lo, hi, w)``: the minimum spanning tree over mutual reachability."""
    spark = nodes.sparkSession
    rows = cut_estimates(nodes.join(core, "node").select("node", "vec", "core", "reach"))
    c = core.select("node", "core")
    listed = (lists.join(c.toDF("src", "cs"), "src").join(c.toDF("dst", "cd"), "dst")
                   .select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"),
                           F.greatest("cs", "cd", "dist").alias("w")).groupBy("lo", "hi").agg(F.min("w").alias("w")))
    listed = cut_estimates(listed)
    comp = cut_estimates(rows.select("node", F.col("node").alias("comp")))
    tree = spark.createDataFrame([], "lo long, hi long, w double")
    left = comp.count()
    first = F.struct("w", "lo", "hi", "other")
    while left > 1:
        out = (listed.join(comp.toDF("lo", "ca"), "lo").join(comp.toDF("hi", "cb"), "hi").where("ca <> cb"))
        out = cut_estimates(out)
        listed = out.select("lo", "hi", "w")
        ends = out.select(F.col("ca").alias("comp"), "w", "lo", "hi", F.col("cb").alias("other")).unionByName(
            out.select(F.col("cb").alias("comp"), "w", "lo", "hi", F.col("ca").alias("other")))
        best = ends.groupBy("comp").agg(F.min(first).alias("e")).select("comp", "e.*")
        best = cut_estimates(best)
        # who asks is found without the vectors, which are joined for them alone
        now = rows.select("node", "reach").where(F.col("reach") < float("inf")).join(comp, "node").join(
            best.select("comp", F.col("w").alias("bound")), "comp", "left").fillna(float("inf"), ["bound"])
        now = cut_estimates(now.where(F.col("reach") <= F.col("bound")).select("node", "comp", "bound"))
        asking = rows.join(now, "node").select("node", "comp", "core", "bound", "vec")
        far = now.agg(F.max("bound")).first()[0]
        if far is not None:
            asking = cut_estimates(asking)
            others = rows.join(comp, "node").where(F.col("core") <= far).select("node", "comp", "core", "vec")
            best = cut_estimates(best.unionByName(search_outside(asking, others))
                                   .groupBy("comp").agg(F.min(first).alias("e")).select("comp", "e.*"))
        tree = cut_estimates(tree.unionByName(best.select("lo", "hi", "w").distinct()))
        joined = connected_components(best.select(F.col("comp").alias("a"), F.col("other").alias("b")), local_edges=ROUND_EDGES)
        comp = cut_estimates(comp.join(joined.toDF("comp", "to"), "comp").select("node", F.col("to").alias("comp")))
        left = comp.select("comp").distinct().count()
    return tree


def grow(nodes: pd.DataFrame, edges: pd.DataFrame, least: int) -> tuple[dict, np.ndarray]:
    """Grow components along the ``edges(a, b, w)`` of one tree; edges of one
    length join all they meet at once.

    ``nodes(comp, size, gain, below, cluster)`` are what is there before:
    ``gain`` sums 1 / distance over a cluster's rows so far, ``below`` the best
    stabilities under it.  Returns the same for the whole tree, and per node
    the selected cluster (its smallest node) that it lies in, or -1.
    """
    n = len(nodes)
    place = {c: i for i, c in enumerate(nodes["comp"].tolist())}
    size, gain, below = (nodes[c].tolist() for c in ("size", "gain", "below"))
    cluster, low = nodes["cluster"].tolist(), nodes["comp"].tolist()
    root = list(range(n))
    parts: list[list[tuple[int, bool]]] = []                # of components n, n + 1, ...: (part, selected)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    edges = edges.sort_values("w")
    length = edges["w"].to_numpy()
    ends = [(place[a], place[b]) for a, b in zip(edges["a"].tolist(), edges["b"].tolist())]
    cuts = [0, *(np.flatnonzero(np.diff(length)) + 1).tolist(), len(length)] if len(length) else [0]
    for begin, end in zip(cuts, cuts[1:]):
        if end == begin + 1:                                # as nearly always: one edge of its length
            groups = [sorted(set(map(find, ends[begin])))]
        else:
            met = Forest()
            for a, b in ends[begin:end]:
                met.unite(find(a), find(b))
            joined: dict[int, list[int]] = {}
            for x in sorted(met.up):
                joined.setdefault(met.find(x), []).append(x)
            groups = list(joined.values())
        lam = 1.0 / max(float(length[begin]), SHORTEST)
        for group in groups:
            large = [x for x in group if cluster[x]]
            total = sum(size[x] for x in group)
            taken: set[int] = set()
            if len(large) > 1:
                best = 0.0
                for x in large:
                    stability = gain[x] - size[x] * lam
                    if stability >= below[x]:
                        taken.add(x)
                    best += max(stability, below[x])
                made = total * lam, best, True
            elif large:
                x = large[0]
                made = gain[x] + (total - size[x]) * lam, below[x], True
            else:
                made = (total * lam if total >= least else 0.0), 0.0, total >= least
            new = len(root)
            root.append(new)
            for x in group:
                root[x] = new
            for column, value in zip((size, gain, below, cluster, low), (total, *made, min(low[x] for x in group))):
                column.append(value)
            parts.append([(x, x in taken) for x in group])
    label = np.full(n, -1, np.int64)
    stack = [(len(root) - 1, -1)]
    while stack:
        i, name = stack.pop()
        if i < n:
            label[i] = name
        else:
            stack += [(x, low[x] if name < 0 and chosen else name) for x, chosen in parts[i - n]]
    end = len(root) - 1
    return dict(size=size[end], gain=gain[end], below=below[end], cluster=cluster[end]), label


def hierarchy_labels(nodes: DataFrame, tree: DataFrame, least: int, band_edges: int = BAND_EDGES) -> DataFrame:
    """``(node, label)``: the selected cluster (smallest node in it) of each
    node of ``nodes(node, weight, core)``; -1 for noise."""
    from tripleselect.operators.select import rank_within
    big = F.col("weight") >= least
    state = cut_estimates(nodes.select(
        F.col("node").alias("comp"), F.col("weight").alias("size"),
        F.when(big, F.col("weight") / F.greatest("core", F.lit(SHORTEST))).otherwise(0.0).alias("gain"),
        F.lit(0.0).alias("below"), big.alias("cluster")))
    edges = tree.count()
    bands = max(1, math.ceil(edges / band_edges))
    if bands > 1:                                           # edges of one length are in one band
        length = rank_within(tree, [], ["w", "lo", "hi"]).groupBy("w").agg(F.min("rank").alias("rank"))
        ranked = tree.join(length, "w").withColumn("band", F.floor((F.col("rank") - 1) / band_edges).cast("int"))
    else:
        ranked = tree.withColumn("band", F.lit(0))
    ranked = cut_estimates(ranked.select("lo", "hi", "w", "band"))
    at = nodes.select("node", F.col("node").alias("comp"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, way = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        end, label = grow(own, way, least)
        return pd.DataFrame({"comp": own["comp"].to_numpy(), "tree": pdf["tree"].iat[0], "label": label,
                             **{k: v for k, v in end.items()}})

    steps = []
    for band in range(bands):
        e = (ranked.where(F.col("band") == band).join(at.toDF("lo", "a"), "lo").join(at.toDF("hi", "b"), "hi").select("a", "b", "w"))
        trees = cut_estimates(connected_components(e, local_edges=ROUND_EDGES)).toDF("comp", "tree")
        own = state.join(trees, "comp").select("tree", F.lit(0).alias("side"), "comp", "size", "gain", "below", "cluster",
                                               F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0.0).alias("w"))
        way = e.join(trees.toDF("a", "tree"), "a").select(
            "tree", F.lit(1).alias("side"), F.lit(0).cast("long").alias("comp"), F.lit(0).cast("long").alias("size"),
            F.lit(0.0).alias("gain"), F.lit(0.0).alias("below"), F.lit(False).alias("cluster"), "a", "b", "w")
        done = cut_estimates(own.unionByName(way).groupBy("tree").applyInPandas(
            run, "comp long, tree long, label long, size long, gain double, below double, cluster boolean"))
        steps.append(done.select("comp", "tree", "label"))
        if band + 1 < bands:
            rest = state.join(done.select("comp"), "comp", "left_anti")
            grown = done.groupBy(F.col("tree")).agg(*[F.first(c).alias(c) for c in ("size", "gain", "below", "cluster")])
            state = cut_estimates(rest.unionByName(grown.withColumnRenamed("tree", "comp")))
            at = cut_estimates(at.join(done.select("comp", "tree"), "comp", "left").select("node", F.coalesce("tree", "comp").alias("comp")))
    # from the last band down: a tree inside a selected cluster is all of it
    above = None
    for done in reversed(steps):
        if above is not None:
            up = above.select(F.col("comp").alias("tree"), F.col("label").alias("top"))
            done = done.join(up, "tree", "left").select("comp", F.when(F.coalesce("top", F.lit(-1)) >= 0, F.col("top"))
                                                        .otherwise(F.col("label")).alias("label"))
            # components that no edge of this band touches are what they are above
            done = done.unionByName(above.join(done.select("comp"), "comp", "left_anti"))
        above = cut_estimates(done.select("comp", "label"))
    return nodes.select("node").join(above.toDF("node", "label"), "node", "left").select(
        "node", F.coalesce("label", F.lit(-1)).alias("label"))


def cluster_density(vectors: DataFrame, min_cluster_size: int, min_samples: int | None = None,
                    graph_k: int | None = None, id_col: str = "triple_id", vec_col: str = "vec",
                    block_rows: int = 2048, band_edges: int = BAND_EDGES) -> DataFrame:
    """(id, cluster_id) with -1 for noise; clusters numbered 0.. by their
    smallest member id.  ``graph_k`` is the length of the lists of nearest
    nodes; it changes the work, not the result."""
    from tripleselect.operators.neighbors import exact_neighbors
    from tripleselect.operators.select import rank_within
    ensure_checkpoint_dir(vectors.sparkSession)
    ms = min_samples or min_cluster_size
    nodes, members = folded(vectors, id_col, vec_col)
    lists = exact_neighbors(nodes, nodes, max(graph_k or 2 * ms, ms), largest=True, exclude_self=True, id_col="node",
                            vec_col="vec", block_rows=block_rows)
    lists = cut_estimates(lists.select("src", "dst", "rank", F.sqrt(F.greatest(F.lit(0.0), F.round(2.0 - 2.0 * F.col("dot"), 12))).alias("dist")))
    core = cut_estimates(core_distances(nodes, lists, ms))
    tree = spanning_tree(nodes, lists, core)
    labels = cut_estimates(hierarchy_labels(nodes.join(core, "node").select("node", "weight", "core"), tree, min_cluster_size, band_edges))
    names = labels.where("label >= 0").select("label").distinct()
    numbered = rank_within(names, [], ["label"], "number").select("label", (F.col("number") - 1).alias("cluster_id"))
    return (members.join(labels, "node").join(numbered, "label", "left")
                   .select(F.col("id").alias(id_col), F.coalesce("cluster_id", F.lit(-1)).cast("int").alias("cluster_id")))
