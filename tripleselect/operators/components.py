"""Connected components of an undirected edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleselect.session import cut_lineage

#: Edge lists up to here (checked) are united by one task; longer ones in rounds of shuffles.
LOCAL_EDGES = 50_000


class Forest:
    """Union-find over any hashable nodes; a root is the smallest node of its tree."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def unite(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = [pdf for pdf in batches if len(pdf)]
    ends = np.concatenate([pdf[c].to_numpy(np.int64) for c in ("u", "v") for pdf in held]) if held else np.empty(0, np.int64)
    nodes, at = np.unique(ends, return_inverse=True)
    u, v = at[:len(at) // 2], at[len(at) // 2:]
    up = np.arange(len(nodes))
    while len(u):                                           # hang the larger root of each edge on the smaller, then shorten all ways
        np.minimum.at(up, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(far := up[up], up):
            up = far
        u, v = up[u], up[v]
        u, v = u[u != v], v[u != v]
    yield pd.DataFrame({"node": nodes, "comp": nodes[up]})


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", local_edges: int | None = None) -> DataFrame:
    """``(node, comp)`` for every (long) node of an undirected edge list,
    ``comp`` being the smallest node of its component.  Null ends and loops
    are ignored; an empty list gives no rows.  Up to ``local_edges``
    (``LOCAL_EDGES``) edges are united by one task.

    Long lists go through alternating large-star / small-star rounds: each
    re-hangs a node's larger (smaller) neighbours on its smallest one, so a
    long chain halves with every round, until nothing changes.
    """
    e = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct())
    if e.count() <= (LOCAL_EDGES if local_edges is None else local_edges):
        return e.repartition(1).mapInPandas(_united, "node long, comp long")
    nodes, before = e, None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (both.where(F.col("v") > F.col("u")).join(low, "u")
                     .select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        e = cut_lineage(large.join(down, "u").select(F.explode(pair).alias("x")).select("x.*")
                             .where(F.col("u") != F.col("v")).distinct())
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    seen = nodes.select(F.col("u").alias("node")).unionByName(nodes.select(F.col("v").alias("node"))).distinct()
    return (seen.join(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp")), "node", "left")
                .select("node", F.coalesce("comp", "node").alias("comp")))
