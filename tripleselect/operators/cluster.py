"""Clustering: centroid assignment, spherical k-means, sweeps over k.

Centroids are K x d with K a parameter; they are size-checked before they
are broadcast.  Assignment is one Arrow-batched matrix product per batch of
rows (``mapInPandas``), so a row is never paired with centroids as rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleselect.functions.vectors import with_l2_normalized

MAX_BROADCAST_FLOATS = 50_000_000   # 400 MB of doubles


def centroid_matrix(centroids: DataFrame, cell_col: str = "cell", vec_col: str = "vec") -> tuple[np.ndarray, np.ndarray]:
    """Collect a K x d centroid table after checking its size."""
    k = centroids.count()
    first = centroids.select(F.size(vec_col)).first()
    d = int(first[0]) if first else 0
    if k * d > MAX_BROADCAST_FLOATS:
        raise ValueError(f"{k} centroids x {d} dims exceed the broadcast bound; use fewer cells")
    pdf = centroids.select(cell_col, vec_col).orderBy(cell_col).toPandas()
    cells = pdf[cell_col].to_numpy(dtype=np.int64)
    mat = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vec_col]]) if len(pdf) else np.zeros((0, d))
    return cells, mat


def assign_clusters(vectors: DataFrame, centroids: DataFrame, id_col: str = "triple_id",
                    vec_col: str = "vec", cell_col: str = "cell", out_col: str = "cluster_id",
                    normalize: bool = True) -> DataFrame:
    """(id, cluster_id, sim): each vector goes to the centroid of largest
    inner product (cosine when ``normalize``; rows are normalised on the
    fly), ties to the smallest cell id."""
    spark = vectors.sparkSession
    cells, mat = centroid_matrix(centroids, cell_col, vec_col)
    if normalize and len(mat):
        nrm = np.linalg.norm(mat, axis=1, keepdims=True)
        mat = np.where(nrm > 0, mat / np.where(nrm > 0, nrm, 1), 0.0)
    b = spark.sparkContext.broadcast((cells, mat))

    def run(it):
        cs, m = b.value
        for pdf in it:
            if len(pdf) == 0:
                continue
            x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vec_col]])
            if normalize:
                nx = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.where(nx > 0, x / np.where(nx > 0, nx, 1), 0.0)
            s = x @ m.T
            j = np.argmax(s, axis=1)          # first maximum = smallest cell (cells sorted)
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), out_col: cs[j].astype(np.int32),
                                "sim": s[np.arange(len(j)), j]})

    return vectors.select(id_col, vec_col).mapInPandas(run, f"{id_col} long, {out_col} int, sim double")


def mean_centroids(vectors: DataFrame, group_col: str, vec_col: str = "vec", cell_col: str = "cell") -> DataFrame:
    """(cell, vec): normalised mean vector of each group - element sums are
    aggregated per (group, position), never by collecting a group."""
    # explode the column as stored (a generator over a computed array would
    # re-evaluate it per element)
    pos = vectors.select(F.col(group_col).alias(cell_col), F.posexplode(vec_col).alias("pos", "x"))
    agg = pos.groupBy(cell_col, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    arr = (agg.groupBy(cell_col).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("px"))
              .select(cell_col, F.transform("px", lambda s: s["x"]).alias(vec_col)))
    return with_l2_normalized(arr, vec_col)


def spherical_kmeans(vectors: DataFrame, k: int, max_iter: int = 20, seed: int = 0,
                     vec_col: str = "vec") -> DataFrame:
    """(cell, vec) centroids of cosine k-means (MLlib ``KMeans`` with the
    cosine distance on normalised rows).  Zero vectors have no direction and
    are not fitted on; if there are only such, one zero centroid."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    turned = vectors.where(F.exists(vec_col, lambda x: x != 0))
    one = turned.select(vec_col).first()
    if one is None:
        d = vectors.agg(F.max(F.size(vec_col))).first()[0] or 0
        return vectors.sparkSession.createDataFrame([(0, [0.0] * d)], "cell int, vec array<double>")
    data = with_l2_normalized(turned.select(vec_col), vec_col).select(array_to_vector(vec_col).alias("features"))
    model = KMeans(k=k, maxIter=max_iter, seed=seed, distanceMeasure="cosine", featuresCol="features").fit(data)
    spark = vectors.sparkSession
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    cents = spark.createDataFrame(rows, "cell int, vec array<double>")
    return with_l2_normalized(cents, vec_col)


def cluster_kmeans(vectors: DataFrame, k: int, max_iter: int = 20, seed: int = 0,
                   id_col: str = "triple_id", vec_col: str = "vec") -> DataFrame:
    """(id, cluster_id): fit spherical k-means, then assign every row."""
    cents = spherical_kmeans(vectors, k, max_iter, seed, vec_col)
    return assign_clusters(vectors, cents, id_col, vec_col).select(id_col, "cluster_id")


def sweep_clusters(vectors: DataFrame, ks: list[int], max_iter: int = 20, seed: int = 0,
                   id_col: str = "triple_id", vec_col: str = "vec") -> DataFrame:
    """(nclust, id, cluster_id) for several cluster counts; one fit per k,
    downstream work keyed by ``nclust`` in a single pass."""
    out = None
    for k in ks:
        a = cluster_kmeans(vectors, k, max_iter, seed, id_col, vec_col).withColumn("nclust", F.lit(k))
        out = a if out is None else out.unionByName(a)
    return out.select("nclust", id_col, "cluster_id")


# ------------------------------------------------------------------ several cluster counts at once

def start_centroids(vectors: DataFrame, ks: list[int], seed: int = 0, id_col: str = "triple_id", vec_col: str = "vec") -> DataFrame:
    """(nclust, cell, vec): for every count ``k`` the unit vectors of the
    ``k`` rows of the least seeded key (all rows, if fewer), cells in that
    order.  Zero vectors have no direction and start no cell."""
    from tripleselect.functions.rand import hash_key
    from tripleselect.operators.select import rank_within, smallest_n
    turned = vectors.where(F.exists(vec_col, lambda x: x != 0)).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    out = None
    for k in sorted(set(ks)):
        keyed = turned.withColumn("key", hash_key(f"{seed}:{k}", "id"))
        picked = rank_within(smallest_n(keyed, k, "key", "id"), [], ["key", "id"], "cell")
        picked = picked.select(F.lit(k).alias("nclust"), (F.col("cell") - 1).alias("cell"), "vec")
        out = picked if out is None else out.unionByName(picked)
    return with_l2_normalized(out, "vec")


class Centroids:
    """The centroids of several counts, size-checked: cell ids and a matrix per count."""

    def __init__(self, centroids: DataFrame):
        n, d = centroids.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
        if n * (d or 0) > MAX_BROADCAST_FLOATS:
            raise ValueError(f"{n} centroids x {d} dims exceed the broadcast bound; use fewer cells")
        pdf = centroids.select("nclust", "cell", "vec").orderBy("nclust", "cell").toPandas()
        self.of = {int(k): (g["cell"].to_numpy(np.int64), np.stack(g["vec"].to_numpy()).astype(np.float64))
                   for k, g in pdf.groupby("nclust")}

    def nearest(self, x: np.ndarray) -> dict[int, np.ndarray]:
        """Row positions of the cells of largest cosine, ties to the smallest cell, per count."""
        size = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
        return {k: np.argmax(np.round(x @ m.T, 12), axis=1) for k, (_, m) in self.of.items()}


def lloyd(vectors: DataFrame, starts: DataFrame, rounds: int, vec_col: str = "vec") -> DataFrame:
    """(nclust, cell, vec): spherical k-means of several counts after
    ``rounds`` rounds from the ``starts``.

    One scan a round serves all counts: every task adds up its rows' unit
    vectors per count and cell, and only these sums are shuffled.  A cell
    without rows keeps its centroid; zero vectors move none."""
    spark = vectors.sparkSession
    now = Centroids(starts)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(now)

        def run(batches):
            c = sent.value
            sums = {k: np.zeros_like(m) for k, (_, m) in c.of.items()}
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
                size = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
                for k, at in c.nearest(x).items():
                    np.add.at(sums[k], at, x)
            for k, (cells, _) in c.of.items():
                yield pd.DataFrame({"nclust": np.int32(k), "cell": cells.astype(np.int32), "vec": list(sums[k])})

        part = vectors.select(F.col(vec_col).alias("vec")).mapInPandas(run, "nclust int, cell int, vec array<double>")
        total = part.select("nclust", "cell", F.posexplode("vec").alias("pos", "x")).groupBy("nclust", "cell", "pos").agg(
            F.sum("x").alias("x"))
        got = total.groupBy("nclust", "cell").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("px")).select(
            "nclust", "cell", F.transform("px", lambda s: s["x"]).alias("vec")).toPandas()     # as many rows as centroids
        for k, g in got.groupby("nclust"):
            cells, m = now.of[int(k)]
            at = np.searchsorted(cells, g["cell"].to_numpy(np.int64))
            v = np.stack(g["vec"].to_numpy())
            size = np.linalg.norm(v, axis=1, keepdims=True)
            m = m.copy()
            m[at] = np.where(size > 1e-12, v / np.where(size > 1e-12, size, 1.0), m[at])
            now.of[int(k)] = (cells, m)
    rows = [(k, int(c), [float(x) for x in v]) for k, (cells, m) in now.of.items() for c, v in zip(cells, m)]
    return spark.createDataFrame(rows, "nclust int, cell int, vec array<double>")


def assign_sweep(vectors: DataFrame, centroids: DataFrame, id_col: str = "triple_id", vec_col: str = "vec") -> DataFrame:
    """(nclust, id, cluster_id): every row's cell for every count, in one scan."""
    sent = vectors.sparkSession.sparkContext.broadcast(Centroids(centroids))

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            ids = pdf["id"].to_numpy()
            for k, at in sent.value.nearest(np.stack(pdf["vec"].to_numpy()).astype(np.float64)).items():
                yield pd.DataFrame({"nclust": np.int32(k), id_col: ids, "cluster_id": sent.value.of[k][0][at].astype(np.int32)})

    return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).mapInPandas(
        run, f"nclust int, {id_col} long, cluster_id int")
