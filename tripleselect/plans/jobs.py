"""End-to-end selection jobs (cluster → rank → quota → exact-size sample).

Each job is one lazy plan; the reference's per-cluster loop becomes a
partition key.  Scalars that steer quotas (median / mean cluster size, total
rows) are aggregated over the K-row size table only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleselect.functions.rand import hash_key
from tripleselect.functions.vectors import cosine_margin
from tripleselect.operators.select import (bonus_quota, cluster_sizes, flat_quota, per_cluster,
                                           sample_exact, smallest_n_per_group, smoothed_quota, top_k_per_group)


def _select(scored: DataFrame, assignments: DataFrame, budget: int, nclust: int, seed: int,
            quota: str = "bonus", center: str = "median", rounding: str = "floor",
            sample: str = "always", cluster_col: str = "cluster_id") -> DataFrame:
    """Shared tail: rank by ``score`` ascending inside clusters, cut each
    cluster at its quota, then draw exactly ``budget`` rows (seeded)."""
    sizes = cluster_sizes(assignments.withColumnRenamed(cluster_col, "cluster_id"))
    q = per_cluster(budget, nclust, rounding)
    if quota == "bonus":
        quotas = bonus_quota(sizes, q, center)
    elif quota == "smoothed":
        quotas = smoothed_quota(sizes, budget, nclust)
    else:
        quotas = flat_quota(sizes, q)
    # each cluster keeps its first ``quota`` rows by (rounded score, id): a
    # salted two-phase top-k, so a cluster holding a third of the rows is
    # still cut by many tasks
    withq = scored.where(F.col("cluster_id") >= 0).join(quotas.select("cluster_id", "quota"), "cluster_id")
    picked = top_k_per_group(withq, ["cluster_id"], [F.round("score", 9)], "quota", "triple_id").drop("quota")
    # smoothed quotas down-sample only when they over-allocate; sample_exact
    # returns everything when there are fewer than ``budget`` rows, so one
    # call covers both cases
    return sample_exact(picked, budget, seed)


def select_cluster_cosine(vectors: DataFrame, assignments: DataFrame, budget: int, nclust: int,
                          dim: int, seed: int = 0, center: str = "median") -> DataFrame:
    """Rank triples inside clusters by cosine margin cos(q,p+) - cos(q,p-)
    (smallest = hardest first), keep a median-bonus quota per cluster, draw
    ``budget`` rows.  Returns (triple_id, cluster_id, rank, score)."""
    scored = (vectors.select("triple_id", "vec").join(assignments.select("triple_id", "cluster_id"), "triple_id")
                     .select("triple_id", "cluster_id", cosine_margin("vec", dim).alias("score")))
    return _select(scored, assignments, budget, nclust, seed, quota="bonus", center=center)


def select_cluster_cosine_multi(vectors: DataFrame, assignments: DataFrame, budget: int, dim: int, seed: int = 0) -> DataFrame:
    """The cosine-margin selection for several cluster counts in one plan
    (E5): ``assignments(nclust, triple_id, cluster_id)``.  Scores are computed
    once; ranks, median-bonus quotas and exact samples are keyed by count.
    (nclust, triple_id, cluster_id, rank, score)."""
    score = vectors.select("triple_id", cosine_margin("vec", dim).alias("score"))
    scored = score.join(assignments.where(F.col("cluster_id") >= 0), "triple_id")
    sizes = scored.groupBy("nclust", "cluster_id").agg(F.count(F.lit(1)).alias("size"))
    scale = sizes.groupBy("nclust").agg(F.median("size").cast("double").alias("scale"))
    q = F.floor(F.lit(budget) / F.col("nclust"))
    bonus = F.when((F.col("size") > F.col("scale")) & (q > 0), F.floor(F.col("scale") / q)).otherwise(0)
    quotas = sizes.join(scale, "nclust").select("nclust", "cluster_id", (q + bonus).cast("int").alias("quota"))
    picked = top_k_per_group(scored.join(quotas, ["nclust", "cluster_id"]), ["nclust", "cluster_id"], [F.round("score", 9)],
                             "quota", "triple_id").drop("quota")
    keyed = picked.withColumn("__key", hash_key(seed, "triple_id"))
    return smallest_n_per_group(keyed, ["nclust"], "__key", budget, "triple_id").select(
        "nclust", "triple_id", "cluster_id", "rank", "score")


def _bm25_scored(triples: DataFrame, assignments: DataFrame, sides: tuple[str, ...], stats, margin: bool,
                 scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(triple_id, score, cluster_id).  ``scorer`` takes the place of BM25: it
    gets (triple_id, side, query, passage, cluster_id) and returns
    (triple_id, side, score), one row per pair."""
    from tripleselect.operators.bm25 import bm25_margin, bm25_pairs, bm25_stats, query_vocab, to_pairs
    t = triples.join(assignments.select("triple_id", "cluster_id"), "triple_id")
    pairs = to_pairs(t, sides, keep=("cluster_id",))
    if scorer is not None:
        scores = scorer(pairs)
        scores = bm25_margin(scores) if margin else scores.select("triple_id", "score")
        return scores.join(assignments.select("triple_id", "cluster_id"), "triple_id")
    if isinstance(stats, str) and stats == "cluster":
        # statistics from the scored passages of each cluster, each side a
        # collection of its own
        st = bm25_stats(pairs.select("cluster_id", "side", F.col("passage").alias("text")), "text",
                        ("cluster_id", "side"), vocab=query_vocab(pairs))
    else:
        # statistics from a background collection of (text) rows, for the
        # query terms only
        st = bm25_stats(stats, "text", vocab=query_vocab(pairs))
    scores = bm25_pairs(pairs.drop("cluster_id") if not st.scope else pairs, st)
    scores = bm25_margin(scores) if margin else scores.select("triple_id", "score")
    return scores.join(assignments.select("triple_id", "cluster_id"), "triple_id")


def select_cluster_bm25(triples: DataFrame, assignments: DataFrame, budget: int, nclust: int, seed: int = 0,
                        stats="cluster", rounding: str = "floor",
                        scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Clean text, score each positive passage against its query by BM25,
    keep the lowest-scoring (hardest) triples per cluster under a
    median-bonus quota, draw ``budget``.  (triple_id, cluster_id, rank, score)."""
    scored = _bm25_scored(triples, assignments, ("pos",), stats, False, scorer)
    return _select(scored, assignments, budget, nclust, seed, quota="bonus", center="median", rounding=rounding)


def select_cluster_bm25_qpos(triples: DataFrame, vectors: DataFrame, budget: int, nclust: int, dim: int,
                             seed: int = 0, stats="cluster", assignments: DataFrame | None = None,
                             max_iter: int = 20) -> DataFrame:
    """As :func:`select_cluster_bm25` but clusters are formed on the query
    and positive blocks only, and the per-cluster quota rounds up."""
    from tripleselect.functions.vectors import vector_view
    from tripleselect.operators.cluster import cluster_kmeans
    if assignments is None:
        view = vectors.select("triple_id", vector_view("vec", dim, "pos").alias("vec"))
        assignments = cluster_kmeans(view, nclust, max_iter, seed)
    return select_cluster_bm25(triples, assignments, budget, nclust, seed, stats, rounding="ceil")


def select_cluster_bm25_margin(triples: DataFrame, assignments: DataFrame, budget: int, nclust: int,
                               seed: int = 0, stats="cluster", scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Score = BM25(positive) - BM25(negative) (joined by id), mean-bonus quota."""
    scored = _bm25_scored(triples, assignments, ("pos", "neg"), stats, True, scorer)
    return _select(scored, assignments, budget, nclust, seed, quota="bonus", center="mean")


def select_cluster_bm25_smoothed(triples: DataFrame, assignments: DataFrame, budget: int, nclust: int,
                                 seed: int = 0, stats="cluster", scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """BM25 margin with smoothed quotas ``floor((n_c + a) / (N + K) * budget)``;
    down-sampled only when the quotas over-allocate."""
    scored = _bm25_scored(triples, assignments, ("pos", "neg"), stats, True, scorer)
    return _select(scored, assignments, budget, nclust, seed, quota="smoothed")


def select_density_bm25_margin(triples: DataFrame, assignments: DataFrame, budget: int, nclust: int,
                               seed: int = 0, stats="cluster", scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Density clusters (noise = -1 never selected), BM25 margin, flat quota
    ``budget // nclust`` per cluster, draw ``budget``."""
    scored = _bm25_scored(triples, assignments.where(F.col("cluster_id") >= 0), ("pos", "neg"), stats, True, scorer)
    return _select(scored, assignments, budget, nclust, seed, quota="flat")


def export_runs(samples: DataFrame, triples: DataFrame, prefix: str | None = None, suffix: str = ".pkl") -> DataFrame:
    """Text of every run (E10): (run, ordinal, query, psg_pos, psg_neg),
    run = run id without its suffix, optionally ``prefix.``-qualified;
    fields made TSV-safe.  Write with ``io.write_triples(..., partition_by="run")``."""
    from tripleselect.functions.text import run_name, tsv_safe
    from tripleselect.operators.select import take
    t = take(triples.select("triple_id", "query", "psg_pos", "psg_neg"), samples.select("run_id", "ordinal", "triple_id"))
    return t.select(run_name("run_id", prefix, suffix).alias("run"), "ordinal", "triple_id",
                    *[tsv_safe(c).alias(c) for c in ("query", "psg_pos", "psg_neg")])


def subset_random(triples: DataFrame, portion: float, dupes: int, seed: int = 0, suffix: str = "train") -> DataFrame:
    """E9: ``dupes`` uniform subsets of ``portion`` percent each, with the
    output name ``triples.<suffix>.<replica>`` per row."""
    from tripleselect.operators.select import subsets
    s = subsets(triples, portion, dupes, seed)
    return s.withColumn("run", F.concat_ws(".", F.lit("triples"), F.lit(suffix), F.col("replica").cast("string")))
