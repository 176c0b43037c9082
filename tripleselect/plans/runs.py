"""Whole selection jobs: files in, a committed run out.

A job reads triple vectors (parquet) and text triples (TSV), selects, and
commits its run: the sample, its record (parameters, steps, seconds) and, if
texts are given, the selected triples as TSV.  Everything is written under an
attempt of its own; the one manifest row that is appended last makes it
visible.  A job that dies before leaves nothing that a reader sees, and of
several attempts of one run the last one committed counts, so jobs may be run
again at any time.  Writes go through Spark, to any store it can write to.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleselect.operators.cluster import cluster_kmeans
from tripleselect.plans import jobs
from tripleselect.session import cut_lineage
from tripleselect.sources import io

MANIFEST = ("run_id string, attempt string, committed_at double, sampler string, params map<string,string>, n long, steps long, "
            "seconds double, complete boolean")


def commit_run(spark: SparkSession, out: str, run_id: str, samples: DataFrame, record: dict,
               triples: DataFrame | None = None) -> str:
    """Write ``samples(ordinal, triple_id)`` and the texts of its triples, then
    the manifest row.  Returns the attempt's folder."""
    attempt = uuid.uuid4().hex
    folder = f"{out}/attempts/{attempt}"
    samples.select(F.col("ordinal").cast("long").alias("ordinal"), F.col("triple_id").cast("long").alias("triple_id")).write.parquet(
        f"{folder}/samples")
    kept = spark.read.schema("ordinal long, triple_id long").parquet(f"{folder}/samples")
    if triples is not None:
        text = jobs.export_runs(kept.withColumn("run_id", F.lit(run_id)), triples)
        io.write_triples(text.select("query", "psg_pos", "psg_neg"), f"{folder}/triples")
    row = (run_id, attempt, time.time(), record["sampler"], {k: str(v) for k, v in record.get("params", {}).items()}, kept.count(),
           record.get("steps"), float(record["seconds"]), bool(record.get("complete", True)))
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{out}/manifest")
    return folder


def committed_runs(spark: SparkSession, out: str, run_ids: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(samples(run_id, ordinal, triple_id), runs)`` of the last committed
    attempt of every run (or of ``run_ids``)."""
    runs = spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
    if run_ids:
        runs = runs.where(F.col("run_id").isin(run_ids))
    last = Window.partitionBy("run_id").orderBy(F.desc("committed_at"), F.desc("attempt"))
    runs = cut_lineage(runs.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r"))
    folders = [f"{out}/attempts/{r['attempt']}/samples" for r in runs.select("attempt").collect()]    # one row a run
    if not folders:
        return spark.createDataFrame([], "run_id string, ordinal long, triple_id long"), runs
    rows = spark.read.schema("ordinal long, triple_id long").parquet(*folders)
    rows = rows.withColumn("attempt", F.regexp_extract(F.col("_metadata.file_path"), r"attempts/([0-9a-f]{32})/", 1))
    return rows.join(runs.select("run_id", "attempt"), "attempt").select("run_id", "ordinal", "triple_id"), runs


def report(spark: SparkSession, out: str, vectors: DataFrame, csv: str | None = None) -> DataFrame:
    """E11 over the committed runs: ``run_id, sampler, n, steps, seconds,
    complete, avg_sim``; also written as CSV if a folder is given."""
    from tripleselect.operators.evaluate import summarize_runs
    samples, runs = committed_runs(spark, out)
    got = summarize_runs(samples, runs.select("run_id", "sampler", "steps", "seconds", "complete"), vectors)
    got = got.select("run_id", "sampler", "n", "steps", "seconds", "complete", "avg_sim")
    if csv:
        io.write_metrics(got.select(F.col("run_id").alias("file"), F.col("seconds").alias("time(s)"), "steps", "avg_sim").coalesce(1), csv)
    return got


def _numbered(picked: DataFrame) -> DataFrame:
    """Selected rows in order of cluster and rank."""
    from tripleselect.operators.select import rank_within
    return rank_within(picked.select("triple_id", "cluster_id", F.col("rank").alias("place")), [], ["cluster_id", "place", "triple_id"],
                       "ordinal")


def _clustered(select: Callable) -> Callable:
    """A job of cluster, rank, quota: clusters are given or fitted."""
    def run(vectors: DataFrame, triples: DataFrame | None, budget: int, nclust: int, seed: int = 0,
            assignments: DataFrame | None = None, max_iter: int = 20, **more) -> tuple[DataFrame, dict]:
        given = assignments if assignments is not None else cut_lineage(cluster_kmeans(vectors, nclust, max_iter, seed))
        return _numbered(select(vectors, triples, given, budget, nclust, seed, **more)), {}
    return run


def _qpos(vectors: DataFrame, triples: DataFrame, budget: int, nclust: int, dim: int, seed: int = 0, **more) -> tuple[DataFrame, dict]:
    return _numbered(jobs.select_cluster_bm25_qpos(triples, vectors, budget, nclust, dim, seed, **more)), {}


def _density(vectors: DataFrame, triples: DataFrame, budget: int, nclust: int, seed: int = 0, min_samples: int | None = None,
             **more) -> tuple[DataFrame, dict]:
    from tripleselect.operators.density import cluster_density
    groups = cut_lineage(cluster_density(vectors, max(2, budget // nclust), min_samples))
    return _numbered(jobs.select_density_bm25_margin(triples, groups, budget, nclust, seed, **more)), {}


def _accept(vectors: DataFrame, triples: DataFrame | None, budget: int, seed: int = 0, **more) -> tuple[DataFrame, dict]:
    from tripleselect.operators.accept import accept_sample
    got = accept_sample(vectors, budget, seed=seed, **more)
    return got.samples, got.run


def _markov(vectors: DataFrame, triples: DataFrame | None, budget: int, n: int = 1, seed: int = 0, dim: int | None = None,
            alpha: float | None = None, beta: float = 1.0, cells: str | None = None, lazy: bool = False,
            **more) -> tuple[DataFrame, dict]:
    """The walk over vectors weighted by ``alpha`` and ``beta`` (if given);
    ``cells`` is the folder of a stored index, whose vectors may be weighted
    otherwise; ``lazy`` searches a state when it is first visited."""
    from tripleselect.functions.vectors import weight_vectors
    from tripleselect.operators.cellindex import CellIndex
    from tripleselect.operators.markov import markov_sample
    from tripleselect.operators.neighbors import antipodal_neighbors
    x = vectors.select("triple_id", "vec")
    if alpha is not None:
        x = cut_lineage(weight_vectors(x, "vec", dim, alpha, beta))
    index = CellIndex.open(x.sparkSession, cells) if cells else None

    def search(states: DataFrame) -> DataFrame:
        q = states.select(F.col("state").alias("triple_id")).join(x, "triple_id")
        return index.search(q, n, largest=False) if index else antipodal_neighbors(q, x, n)

    moves = search if lazy else search(x.select(F.col("triple_id").alias("state")))
    return markov_sample(moves, budget, seed=seed, vectors=x, **more)


def _subset(vectors: DataFrame, triples: DataFrame | None, portion: float, seed: int = 0) -> tuple[DataFrame, dict]:
    ids = triples if triples is not None else vectors
    got = jobs.subset_random(ids.select("triple_id"), portion, 1, seed).select("triple_id", F.lit(0).alias("cluster_id"), F.lit(0).alias("rank"))
    return _numbered(got), {}


JOBS: dict[str, Callable] = {
    "cluster_bm25": _clustered(lambda v, t, a, *p, **m: jobs.select_cluster_bm25(t, a, *p, **m)),
    "cluster_bm25_qpos": _qpos,
    "cluster_bm25_margin": _clustered(lambda v, t, a, *p, **m: jobs.select_cluster_bm25_margin(t, a, *p, **m)),
    "cluster_bm25_smoothed": _clustered(lambda v, t, a, *p, **m: jobs.select_cluster_bm25_smoothed(t, a, *p, **m)),
    "cluster_cosine": _clustered(lambda v, t, a, budget, nclust, seed, dim: jobs.select_cluster_cosine(v, a, budget, nclust, dim, seed)),
    "density_bm25_margin": _density, "accept": _accept, "markov": _markov, "subset": _subset,
}


def run_job(spark: SparkSession, job: str, out: str, run_id: str, vectors: str | None = None, triples: str | None = None,
            **params) -> str:
    """Read the input files, run one of ``JOBS`` and commit its run; returns
    the attempt's folder.  ``vectors`` is a parquet folder of (triple_id, vec),
    ``triples`` one of headerless TSV, whose rows are numbered in order."""
    t0 = time.time()
    v = io.read_vectors(spark, vectors) if vectors else None
    t = cut_lineage(io.read_triples(spark, triples, kind="text")) if triples else None
    samples, info = JOBS[job](v, t, **params)
    samples = cut_lineage(samples.select("ordinal", "triple_id"))
    plain = {k: p for k, p in params.items() if isinstance(p, (str, int, float, bool))}
    record = dict(sampler=job, params=plain, steps=info.get("steps"), complete=info.get("complete", True), seconds=time.time() - t0)
    return commit_run(spark, out, run_id, samples, record, t)
