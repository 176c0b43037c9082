"""Whole jobs: files in, a committed run out, read back by the report."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleselect.plans import runs
from tripleselect.sources import io


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    rng = np.random.default_rng(0)
    vecs = [(i, [float(x) for x in rng.normal(size=6) + 3 * np.eye(6)[i % 3]]) for i in range(90)]
    io.write_vectors(spark.createDataFrame(vecs, "triple_id long, vec array<float>"), str(d / "v"))
    words = [f"w{i}" for i in range(40)]
    text = [(" ".join(rng.choice(words, 4)), " ".join(rng.choice(words, 12)), " ".join(rng.choice(words, 12))) for _ in range(90)]
    io.write_triples(spark.createDataFrame(text, "query string, psg_pos string, psg_neg string").coalesce(1), str(d / "t"))
    return str(d / "v"), str(d / "t"), text


@pytest.mark.parametrize("job, params", [
    ("cluster_bm25", dict(budget=12, nclust=3, max_iter=3)), ("cluster_bm25_margin", dict(budget=12, nclust=3, max_iter=3)),
    ("cluster_bm25_smoothed", dict(budget=12, nclust=3, max_iter=3)), ("cluster_cosine", dict(budget=12, nclust=3, dim=2, max_iter=3)),
    ("density_bm25_margin", dict(budget=12, nclust=3, min_samples=3)), ("accept", dict(budget=12, k=4, t=0.9)),
    ("markov", dict(budget=12, n=3, walkers=4, lazy=True)), ("subset", dict(portion=20.0))])
def test_job_commits_a_run(spark, tmp_path, files, job, params):
    vectors, triples, text = files
    out = str(tmp_path / "out")
    folder = runs.run_job(spark, job, out, f"{job}.run", vectors, triples, **params)
    samples, record = runs.committed_runs(spark, out)
    ids = [r.triple_id for r in samples.orderBy("ordinal").collect()]
    r = record.first()
    assert r.sampler == job and r.n == len(ids) == len(set(ids)) > 0 and r.seconds > 0
    if "budget" in params:
        assert len(ids) <= 12 and r.params["budget"] == "12"
    assert (r.steps is not None) == (job in ("accept", "markov"))
    got = io.read_triples(spark, f"{folder}/triples", kind="text").collect()
    assert sorted((x.query, x.psg_pos, x.psg_neg) for x in got) == sorted(text[i] for i in ids)


def test_only_the_last_committed_attempt_counts(spark, tmp_path, files):
    vectors, _, _ = files
    out = str(tmp_path / "out")
    one = spark.createDataFrame([(1, 5), (2, 7)], "ordinal long, triple_id long")
    two = spark.createDataFrame([(1, 9)], "ordinal long, triple_id long")
    runs.commit_run(spark, out, "a", one, dict(sampler="x", seconds=1.5, steps=4))
    runs.commit_run(spark, out, "b", one, dict(sampler="x", seconds=2.0, complete=False))
    two.write.parquet(f"{out}/attempts/{'0' * 32}/samples")              # an attempt that died before its manifest row
    runs.commit_run(spark, out, "a", two, dict(sampler="y", seconds=3.0, steps=6, params=dict(t=0.5)))
    samples, record = runs.committed_runs(spark, out)
    assert sorted((r.run_id, r.triple_id) for r in samples.collect()) == [("a", 9), ("b", 5), ("b", 7)]
    assert {(r.run_id, r.sampler, r.steps, r.n) for r in record.collect()} == {("a", "y", 6, 1), ("b", "x", None, 2)}
    got = {r.run_id: r for r in runs.report(spark, out, io.read_vectors(spark, vectors), str(tmp_path / "csv")).collect()}
    assert got["a"].steps == 6 and got["a"].seconds == 3.0 and got["a"].complete and abs(got["a"].avg_sim - 1) < 1e-6
    assert not got["b"].complete and got["b"].avg_sim < 1
    head = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert head.columns == ["file", "time(s)", "steps", "avg_sim"] and head.count() == 2
    assert [r.run_id for r in runs.committed_runs(spark, out, ["b"])[1].collect()] == ["b"]


def test_walk_on_an_index_of_other_vectors(spark, tmp_path, files):
    """Weighted queries on a stored index of unweighted vectors."""
    from tripleselect.functions.vectors import weight_vectors
    from tripleselect.operators.cellindex import CellIndex
    from tripleselect.operators.markov import markov_sample
    from tripleselect.operators.neighbors import antipodal_neighbors
    vectors, _, _ = files
    x = io.read_vectors(spark, vectors)
    CellIndex.build(x, 4, str(tmp_path / "cells"), max_iter=3)
    out = str(tmp_path / "out")
    runs.run_job(spark, "markov", out, "m", vectors, budget=10, n=3, walkers=2, dim=2, alpha=0.5, beta=0.3, cells=str(tmp_path / "cells"))
    got = [r.triple_id for r in runs.committed_runs(spark, out)[0].orderBy("ordinal").collect()]
    w = weight_vectors(x, "vec", 2, 0.5, 0.3)
    moves = antipodal_neighbors(w, x.withColumn("vec", F.col("vec").cast("array<double>")), 3)
    want, _ = markov_sample(moves, 10, walkers=2, seed=0)
    assert got == [r.triple_id for r in want.orderBy("ordinal").collect()]
