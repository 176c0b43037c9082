"""Properties of ranking, exact samples, quotas and the diversity closed form."""
import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF01
from tripleselect.operators.evaluate import mean_pairwise_cosine
from tripleselect.operators.select import (bonus_quota, cluster_sizes, rank_within, sample_exact, subsets,
                                           top_k_per_group)
from tripleselect.sources import fixtures as fx


def _skewed(spark):
    # one group holds a third of the rows
    return spark.range(0, 3000).select(F.col("id").alias("triple_id"),
                                       F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 17).alias("g"),
                                       (F.hash("id") % 1000).alias("s"))


def test_rank_within_matches_row_number(spark):
    df = _skewed(spark)
    got = {(r.triple_id, r.rank) for r in rank_within(df, ["g"], ["s", "triple_id"]).collect()}
    w = Window.partitionBy("g").orderBy("s", "triple_id")
    want = {(r.triple_id, r.rank) for r in df.withColumn("rank", F.row_number().over(w)).collect()}
    assert got == want


def test_top_k_matches_plain_window(spark):
    df = _skewed(spark)
    got = {(r.triple_id, r.rank) for r in top_k_per_group(df, ["g"], [F.col("s")], 25, "triple_id").collect()}
    w = Window.partitionBy("g").orderBy("s", "triple_id")
    want = {(r.triple_id, r.rank) for r in df.withColumn("rank", F.row_number().over(w)).where("rank <= 25").collect()}
    assert got == want


def test_sample_exact_size_uniqueness_and_partition_independence(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "triple_id")
    a = [r.triple_id for r in sample_exact(df.repartition(1), 123, 9).collect()]
    b = [r.triple_id for r in sample_exact(df.repartition(7), 123, 9).collect()]
    assert len(a) == 123 and len(set(a)) == 123 and set(a) == set(b)
    assert sample_exact(df, 10000, 9).count() == 5000


def test_subsets_sizes(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "triple_id")
    s = subsets(df, 7, 4, 3)
    sizes = {r.replica: r.c for r in s.groupBy("replica").agg(F.count("*").alias("c")).collect()}
    assert sizes == {0: 70, 1: 70, 2: 70, 3: 70}
    assert s.groupBy("replica", "triple_id").count().where("count > 1").count() == 0


def test_bonus_quota_edge_clusters(spark):
    # one empty (absent), one tiny and one oversized cluster
    a = spark.createDataFrame([(i, 0) for i in range(3)] + [(100 + i, 1) for i in range(200)] + [(500 + i, 2) for i in range(20)],
                              "triple_id long, cluster_id int")
    q = {r.cluster_id: r.quota for r in bonus_quota(cluster_sizes(a), 10).collect()}
    assert q == {0: 10, 1: 12, 2: 10}


def test_mean_pairwise_cosine_closed_form_equals_brute_force(spark):
    tv = fx.triple_vectors(spark, SF01).select("triple_id", "vec")
    samples = tv.select(F.lit("r").alias("run_id"), "triple_id")
    got = mean_pairwise_cosine(samples, tv).first()["avg_sim"]
    X = np.stack([np.asarray(r.vec, dtype=np.float64) for r in tv.collect()])
    Xh = X / np.linalg.norm(X, axis=1, keepdims=True)
    assert abs(got - float((Xh @ Xh.T).mean())) < 1e-12


def test_rank_within_with_payload_equals_row_number(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from tripleselect.operators.select import rank_within
    df = spark.range(200_000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"),
        (F.xxhash64("id") % 1000).alias("score"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("payload"))
    got = rank_within(df, ["g"], ["score", "id"], "r")
    want = F.row_number().over(Window.partitionBy("g").orderBy("score", "id"))
    assert got.count() == 200_000
    assert got.withColumn("w", want).where("r <> w").count() == 0
