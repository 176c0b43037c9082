"""Ranking, quotas, exact-size samples and take-by-index.

Two building blocks keep every ordering distributed, even when one group
holds a third of the rows:

* :func:`rank_within` - row number inside a group by range-partitioning on
  ``(group, order...)``; each range partition numbers its own slice and a
  small per-(group, partition) count table supplies the offsets.  No task
  ever holds a whole group.
* :func:`smallest_n_per_group` - exact "n smallest keys" for uniform hash
  keys: a (group, key-bucket) histogram finds the boundary bucket, rows below
  it pass, and only the boundary bucket is ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleselect.functions.rand import KEY_BITS, hash_key
from tripleselect.session import cut_lineage

BUCKET_BITS = 16


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def rank_within(df: DataFrame, group_cols: list[str], order_cols: list, rank_col: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    """Add ``rank_col`` = 1-based row number of each row inside its group,
    ordered by ``order_cols`` (ascending; make them unique for a stable
    result).  Skew-safe: cost does not depend on the largest group."""
    spark = df.sparkSession
    p = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    gcols = list(group_cols)
    order = _cols(order_cols)
    # checkpointed: planned twice, the two branches would sample other range bounds and number other slices
    ranged = cut_lineage(df.repartitionByRange(p, *(_cols(gcols) + order)).withColumn("__part", F.spark_partition_id()))
    local = ranged.withColumn("__rn", F.row_number().over(Window.partitionBy(*gcols, "__part").orderBy(*order)))
    counts = ranged.groupBy(*gcols, "__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.withColumn(
        "__off", F.coalesce(F.sum("__n").over(Window.partitionBy(*gcols).orderBy("__part")
                                             .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # offsets has one row per non-empty (group, range partition); AQE
    # broadcasts it when its measured size is small
    return (local.join(offsets.select(*gcols, "__part", "__off"), gcols + ["__part"])
                 .withColumn(rank_col, (F.col("__rn") + F.col("__off")).cast("int"))
                 .drop("__part", "__rn", "__off"))


def top_k_per_group(df: DataFrame, group_cols: list[str], order_cols: list, k, tie_col: str,
                     rank_col: str = "rank", salts: int | None = None) -> DataFrame:
    """Keep the first ``k`` rows of each group by ``order_cols`` (then
    ``tie_col``) and number them 1..k.  ``k`` is an int or a column (a
    per-group quota).

    Two phases: rows are first cut to ``k`` per ``(group, salt)`` with
    ``salt = hash(tie) mod salts``, so a hot group is split over ``salts``
    tasks; the survivors (at most ``salts * k`` per group) are ranked once
    more.  Exact, because a group's first ``k`` rows survive phase one.
    With one salt (groups known to be small) rows are ranked at once."""
    s = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = _cols(order_cols) + [F.col(tie_col)]
    kexpr = F.lit(k) if not isinstance(k, (Column, str)) else (F.col(k) if isinstance(k, str) else k)
    stage = df.withColumn("__k", kexpr)
    if s > 1:
        work = stage.withColumn("__salt", F.pmod(F.xxhash64(tie_col), F.lit(s)))
        stage = (work.withColumn("__r1", F.row_number().over(Window.partitionBy(*group_cols, "__salt").orderBy(*order)))
                     .where(F.col("__r1") <= F.col("__k")).drop("__r1", "__salt"))
    return (stage.withColumn(rank_col, F.row_number().over(Window.partitionBy(*group_cols).orderBy(*order)))
                 .where(F.col(rank_col) <= F.col("__k")).drop("__k"))


def smallest_n_per_group(df: DataFrame, group_cols: list[str], key_col: str, n, tie_col: str) -> DataFrame:
    """Keep, per group, the ``n`` rows with the smallest ``(key, tie)``.

    ``key_col`` must be a uniform unsigned 60-bit hash key (see
    ``functions.rand``); ``n`` is an int or a column holding the group's
    quota.  Exact, and no task holds more than one key bucket of one group.
    """
    shift = KEY_BITS - BUCKET_BITS
    gcols = list(group_cols) or []
    work = df.withColumn("__b", F.shiftright(F.col(key_col), shift))
    nexpr = F.lit(n) if not isinstance(n, (Column, str)) else (F.col(n) if isinstance(n, str) else n)
    if not gcols:
        work = work.withColumn("__g", F.lit(0))
        gcols_i = ["__g"]
    else:
        gcols_i = gcols
    work = work.withColumn("__quota", nexpr)
    hist = work.groupBy(*gcols_i, "__b").agg(F.count(F.lit(1)).alias("__cnt"), F.first("__quota").alias("__quota"))
    hist = (hist.withColumn("__before", F.coalesce(F.sum("__cnt").over(
                Window.partitionBy(*gcols_i).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                .where(F.col("__before") < F.col("__quota")))
    # buckets entirely inside the quota pass whole; the boundary bucket is ranked
    hist = hist.withColumn("__whole", (F.col("__before") + F.col("__cnt")) <= F.col("__quota"))
    kept = work.drop("__quota").join(hist.select(*gcols_i, "__b", "__before", "__quota", "__whole"),
                                     gcols_i + ["__b"])
    whole = kept.where("__whole")
    edge = kept.where(~F.col("__whole"))
    edge = (edge.withColumn("__rn", F.row_number().over(Window.partitionBy(*gcols_i, "__b").orderBy(key_col, tie_col)))
                .where(F.col("__rn") <= F.col("__quota") - F.col("__before")).drop("__rn"))
    out = whole.unionByName(edge).drop("__b", "__before", "__quota", "__whole")
    return out.drop("__g") if not gcols else out


def smallest_n(df: DataFrame, n: int, key_col: str, tie_col: str) -> DataFrame:
    return smallest_n_per_group(df, [], key_col, n, tie_col)


def sample_exact(df: DataFrame, n: int, seed: int, id_col: str = "triple_id", strict: bool = False) -> DataFrame:
    """Uniform sample of exactly ``min(n, rows)`` rows without replacement.

    Row ``i`` is kept when its seeded key ``md5(seed:id)`` is among the ``n``
    smallest - the same set whatever the partitioning.  ``strict`` raises
    when fewer than ``n`` rows exist (the default returns what exists).
    """
    if strict:
        have = df.count()
        if have < n:
            raise ValueError(f"sample_exact: {have} rows available, {n} requested")
    keyed = df.withColumn("__key", hash_key(seed, id_col))
    return smallest_n(keyed, n, "__key", id_col).drop("__key")


def subsets(df: DataFrame, portion: float, dupes: int, seed: int, id_col: str = "triple_id") -> DataFrame:
    """``dupes`` independent uniform subsets of ``trunc(rows * portion / 100)``
    rows each (without replacement inside a subset); adds ``replica``."""
    total = df.count()
    n = math.trunc(total * (portion / 100.0))
    ids = df.select(id_col).withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(dupes - 1))))
    ids = ids.withColumn("__key", hash_key(seed, "replica", id_col))
    picked = smallest_n_per_group(ids, ["replica"], "__key", n, id_col).drop("__key")
    return picked.join(df, id_col)


# --------------------------------------------------------------------------- ranking + quotas

def rank_in_cluster(scored: DataFrame, by: str = "score", cluster_col: str = "cluster_id",
                    id_col: str = "triple_id", ascending: bool = True, digits: int = 9,
                    rank_col: str = "rank") -> DataFrame:
    """Rank triples inside each cluster by score (ascending = hardest first),
    ties by id.  Scores are rounded to ``digits`` first so engines agree."""
    s = F.round(F.col(by), digits)
    s = s if ascending else -s
    return rank_within(scored, [cluster_col], [s, F.col(id_col)], rank_col)


def cluster_sizes(assignments: DataFrame, cluster_col: str = "cluster_id") -> DataFrame:
    """(cluster_id, size); noise (-1) excluded."""
    return (assignments.where(F.col(cluster_col) >= 0).groupBy(cluster_col)
                       .agg(F.count(F.lit(1)).alias("size")))


def per_cluster(budget: int, k: int, rounding: str = "floor") -> int:
    return -(-budget // k) if rounding == "ceil" else budget // k


def size_scale(sizes: DataFrame, center: str = "median") -> float:
    """Median or mean cluster size: one aggregate over the K-row size table,
    returned to the driver as a scalar."""
    agg = F.median("size") if center == "median" else F.avg("size")
    v = sizes.agg(agg.cast("double")).first()[0]
    return float(v) if v is not None else 0.0


def bonus_quota(sizes: DataFrame, per_cluster_n: int, center: str = "median") -> DataFrame:
    """(cluster_id, size, quota): ``q`` per cluster, ``q + floor(scale / q)``
    when the cluster is larger than ``scale`` (median or mean size)."""
    scale = size_scale(sizes, center)
    q = per_cluster_n
    bonus = math.floor(scale / q) if q > 0 else 0
    return sizes.withColumn("quota", (F.lit(q) + F.when(F.col("size") > F.lit(scale), F.lit(bonus))
                                      .otherwise(F.lit(0))).cast("int"))


def flat_quota(sizes: DataFrame, per_cluster_n: int) -> DataFrame:
    return sizes.withColumn("quota", F.lit(per_cluster_n).cast("int"))


def smoothed_quota(sizes: DataFrame, budget: int, k: int, normalized: bool = False) -> DataFrame:
    """``floor((size + a) / (N + K) * budget)`` with ``a = budget // K``.

    ``N`` is the total row count and ``K`` the number of clusters asked for.
    ``normalized=True`` divides by ``N + a*K`` so the quotas sum to at most
    the budget."""
    a = budget // k
    total = sizes.agg(F.sum("size")).first()[0] or 0
    den = float(total + a * k) if normalized else float(total + k)
    return sizes.withColumn("quota", F.floor((F.col("size") + F.lit(a)) / F.lit(den) * F.lit(budget)).cast("int"))


def apply_quota(ranked: DataFrame, quotas: DataFrame, cluster_col: str = "cluster_id",
                rank_col: str = "rank") -> DataFrame:
    """Keep rows whose in-cluster rank is within the cluster's quota."""
    return (ranked.join(quotas.select(cluster_col, "quota"), cluster_col)
                  .where(F.col(rank_col) <= F.col("quota")).drop("quota"))


# --------------------------------------------------------------------------- take by index

def take(rows: DataFrame, samples: DataFrame, id_col: str = "triple_id") -> DataFrame:
    """Rows for a list of ids, keeping the list's order (``run_id``,
    ``ordinal``) and repeats.  An inner equi-join; AQE broadcasts the sample
    side at run time when it is small."""
    return samples.join(rows, id_col)
