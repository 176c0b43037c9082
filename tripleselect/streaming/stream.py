"""Structured Streaming: stateless operators applied to new triples.

Once a reference set, centroids or a scoring rule is fixed, three operators
need no state across rows and run unchanged on a stream:

* ``filter_stream_by_reference`` - the bulk step of the threshold sampler:
  keep arriving triples whose mean cosine to the frozen reference set is
  below ``t`` (x̂ · r̄ < t);
* ``assign_stream`` - nearest centroid (broadcast, size-checked);
* ``margin_stream`` - cosine margin of each arriving triple vector.

Sources: ``sources.io.stream_triples`` (TSV folder) or any
``readStream`` of (triple_id, vec).  Sinks: any ``writeStream``; tests use
the memory sink with ``availableNow``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleselect.functions.vectors import cosine_margin, dot, with_l2_normalized


def filter_stream_by_reference(stream: DataFrame, rbar: list[float], t: float, id_col: str = "triple_id",
                               vec_col: str = "vec") -> DataFrame:
    """(id, d) of arriving rows with d = x̂ · r̄ < t; r̄ is a literal of d floats."""
    lit = F.array(*[F.lit(float(v)) for v in rbar])
    x = with_l2_normalized(stream.select(id_col, vec_col), vec_col)
    return x.select(id_col, dot(vec_col, lit).alias("d")).where(F.col("d") < F.lit(float(t)))


def assign_stream(stream: DataFrame, centroids: DataFrame, id_col: str = "triple_id", vec_col: str = "vec") -> DataFrame:
    """Nearest-centroid assignment of arriving rows (``mapInPandas`` works
    on streaming DataFrames)."""
    from tripleselect.operators.cluster import assign_clusters
    return assign_clusters(stream, centroids, id_col, vec_col)


def margin_stream(stream: DataFrame, dim: int, id_col: str = "triple_id", vec_col: str = "vec") -> DataFrame:
    """(id, margin) = cos(q, p+) - cos(q, p-) for arriving triple vectors."""
    return stream.select(id_col, cosine_margin(vec_col, dim).alias("margin"))


def run_to_memory(df: DataFrame, name: str, checkpoint: str) -> None:
    """Drain everything currently available into an in-memory table
    ``name`` (append mode), then stop."""
    q = (df.writeStream.format("memory").queryName(name).outputMode("append")
           .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
