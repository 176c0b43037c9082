"""Readers and writers.

* triples as headerless TSV (ids or texts), declared schema, never inferred
* triple vectors / cells / runs / metrics as parquet or CSV
* dense ingest ids (``with_triple_id``) - 0..N-1 by file path and place in
  the file; only per-slice row counts are summed up
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleselect.functions.text import tsv_safe
from tripleselect.session import cut_lineage

ID_COLS = ("qid", "pos_id", "neg_id")
TEXT_COLS = ("query", "psg_pos", "psg_neg")
CELL_ROWS = "id long, copy int, code binary, step float, err float, vec array<double>, cell int"


def triple_schema(kind: str = "ids") -> T.StructType:
    cols = ID_COLS if kind == "ids" else TEXT_COLS
    return T.StructType([T.StructField(c, T.StringType(), True) for c in cols])


def with_triple_id(df: DataFrame, id_col: str = "triple_id") -> DataFrame:
    """Add a dense 0..N-1 id in input order: by ``__file`` and ``__block``
    (path and offset of the slice that a row was read from, see
    :func:`read_triples`) when present, else by partition, then by place in
    the slice.  The numbered rows are checkpointed once; offsets come from one
    count per slice."""
    slice_cols = ["__file", "__block"] if "__file" in df.columns else ["__block"]
    if "__file" not in df.columns:
        df = df.withColumn("__block", F.spark_partition_id().cast("long"))
    rows = cut_lineage(df.withColumn("__at", F.monotonically_increasing_id()))
    slices = rows.groupBy(*slice_cols).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.orderBy(*slice_cols).rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.select(*slice_cols, "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    return (rows.join(slices, slice_cols)
                .select((F.col("__before") + F.col("__at") - F.col("__first")).alias(id_col),
                        *[c for c in df.columns if c not in ("__file", "__block")]))


def read_triples(spark: SparkSession, path: str, kind: str = "ids", with_ids: bool = True) -> DataFrame:
    """Headerless tab-separated triples, all strings.  ``kind`` = ids
    (qid, pos_id, neg_id) or text (query, psg_pos, psg_neg).  Quotes are not
    special: a field is everything between two tabs."""
    df = (spark.read.schema(triple_schema(kind))
               .option("sep", "\t").option("header", "false").option("quote", "\u0000")
               .option("escape", "\u0000").option("mode", "PERMISSIVE").csv(path))
    # a missing field is the empty string, never null
    cols = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns]
    if not with_ids:
        return df.select(*cols)
    return with_triple_id(df.select(*cols, F.col("_metadata.file_path").alias("__file"),
                                    F.col("_metadata.file_block_start").alias("__block")))


def stream_triples(spark: SparkSession, path: str, kind: str = "ids", max_files: int = 1) -> DataFrame:
    """Streaming twin of :func:`read_triples`: new TSV files in a folder,
    ``max_files`` per micro-batch; a missing field is the empty string here too."""
    df = (spark.readStream.schema(triple_schema(kind)).option("sep", "\t").option("header", "false")
               .option("quote", "\u0000").option("escape", "\u0000").option("maxFilesPerTrigger", max_files)
               .csv(path))
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns])


def write_triples(df: DataFrame, path: str, kind: str = "text", partition_by: str | None = None,
                  mode: str = "overwrite") -> None:
    """Headerless TSV; tabs and line breaks inside fields become spaces so
    every record stays one line."""
    cols = list(TEXT_COLS if kind == "text" else ID_COLS)
    out = df.select(*([partition_by] if partition_by else []), *[tsv_safe(c).alias(c) for c in cols])
    w = out.write.mode(mode).option("sep", "\t").option("header", "false").option("quote", "\u0000") \
        .option("escape", "\u0000").option("emptyValue", "")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(triple_id, vec ARRAY<FLOAT>) parquet."""
    return spark.read.parquet(path)


def write_vectors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select("triple_id", "vec").write.mode(mode).parquet(path)


def write_run(samples: DataFrame, runs: DataFrame, path: str, mode: str = "append") -> None:
    """Samples partitioned by run_id (``path/samples``) and the run records
    (``path/runs``)."""
    samples.select("run_id", "ordinal", "triple_id").write.mode(mode).partitionBy("run_id").parquet(f"{path}/samples")
    runs.write.mode(mode).parquet(f"{path}/runs")


def read_runs(spark: SparkSession, path: str, run_ids: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples, runs); ``run_ids`` prunes partitions."""
    s = spark.read.parquet(f"{path}/samples")
    r = spark.read.parquet(f"{path}/runs")
    if run_ids:
        s = s.where(F.col("run_id").isin(run_ids))
        r = r.where(F.col("run_id").isin(run_ids))
    return s, r


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header (one file per partition)."""
    df.write.mode(mode).option("header", "true").csv(path)


def write_cells(rows: DataFrame, centroids: DataFrame, path: str, files: int = 1) -> None:
    """Neighbour index: rows partitioned by ``cell`` (each over up to
    ``files`` files, by hash of ``id``) and the centroid table."""
    dealt = rows.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(files)))
    dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    centroids.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def read_cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows with cell, centroids); filters on ``cell`` prune partitions."""
    return spark.read.schema(CELL_ROWS).parquet(f"{path}/rows"), spark.read.parquet(f"{path}/centroids")
