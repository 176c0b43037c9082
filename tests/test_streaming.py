"""Streaming operators give the same rows as their batch forms."""
from pyspark.sql import functions as F

from conftest import SF001
from tripleselect.functions.vectors import cosine_margin
from tripleselect.operators.cluster import assign_clusters, mean_centroids
from tripleselect.operators.evaluate import cosine_to_reference, reference_mean
from tripleselect.sources import fixtures as fx
from tripleselect.streaming.stream import (assign_stream, filter_stream_by_reference, margin_stream,
                                           run_to_memory)


def _stream_source(spark, tmp_path):
    tv = fx.triple_vectors(spark, SF001).select("triple_id", "vec")
    src = str(tmp_path / "src")
    tv.repartition(3).write.parquet(src)
    return tv, spark.readStream.schema(tv.schema).option("maxFilesPerTrigger", 1).parquet(src)


def test_filter_and_margin_stream(spark, tmp_path):
    tv, stream = _stream_source(spark, tmp_path)
    refs = fx.reference_ids(spark, SF001)
    rbar = reference_mean(tv, refs).first()["rbar"]
    run_to_memory(filter_stream_by_reference(stream, rbar, 0.0), "flt", str(tmp_path / "ck1"))
    got = {r.triple_id for r in spark.sql("select * from flt").collect()}
    want = {r.triple_id for r in cosine_to_reference(tv, refs).where(F.col("d") < 0.0).collect()}
    assert got == want and got
    run_to_memory(margin_stream(stream, 64), "mrg", str(tmp_path / "ck2"))
    got = {(r.triple_id, round(r.margin, 9)) for r in spark.sql("select * from mrg").collect()}
    want = {(r.triple_id, round(r.m, 9)) for r in tv.select("triple_id", cosine_margin("vec", 64).alias("m")).collect()}
    assert got == want


def test_assign_stream(spark, tmp_path):
    tv, stream = _stream_source(spark, tmp_path)
    lab = fx.triple_vectors(spark, SF001).select("triple_id", "vec", "label")
    cents = mean_centroids(lab, "label")
    run_to_memory(assign_stream(stream, cents), "asg", str(tmp_path / "ck3"))
    got = {(r.triple_id, r.cluster_id) for r in spark.sql("select * from asg").collect()}
    want = {(r.triple_id, r.cluster_id) for r in assign_clusters(tv, cents).collect()}
    assert got == want


def test_stream_reads_missing_fields_as_empty(spark, tmp_path):
    from tripleselect.sources.io import stream_triples
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("q\t\tn\nonly\n")
    q = (stream_triples(spark, str(tmp_path / "in"), kind="text").writeStream.format("parquet")
         .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")))
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("only", "", ""), ("q", "", "n")]
