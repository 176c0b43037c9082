"""Stand-in inputs derived from the given test tables.

These builders only shape rows into the schemas the operators take
(id triples, triple vectors, text triples, qrels, a reference set).  They do
none of the operators' work.  Rules are the ones written down in FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleselect.functions.rand import hash_key
from tripleselect.operators.select import smallest_n
from tripleselect.session import cut_lineage

N_LABELS = 10          # fixed value: labels 0-9 in the embeddings table
QREL_WORDS = 5         # words of the runs by which passages are found
REFERENCE_SEED = 42    # fixed value: seed of the given reference set
REFERENCE_SIZE = 20    # fixed value: size of the given reference set


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(triple_id, qid, pos_id, neg_id, label): positive = next vector of the
    same label (cyclic), negative = same-ranked vector of the next label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    r = e.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    cnt = e.groupBy("label").agg(F.count(F.lit(1)).alias("cnt"))
    q = (r.join(cnt, "label")
          .withColumn("nlabel", F.pmod(F.col("label") + 1, F.lit(N_LABELS)))
          .join(cnt.select(F.col("label").alias("nlabel"), F.col("cnt").alias("ncnt")), "nlabel")
          .withColumn("prn", F.pmod(F.col("rn"), F.col("cnt")) + 1)
          .withColumn("nrn", F.pmod(F.col("rn") - 1, F.col("ncnt")) + 1))
    p = r.select(F.col("label").alias("plabel"), F.col("rn").alias("prn"), F.col("vec_id").alias("pos_id"))
    n = r.select(F.col("label").alias("nlabel"), F.col("rn").alias("nrn"), F.col("vec_id").alias("neg_id"))
    # stand-in tables are written once to the shared checkpoint folder, as a
    # prepared input table would be
    return cut_lineage(q.join(p, (q.label == p.plabel) & (q.prn == p.prn))
                        .join(n, ["nlabel", "nrn"])
                        .select(F.col("vec_id").alias("triple_id"), F.col("vec_id").alias("qid"),
                                "pos_id", "neg_id", "label"))


def triple_vectors(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """(triple_id, label, vec) with vec = query ‖ positive ‖ negative."""
    from tripleselect.operators.assemble import assemble_triples
    ids = ids if ids is not None else id_triples(spark, sf_dir)
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return cut_lineage(assemble_triples(ids, emb, emb).select("triple_id", "label", "vec"))


def text_triples(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """(triple_id, label, query, psg_pos, psg_neg): as many as there are
    documents or id triples, whichever are more, so that every one of both
    occurs; the query is a benchmark item, the passages two documents half a
    corpus apart."""
    ids = ids if ids is not None else id_triples(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text")
    nd, ni, nb = docs.count(), ids.count(), bench.count()
    if not (nd and ni and nb):
        return spark.createDataFrame([], "triple_id long, label int, query string, psg_pos string, psg_neg string")
    t = spark.range(max(nd, ni)).select(
        F.col("id").alias("triple_id"), F.pmod("id", F.lit(ni)).alias("v_id"), F.pmod("id", F.lit(nb)).alias("b_id"),
        F.pmod("id", F.lit(nd)).alias("p_id"), F.pmod(F.col("id") + F.lit(nd // 2), F.lit(nd)).alias("n_id"))
    return cut_lineage(t.join(ids.select(F.col("triple_id").alias("v_id"), "label"), "v_id")
                        .join(bench.select(F.col("item_id").alias("b_id"), F.col("text").alias("query")), "b_id")
                        .join(docs.select(F.col("doc_id").alias("p_id"), F.col("text").alias("psg_pos")), "p_id")
                        .join(docs.select(F.col("doc_id").alias("n_id"), F.col("text").alias("psg_neg")), "n_id")
                        .select("triple_id", "label", "query", "psg_pos", "psg_neg"))


def over_texts(assignments: DataFrame, texts: DataFrame) -> DataFrame:
    """(triple_id, cluster_id) of text triples, each with the cluster of the
    vector triple that it was made with (``assignments``: dense ids)."""
    n = assignments.count()
    a = assignments.select(F.col("triple_id").alias("v_id"), "cluster_id")
    return texts.select("triple_id", F.pmod("triple_id", F.lit(n)).alias("v_id")).join(a, "v_id").select("triple_id", "cluster_id")


def reference_ids(spark: SparkSession, sf_dir: str, seed: int = REFERENCE_SEED,
                  size: int = REFERENCE_SIZE) -> DataFrame:
    """(ref_id): the ``size`` vectors with the smallest seeded key."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ref_id"))
    return smallest_n(e.withColumn("k", hash_key(seed, "ref_id")), size, "k", "ref_id").select("ref_id")


def word_list(text: str):
    """The words of a text (runs of anything but spaces and the controls 9-13)."""
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), "")


def shingles(df: DataFrame, words: str, size) -> DataFrame:
    """``df`` with one row per run of ``size`` words of the ``words`` column, as ``shingle``."""
    n = size if not isinstance(size, int) else F.lit(size)
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1))
    return df.withColumn("at", F.explode(starts)).withColumn("shingle", F.array_join(F.slice(words, F.col("at"), n), " ")).drop("at")


def lexical_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, docno, rel): a document is relevant to a benchmark item when it
    holds at least half of the item's different five-word runs, grade 2 when it
    holds all.  An item of fewer words is one run of all its words.  Items and
    documents meet by an equi-join on the runs, over whole texts of both."""
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), word_list("text").alias("w"))
    bench = bench.where(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(QREL_WORDS)))
    runs = cut_lineage(shingles(bench, "w", F.col("size")).select("qid", "size", "shingle").distinct())
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("docno"), word_list("text").alias("w"))
    found = None
    for size in sorted(r["size"] for r in runs.select("size").distinct().collect()):          # five sizes at most
        part = shingles(docs, "w", size).select("docno", "shingle")
        hit = part.join(runs.where(F.col("size") == size), "shingle").select("qid", "docno", "shingle").distinct()
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return spark.createDataFrame([], "qid long, docno long, rel int")
    need = runs.groupBy("qid").agg(F.count(F.lit(1)).alias("need"))
    have = found.groupBy("qid", "docno").agg(F.count(F.lit(1)).alias("have"))
    return have.join(need, "qid").where(2 * F.col("have") >= F.col("need")).select(
        "qid", "docno", F.when(F.col("have") == F.col("need"), 2).otherwise(1).alias("rel"))


def graded_qrels(spark: SparkSession, sf_dir: str, depth: int = 3) -> DataFrame:
    """(qid, docno, rel) over the embeddings: every vector is a topic; the
    next vector of its label (cyclic, by vec_id) is graded 2 and the
    ``depth - 1`` after it graded 1.  Built by equi-joins on (label, rank)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    r = e.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    cnt = e.groupBy("label").agg(F.count(F.lit(1)).alias("cnt"))
    t = (r.join(cnt, "label").withColumn("o", F.explode(F.sequence(F.lit(1), F.lit(depth))))
          .withColumn("trn", F.pmod(F.col("rn") - 1 + F.col("o"), F.col("cnt")) + 1)
          .select(F.col("vec_id").alias("qid"), "label", "trn", "o"))
    d = r.select("label", F.col("rn").alias("trn"), F.col("vec_id").alias("docno"))
    return (t.join(d, ["label", "trn"]).where(F.col("qid") != F.col("docno"))
             .groupBy("qid", "docno").agg(F.max(F.when(F.col("o") == 1, 2).otherwise(1)).alias("rel")))
