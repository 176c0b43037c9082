"""Triple-vector assembly and the pluggable passage encoder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble_triples(ids: DataFrame, q_vecs: DataFrame, p_vecs: DataFrame,
                     id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """Look up query, positive and negative vectors and concatenate them.

    ``ids`` has (triple_id, qid, pos_id, neg_id, ...); ``q_vecs`` / ``p_vecs``
    have (id, vec).  Three equi-joins, each shuffling only the narrow id
    columns plus one vector; the result keeps every other ``ids`` column.
    """
    q = q_vecs.select(F.col(id_col).alias("qid"), F.col(vec_col).alias("__q"))
    p = p_vecs.select(F.col(id_col).alias("pos_id"), F.col(vec_col).alias("__p"))
    n = p_vecs.select(F.col(id_col).alias("neg_id"), F.col(vec_col).alias("__n"))
    return (ids.join(q, "qid").join(p, "pos_id").join(n, "neg_id")
               .withColumn("vec", F.concat("__q", "__p", "__n"))
               .drop("__q", "__p", "__n"))


def hashing_encoder(num_features: int = 64, seed: int = 0) -> Callable[[DataFrame, str, str], DataFrame]:
    """Built-in deterministic encoder: clean + lower-case tokens, signed
    feature hashing into ``num_features`` buckets, L2 norm.  Runs as
    built-in array functions (no model, no Python)."""
    from tripleselect.functions.text import clean_text, tokens
    from tripleselect.functions.vectors import with_l2_normalized

    def encode(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        toks = df.select(F.col(id_col).alias("id"), F.explode(tokens(clean_text(text_col))).alias("tok"))
        h = F.xxhash64(F.lit(seed), "tok")
        feats = (toks.select("id", F.pmod(h, F.lit(num_features)).cast("int").alias("f"),
                             F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s"))
                     .groupBy("id", "f").agg(F.sum("s").alias("v")))
        dense = (feats.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("f", "v"))).alias("m"))
                      .select("id", F.transform(F.sequence(F.lit(0), F.lit(num_features - 1)),
                                                lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("vec")))
        # texts without a single token still get a (zero) vector
        allids = df.select(F.col(id_col).alias("id")).distinct()
        zero = F.array_repeat(F.lit(0.0), num_features)
        out = allids.join(dense, "id", "left").select("id", F.coalesce("vec", zero).alias("vec"))
        return with_l2_normalized(out, "vec")

    return encode


def embed_triples(ids: DataFrame, queries: DataFrame, passages: DataFrame,
                  encoder: Callable[[DataFrame, str, str], DataFrame] | None = None) -> DataFrame:
    """Encode query and passage texts, then assemble triple vectors.

    ``queries`` / ``passages`` have (id, text).  ``encoder(df, id_col,
    text_col) -> (id, vec)`` is pluggable (e.g. a ``mapInPandas`` model);
    each distinct text is encoded once, not once per triple.
    """
    enc = encoder or hashing_encoder()
    qv = enc(queries.join(ids.select(F.col("qid").alias("id")).distinct(), "id", "left_semi"), "id", "text")
    used = ids.select(F.col("pos_id").alias("id")).union(ids.select(F.col("neg_id").alias("id"))).distinct()
    pv = enc(passages.join(used, "id", "left_semi"), "id", "text")
    return assemble_triples(ids, qv, pv)
