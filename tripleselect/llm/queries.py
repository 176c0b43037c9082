"""The registered queries of this package.

Each applies one operator with production parameters to its whole table and
derives the stated result columns; ``ORACLES`` holds DuckDB SQL where SQL can
express the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleselect.llm import (decontaminate, hard_negatives, kd_shards, language_id, line_dedup, mixing, near_dedup,
                              prefix_trie, quality_cotrain, quality_rules, token_counts, token_planes, toxicity)
from tripleselect.llm.common import documents, fold, shared_folder

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kd_shards.kd_shards(documents(spark, sf_dir), numeric=["doc_id", "n_chars"], categories=["source", "lang"],
                               shards=16)
    return kd_shards.with_slots(rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                                             F.col("slot").cast("long").alias("slot"),
                                             F.lit(None).cast("int").alias("grown_shard"))


def op2_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_cotrain.view_rows(documents(spark, sf_dir))
    held = fold(F.col("doc_id"), 5) == 0
    model = quality_cotrain.fit(rows, documents(spark, sf_dir, "labels"), ~held)
    return (rows.select("doc_id", held.alias("held_out"), quality_cotrain.score_column(rows, model).alias("score"))
                .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def op3_multinomial_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.words_taken(documents(spark, sf_dir))


def op4_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.with_hits(documents(spark, sf_dir).select("doc_id", "text"),
                                   documents(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", (F.size("hits") > 0).alias("contaminated"),
                       F.transform("hits", lambda h: h["item_id"].cast("long")).alias("item_ids"),
                       F.coalesce(F.array_max(F.transform("hits", lambda h: h["coverage"])), F.lit(0.0)).alias("coverage"))


def op5_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.document_lines(documents(spark, sf_dir))


def op6_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, documents(spark, sf_dir, "labels"), ~held)
    return (docs.select("doc_id", held.alias("held_out"), toxicity.score_column(docs, model).alias("score"))
                .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def op7_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(documents(spark, sf_dir)).select(
        "doc_id", "class_id", "class_size", "texts", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op8_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs, fold(F.col("doc_id"), 3) != 1)
    out = language_id.identify(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score",
                      "cross_entropy", "rejected")


def op9_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-planes")
    token_planes.write_token_planes(documents(spark, sf_dir), folder, tokenizer_path())
    return token_planes.read_token_planes(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(documents(spark, sf_dir))
    base, best = quality_rules.POLICIES[0], quality_rules.POLICIES[-1]
    base_failed = ~quality_rules.verdict(base)
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      base_failed.alias("base_failed"), (~base_failed & quality_rules.verdict(best)).alias("kept"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(documents(spark, sf_dir, "conversations"))).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", token_counts.byte_length(F.col("text")).alias("n_bytes"), "text")
    return (token_counts.with_token_counts(docs, tokenizer_path("word_bpe_49k.json"))
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.taking_part(documents(spark, sf_dir, "embeddings"), label=moved)
    return hard_negatives.hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0))


QUERIES = {f.__name__: f for f in (
    op1_kd_shards, op2_cotraining_quality, op3_multinomial_mix, op4_greedy_tiling, op5_line_edit_join,
    op6_weak_toxicity, op7_prob_minhash, op8_kneser_ney_langid, op9_token_planes, op10_rule_ledger,
    op11_prefix_trie, op12_token_counts, op13_hard_negatives)}

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    # the verdict's rules as plain conditions; windows compared as lists of words
    "op10_rule_ledger": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS_SQL} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
           FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS s, w FROM d WHERE len(w) >= 8),
rep AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, w[s:s + 7]) AS c FROM win),
hit AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM rep WHERE c > 1),
cov AS (SELECT doc_id, sum(CASE WHEN p IS NULL THEN 8 ELSE least(8, s - p) END) AS n FROM hit GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(l) AS n_lines, length(t) - length(replace(t, '!', '')) AS bangs,
             length(t) - length(translate(t, '0123456789', '')) AS digits
      FROM d LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > 3 * n_words) AND NOT (100 * n_dup_lines > 30 * n_lines)
       AND NOT (word_chars < 2 * n_words OR word_chars > 14 * n_words) AND NOT (10 * bangs > 5 * n_words)
       AND NOT (100 * digits > 40 * word_chars) AS kept
FROM b""",
    # every pair of anchor and row is scored
    "op13_hard_negatives": """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
             list_dot_product(a.v, b.v)::BIGINT AS score
      FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score
      FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other))::INTEGER AS rank,
       s.other AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
     AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) <= 10""",
    # nodes as lists of turns; crc32 of the decimal id, bit by bit
    "op11_prefix_trie": """
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 100 AS base, (xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT),
             lambda s, b: list_reduce(range(8), lambda t, i: xor(t >> 1, (t & 1) * 3988292384), xor(s, b)),
             4294967295::BIGINT), 4294967295::BIGINT)) % 6 AS h FROM ids),
own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS rn
        FROM conversations WHERE conv_id IS NOT NULL),
seq AS (SELECT h.c, list({'r': o.role, 't': o.text} ORDER BY o.part, o.rn) FILTER (o.part IS NOT NULL) AS q
        FROM h LEFT JOIN (SELECT h.c AS k, 1 AS part, rn, role, text FROM h JOIN own ON own.c = h.base AND rn <= h.h
                          UNION ALL SELECT h.c, 2, rn, role, text FROM h JOIN own ON own.c = h.c AND rn > h.h) o ON o.k = h.c
        GROUP BY h.c),
s AS (SELECT c, coalesce(q, []) AS q FROM seq),
steps AS (SELECT c, unnest(range(0, len(q) + 1)) AS depth, q FROM s),
pre AS (SELECT c, depth, len(q) AS n, md5(q[1:depth]::VARCHAR) AS node,
               CASE WHEN depth > 0 THEN md5(q[1:depth - 1]::VARCHAR) END AS parent,
               CASE WHEN depth > 0 THEN length(q[depth].t) ELSE 0 END AS chars FROM steps),
node AS (SELECT depth, node, any_value(parent) AS parent, any_value(chars) AS chars, min(c) AS conv_id, count(*) AS n_convs,
                sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = depth), '')) AS ends_sha256
         FROM pre GROUP BY depth, node),
kids AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1, 2),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (depth, node)),
below AS (SELECT DISTINCT y.depth, y.node, x.depth AS d2, x.node AS n2
          FROM pre x JOIN pre y ON x.c = y.c AND y.depth <= x.depth),
sums AS (SELECT below.depth, below.node, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved
         FROM below JOIN full_node f ON f.depth = below.d2 AND f.node = below.n2 GROUP BY 1, 2)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children,
       sums.n_leaves, sums.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM full_node f JOIN sums USING (depth, node) LEFT JOIN node p ON p.depth = f.depth - 1 AND p.node = f.parent""",
}
