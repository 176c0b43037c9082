"""Registered queries: one Spark callable ``(spark, sf_dir) -> DataFrame``
per operator, plus (where SQL can express it) an independent DuckDB oracle.

Every query reads the given tables (or fixtures Spark derives from them)
and runs over the whole tables.  Computed columns carry the same alias on
both sides; floating results are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleselect.plans import sqlkit as K
from tripleselect.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


DIM = 64          # fixed value: floats per block in the embeddings table
NCLUST = 10       # clusters = the 10 given labels
BUDGET = 100
SEED = 7


def _given_clusters(tv: DataFrame) -> DataFrame:
    return tv.select("triple_id", F.col("label").alias("cluster_id"))


# ----------------------------------------------------------------------------- E5 (minimum slice)

@register("select_cluster_cosine", K.with_(*K.FIX, f"""scored AS (
  SELECT triple_id, label AS cluster_id, {K.margin('vec', DIM)} AS score FROM tv)""", """sizes AS (
  SELECT cluster_id, count(*) AS size FROM scored GROUP BY cluster_id)""", f"""quota AS (
  SELECT cluster_id, {BUDGET // NCLUST} + CASE WHEN size > s THEN CAST(floor(s / {BUDGET // NCLUST}) AS INT) ELSE 0 END AS quota
  FROM sizes, (SELECT median(size) AS s FROM sizes))""", """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(score, 9), triple_id) AS rank FROM scored)""")
    + f"""SELECT triple_id, cluster_id, CAST(rank AS INT) AS rank, round(score, 6) AS score
FROM ranked JOIN quota USING (cluster_id) WHERE rank <= quota
ORDER BY {K.key(SEED, 'triple_id')}, triple_id LIMIT {BUDGET}""")
def q_select_cluster_cosine(spark, sf):
    from tripleselect.plans.jobs import select_cluster_cosine
    tv = fx.triple_vectors(spark, sf)
    out = select_cluster_cosine(tv, _given_clusters(tv), BUDGET, NCLUST, DIM, SEED)
    return out.select("triple_id", "cluster_id", "rank", F.round("score", 6).alias("score"))


# ----------------------------------------------------------------------------- checksums for vector outputs

def vsum(c) -> F.Column:
    v = F.transform(F.col(c) if isinstance(c, str) else c, lambda x: x.cast("double"))
    return F.round(F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x), 6)


def vwsum(c) -> F.Column:
    v = F.transform(F.col(c) if isinstance(c, str) else c, lambda x, i: x.cast("double") * (i + 1))
    return F.round(F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x), 6)


def _vcheck(c: str) -> list:
    return [F.size(c).alias("n_dims"), vsum(c).alias("v_sum"), vwsum(c).alias("v_wsum")]


def sql_vcheck(v: str) -> str:
    return (f"CAST(len({v}) AS INT) AS n_dims, "
            f"round(list_reduce(CAST({v} AS DOUBLE[]), lambda a, x: a + x, 0.0::DOUBLE), 6) AS v_sum, "
            f"round(list_reduce(list_transform(CAST({v} AS DOUBLE[]), lambda x, i: x * i), lambda a, x: a + x, 0.0::DOUBLE), 6) AS v_wsum")


def _dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


# ----------------------------------------------------------------------------- J8 assemble, P3 views, P4/P5, P6

@register("assemble_triples", K.with_(*K.FIX) + f"SELECT triple_id, label, {sql_vcheck('vec')} FROM tv")
def q_assemble_triples(spark, sf):
    tv = fx.triple_vectors(spark, sf)
    return tv.select("triple_id", "label", *_vcheck("vec"))


def _view_sql(view: str) -> str:
    if view == "query":
        expr = K.block("vec", DIM, 0)
    elif view == "pos":
        expr = f"list_slice(vec, 1, {2 * DIM})"
    else:
        expr = f"list_concat(list_concat(list_slice(vec, 1, 16), list_slice(vec, {DIM + 1}, {DIM + 16})), list_slice(vec, {2 * DIM + 1}, {2 * DIM + 16}))"
    return K.with_(*K.FIX) + f"SELECT triple_id, {sql_vcheck(expr)} FROM tv"


def _view_q(view: str):
    def q(spark, sf):
        from tripleselect.functions.vectors import vector_view
        tv = fx.triple_vectors(spark, sf)
        return tv.select("triple_id", vector_view("vec", DIM, view, 16).alias("v")).select("triple_id", *_vcheck("v"))
    return q


for _v in ("query", "pos", "trunc"):
    register(f"vector_view_{_v}", _view_sql(_v))(_view_q(_v))


def _weight_sql(a: float, b: float, g: float, equal: bool) -> str:
    if equal:
        w = "CAST(vec AS DOUBLE[])"
    else:
        w = (f"list_transform(CAST(vec AS DOUBLE[]), lambda x, i: x * CASE WHEN i <= {DIM} THEN {_dbl(a)} "
             f"WHEN i <= {2 * DIM} THEN {_dbl(b)} ELSE {_dbl(g)} END)")
    return (K.with_(*K.FIX, f"w AS (SELECT triple_id, {w} AS v FROM tv)",
                    f"nw AS (SELECT triple_id, v, {K.norm('v')} AS n FROM w)",
                    "nv AS (SELECT triple_id, list_transform(v, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END) AS v FROM nw)")
            + f"SELECT triple_id, {sql_vcheck('v')} FROM nv")


def _weight_q(a: float, b: float, equal: bool, clip: bool):
    def q(spark, sf):
        from tripleselect.functions.vectors import weight_vectors
        tv = fx.triple_vectors(spark, sf)
        w = weight_vectors(tv.select("triple_id", "vec"), "vec", DIM, a, b, equal=equal, clip_gamma=clip)
        return w.select("triple_id", *_vcheck("vec"))
    return q


register("weight_vectors", _weight_sql(0.5, 0.3, 1.0 - 0.5 - 0.3, False))(_weight_q(0.5, 0.3, False, True))
register("weight_vectors_unclipped", _weight_sql(1.0, 1.0, -1.0, False))(_weight_q(1.0, 1.0, False, False))
register("l2_normalize", _weight_sql(1.0, 1.0, 0.0, True))(_weight_q(1.0, 1.0, True, True))


@register("cosine_margin", K.with_(*K.FIX) + f"SELECT triple_id, round({K.margin('vec', DIM)}, 6) AS margin FROM tv")
def q_cosine_margin(spark, sf):
    from tripleselect.functions.vectors import cosine_margin
    tv = fx.triple_vectors(spark, sf)
    return tv.select("triple_id", F.round(cosine_margin("vec", DIM), 6).alias("margin"))


# ----------------------------------------------------------------------------- J1 take by index

@register("take_by_index", K.with_(*K.FIX, K.TEXT, f"""draws AS (
  SELECT 'draws' AS run_id, step AS ordinal, {K.key(SEED, 'step')} % (SELECT count(*) FROM tt) AS triple_id
  FROM range(1, (SELECT count(*) FROM tt) + 1) t(step))""")
    + "SELECT d.run_id, d.ordinal, d.triple_id, t.query, t.psg_pos, t.psg_neg FROM draws d JOIN tt t USING (triple_id)")
def q_take_by_index(spark, sf):
    from tripleselect.functions.rand import draw_index
    from tripleselect.operators.select import take
    tt = fx.text_triples(spark, sf)
    n = tt.count()
    samples = (spark.range(1, n + 1).select(F.lit("draws").alias("run_id"), F.col("id").alias("ordinal"))
                    .withColumn("triple_id", draw_index(SEED, "ordinal", n)))
    return take(tt.select("triple_id", "query", "psg_pos", "psg_neg"), samples) \
        .select("run_id", "ordinal", "triple_id", "query", "psg_pos", "psg_neg")


# ----------------------------------------------------------------------------- A1-A3, Q2-Q5

_SIZES = "sizes AS (SELECT label AS cluster_id, count(*) AS size FROM tv GROUP BY label)"


@register("cluster_sizes", K.with_(*K.FIX, _SIZES) + "SELECT cluster_id, size FROM sizes")
def q_cluster_sizes(spark, sf):
    from tripleselect.operators.select import cluster_sizes
    return cluster_sizes(_given_clusters(fx.triple_vectors(spark, sf)))


def _bonus_sql(center: str) -> str:
    q = BUDGET // NCLUST
    agg = "median(size)" if center == "median" else "avg(size)"
    return (K.with_(*K.FIX, _SIZES)
            + f"""SELECT cluster_id, size, CAST({q} + CASE WHEN size > s THEN floor(s / {q}) ELSE 0 END AS INT) AS quota
FROM sizes, (SELECT CAST({agg} AS DOUBLE) AS s FROM sizes)""")


def _bonus_q(center: str):
    def q(spark, sf):
        from tripleselect.operators.select import bonus_quota, cluster_sizes, per_cluster
        sizes = cluster_sizes(_given_clusters(fx.triple_vectors(spark, sf)))
        return bonus_quota(sizes, per_cluster(BUDGET, NCLUST), center)
    return q


register("bonus_quota_median", _bonus_sql("median"))(_bonus_q("median"))
register("bonus_quota_mean", _bonus_sql("mean"))(_bonus_q("mean"))


@register("smoothed_quota", K.with_(*K.FIX, _SIZES)
          + f"""SELECT cluster_id, size, CAST(floor((size + {BUDGET // NCLUST}) / CAST(tot + {NCLUST} AS DOUBLE) * {BUDGET}) AS INT) AS quota
FROM sizes, (SELECT sum(size) AS tot FROM sizes)""")
def q_smoothed_quota(spark, sf):
    from tripleselect.operators.select import cluster_sizes, smoothed_quota
    sizes = cluster_sizes(_given_clusters(fx.triple_vectors(spark, sf)))
    return smoothed_quota(sizes, BUDGET, NCLUST)


_RANKED = f"""ranked AS (
  SELECT triple_id, label AS cluster_id, round({K.margin('vec', DIM)}, 9) AS score9, {K.margin('vec', DIM)} AS score,
         row_number() OVER (PARTITION BY label ORDER BY round({K.margin('vec', DIM)}, 9), triple_id) AS rank
  FROM tv)"""


@register("rank_in_cluster", K.with_(*K.FIX, _RANKED)
          + "SELECT triple_id, cluster_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM ranked")
def q_rank_in_cluster(spark, sf):
    from tripleselect.functions.vectors import cosine_margin
    from tripleselect.operators.select import rank_in_cluster
    tv = fx.triple_vectors(spark, sf)
    scored = tv.select("triple_id", F.col("label").alias("cluster_id"), cosine_margin("vec", DIM).alias("score"))
    return rank_in_cluster(scored, "score").select("triple_id", "cluster_id", "rank", F.round("score", 6).alias("score"))


@register("flat_quota", K.with_(*K.FIX, _RANKED)
          + f"SELECT triple_id, cluster_id, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= {BUDGET // NCLUST}")
def q_flat_quota(spark, sf):
    from tripleselect.functions.vectors import cosine_margin
    from tripleselect.operators.select import apply_quota, cluster_sizes, flat_quota, rank_in_cluster
    tv = fx.triple_vectors(spark, sf)
    scored = tv.select("triple_id", F.col("label").alias("cluster_id"), cosine_margin("vec", DIM).alias("score"))
    quotas = flat_quota(cluster_sizes(_given_clusters(tv)), BUDGET // NCLUST)
    return apply_quota(rank_in_cluster(scored, "score"), quotas).select("triple_id", "cluster_id", "rank")


# ----------------------------------------------------------------------------- C1 assignment

_CENT = """pe AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x
  FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos),
cent AS (SELECT label AS cell, list(x ORDER BY pos) AS c FROM pe GROUP BY label),
ncent AS (SELECT cell, list_transform(c, lambda x: x / sqrt(list_reduce(list_transform(c, lambda y: y * y), lambda a, b: a + b, 0.0::DOUBLE))) AS c FROM cent),
sims AS (SELECT e.vec_id, n.cell, list_reduce(list_transform(CAST(e.embedding AS DOUBLE[]), lambda x, i: x * n.c[i]), lambda a, b: a + b, 0.0::DOUBLE)
              / sqrt(list_reduce(list_transform(CAST(e.embedding AS DOUBLE[]), lambda x: x * x), lambda a, b: a + b, 0.0::DOUBLE)) AS sim
         FROM embeddings e, ncent n)"""


@register("assign_clusters", "WITH " + _CENT + """
SELECT vec_id, CAST(arg_max(cell, struct_pack(s := sim, c := -cell)) AS INT) AS cluster_id FROM sims GROUP BY vec_id""")
def q_assign_clusters(spark, sf):
    from tripleselect.operators.cluster import assign_clusters, mean_centroids
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("triple_id"), F.col("embedding").alias("vec"), "label")
    cents = mean_centroids(e, "label")
    return assign_clusters(e, cents).select(F.col("triple_id").alias("vec_id"), "cluster_id")


# ----------------------------------------------------------------------------- Q6 / Q7

@register("sample_exact", f"SELECT doc_id FROM documents ORDER BY {K.key(SEED, 'doc_id')}, doc_id LIMIT {BUDGET}")
def q_sample_exact(spark, sf):
    from tripleselect.operators.select import sample_exact
    return sample_exact(fx.table(spark, sf, "documents").select("doc_id"), BUDGET, SEED, "doc_id")


@register("subsets", K.with_(K.RANKED_EMB, K.IDS, f"""rep AS (
  SELECT r.replica, ids.*, row_number() OVER (PARTITION BY r.replica ORDER BY {K.key(SEED, 'r.replica', 'ids.triple_id')}, ids.triple_id) AS rn
  FROM ids, range(0, 3) r(replica))""")
    + "SELECT CAST(replica AS INT) AS replica, triple_id, qid, pos_id, neg_id FROM rep WHERE rn <= CAST(trunc((SELECT count(*) FROM ids) * 0.1) AS BIGINT)")
def q_subsets(spark, sf):
    from tripleselect.operators.select import subsets
    ids = fx.id_triples(spark, sf).select("triple_id", "qid", "pos_id", "neg_id")
    return subsets(ids, 10, 3, SEED).select("replica", "triple_id", "qid", "pos_id", "neg_id")


# ----------------------------------------------------------------------------- P1 P2, J4 J5 A8, E1-E4, J6

@register("clean_text", f"SELECT doc_id, {K.clean('text')} AS text FROM documents")
def q_clean_text(spark, sf):
    from tripleselect.functions.text import clean_text
    return fx.table(spark, sf, "documents").select("doc_id", clean_text("text").alias("text"))


@register("to_pairs", K.with_(*K.FIX, K.TEXT, K.pairs_cte()) + "SELECT triple_id, side, query, passage FROM pairs")
def q_to_pairs(spark, sf):
    from tripleselect.operators.bm25 import to_pairs
    return to_pairs(fx.text_triples(spark, sf))


def _pairs_scores(spark, sf, scope: str, sides=("pos", "neg")):
    from tripleselect.operators.bm25 import bm25_pairs, bm25_stats, query_vocab, to_pairs
    tt = fx.text_triples(spark, sf).withColumnRenamed("label", "cluster_id")
    pairs = to_pairs(tt, sides, keep=("cluster_id",))
    if scope == "corpus":
        st = bm25_stats(fx.table(spark, sf, "documents"), "text", vocab=query_vocab(pairs))
        return bm25_pairs(pairs.drop("cluster_id"), st)
    st = bm25_stats(pairs.select("cluster_id", "side", F.col("passage").alias("text")), "text", ("cluster_id", "side"),
                    vocab=query_vocab(pairs))
    return bm25_pairs(pairs, st)


@register("bm25_pairs_corpus", K.with_(*K.FIX, K.TEXT, *K.bm25_ctes(scope="corpus"))
          + "SELECT triple_id, side, round(score, 6) AS score FROM scores")
def q_bm25_pairs_corpus(spark, sf):
    return _pairs_scores(spark, sf, "corpus").select("triple_id", "side", F.round("score", 6).alias("score"))


@register("bm25_pairs_cluster", K.with_(*K.FIX, K.TEXT, *K.bm25_ctes(scope="cluster"))
          + "SELECT triple_id, side, round(score, 6) AS score FROM scores")
def q_bm25_pairs_cluster(spark, sf):
    return _pairs_scores(spark, sf, "cluster").select("triple_id", "side", F.round("score", 6).alias("score"))


@register("bm25_margin", K.with_(*K.FIX, K.TEXT, *K.bm25_ctes(scope="corpus"), K.MARGIN)
          + "SELECT triple_id, round(score, 6) AS score FROM margin")
def q_bm25_margin(spark, sf):
    from tripleselect.operators.bm25 import bm25_margin
    return bm25_margin(_pairs_scores(spark, sf, "corpus")).select("triple_id", F.round("score", 6).alias("score"))


_CLUSTER_BY_LABEL = "scored AS (SELECT s.triple_id, tt.label AS cluster_id, s.score FROM {src} s JOIN tt USING (triple_id))"


@register("select_cluster_bm25",
          K.with_(*K.FIX, K.TEXT, *K.bm25_ctes(("pos",), "cluster"), _CLUSTER_BY_LABEL.format(src="scores"))[:-1]
          + K.select_tail("scored", BUDGET, NCLUST, SEED, "bonus", "median"))
def q_select_cluster_bm25(spark, sf):
    from tripleselect.plans.jobs import select_cluster_bm25
    tt = fx.text_triples(spark, sf)
    out = select_cluster_bm25(tt.drop("label"), _given_clusters(tt), BUDGET, NCLUST, SEED, stats="cluster")
    return out.select("triple_id", "cluster_id", "rank", F.round("score", 6).alias("score"))


_POS_VIEW_ASSIGN = f"""pv AS (SELECT triple_id, label, list_slice(vec, 1, {2 * DIM}) AS v FROM tv),
pe AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x
  FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM pv) GROUP BY label, pos),
cent AS (SELECT label AS cell, list(x ORDER BY pos) AS c FROM pe GROUP BY label),
ncent AS (SELECT cell, list_transform(c, lambda x: x / sqrt(list_reduce(list_transform(c, lambda y: y * y), lambda a, b: a + b, 0.0::DOUBLE))) AS c FROM cent),
sims AS (SELECT p.triple_id, n.cell, list_reduce(list_transform(CAST(p.v AS DOUBLE[]), lambda x, i: x * n.c[i]), lambda a, b: a + b, 0.0::DOUBLE) AS sim
         FROM pv p, ncent n),
asg AS (SELECT triple_id, CAST(arg_max(cell, struct_pack(s := sim, c := -cell)) AS INT) AS cluster_id FROM sims GROUP BY triple_id)"""


@register("select_cluster_bm25_qpos",
          K.with_(*K.FIX, _POS_VIEW_ASSIGN,
                  K.TEXT.replace("ids.label", "asg.cluster_id AS label").replace(
                      "JOIN ids ON ids.triple_id", "JOIN asg ON asg.triple_id"),
                  *K.bm25_ctes(("pos",), "cluster"), _CLUSTER_BY_LABEL.format(src="scores"))[:-1]
          + K.select_tail("scored", BUDGET + 5, NCLUST, SEED, "bonus", "median", "ceil"))
def q_select_cluster_bm25_qpos(spark, sf):
    """Clusters = nearest label centroid in the query+positive view (P3),
    per-cluster BM25 statistics over those clusters, ceil quota."""
    from tripleselect.functions.vectors import vector_view
    from tripleselect.operators.cluster import assign_clusters, mean_centroids
    from tripleselect.plans.jobs import select_cluster_bm25_qpos
    tv = fx.triple_vectors(spark, sf)
    view = tv.select("triple_id", "label", vector_view("vec", DIM, "pos").alias("vec"))
    asg = assign_clusters(view, mean_centroids(view, "label")).select("triple_id", "cluster_id")
    tt = fx.text_triples(spark, sf).drop("label")
    out = select_cluster_bm25_qpos(tt, tv, BUDGET + 5, NCLUST, DIM, SEED, stats="cluster", assignments=fx.over_texts(asg, tt))
    return out.select("triple_id", "cluster_id", "rank", F.round("score", 6).alias("score"))


@register("select_cluster_bm25_margin",
          K.with_(*K.FIX, K.TEXT, *K.bm25_ctes(scope="corpus"), K.MARGIN, _CLUSTER_BY_LABEL.format(src="margin"))[:-1]
          + K.select_tail("scored", BUDGET, NCLUST, SEED, "bonus", "mean"))
def q_select_cluster_bm25_margin(spark, sf):
    from tripleselect.plans.jobs import select_cluster_bm25_margin
    tt = fx.text_triples(spark, sf)
    docs = fx.table(spark, sf, "documents").select("text")
    out = select_cluster_bm25_margin(tt.drop("label"), _given_clusters(tt), BUDGET, NCLUST, SEED, stats=docs)
    return out.select("triple_id", "cluster_id", "rank", F.round("score", 6).alias("score"))


@register("select_cluster_bm25_smoothed",
          K.with_(*K.FIX, K.TEXT, *K.bm25_ctes(scope="corpus"), K.MARGIN, _CLUSTER_BY_LABEL.format(src="margin"))[:-1]
          + K.select_tail("scored", BUDGET, NCLUST, SEED, "smoothed"))
def q_select_cluster_bm25_smoothed(spark, sf):
    from tripleselect.plans.jobs import select_cluster_bm25_smoothed
    tt = fx.text_triples(spark, sf)
    docs = fx.table(spark, sf, "documents").select("text")
    out = select_cluster_bm25_smoothed(tt.drop("label"), _given_clusters(tt), BUDGET, NCLUST, SEED, stats=docs)
    return out.select("triple_id", "cluster_id", "rank", F.round("score", 6).alias("score"))


RETRIEVE_K = 20


@register("bm25_retrieve", K.with_(K.CORPUS_STATS, f"""qterms AS (SELECT qid, term, count(*) AS qtf
  FROM (SELECT item_id AS qid, unnest({K.toks('text')}) AS term FROM benchmark) GROUP BY qid, term)""",
    """post AS (SELECT doc_id AS docno, dl, term, count(*) AS tf
  FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM dtok) GROUP BY ALL)""",
    f"""sc AS (SELECT qid, docno, sum({K.bm25_w()}) AS score
  FROM qterms JOIN cterms USING (term) CROSS JOIN cdocs JOIN post USING (term) GROUP BY qid, docno)""",
    "rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, docno) AS rank FROM sc)")
    + f"SELECT qid, docno, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM rk WHERE rank <= {RETRIEVE_K}")
def q_bm25_retrieve(spark, sf):
    from tripleselect.operators.bm25 import bm25_retrieve
    topics = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    out = bm25_retrieve(topics, fx.table(spark, sf, "documents"), RETRIEVE_K)
    return out.select("qid", "docno", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


# ----------------------------------------------------------------------------- A4 A5 A10/E11

def _diversity_samples(spark, sf):
    from tripleselect.operators.select import subsets
    ids = fx.id_triples(spark, sf).select("triple_id")
    sub = subsets(ids, 20, 3, SEED).select(F.concat(F.lit("subset."), F.col("replica").cast("string")).alias("run_id"),
                                           "triple_id")
    return sub.unionByName(ids.select(F.lit("all").alias("run_id"), "triple_id"))


_DIV_SQL = [f"""rep AS (
  SELECT r.replica, ids.triple_id, row_number() OVER (PARTITION BY r.replica ORDER BY {K.key(SEED, 'r.replica', 'ids.triple_id')}, ids.triple_id) AS rn
  FROM ids, range(0, 3) r(replica))""",
            """samples AS (SELECT 'subset.' || CAST(replica AS VARCHAR) AS run_id, triple_id FROM rep
  WHERE rn <= CAST(trunc((SELECT count(*) FROM ids) * 0.2) AS BIGINT)
  UNION ALL SELECT 'all' AS run_id, triple_id FROM ids)""",
            f"""tvn AS (SELECT triple_id, list_transform(CAST(vec AS DOUBLE[]), lambda x: x / {K.norm('vec')}) AS v FROM tv)""",
            f"""pw AS (SELECT sa.run_id, {K.dot('a.v', 'b.v')} AS s
  FROM samples sa JOIN tvn a USING (triple_id) JOIN samples sb ON sb.run_id = sa.run_id JOIN tvn b ON b.triple_id = sb.triple_id)""",
            "div AS (SELECT run_id, avg(s) AS avg_sim FROM pw GROUP BY run_id)",
            "cnt AS (SELECT run_id, count(*) AS n FROM samples GROUP BY run_id)"]


@register("mean_pairwise_cosine", K.with_(*K.FIX, *_DIV_SQL)
          + "SELECT run_id, n, round(avg_sim, 6) AS avg_sim FROM cnt JOIN div USING (run_id)")
def q_mean_pairwise_cosine(spark, sf):
    from tripleselect.operators.evaluate import mean_pairwise_cosine
    tv = fx.triple_vectors(spark, sf)
    out = mean_pairwise_cosine(_diversity_samples(spark, sf), tv)
    return out.select("run_id", "n", F.round("avg_sim", 6).alias("avg_sim"))


@register("diversity_report", K.with_(*K.FIX, *_DIV_SQL)
          + """SELECT run_id, CASE WHEN run_id = 'all' THEN 'all' ELSE 'subsets' END AS sampler, n, round(avg_sim, 6) AS avg_sim
FROM cnt JOIN div USING (run_id)""")
def q_diversity_report(spark, sf):
    from tripleselect.operators.evaluate import summarize_runs
    tv = fx.triple_vectors(spark, sf)
    samples = _diversity_samples(spark, sf)
    runs = samples.select("run_id").distinct().withColumn(
        "sampler", F.when(F.col("run_id") == "all", "all").otherwise("subsets"))
    out = summarize_runs(samples, runs, tv)
    return out.select("run_id", "sampler", "n", F.round("avg_sim", 6).alias("avg_sim"))


@register("cosine_to_reference", K.with_(*K.FIX, K.REF, f"""tvn AS (SELECT triple_id, list_transform(CAST(vec AS DOUBLE[]), lambda x: x / {K.norm('vec')}) AS v FROM tv)""")
          + f"""SELECT a.triple_id, round(avg({K.dot('a.v', 'b.v')}), 6) AS d
FROM tvn a, ref JOIN tvn b ON b.triple_id = ref.ref_id GROUP BY a.triple_id""")
def q_cosine_to_reference(spark, sf):
    from tripleselect.operators.evaluate import cosine_to_reference
    tv = fx.triple_vectors(spark, sf)
    out = cosine_to_reference(tv, fx.reference_ids(spark, sf))
    return out.select("triple_id", F.round("d", 6).alias("d"))


# ----------------------------------------------------------------------------- J3 exact, dense retrieval, J7, A9, E12

ANTI_N = 5
DENSE_K = 20


@register("antipodal_neighbors", K.with_(*K.FIX, f"""p AS (SELECT a.triple_id AS src, b.triple_id AS dst, {K.dot('a.vec', 'b.vec')} AS d FROM tv a, tv b)""",
                                         "rk AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(d, 9), dst) AS rank FROM p)")
          + f"SELECT src, dst, CAST(rank AS INT) AS rank, round(d, 6) AS dot FROM rk WHERE rank <= {ANTI_N}")
def q_antipodal_neighbors(spark, sf):
    from tripleselect.operators.neighbors import antipodal_neighbors
    tv = fx.triple_vectors(spark, sf).select("triple_id", "vec")
    out = antipodal_neighbors(tv, tv, ANTI_N, block_rows=256)
    return out.select("src", "dst", F.col("rank").cast("int").alias("rank"), F.round("dot", 6).alias("dot"))


def _dense_run(spark, sf):
    from tripleselect.functions.vectors import with_l2_normalized
    from tripleselect.operators.neighbors import exact_neighbors
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("triple_id"), F.col("embedding").alias("vec"))
    en = with_l2_normalized(e, "vec")
    nn = exact_neighbors(en, en, DENSE_K, largest=True, exclude_self=True, block_rows=256)
    return nn.select(F.lit("dense").alias("system"), F.col("src").alias("qid"), F.col("dst").alias("docno"),
                     F.col("dot").alias("score"), F.col("rank").cast("int").alias("rank"))


_DENSE_SQL = [K.NORM_EMB, f"""dp AS (SELECT a.vec_id AS qid, b.vec_id AS docno, {K.dot('a.v', 'b.v')} AS score FROM ne a, ne b WHERE a.vec_id <> b.vec_id)""",
              f"""dense AS (SELECT * FROM (SELECT 'dense' AS system, qid, docno, score,
  row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, docno) AS rank FROM dp) WHERE rank <= {DENSE_K})"""]

_TOK_SQL = ["tok AS (SELECT vec_id, t, list_slice(embedding, t * 16 + 1, t * 16 + 16) AS v FROM embeddings, range(0, 4) r(t))"]


def _maxsim_sql(pairs: str, key: str) -> str:
    return f"""ms AS (SELECT {key}, sum(b) AS score FROM (
  SELECT {key}, qt.t, max({K.dot('qt.v', 'dt.v')}) AS b
  FROM {pairs} pr JOIN tok qt ON qt.vec_id = pr.qid JOIN tok dt ON dt.vec_id = pr.docno GROUP BY ALL) GROUP BY ALL)"""


_RERANK_SQL = [*_TOK_SQL, _maxsim_sql("dense", "pr.qid, pr.docno").replace("SELECT pr.qid, pr.docno, sum(b)", "SELECT qid, docno, sum(b)")
               .replace("GROUP BY ALL) GROUP BY ALL", "GROUP BY ALL) GROUP BY qid, docno"),
               """rr2 AS (SELECT 'dense>>maxsim' AS system, qid, docno, score,
  row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, docno) AS rank FROM ms)""",
               "runs AS (SELECT * FROM dense UNION ALL SELECT * FROM rr2)"]


@register("dense_retrieve", K.with_(*_DENSE_SQL)
          + "SELECT system, qid, docno, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM dense")
def q_dense_retrieve(spark, sf):
    return _dense_run(spark, sf).withColumn("score", F.round("score", 6))


def _token_tables(spark, sf):
    from tripleselect.operators.evaluate import slice_tokens
    e = fx.table(spark, sf, "embeddings")
    q = slice_tokens(e, "vec_id", "embedding", 4, 16, "qid")
    d = slice_tokens(e, "vec_id", "embedding", 4, 16, "docno")
    return q, d


@register("maxsim", K.with_(K.RANKED_EMB, K.IDS, *_TOK_SQL,
                            """prs AS (SELECT triple_id, 'pos' AS side, qid, pos_id AS docno FROM ids
  UNION ALL SELECT triple_id, 'neg' AS side, qid, neg_id AS docno FROM ids)""", _maxsim_sql("prs", "triple_id, side"))
          + "SELECT triple_id, side, round(score, 6) AS score FROM ms")
def q_maxsim(spark, sf):
    from tripleselect.operators.evaluate import maxsim
    ids = fx.id_triples(spark, sf)
    pairs = (ids.select("triple_id", F.lit("pos").alias("side"), "qid", F.col("pos_id").alias("docno"))
                .unionByName(ids.select("triple_id", F.lit("neg").alias("side"), "qid", F.col("neg_id").alias("docno"))))
    qt, dt = _token_tables(spark, sf)
    out = maxsim(pairs, qt, dt, ("triple_id", "side"))
    return out.select("triple_id", "side", F.round("score", 6).alias("score"))


def _systems(spark, sf):
    from tripleselect.operators.evaluate import maxsim, rerank
    from tripleselect.session import cut_lineage
    # searched once, scored once: every use of a run would do it again
    dense = cut_lineage(_dense_run(spark, sf).drop("system")).withColumn("system", F.lit("dense"))
    qt, dt = _token_tables(spark, sf)
    scores = maxsim(dense.select("qid", "docno"), qt, dt)
    rr = cut_lineage(rerank(dense, scores, "dense>>maxsim").select("qid", "docno", "score", F.col("rank").cast("int")))
    return dense.unionByName(rr.withColumn("system", F.lit("dense>>maxsim"))).select("system", "qid", "docno", "score", "rank")


@register("rerank_dense", K.with_(*_DENSE_SQL, *_RERANK_SQL)
          + "SELECT system, qid, docno, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM rr2")
def q_rerank_dense(spark, sf):
    return _systems(spark, sf).where(F.col("system") == "dense>>maxsim").withColumn("score", F.round("score", 6))


_METRIC_BASE = [K.RANKED_EMB, K.GRADED_QRELS, *_DENSE_SQL, *_RERANK_SQL, *K.metric_ctes("runs", "gq")]


def _metric_q(fn_name: str, col: str):
    def q(spark, sf):
        from tripleselect.operators import evaluate as ev
        runs = _systems(spark, sf)
        qrels = fx.graded_qrels(spark, sf)
        fn = getattr(ev, fn_name)
        out = fn(runs, qrels, 10) if fn_name == "ndcg" else fn(runs, qrels, 2)
        return out.select("system", "qid", F.round(col, 6).alias(col))
    return q


register("reciprocal_rank", K.with_(*_METRIC_BASE) + "SELECT system, qid, round(rr, 6) AS rr FROM rr")(
    _metric_q("reciprocal_rank", "rr"))
register("average_precision", K.with_(*_METRIC_BASE) + "SELECT system, qid, round(ap, 6) AS ap FROM ap")(
    _metric_q("average_precision", "ap"))
register("ndcg_at_10", K.with_(*_METRIC_BASE) + "SELECT system, qid, round(ndcg, 6) AS ndcg FROM nd")(
    _metric_q("ndcg", "ndcg"))


_REPORT_TAIL = """SELECT system, round(sum(coalesce(rr, 0)) / (SELECT count(*) FROM topics), 6) AS rr,
       round(sum(coalesce(ap, 0)) / (SELECT count(*) FROM topics), 6) AS ap,
       round(sum(coalesce(ndcg, 0)) / (SELECT count(*) FROM topics), 6) AS ndcg
FROM rr FULL JOIN ap USING (system, qid) FULL JOIN nd USING (system, qid) GROUP BY system"""


@register("retrieval_report", K.with_(*_METRIC_BASE) + _REPORT_TAIL)
def q_retrieval_report(spark, sf):
    from tripleselect.operators.evaluate import evaluate
    out = evaluate(_systems(spark, sf), fx.graded_qrels(spark, sf), 2, 10)
    return out.select("system", *[F.round(c, 6).alias(c) for c in ("rr", "ap", "ndcg")])


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LEX_QRELS = f"""bw AS (SELECT item_id AS qid, w, least(len(w), 5) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bs AS (SELECT DISTINCT qid, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bw)),
dw AS (SELECT doc_id AS docno, {_WORDS} AS w FROM documents),
ds AS (SELECT DISTINCT docno, n, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT docno, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM bs))),
lq AS (SELECT qid, docno, CASE WHEN have = need THEN 2 ELSE 1 END AS rel
  FROM (SELECT qid, docno, count(*) AS have FROM bs JOIN ds USING (n, s) GROUP BY qid, docno)
  JOIN (SELECT qid, count(*) AS need FROM bs GROUP BY qid) USING (qid) WHERE 2 * have >= need)"""


@register("retrieval_report_bm25", K.with_(K.CORPUS_STATS, f"""qterms AS (SELECT qid, term, count(*) AS qtf
  FROM (SELECT item_id AS qid, unnest({K.toks('text')}) AS term FROM benchmark) GROUP BY qid, term)""",
    """post AS (SELECT doc_id AS docno, dl, term, count(*) AS tf
  FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM dtok) GROUP BY ALL)""",
    f"""sc AS (SELECT qid, docno, sum({K.bm25_w()}) AS score
  FROM qterms JOIN cterms USING (term) CROSS JOIN cdocs JOIN post USING (term) GROUP BY qid, docno)""",
    f"""bm AS (SELECT * FROM (SELECT 'bm25' AS system, qid, docno, score,
  row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, docno) AS rank FROM sc) WHERE rank <= {RETRIEVE_K})""",
    _LEX_QRELS, *K.metric_ctes("bm", "lq")) + _REPORT_TAIL)
def q_retrieval_report_bm25(spark, sf):
    from tripleselect.operators.bm25 import bm25_retrieve
    from tripleselect.operators.evaluate import evaluate
    topics = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    run = bm25_retrieve(topics, fx.table(spark, sf, "documents"), RETRIEVE_K).withColumn("system", F.lit("bm25"))
    out = evaluate(run, fx.lexical_qrels(spark, sf), 2, 10)
    return out.select("system", *[F.round(c, 6).alias(c) for c in ("rr", "ap", "ndcg")])


@register("lexical_qrels", "WITH " + _LEX_QRELS + " SELECT qid, docno, rel FROM lq")
def q_lexical_qrels(spark, sf):
    return fx.lexical_qrels(spark, sf)


# ----------------------------------------------------------------------------- M1-M6 acceptance sampler

ACC_DRAWS_SQL = 40   # oracle draws = 40 x rows; the Spark side grows its range until it has enough


def _acc_sql(n: int, t0: float, t1: float | None = None, horizon: int = 0, stall: int | None = None) -> str:
    if t1 is None:
        texpr = _dbl(t0)
    else:
        texpr = f"({_dbl(t0)} + {_dbl(t1 - t0)} * CAST(least(step - 1, {horizon}) AS DOUBLE) / {_dbl(float(horizon))})"
    ctes = [*K.FIX, K.REF,
            f"tvn AS (SELECT triple_id, list_transform(CAST(vec AS DOUBLE[]), lambda x: x / {K.norm('vec')}) AS v FROM tv)",
            """rb AS (SELECT pos, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos
  FROM tvn JOIN ref ON ref.ref_id = tvn.triple_id) GROUP BY pos)""",
            "rbar AS (SELECT list(m ORDER BY pos) AS r FROM rb)",
            f"proj AS (SELECT triple_id AS idx, {K.dot('v', 'r')} AS d FROM tvn, rbar)",
            "nrows AS (SELECT count(*) AS n FROM tv)",
            f"""dr AS (SELECT step, d, idx, d < {texpr} AS acc FROM (
  SELECT step, {K.key(SEED, 'step')} % (SELECT n FROM nrows) AS idx
  FROM range(1, {ACC_DRAWS_SQL} * (SELECT n FROM nrows) + 1) t(step)) JOIN proj USING (idx))"""]
    if stall:
        ctes += ["""la AS (SELECT *, coalesce(max(CASE WHEN acc THEN step END) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS L FROM dr)""",
                 f"""bl AS (SELECT *, (step - L - 1) // {stall} AS blk FROM la)""",
                 f"""st AS (SELECT L + (blk + 1) * {stall} AS step, arg_min(idx, struct_pack(d := d, s := step)) FILTER (WHERE d < 1.0) AS idx
  FROM bl GROUP BY L, blk HAVING count(*) = {stall} AND NOT bool_or(acc))""",
                 "ev AS (SELECT step, idx FROM dr WHERE acc UNION ALL SELECT step, idx FROM st WHERE idx IS NOT NULL)"]
    else:
        ctes += ["ev AS (SELECT step, idx FROM dr WHERE acc)"]
    ctes += ["fe AS (SELECT idx, min(step) AS step FROM ev GROUP BY idx)"]
    return (K.with_(*ctes) + f"""SELECT 'bulk' AS run_id, row_number() OVER (ORDER BY step, idx) AS ordinal, idx AS triple_id, step
FROM fe ORDER BY step, idx LIMIT {n}""")


def _acc_q(n: int, t0: float, t1: float | None = None, horizon: int = 0, stall: int | None = None):
    def q(spark, sf):
        from tripleselect.operators.accept import Schedule, accept_bulk
        tv = fx.triple_vectors(spark, sf).select("triple_id", "vec")
        sched = Schedule(t0, t1, horizon)
        r = accept_bulk(tv, fx.reference_ids(spark, sf), n, sched, SEED, max_steps=stall)
        return r.samples.select("run_id", F.col("ordinal").cast("long"), "triple_id", "step")
    return q


register("accept_bulk", _acc_sql(50, 0.0))(_acc_q(50, 0.0))
register("accept_bulk_t002", _acc_sql(50, 0.02))(_acc_q(50, 0.02))
register("accept_schedule", _acc_sql(50, 0.02, -0.02, 50 * 10))(_acc_q(50, 0.02, -0.02, 50 * 10))
register("accept_stall", _acc_sql(20, -0.02, stall=10))(_acc_q(20, -0.02, stall=10))


@register("accept_sample")
def q_accept_sample(spark, sf):
    """Full sampler (warm-up with C as reference set, freeze, bulk) on the
    triple vectors; rows-only here, exact against a sequential twin in tests."""
    from tripleselect.operators.accept import accept_sample
    tv = fx.triple_vectors(spark, sf).select("triple_id", "vec")
    return accept_sample(tv, 60, k=20, t=0.0, seed=SEED).samples


@register("accept_sweep")
def q_accept_sweep(spark, sf):
    """Grid k x t x max_steps, one run each; returns the runs table."""
    from tripleselect.operators.accept import accept_sweep
    tv = fx.triple_vectors(spark, sf).select("triple_id", "vec")
    _, runs = accept_sweep(tv, 40, [10], [0.0, -0.02], SEED, max_steps_list=[None, 10])
    return runs.select("run_id", "sampler", "n", "steps", "complete")


@register("accept_ablate")
def q_accept_ablate(spark, sf):
    """Sampler on the query block only (vector view 'query')."""
    from tripleselect.functions.vectors import vector_view
    from tripleselect.operators.accept import accept_sample
    tv = fx.triple_vectors(spark, sf).select("triple_id", vector_view("vec", DIM, "query").alias("vec"))
    return accept_sample(tv, 60, k=20, t=0.0, seed=SEED, run_id="ablate.query").samples


# ----------------------------------------------------------------------------- J9 J10, W1-W8, J3-IVF, C2 C4

WALK_N = 4


def _transitions(spark, sf):
    from tripleselect.operators.neighbors import antipodal_neighbors
    tv = fx.triple_vectors(spark, sf).select("triple_id", "vec")
    return antipodal_neighbors(tv, tv, WALK_N, block_rows=256).select("src", "rank", "dst", "dot")


_TRANS_SQL = [*K.FIX, f"""p AS (SELECT a.triple_id AS src, b.triple_id AS dst, {K.dot('a.vec', 'b.vec')} AS d FROM tv a, tv b)""",
              f"""tr AS (SELECT * FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY round(d, 9), dst) AS rank FROM p) WHERE rank <= {WALK_N})""",
              "cnt AS (SELECT src, count(*) AS c FROM tr GROUP BY src)"]


@register("markov_step", K.with_(*_TRANS_SQL)
          + f"""SELECT w.src AS walker, tr.dst AS state FROM cnt w
JOIN tr ON tr.src = w.src AND tr.rank = ({K.key(SEED, 'w.src', '1')} % w.c) + 1""")
def q_markov_step(spark, sf):
    """Every state is a walker; one uniform antipodal transition each."""
    from tripleselect.operators.markov import _counts, choose_std
    tr = _transitions(spark, sf)
    walkers = fx.id_triples(spark, sf).select(F.col("triple_id").alias("walker"), F.col("triple_id").alias("state"))
    return choose_std(walkers.withColumn("step", F.lit(1).cast("long")), tr, _counts(tr), SEED)


@register("constraint_choice", K.with_(*_TRANS_SQL, "ex AS (SELECT DISTINCT dst FROM tr WHERE rank = 1)",
                                       """cand AS (SELECT tr.src, tr.dst, row_number() OVER (PARTITION BY tr.src ORDER BY tr.rank) AS crn
  FROM tr WHERE tr.dst NOT IN (SELECT dst FROM ex))""",
                                       "ccnt AS (SELECT src, count(*) AS cc FROM cand GROUP BY src)",
                                       f"""fresh AS (SELECT c.src AS walker, cand.dst AS state FROM ccnt c
  JOIN cand ON cand.src = c.src AND cand.crn = ({K.key(SEED, 'c.src', '1')} % c.cc) + 1)""",
                                       f"""rest AS (SELECT w.src AS walker, tr.dst AS state FROM cnt w
  JOIN tr ON tr.src = w.src AND tr.rank = ({K.key(SEED, 'w.src', '1')} % w.c) + 1 WHERE w.src NOT IN (SELECT src FROM ccnt))""")
          + "SELECT walker, state FROM fresh UNION ALL SELECT walker, state FROM rest")
def q_constraint_choice(spark, sf):
    """Every state is a walker; choose among transitions to states outside
    the expanded set (here: every state that is some state's first
    antipodal neighbour), else among all."""
    from tripleselect.operators.markov import _counts, choose_constraint
    tr = _transitions(spark, sf)
    walkers = fx.id_triples(spark, sf).select(F.col("triple_id").alias("walker"), F.col("triple_id").alias("state"))
    expanded = tr.where(F.col("rank") == 1).select(F.col("dst").alias("state"))
    return choose_constraint(walkers.withColumn("step", F.lit(1).cast("long")), tr, _counts(tr), expanded, SEED)


def _walk_sql(tables: list[str], walkers: int, k: int, steps: int, columns: str) -> str:
    """A walk step by step in recursive SQL: chain start, uniform choice;
    ``steps`` must be enough for ``k`` states (or for all that can be reached)."""
    return "WITH RECURSIVE " + ",\n".join([*tables, f"""init AS (
  SELECT 0::BIGINT AS walker, ({K.key(f'{SEED}:start', '0')} % (SELECT count(*) FROM cnt)) AS state
  UNION ALL SELECT i.walker + 1, tr.dst FROM init i JOIN cnt ON cnt.src = i.state
  JOIN tr ON tr.src = i.state AND tr.rank = ({K.key(f'{SEED}:init', 'i.walker + 1', '0')} % cnt.c) + 1
  WHERE i.walker + 1 < {walkers})""", f"""walk AS (
  SELECT 0::BIGINT AS step, walker, state FROM init
  UNION ALL SELECT w.step + 1, w.walker, tr.dst FROM walk w JOIN cnt ON cnt.src = w.state
  JOIN tr ON tr.src = w.state AND tr.rank = ({K.key(SEED, 'w.walker', 'w.step + 1')} % cnt.c) + 1
  WHERE w.step < {steps})""", """fv AS (SELECT state, min(step * 1000000 + walker) AS v FROM walk WHERE step > 0 GROUP BY state)""",
        f"""kept AS (SELECT state AS triple_id, v, row_number() OVER (ORDER BY v) AS ordinal FROM fv
  QUALIFY ordinal <= {k})"""]) + f"""
SELECT {columns} FROM kept"""


def _trans_sql(vectors: str, n: int) -> list[str]:
    return [f"""p AS MATERIALIZED (SELECT a.triple_id AS src, b.triple_id AS dst, {K.dot('a.vec', 'b.vec')} AS d FROM {vectors} a, {vectors} b)""",
            f"""tr AS MATERIALIZED (SELECT * FROM (SELECT src, dst, d, row_number() OVER (PARTITION BY src ORDER BY round(d, 9), dst) AS rank FROM p) WHERE rank <= {n})""",
            "cnt AS MATERIALIZED (SELECT src, count(*) AS c FROM tr GROUP BY src)"]


_WALK_COLUMNS = """ordinal, triple_id, (SELECT max(v // 1000000) FROM kept) AS steps,
  (SELECT count(*) FROM kept) >= {k} AS complete"""
_WEIGHTED = f"""sv AS (SELECT triple_id, list_transform(CAST(vec AS DOUBLE[]), lambda x, i:
    x * CASE WHEN i <= {DIM} THEN 0.5::DOUBLE WHEN i <= {2 * DIM} THEN 0.3::DOUBLE ELSE {1.0 - 0.5 - 0.3!r}::DOUBLE END) AS s FROM tv),
wv AS MATERIALIZED (SELECT triple_id, list_transform(s, lambda x: x / {K.norm('s')}) AS vec FROM sv)"""


def _walk_rows(samples: DataFrame, run: dict) -> DataFrame:
    return samples.select(F.col("ordinal").cast("long").alias("ordinal"), "triple_id",
                          F.lit(run["steps"]).cast("long").alias("steps"), F.lit(run["complete"]).alias("complete"))


@register("markov_sample", _walk_sql([*K.FIX, _WEIGHTED, *_trans_sql("wv", WALK_N)], 16, 100, 60,
                                     "'markov' AS run_id, ordinal::INTEGER AS ordinal, triple_id"))
def q_markov_sample(spark, sf):
    """16 walkers, chain init, uniform choice, over weighted vectors."""
    from tripleselect.functions.vectors import weight_vectors
    from tripleselect.operators.markov import markov_sample
    from tripleselect.operators.neighbors import antipodal_neighbors
    tv = fx.triple_vectors(spark, sf).select("triple_id", "vec")
    wv = weight_vectors(tv, "vec", DIM, 0.5, 0.3)
    tr = antipodal_neighbors(wv, wv, WALK_N, block_rows=256)
    samples, _ = markov_sample(tr, 100, walkers=16, seed=SEED, init="chain", choice="std")
    return samples


@register("markov_lazy", _walk_sql([*K.FIX, *_trans_sql("tv", WALK_N)], 16, 60, 60, _WALK_COLUMNS.format(k=60)))
def q_markov_lazy(spark, sf):
    """16 walkers whose states are searched when first stood on; the SQL has
    every state's transitions beforehand."""
    from tripleselect.operators.markov import markov_sample
    from tripleselect.operators.neighbors import antipodal_neighbors
    tv = fx.triple_vectors(spark, sf).select("triple_id", "vec")

    def search(states: DataFrame) -> DataFrame:
        return antipodal_neighbors(states.withColumnRenamed("state", "triple_id").join(tv, "triple_id"), tv, WALK_N)

    return _walk_rows(*markov_sample(search, 60, walkers=16, seed=SEED, vectors=tv))


@register("markov_doubled", _walk_sql([*K.FIX, *_trans_sql("tv", 1)], 16, 10_000, 300, _WALK_COLUMNS.format(k=10_000)))
def q_markov_doubled(spark, sf):
    """16 walkers over the single most dissimilar triple of each, until
    nothing else can be reached; steps are doubled, not taken one by one."""
    from tripleselect.operators.markov import markov_sample
    from tripleselect.operators.neighbors import antipodal_neighbors
    tv = fx.triple_vectors(spark, sf).select("triple_id", "vec")
    return _walk_rows(*markov_sample(antipodal_neighbors(tv, tv, 1), 10_000, walkers=16, seed=SEED))


@register("markov_sample_constraint")
def q_markov_sample_constraint(spark, sf):
    """4 walkers, mean init, constraint choice (fresh states first)."""
    from tripleselect.operators.markov import markov_sample
    tv = fx.triple_vectors(spark, sf).select("triple_id", "vec")
    tr = _transitions(spark, sf)
    samples, _ = markov_sample(tr, 40, walkers=4, seed=SEED, init="mean", choice="constraint", vectors=tv)
    return samples


@register("antipodal_ivf", K.with_(*K.FIX, *_trans_sql("tv", WALK_N))
          + "SELECT src, dst, rank::INTEGER AS rank, round(d, 6) AS dot FROM tr")
def q_antipodal_ivf(spark, sf):
    """The antipodal top-n of every triple from a stored cell index."""
    from tripleselect.operators.cellindex import CellIndex
    from tripleselect.session import shared_path
    tv = fx.triple_vectors(spark, sf).select("triple_id", "vec")
    index = CellIndex.build(tv, 20, shared_path(spark, "cells"), max_iter=10, seed=SEED)
    out = index.search(tv, WALK_N, largest=False)
    return out.select("src", "dst", F.col("rank").cast("int").alias("rank"), F.round("dot", 6).alias("dot"))


@register("cluster_kmeans")
def q_cluster_kmeans(spark, sf):
    from tripleselect.operators.cluster import cluster_kmeans
    tv = fx.triple_vectors(spark, sf).select("triple_id", "vec")
    return cluster_kmeans(tv, NCLUST, max_iter=10, seed=SEED)


@register("sweep_clusters")
def q_sweep_clusters(spark, sf):
    from tripleselect.operators.cluster import sweep_clusters
    tv = fx.triple_vectors(spark, sf).select("triple_id", "vec")
    return sweep_clusters(tv, [5, 10], max_iter=10, seed=SEED)


@register("select_cluster_cosine_kmeans")
def q_select_cluster_cosine_kmeans(spark, sf):
    """E5 end to end: spherical k-means clusters (not the given labels)."""
    from tripleselect.operators.cluster import cluster_kmeans
    from tripleselect.plans.jobs import select_cluster_cosine
    tv = fx.triple_vectors(spark, sf).select("triple_id", "vec")
    asg = cluster_kmeans(tv, NCLUST, max_iter=10, seed=SEED)
    return select_cluster_cosine(tv, asg, BUDGET, NCLUST, DIM, SEED)


LLOYD_KS, LLOYD_ROUNDS = (5, 10), 3


def _lloyd_sql(ks: tuple[int, ...], rounds: int) -> list[str]:
    """Spherical k-means of several counts, one CTE for every half round."""
    unit = "list_transform({v}, lambda x: x / greatest(sqrt(list_reduce(list_transform({v}, lambda y: y * y), lambda a, b: a + b, 0.0::DOUBLE)), 1e-300))"
    out = [f"xn AS MATERIALIZED (SELECT triple_id, {unit.format(v='v')} AS v FROM (SELECT triple_id, CAST(vec AS DOUBLE[]) AS v FROM tv))",
           "c0 AS MATERIALIZED (" + " UNION ALL ".join(
               f"SELECT {k} AS nclust, i AS cell, v FROM (SELECT v, row_number() OVER (ORDER BY {K.key(f'{SEED}:{k}', 'triple_id')}, triple_id) - 1 AS i FROM xn) WHERE i < {k}"
               for k in ks) + ")"]
    for r in range(rounds + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT x.triple_id, c.nclust,
  arg_max(c.cell, struct_pack(s := round(list_dot_product(x.v, c.v), 12), c := -c.cell)) AS cell
  FROM xn x, c{r} c GROUP BY x.triple_id, c.nclust)""")
        if r < rounds:
            out.append(f"""m{r} AS (SELECT nclust, cell, list(s ORDER BY pos) AS v FROM (
  SELECT nclust, cell, pos, sum(e) AS s FROM (SELECT a.nclust, a.cell, unnest(x.v) AS e, generate_subscripts(x.v, 1) AS pos
    FROM a{r} a JOIN xn x USING (triple_id)) GROUP BY nclust, cell, pos) GROUP BY nclust, cell),
c{r + 1} AS MATERIALIZED (SELECT c.nclust, c.cell, CASE WHEN m.v IS NULL THEN c.v ELSE {unit.format(v='m.v')} END AS v
  FROM c{r} c LEFT JOIN m{r} m USING (nclust, cell))""")
    return out


_SWEEP_SQL = [*K.FIX, *_lloyd_sql(LLOYD_KS, LLOYD_ROUNDS)]


def _sweep(spark, sf):
    from tripleselect.operators.cluster import assign_sweep, lloyd, start_centroids
    tv = fx.triple_vectors(spark, sf).select("triple_id", "vec")
    return tv, assign_sweep(tv, lloyd(tv, start_centroids(tv, list(LLOYD_KS), SEED), LLOYD_ROUNDS))


@register("sweep_lloyd", K.with_(*_SWEEP_SQL)
          + f"SELECT nclust, triple_id, cell::INTEGER AS cluster_id FROM a{LLOYD_ROUNDS}")
def q_sweep_lloyd(spark, sf):
    """C4 / A7: k-means of several counts, one scan a round for all."""
    return _sweep(spark, sf)[1]


@register("select_cluster_cosine_multi", K.with_(*_SWEEP_SQL, f"""scored AS (
  SELECT a.nclust, triple_id, a.cell AS cluster_id, {K.margin('tv.vec', DIM)} AS score FROM a{LLOYD_ROUNDS} a JOIN tv USING (triple_id))""", """sizes AS (
  SELECT nclust, cluster_id, count(*) AS size FROM scored GROUP BY nclust, cluster_id)""", f"""quota AS (
  SELECT nclust, cluster_id, {BUDGET} // nclust + CASE WHEN size > s THEN CAST(floor(s / ({BUDGET} // nclust)) AS INT) ELSE 0 END AS quota
  FROM sizes JOIN (SELECT nclust, median(size) AS s FROM sizes GROUP BY nclust) USING (nclust))""", """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY nclust, cluster_id ORDER BY round(score, 9), triple_id) AS rank FROM scored)""")
    + f"""SELECT nclust, triple_id, cluster_id::INTEGER AS cluster_id, CAST(rank AS INT) AS rank, round(score, 6) AS score
FROM ranked JOIN quota USING (nclust, cluster_id) WHERE rank <= quota
QUALIFY row_number() OVER (PARTITION BY nclust ORDER BY {K.key(SEED, 'triple_id')}, triple_id) <= {BUDGET}""")
def q_select_cluster_cosine_multi(spark, sf):
    """E5 over several cluster counts in one plan."""
    from tripleselect.plans.jobs import select_cluster_cosine_multi
    tv, asg = _sweep(spark, sf)
    return select_cluster_cosine_multi(tv, asg, BUDGET, DIM, SEED).withColumn("score", F.round("score", 6))


# ----------------------------------------------------------------------------- E9 E10 E13

def _export_samples(texts):
    from tripleselect.operators.select import subsets
    sub = subsets(texts.select("triple_id"), 10, 2, SEED)
    w = Window.partitionBy("replica").orderBy("triple_id")
    return sub.select(F.concat(F.lit("selected.s"), F.col("replica").cast("string"), F.lit(".pkl")).alias("run_id"),
                      F.row_number().over(w).cast("long").alias("ordinal"), "triple_id")


def _tsv(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[\\t\\r\\n]', ' ', 'g') AS {x}"


@register("export_runs", K.with_(*K.FIX, K.TEXT, f"""rep AS (
  SELECT r.replica, tt.triple_id, row_number() OVER (PARTITION BY r.replica ORDER BY {K.key(SEED, 'r.replica', 'tt.triple_id')}, tt.triple_id) AS rn
  FROM tt, range(0, 2) r(replica))""", """samples AS (SELECT 'selected.s' || CAST(replica AS VARCHAR) || '.pkl' AS run_id,
  row_number() OVER (PARTITION BY replica ORDER BY triple_id) AS ordinal, triple_id
  FROM rep WHERE rn <= CAST(trunc((SELECT count(*) FROM tt) * 0.1) AS BIGINT))""")
          + f"""SELECT 'export.' || regexp_replace(run_id, '\\.pkl$', '') AS run, ordinal, triple_id,
  {_tsv('query')}, {_tsv('psg_pos')}, {_tsv('psg_neg')}
FROM samples JOIN tt USING (triple_id)""")
def q_export_runs(spark, sf):
    from tripleselect.plans.jobs import export_runs
    tt = fx.text_triples(spark, sf)
    return export_runs(_export_samples(tt), tt, prefix="export")


@register("embed_triples")
def q_embed_triples(spark, sf):
    """Encode benchmark queries and document passages with the built-in
    hashing encoder and assemble 192-float triple vectors."""
    from tripleselect.operators.assemble import embed_triples
    nd = fx.table(spark, sf, "documents").count()
    nb = fx.table(spark, sf, "benchmark").count()
    tids = fx.text_triples(spark, sf).select("triple_id", F.pmod("triple_id", F.lit(nb)).alias("qid"),
                      F.pmod("triple_id", F.lit(nd)).alias("pos_id"),
                      F.pmod(F.col("triple_id") + F.lit(nd // 2), F.lit(nd)).alias("neg_id"))
    queries = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    passages = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    out = embed_triples(tids, queries, passages)
    return out.select("triple_id", *_vcheck("vec"))


# ----------------------------------------------------------------------------- whole jobs: E5, E8, E11

def _job_sql(picked: str, name: str, steps: str, complete: str) -> str:
    """The report's row of one job from the SQL of its sample."""
    return f"""SELECT '{name}' AS run_id, '{name}' AS sampler, (SELECT count(*) FROM s_{name}) AS n, {steps} AS steps, {complete} AS complete,
  round((SELECT avg({K.dot('a.v', 'b.v')}) FROM s_{name} x JOIN tvn a ON a.triple_id = x.triple_id, s_{name} y JOIN tvn b ON b.triple_id = y.triple_id), 6) AS avg_sim"""


@register("job_report", K.with_(*K.FIX, f"""tvn AS MATERIALIZED (SELECT triple_id, list_transform(CAST(vec AS DOUBLE[]), lambda x: x / {K.norm('vec')}) AS v FROM tv)""",
                                "s_cluster_cosine AS MATERIALIZED (" + ORACLES["select_cluster_cosine"] + ")",
                                "s_markov AS MATERIALIZED (" + ORACLES["markov_lazy"] + ")")
          + _job_sql("s_cluster_cosine", "cluster_cosine", "NULL::BIGINT", "true")
          + " UNION ALL " + _job_sql("s_markov", "markov", "(SELECT max(steps) FROM s_markov)", "(SELECT bool_and(complete) FROM s_markov)"))
def q_job_report(spark, sf):
    """Two whole jobs: vectors written to files, runs committed, the report
    read back from them (without the seconds)."""
    from tripleselect.plans import runs
    from tripleselect.session import shared_path
    from tripleselect.sources import io
    tv = fx.triple_vectors(spark, sf)
    folder = shared_path(spark, "jobs")
    io.write_vectors(tv, f"{folder}/vectors")
    runs.run_job(spark, "cluster_cosine", f"{folder}/out", "cluster_cosine", f"{folder}/vectors", budget=BUDGET, nclust=NCLUST, dim=DIM,
                 seed=SEED, assignments=_given_clusters(tv))
    runs.run_job(spark, "markov", f"{folder}/out", "markov", f"{folder}/vectors", budget=60, n=WALK_N, seed=SEED, walkers=16, lazy=True)
    return runs.report(spark, f"{folder}/out", io.read_vectors(spark, f"{folder}/vectors")).select(
        "run_id", "sampler", "n", "steps", "complete", F.round("avg_sim", 6).alias("avg_sim"))


# ----------------------------------------------------------------------------- C3, E6

@register("cluster_density")
def q_cluster_density(spark, sf):
    """The longest-lived density clusters of the triple vectors
    (min_cluster_size = budget // nclust); -1 = noise."""
    from tripleselect.operators.density import cluster_density
    tv = fx.triple_vectors(spark, sf).select("triple_id", "vec")
    return cluster_density(tv, BUDGET // NCLUST, block_rows=256)


@register("select_density_bm25_margin")
def q_select_density_bm25_margin(spark, sf):
    """E6: density clusters, BM25 margin (per-cluster statistics), flat quota."""
    from tripleselect.operators.density import cluster_density
    from tripleselect.plans.jobs import select_density_bm25_margin
    tv = fx.triple_vectors(spark, sf).select("triple_id", "vec")
    asg = cluster_density(tv, BUDGET // NCLUST, block_rows=256)
    tt = fx.text_triples(spark, sf).drop("label")
    return select_density_bm25_margin(tt, fx.over_texts(asg, tt), BUDGET, NCLUST, SEED, stats="cluster")
