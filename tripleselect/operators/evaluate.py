"""Diversity and retrieval metrics.

* mean pairwise cosine of a sample (diagonal included) in closed form:
  mean_ij x̂_i·x̂_j = ||mean_i x̂_i||², one aggregate per (run, dimension) -
  O(n·d) with map-side partial sums, no n² matrix and no collected group.
* RR / AP at a relevance threshold and nDCG@k, per (system, topic), then
  the mean per system over all judged topics (topics with nothing retrieved
  count as 0; topics without judgements are dropped).
* MaxSim late interaction and re-ranking of a fixed candidate set; vectors are met in stored blocks, never copied per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleselect.functions.vectors import dot, norm, with_l2_normalized
from tripleselect.operators.neighbors import block_join
from tripleselect.operators.select import rank_within, top_k_per_group

#: Documents that one row of a query asks for, about; products of tokens computed at once.
ASKED, PRODUCTS = 1000, 1 << 18


def unit_sums(df: DataFrame, group_col: str, vec_col: str = "vec") -> DataFrame:
    """(group, pos, s, n): per group, the element-wise sum ``s`` of the
    L2-normalised vectors and the row count ``n``.  Each Arrow batch is
    summed in numpy (a map-side combine), so only (groups x d) partial rows
    per batch are shuffled; a group is never collected."""
    def part(it):
        for pdf in it:
            if len(pdf) == 0:
                continue
            x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vec_col]])
            nx = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.where(nx > 0, x / np.where(nx > 0, nx, 1.0), 0.0)
            g = pdf[group_col].to_numpy()
            for key in pd.unique(g):
                m = g == key
                sv = x[m].sum(axis=0)
                yield pd.DataFrame({group_col: key, "pos": np.arange(len(sv), dtype=np.int32), "s": sv,
                                    "n": np.full(len(sv), int(m.sum()), dtype=np.int64)})

    gtype = dict(df.dtypes)[group_col]
    partial = df.select(group_col, vec_col).mapInPandas(part, f"{group_col} {gtype}, pos int, s double, n long")
    return partial.groupBy(group_col, "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def mean_pairwise_cosine(samples: DataFrame, vectors: DataFrame, run_col: str = "run_id",
                         id_col: str = "triple_id", vec_col: str = "vec") -> DataFrame:
    """(run_id, n, avg_sim) for every run of ``samples`` (run_id, triple_id)."""
    x = samples.select(run_col, id_col).join(vectors.select(id_col, vec_col), id_col)
    per_dim = unit_sums(x, run_col, vec_col)
    # ||mean of unit vectors||^2 per run, over d rows per run
    return (per_dim.groupBy(run_col)
                   .agg(F.max("n").alias("n"),
                        F.sum((F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))).alias("avg_sim"))
                   .select(run_col, "n", "avg_sim"))


def reference_mean(vectors: DataFrame, ref_ids: DataFrame, id_col: str = "triple_id",
                   vec_col: str = "vec", ref_col: str = "ref_id") -> DataFrame:
    """One row (rbar): mean of the normalised reference vectors."""
    r = (vectors.join(ref_ids.select(F.col(ref_col).alias(id_col)), id_col)
                .select(F.lit(0).alias("__g"), vec_col))
    per_dim = unit_sums(r, "__g", vec_col).select("pos", (F.col("s") / F.col("n")).alias("m"))
    return per_dim.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("rbar"))


def cosine_to_reference(vectors: DataFrame, ref_ids: DataFrame, id_col: str = "triple_id",
                        vec_col: str = "vec", ref_col: str = "ref_id") -> DataFrame:
    """(id, d): mean cosine of each row to a reference set = x̂ · mean(r̂).
    The mean is d floats, computed once and attached as a literal."""
    rbar = reference_mean(vectors, ref_ids, id_col, vec_col, ref_col).first()["rbar"]
    lit = F.array(*[F.lit(float(v)) for v in rbar])
    x = with_l2_normalized(vectors.select(id_col, vec_col), vec_col)
    return x.select(id_col, dot(vec_col, lit).alias("d"))


# --------------------------------------------------------------------------- retrieval metrics

def _judged(rankings: DataFrame, qrels: DataFrame) -> DataFrame:
    return (rankings.join(qrels.select("qid", "docno", "rel"), ["qid", "docno"], "left")
                    .withColumn("rel", F.coalesce("rel", F.lit(0))))


def reciprocal_rank(rankings: DataFrame, qrels: DataFrame, rel: int = 2) -> DataFrame:
    """(system, qid, rr): 1 / rank of the first document graded >= rel."""
    j = _judged(rankings, qrels)
    judged_topics = qrels.select("qid").distinct()
    first = (j.where(F.col("rel") >= rel).groupBy("system", "qid").agg(F.min("rank").alias("r")))
    sys_topics = j.select("system", "qid").distinct().join(judged_topics, "qid")
    return (sys_topics.join(first, ["system", "qid"], "left")
                      .select("system", "qid", F.coalesce(1.0 / F.col("r"), F.lit(0.0)).alias("rr")))


def average_precision(rankings: DataFrame, qrels: DataFrame, rel: int = 2) -> DataFrame:
    """(system, qid, ap): sum of precision at each relevant rank divided by
    the number of documents graded >= rel in the judgements."""
    nrel = qrels.where(F.col("rel") >= rel).groupBy("qid").agg(F.count(F.lit(1)).alias("nrel"))
    j = _judged(rankings, qrels)
    hits = j.where(F.col("rel") >= rel)
    w = Window.partitionBy("system", "qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    prec = hits.withColumn("p", F.count(F.lit(1)).over(w) / F.col("rank"))
    s = prec.groupBy("system", "qid").agg(F.sum("p").alias("sp"))
    sys_topics = j.select("system", "qid").distinct().join(qrels.select("qid").distinct(), "qid")
    return (sys_topics.join(s, ["system", "qid"], "left").join(nrel, "qid", "left")
                      .select("system", "qid", F.when(F.col("nrel") > 0, F.coalesce("sp", F.lit(0.0)) / F.col("nrel"))
                              .otherwise(F.lit(0.0)).alias("ap")))


def ndcg(rankings: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(system, qid, ndcg): DCG@k / IDCG@k with gain = grade and discount
    log2(rank + 1).  The ideal list is a salted top-k over the judgements,
    so a topic with very many judged documents is never sorted whole."""
    j = _judged(rankings, qrels).where(F.col("rank") <= k)
    dcg = j.groupBy("system", "qid").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = top_k_per_group(qrels.where(F.col("rel") > 0), ["qid"], [F.col("rel").desc()], k, "docno", rank_col="i")
    idcg = ideal.groupBy("qid").agg(F.sum(F.col("rel") / F.log2(F.col("i") + 1)).alias("idcg"))
    sys_topics = j.select("system", "qid").union(rankings.select("system", "qid")).distinct() \
        .join(qrels.select("qid").distinct(), "qid")
    return (sys_topics.join(dcg, ["system", "qid"], "left").join(idcg, "qid", "left")
                      .select("system", "qid", F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg"))
                              .otherwise(F.lit(0.0)).alias("ndcg")))


def evaluate(rankings: DataFrame, qrels: DataFrame, rel: int = 2, k: int = 10) -> DataFrame:
    """(system, rr, ap, ndcg): means over every judged topic; a judged topic
    a system retrieved nothing for counts 0 (the per-topic tables hold only
    retrieved topics, so sums are divided by the judged-topic count)."""
    n_topics = qrels.select("qid").distinct().count()
    rr = reciprocal_rank(rankings, qrels, rel)
    ap = average_precision(rankings, qrels, rel)
    nd = ndcg(rankings, qrels, k)
    per = rr.join(ap, ["system", "qid"], "full").join(nd, ["system", "qid"], "full")
    return per.groupBy("system").agg(*[(F.sum(F.coalesce(c, F.lit(0.0))) / F.lit(max(n_topics, 1))).alias(c)
                                       for c in ("rr", "ap", "ndcg")])


# --------------------------------------------------------------------------- late interaction, rerank

def slice_tokens(vectors: DataFrame, id_col: str, vec_col: str, tokens: int, width: int,
                 out_id: str = "id") -> DataFrame:
    """(id, tok, vec): a vector read as ``tokens`` token vectors of ``width``."""
    return vectors.select(F.col(id_col).alias(out_id),
                          F.explode(F.sequence(F.lit(0), F.lit(tokens - 1))).alias("tok"), vec_col) \
                  .select(out_id, "tok", F.slice(vec_col, F.col("tok") * width + 1, F.lit(width)).alias("vec"))


def token_lists(tokens: DataFrame, id_col: str, name: str) -> DataFrame:
    """(id, name): the token vectors of each id as one list of (tok, vec), sorted by tok."""
    kind = "array<float>" if dict(tokens.dtypes)["vec"] == "array<float>" else "array<double>"
    one = F.struct("tok", F.col("vec").cast(kind).alias("vec"))
    return tokens.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.sort_array(F.collect_list(one)).alias(name))


class Tokens:
    """The token lists of a block: ``first[i]`` is where row ``i``'s tokens
    start; per token its name, its length and whether it is whole, per place
    the elements of all tokens (0 where a token is shorter)."""

    def __init__(self, lists: pa.ListArray):
        flat = lists.flatten()
        self.first = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))).astype(np.int64)
        self.tok, vec = flat.field("tok"), flat.field("vec")
        # flatten() leaves out null lists, field() keeps what a parent's offset hides: both are whole here
        size = pc.fill_null(pc.list_value_length(vec), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        x = vec.flatten()
        who = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size)
        self.at = np.zeros((int(size.max(initial=0)), len(size)))
        self.at[place, who] = pc.fill_null(x, 0.0).to_numpy(zero_copy_only=False)
        self.whole = vec.is_valid().to_numpy(zero_copy_only=False).copy()
        self.whole[who[x.is_null(nan_is_null=False).to_numpy(zero_copy_only=False)]] = False
        self.size = size

    def __len__(self) -> int:
        return len(self.size)


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...``, ``count[i]`` of them, one row after another."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def best_products(q: Tokens, d: Tokens, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Per token of row ``i[k]`` of ``q``, for all ``k``: its best inner product
    with a token of row ``j[k]`` of ``d``; -inf if it has none.  Sums are
    left to right, in double precision, as ``functions.vectors.dot``."""
    nq, nd = np.diff(q.first)[i], np.diff(d.first)[j]
    x = spread(q.first[i], nq)
    per = np.repeat(nd, nq)
    y = spread(np.repeat(d.first[j], nq), per)
    x = np.repeat(x, per)
    s = np.zeros(len(x))
    for k in range(min(len(q.at), len(d.at))):
        s += q.at[k][x] * d.at[k][y]
    s[~(q.whole[x] & d.whole[y] & (q.size[x] == d.size[y]))] = -np.inf
    return np.maximum.reduceat(s, np.cumsum(per) - per) if len(s) else s


def pair_bests(pairs: DataFrame, query_tokens: DataFrame, doc_tokens: DataFrame) -> DataFrame:
    """(qid, docno, best): per pair, ``best`` lists (qtok, best) of every query
    token, null where no product is defined.

    Queries with the documents asked of them, and documents, are stored in
    blocks once each and met by ``block_join``: no vector is copied per pair."""
    asked = pairs.select("qid", "docno").where(F.col("qid").isNotNull() & F.col("docno").isNotNull())
    # a query asked for very many documents is several rows
    parts = asked.groupBy("qid").agg(F.ceil(F.count(F.lit(1)) / ASKED).alias("parts"))
    asked = (asked.join(parts, "qid").groupBy("qid", F.pmod(F.xxhash64("docno"), F.col("parts")).alias("part"))
                  .agg(F.collect_set("docno").alias("docs")))
    q = asked.join(token_lists(query_tokens, "qid", "tokens"), "qid").select("qid", "docs", "tokens")
    d = token_lists(doc_tokens, "docno", "tokens").select("docno", "tokens")
    bytes_ = doc_tokens.agg(F.avg(F.size("vec")).alias("w"), F.count(F.lit(1)).alias("n"),
                            F.approx_count_distinct("docno").alias("docs")).first()
    row_bytes = math.ceil((8 * max(bytes_["w"] or 1, 1) + 16) * bytes_["n"] / max(1, bytes_["docs"]))
    tok, qid, docno = (dict(t.dtypes)[c] for t, c in ((query_tokens, "tok"), (q, "qid"), (pairs, "docno")))

    def meet(left: pa.RecordBatch, rights: Iterator[pa.RecordBatch]) -> pa.RecordBatch | None:
        q, asked = Tokens(left.column("tokens")), left.column("docs")
        row = np.repeat(np.arange(left.num_rows), pc.list_value_length(asked).to_numpy(zero_copy_only=False))
        asked = asked.flatten()
        want = pd.Index(asked.to_numpy(zero_copy_only=False))
        # tokens of one name are one, whichever is best
        names, nth = pd.factorize(q.tok.to_numpy(zero_copy_only=False), use_na_sentinel=False)[0], np.zeros(len(q), bool)
        nth[q.first[:-1]] = True
        nth[1:] |= names[1:] != names[:-1]
        out = []
        for right in rights:
            at = pd.Index(right.column("docno").to_numpy(zero_copy_only=False)).get_indexer(want)
            met = np.flatnonzero(at >= 0)
            if not len(met):
                continue
            d = Tokens(right.column("tokens"))
            work = np.cumsum(np.diff(q.first)[row[met]] * np.diff(d.first)[at[met]])
            for part in np.split(met, np.searchsorted(work, np.arange(PRODUCTS, work[-1], PRODUCTS))):
                if not len(part):
                    continue
                i = row[part]
                best = best_products(q, d, i, at[part])
                x = spread(q.first[i], np.diff(q.first)[i])
                begin = np.flatnonzero(nth[x])
                best = np.maximum.reduceat(best, begin)
                per = np.add.reduceat(nth[x].astype(np.int64), np.cumsum(np.diff(q.first)[i]) - np.diff(q.first)[i])
                pair = pa.StructArray.from_arrays([q.tok.take(pa.array(x[begin])), pa.array(best, mask=np.isneginf(best))], ["qtok", "best"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)), pa.int32()), pair)
                out.append(pa.RecordBatch.from_arrays([left.column("qid").take(pa.array(i)), asked.take(pa.array(part)), lists],
                                                      names=["qid", "docno", "best"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    return block_join(q, d, row_bytes, meet, f"qid {qid}, docno {docno}, best array<struct<qtok:{tok},best:double>>")


def maxsim(pairs: DataFrame, query_tokens: DataFrame, doc_tokens: DataFrame,
           key_cols: tuple[str, ...] = ("qid", "docno")) -> DataFrame:
    """(key..., score): sum over query tokens of the best dot product with
    any document token.  ``pairs`` holds (key..., qid, docno); token tables
    (qid, tok, vec) and (docno, tok, vec).  Only candidate pairs are scored,
    where both vectors lie (``pair_bests``)."""
    key = list(key_cols)
    bests = pair_bests(pairs, query_tokens, doc_tokens)
    if set(key) == {"qid", "docno"}:
        known = F.filter("best", lambda b: b["best"].isNotNull())
        score = F.aggregate(known, F.lit(0.0).cast("double"), lambda acc, b: acc + b["best"])
        return bests.select(*key, F.when(F.size(known) > 0, score).alias("score"))
    per = (pairs.select(*dict.fromkeys(key + ["qid", "docno"])).join(bests.select("qid", "docno", F.explode("best").alias("b")), ["qid", "docno"])
                .select(*key, "b.qtok", "b.best").groupBy(*key, "qtok").agg(F.max("best").alias("best")))
    return per.groupBy(*key).agg(F.sum("best").alias("score"))


def rerank(candidates: DataFrame, scores: DataFrame, system: str, k: int | None = None) -> DataFrame:
    """Keep the candidate set (qid, docno), replace its scores, rank again
    (score desc rounded to 9 decimals, then docno)."""
    c = candidates.select("qid", "docno").join(scores.select("qid", "docno", "score"), ["qid", "docno"])
    if k is None:
        ranked = rank_within(c, ["qid"], [F.round("score", 9).desc(), F.col("docno")])
    else:
        ranked = top_k_per_group(c, ["qid"], [F.round("score", 9).desc()], k, "docno")
    return ranked.withColumn("system", F.lit(system))


def summarize_runs(samples: DataFrame, runs: DataFrame, vectors: DataFrame, id_col: str = "triple_id",
                   vec_col: str = "vec") -> DataFrame:
    """Per-run report: every ``runs`` column plus n and avg_sim."""
    div = mean_pairwise_cosine(samples, vectors, "run_id", id_col, vec_col)
    return runs.join(div, "run_id", "left")
