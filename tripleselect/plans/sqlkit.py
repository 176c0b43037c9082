"""SQL text builders for the independent DuckDB oracle.

The oracle re-derives every fixture and every operator in plain SQL from
the raw tables.  Vector sums are written left-to-right with ``list_reduce``
so they match the Spark side bit-for-bit.
"""

from __future__ import annotations

from tripleselect.functions.rand import sql_hash_key


def dot(a: str, b: str) -> str:
    return (f"list_reduce(list_transform(CAST({a} AS DOUBLE[]), lambda x, i: x * CAST({b} AS DOUBLE[])[i]), "
            f"lambda acc, x: acc + x, 0.0::DOUBLE)")


def norm(a: str) -> str:
    return f"sqrt({dot(a, a)})"


def cosine(a: str, b: str) -> str:
    den = f"({norm(a)} * {norm(b)})"
    return f"(CASE WHEN {den} > 0 THEN {dot(a, b)} / {den} ELSE 0.0 END)"


def block(v: str, dim: int, i: int) -> str:
    return f"list_slice({v}, {i * dim + 1}, {(i + 1) * dim})"


def margin(v: str, dim: int) -> str:
    return f"({cosine(block(v, dim, 0), block(v, dim, 1))} - {cosine(block(v, dim, 0), block(v, dim, 2))})"


def key(seed, *exprs: str) -> str:
    return sql_hash_key(seed, *exprs)


RANKED_EMB = """r AS (
  SELECT vec_id, embedding, label,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn,
         count(*) OVER (PARTITION BY label) AS cnt
  FROM embeddings)"""

IDS = """ids AS (
  SELECT q.vec_id AS triple_id, q.vec_id AS qid, p.vec_id AS pos_id, n.vec_id AS neg_id, q.label AS label
  FROM r q
  JOIN r p ON p.label = q.label AND p.rn = (q.rn % q.cnt) + 1
  JOIN r n ON n.label = (q.label + 1) % 10 AND n.rn = ((q.rn - 1) % n.cnt) + 1)"""

TV = """tv AS (
  SELECT ids.triple_id, ids.label, list_concat(list_concat(eq.embedding, ep.embedding), en.embedding) AS vec
  FROM ids
  JOIN embeddings eq ON eq.vec_id = ids.qid
  JOIN embeddings ep ON ep.vec_id = ids.pos_id
  JOIN embeddings en ON en.vec_id = ids.neg_id)"""

TEXT = """nt AS (SELECT (SELECT count(*) FROM documents) AS nd, (SELECT count(*) FROM ids) AS ni,
  (SELECT count(*) FROM benchmark) AS nb),
tt AS (
  SELECT t.triple_id, ids.label, b.text AS query, dp.text AS psg_pos, dn.text AS psg_neg
  FROM (SELECT unnest(range(0, greatest(nd, ni))) AS triple_id, nd, ni, nb FROM nt) t
  JOIN ids ON ids.triple_id = t.triple_id % t.ni
  JOIN benchmark b ON b.item_id = t.triple_id % t.nb
  JOIN documents dp ON dp.doc_id = t.triple_id % t.nd
  JOIN documents dn ON dn.doc_id = (t.triple_id + CAST(floor(t.nd / 2) AS BIGINT)) % t.nd)"""

REF = f"""ref AS (
  SELECT vec_id AS ref_id FROM embeddings ORDER BY {sql_hash_key(42, 'vec_id')}, vec_id LIMIT 20)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


FIX = [RANKED_EMB, IDS, TV]


def clean(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[^A-Za-z0-9 ]+', '', 'g')"


def toks(x: str) -> str:
    return f"list_filter(string_split_regex(lower({clean(x)}), ' +'), lambda t: t <> '')"


def bm25_w(k1: float = 1.2, b: float = 0.75) -> str:
    """Per-term BM25 weight over columns qtf, tf, dl, df, n_docs, avgdl."""
    return (f"(qtf * (ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) / ln(2.0::DOUBLE)) * tf * CAST({k1 + 1!r} AS DOUBLE)"
            f" / (tf + CAST({k1!r} AS DOUBLE) * (CAST({1 - b!r} AS DOUBLE) + CAST({b!r} AS DOUBLE) * dl / avgdl)))")


def pairs_cte(sides=("pos", "neg")) -> str:
    parts = [f"SELECT triple_id, '{s}' AS side, label AS cluster_id, query, psg_{s} AS passage FROM tt" for s in sides]
    return "pairs AS (" + " UNION ALL ".join(parts) + ")"


QT = f"""qt AS (SELECT triple_id, side, cluster_id, term, count(*) AS qtf
  FROM (SELECT triple_id, side, cluster_id, unnest({toks('query')}) AS term FROM pairs) GROUP BY ALL)"""
PT = f"""ptok AS (SELECT triple_id, side, cluster_id, {toks('passage')} AS t FROM pairs),
pt AS (SELECT triple_id, side, cluster_id, dl, term, count(*) AS tf
  FROM (SELECT triple_id, side, cluster_id, len(t) AS dl, unnest(t) AS term FROM ptok) GROUP BY ALL)"""
CORPUS_STATS = f"""dtok AS (SELECT doc_id, {toks('text')} AS t FROM documents),
cdocs AS (SELECT count(*) AS n_docs, avg(CAST(len(t) AS DOUBLE)) AS avgdl FROM dtok),
cterms AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(t)) AS term FROM dtok) GROUP BY term)"""
CLUSTER_STATS = """cdocs AS (SELECT cluster_id, side, count(*) AS n_docs, avg(CAST(len(t) AS DOUBLE)) AS avgdl
  FROM ptok GROUP BY cluster_id, side),
cterms AS (SELECT cluster_id, side, term, count(*) AS df
  FROM (SELECT cluster_id, triple_id, side, unnest(list_distinct(t)) AS term FROM ptok) GROUP BY cluster_id, side, term)"""


def scores_cte(scope: str) -> str:
    if scope == "corpus":
        j = "JOIN cterms USING (term) CROSS JOIN cdocs"
    else:
        j = "JOIN cterms USING (cluster_id, side, term) JOIN cdocs USING (cluster_id, side)"
    return f"""sc AS (SELECT triple_id, side, sum({bm25_w()}) AS score
  FROM qt JOIN pt USING (triple_id, side, cluster_id, term) {j} GROUP BY triple_id, side),
scores AS (SELECT p.triple_id, p.side, coalesce(sc.score, 0.0) AS score FROM pairs p LEFT JOIN sc USING (triple_id, side))"""


def bm25_ctes(sides=("pos", "neg"), scope: str = "corpus") -> list[str]:
    stats = CORPUS_STATS if scope == "corpus" else CLUSTER_STATS
    return [pairs_cte(sides), QT, PT, stats, scores_cte(scope)]


MARGIN = """margin AS (SELECT triple_id, sum(CASE WHEN side = 'pos' THEN score ELSE 0.0 END)
                            - sum(CASE WHEN side = 'neg' THEN score ELSE 0.0 END) AS score FROM scores GROUP BY triple_id)"""


def select_tail(scored: str, budget: int, nclust: int, seed, quota: str, center: str = "median",
                rounding: str = "floor") -> str:
    """Quota + top-k + seeded exact sample over a CTE ``scored``(triple_id, cluster_id, score)."""
    q = -(-budget // nclust) if rounding == "ceil" else budget // nclust
    if quota == "bonus":
        agg = "median(size)" if center == "median" else "avg(size)"
        qexpr = f"{q} + CASE WHEN size > s THEN CAST(floor(s / {q}) AS INT) ELSE 0 END"
        qsrc = f"sizes, (SELECT CAST({agg} AS DOUBLE) AS s FROM sizes)"
    elif quota == "smoothed":
        qexpr = f"CAST(floor((size + {budget // nclust}) / CAST(tot + {nclust} AS DOUBLE) * {budget}) AS INT)"
        qsrc = "sizes, (SELECT sum(size) AS tot FROM sizes)"
    else:
        qexpr, qsrc = str(q), "sizes"
    return f""",
sizes AS (SELECT cluster_id, count(*) AS size FROM {scored} WHERE cluster_id >= 0 GROUP BY cluster_id),
quota AS (SELECT cluster_id, {qexpr} AS quota FROM {qsrc}),
rk AS (SELECT triple_id, cluster_id, score, row_number() OVER (PARTITION BY cluster_id ORDER BY round(score, 9), triple_id) AS rank
       FROM {scored} WHERE cluster_id >= 0)
SELECT triple_id, cluster_id, CAST(rank AS INT) AS rank, round(score, 6) AS score
FROM rk JOIN quota USING (cluster_id) WHERE rank <= quota
ORDER BY {key(seed, 'triple_id')}, triple_id LIMIT {budget}"""


GRADED_QRELS = """gq AS (
  SELECT q.vec_id AS qid, d.vec_id AS docno, max(CASE WHEN o = 1 THEN 2 ELSE 1 END) AS rel
  FROM r q, range(1, 4) t(o)
  JOIN r d ON d.label = q.label AND d.rn = ((q.rn - 1 + o) % q.cnt) + 1
  WHERE d.vec_id <> q.vec_id GROUP BY q.vec_id, d.vec_id)"""

NORM_EMB = """ne AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_reduce(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y), lambda a, b: a + b, 0.0::DOUBLE))) AS v FROM embeddings)"""


def metric_ctes(rank_cte: str, qrels: str, rel: int = 2, k: int = 10) -> list[str]:
    """Per (system, qid) RR, AP, nDCG@k over CTE ``rank_cte``(system, qid, docno, score, rank)."""
    return [
        f"jd AS (SELECT r.system, r.qid, r.docno, r.rank, coalesce(q.rel, 0) AS rel FROM {rank_cte} r LEFT JOIN {qrels} q USING (qid, docno))",
        f"topics AS (SELECT DISTINCT qid FROM {qrels})",
        "st AS (SELECT DISTINCT system, qid FROM jd JOIN topics USING (qid))",
        f"rr AS (SELECT st.system, st.qid, coalesce(1.0 / f.r, 0.0) AS rr FROM st LEFT JOIN (SELECT system, qid, min(rank) AS r FROM jd WHERE rel >= {rel} GROUP BY ALL) f USING (system, qid))",
        f"nrel AS (SELECT qid, count(*) AS nrel FROM {qrels} WHERE rel >= {rel} GROUP BY qid)",
        f"hp AS (SELECT system, qid, sum(c / rank) AS sp FROM (SELECT system, qid, rank, count(*) OVER (PARTITION BY system, qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS c FROM jd WHERE rel >= {rel}) GROUP BY ALL)",
        "ap AS (SELECT st.system, st.qid, CASE WHEN nrel > 0 THEN coalesce(sp, 0.0) / nrel ELSE 0.0 END AS ap FROM st LEFT JOIN hp USING (system, qid) LEFT JOIN nrel USING (qid))",
        f"dcg AS (SELECT system, qid, sum(rel / (ln(rank + 1) / ln(2.0))) AS dcg FROM jd WHERE rank <= {k} GROUP BY ALL)",
        f"idl AS (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, docno) AS i FROM {qrels} WHERE rel > 0)",
        f"idcg AS (SELECT qid, sum(rel / (ln(i + 1) / ln(2.0))) AS idcg FROM idl WHERE i <= {k} GROUP BY qid)",
        "nd AS (SELECT st.system, st.qid, CASE WHEN idcg > 0 THEN coalesce(dcg, 0.0) / idcg ELSE 0.0 END AS ndcg FROM st LEFT JOIN dcg USING (system, qid) LEFT JOIN idcg USING (qid))",
    ]
