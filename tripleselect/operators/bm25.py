"""BM25 as term joins.

Definition (ours; the scoring library's internals are not part of the
input): tokens are the lower-cased, space-separated words of
``clean_text``; for a query q and a passage p of ``dl`` tokens

    score = sum over terms t of q ∩ p of
            qtf(t) * idf(t) * tf(t) * (k1 + 1) / (tf(t) + k1 * (1 - b + b * dl / avgdl))

    idf = log2((N - df + 0.5) / (df + 0.5))      ("robertson", may be negative)
    idf = ln(1 + (N - df + 0.5) / (df + 0.5))    ("nonneg")

``N``, ``df`` and ``avgdl`` come from a statistics scope: a background
collection, or the scored passages themselves per cluster and side.  Pairs
that share no term score 0.

Plan shape: texts are cut into words in Arrow batches, once for the
statistics and once for the pairs.  Statistics leave a batch as counts.
Query and passage are in one row, so the terms they share are counted there;
only those are kept, with the pair's key, and exploded.  The statistics join
is keyed by term - frequent terms are skewed, which AQE's skew-join split
handles, and the statistics side is broadcast by AQE when it is small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tripleselect.functions.text import clean_text, token_array, tokens
from tripleselect.operators.select import top_k_per_group
from tripleselect.session import cut_lineage, ship_package

K1 = 1.2
B = 0.75
#: Bytes of text that are cut into words together, and terms of a vocabulary that may be broadcast.
SLICE_BYTES, BROADCAST_TERMS = 8 << 20, 200_000


@dataclass
class Bm25Stats:
    terms: DataFrame    # (scope..., term, df)
    docs: DataFrame     # (scope..., n_docs, avgdl)
    scope: tuple[str, ...] = ()


def _toks(text_col):
    return tokens(clean_text(text_col))


def _slices(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``SLICE_BYTES`` of text."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(text_col)), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // SLICE_BYTES)) + 1
        for i, j in zip([0, *cuts], [*cuts, b.num_rows]):
            if j > i:
                yield b.slice(i, j - i)


def _term_counts(texts: DataFrame, text_col: str, scope: list[str]) -> DataFrame:
    """(scope..., term, n, len): in how many texts of a slice a term is.  The
    empty term stands for the texts themselves; ``len`` is their words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, text_col):
            group = np.zeros(b.num_rows, np.int64)
            for c in scope:
                codes = pc.fill_null(b.column(c).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
                group = np.unique(group * (b.num_rows + 1) + codes + 1, return_inverse=True)[1]
            head = np.unique(group, return_index=True)[1]          # a row of each scope
            words, row = token_array(b.column(text_col))
            words = words.dictionary_encode()
            v = max(1, len(words.dictionary))
            once = np.unique(row * v + words.indices.to_numpy(zero_copy_only=False))
            at, n = np.unique(group[once // v] * v + once % v, return_counts=True)
            term = pa.concat_arrays([words.dictionary.take(pa.array(at % v)), pa.array([""] * len(head), words.dictionary.type)])
            length = np.bincount(group[row], minlength=len(head)).astype(np.int64)
            rows = pa.array(np.concatenate([head[at // v], head]))
            yield pa.RecordBatch.from_arrays(
                [b.column(c).take(rows) for c in scope] + [term, pa.array(np.concatenate([n, np.bincount(group)]).astype(np.int64)),
                 pa.array(np.concatenate([np.zeros(len(at), np.int64), length]))], names=[*scope, "term", "n", "len"])

    ship_package(texts.sparkSession)
    schema = StructType(texts.select(*scope).schema.fields + StructType.fromDDL("term string, n long, len long").fields)
    return texts.select(*scope, text_col).mapInArrow(run, schema)


def bm25_stats(texts: DataFrame, text_col: str = "text", scope_cols: tuple[str, ...] = (),
               vocab: DataFrame | None = None) -> Bm25Stats:
    """Collection statistics, optionally per scope (e.g. cluster and side).

    Every text is read once: a slice of texts is counted where it is read,
    and only its counts are added up.  ``vocab`` (term) restricts document
    frequencies to the terms that can score (the query terms): counts are
    semi-joined to it before they are shuffled and stored."""
    sc = list(scope_cols)
    counts = _term_counts(texts, text_col, sc)
    if vocab is not None:
        known = cut_lineage(vocab.select("term").union(vocab.sparkSession.createDataFrame([("",)], "term string")).distinct())
        small = known.count() <= BROADCAST_TERMS
        counts = counts.join(F.broadcast(known) if small else known, "term", "left_semi")
    counts = cut_lineage(counts.groupBy(*sc, "term").agg(F.sum("n").alias("n"), F.sum("len").alias("len")))
    docs = counts.where("term = ''").groupBy(*sc).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_docs"), (F.sum("len") / F.sum("n")).alias("avgdl"))
    return Bm25Stats(counts.where("term <> ''").select(*sc, "term", F.col("n").alias("df")), docs, tuple(sc))


def query_vocab(df: DataFrame, text_col: str = "query") -> DataFrame:
    """(term): distinct terms of the query texts, each of which is read once."""
    return df.select(text_col).distinct().select(F.explode(_toks(text_col)).alias("term")).distinct()


def _term_stats(stats: Bm25Stats) -> DataFrame:
    """(scope..., term, df, n_docs, avgdl): joined per scope, or with two
    driver scalars when the statistics are global (one row)."""
    if stats.scope:
        return stats.terms.join(stats.docs, list(stats.scope))
    row = stats.docs.first()
    n_docs, avgdl = (row["n_docs"], row["avgdl"]) if row else (0, 0.0)
    return stats.terms.withColumn("n_docs", F.lit(n_docs).cast("long")).withColumn("avgdl", F.lit(avgdl).cast("double"))


def idf_expr(n, df, kind: str = "robertson"):
    ratio = (n - df + F.lit(0.5)) / (df + F.lit(0.5))
    if kind == "nonneg":
        return F.log(F.lit(1.0) + ratio)
    return F.log2(ratio)


def to_pairs(triples: DataFrame, sides: tuple[str, ...] = ("pos", "neg"), keep: tuple[str, ...] = ()) -> DataFrame:
    """(triple_id, side, query, passage, keep...): one row per requested side."""
    parts = []
    for s in sides:
        parts.append(triples.select("triple_id", *keep, F.lit(s).alias("side"), "query",
                                    F.col("psg_pos" if s == "pos" else "psg_neg").alias("passage")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("triple_id", "side", "query", "passage", *keep)


def shared_terms(pairs: DataFrame, cols: list[str]) -> DataFrame:
    """(cols..., dl, shared): the passage's length and, of each term that is
    in both texts, how often it is in the query and in the passage."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, "passage"):
            (asked, q), (words, p) = token_array(b.column("query")), token_array(b.column("passage"))
            every = pa.concat_arrays([asked, words]).dictionary_encode()
            v = max(1, len(every.dictionary))
            codes = every.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            both, qtf = np.unique(q * v + codes[:len(q)], return_counts=True)
            at = p * v + codes[len(q):]
            place = np.searchsorted(both, at)
            hit = place < len(both)
            hit[hit] = both[place[hit]] == at[hit]
            tf = np.bincount(place[hit], minlength=len(both))
            some = np.flatnonzero(tf)
            term, row = both[some] % v, both[some] // v
            ends = np.cumsum(np.bincount(row, minlength=b.num_rows)).astype(np.int32)
            shared = pa.StructArray.from_arrays([every.dictionary.take(pa.array(term)), pa.array(qtf[some].astype(np.int32)),
                                                 pa.array(tf[some].astype(np.int32))], names=["term", "qtf", "tf"])
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in cols] + [pa.array(np.bincount(p, minlength=b.num_rows).astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), shared)], names=[*cols, "dl", "shared"])

    ship_package(pairs.sparkSession)
    schema = StructType(pairs.select(*cols).schema.fields + StructType.fromDDL("dl int, shared array<struct<term:string,qtf:int,tf:int>>").fields)
    return pairs.select(*cols, "query", "passage").mapInArrow(run, schema)


def bm25_pairs(pairs: DataFrame, stats: Bm25Stats, k1: float = K1, b: float = B, idf: str = "robertson",
               key_cols: tuple[str, ...] = ("triple_id", "side")) -> DataFrame:
    """(key..., score) for every (query, passage) pair."""
    key = list(key_cols)
    sc = list(stats.scope)
    cols = list(dict.fromkeys(key + sc))
    # stored, so that the texts are read once for the terms and for the pairs without any
    found = cut_lineage(shared_terms(pairs, cols))
    m = found.select(*cols, "dl", F.explode("shared").alias("__s")).select(*cols, "dl", "__s.*").join(_term_stats(stats), sc + ["term"])
    w = (F.col("qtf") * idf_expr(F.col("n_docs"), F.col("df"), idf) * F.col("tf") * F.lit(k1 + 1)
         / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avgdl"))))
    scores = m.groupBy(*key).agg(F.sum(w).alias("score"))
    return (found.select(*key).join(scores, key, "left")
                 .select(*key, F.coalesce("score", F.lit(0.0)).alias("score")))


def bm25_margin(scores: DataFrame, id_col: str = "triple_id") -> DataFrame:
    """(triple_id, score) = score(positive) - score(negative), joined by id."""
    return scores.groupBy(id_col).agg(
        (F.sum(F.when(F.col("side") == "pos", F.col("score")).otherwise(0.0))
         - F.sum(F.when(F.col("side") == "neg", F.col("score")).otherwise(0.0))).alias("score"))


def postings(corpus: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(docno, term, tf, dl) of a corpus for the ``vocab(term)``, and one row
    with the empty term per document, which carries its length.  The corpus is
    tokenised once; tokens are semi-joined before they are aggregated."""
    t = corpus.select(F.col(id_col).alias("docno"), _toks(text_col).alias("__t")).select(
        "docno", F.size("__t").alias("dl"), F.explode(F.concat("__t", F.array(F.lit("")))).alias("term"))
    known = vocab.select("term").union(vocab.sparkSession.createDataFrame([("",)], "term string")).distinct()
    return t.join(known, "term", "left_semi").groupBy("docno", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25_retrieve(topics: DataFrame, corpus: DataFrame, k: int, k1: float = K1, b: float = B,
                  idf: str = "robertson", topic_id: str = "qid", topic_text: str = "query",
                  doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """(qid, docno, score, rank): top-``k`` documents per topic by BM25
    with corpus statistics; ties by docno.

    Every term of a topic has a highest score.  A topic's terms of the highest
    bounds are joined first, and the exact scores of the best documents they
    find set the topic's threshold.  Terms whose bounds together stay under it
    cannot lift a document over it by themselves: postings are joined only for
    the others, documents that cannot reach the threshold are dropped, and
    only what is left looks up the remaining terms.  Common words, which make
    nearly all of the matches, are thus hardly ever joined.  The result is
    exact; the final cut is a salted two-phase top-k.
    """
    qt = (topics.select(F.col(topic_id).alias("qid"), F.explode(_toks(topic_text)).alias("term"))
                .groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf")))
    qt = cut_lineage(qt)
    post = cut_lineage(postings(corpus, qt.select("term").distinct(), doc_id, doc_text))
    n_docs, avgdl = post.where("term = ''").agg(F.count(F.lit(1)), F.avg(F.col("dl").cast("double"))).first()
    if not n_docs:
        return topics.sparkSession.createDataFrame([], "qid long, docno long, score double, rank int")
    post = post.where("term <> ''").select("docno", "term", (F.col("tf") * F.lit(k1 + 1) / (
        F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.lit(avgdl)))).alias("part"))
    weight = F.col("qtf") * idf_expr(F.lit(n_docs), F.col("df"), idf)
    stats = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("part").alias("most"), F.min("part").alias("least"))
    # up: most that a term can add; terms by falling bound, with what all later terms can add
    terms = qt.join(stats, "term").select("qid", "term", "df", weight.alias("w"), "most", "least")
    terms = terms.withColumn("up", F.greatest(F.lit(0.0), F.col("w") * F.col("most"), F.col("w") * F.col("least")))
    by = Window.partitionBy("qid").orderBy(F.desc("up"), "df", "term")
    terms = cut_lineage(terms.select(
        "qid", "term", "w", F.coalesce(F.sum("up").over(by.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)).alias("after"),
        F.coalesce(F.sum("df").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))

    def partial(part: DataFrame) -> DataFrame:
        return part.join(post, "term").groupBy("qid", "docno").agg(F.sum(F.col("w") * F.col("part")).alias("score"))

    def completed(found: DataFrame, rest: DataFrame) -> DataFrame:
        """Scores with the terms in ``rest`` added, looked up by document."""
        more = (found.join(rest.select("qid", "term", "w"), "qid").join(post, ["docno", "term"])
                     .groupBy("qid", "docno").agg(F.sum(F.col("w") * F.col("part")).alias("more")))
        return found.join(more, ["qid", "docno"], "left").select(
            "qid", "docno", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))

    # the first terms, until their postings may hold a few times k documents
    seed = F.col("before") < 4 * k
    first = top_k_per_group(partial(terms.where(seed)), ["qid"], [F.desc("score")], 2 * k, "docno").drop("rank")
    best = top_k_per_group(completed(first, terms.where(~seed)), ["qid"], [F.desc("score")], k, "docno")
    bar = best.where(F.col("rank") == k).select("qid", (F.col("score") - 1e-6).alias("bar"))
    # needed: terms up to the one after which the bounds left stay under the bar
    by_bar = terms.join(bar, "qid", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))))
    left = F.lag("after").over(Window.partitionBy("qid").orderBy("before", F.desc("after")))
    by_bar = cut_lineage(by_bar.withColumn("left", F.coalesce(left, F.lit(float("inf")))).withColumn(
        "needed", F.col("left") >= F.col("bar")))
    rest_up = by_bar.where("needed").groupBy("qid").agg(F.min("after").alias("rest"), F.first("bar").alias("bar"))
    found = partial(by_bar.where("needed")).join(rest_up, "qid").where(F.col("score") + F.col("rest") >= F.col("bar"))
    scored = completed(cut_lineage(found.select("qid", "docno", "score")), by_bar.where("NOT needed"))
    # rank on the score rounded to 9 decimals so that equal documents tie
    # exactly (float sums depend on summation order), then by docno
    return top_k_per_group(scored, ["qid"], [F.round("score", 9).desc()], k, "docno")
