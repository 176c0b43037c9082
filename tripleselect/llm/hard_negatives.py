"""Hard negatives by threshold joins over an inverted index of dimensions.

A query row (anchor) first looks for its positives, the nearest rows of its
own label, and then, for every positive, for rows of other labels whose score
lies in a window below the positive's.  Both are the same join: *searches*,
each of one anchor, with a lowest and a highest score and a number of rows to
fill, against all rows.

A round has one threshold per anchor.  Every task takes the rows of its scan
in blocks and indexes a block by groups of dimensions.  Rows are indexed only
up to the group from where the norm of what is left, times the longest
anchor's norm, cannot reach the lowest threshold; what is left stays with the
row.  Partial scores are accumulated group by group, and a pair is given up as
soon as its partial score plus the product of both remaining norms is under
the anchor's threshold.  A search that is not full after a round goes on with
a lower threshold, down to its lowest score; a full one is done, since every
row above its threshold was seen.  Tasks hand on no more than the best rows of
each search, so nothing grows with the number of pairs.

Anchors are dealt into blocks of bounded bytes; a block is broadcast and the
rows are scanned in place, so rows are never shuffled.

Rows: a null id, label or vector, or a null or non-finite component, takes no
part.  Vectors of different lengths are filled up with zeros.  Repeated ids
count once in a search, by their best score; of anchors with one id the one
with the smallest label and vector searches.  Ties go to the smaller id.
Other columns are ignored.  Scores must be below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleselect.session import cut_lineage

#: Bytes of a block of anchors, and rows of a block of the index.
ANCHOR_BYTES, BLOCK_ROWS = 16 << 20, 8192
GROUP = 8                   # dimensions that are accumulated between two prunings
FOUND = "anchor_id long, search int, other_id long, score long"
#: Thresholds of the rounds: shares of an anchor's own score, and of a positive's score.
POSITIVE_STEPS = (0.7, 0.45, 0.3, 0.15, None)
NEGATIVE_STEPS = (0.85, 0.75, 0.6, None)


def taking_part(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: Column | None = None) -> DataFrame:
    """``(vec_id, label, vec)`` of the rows that take part; components are
    quantised to ``floor(256 * x)``."""
    label = F.col("label") if label is None else label
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (rows.where(F.col(vec_id).isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & ~bad)
                .select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                        F.transform(vector, lambda c: F.floor(c.cast("double") * 256).cast("double")).alias("vec")))


@dataclass
class Searches:
    """A block of anchors (ascending ids) and what each looks for.  Row ``i``
    of the search arrays belongs to anchor ``owner[i]``."""
    ids: np.ndarray
    labels: np.ndarray
    vecs: np.ndarray
    owner: np.ndarray
    name: np.ndarray
    low: np.ndarray
    high: np.ndarray
    want: int
    same_label: bool
    least: np.ndarray = field(default=None)         # threshold per anchor
    order: np.ndarray = field(default=None)         # dimensions, most energy first

    def prepare(self) -> None:
        d = self.vecs.shape[1]
        self.order = np.argsort(-(self.vecs ** 2).sum(axis=0), kind="stable")
        self.vecs = self.vecs[:, self.order]
        self.rest = remaining_norms(self.vecs)
        self.groups = [(g, min(g + GROUP, d)) for g in range(0, d, GROUP)]


def remaining_norms(x: np.ndarray) -> np.ndarray:
    """``[rows, groups + 1]``: the norm of each row from each group on."""
    d = x.shape[1]
    cuts = [*range(0, d, GROUP), d]
    sq = np.stack([(x[:, a:b] ** 2).sum(axis=1) for a, b in zip(cuts, cuts[1:])] + [np.zeros(len(x))], axis=1)
    return np.sqrt(sq[:, ::-1].cumsum(axis=1)[:, ::-1])


def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The vectors of a batch, cut or filled to ``dims`` (what an anchor lacks adds nothing)."""
    col = batch.column("vec")
    lens = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if len(lens) and (lens == dims).all():
        return flat.reshape(len(lens), dims)
    out = np.zeros((len(lens), dims))
    row = np.repeat(np.arange(len(lens)), lens)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    ok = at < dims
    out[row[ok], at[ok]] = flat[ok]
    return out


def pairs_above(s: Searches, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, row, score)`` of all pairs of a block that reach the anchor's threshold."""
    rest = remaining_norms(x)
    slack = 1 + 1e-9
    lowest, longest = s.least.min(), s.rest[:, 0].max()
    # a row is indexed in the groups before the first whose remaining norm cannot reach the lowest threshold
    depth = (rest[:, :-1] * longest * slack >= lowest).sum(axis=1) if lowest > 0 else np.full(len(x), len(s.groups))
    by_depth = np.argsort(-depth, kind="stable")
    x, rest, depth = x[by_depth], rest[by_depth], depth[by_depth]
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for at in range(0, len(s.ids) if depth.any() else 0, 512):
        a, ar, least = s.vecs[at:at + 512], s.rest[at:at + 512], s.least[at:at + 512, None]
        listed = int(np.searchsorted(-depth, 0, side="left"))       # rows with any posting
        acc = np.zeros((len(a), listed))
        alive = None
        for g, (lo, hi) in enumerate(s.groups):
            n = int(np.searchsorted(-depth, -g, side="left"))       # the group's posting list: the rows that reach it
            if alive is None:
                acc[:, :n] += a[:, lo:hi] @ x[:n, lo:hi].T
                # rows that left the index keep the bound of their own remainder
                bound = acc + ar[:, g + 1:g + 2] * rest[:listed, g + 1] * slack
                if n < listed:
                    left = np.arange(n, listed)
                    bound[:, n:] = acc[:, n:] + ar[:, depth[left]] * rest[left, depth[left]] * slack
                keep = bound >= least
                if keep.mean() < 0.05 or g + 1 == len(s.groups):
                    ai, xi = np.nonzero(keep)
                    score, alive = acc[ai, xi], True
            else:
                part = xi < n
                score[part] += np.einsum("ij,ij->i", a[ai[part], lo:hi], x[xi[part], lo:hi])
                level = np.minimum(g + 1, depth[xi])
                ok = score + ar[ai, level] * rest[xi, level] * slack >= least[ai, 0]
                ai, xi, score = ai[ok], xi[ok], score[ok]
        # what was left out of the index, from the rows themselves
        for g, (lo, hi) in enumerate(s.groups):
            part = depth[xi] <= g
            if part.any():
                score[part] += np.einsum("ij,ij->i", a[ai[part], lo:hi], x[xi[part], lo:hi])
        ok = score >= least[ai, 0]
        out.append((ai[ok] + at, by_depth[xi[ok]], score[ok]))
    return tuple(np.concatenate(c) for c in zip(*out))


def best_of(search: np.ndarray, other: np.ndarray, score: np.ndarray, want: int) -> np.ndarray:
    """Positions of each search's best ``want`` rows, an id counting once."""
    o = np.lexsort((other, -score, search))
    seen = np.lexsort((-score, other, search))
    again = np.zeros(len(o), bool)
    same = (search[seen][1:] == search[seen][:-1]) & (other[seen][1:] == other[seen][:-1])
    again[seen[1:][same]] = True
    o = o[~again[o]]
    first = np.concatenate([[True], search[o][1:] != search[o][:-1]]) if len(o) else np.empty(0, bool)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(o)), 0))
    return o[np.arange(len(o)) - begin < want]


def scan(rows: DataFrame, searches: Searches) -> DataFrame:
    """``FOUND``: every task's best rows of each search, over all ``rows``."""
    searches.prepare()
    sent = rows.sparkSession.sparkContext.broadcast(searches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        by_owner = np.argsort(s.owner, kind="stable")
        first = np.searchsorted(s.owner[by_owner], np.arange(len(s.ids)))
        number = np.bincount(s.owner, minlength=len(s.ids))
        best = [np.empty(0, np.int64)] * 2 + [np.empty(0)]
        for big in batches:
            for at in range(0, big.num_rows, BLOCK_ROWS):
                b = big.slice(at, BLOCK_ROWS)
                ids, labels = b.column("vec_id").to_numpy(), b.column("label").to_numpy()
                ai, xi, score = pairs_above(s, np.ascontiguousarray(matrix(b, s.vecs.shape[1])[:, s.order]))
                ok = ((s.labels[ai] == labels[xi]) == s.same_label) & (s.ids[ai] != ids[xi])
                ai, xi, score = ai[ok], xi[ok], score[ok]
                # every search of the anchor whose window holds the score
                n = number[ai]
                pair = np.repeat(np.arange(len(ai)), n)
                search = by_owner[first[ai[pair]] + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)]
                ok = (score[pair] >= s.low[search]) & (score[pair] <= s.high[search])
                best = [np.concatenate(c) for c in zip(best, (search[ok], ids[xi[pair[ok]]], score[pair[ok]]))]
                keep = best_of(*best, s.want)
                best = [c[keep] for c in best]
        search, other, score = best
        yield pa.RecordBatch.from_arrays(
            [pa.array(s.ids[s.owner[search]]), pa.array(s.name[search].astype(np.int32)), pa.array(other),
             pa.array(score.astype(np.int64))], names=[c.split()[0] for c in FOUND.split(", ")])

    return rows.mapInArrow(run, FOUND)


def merged(found: DataFrame, want: int) -> DataFrame:
    """The best ``want`` distinct rows of each search, with their ``rank``."""
    once = found.groupBy("anchor_id", "search", "other_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("anchor_id", "search").orderBy(F.desc("score"), "other_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= want)


def fill(rows: DataFrame, s: Searches, steps: tuple, scale: np.ndarray) -> DataFrame:
    """The rows of each search, in rounds of falling thresholds
    (``step * scale`` per search; None: the search's lowest score)."""
    spark = rows.sparkSession
    out, open_ = None, np.ones(len(s.owner), bool)
    for step in steps:
        part = np.flatnonzero(open_)
        if not len(part):
            break
        floor = s.low[part] if step is None else np.maximum(s.low[part], step * scale[part])
        used, owner = np.unique(s.owner[part], return_inverse=True)
        least = np.full(len(used), np.inf)
        np.minimum.at(least, owner, floor)
        now = Searches(s.ids[used], s.labels[used], s.vecs[used], owner, s.name[part], s.low[part], s.high[part], s.want,
                       s.same_label, np.where(np.isfinite(least), least, -1e300))
        got = cut_lineage(merged(scan(rows, now), s.want))
        full = got.groupBy("anchor_id", "search").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst")).toPandas()
        key = {(int(a), int(w)): (int(n), float(z)) for a, w, n, z in full.itertuples(index=False)}
        # a search is done when it is full, or its threshold was its lowest score
        done = []
        for i, a, w, low in zip(part.tolist(), s.ids[s.owner[part]].tolist(), s.name[part].tolist(), s.low[part].tolist()):
            n, _ = key.get((a, w), (0, 0.0))
            if n >= s.want or step is None or least[np.searchsorted(used, s.owner[i])] <= low:
                done.append((a, w))
                open_[i] = False
        if done:
            ended = spark.createDataFrame(done, "anchor_id long, search int")
            won = got.join(F.broadcast(ended), ["anchor_id", "search"], "left_semi")
            out = won if out is None else out.unionByName(won)
    return out


def anchor_blocks(anchors: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(ids, labels, vectors)`` of the anchors, in blocks of bounded bytes."""
    kept = cut_lineage(anchors.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("a"))
                              .select("vec_id", "a.label", "a.vec"))
    n, dims = kept.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not n or not dims:
        return
    blocks = -(-n * dims * 8 // ANCHOR_BYTES)
    dealt = kept.withColumn("__b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))) if blocks > 1 else kept.withColumn("__b", F.lit(0))
    for b in range(blocks):
        got = dealt.where(F.col("__b") == b).orderBy("vec_id").toArrow()
        if got.num_rows:
            col = got.select(["vec_id", "label", "vec"]).combine_chunks().to_batches()[0]
            yield col.column("vec_id").to_numpy(), col.column("label").to_numpy(), matrix(col, dims)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10,
                   window: tuple[int, int] = (30, 90)) -> DataFrame:
    """For each anchor and each of its ``positives`` nearest rows of the same
    label, the best ``negatives`` rows of other labels that score between
    ``window`` percent of the positive's score.  Both inputs are as from
    :func:`taking_part`."""
    spark = rows.sparkSession
    out = None
    for ids, labels, vecs in anchor_blocks(anchors):
        n = len(ids)
        own = (vecs ** 2).sum(axis=1)
        s = Searches(ids, labels, vecs, np.arange(n), np.zeros(n, np.int32), np.full(n, -np.inf), np.full(n, np.inf), positives, True)
        pos = fill(rows, s, POSITIVE_STEPS, own)
        got = pos.toPandas().sort_values(["anchor_id", "rank"], ignore_index=True)
        score = got["score"].to_numpy(np.int64)
        lo, hi = -((-window[0] * score) // 100), (window[1] * score) // 100
        ok = lo <= hi
        got, lo, hi = got[ok].reset_index(drop=True), lo[ok], hi[ok]
        if not len(got):
            continue
        s = Searches(ids, labels, vecs, np.searchsorted(ids, got["anchor_id"].to_numpy()), got["rank"].to_numpy(np.int32),
                     lo.astype(float), hi.astype(float), negatives, False)
        neg = fill(rows, s, NEGATIVE_STEPS, got["score"].to_numpy(float))
        named = pos.select("anchor_id", F.col("rank").alias("search"), F.col("other_id").alias("positive_id"),
                           F.col("score").alias("positive_score"))
        part = neg.join(named, ["anchor_id", "search"]).select(
            "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
                                         "negative_score long")
    return out
