"""Quality by co-training two views of a document.

The text view sees what is written (kinds of characters, word shapes, hashed
word endings); the metadata view sees what is known about the page without
reading it (source, language, length, layout).  Each view has its own logistic
classifier.  In every round each classifier scores all unlabelled training
texts, labels those it is most confident of and hands them to the other.  Both
views are then calibrated on labelled rows kept apart, and a third logistic
function of the two calibrated logits scores every document.

The features of all documents are computed once and written to the shared
checkpoint folder; rounds and scores read only them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tripleselect.llm.common import cut_lineage

#: Labelled rows that the views are fitted and calibrated on (least hash first).
LABELLED_ROWS = 6000
ROUNDS = 4
#: Pseudo-labels a view hands over per round and class, as a share of its labelled rows of that class,
#: and the least log odds it must have for them.
GIVE, CONFIDENT = 0.1, 1.0
DIM_TEXT, DIM_META = 1 << 12, 1 << 10
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = [re.compile(p) for p in (r"[^\W\d_]", r"\d", r"[A-ZÀ-ÖØ-Þ]", r"[#*$%&|<>]", r"!", r"[.,;:?]", r"http|www|@")]


def _bucket(name: str, value: float, steps: int, dim: int) -> int:
    return xxhash.xxh32_intdigest(f"{name}:{int(value * steps)}") % dim


def text_features(text: str | None) -> list[int]:
    """Distinct features of the text view."""
    t = text or ""
    words = WORD.findall(t)
    n, chars = max(len(words), 1), max(sum(map(len, words)), 1)
    out = {_bucket(f"k{i}", min(len(k.findall(t)) / chars, 1.0), 20, DIM_TEXT) for i, k in enumerate(KINDS)}
    out.add(_bucket("wl", min(chars / n, 20) / 20, 20, DIM_TEXT))
    out.add(_bucket("distinct", len(set(words)) / n, 10, DIM_TEXT))
    out.add(_bucket("n", min(np.log2(n + 1), 16) / 16, 16, DIM_TEXT))
    ends = {}
    for w in words:
        ends[w[-2:]] = ends.get(w[-2:], 0) + 1
    out |= {xxhash.xxh32_intdigest("e" + e) % DIM_TEXT for e, c in ends.items() if 20 * c >= n}
    return sorted(out)


def meta_features(source, lang, chars, lines, longest) -> list[int]:
    """Features of the metadata view: never the words."""
    c, ln = float(chars or 0), float(lines or 1)
    return sorted({xxhash.xxh32_intdigest(f"s:{source}") % DIM_META, xxhash.xxh32_intdigest(f"l:{lang}") % DIM_META,
                   _bucket("c", np.log2(c + 1), 1, DIM_META), _bucket("ln", np.log2(ln + 1), 2, DIM_META),
                   _bucket("pl", np.log2(c / ln + 1), 2, DIM_META),
                   _bucket("top", np.log2(float(longest or 0) + 1), 2, DIM_META)})


def text_view(text: pd.Series) -> pd.Series:
    return pd.Series([text_features(t) for t in text])


def meta_view(source: pd.Series, lang: pd.Series, chars: pd.Series, lines: pd.Series, longest: pd.Series) -> pd.Series:
    return pd.Series([meta_features(*r) for r in zip(source, lang, chars.fillna(0), lines.fillna(0), longest.fillna(0))])


def view_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, at, key, t, m`` of every row, checkpointed: a hash of the
    text and the features of the two views; ``at`` tells equal rows apart."""
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    tv, mv = pandas_udf(text_view, "array<int>"), pandas_udf(meta_view, "array<int>")
    narrow = docs.select("doc_id", F.xxhash64("text").alias("key"), "text", F.col("source").cast("string").alias("source"),
                         F.col("lang").cast("string").alias("lang"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"),
                         F.size(split).alias("lines"), F.array_max(F.transform(split, F.length)).alias("longest"))
    return cut_lineage(narrow.select("doc_id", "key", tv("text").alias("t"),
                                     mv("source", "lang", "chars", "lines", "longest").alias("m")))


class Sparse:
    """Rows of distinct feature numbers."""

    def __init__(self, rows: list | pa.ListArray):
        if isinstance(rows, pa.ListArray):
            self.n, lens = len(rows), np.diff(rows.offsets.to_numpy())
            self.col = rows.flatten().to_numpy().astype(int)
            self.row = np.repeat(np.arange(self.n), lens)
            return
        self.n = len(rows)
        lens = np.array([len(r) for r in rows], int)
        self.col = np.concatenate([np.asarray(r, int) for r in rows]) if lens.sum() else np.empty(0, int)
        self.row = np.repeat(np.arange(self.n), lens)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def pick(self, keep: np.ndarray) -> Sparse:
        """Rows in the order of ``keep`` (distinct row numbers)."""
        place = np.full(self.n, -1)
        place[keep] = np.arange(len(keep))
        ok = place[self.row] >= 0
        out = Sparse([])
        out.n, out.col, out.row = len(keep), self.col[ok], place[self.row[ok]]
        return out

    def plus(self, other: Sparse) -> Sparse:
        out = Sparse([])
        out.n = self.n + other.n
        out.col, out.row = np.concatenate([self.col, other.col]), np.concatenate([self.row, other.row + self.n])
        return out


def logistic(x: Sparse, y: np.ndarray, dim: int, steps: int = 200, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Class-balanced logistic regression (gradient steps scaled by feature)."""
    w, b = np.zeros(dim), 0.0
    share = np.clip(y.mean(), 0.02, 0.98)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    speed = np.full(dim, 1e-8)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + b, -30, 30)))
        g = weight * (p - y)
        grad = np.bincount(x.col, g[x.row], dim) + l2 * w
        speed += grad ** 2
        w -= 0.3 * grad / np.sqrt(speed)
        b -= 0.3 * g.sum()
    return w, b


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make ``sigmoid(a z + b)`` a probability."""
    a, b = 1.0, 0.0
    scale = max(float(np.abs(z).mean()), 1e-6)
    u = z / scale
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        a -= 0.5 * float(((p - y) * u).mean())
        b -= 0.5 * float((p - y).mean())
    return max(a, 0.0) / scale, b


@dataclass
class CoTrained:
    text: tuple[np.ndarray, float]
    meta: tuple[np.ndarray, float]
    text_cal: tuple[float, float]
    meta_cal: tuple[float, float]
    join: tuple[float, float, float]

    def scores(self, xt: Sparse, xm: Sparse) -> np.ndarray:
        zt, zm = xt.dot(self.text[0]) + self.text[1], xm.dot(self.meta[0]) + self.meta[1]
        zt, zm = self.text_cal[0] * zt + self.text_cal[1], self.meta_cal[0] * zm + self.meta_cal[1]
        z = self.join[0] * zt + self.join[1] * zm + self.join[2]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


PICKED = "list int, z double, key long, t array<int>, m array<int>"


def most_confident(pool: DataFrame, models: list, taken: set[int], number: dict[int, int]) -> pd.DataFrame:
    """The texts of ``pool`` that each view is surest of, at both ends: lists
    ``2 view + class``, ``number[class]`` texts each at most, surest first."""
    sent = pool.sparkSession.sparkContext.broadcast((models, np.array(sorted(taken), np.int64), number))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (text, meta), known, most = sent.value
        kept: dict[int, list] = {}
        for b in batches:
            fresh = ~np.isin(b.column("key").to_numpy(), known)
            z = [Sparse(b.column(c)).dot(w) + bias for c, (w, bias) in (("t", text), ("m", meta))]
            for v in (0, 1):
                for y, sign in ((1, 1.0), (0, -1.0)):
                    sure = np.flatnonzero(fresh & (sign * z[v] >= CONFIDENT))
                    best = sure[np.lexsort((b.column("key").to_numpy()[sure], -sign * z[v][sure]))][:most[y]]
                    got = [(float(sign * z[v][i]), i) for i in best]
                    rows = b.take(pa.array(best, pa.int64()))
                    held = kept.setdefault(2 * v + y, [])
                    held += [(zi, *x) for (zi, _), x in zip(got, zip(*(rows.column(c).to_pylist() for c in ("key", "t", "m"))))]
                    held.sort(key=lambda x: (-x[0], x[1]))
                    del held[most[y]:]
        out = [(k, *x) for k, xs in kept.items() for x in xs]
        cols = list(zip(*out)) or [()] * 5
        types = [pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["list", "z", "key", "t", "m"])

    best = Window.partitionBy("list").orderBy(F.desc("z"), "key")
    found = pool.mapInArrow(run, PICKED).withColumn("rank", F.row_number().over(best))
    return (found.where(F.col("rank") <= max(number.values())).orderBy("list", "rank").toPandas())


def co_train(xt: Sparse, xm: Sparse, y: np.ndarray, pool: DataFrame,
             rounds: int = ROUNDS) -> tuple[tuple[np.ndarray, float], tuple[np.ndarray, float]]:
    """The two views' classifiers after ``rounds`` of exchanging labels over
    ``pool(key, t, m)``, one row per unlabelled text."""
    sets = [[xt, y], [xm, y]]                     # each view's training rows
    dims, taken = (DIM_TEXT, DIM_META), set()
    models = [logistic(xt, y, DIM_TEXT), logistic(xm, y, DIM_META)]
    number = {k: int(GIVE * (y == k).sum()) for k in (0, 1)}
    for _ in range(rounds):
        got = most_confident(pool, models, taken, number)
        for name, rows in got.groupby("list"):
            view, label = divmod(int(name), 2)
            rows = rows[~rows["key"].isin(taken)].head(number[label])
            if not len(rows):
                continue
            other = 1 - view
            sets[other] = [sets[other][0].plus(Sparse(list(rows["m" if other else "t"]))),
                           np.concatenate([sets[other][1], np.full(len(rows), float(label))])]
            taken |= set(rows["key"].tolist())
        models = [logistic(*sets[v], dims[v]) for v in (0, 1)]
        if not len(got):
            break
    return models[0], models[1]


def fit(rows: DataFrame, labels: DataFrame, train: Column, rounds: int = ROUNDS) -> CoTrained | None:
    """Model from the :func:`view_rows` where ``train`` holds;
    ``labels(doc_id, quality)`` marks some of them.  None when a class is
    missing (an empty table too).

    Of several labels of one id the highest counts; null ids and labels teach
    nothing.  Repeated rows of a labelled id are each a labelled row; a text
    that occurs in several unlabelled rows is one pool text, with the least
    metadata features.  Ties in confidence go to the smaller text hash.
    """
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col("quality").cast("int")).alias("y"))
    known = cut_lineage(rows.where(train & F.col("doc_id").isNotNull()).join(marked, "doc_id", "left"))
    lab = (known.where(F.col("y").isNotNull()).orderBy(F.xxhash64("doc_id", "key"), "key").limit(LABELLED_ROWS)
                .select("t", "m", "y").toPandas())
    y = lab["y"].to_numpy(float)
    if len(lab) < 10 or y.min() == y.max():
        return None
    pool = cut_lineage(known.where(F.col("y").isNull()).groupBy("key").agg(F.min(F.struct("m", "t")).alias("f"))
                            .select("key", "f.t", "f.m"))
    xt, xm = Sparse(list(lab["t"])), Sparse(list(lab["m"]))
    cal = np.arange(len(lab)) % 5 == 0
    if y[~cal].min() == y[~cal].max():
        cal[:] = False
    hold = cal if cal.any() else ~cal
    own = np.flatnonzero(~cal)
    text, meta = co_train(xt.pick(own), xm.pick(own), y[own], pool, rounds)
    zt, zm = (xt.dot(text[0]) + text[1])[hold], (xm.dot(meta[0]) + meta[1])[hold]
    ct, cm = platt(zt, y[hold]), platt(zm, y[hold])
    both = np.stack([ct[0] * zt + ct[1], cm[0] * zm + cm[1]], axis=1)
    w = np.array([1.0, 0.3])
    b = 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(both @ w + b, -30, 30)))
        w = np.maximum(w - 0.2 * (both.T @ (p - y[hold])) / len(p), 0)
        b -= 0.2 * float((p - y[hold]).mean())
    return CoTrained(text, meta, ct, cm, (float(w[0]), float(w[1]), float(b)))


def score_column(rows: DataFrame, model: CoTrained | None) -> Column:
    """Probability that a document is of good quality, from the columns ``t``
    and ``m`` of :func:`view_rows`; 0.5 for every row when there was nothing to
    learn from.  Null texts count as empty."""
    if model is None:
        return F.lit(0.5)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(t: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series(sent.value.scores(Sparse(list(t)), Sparse(list(m))), dtype=float)

    return score("t", "m")
