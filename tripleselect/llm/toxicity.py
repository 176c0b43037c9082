"""Toxicity by weak supervision.

Voters look for something in a text and vote "toxic" or abstain: groups of a
given lexicon, and patterns (words and word beginnings) that the labelled
training rows associate with toxic texts.  A generative label model estimates
each voter's accuracy from how voters agree: within a block of voters that fire together
their covariance is a rank-one matrix except where two voters are correlated
beyond the label, so the rank-one part gives the accuracies and the residuals
the correlations, which discount a voter's weight.  The statistics cover every text outside the
held-out fold and are two moments of the votes, of fixed size.

The label model's posteriors on a bounded sample then train a linear
classifier on all the words and word beginnings of a text, and that classifier
scores every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tripleselect.llm.common import hold, least_hash_rows

#: Labelled training rows that voters are mined from and the classifier is fitted on (least hash first).
SAMPLE_ROWS = 8000
FEATURES = 1 << 20
PREFIXES = (4, 5, 6, 7)
MINED = 48
MIN_SUPPORT = 6
CACHED = 300_000
WORDS = re.compile(r"\w+")
#: Given lexicon, one voter per group.
LEXICON = (
    ("idiot", "idiots", "idiotic"), ("moron", "morons", "moronic"), ("stupid", "stupidity"), ("dumb", "dumbass"),
    ("loser", "losers"), ("clown", "clowns"), ("scum", "scumbag"), ("trash", "garbage"), ("pathetic",),
    ("worthless", "useless"), ("disgusting", "disgust"), ("imbecile", "cretin"), ("jerk", "creep"),
    ("retard", "retarded"), ("pig", "swine"), ("hate", "hateful"), ("vermin", "filth"),
)


def feature(kind: str, s: str) -> int:
    return xxhash.xxh32_intdigest(kind + s) & (FEATURES - 1)


def word_features(w: str) -> list[int]:
    """The word, and its beginnings if it is longer than they are."""
    return [feature("w", w)] + [feature("p", w[:k]) for k in PREFIXES if len(w) > k]


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall(text.lower())) if text else set()


class Cached(dict):
    """Value of a word, remembered for at most ``CACHED`` words."""

    def __init__(self, make):
        self.make = make
        hold("toxicity", lambda: None)          # this one goes with its task

    def __missing__(self, w):
        v = self.make(w)
        if len(self) < CACHED and len(w) <= 40:
            self[w] = v
        return v


@dataclass
class Sample:
    """Distinct features of a bounded number of rows, as two flat arrays."""
    toxic: np.ndarray
    row: np.ndarray
    feature: np.ndarray


def feature_rows(docs: DataFrame, rows: int) -> Sample:
    """``toxic`` and features of ``rows`` rows of a bounded sample at most
    (repeated ids may bring more).  Features of fewer than three rows can
    neither vote nor get a weight; they are left out."""
    @pandas_udf("binary")
    def feats(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Cached(word_features)
        for text in texts:
            yield pd.Series([np.array(sorted({f for w in words_of(t) for f in own[w]}), "<i4").tobytes() for t in text],
                            dtype=object)

    got = (docs.select("toxic", feats("text").alias("f"), F.xxhash64("doc_id").alias("h"), F.md5("text").alias("t"))
               .orderBy("h", "t").limit(rows).select("toxic", "f").toPandas())
    lens = np.array([len(f) // 4 for f in got["f"]], int)
    flat = np.frombuffer(b"".join(got["f"]), "<i4")
    row = np.repeat(np.arange(len(got), dtype=np.int32), lens)
    keep = np.bincount(flat, minlength=FEATURES)[flat] >= 3
    return Sample(got["toxic"].to_numpy() == 1, row[keep], flat[keep])


def mine_voters(sample: Sample) -> list[list[int]]:
    """Features that occur in at least ``MIN_SUPPORT`` toxic rows and hardly
    elsewhere, strongest first; one of several with the same rows is kept."""
    y, flat, row = sample.toxic, sample.feature, sample.row
    mine = y[row]
    pos = np.bincount(flat[mine], minlength=FEATURES)
    neg = np.bincount(flat[~mine], minlength=FEATURES)
    odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / ((~y).sum() + 1))
    good = np.flatnonzero((pos >= MIN_SUPPORT) & (odds > 3.0) & (25 * neg <= pos))
    good = good[np.argsort(-(odds * np.sqrt(pos))[good], kind="stable")]
    seen, out = set(), []
    for f in good:
        mark = row[flat == f].tobytes()
        if mark not in seen:
            seen.add(mark)
            out.append([int(f)])
        if len(out) == MINED:
            break
    return out


def all_voters(sample: Sample) -> list[list[int]]:
    given = [[feature("w", w) for w in group] for group in LEXICON]
    known = {f for g in given for f in g}
    return given + [v for v in mine_voters(sample) if v[0] not in known]


def vote_moments(docs: DataFrame, voters: list[list[int]]) -> tuple[float, np.ndarray]:
    """Number of texts and the sums of products of all pairs of votes."""
    m = len(voters)
    owner = {f: v for v, fs in enumerate(voters) for f in fs}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        votes = Cached(lambda w: [owner[f] for f in word_features(w) if f in owner])
        total, n = np.zeros((m, m)), 0
        for pdf in batches:
            hits = np.zeros((len(pdf), m), np.float32)
            for i, t in enumerate(pdf["text"]):
                for w in words_of(t):
                    for v in votes[w]:
                        hits[i, v] = 1
            total += hits.T @ hits
            n += len(pdf)
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": np.append(i, -1).astype(np.int32), "j": np.append(j, -1).astype(np.int32),
                            "s": np.append(total[i, j], float(n))})

    rows = docs.select("text").mapInPandas(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    n = rows.loc[rows["i"] < 0, "s"].sum()
    out = np.zeros((m, m))
    own = rows[rows["i"] >= 0]
    out[own["i"], own["j"]] = own["s"]
    return float(n), out


@dataclass
class LabelModel:
    """Voters fall into blocks (say, one per language) that fire on different
    texts; a text is toxic when it is in some block's sense."""
    blocks: list[np.ndarray]
    priors: list[float]
    fire_toxic: np.ndarray      # chance that a voter fires on a text toxic in its block's sense
    fire_clean: np.ndarray
    discount: np.ndarray        # 1 / (1 + correlations with other voters)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.fire_toxic / self.fire_clean)
        off = np.log((1 - self.fire_toxic) / (1 - self.fire_clean))
        each = np.where(votes, on, off) * self.discount
        clean = np.ones(len(votes))
        for block, prior in zip(self.blocks, self.priors):
            z = np.log(prior / (1 - prior)) + each[:, block].sum(axis=1)
            clean *= 1 - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return 1 - clean


def _components(linked: np.ndarray) -> list[np.ndarray]:
    label = np.arange(len(linked))
    while True:
        new = np.array([min([label[i], *label[linked[i]]]) for i in range(len(linked))])
        if (new == label).all():
            return [np.flatnonzero(label == k) for k in np.unique(label)]
        label = new


def fit_label_model(n: float, moments: np.ndarray, share: np.ndarray, fires: np.ndarray) -> LabelModel:
    """Per block, accuracies from the rank-one part of the votes' covariance
    and correlations from what it leaves, alternately.

    ``share[v]`` holds, for every voter, the labelled rows (as booleans) that
    are toxic and on which it fires; their union over a block is the block's
    prior; ``fires[v]`` the labelled rows on which it fires at all.  Voters
    with fewer than two others to agree with cannot be judged by agreement:
    they get the share of their labelled rows that are toxic.
    """
    m = len(moments)
    mean = np.diag(moments) / max(n, 1)
    cov = moments / max(n, 1) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    rho = cov / np.outer(sd, sd)
    np.fill_diagonal(rho, 0)
    blocks = [b for b in _components(rho > 0.05) if (mean[b] > 0).any()]
    toxic, clean = np.full(m, 1e-4), np.full(m, 1e-4)
    discount, priors = np.ones(m), []
    for b in blocks:
        prior = float(np.clip(share[b].any(axis=0).mean(), 1e-3, 0.5))
        priors.append(prior)
        k = len(b)
        own, s = cov[np.ix_(b, b)], sd[b]
        z, used, linked = s * np.sqrt(prior), ~np.eye(k, dtype=bool), np.zeros((k, k), bool)
        corr = np.zeros((k, k))
        for _ in range(4):
            for _ in range(50):
                for i in range(k):
                    w = used[i]
                    bottom = (z[w] ** 2).sum()
                    if bottom > 0:
                        z[i] = max((own[i, w] * z[w]).sum() / bottom, 0.0)
            corr = (own - np.outer(z, z)) / np.outer(s, s)
            np.fill_diagonal(corr, 0)
            linked = corr > 0.2
            used = ~np.eye(k, dtype=bool) & ~linked
        few = used.sum(axis=1) < 2
        lift = np.sqrt((1 - prior) / prior)
        right = (share[b].sum(axis=1) + 0.1) / (fires[b].sum(axis=1) + 1)
        z = np.where(few, (right * mean[b] / prior - mean[b]) / lift, z)
        toxic[b] = np.clip(mean[b] + z * lift, 1e-4, 0.99)
        clean[b] = np.clip(mean[b] - z / lift, 0.02 * mean[b] + 1e-6, 0.5)
        discount[b] = 1 / (1 + np.where(linked, np.minimum(corr, 1.0), 0.0).sum(axis=1))
    return LabelModel(blocks, priors, np.maximum(toxic, clean), clean, discount)


def fit_linear(sample: Sample, target: np.ndarray, steps: int = 300, l2: float = 1e-4, l1: float = 4e-4,
               rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression on soft labels with weights of zero or more
    (proximal gradient, L1 and L2): ``(features, weights)`` without the zero
    weights."""
    used = np.flatnonzero(np.bincount(sample.feature, minlength=FEATURES))
    place = np.zeros(FEATURES, np.int32)
    place[used] = np.arange(len(used))
    col, row, n = place[sample.feature], sample.row, len(target)
    w, bias = np.zeros(len(used)), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    speed = np.ones(len(used)) * 1e-8
    # every class weighs half, so that rare toxic rows count
    share = np.clip(target.mean(), 0.01, 0.99)
    weight = target * 0.5 / share + (1 - target) * 0.5 / (1 - share)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], n) + bias, -30, 30)))
        g = weight * (p - target) / n
        grad = np.bincount(col, g[row], len(used)) + l2 * w
        speed += grad ** 2
        step = rate / np.sqrt(speed)
        w = w - step * grad
        w = np.maximum(w - np.minimum(step, 50) * l1, 0)      # harmless words never excuse a text
        bias -= rate * g.sum()
    nz = w != 0
    return used[nz], w[nz]


@dataclass
class Classifier:
    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        table = dict(zip(self.features.tolist(), self.weights.tolist()))
        own = Cached(lambda w: sum(table.get(f, 0.0) for f in word_features(w)))

        def score(text: str | None) -> float:
            z = self.bias + sum(map(own.__getitem__, sorted(words_of(text))))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return score


def fit(docs: DataFrame, labels: DataFrame, train: Column) -> Classifier:
    """Classifier from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``;
    ``train`` says which documents may be learned from.  Without toxic rows to
    learn from (or on an empty table), a classifier that finds nothing toxic.

    Of several labels of one id the highest counts; null ids and labels, and
    labels of absent documents, teach nothing; null texts count as empty; rows
    repeated in ``docs`` are each counted in the votes.  Ties in the sample are
    broken by text.  Other columns are never read."""
    rows = docs.where(train).select("doc_id", "text")
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = feature_rows(least_hash_rows(rows, marked, SAMPLE_ROWS).select("doc_id", "toxic", "text"), SAMPLE_ROWS)
    if not sample.toxic.any():
        return Classifier(np.empty(0, np.int64), np.empty(0), -6.0)
    voters = all_voters(sample)
    n, moments = vote_moments(rows, voters)
    owner = np.full(FEATURES, -1)
    for v, fs in enumerate(voters):
        owner[fs] = v
    who = owner[sample.feature]
    votes = np.zeros((len(sample.toxic), len(voters)), bool)
    votes[sample.row[who >= 0], who[who >= 0]] = True
    model = fit_label_model(n, moments, (votes & sample.toxic[:, None]).T, votes.T)
    soft = model.posterior(votes)
    used, weights = fit_linear(sample, soft)
    # the cut lies where it divides the label model's decisions best
    table = np.zeros(FEATURES)
    table[used] = weights
    z = np.bincount(sample.row, table[sample.feature], len(soft))
    cuts = np.quantile(z, np.linspace(0, 1, 401))
    hard = soft >= 0.5
    err = np.array([((z >= c) != hard).sum() for c in cuts])
    return Classifier(used, weights, -float(cuts[err == err.min()].mean()))


def score_column(docs: DataFrame, model: Classifier) -> Column:
    """Score of the ``text`` column, 0 to 1; null and empty texts score by
    the bias alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = sent.value.scorer()
        for text in texts:
            yield pd.Series([one(t) for t in text], dtype=float)

    return score(F.col("text"))


def not_toxic(docs: DataFrame, model: Classifier, threshold: float = 0.5) -> DataFrame:
    """Rows that score below the threshold, columns unchanged."""
    return docs.where(score_column(docs, model) < threshold)
