"""Language identification by interpolated Kneser-Ney character models.

Letters are folded to 63 classes (a-z, and 37 classes of all other letters by
code point), everything else is one boundary symbol, so a 4-gram is a 24-bit
hash that can be shifted to its context and its suffix.  Counts of 4-grams per
language cover every training text and are added up by Spark; the tables that
reach the driver are bounded by 2^24 entries a language whatever the corpus.
From them the continuation counts of the lower orders, the discounts and the
interpolated probabilities follow.  A model keeps one sorted array of 4-gram
hashes with a row of log probabilities, one per language; orders 1 to 3 fit
dense tables, which serve 4-grams never seen.

A text gets the language of the lowest cross-entropy per symbol.  Confidence
and the rejection thresholds are calibrated with a model that leaves out one
training row in twenty, on all of the rows left out, which are scored where
they lie; the model that scores has the counts of all training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleselect.operators.select import rank_within
from tripleselect.session import cut_lineage

ORDER, BITS = 4, 6
CLASSES = 1 << BITS
SUFFIX = (1 << (BITS * (ORDER - 1))) - 1
#: Symbols handled together; bounds a task's memory however long a text is.
SLICE_CHARS = 1 << 21
#: Scales that calibration chooses from; losses are added up exactly, as whole numbers and these parts of one.
SCALES, LOSS_PARTS = 2.0 ** np.arange(-6, 6, 0.5), 1 << 60
REJECT_QUANTILE = 0.995
UNDETERMINED = "und"
_FOLD: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Class of every code point: 0 for all but letters."""
    if not _FOLD:
        t = np.zeros(0x110000, np.uint8)
        letters = np.array([c for c in range(0x110000) if chr(c).isalpha()])
        t[letters] = CLASSES - 37 + letters % 37
        t[ord("a"):ord("z") + 1] = np.arange(1, 27)
        _FOLD.append(t)
    return _FOLD[0]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the texts' characters and which of them begin a text; runs
    of non-letters are one boundary, texts start with one."""
    code = np.frombuffer("".join(" " + t for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    c = fold_table()[code]
    lens = np.array([len(t) + 1 for t in texts])
    first = np.zeros(len(c), bool)
    first[np.cumsum(lens) - lens] = True
    keep = first | (c > 0)
    keep[1:] |= c[:-1] > 0
    return c[keep], first[keep]


def keys_of(c: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The hash of the ``ORDER`` symbols that end at each place, not reaching
    before a text's first."""
    pos = np.arange(len(c)) - np.maximum.accumulate(np.where(first, np.arange(len(c)), 0))
    key = c.astype(np.uint32)
    for k in range(1, ORDER):
        past = np.zeros(len(c), np.uint32)
        past[k:] = c[:-k]
        key |= np.where(pos >= k, past, 0).astype(np.uint32) << np.uint32(BITS * k)
    return key


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(document, 4-gram)`` for every symbol after the first of each text,
    in slices."""
    group, held = [], 0

    def flush():
        c, first = symbols([t for _, t in group])
        doc = np.array([d for d, _ in group])[np.cumsum(first) - 1]
        return doc[~first], keys_of(c, first)[~first]

    for d, t in enumerate(texts):
        if not t:
            continue
        t = t.lower()
        if len(t) > SLICE_CHARS:                         # one byte a symbol; hashes a stretch at a time
            c, first = symbols([t])
            for i in range(0, len(c), SLICE_CHARS):
                lead = min(i, ORDER - 1)
                key = keys_of(c[i - lead:i + SLICE_CHARS], first[i - lead:i + SLICE_CHARS])[lead:]
                key = key[1:] if i == 0 else key
                yield np.full(len(key), d), key
            continue
        group.append((d, t))
        held += len(t)
        if held >= SLICE_CHARS:
            yield flush()
            group, held = [], 0
    if group:
        yield flush()


def count_grams(docs: DataFrame, apart: Column, lang: str = "lang") -> DataFrame:
    """``lang, gram, n, kept`` over all rows of ``docs`` with a language:
    counts in all rows, and in those where ``apart`` does not hold."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[tuple[str, bool], tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for name, part in pdf.groupby(["lang", "apart"]):
                for _, key in grams(list(part["text"])):
                    k, n = np.unique(key, return_counts=True)
                    if name in own:
                        k, at = np.unique(np.concatenate([own[name][0], k]), return_inverse=True)
                        n = np.bincount(at, np.concatenate([own[name][1], n])).astype(np.int64)
                    own[name] = (k, n)
        for (name, left), (k, n) in own.items():
            yield pd.DataFrame({"lang": name, "gram": k.astype(np.int32), "n": n, "kept": np.where(left, 0, n)})

    src = docs.select(F.col(lang).alias("lang"), "text", apart.alias("apart")).where("lang IS NOT NULL AND text IS NOT NULL")
    return (src.mapInPandas(run, "lang string, gram int, n long, kept long").groupBy("lang", "gram")
               .agg(F.sum("n").alias("n"), F.sum("kept").alias("kept")))


def _level(key: np.ndarray, n: np.ndarray, lower: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Interpolated probability of each listed gram, and the back-off weight
    of every context (1 where the context is unseen)."""
    n1, n2 = (n == 1).sum(), (n == 2).sum()
    d = n1 / (n1 + 2 * n2) if n1 and n1 + 2 * n2 else 0.5
    ctx = key >> BITS
    total = np.bincount(ctx, n, size)
    kinds = np.bincount(ctx, minlength=size)
    back = np.ones(size)
    back[total > 0] = d * kinds[total > 0] / total[total > 0]
    return np.maximum(n - d, 0) / total[ctx] + back[ctx] * lower[key], back


@dataclass
class Model:
    """Sorted hash array of 4-grams and, per language, log probabilities."""
    langs: list[str]
    keys: np.ndarray
    logp: np.ndarray            # [language, gram]
    back: np.ndarray            # [language, context]  log back-off weight
    low: np.ndarray             # [language, trigram]  log probability of order 3
    scale: float = 1.0
    limit: np.ndarray = field(default_factory=lambda: np.empty(0))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol ``[text, language]`` and symbols per text."""
        h, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        if not hasattr(self, "_place"):
            place = np.full(1 << (BITS * ORDER), -1, np.int32)     # where each hash is in the sorted array
            place[self.keys] = np.arange(len(self.keys))
            self._place = place
        for doc, key in grams(texts):
            at = self._place[key]
            new = np.flatnonzero(at < 0)
            cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.empty(0, int)
            if not len(cut):
                continue
            n[doc[cut]] += np.diff(np.append(cut, len(doc)))
            for l in range(len(self.langs)):
                p = self.logp[l][at] if len(self.keys) else np.zeros(len(at), np.float32)
                p[new] = self.back[l][key[new] >> BITS] + self.low[l][key[new] & SUFFIX]
                h[doc[cut], l] -= np.add.reduceat(p.astype(np.float64), cut)
        return h / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        h, n = self.entropies(texts)
        table = fold_table()
        letters = np.array([bool(t) and any(table[ord(c)] for c in t.lower()[:64]) or bool(t) and
                            any(c.isalpha() for c in t) for t in texts], bool)
        if not self.langs:
            return pd.DataFrame({"lang_pred": [UNDETERMINED] * len(texts), "score": 0.0, "cross_entropy": np.nan,
                                 "rejected": True})
        best = h.argmin(axis=1) if len(texts) else np.empty(0, int)
        z = -(h - h.min(axis=1, keepdims=True)) * (self.scale * np.sqrt(np.maximum(n, 1)))[:, None]
        score = 1.0 / np.exp(z).sum(axis=1)
        low = h[np.arange(len(texts)), best]
        name = np.array(self.langs, object)[best]
        return pd.DataFrame({"lang_pred": np.where(letters, name, UNDETERMINED), "score": np.where(letters, score, 0.0),
                             "cross_entropy": np.where(letters, low, np.nan),
                             "rejected": ~letters | (low > self.limit[best])})


def build_model(counts: pd.DataFrame) -> Model:
    """Kneser-Ney tables from ``lang, gram, n`` (bounded, see the module)."""
    langs = sorted(counts["lang"].unique())
    keys = np.unique(counts["gram"].to_numpy(np.int64))
    logp = np.zeros((len(langs), len(keys)), np.float32)
    back, low = np.zeros((len(langs), SUFFIX + 1), np.float32), np.zeros((len(langs), SUFFIX + 1), np.float32)
    for l, name in enumerate(langs):
        own = counts[counts["lang"] == name].sort_values("gram")
        k, n = own["gram"].to_numpy(np.int64), own["n"].to_numpy(np.float64)
        # continuation counts: in how many grams one symbol longer a gram is the end
        level = {ORDER: (k, n)}
        for o in range(ORDER - 1, 0, -1):
            level[o] = np.unique(level[o + 1][0] & ((1 << (BITS * o)) - 1), return_counts=True)
        dense = np.full(CLASSES, 1.0 / CLASSES)
        for o in range(1, ORDER):
            ko, no = level[o]
            wide = np.tile(dense, CLASSES) if o > 1 else dense      # lower order of every gram of this order
            p, b = _level(ko, no.astype(float), wide, 1 << (BITS * (o - 1)))
            full = np.repeat(b, CLASSES) * wide
            full[ko] = p
            dense = full
        p, b = _level(k, n, np.tile(dense, CLASSES), SUFFIX + 1)
        back[l], low[l] = np.log(b), np.log(dense)
        logp[l] = back[l][keys >> BITS] + low[l][keys & SUFFIX]
        logp[l][np.searchsorted(keys, k)] = np.log(p)
    return Model(langs, keys, logp, back, low, limit=np.full(len(langs), np.inf))


def calibration(rows: DataFrame, model: Model) -> DataFrame:
    """``lang, own, ones, parts`` of every row of ``rows(lang, text)`` that has a
    symbol and a language of the model: its entropy in its language, and its
    loss at each of ``SCALES`` in whole numbers and parts of one."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for pdf in batches:
            for i in range(0, len(pdf), 2000):
                part = pdf.iloc[i:i + 2000]
                h, n = m.entropies(list(part["text"]))
                truth = np.array([m.langs.index(x) if x in m.langs else -1 for x in part["lang"]], int)
                ok = (truth >= 0) & (n > 0)
                if not ok.any():
                    continue
                h, n, truth = h[ok], n[ok], truth[ok]
                own = np.arange(len(h)), truth
                loss = np.empty((len(h), len(SCALES)))
                for k, s in enumerate(SCALES):
                    z = -(h - h.min(axis=1, keepdims=True)) * (s * np.sqrt(n))[:, None]
                    loss[:, k] = np.log(np.exp(z).sum(axis=1)) - z[own]
                ones = np.floor(loss)
                yield pd.DataFrame({"lang": part["lang"][ok].array, "own": h[own], "ones": list(ones.astype(np.int64)),
                                    "parts": list(((loss - ones) * LOSS_PARTS).astype(np.int64))})

    return rows.select("lang", "text").mapInPandas(run, "lang string, own double, ones array<bigint>, parts array<bigint>")


def total_losses(cal: DataFrame) -> list[int]:
    """Sum of the losses at each of ``SCALES``, in ``LOSS_PARTS`` of one; the order of the rows does not matter."""
    sums = cal.agg(*[F.sum(F.col(c)[i].cast("decimal(38,0)")) for c in ("ones", "parts") for i in range(len(SCALES))]).first()
    return [int(sums[i]) * LOSS_PARTS + int(sums[len(SCALES) + i]) for i in range(len(SCALES))] if sums[0] is not None else []


def upper_limits(cal: DataFrame, least: int = 20) -> dict[str, float]:
    """Of each language with at least ``least`` rows the ``REJECT_QUANTILE``
    of ``own``, between the two rows next to it; two rows a language are collected."""
    sizes = cal.groupBy("lang").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    at = (F.col("size") - 1) * F.lit(REJECT_QUANTILE)
    ranked = rank_within(cal.select("lang", "own"), ["lang"], ["own"]).join(sizes, "lang").withColumn("at", at)
    near = ranked.where((F.col("rank") - 1 >= F.floor("at")) & (F.col("rank") - 1 <= F.ceil("at")))
    got = near.groupBy("lang").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.max(F.col("at") - F.floor("at")).alias("part"))
    return {r["lang"]: r["low"] + (r["high"] - r["low"]) * r["part"] for r in got.collect()}


def fit(docs: DataFrame, train: Column) -> Model:
    """Model from the rows where ``train`` holds and ``lang`` is not null;
    without such rows one that knows no language.  Null texts teach nothing,
    repeated rows count as often as they occur, other columns are ignored."""
    apart = F.pmod(F.xxhash64("doc_id", "text"), F.lit(20)) == 0
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = count_grams(rows, apart).toPandas()
    whole = build_model(counts[["lang", "gram", "n"]])
    if not whole.langs:
        return whole
    model = build_model(counts.loc[counts["kept"] > 0, ["lang", "gram", "kept"]].rename(columns={"kept": "n"}))
    del counts
    cal = cut_lineage(calibration(rows.where(apart), model))
    losses = total_losses(cal)
    if losses:
        whole.scale = float(SCALES[losses.index(min(losses))])
        for name, limit in upper_limits(cal).items():
            whole.limit[whole.langs.index(name)] = limit
    return whole


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row ``doc_id, lang_pred, score, cross_entropy, rejected``.

    ``lang_pred`` is ``und`` with score 0 for null texts and texts without
    letters (and when nothing was learned).  ``score`` is the calibrated
    probability of the prediction; ``rejected`` marks texts whose
    cross-entropy is above nearly all calibration texts of that language.
    Equal cross-entropies go to the language first in order.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for pdf in batches:
            for i in range(0, len(pdf), 2000):
                part = pdf.iloc[i:i + 2000]
                out = m.predict(list(part["text"]))
                out.insert(0, "doc_id", part["doc_id"].array)
                yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")
