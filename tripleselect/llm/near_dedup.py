"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is a weighted set of five-word shingles (weight ``1 + ln count``).
Every shingle is a Poisson process whose rate is its weight; each arrival
falls on one of ``m`` registers, and a register keeps the shingle of its first
arrival.  Two documents agree in a register with their probability Jaccard,
which for equal weights is the Jaccard of the sets.  Arrivals are generated
in rounds over whole batches; a shingle stops as soon as its next arrival
comes after the latest first arrival of its document.

A pair passes when the exact Jaccard or the exact probability Jaccard of its
shingles reaches the threshold, so a text with repeated shingles has a second
set of registers, of the same processes with all weights 1: those agree with
the Jaccard.  Without repeats both sets are the same and one is kept.

Registers are cut into bands; documents with equal bands share a bucket.
Each member of a bucket is compared with the bucket's hub (the member met in
the most buckets) and with its neighbours in the orders of two further bands,
so a group of n copies costs O(n) comparisons per band.  Classes are the connected components of passed pairs; equal texts
are one node from the start.  Then every bucket whose members are still in
several classes is compared whole: the members outside its largest class with
all members, block by block, by sketch and then by shingles.  So a pair that shares a bucket is lost only if both its
sets of registers agree ``SLACK_SE`` standard errors too rarely.  Banding itself is probabilistic: see the README.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tripleselect.llm.common import connected_components, cut_lineage, hold, map_slices, marked_rows, text_key

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 26, 6
#: Standard errors below the threshold down to which a pair's agreement of registers is still verified.
SLACK_SE = 4.0
#: Bytes of texts whose shingles are held at once (one text at least), and words remembered with their hash.
SLICE_CHARS, CACHED_WORDS = 1 << 20, 200_000
#: Expected members of a block of a bucket that is compared whole.
BLOCK = 128
GOLD, M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit integers (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M1
        x = (x ^ (x >> np.uint64(27))) * M2
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, w: str) -> int:
        h = xxhash.xxh64_intdigest(w)
        if len(w) <= 40:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[w] = h
        return h


WORDS = WordHashes()


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, shingle, count)``: distinct shingles of each text.  Words
    are runs of non-space; a text with 1 to ``size - 1`` words is one shingle
    of all its words; a text without words has none."""
    hold("near_dedup", WORDS.clear)
    words = [t.split() if t else [] for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((WORDS[x] for w in words for x in w), np.uint64, int(n.sum()))
    doc = np.repeat(np.arange(len(n)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(flat))      # words from here to the text's end
    short = np.repeat(n < size, n)
    start = (left >= size) | (short & (left == np.repeat(n, n)))
    h = np.zeros(len(flat), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            nxt = np.zeros(len(flat), np.uint64)
            if len(flat) > k:
                nxt[:len(flat) - k] = flat[k:]
            h = np.where(left > k, (h ^ nxt) * GOLD + np.uint64(k + 1), h)
    h, doc = mix(h[start]), doc[start]
    own = mix(h ^ mix(doc.astype(np.uint64) + GOLD))              # one key per (document, shingle)
    _, first, count = np.unique(own, return_index=True, return_counts=True)
    return doc[first], h[first], count


def prob_minhash(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """Registers ``[docs, m]`` (winning item, 0 where a document has none)."""
    time = np.full(docs * m, np.inf)
    won = np.zeros(docs * m, np.uint64)
    live_doc, live, rate, at = doc, item, weight.astype(float), np.zeros(len(item))
    step = 0
    while len(live):
        step += 1
        with np.errstate(over="ignore"):
            r = mix(live + np.uint64(step) * GOLD)
        at = at - np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53) / rate
        cell = live_doc * m + (mix(r) % np.uint64(m)).astype(np.int64)
        np.minimum.at(time, cell, at)
        first = time[cell] == at
        won[cell[first]] = live[first]
        open_docs = np.unique(live_doc)
        last = np.zeros(docs)
        last[open_docs] = time.reshape(docs, m)[open_docs].max(axis=1)
        on = at < last[live_doc]
        live_doc, live, rate, at = live_doc[on], live[on], rate[on], at[on]
    return won.reshape(docs, m)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of Jaccard and probability Jaccard of two weighted sets,
    given as sorted items and their weights."""
    common, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    j = len(common) / (len(a[0]) + len(b[0]) - len(common))
    x, y = a[1][ia], b[1][ib]
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    ratio = x / y
    order = np.argsort(ratio)                                     # by x / y
    xs, ys = x[order], y[order]
    # P = sum over i of 1 / sum over j of max(x_j / x_i, y_j / y_i); y's term is the larger where x_j / y_j <= x_i / y_i
    cy, cx = np.cumsum(ys), np.cumsum(xs[::-1])[::-1]
    after = np.append(cx[1:], 0.0)
    jp = (1.0 / ((cy + only_b) / ys + (after + only_a) / xs)).sum()
    return float(max(j, jp))


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, tkey, bands, unit, sketch`` for every row: band hashes, those
    of the registers of weight 1 (null where they are the same), and the low
    byte of each register (then of each of weight 1, unless ``unit`` is null).
    All null for texts without words."""
    m = bands * rows

    def band_hashes(won: np.ndarray) -> np.ndarray:
        h = np.zeros((len(won), bands), np.uint64)
        cut = won.reshape(len(won), bands, rows)
        for r in range(rows):
            with np.errstate(over="ignore"):
                h = mix((h ^ cut[:, :, r]) + GOLD)
        return h.view(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            code, uniq = pd.factorize(part["tkey"])               # copies in a slice are sketched once
            first = np.full(len(uniq), -1)
            first[code[::-1]] = np.arange(len(part))[::-1]
            texts = part["text"].to_numpy()[first[first >= 0]] if len(uniq) else []
            d, s, c = shingles(list(texts))
            won = prob_minhash(d, s, 1.0 + np.log(c), len(texts), m)
            has = np.zeros(len(texts), bool)
            has[d] = True
            band, low = band_hashes(won), [x.tobytes() for x in won.astype(np.uint8)]
            unit: list = [None] * len(texts)
            again = np.unique(d[c > 1])                           # texts with repeated shingles
            mine = np.isin(d, again)
            flat = prob_minhash(np.searchsorted(again, d[mine]), s[mine], np.ones(mine.sum()), len(again), m)
            for x, k, w in zip(again, band_hashes(flat), flat):
                if (w != won[x]).any():
                    unit[x] = k
                    low[x] += w.astype(np.uint8).tobytes()
            ok = [k >= 0 and has[k] for k in code]
            yield pd.DataFrame({"doc_id": pd.array(part["doc_id"], dtype="Int64"), "tkey": part["tkey"],
                                "bands": [band[k] if o else None for k, o in zip(code, ok)],
                                "unit": [unit[k] if o else None for k, o in zip(code, ok)],
                                "sketch": [low[k] if o else None for k, o in zip(code, ok)]})

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("tkey"), "text")
    return map_slices(src, run, "doc_id long, tkey string, bands array<bigint>, unit array<bigint>, sketch binary", ("text",),
                      SLICE_CHARS)


def _neighbours(rows: DataFrame, order: list[str]) -> DataFrame:
    """Pairs ``(a, b)`` of rows next to each other in a bucket's order.  The
    rows are range-partitioned by bucket and order, so a large bucket spans
    partitions; the rows at partition borders are paired at the end."""
    p = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = ["band", "h", *order, "node"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        part, last, head = TaskContext.get().partitionId(), None, None
        for pdf in batches:
            if not len(pdf):
                continue
            key = list(zip(pdf["band"], pdf["h"], pdf["node"]))
            head = head or key[0]
            if last is not None:
                key = [last, *key]
            last = key[-1]
            band = np.array([k[0] for k in key])
            h = np.array([k[1] for k in key], np.int64)
            node = np.array([k[2] for k in key], object)
            same = (band[1:] == band[:-1]) & (h[1:] == h[:-1]) & (node[1:] != node[:-1])
            yield pd.DataFrame({"part": part, "side": 0, "band": 0, "h": 0, "a": node[:-1][same], "b": node[1:][same]})
        if head is not None:
            yield pd.DataFrame({"part": part, "side": [1, 2], "band": [head[0], last[0]], "h": [head[1], last[1]],
                                "a": [head[2], last[2]], "b": None})

    out = cut_lineage(rows.select(*dict.fromkeys(cols)).repartitionByRange(p, *dict.fromkeys(cols))
                          .sortWithinPartitions(*dict.fromkeys(cols))
                          .mapInPandas(run, "part int, side int, band int, h long, a string, b string"))
    # two rows per partition
    w = Window.orderBy("part", "side")
    edge = out.where("side > 0").select("side", "band", "h", "a", F.lag("a").over(w).alias("pa"), F.lag("side").over(w)
                                        .alias("ps"), F.lag("band").over(w).alias("pb"), F.lag("h").over(w).alias("ph"))
    edge = edge.where("side = 1 AND ps = 2 AND band = pb AND h = ph AND a <> pa").select("a", F.col("pa").alias("b"))
    return out.where("side = 0").select("a", "b").unionByName(edge)


def registers(sketch: Iterable[bytes], m: int) -> np.ndarray:
    """Low bytes ``[texts, 2 m]``: registers, then those of weight 1."""
    return np.frombuffer(b"".join(x if len(x) == 2 * m else x + x for x in sketch), np.uint8).reshape(-1, 2 * m)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The larger share of equal registers of both kinds, per row."""
    m = a.shape[-1] // 2
    same = a == b
    return np.maximum(same[..., :m].mean(axis=-1), same[..., m:].mean(axis=-1))


def least_agreement(m: int, threshold: float) -> float:
    """Share of ``m`` registers from which a pair is worth verifying."""
    return max(0.0, threshold - SLACK_SE * (threshold * (1 - threshold) / m) ** 0.5)


def bucket_entries(sk: DataFrame, bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """``node, bands, unit, sketch`` of every different text, and ``band, h, node,
    h1, h2, n`` of every bucket with ``n`` > 1 members."""
    one = sk.where(F.col("bands").isNotNull()).groupBy(F.col("tkey").alias("node")).agg(
        F.first(F.struct("bands", "unit", "sketch")).alias("one")).select("node", "one.*")
    one = cut_lineage(one)
    # both kinds of registers share the buckets; a unit band that equals the weighted one is no second entry
    entry = one.select("node", F.posexplode("bands").alias("band", "h"), "bands").unionByName(
        one.where(F.col("unit").isNotNull()).select("node", F.posexplode("unit").alias("band", "h"), "unit", "bands")
           .where(F.col("h") != F.get("bands", F.col("band"))).drop("bands").withColumnRenamed("unit", "bands"))
    entry = entry.select("node", "band", "h", F.get("bands", (F.col("band") + 1) % bands).alias("h1"),
                         F.get("bands", (F.col("band") + 7) % bands).alias("h2"))
    size = cut_lineage(entry.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # most texts are alone in their buckets: those entries are not shuffled a second time
    bucket = F.xxhash64("band", "h")
    return one, cut_lineage(marked_rows(entry, bucket, size, bucket).join(size, ["band", "h"]))


def candidate_pairs(one: DataFrame, entry: DataFrame, bands: int = BANDS, rows: int = ROWS,
                    threshold: float = THRESHOLD) -> DataFrame:
    """Distinct pairs ``(a, b)`` of different texts worth verifying, from a
    number of comparisons linear in the buckets' sizes."""
    met = entry.groupBy("node").agg(F.sum("n").alias("met"))
    hubs = (entry.join(met, "node").groupBy("band", "h")
                 .agg(F.max(F.struct("met", "node"))["node"].alias("hub")))
    star = entry.join(hubs, ["band", "h"]).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    pairs = (star.unionByName(_neighbours(entry, ["h1", "h2"])).unionByName(_neighbours(entry, ["h2", "h1"]))
                 .where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    m = bands * rows
    least = least_agreement(m, threshold)

    @pandas_udf("double")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(agreement(registers(x, m), registers(y, m)), dtype=float)

    sketch = one.select("node", "sketch")
    both = (pairs.join(sketch.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a")
                 .join(sketch.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b"))
    return both.where(agree("x", "y") >= least).select("a", "b")


def node_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, text`` of the texts in ``nodes(node)``, each once; few others are shuffled."""
    texts = docs.select(text_key(F.col("text")).alias("node"), "text").where(F.col("node").isNotNull())
    key = F.xxhash64("node")
    one = marked_rows(texts, key, nodes, key).groupBy("node").agg(F.first("text").alias("text"))
    return one.join(nodes, "node", "left_semi")


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, items, counts`` of the texts in ``nodes(node)``: sorted
    shingles (64 bits each) and how often each occurs (32 bits each)."""
    texts = node_texts(docs, nodes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            d, s, c = shingles(list(part["text"]))
            order = np.lexsort((s, d))
            s, c = s[order], c[order].astype(np.int32)
            cut = np.searchsorted(d[order], np.arange(len(part) + 1))
            yield pd.DataFrame({"node": part["node"], "items": [s[x:y].tobytes() for x, y in zip(cut, cut[1:])],
                                "counts": [c[x:y].tobytes() for x, y in zip(cut, cut[1:])]})

    return map_slices(texts, run, "node string, items binary, counts binary", ("text",), SLICE_CHARS)


def leftover_links(docs: DataFrame, one: DataFrame, entry: DataFrame, comps: DataFrame, bands: int = BANDS,
                   rows: int = ROWS, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Similar pairs ``(a, b)`` among members of one bucket that are in
    different classes (``comps``: ``node, comp``).

    The members outside a bucket's largest class (``side`` 0) meet all its
    members (``side`` 1).  Both are split by hash into blocks, one task group
    per pair of blocks, which compares sketches and then shingles; only
    similar pairs leave it.
    """
    least = least_agreement(bands * rows, threshold)
    at = entry.select("band", "h", "node").join(comps.select("node", "comp"), "node", "left").select(
        "band", "h", "node", F.coalesce("comp", "node").alias("comp"))
    per = at.groupBy("band", "h", "comp").agg(F.count(F.lit(1)).alias("c"))
    # two members have met already
    per = (per.groupBy("band", "h").agg(F.sum("c").alias("n"), F.max(F.struct("c", "comp")).alias("top"))
              .where("n > 2 AND top.c < n").select("band", "h", F.col("top.comp").alias("main"),
                                                   F.ceil(F.col("n") / block).alias("all_blocks"),
                                                   F.ceil((F.col("n") - F.col("top.c")) / block).alias("few_blocks")))
    at = cut_lineage(at.join(per, ["band", "h"]))
    wide = at.join(shingle_sets(docs, cut_lineage(at.select("node").distinct())).join(one.select("node", "sketch"), "node"), "node")
    few = F.pmod(F.xxhash64("node"), F.col("few_blocks"))
    every = F.pmod(F.xxhash64("node", F.lit(1)), F.col("all_blocks"))

    def blocks(n: str):
        return F.sequence(F.lit(0).cast("long"), F.col(n) - 1)

    as_any = F.transform(blocks("few_blocks"), lambda i: F.struct(i.alias("i"), every.alias("j"), F.lit(1).alias("side")))
    as_few = F.transform(blocks("all_blocks"), lambda j: F.struct(few.alias("i"), j.alias("j"), F.lit(0).alias("side")))
    key = ["band", "h", "i", "j"]
    met = (wide.withColumn("at", F.explode(F.when(F.col("comp") != F.col("main"), F.concat(as_any, as_few)).otherwise(as_any)))
               .select("band", "h", "at.*", "node", F.xxhash64("comp").alias("comp"), "sketch", "items", "counts"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        keys = part[key].to_numpy(np.int64)
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        side, comp, node = part["side"].to_numpy(), part["comp"].to_numpy(), part["node"].to_numpy(object)
        regs = registers(part["sketch"], bands * rows)
        sets = [(np.frombuffer(s, np.uint64), 1.0 + np.log(np.frombuffer(c, np.int32)))
                for s, c in zip(part["items"], part["counts"])]
        out = set()
        for lo, hi in zip(np.append(0, cut), np.append(cut, len(part))):
            rest = lo + np.flatnonzero(side[lo:hi] == 1)
            others = regs[rest]
            for x in lo + np.flatnonzero(side[lo:hi] == 0):
                for y in rest[(comp[rest] != comp[x]) & (agreement(others, regs[x]) >= least)]:
                    if similarity(sets[x], sets[y]) >= threshold:
                        out.add((node[x], node[y]))
        return pd.DataFrame(sorted(out), columns=["a", "b"], dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None                                               # the group that the next batch may go on with
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            other = (pdf[key].to_numpy(np.int64) != pdf[key].to_numpy(np.int64)[-1]).any(axis=1)
            last = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if last:
                yield compare(pdf.iloc[:last])
            held = pdf.iloc[last:]
        if held is not None:
            yield compare(held)

    return (met.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, "a string, b string")
               .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def verified_pairs(docs: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs whose texts are similar enough, with their ``similarity``."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = node_texts(docs, cut_lineage(nodes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def sets(texts) -> list[tuple[np.ndarray, np.ndarray]]:
            d, s, c = shingles(list(texts))
            order = np.lexsort((s, d))
            d, s, w = d[order], s[order], 1.0 + np.log(c[order])
            cut = np.searchsorted(d, np.arange(len(texts) + 1))
            return [(s[i:j], w[i:j]) for i, j in zip(cut[:-1], cut[1:])]

        for part in batches:
            code, uniq = pd.factorize(pd.concat([part["ta"], part["tb"]], ignore_index=True))
            own = sets(uniq)
            n = len(part)
            sim = np.array([similarity(own[x], own[y]) for x, y in zip(code[:n], code[n:])])
            ok = sim >= threshold
            yield pd.DataFrame({"a": part["a"].to_numpy()[ok], "b": part["b"].to_numpy()[ok], "similarity": sim[ok]})

    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
                 .join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b"))
    return map_slices(both.select("a", "b", "ta", "tb"), run, "a string, b string, similarity double", ("ta", "tb"), SLICE_CHARS)


def joined_classes(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``node, comp`` once the classes of ``comps(node, comp)`` that ``links(a,
    b)`` connect are one; a node without a class is one of its own.  Only
    linked classes go through the rounds of the component search."""
    for end in ("a", "b"):
        links = (links.join(comps.select(F.col("node").alias(end), "comp"), end, "left")
                      .withColumn(end, F.coalesce("comp", end)).drop("comp"))
    met = cut_lineage(connected_components(links))
    now = (comps.join(met.select(F.col("node").alias("comp"), F.col("comp").alias("now")), "comp", "left")
                .select("node", F.coalesce("now", "comp").alias("comp")))
    return now.unionByName(met.join(comps, "node", "left_anti"))


def near_classes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Per input row ``doc_id, tkey, class_id, class_key, class_size, texts``.

    ``class_id`` is the least doc_id of the class and ``class_key`` the text of
    that document; ``class_size`` counts rows, ``texts`` different texts.
    Equal texts (empty ones too) are one class; texts without words are in no
    other; a null text is never similar to anything, so its row is a class of
    its own (size 1, ``class_key`` null, ``class_id`` its doc_id).  An empty
    table gives no rows; other columns are ignored.
    """
    sk = cut_lineage(sketches(docs, bands, rows))
    one, entry = bucket_entries(sk, bands)
    tried = cut_lineage(candidate_pairs(one, entry, bands, rows, threshold))
    comps = cut_lineage(connected_components(verified_pairs(docs, tried, threshold)))
    links = cut_lineage(leftover_links(docs, one, entry, comps, bands, rows, threshold))
    if links.limit(1).count():
        comps = joined_classes(comps, links)
    keys = sk.where(F.col("tkey").isNotNull()).groupBy("tkey").agg(F.min("doc_id").alias("low"),
                                                                   F.count(F.lit(1)).alias("n"))
    keys = keys.join(comps, F.col("tkey") == F.col("node"), "left").select(
        "tkey", "low", "n", F.coalesce("comp", "tkey").alias("comp"))
    cls = keys.groupBy("comp").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "tkey")).alias("first"),
                                   F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("texts"))
    named = keys.join(cls, "comp").select(F.col("tkey").alias("k"), F.col("first.low").alias("class_id"),
                                          F.col("first.tkey").alias("class_key"), "class_size", "texts")
    out = sk.select("doc_id", "tkey").join(named, F.col("tkey") == F.col("k"), "left")
    return out.select("doc_id", "tkey", F.coalesce("class_id", "doc_id").alias("class_id"), "class_key",
                      F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
                      F.coalesce("texts", F.lit(1)).cast("long").alias("texts"))


def near_deduplicated(docs: DataFrame, **kw) -> DataFrame:
    """One document of each class, columns unchanged: the one with the least
    doc_id.  Rows with null texts stay."""
    def row_key(text: Column, doc_id: str) -> Column:
        return F.concat_ws(" ", text, F.col(doc_id).cast("long").cast("string"))

    cls = near_classes(docs, **kw).where(F.col("class_key").isNotNull())
    key = "__row_key"
    while key in docs.columns:
        key += "_"
    keep = cls.where(F.col("tkey") == F.col("class_key")).select(row_key(F.col("tkey"), "class_id").alias(key)).distinct()
    rows = docs.where(F.col("text").isNotNull()).withColumn(key, row_key(text_key(F.col("text")), "doc_id"))
    # the join leaves the rows partitioned by the key on which repeated rows then go
    return rows.join(keep, key, "left_semi").dropDuplicates([key]).drop(key).unionByName(docs.where(F.col("text").isNull()))
