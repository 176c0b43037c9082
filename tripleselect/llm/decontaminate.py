"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of lower-cased words.  Shared
runs of ``MIN_MATCH`` words (seeds) join documents to items; for each joined
pair the longest matches are marked repeatedly, so that no word is covered
twice (running Karp-Rabin), until none of at least ``MIN_MATCH`` words is
left.  A document is contaminated by an item when the tiles cover at least
``THRESHOLD`` of the item's words, wherever they stand: a passage whose parts
were reordered is still found.

The benchmark is processed in blocks of bounded size.  A block's seeds are
broadcast and every document is scanned once per block, so nothing is
shuffled and a popular passage makes no hot group.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

MIN_MATCH = 5
THRESHOLD = 0.8
#: Benchmark text broadcast at once; a larger benchmark takes several scans.
BLOCK_BYTES = 16 << 20
WORDS = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)
HITS = "array<struct<item_id:string,coverage:double,covered:int,words:int,tiles:array<struct<at:int,n:int>>>>"


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE, np.uint64)]))


class Rolling:
    """Karp-Rabin hashes of all windows of a sequence of word numbers."""

    def __init__(self, ids: np.ndarray):
        self.ids, n = ids, len(ids)
        with np.errstate(over="ignore"):
            self.pw = _powers(n)
            # h[i] = sum of (id + 1) * BASE^-k in a form that needs no division: compare h scaled by BASE^(n-i)
            self.sum = np.concatenate([[np.uint64(0)], np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * self.pw[:n])])

    def windows(self, size: int, scale: int) -> np.ndarray:
        """Hash of ``ids[i:i + size]`` for every i, brought to power ``scale``
        (at least the number of windows) so that sequences compare."""
        n = len(self.ids) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            return (self.sum[size:] - self.sum[:n]) * _powers(scale)[scale - np.arange(n)]


def greedy_tiles(doc: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles ``(place in doc, place in item, length)`` of greedy string tiling.

    Negative word numbers never match.  The search length starts at the
    item's length and is halved down to ``min_match``; in each step all
    unmarked matches of at least that length are marked, the longest first
    (equal lengths: first in the item, then in the document).
    """
    nd, ni = len(doc), len(item)
    if min(nd, ni) < min_match:
        return []
    free_d, free_i = doc >= 0, item >= 0
    scale = max(nd, ni)
    rd, ri = Rolling(np.where(doc >= 0, doc, 0)), Rolling(np.where(item >= 0, item, 0))
    tiles: list[tuple[int, int, int]] = []
    size = ni
    while True:
        size = max(min_match, min(size, ni, nd))
        open_d = np.concatenate([[0], np.cumsum(~free_d)])
        open_i = np.concatenate([[0], np.cumsum(~free_i)])
        hi, hd = ri.windows(size, scale), rd.windows(size, scale)
        ok_i = np.flatnonzero(open_i[size:] == open_i[:-size])
        ok_d = np.flatnonzero((open_d[size:] == open_d[:-size]) & np.isin(hd, hi[ok_i]))
        by_hash: dict[int, list[int]] = {}
        for j in ok_i:
            by_hash.setdefault(int(hi[j]), []).append(int(j))
        found = []
        for i in ok_d:
            for j in by_hash.get(int(hd[i]), ()):
                i = int(i)
                if i and j and free_d[i - 1] and free_i[j - 1] and doc[i - 1] == item[j - 1]:
                    continue                     # inside a match that starts earlier
                if not np.array_equal(doc[i:i + size], item[j:j + size]):
                    continue
                n = size
                while i + n < nd and j + n < ni and free_d[i + n] and free_i[j + n] and doc[i + n] == item[j + n]:
                    n += 1
                found.append((-n, j, i))
        again = False
        for n, j, i in sorted(found):
            n = -n
            if free_d[i:i + n].all() and free_i[j:j + n].all():
                free_d[i:i + n] = free_i[j:j + n] = False
                tiles.append((i, j, n))
            else:
                again = True                     # part of it may still be free: look again at this length
        if again:
            continue
        if size == min_match:
            return tiles
        size = max(min_match, size // 2)


class Block:
    """Benchmark items as word numbers, with a seed index."""

    def __init__(self, items: list[tuple[str, str]], min_match: int):
        self.min = min_match
        self.vocab: dict[str, int] = {}
        self.names, self.words = [], []
        for name, text in items:
            w = words_of(text)
            if len(w) < min_match:
                continue
            self.names.append(name)
            self.words.append(np.array([self.vocab.setdefault(x, len(self.vocab)) for x in w], np.int64))
        self.weights = _powers(min_match)[:min_match]
        seeds = [self.seeds(w) for w in self.words]
        flat = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        place = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else owner
        order = np.argsort(flat, kind="stable")
        self.keys, first = np.unique(flat[order], return_index=True)
        self.bounds = np.append(first, len(flat))
        self.owner, self.place = owner[order], place[order]

    def seeds(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) - self.min + 1
        with np.errstate(over="ignore"):
            u = ids.astype(np.uint64) + np.uint64(1)
            out = np.zeros(max(n, 0), np.uint64)
            for k in range(self.min):
                out += u[k:n + k] * self.weights[k]
        return out

    def search(self, text: str | None, threshold: float) -> list[dict]:
        get = self.vocab.get
        doc = np.array([get(w, -1) for w in words_of(text)], np.int64)
        if len(doc) < self.min or not len(self.keys):
            return []
        bad = np.concatenate([[0], np.cumsum(doc < 0)])
        at = np.flatnonzero(bad[self.min:] == bad[:-self.min])
        if not len(at):
            return []
        mine = np.unique(self.seeds(doc)[at])
        pos = np.minimum(np.searchsorted(self.keys, mine), len(self.keys) - 1)
        hit = pos[self.keys[pos] == mine]
        if not len(hit):
            return []
        rows = np.concatenate([np.arange(self.bounds[h], self.bounds[h + 1]) for h in hit])
        out = []
        for o in np.unique(self.owner[rows]):
            item = self.words[o]
            cover = np.zeros(len(item) + 1, np.int64)
            starts = self.place[rows[self.owner[rows] == o]]
            cover[starts] += 1
            np.add.at(cover, np.minimum(starts + self.min, len(item)), -1)
            # words in no shared seed are in no tile
            if (np.cumsum(cover)[:-1] > 0).sum() < threshold * len(item):
                continue
            tiles = greedy_tiles(doc, item, self.min)
            covered = sum(n for _, _, n in tiles)
            if covered >= threshold * len(item):
                out.append({"item_id": self.names[o], "coverage": covered / len(item), "covered": covered,
                            "words": len(item), "tiles": [{"at": i, "n": n} for i, _, n in sorted(tiles)]})
        return out


def _searcher(sent, threshold: float):
    @pandas_udf(HITS)
    def search(text: pd.Series) -> pd.Series:
        block = sent.value
        return pd.Series([block.search(t, threshold) for t in text])

    return search


def with_hits(docs: DataFrame, bench: DataFrame, column: str = "hits", min_match: int = MIN_MATCH,
              threshold: float = THRESHOLD) -> DataFrame:
    """Add ``column``: the benchmark items that a row's text contains, each
    with its coverage and tiles (word places in the document).

    ``bench(item_id, text)``.  Null and empty texts have no hits; items of
    fewer than ``min_match`` words (and null items) cannot be matched; a
    repeated item is reported once per row of the benchmark.  Rows are kept as
    they are, whatever their columns, except that a column named ``column`` is
    replaced.
    """
    spark = docs.sparkSession
    total = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-total // BLOCK_BYTES) or 1
    part = bench.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull())
    hits: Column | None = None
    for k in range(blocks):
        own = part.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else part
        # at most about BLOCK_BYTES, checked above
        sent = spark.sparkContext.broadcast(Block([(r.item_id, r.text) for r in own.orderBy("item_id", "text").collect()],
                                                  min_match))

        one = _searcher(sent, threshold)(F.col("text"))
        hits = one if hits is None else F.concat(hits, one)
    return docs.withColumn(column, hits)


def decontaminated(docs: DataFrame, bench: DataFrame, **kw) -> DataFrame:
    """The rows that no benchmark item contaminates, columns unchanged."""
    name = "__hits"
    while name in docs.columns:
        name += "_"
    return with_hits(docs, bench, name, **kw).where(F.size(name) == 0).drop(name)
