"""Near-duplicate lines by a segment-partition edit join, on DataFrame and SQL
functions; the join's keys are computed on Arrow batches.

Two lines are near copies when one edit for every ``EDIT_CHARS`` characters of
the longer one, ``TAU`` at most, turns one into the other; so lines of fewer
than ``EDIT_CHARS`` characters must be equal.  Each number of edits has keys
of its own, for the longer lines (probes) that it is allowed to, and the lines
that many edits shorter; all meet in one join.

Lines within edit distance ``TAU`` are joined without comparing all pairs: an
indexed line of length ``l`` is cut into ``TAU + 1`` segments of even length;
if a probe is within ``TAU`` edits, one segment occurs in it unchanged, no
further than ``TAU`` from its place.  Probes look up only the substrings that
can be that segment (the multi-match-aware ranges: the shift before segment
``i`` is bounded by the edits spent before it and those left after it).
Segments and substrings are keyed by (edits, length, segment number, hash).  Keys
are computed where the texts are read; only the texts of candidates are shuffled.

Candidates must also agree in their counts of the ``LETTERS``: an edit changes
at most two of them by one; equally long lines meet in one order of their ids only.  What is left is verified by banded bit-parallel edit distance: the band of
``2 TAU + 1`` diagonals is one integer per text position, moved one row down
per column.  Common prefixes and suffixes are stripped first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleselect.llm.common import connected_components, cut_lineage, marked_rows

TAU = 2
#: Characters of the longer line for each edit.
EDIT_CHARS = 12
#: Lines from here on may have all edits.
MIN_CHARS = TAU * EDIT_CHARS
SPACES = " \t\n\x0b\f\r"
#: Letters counted (modulo 64) in a line's 60-bit profile.
LETTERS = "entaiorshl"
#: Bytes of lines whose keys are computed at once (one line at least).
SLICE_BYTES = 1 << 20
GOLD, M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Base of the prefix hash; odd, so that it has an inverse.
BASE = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit integers (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


#: What a byte counts in the prefix hash.
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def line_rows(docs: DataFrame) -> DataFrame:
    """One row per line with a word: ``doc_id, line_no, line`` (``\\n``-split,
    surrounding blanks removed; numbered from 0 over all lines)."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return rows.select("doc_id", "line_no", F.btrim("raw", F.lit(SPACES)).alias("line")).where(F.length("line") > 0)


def common_prefix(a: Column, b: Column, limit: Column) -> Column:
    """Characters that ``a`` and ``b`` share at their start, ``limit`` at most."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when(
        (s <= limit - n) & (F.substring(a, n + 1, s) == F.substring(b, n + 1, s)), n + s).otherwise(n))


def common_suffix(a: Column, b: Column, limit: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b), limit)


def banded_distance(a: Column, b: Column, tau: int = TAU) -> Column:
    """Edit distance of ``a`` and ``b`` if it is at most ``tau``, else some
    value above ``tau``.

    ``a`` is the pattern, ``b`` runs over the columns; bit ``k`` of the band
    at column ``j`` is row ``j - tau + k``.  The score follows the band's
    lowest diagonal until it reaches the last row, then that row.
    """
    w = 2 * tau + 1
    mask = (1 << w) - 1
    m, n = F.length(a), F.length(b)
    state = F.struct(F.lit(mask & ~((1 << tau) - 1)).alias("vp"), F.lit(0).alias("vn"),
                     F.least(m, F.lit(tau)).alias("d"))

    def column(xs: Column, ys: Column, m: Column, acc: Column, j: Column) -> Column:
        eq = sum((F.when((j - tau + k >= 1) & (j - tau + k <= m) & (F.get(xs, j - tau + k - 1) == F.get(ys, j - 1)), 1 << k)
                  .otherwise(0) for k in range(w)), F.lit(0))

        def step(x: Column) -> Column:
            vp, vn = acc["vp"], acc["vn"]
            d0 = (((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn)).bitwiseAND(F.lit(mask))

            def moved(d: Column) -> Column:
                hp = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp))).bitwiseAND(F.lit(mask))
                hn = d.bitwiseAND(vp)
                down = F.shiftright(d, 1)
                low = F.when(d.bitwiseAND(F.lit(1 << (w - 1))) == 0, 1).otherwise(0)
                bit = F.element_at(F.array(*[F.lit(1 << k) for k in range(w)]), F.greatest(m - j + tau, F.lit(0)) + 1)
                along = F.when(hp.bitwiseAND(bit) != 0, 1).when(hn.bitwiseAND(bit) != 0, -1).otherwise(0)
                return F.struct(
                    hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(F.lit(mask))).alias("vp"),
                    down.bitwiseAND(hp).alias("vn"),
                    (acc["d"] + F.when(j + tau <= m, low).otherwise(along)).alias("d"))
            return let(d0, moved)
        # at most 2 tau columns remain once the score may fall again
        return F.when(acc["d"] > 3 * tau, acc).otherwise(let(eq, step))

    run = let(F.split(a, ""), lambda xs: let(F.split(b, ""), lambda ys: F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), state, lambda acc, j: column(xs, ys, m, acc, j))))["d"]
    return (F.when(F.abs(m - n) > tau, F.lit(tau + 1)).when((m == 0) | (n == 0), F.greatest(m, n)).otherwise(run))


def segment(length: np.ndarray, i: int, tau: int = TAU) -> tuple[np.ndarray, np.ndarray]:
    """Start (from 0) and length of segment ``i`` of lines of ``length``: the
    last segments are one longer if it does not divide evenly."""
    k = tau + 1
    short, longer = length // k, length % k
    return short * i + np.maximum(0, longer - (k - i)), short + (longer >= k - i)


def probe_places(tau: int) -> list[tuple[int, int, int]]:
    """Per ``(gap, i, shift)``: a probe's substring ``shift`` characters on from
    where a line ``gap`` shorter has its segment ``i`` may be that segment."""
    # 1-based segment i + 1 of a line `gap` shorter: shift bounded from the left by i edits, from the right by tau - i
    return [(gap, i, shift) for gap in range(tau + 1) for i in range(tau + 1)
            for shift in range(max(-i, gap - (tau - i)), min(i, gap + (tau - i)) + 1)]


class LineTexts:
    """Lines' UTF-8 bytes with a prefix hash (a polynomial modulo 2^64), so
    that any substring's hash takes two look-ups."""

    _power = _inverse = np.ones(1, np.uint64)

    def __init__(self, lines: pa.Array):
        lines = lines.cast(pa.large_string())
        ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset:lines.offset + len(lines) + 1]
        self.data = np.frombuffer(lines.buffers()[2], np.uint8)[ends[0]:ends[-1]]
        self.ends = ends - ends[0]
        # places of characters among the bytes, and the end
        self.chars = np.append(np.flatnonzero((self.data & 0xC0) != 0x80), len(self.data))
        at = np.searchsorted(self.chars, self.ends)
        self.first, self.length = at[:-1], np.diff(at)
        if len(self._power) <= len(self.data):
            n = max(len(self.data), SLICE_BYTES) + 1
            for name, base in (("_power", BASE), ("_inverse", pow(BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(LineTexts, name, np.cumprod(steps, dtype=np.uint64))
        self.prefix = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(BYTE_CODES[self.data] * self._power[:len(self.data)], out=self.prefix[1:])

    def key(self, rows: np.ndarray, tau: int, short: np.ndarray, i: int, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Keys of ``n`` characters from ``at`` of each line, as segment ``i`` of a line of ``short``."""
        lo = self.first[rows] + at
        lo, hi = self.chars[lo], self.chars[lo + n]
        h = (self.prefix[hi] - self.prefix[lo]) * self._inverse[lo]
        place = (short.astype(np.uint64) * np.uint64(16) + np.uint64(tau)) * np.uint64(16) + np.uint64(i)
        return mix(h ^ mix(place + GOLD))

    def index(self, tau: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the segments of every line, cut for each number of edits of
        the probes that can reach it, and how many keys each line has."""
        keys, has = [], []
        for t in range(1, tau + 1):
            reached = (self.length >= (EDIT_CHARS - 1) * t) & ((t == tau) | (self.length < EDIT_CHARS * (t + 1)))
            rows = np.flatnonzero(reached)
            for i in range(t + 1):
                at, n = segment(self.length[rows], i, t)
                keys.append((rows, self.key(rows, t, self.length[rows], i, at, n)))
        return self.listed(keys)

    def probes(self, tau: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of every substring that may be a segment of an indexed line that
        is equally long or up to the allowed edits shorter, and how many each line has."""
        keys, allowed = [], np.minimum(self.length // EDIT_CHARS, tau)
        for t in range(1, tau + 1):
            mine = np.flatnonzero(allowed == t)
            for gap, i, shift in probe_places(t):
                short = self.length[mine] - gap
                at, n = segment(short, i, t)
                at = at + shift
                inside = (at >= 0) & (at + n <= self.length[mine])
                rows = mine[inside]
                keys.append((rows, self.key(rows, t, short[inside], i, at[inside], n[inside])))
        return self.listed(keys)

    def listed(self, keys: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        rows, flat = (np.concatenate([k[c] for k in keys]) for c in (0, 1))
        return flat[np.argsort(rows, kind="stable")].view(np.int64), np.bincount(rows, minlength=len(self.length))

    def profile(self) -> np.ndarray:
        """Counts of the letters, modulo 64, and the length, modulo 8, packed into one integer."""
        codes = [ord(c) for c in LETTERS]
        out = (self.length & 7).astype(np.int64) << 60
        for half in (0, 5):                                       # five letters at once, 12 bits each
            count = np.zeros(256, np.int64)
            for k, c in enumerate(codes[half:half + 5]):
                count[c] = 1 << (12 * k)
            sums = np.add.reduceat(count[self.data], self.ends[:-1]) if len(self.length) else out
            for k in range(len(codes[half:half + 5])):
                out |= ((sums >> (12 * k)) & 63) << (6 * (half + k))
        for r in np.flatnonzero(np.diff(self.ends) >= 1 << 12):    # their counts may not fit
            n = np.bincount(self.data[self.ends[r]:self.ends[r + 1]], minlength=256)[codes] & 63
            out[r] = ((self.length[r] & 7) << 60) + (n << (6 * np.arange(len(codes)))).sum()
        return out


def profiles_agree(a: Column, b: Column, tau: int = TAU) -> Column:
    """False only for lines that are more than ``tau`` edits apart."""
    gaps = []
    for k in range(len(LETTERS)):
        x, y = (F.shiftrightunsigned(c, 6 * k).bitwiseAND(F.lit(63).cast("long")) for c in (a, b))
        gap = F.abs(x - y)
        gaps.append(F.least(gap, F.lit(64) - gap))
    return sum(gaps[1:], gaps[0]) <= 2 * tau


def allowed_edits(longer: Column, tau: int = TAU) -> Column:
    """Edits within which a line is a near copy of one of ``longer`` characters."""
    return F.least(F.floor(longer / EDIT_CHARS), F.lit(tau))


def distinct_lines(lines: DataFrame, tau: int = TAU) -> DataFrame:
    """``id, profile, index, probes`` for every different line (``lines``: ``id,
    line, len``, an id any number of times): what the join needs, computed
    where the texts are read, so no text is shuffled.

    A probe of ``t`` allowed edits meets lines indexed for ``t``: only lines
    that such a probe can reach have those keys."""
    kinds = pa.schema([("id", pa.int64()), ("profile", pa.int64()), ("index", pa.list_(pa.int64())), ("probes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat))

        for b in batches:
            size = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            group = (np.cumsum(size) - size) // SLICE_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    part = b.slice(lo, hi - lo)
                    texts = LineTexts(part.column(1))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts.profile()), lists(*texts.index(tau)),
                                                      lists(*texts.probes(tau))], schema=kinds)

    keyed = lines.where(F.length("line") > 0).select("id", "line").mapInArrow(
        run, "id long, profile long, index array<bigint>, probes array<bigint>")
    return keyed.groupBy("id").agg(F.first(F.struct("profile", "index", "probes")).alias("one")).select("id", "one.*")


def marked_lines(lines: DataFrame, need: DataFrame) -> DataFrame:
    """``id, line`` of the lines in ``need(id)``, each once; few others are shuffled."""
    some = marked_rows(lines.select("id", "line"), F.col("id"), need, F.col("id"))
    return some.groupBy("id").agg(F.first("line").alias("line")).join(need, "id", "left_semi")


def edit_links(lines: DataFrame, tau: int = TAU) -> DataFrame:
    """Pairs ``(a, b)`` of lines of at least ``MIN_CHARS`` characters within
    ``tau`` edits, with ``distance``."""
    return near_links(lines.where(F.col("len") >= MIN_CHARS), tau)


def met_lines(keyed: DataFrame, tau: int = TAU) -> DataFrame:
    """Rows ``a, b`` of lines (``distinct_lines``) that share a key and may be near copies."""
    # one exchange of the different lines feeds both sides
    idx = keyed.select(F.explode("index").alias("key"), F.col("id").alias("a"), F.col("profile").alias("pa"))
    prb = keyed.select(F.explode("probes").alias("k"), F.col("id").alias("b"), F.col("profile").alias("pb"))
    # equally long lines are both indexed and probes: they meet once, not once in either role
    once = F.when(F.shiftright("pa", 60) == F.shiftright("pb", 60), F.col("a") < F.col("b")).otherwise(True)
    met = idx.join(prb, (F.col("key") == F.col("k")) & once & profiles_agree(F.col("pa"), F.col("pb"), tau))
    return met.select("a", "b")


def near_links(lines: DataFrame, tau: int = TAU) -> DataFrame:
    """Pairs ``(a, b)`` of different lines (``lines``: ``id, line, len``, an id
    any number of times) that are near copies (``allowed_edits``, ``tau`` at most), with ``distance``."""
    long = lines.where(F.col("len") >= EDIT_CHARS - 1)
    keyed = distinct_lines(long, tau)
    met = met_lines(keyed, tau)
    pairs = cut_lineage(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    need = cut_lineage(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    text = marked_lines(long, need)
    both = (pairs.join(text.select(F.col("id").alias("a"), F.col("line").alias("x")), "a")
                 .join(text.select(F.col("id").alias("b"), F.col("line").alias("y")), "b"))
    both = both.withColumn("lim", F.least(F.length("x"), F.length("y")))
    both = both.withColumn("most", allowed_edits(F.greatest(F.length("x"), F.length("y")), tau))
    both = both.withColumn("pre", common_prefix(F.col("x"), F.col("y"), F.col("lim")))
    both = both.withColumn("suf", common_suffix(F.col("x"), F.col("y"), F.col("lim") - F.col("pre")))
    mid = [F.substring(F.col(c), F.col("pre") + 1, F.length(c) - F.col("pre") - F.col("suf")) for c in ("x", "y")]
    # each step is checkpointed: a filter would be pushed through, and copy these expressions into one another
    both = cut_lineage(both.select("a", "b", "most", mid[0].alias("x"), mid[1].alias("y")))
    return cut_lineage(both.where(F.abs(F.length("x") - F.length("y")) <= F.col("most")).select(
        "a", "b", "most", banded_distance(F.col("x"), F.col("y"), tau).alias("distance"))).where(
            F.col("distance") <= F.col("most")).drop("most")


def line_classes(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """Per different line that has a near copy: ``id, class_key, n_links``
    (other lines that are near copies of it)."""
    lines = line_rows(docs).select(F.xxhash64("line").alias("id"), "line", F.length("line").alias("len"))
    links = cut_lineage(near_links(lines, tau))
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    comps = connected_components(links)
    return (ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_links")).join(comps, "node")
                .select(F.col("node").alias("id"), F.col("comp").alias("class_key"), "n_links"))


def document_lines(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """One row per line with a word: ``doc_id, line_no, line_id, class_key,
    n_links, kept``.

    ``class_key`` names the class of near copies (the least line id in it),
    ``n_links`` counts the different lines that are near copies, ``kept`` marks
    the first line of its class by doc_id, then place.  Lines of fewer than
    ``EDIT_CHARS`` characters are only ever equal.  Null and empty texts have
    no lines; repeated rows give repeated lines, all but one not kept; other
    columns are ignored.
    """
    cls = line_classes(docs, tau)
    rows = line_rows(docs).select("doc_id", "line_no", F.xxhash64("line").alias("line_id"))
    rows = cut_lineage(rows.join(cls, F.col("line_id") == F.col("id"), "left").select(
        "doc_id", "line_no", "line_id", F.coalesce("class_key", "line_id").alias("class_key"),
        F.coalesce("n_links", F.lit(0)).alias("n_links")).withColumn("__at", F.monotonically_increasing_id()))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no", "__at")
    first = rows.groupBy(F.col("class_key").alias("k")).agg(F.min(order)["__at"].alias("first"), F.count(F.lit(1)).alias("n"))
    # a line alone in its class needs no lookup
    first = first.where("n > 1").select("k", "first")
    return (rows.join(first, F.col("class_key") == F.col("k"), "left")
                .select("doc_id", "line_no", "line_id", "class_key", "n_links",
                        (F.col("first").isNull() | (F.col("first") == F.col("__at"))).alias("kept")))
