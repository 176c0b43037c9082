"""A neighbour index in cells, stored and searched where it lies.

Build: k-means centroids from a bounded sample, then every row goes to its
nearest centroid, and a row's offset from the centroid is kept as one signed
byte a dimension.  The stored rows ``(cell, id, copy, code, err, vec)`` are
partitioned by cell, a hot cell over many files; ``err`` is how far the code is
from the vector, ``copy`` numbers equal vectors by id.  Cells with fewer than
``min_points`` rows are given up and their rows go to the next centroid.

Search: queries are dealt into blocks of bounded bytes, neighbours in cell
first, and a block is broadcast; its probed cells prune the index's partitions.

1. Every task scores its rows by their codes.  The true score is within
   ``err * |query|`` of that, so a row stays only while its upper bound reaches
   the query's n-th best lower bound.  Upper bounds are one matrix product; lower ones are taken of the rows that stay.  Cells whose extent rules out a better
   row are not scored at all, nor are rows of which ``n`` equal ones come first.
2. The rows that are left get their exact score from the full vectors, which
   are read from the cells of these rows only.

Rows are scanned in place and never shuffled, tasks hand on no more than what
their bounds leave, and the result is that of a search through all rows.  Only
a caller who sets ``nprobe`` gets the nearest ``nprobe`` cells alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleselect.operators.cluster import centroid_matrix, spherical_kmeans
from tripleselect.operators.select import rank_within
from tripleselect.session import cut_lineage, ship_package
from tripleselect.sources.io import read_cells, write_cells

#: Rows that centroids are fitted on (least hash first), bytes of a block of queries, rows of a stored file.
SAMPLE_ROWS, QUERY_BYTES, FILE_ROWS = 100_000, 32 << 20, 100_000
MIN_POINTS = 5
#: Queries and rows of a tile of bounds, and hashes of copies that may be broadcast.
TILE_QUERIES, TILE_ROWS, BROADCAST_HASHES = 512, 2048, 200_000
#: Bounds are computed in 32 bits.
SLACK = 1e-4


def matrix(column: pa.Array, dtype=np.float32) -> np.ndarray:
    """A list column as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _nearest(rows: DataFrame, mat: np.ndarray, cells: np.ndarray, sign: float = 1.0) -> DataFrame:
    """``(id, vec, cell)``: the cell of the largest cosine with ``sign * vec``."""
    unit = mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-30)
    sent = rows.sparkSession.sparkContext.broadcast((unit.astype(np.float32), cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, name = sent.value
        for b in batches:
            if b.num_rows:
                best = (sign * matrix(b.column("vec")) @ u.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(name[best].astype(np.int32))],
                                                 names=["id", "vec", "cell"])

    return rows.select("id", "vec").mapInArrow(run, f"id long, vec {dict(rows.dtypes)['vec']}, cell int")


def _numbered(placed: DataFrame) -> DataFrame:
    """``placed`` with ``copy``: 1, 2, ... among equal vectors, by id.  Only
    vectors whose hash occurs again are compared and ranked."""
    h = F.xxhash64("vec")
    again = cut_lineage(placed.select(h.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    n = again.count()
    if not n:
        return placed.withColumn("copy", F.lit(1))
    known = F.broadcast(again) if n <= BROADCAST_HASHES else again
    named = placed.withColumn("h", h)
    ranked = rank_within(named.join(known, "h", "left_semi").drop("h"), ["vec"], ["id"], "copy")
    return ranked.unionByName(named.join(known, "h", "left_anti").drop("h").withColumn("copy", F.lit(1)))


class Bounds:
    """Rows whose upper bound reaches a query's n-th best lower bound, among those met so far."""

    def __init__(self, q: np.ndarray, size: np.ndarray, n: int):
        self.q, self.size, self.n = np.concatenate([q, size[:, None]], axis=1), size, n
        self.floor = np.full(len(q), -np.inf, np.float32)           # n rows have a lower bound of no less
        self.held, self.count = [], 0

    def add(self, ask: np.ndarray, y: np.ndarray, room: np.ndarray, name: np.ndarray, cell: int) -> None:
        """Queries ``ask`` with rows ``y`` of a cell, each known up to ``room``."""
        for r in range(0, len(name), TILE_ROWS):
            part = np.concatenate([y[r:r + TILE_ROWS], room[r:r + TILE_ROWS, None]], axis=1)
            for a in range(0, len(ask), TILE_QUERIES):
                who = ask[a:a + TILE_QUERIES]
                up = self.q[who] @ part.T
                if len(part) >= self.n and np.isneginf(self.floor[who]).any():
                    low = up - 2 * self.size[who, None] * part[:, -1]
                    self.floor[who] = np.maximum(self.floor[who], np.partition(low, -self.n, axis=1)[:, -self.n])
                hit = np.flatnonzero(up >= self.floor[who][:, None])
                i, j = who[hit // len(part)], hit % len(part)
                high = up.ravel()[hit]
                self.held.append((i, name[r + j], np.full(len(i), cell, np.int32), high, high - 2 * self.size[i] * part[j, -1]))
                self.count += len(i)
                if self.count > 4 * self.n * len(self.q) + 1_000_000:
                    self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        """``(query, row, cell, high, low)`` that are left; what newer rows have ruled out goes."""
        if self.held:
            src, dst, home, high, low = (np.concatenate(v) for v in zip(*self.held))
            order = np.lexsort((-low, src))
            rank = np.arange(len(order)) - np.searchsorted(src[order], src[order])
            nth = order[rank == self.n - 1]
            self.floor[src[nth]] = np.maximum(self.floor[src[nth]], low[nth])
            ok = high >= self.floor[src]
            self.held = [tuple(v[ok] for v in (src, dst, home, high, low))]
            self.count = int(ok.sum())
        return self.held[0] if self.held else ()


@dataclass
class CellIndex:
    """A stored index: its rows and, by cell, the centers and extents."""
    rows: DataFrame
    cells: np.ndarray
    centers: np.ndarray
    extent: np.ndarray          # along the unit centroid: least, largest; largest across it

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CellIndex:
        rows, cents = read_cells(spark, path)
        cells, mat = centroid_matrix(cents, "cell", "vec")
        more = cents.select("cell", "lo", "hi", "off").orderBy("cell").toPandas()
        return cls(rows, cells, mat, more[["lo", "hi", "off"]].to_numpy(float))

    @classmethod
    def build(cls, vectors: DataFrame, k: int, path: str, max_iter: int = 20, seed: int = 0, min_points: int = MIN_POINTS,
              sample_rows: int = SAMPLE_ROWS, id_col: str = "triple_id", vec_col: str = "vec") -> CellIndex:
        """Fit, code and store an index of ``vectors``; returns it as stored."""
        spark = vectors.sparkSession
        ship_package(spark)
        x = vectors.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(
            F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        n = x.count()
        sample = x.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample_rows) if n > sample_rows else x
        cells, mat = centroid_matrix(spherical_kmeans(sample, max(1, min(k, n)), max_iter, seed)) if n else (
            np.empty(0, np.int64), np.empty((0, 0)))
        while True:
            placed = _nearest(x, mat, cells) if n else x.withColumn("cell", F.lit(0))
            placed = cut_lineage(placed)
            sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
            keep = np.array([sizes.get(int(c), 0) >= min_points for c in cells], bool)
            if keep.all() or len(cells) <= 1:
                break
            if not keep.any():
                keep[int(np.argmax([sizes.get(int(c), 0) for c in cells]))] = True
            cells, mat = cells[keep], mat[keep]
        unit = mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-30) if n else mat
        # centroids are unit vectors; a cell's offsets are taken from its mean, which is as long as its rows
        along = spark.sparkContext.broadcast((cells, unit))

        def extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, u = along.value
            out = {}
            for b in batches:
                y, at = matrix(b.column("vec"), np.float64), np.searchsorted(name, b.column("cell").to_numpy())
                for c in np.unique(at):
                    z = y[at == c]
                    a = z @ u[c]
                    off = np.linalg.norm(z - a[:, None] * u[c], axis=1)
                    now = out.get(c, (np.inf, -np.inf, 0.0, 0.0, 0))
                    out[c] = (min(now[0], a.min()), max(now[1], a.max()), max(now[2], off.max()), now[3] + a.sum(), now[4] + len(a))
            if out:
                cols = list(zip(*[(int(name[c]), *map(float, v[:4]), int(v[4])) for c, v in out.items()]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32()] + [pa.float64()] * 4 + [pa.int64()])],
                                                 names=["cell", "lo", "hi", "off", "sum", "n"])

        ext = (placed.select("vec", "cell").mapInArrow(extents, "cell int, lo double, hi double, off double, sum double, n long")
               .groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("off").alias("off"),
                                    (F.sum("sum") / F.sum("n")).alias("mean")).orderBy("cell").toPandas())
        ext = {int(r.cell): r for r in ext.itertuples()}
        keep = np.array([int(c) in ext for c in cells], bool)
        cells, unit = cells[keep], unit[keep]
        centers = np.stack([unit[i] * ext[int(c)].mean for i, c in enumerate(cells)]) if len(cells) else unit
        sent = spark.sparkContext.broadcast((cells, centers))

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, c = sent.value
            for b in batches:
                if not b.num_rows:
                    continue
                at = np.searchsorted(name, b.column("cell").to_numpy())
                y = matrix(b.column("vec"), np.float64)
                # the widest offset of a row sets its own step, so codes use all of their range
                off = y - c[at]
                own = np.maximum(np.abs(off).max(axis=1), 1e-12) / 127
                q = np.rint(off / own[:, None]).astype(np.int8)
                err = np.linalg.norm(off - own[:, None] * q, axis=1) + 1e-5 * np.linalg.norm(y, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("cell"), b.column("id"), b.column("copy"), pa.array([r.tobytes() for r in q], pa.binary()),
                     pa.array(own.astype(np.float32)), pa.array(err.astype(np.float32)), b.column("vec")],
                    names=["cell", "id", "copy", "code", "step", "err", "vec"])

        copies = _numbered(placed).select("cell", "id", "copy", "vec")
        coded = copies.mapInArrow(code, "cell int, id long, copy int, code binary, step float, err float, vec array<double>")
        salts = max(1, math.ceil(max(sizes.values(), default=1) / FILE_ROWS))
        table = [(int(c), [float(v) for v in centers[i]], float(ext[int(c)].lo), float(ext[int(c)].hi),
                  float(ext[int(c)].off)) for i, c in enumerate(cells)]
        write_cells(coded, spark.createDataFrame(table, "cell int, vec array<double>, lo double, hi double, off double"),
                    path, salts)
        return cls.open(spark, path)

    # -------------------------------------------------------------- search

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """``[query, cell]``: no row of the cell has a larger inner product."""
        unit = self.centers / np.maximum(np.linalg.norm(self.centers, axis=1, keepdims=True), 1e-30)
        along = q @ unit.T
        across = np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] - along ** 2, 0.0))
        return np.maximum(along * self.extent[:, 0], along * self.extent[:, 1]) + across * self.extent[:, 2]

    def blocks(self, queries: DataFrame, sign: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(ids, targets)`` of the queries, blocks of near cells together; a target is ``sign * vec``."""
        dims = self.centers.shape[1]
        most = max(1, QUERY_BYTES // (4 * dims))
        placed = cut_lineage(_nearest(queries, self.centers, self.cells, sign))
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).orderBy("cell").collect()
        runs, held = [[]], 0
        for r in sizes:                          # small cells share a block, a large one is dealt over several
            if held + r["n"] > most and runs[-1]:
                runs.append([])
                held = 0
            runs[-1].append(r["cell"])
            held += r["n"]
        count = {r["cell"]: r["n"] for r in sizes}
        for cells in runs:
            n = sum(count[c] for c in cells)
            parts = math.ceil(n / most)
            rows = placed.where(F.col("cell").isin(cells))
            for p in range(parts):
                part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p)
                got = part.select("id", "vec").toArrow().combine_chunks()
                if got.num_rows:
                    b = got.to_batches()[0]
                    yield b.column("id").to_numpy(), sign * matrix(b.column("vec"), np.float64)

    def search(self, queries: DataFrame, n: int, largest: bool = True, nprobe: int | None = None,
               id_col: str = "triple_id", vec_col: str = "vec") -> DataFrame:
        """(src, dst, dot, rank): the ``n`` rows of largest (or smallest) inner
        product with each query, ties by id; the query itself is a row like
        any other.  Queries with a null id or vector are left out; repeated
        query ids are one query each."""
        spark = queries.sparkSession
        ship_package(spark)
        sign = 1.0 if largest else -1.0
        # queries reach the driver block by block, in the type of their numbers
        kind = "array<float>" if dict(queries.dtypes)[vec_col] == "array<float>" else "array<double>"
        q = queries.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(
            F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("vec")).dropDuplicates(["id"])
        out = None
        if len(self.cells):
            for ids, target in self.blocks(q, sign):
                found = self._block(spark, ids, target, n, sign, nprobe)
                out = found if out is None else out.unionByName(found)
        if out is None:
            return spark.createDataFrame([], "src long, dst long, dot double, rank int")
        return out

    def vectors_of(self, near: DataFrame) -> DataFrame:
        """``(q, id, vec)`` of ``near(q, id, cell)``, a few rows for each query
        of a block; their cells prune the partitions (the filter lets them)."""
        wanted = F.broadcast(near.where("cell >= 0"))
        return self.rows.select("cell", "id", "vec").join(wanted, ["cell", "id"]).select("q", "id", "vec")

    def _block(self, spark: SparkSession, ids: np.ndarray, target: np.ndarray, n: int, sign: float, nprobe: int | None) -> DataFrame:
        bound = self.bounds(target)
        if nprobe and nprobe < len(self.cells):
            unit = self.centers / np.maximum(np.linalg.norm(self.centers, axis=1, keepdims=True), 1e-30)
            near = np.argsort(-(target @ unit.T), axis=1, kind="stable")[:, :nprobe]
            asked = np.zeros(bound.shape, bool)
            np.put_along_axis(asked, near, True, axis=1)
            bound = np.where(asked, bound, -np.inf)
        sent = spark.sparkContext.broadcast((ids, target.astype(np.float32), np.linalg.norm(target, axis=1).astype(np.float32),
                                             bound.astype(np.float32), self.cells, self.centers.astype(np.float32)))

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, size, bound, cells, centers = sent.value
            found = Bounds(q, size, n)
            for b in batches:
                if not b.num_rows:
                    continue
                name, own = b.column("id").to_numpy(), b.column("cell").to_numpy()
                codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.int8).reshape(b.num_rows, -1)
                err, step = b.column("err").to_numpy(), b.column("step").to_numpy()
                for c in np.unique(own):
                    at = np.searchsorted(cells, c)
                    up = bound[:, at]
                    ask = np.flatnonzero((up > -np.inf) & (up + SLACK * (1 + size + np.abs(up)) >= found.floor))
                    rows = np.flatnonzero(own == c)
                    if len(ask):
                        y = codes[rows].astype(np.float32) * step[rows, None] + centers[at]
                        found.add(ask, y, err[rows] + np.float32(SLACK), name[rows], c)
            if left := found.settle():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(left[0].astype(np.int32)), pa.array(left[1]), pa.array(left[2]), pa.array(left[3]), pa.array(found.floor[left[0]])],
                    names=["q", "id", "cell", "high", "worst"])

        rows = self.rows.where((F.col("copy") <= n) & F.col("cell").isin([int(c) for c in self.cells[(bound > -np.inf).any(axis=0)]]))
        near = rows.select("id", "cell", "code", "step", "err").mapInArrow(first, "q int, id long, cell int, high float, worst float")
        # a task's n-th best lower bound holds for the query whatever other tasks have
        near = cut_lineage(near)
        least = near.groupBy("q").agg(F.max("worst").alias("least"))
        near = cut_lineage(near.join(least, "q").where(F.col("high") >= F.col("least")).select("q", "id", "cell"))

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = full.value
            for b in batches:
                at = b.column("q").to_numpy()
                dot = np.einsum("ij,ij->i", q[at], matrix(b.column("vec"), np.float64)) if len(at) else np.empty(0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), b.column("id"), pa.array(dot)], names=["src", "dst", "dot"])

        full = spark.sparkContext.broadcast((ids, sign * target))
        kept = self.vectors_of(near)
        from tripleselect.operators.neighbors import _finish
        return cut_lineage(_finish(kept.mapInArrow(exact, "src long, dst long, dot double"), n, sign > 0))
