"""Top-n neighbour search by inner product (nearest or antipodal).

A query's antipodal neighbours are the rows with the largest inner product
with ``-x``, i.e. the smallest inner product with ``x``; self is not
excluded unless asked.

Both modes meet a block of queries with a block of rows and compute the
block's dot products as matrix products in an Arrow batch; a task emits
only each query's best ``n``, never the pairs.  The per-query
candidates are cut to ``n`` by a salted top-k.

* ``exact``: both tables are written once as blocks of bounded bytes, in the type
  of their numbers, and only one table if the two are the same.  A Cartesian
  product of their partitions (``block_join``) reads them where they lie: a task holds a block of queries and meets it with one
  partition of rows after another.  Work is all pairs, inherent to exact search: products in single precision, each with a
  bound of its error, rule out all but a few rows a query, and only these get their product in double precision.
  Nothing is replicated: written are the tables once and ``n`` candidates per query and task.
* ``ivf``: rows live in k-means cells, blocks of both sides are cogrouped.  A query visits the cells whose
  centroid is closest to its target (``-x`` for antipodal), then every other
  cell that can still hold a row as good as its ``n``-th best so far: a bound
  from the cell's extent along and across its centroid tells which.  The
  result is the exact one; how many cells the bound saves depends on the data.
  Only a caller who sets ``nprobe`` gets the nearest ``nprobe`` cells alone.
  A cell is split into sub-blocks of at most ``SIDE_BLOCKS * block_rows`` rows
  (and its visiting queries into sub-blocks too), so a cell holding a third of
  the data is spread over many tasks; products are ``block_rows`` queries high.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleselect.operators.select import top_k_per_group
from tripleselect.session import cut_lineage, ship_package

#: Blocks of rows on each side of a task group of the cell-probed mode.
SIDE_BLOCKS = 8
OUT_SCHEMA = "src long, dst long, dot double"
#: Bytes of a stored block, of one of which several share a task, and of a partition of the right side of a block join.
BLOCK_BYTES, SMALL_BYTES, SIDE_BYTES = 8 << 20, 2 << 20, 32 << 20
#: Blocks of the left side that share a task, when there are tasks enough.
LEFT_BLOCKS = 8
#: Products of a tile, and pairs whose product is taken again at once.
TILE, AGAIN = 1 << 20, 4096


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """A list column as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def stored_blocks(df: DataFrame, parts: int, kept: DataFrame | None = None, filled: str | None = None,
                  block_bytes: int | None = None) -> DataFrame:
    """``(name, block)``: the rows of ``df`` as Arrow streams of about
    ``block_bytes``, dealt over ``parts`` partitions and written once; ``kept``
    if that is what an earlier call wrote of them.  Rows without a ``filled``
    are left out."""
    if kept is not None:
        return kept
    block_bytes = block_bytes or BLOCK_BYTES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, size = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                              names=["name", "block"])

        for b in batches:
            b = b if filled is None else b.filter(b.column(filled).is_valid())
            step = max(1, math.ceil(b.num_rows * block_bytes / max(1, b.nbytes)))
            for i in range(0, b.num_rows, step):
                held.append(b.slice(i, step))
                size += held[-1].nbytes
                if size >= block_bytes:
                    yield block()
                    name, held, size = name + 1, [], 0
        if held:
            yield block()

    return cut_lineage(df.repartition(parts).mapInArrow(pack, "name long, block binary"))


def block_join(left: DataFrame, right: DataFrame, row_bytes: int,
               meet: Callable[[pa.RecordBatch, Iterator[pa.RecordBatch]], pa.RecordBatch | None], schema: str,
               filled: str | None = None, held: bool = False) -> DataFrame:
    """All rows of ``left`` met with all rows of ``right``, block by block.

    ``meet`` gets a block of ``left`` and, one after another, the blocks of
    some partitions of ``right``; what it returns is the output.  The tables are
    stored once each, once for both if they are one DataFrame, and joined by a
    Cartesian product of their partitions, so neither is shuffled again,
    collected or broadcast.  A task takes several partitions of ``right`` when
    there are tasks enough; a block of ``left`` is sent to Python once for each.
    ``row_bytes`` is about what a row takes.  Rows without a ``filled`` meet
    none.  Blocks have ``SMALL_BYTES`` and some share a partition of ``left``;
    with ``held`` they have ``BLOCK_BYTES`` and one each."""
    spark = left.sparkSession
    ship_package(spark)
    block_bytes = BLOCK_BYTES if held else min(SMALL_BYTES, BLOCK_BYTES)
    same = right is left
    nl = left.count()
    nr = nl if same else right.count()
    rp = max(1, math.ceil(nr * row_bytes / SIDE_BYTES))
    # a little more than there are, so that a partition of the left side is one block
    blocks = max(1, math.ceil((1.1 if held else 1) * nl * row_bytes / block_bytes))
    wide = 4 * spark.sparkContext.defaultParallelism        # tasks that keep all cores busy
    lp = max(blocks if held else math.ceil(blocks / LEFT_BLOCKS), min(max(blocks, min(nl, wide)), math.ceil(wide / rp)))
    lp = max(1, lp)
    # one table for both sides is dealt for the side of more partitions; the other takes several of them at once
    a = stored_blocks(left, max(lp, rp) if same else lp, None, filled, block_bytes)
    b = stored_blocks(right, rp, a if same else None, filled, block_bytes)
    if same:
        a, b = a.coalesce(lp), b.coalesce(rp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(block) -> pa.RecordBatch:
            table = pa.ipc.open_stream(block.as_buffer()).read_all()
            return table.combine_chunks().to_batches()[0]

        pairs = ((x[0][i].as_py(), x[1][i], x[2][i]) for x in (t.columns for t in batches) for i in range(len(x[0])))
        for _, same in groupby(pairs, key=lambda p: p[0]):
            first = next(same)
            out = meet(read(first[1]), (read(p[2]) for p in chain([first], same)))
            if out is not None and out.num_rows:
                yield out

    # a block of the left side goes with the first block of each partition that it meets, not with all
    b = b.select(F.col("block").alias("r"), (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0).alias("first"))
    met = a.select("name", F.col("block").alias("l")).hint("shuffle_replicate_nl").crossJoin(b)
    met = met.select("name", F.when(F.col("first"), F.col("l")).alias("l"), "r")
    if held:
        met = met.coalesce(max(lp, min(lp * rp, wide)))
    return met.mapInArrow(run, schema)


def finite(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of finite numbers; others have no product."""
    ok = np.isfinite(x).all(axis=1)
    return (ids, x) if ok.all() else (ids[ok], x[ok])


def in_single(x: np.ndarray, queries: bool) -> tuple[np.ndarray, float]:
    """Rows in single precision, over their largest norm, and that norm.  One
    more column makes a query's product with a row no less than the true one,
    and greater by at most twice what the columns make up."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    scale = float(norm.max(initial=0.0)) or 1.0
    out = np.empty((len(x), x.shape[1] + 1), np.float32)
    np.divide(x, scale, out=out[:, :-1], casting="same_kind")
    out[:, -1] = norm / scale * (error_of(x.shape[1]) if queries else 1.0)
    return out, scale


def error_of(dims: int) -> float:
    """Of a product in single precision, in the product of the two norms."""
    return 1.5 * (dims + 8) * 2.0 ** -24


def products(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows ``i`` of ``x`` with rows ``j`` of ``y`` in double precision."""
    out = np.empty(len(i))
    for k in range(0, len(i), AGAIN):
        out[k:k + AGAIN] = np.einsum("ij,ij->i", x[i[k:k + AGAIN]].astype(np.float64), y[j[k:k + AGAIN]].astype(np.float64))
    return out


class Best:
    """The ``n`` rows of largest product of each query ``x``, met block after block."""

    def __init__(self, src: np.ndarray, x: np.ndarray, n: int, exclude_self: bool, block_rows: int):
        self.src, self.x, self.n, self.exclude_self, self.block_rows = src, x, n, exclude_self, block_rows
        self.single, self.scale = in_single(x, True)
        self.key = np.full((len(src), n), -np.inf)
        self.dst = np.full((len(src), n), np.iinfo(np.int64).max)
        self.dot = np.zeros((len(src), n))
        self.floor = np.full(len(src), -np.inf)             # the n-th best product is no less
        self.held, self.count = [], 0

    def meet(self, dst: np.ndarray, y: np.ndarray) -> None:
        """All queries with rows ``y``, in tiles."""
        single, scale = in_single(y, False)
        wide = max(1, TILE // self.block_rows)
        for c in range(0, len(dst), wide):
            for r in range(0, len(self.src), self.block_rows):
                self.tile(r, single[c:c + wide], scale * self.scale, dst[c:c + wide], y[c:c + wide])
                if self.count > 2 * self.key.size:
                    self.settle()

    def tile(self, at: int, single: np.ndarray, scale: float, dst: np.ndarray, y: np.ndarray) -> None:
        q = self.single[at:at + self.block_rows]
        up = q @ single.T
        floor = self.floor[at:at + len(q)]
        if len(dst) > self.n and np.isneginf(floor).any():
            low = up - 2 * q[:, -1:] * single[:, -1]
            if self.exclude_self:
                low[self.src[at:at + len(q), None] == dst[None, :]] = -np.inf
            low = np.partition(low, -self.n, axis=1)[:, -self.n].astype(np.float64)
            floor = np.maximum(floor, scale * (low - 1e-6 * np.abs(low) - 1e-30))
            self.floor[at:at + len(q)] = floor
        # a little below, for rounding
        least = (floor - 2e-9) / scale
        least = np.where(np.isfinite(least), least - 1e-6 * np.abs(least) - 1e-30, -np.inf).astype(np.float32)
        hit = np.flatnonzero(up >= least[:, None])
        if not len(hit):
            return
        i, j = at + hit // len(dst), hit % len(dst)
        if len(hit) > up.size // 16:                        # many equal rows: the whole tile costs less
            dot = (self.x[at:at + len(q)].astype(np.float64) @ y.astype(np.float64).T).ravel()[hit]
        else:
            dot = products(self.x, y, i, j)
        key, to = np.round(dot, 9), dst[j]
        ok = np.isfinite(key) & ((key > self.key[i, -1]) | ((key == self.key[i, -1]) & (to < self.dst[i, -1])))
        if self.exclude_self:
            ok &= self.src[i] != to
        if ok.any():
            self.held.append((i[ok], to[ok], dot[ok], key[ok]))
            self.count += len(self.held[-1][0])

    def settle(self) -> None:
        """The best of what is held.  Order: rounded product, then ``dst``."""
        if not self.count:
            return
        i, to, dot, key = (np.concatenate(v) for v in zip(*self.held))
        self.held, self.count = [], 0
        rows = np.unique(i)
        who = np.concatenate([np.repeat(rows, self.n), i])
        key = np.concatenate([self.key[rows].ravel(), key])
        to = np.concatenate([self.dst[rows].ravel(), to])
        dot = np.concatenate([self.dot[rows].ravel(), dot])
        order = np.lexsort((to, -key, who))
        begin = np.searchsorted(who[order], rows)
        pick = order[begin[:, None] + np.arange(self.n)]
        self.key[rows], self.dst[rows], self.dot[rows] = key[pick], to[pick], dot[pick]
        self.floor = np.maximum(self.floor, self.key[:, -1])


def _local_topn(n: int, largest: bool, exclude_self: bool):
    def fn(qpdf: pd.DataFrame, dpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(dpdf) == 0:
            return pd.DataFrame({"src": pd.Series([], dtype="int64"), "dst": pd.Series([], dtype="int64"),
                                 "dot": pd.Series([], dtype="float64")})
        qv = np.stack([np.asarray(v, dtype=np.float64) for v in qpdf["qv"]])
        dv = np.stack([np.asarray(v, dtype=np.float64) for v in dpdf["dv"]])
        src = qpdf["src"].to_numpy(dtype=np.int64)
        dst = dpdf["dst"].to_numpy(dtype=np.int64)
        s = qv @ dv.T
        key = np.round(s, 9) if largest else -np.round(s, 9)
        if exclude_self:
            key = np.where(src[:, None] == dst[None, :], -np.inf, key)
        m = min(n, s.shape[1])
        out_s, out_d, out_v = [], [], []
        for i in range(s.shape[0]):
            row = key[i]
            if m < len(row):
                cand = np.argpartition(-row, m - 1)[:m]
                thr = row[cand].min()
                cand = np.nonzero(row >= thr)[0]          # keep every tie at the cut
            else:
                cand = np.arange(len(row))
            cand = cand[np.isfinite(row[cand])]
            order = np.lexsort((dst[cand], -row[cand]))[:m]
            c = cand[order]
            out_s.append(np.full(len(c), src[i]))
            out_d.append(dst[c])
            out_v.append(s[i, c])
        return pd.DataFrame({"src": np.concatenate(out_s), "dst": np.concatenate(out_d),
                             "dot": np.concatenate(out_v)})
    return fn


def _finish(cands: DataFrame, n: int, largest: bool, salts: int | None = None) -> DataFrame:
    order = F.round("dot", 9).desc() if largest else F.round("dot", 9).asc()
    return top_k_per_group(cands, ["src"], [order], n, "dst", rank_col="rank", salts=salts)


def exact_neighbors(queries: DataFrame, vectors: DataFrame, n: int, largest: bool = True,
                    exclude_self: bool = False, id_col: str = "triple_id", vec_col: str = "vec",
                    block_rows: int = 2048) -> DataFrame:
    """(src, dst, dot, rank): the ``n`` rows of largest (``largest``) or
    smallest inner product with each query, ties by dst.  ``block_rows`` is the
    height of a matrix product.  Rows without a vector have no product."""
    def narrow(df: DataFrame) -> DataFrame:
        kind = "array<float>" if dict(df.dtypes)[vec_col] == "array<float>" else "array<double>"
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("vec"))

    d = narrow(vectors)
    q = d if queries is vectors else narrow(queries)
    dims = max(1, d.agg(F.max(F.size("vec"))).first()[0] or 1)
    width = 4 if {dict(t.dtypes)["vec"] for t in (q, d)} == {"array<float>"} else 8
    kind = np.float32 if width == 4 else np.float64

    def meet(left: pa.RecordBatch, rights: Iterator[pa.RecordBatch]) -> pa.RecordBatch:
        src, x = finite(left.column("id").to_numpy(), matrix(left.column("vec"), kind))
        best = Best(src, x if largest else -x, n, exclude_self, block_rows)
        for right in rights:
            dst, y = finite(right.column("id").to_numpy(), matrix(right.column("vec"), kind))
            if len(src) and len(dst):
                best.meet(dst, y)
        best.settle()
        i, j = np.nonzero(np.isfinite(best.key))
        return pa.RecordBatch.from_arrays([pa.array(src[i]), pa.array(best.dst[i, j]), pa.array(best.dot[i, j] if largest else -best.dot[i, j])],
                                          names=["src", "dst", "dot"])

    # a query has n candidates for each task that it is in, so no group is large
    return _finish(block_join(q, d, width * dims + 16, meet, OUT_SCHEMA, "vec", held=True), n, largest, salts=1)


def antipodal_neighbors(queries: DataFrame, vectors: DataFrame, n: int, mode: str = "exact",
                        cells: DataFrame | None = None, centroids: DataFrame | None = None,
                        nprobe: int | None = None, exclude_self: bool = False,
                        id_col: str = "triple_id", vec_col: str = "vec", block_rows: int = 2048) -> DataFrame:
    """(src, dst, dot, rank): the ``n`` most dissimilar rows of each query
    (smallest inner product = largest inner product with ``-x``)."""
    if mode == "exact":
        return exact_neighbors(queries, vectors, n, largest=False, exclude_self=exclude_self,
                               id_col=id_col, vec_col=vec_col, block_rows=block_rows)
    if cells is None or centroids is None:
        raise ValueError("mode='ivf' needs cells (id, cell) and centroids (cell, vec)")
    return ivf_neighbors(queries, vectors, cells, centroids, n, nprobe, largest=False,
                         exclude_self=exclude_self, id_col=id_col, vec_col=vec_col, block_rows=block_rows)


def probe_cells(queries: DataFrame, centroids: DataFrame, nprobe: int, antipodal: bool,
                id_col: str = "triple_id", vec_col: str = "vec") -> DataFrame:
    """(src, cell): the ``nprobe`` cells whose centroid has the largest inner
    product with the query target (``-x`` when antipodal)."""
    from tripleselect.operators.cluster import centroid_matrix
    spark = queries.sparkSession
    cells, mat = centroid_matrix(centroids, "cell", "vec")
    b = spark.sparkContext.broadcast((cells, mat))
    sign = -1.0 if antipodal else 1.0

    def run(it):
        cs, m = b.value
        p = min(nprobe, len(cs))
        for pdf in it:
            if len(pdf) == 0:
                continue
            x = sign * np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vec_col]])
            s = x @ m.T
            top = np.argsort(-s, axis=1, kind="stable")[:, :p]
            yield pd.DataFrame({"src": np.repeat(pdf[id_col].to_numpy(dtype=np.int64), p),
                                "cell": cs[top].ravel().astype(np.int32)})

    return queries.select(id_col, vec_col).mapInPandas(run, "src long, cell int")


def cell_extents(rows: DataFrame, centroids: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every cell with rows (``rows``: dst, dv, cell): id, unit centroid
    ``u``, and (least, largest) ``y . u`` and largest ``|y - (y . u) u|`` over
    its rows ``y``.  K rows reach the driver."""
    from tripleselect.operators.cluster import centroid_matrix
    cs, mat = centroid_matrix(centroids, "cell", "vec")
    norm = np.linalg.norm(mat, axis=1, keepdims=True)
    unit = np.divide(mat, norm, out=np.zeros_like(mat), where=norm > 0)
    b = rows.sparkSession.sparkContext.broadcast((cs, unit))

    def run(it):
        ids, u = b.value
        for pdf in it:
            if len(pdf) == 0:
                continue
            y = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["dv"]])
            c = u[np.searchsorted(ids, pdf["cell"].to_numpy(dtype=np.int64))]
            a = (y * c).sum(axis=1)
            out = pd.DataFrame({"cell": pdf["cell"], "lo": a, "hi": a, "off": np.linalg.norm(y - a[:, None] * c, axis=1)})
            yield out.groupby("cell", as_index=False).agg({"lo": "min", "hi": "max", "off": "max"})

    ext = (rows.select("cell", "dv").mapInPandas(run, "cell int, lo double, hi double, off double")
               .groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("off").alias("off"))
               .orderBy("cell").toPandas())
    own = ext["cell"].to_numpy(dtype=np.int64)
    return own, unit[np.searchsorted(cs, own)], ext[["lo", "hi", "off"]].to_numpy(dtype=np.float64)


def cells_left(queries: DataFrame, found: DataFrame, first: DataFrame, rows: DataFrame, centroids: DataFrame,
               n: int, antipodal: bool, id_col: str = "triple_id", vec_col: str = "vec") -> DataFrame:
    """(src, cell): the cells not in ``first`` (src, cell) that may hold a row
    at least as good as the query's ``n``-th best in ``found``; every such
    cell for a query that has fewer than ``n``."""
    sign = -1.0 if antipodal else 1.0
    b = queries.sparkSession.sparkContext.broadcast(cell_extents(rows, centroids))
    worst = found.groupBy("src").agg(F.min(F.lit(sign) * F.col("dot")).alias("worst"), F.count(F.lit(1)).alias("have"))
    worst = worst.where(F.col("have") >= n).select("src", "worst")
    seen = first.groupBy("src").agg(F.collect_list("cell").alias("seen"))
    q = (queries.select(F.col(id_col).alias("src"), F.col(vec_col).alias("qv"))
                .join(seen, "src", "left").join(worst, "src", "left"))

    def run(it):
        ids, u, ext = b.value
        for pdf in it:
            if len(pdf) == 0 or len(ids) == 0:
                continue
            t = sign * np.stack([np.asarray(v, dtype=np.float64) for v in pdf["qv"]])
            along = t @ u.T
            across = np.sqrt(np.maximum((t * t).sum(axis=1)[:, None] - along ** 2, 0.0))
            bound = np.maximum(along * ext[:, 0], along * ext[:, 1]) + across * ext[:, 2]
            thr = pdf["worst"].to_numpy(dtype=np.float64)
            thr = np.where(np.isnan(thr), -np.inf, thr)
            # a little below, for rounding and for ties
            go = bound >= (thr - 1e-6 * np.maximum(1.0, np.abs(np.where(np.isfinite(thr), thr, 0.0))))[:, None]
            for i, s in enumerate(pdf["seen"]):
                if s is not None:
                    go[i] &= ~np.isin(ids, np.asarray(s, dtype=np.int64))
            at, cell = np.nonzero(go)
            yield pd.DataFrame({"src": pdf["src"].to_numpy(dtype=np.int64)[at], "cell": ids[cell].astype(np.int32)})

    return q.mapInPandas(run, "src long, cell int")


def _probed(probes: DataFrame, queries: DataFrame, rows: DataFrame, n: int, largest: bool, exclude_self: bool,
            id_col: str, vec_col: str, block_rows: int) -> DataFrame:
    """Each query's best ``n`` of every sub-block of the cells it visits."""
    side = SIDE_BLOCKS * block_rows
    # sub-block counts per cell from two K-row aggregates (rows and visiting queries per cell)
    dcount = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("nd"))
    qcount = probes.groupBy("cell").agg(F.count(F.lit(1)).alias("nq"))
    blocks = (dcount.join(qcount, "cell")
                    .select("cell", F.greatest(F.lit(1), F.ceil(F.col("nd") / side)).cast("int").alias("ds"),
                            F.greatest(F.lit(1), F.ceil(F.col("nq") / side)).cast("int").alias("qs")))
    q = (probes.join(queries.select(F.col(id_col).alias("src"), F.col(vec_col).alias("qv")), "src")
               .join(blocks, "cell")
               .withColumn("qsub", F.pmod(F.xxhash64("src"), F.col("qs")).cast("int"))
               .withColumn("dsub", F.explode(F.sequence(F.lit(0), F.col("ds") - 1)))
               .drop("qs", "ds"))
    d = (rows.join(blocks, "cell")
             .withColumn("dsub", F.pmod(F.xxhash64("dst"), F.col("ds")).cast("int"))
             .withColumn("qsub", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
             .drop("qs", "ds"))
    # cogroup does not coerce key types: every key is an int on both sides
    keys = ["cell", "qsub", "dsub"]
    local = _local_topn(n, largest, exclude_self)

    def by_block(qpdf: pd.DataFrame, dpdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([local(qpdf.iloc[i:i + block_rows], dpdf) for i in range(0, max(1, len(qpdf)), block_rows)])

    return q.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInPandas(by_block, OUT_SCHEMA)


def ivf_neighbors(queries: DataFrame, vectors: DataFrame, cells: DataFrame, centroids: DataFrame, n: int,
                  nprobe: int | None = None, largest: bool = True, exclude_self: bool = False,
                  id_col: str = "triple_id", vec_col: str = "vec", block_rows: int = 2048) -> DataFrame:
    """Cell-probed top-n.  ``cells`` = (id, cell) for every row of
    ``vectors``; ``centroids`` = (cell, vec).  Without ``nprobe`` the nearest
    ``k // 10`` cells (at least 1) give a first top-n, and every other cell
    that its bound does not rule out is visited too, so the result is that of
    ``exact_neighbors``; with it, only the nearest ``nprobe`` cells are."""
    k = centroids.count()
    first = probe_cells(queries, centroids, nprobe or max(1, k // 10), antipodal=not largest, id_col=id_col, vec_col=vec_col)
    rows = vectors.select(F.col(id_col).alias("dst"), F.col(vec_col).alias("dv")).join(
        cells.select(F.col(id_col).alias("dst"), "cell"), "dst")
    args = (queries, rows, n, largest, exclude_self, id_col, vec_col, block_rows)
    if nprobe:
        return _finish(_probed(first, *args), n, largest)
    found = cut_lineage(_finish(_probed(first, *args), n, largest))
    left = cut_lineage(cells_left(queries, found, first, rows, centroids, n, not largest, id_col, vec_col))
    return _finish(found.select("src", "dst", "dot").unionByName(_probed(left, *args)), n, largest)


def build_cells(vectors: DataFrame, k: int, max_iter: int = 20, seed: int = 0,
                id_col: str = "triple_id", vec_col: str = "vec") -> tuple[DataFrame, DataFrame]:
    """Index build: spherical k-means centroids and each row's cell.  There
    are ``k`` cells, or one per row if there are fewer rows."""
    from tripleselect.operators.cluster import assign_clusters, spherical_kmeans
    nrows = vectors.count()
    k = max(1, min(k, nrows))
    cents = spherical_kmeans(vectors, k, max_iter, seed, vec_col)
    cells = assign_clusters(vectors, cents, id_col, vec_col).select(id_col, F.col("cluster_id").alias("cell"))
    return cents, cells
