"""The stored cell index against numpy brute force."""
import re

import numpy as np
import pytest

from tripleselect.operators import cellindex
from tripleselect.operators.cellindex import CellIndex
from tripleselect.session import shared_path


def frame(spark, x, ids=None):
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(range(len(x)) if ids is None else ids, x)]
    return spark.createDataFrame(rows, "triple_id long, vec array<double>")


def brute(q, x, n, largest):
    s = np.round(q @ x.T, 9)
    return {i: sorted(range(len(x)), key=lambda j: (-s[i, j] if largest else s[i, j], j))[:n] for i in range(len(q))}


def got(df):
    out = {}
    for r in df.orderBy("src", "rank").collect():
        out.setdefault(r.src, []).append(r.dst)
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 12)) * rng.uniform(0.2, 4.0, size=(400, 1)) + 6.0 * (np.arange(400) % 4 == 0)[:, None]
    x[40:160] = x[40]                                  # a group of copies: ties beyond every n
    return x


@pytest.mark.parametrize("largest", [True, False])
def test_search_is_exact(spark, data, monkeypatch, largest):
    monkeypatch.setattr(cellindex, "QUERY_BYTES", 4 * 12 * 70)        # several blocks of queries
    monkeypatch.setattr(cellindex, "FILE_ROWS", 50)
    df = frame(spark, data)
    path = shared_path(spark, "cells")
    built = CellIndex.build(df, 15, path, max_iter=5, seed=1)
    assert built.rows.count() == 400 and built.rows.groupBy("cell").count().agg({"count": "min"}).first()[0] >= cellindex.MIN_POINTS
    assert got(built.search(df, 4, largest=largest)) == brute(data, data, 4, largest)
    again = CellIndex.open(spark, path)                               # a later application
    some = df.where("triple_id % 50 = 7")
    want = brute(data, data, 4, largest)
    assert got(again.search(some, 4, largest=largest)) == {i: want[i] for i in range(7, 400, 50)}


def test_codes_are_within_their_error(spark, data):
    index = CellIndex.build(frame(spark, data), 6, shared_path(spark, "cells"), max_iter=3)
    place = {int(c): i for i, c in enumerate(index.cells)}
    for r in index.rows.collect():
        near = index.centers[place[r.cell]] + r.step * np.frombuffer(r.code, np.int8)
        assert np.linalg.norm(np.array(r.vec) - near) <= r.err + 1e-5


def test_probed_partitions_are_pruned(spark, data):
    index = CellIndex.build(frame(spark, data), 8, shared_path(spark, "cells"), max_iter=3)
    few = index.rows.where(index.rows["cell"].isin([int(index.cells[0])]))
    assert re.search(r"PartitionFilters: \[[^\]]*cell", few._jdf.queryExecution().toString())
    wanted = spark.createDataFrame([(0, 40, int(index.cells[0]))], "q int, id long, cell int")
    assert "dynamicpruning" in index.vectors_of(wanted)._jdf.queryExecution().toString()
    near = got(index.search(frame(spark, data), 3, nprobe=2))
    want = brute(data, data, 3, True)
    assert sum(len(set(near.get(i, [])) & set(w)) for i, w in want.items()) > 0.5 * 3 * 400


def test_recall_of_a_bounded_sample_of_the_given_vectors(spark):
    """Centroids from 200 rows: every row is indexed and every neighbour found."""
    from conftest import SF01
    from tripleselect.operators.neighbors import exact_neighbors
    from tripleselect.plans import registry as R
    tv = R.fx.triple_vectors(spark, SF01).select("triple_id", "vec")
    index = CellIndex.build(tv, 20, shared_path(spark, "cells"), max_iter=5, sample_rows=200)
    assert got(index.search(tv, 4, largest=False)) == got(exact_neighbors(tv, tv, 4, largest=False))


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "triple_id long, vec array<double>")
    index = CellIndex.build(empty, 4, shared_path(spark, "cells"))
    assert index.search(empty, 3).count() == 0
    x = np.array([[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]])
    df = frame(spark, x).union(spark.createDataFrame([(9, None), (None, [1.0, 1.0])], "triple_id long, vec array<double>"))
    index = CellIndex.build(df, 4, shared_path(spark, "cells"))
    assert got(index.search(df, 5)) == {0: [0, 1, 2], 1: [1, 0, 2], 2: [0, 1, 2]}


def test_queries_reach_the_driver_in_the_type_of_their_numbers(spark, data):
    """Single precision stays single: half the bytes, the same neighbours."""
    single = data.astype(np.float32)
    df = frame(spark, single.astype(float)).selectExpr("triple_id", "cast(vec as array<float>) vec")
    index = CellIndex.build(df, 6, shared_path(spark, "cells"), max_iter=3)
    kinds = []
    sent = cellindex._nearest

    def seen(rows, *args):
        kinds.append(dict(sent(rows, *args).dtypes)["vec"])
        return sent(rows, *args)
    cellindex._nearest, want = seen, brute(single.astype(float), single.astype(float), 4, False)
    try:
        assert got(index.search(df, 4, largest=False)) == want and kinds == ["array<float>"]
    finally:
        cellindex._nearest = sent


def test_bounds_keep_the_best_and_little_else(monkeypatch):
    """Whatever the tiles, rows that may be among the best stay; few others do."""
    monkeypatch.setattr(cellindex, "TILE_ROWS", 64)
    monkeypatch.setattr(cellindex, "TILE_QUERIES", 16)
    rng = np.random.default_rng(8)
    q, y = rng.normal(size=(50, 10)).astype(np.float32), rng.normal(size=(1000, 10)).astype(np.float32)
    room = np.full(1000, 0.01, np.float32)
    found = cellindex.Bounds(q, np.linalg.norm(q, axis=1), 3)
    for r in range(0, 1000, 250):
        found.add(np.arange(50), y[r:r + 250], room[r:r + 250], np.arange(r, r + 250), r // 250)
    src, dst, home, high, low = found.settle()
    s = q @ y.T
    for i in range(50):
        assert set(np.argsort(-s[i])[:3]) <= set(dst[src == i])
    assert len(src) < 50 * 12 and (home == dst // 250).all()
    assert (s[src, dst] <= high + 1e-4).all() and (s[src, dst] >= low - 1e-4).all()


def test_only_vectors_that_occur_again_are_ranked(spark, monkeypatch):
    ranked = []
    whole = cellindex.rank_within
    monkeypatch.setattr(cellindex, "rank_within", lambda df, *a, **kw: ranked.append(df.count()) or whole(df, *a, **kw))
    rows = [(5, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [0.0, 1.0]), (9, [-0.0, 1.0]), (1, [2.0, 2.0])]
    placed = spark.createDataFrame([(i, v, 0) for i, v in rows], "id long, vec array<double>, cell int")
    want = {5: 2, 3: 1, 4: 1, 9: 2, 1: 1}
    for most in (200_000, 0):
        monkeypatch.setattr(cellindex, "BROADCAST_HASHES", most)
        assert {r["id"]: r["copy"] for r in cellindex._numbered(placed).collect()} == want
    assert ranked == [4, 4]
    assert {r["copy"] for r in cellindex._numbered(placed.where("id in (1, 3, 4)")).collect()} == {1} and len(ranked) == 2
