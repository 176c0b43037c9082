"""Neighbour search against numpy brute force (several blocks, double vectors)."""
import numpy as np

from tripleselect.operators.neighbors import build_cells, exact_neighbors, ivf_neighbors


def _data(spark, n=300, d=16, seed=3):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d))
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "triple_id long, vec array<double>")
    return X, df


def _brute(X, n, largest, exclude_self):
    S = X @ X.T
    out = {}
    for i in range(len(X)):
        key = np.round(S[i], 9)
        order = sorted(range(len(X)), key=lambda j: (-key[j] if largest else key[j], j))
        if exclude_self:
            order = [j for j in order if j != i]
        out[i] = order[:n]
    return out


def _got(df):
    res = {}
    for r in df.orderBy("src", "rank").collect():
        res.setdefault(r.src, []).append(r.dst)
    return res


def test_exact_matches_brute_force_over_blocks(spark):
    X, df = _data(spark)
    for largest, excl in [(True, True), (False, False)]:
        got = _got(exact_neighbors(df, df, 5, largest=largest, exclude_self=excl, block_rows=64))
        assert got == _brute(X, 5, largest, excl)


def test_ivf_probing_every_cell_is_exact(spark):
    X, df = _data(spark, n=200)
    cents, cells = build_cells(df, 6, max_iter=5, seed=1)
    k = cents.count()
    got = _got(ivf_neighbors(df, df, cells, cents, 4, nprobe=k, largest=False, block_rows=32))
    assert got == _brute(X, 4, False, False)


def test_ivf_without_nprobe_is_exact_on_unnormalised_vectors(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(240, 12)) * rng.uniform(0.2, 4.0, size=(240, 1)) + 6.0 * (np.arange(240) % 4 == 0)[:, None]
    X[7] = X[11] = X[19]
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "triple_id long, vec array<double>")
    cents, cells = build_cells(df, 20, max_iter=5, seed=1)
    for largest, excl in [(False, False), (True, True)]:
        got = _got(ivf_neighbors(df, df, cells, cents, 4, largest=largest, exclude_self=excl, block_rows=4))
        assert got == _brute(X, 4, largest, excl)


def test_registered_ivf_query_recall(spark):
    from conftest import SF01
    from tripleselect.plans import registry as R
    want = _got(exact_neighbors(tv := R.fx.triple_vectors(spark, SF01).select("triple_id", "vec"), tv, R.WALK_N, largest=False))
    got = _got(R.q_antipodal_ivf(spark, SF01))
    hit = sum(len(set(got.get(i, [])) & set(w)) for i, w in want.items())
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_exact_search_writes_its_tables_once_whatever_the_number_of_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tripleselect.operators import neighbors
    X, df = _data(spark, n=400, d=8)
    X[200:] = X[5]                                         # a group of copies: ties are decided by id
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)] + [(1000, None)], "triple_id long, vec array<double>")
    monkeypatch.setattr(neighbors, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(neighbors, "SIDE_BYTES", 8000)
    stored = []
    whole = neighbors.stored_blocks
    monkeypatch.setattr(neighbors, "stored_blocks", lambda *a: stored.append(whole(*a)) or stored[-1])
    assert _got(neighbors.exact_neighbors(df, df, 5, block_rows=16)) == _brute(X, 5, True, False)
    assert len(stored) == 2
    for table in stored:                                   # 400 rows of 72 bytes and the blocks' headers
        blocks, size = table.agg(F.count("name"), F.sum(F.length("block"))).first()
        assert blocks > 10 and size < 5 * 400 * 72


def test_one_table_searched_for_its_own_rows_is_stored_once_in_its_own_type(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tripleselect.operators import neighbors
    monkeypatch.setattr(neighbors, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(neighbors, "SIDE_BYTES", 8000)
    X, df = _data(spark, n=300, d=16)
    df = df.withColumn("vec", F.col("vec").cast("array<float>"))
    df = df.unionByName(spark.createDataFrame([(1000, None)], "triple_id long, vec array<float>"))
    written = []
    whole = neighbors.cut_lineage
    monkeypatch.setattr(neighbors, "cut_lineage", lambda x: written.append(whole(x)) or written[-1])
    got = neighbors.exact_neighbors(df, df, 5, largest=False, block_rows=64)
    assert _got(got) == _brute(X.astype(np.float32).astype(np.float64), 5, False, False)
    assert len(written) == 1
    # 300 rows of 72 bytes, and for each block its header
    blocks, size = written[0].agg(F.count("name"), F.sum(F.length("block"))).first()
    assert blocks >= 10 and size - 600 * blocks < 300 * 90


def _best(x, y, n, exclude_self, block_rows, step, largest=True):
    from tripleselect.operators.neighbors import Best, finite
    src, q = finite(np.arange(len(x)), x)
    best = Best(src, q if largest else -q, n, exclude_self, block_rows)
    for k in range(0, len(y), step):
        ids, part = finite(np.arange(k, min(k + step, len(y))), y[k:k + step])
        if len(ids):
            best.meet(ids, part)
    best.settle()
    return {int(s): [int(d) for d in best.dst[i][np.isfinite(best.key[i])]] for i, s in enumerate(src)}


def test_few_products_are_taken_in_double_precision(monkeypatch):
    """Products in single precision rule out nearly all rows, and the result is that of all pairs."""
    from tripleselect.operators import neighbors
    taken = []
    whole = neighbors.products
    monkeypatch.setattr(neighbors, "products", lambda x, y, i, j: taken.append(len(i)) or whole(x, y, i, j))
    x = np.random.default_rng(0).normal(size=(3000, 24))
    for largest, excl in [(True, True), (False, False)]:
        assert _best(x[:200], x, 5, excl, 64, 700, largest) == {i: w for i, w in _brute(x, 5, largest, excl).items() if i < 200}
    assert sum(taken) < 0.05 * 2 * 200 * 3000


def test_search_in_single_precision_keeps_odd_rows(monkeypatch):
    from tripleselect.operators import neighbors
    monkeypatch.setattr(neighbors, "TILE", 16 * 50)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6))
    x[50:200] = x[50] + 1e-7 * rng.normal(size=(150, 6))      # apart by less than single precision tells
    x[200:260] = x[3]                                         # copies: ties by id, and whole tiles of them
    x[260:265] = 0.0
    x[265] *= 1e12                                            # one row as long as no other
    x[266] *= 1e-12
    for excl in (False, True):
        assert _best(x, x, 7, excl, 16, 90) == _brute(x, 7, True, excl)
    x[7, 2], x[8, 1] = np.nan, np.inf                         # no product
    got = _best(x, x, 7, False, 16, 90)
    assert 7 not in got and 8 not in got and not {7, 8} & {d for v in got.values() for d in v}
    assert _best(x[:4], x[:4], 7, True, 16, 2) == {i: w for i, w in _brute(x[:4], 3, True, True).items()}


def test_a_task_hands_on_n_rows_a_query_whatever_the_partitions_of_rows(spark, monkeypatch):
    from tripleselect.operators import neighbors
    X, df = _data(spark, n=300, d=8)
    monkeypatch.setattr(neighbors, "BLOCK_BYTES", 800)        # more blocks of queries than tasks are asked for
    monkeypatch.setattr(neighbors, "SIDE_BYTES", 4800)        # five partitions of rows
    handed = []
    finish = neighbors._finish
    monkeypatch.setattr(neighbors, "_finish", lambda c, *a, **kw: handed.append(c.count()) or finish(c, *a, **kw))
    assert _got(neighbors.exact_neighbors(df, df, 5)) == _brute(X, 5, True, False)
    assert handed == [300 * 5]
