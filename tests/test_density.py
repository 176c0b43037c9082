"""Density clusters against a hierarchy by brute force."""
import numpy as np
from pyspark.sql import functions as F

from tripleselect.operators import density
from tripleselect.operators.components import connected_components
from tripleselect.operators.density import cluster_density


def test_density_recovers_blobs(spark):
    rng = np.random.default_rng(0)
    centers = np.eye(8)[:3] * 1.0
    rows, truth = [], []
    for c in range(3):
        for _ in range(40):
            v = centers[c] + rng.normal(0, 0.03, 8)
            rows.append(v)
            truth.append(c)
    for _ in range(10):
        rows.append(rng.normal(0, 1, 8))
        truth.append(-1)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "triple_id long, vec array<double>")
    got = {r.triple_id: r.cluster_id for r in cluster_density(df, 20, 5, block_rows=64).collect()}
    clusters = {}
    for i, t in enumerate(truth[:120]):
        clusters.setdefault(t, set()).add(got[i])
    # every blob maps to exactly one cluster id, and blobs get distinct ids
    assert all(len(v) == 1 and -1 not in v for v in clusters.values())
    assert len({next(iter(v)) for v in clusters.values()}) == 3


def test_no_edge_means_noise(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0])], "triple_id long, vec array<double>")
    assert [tuple(r) for r in cluster_density(v, 2).collect()] == [(0, -1)]


def brute(x, least, ms):
    """Labels by taking the whole graph apart: at every distance, longest first, a component's edges go all at once."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = len(x)
    d = np.sqrt(np.maximum(np.round(2 - 2 * x @ x.T, 12), 0))
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, min(ms, n) - 1]
    w = np.maximum(d, np.maximum(core[:, None], core[None, :]))

    def parts(rows, below):
        left, out = set(rows), []
        while left:
            todo = [left.pop()]
            comp = set(todo)
            while todo:
                i = todo.pop()
                near = {j for j in left if w[i, j] < below}
                left -= near
                comp |= near
                todo += near
            out.append(sorted(comp))
        return out

    def longest(rows):
        # the longest edge of a spanning tree is the distance at which the rows become one
        seen, edge, top = {rows[0]}, {j: w[rows[0], j] for j in rows[1:]}, 0.0
        while edge:
            j = min(edge, key=edge.get)
            top = max(top, edge.pop(j))
            seen.add(j)
            for k in edge:
                edge[k] = min(edge[k], w[j, k])
        return top

    def solve(rows, born):
        gain, now = 0.0, rows
        while True:
            at = longest(now) if len(now) > 1 else 0.0
            lam = 1 / max(at, density.SHORTEST)
            pieces = parts(now, at) if at > 0 else [[i] for i in now]
            big = [p for p in pieces if len(p) >= least]
            gain += (lam - born) * (len(now) - (len(big[0]) if len(big) == 1 else 0))
            if len(big) == 1:
                now = big[0]
                continue
            below = [solve(p, lam) for p in big]
            best = sum(b for b, _ in below)
            if born > 0 and gain >= best:
                return gain, [rows]
            return best, [c for _, cs in below for c in cs]

    label = np.full(n, -1)
    for k, c in enumerate(sorted(solve(list(range(n)), 0.0)[1])):
        label[c] = k
    return label.tolist()


def labels(spark, x, *args, **kw):
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "triple_id long, vec array<double>")
    got = {r.triple_id: r.cluster_id for r in cluster_density(df, *args, **kw).collect()}
    return [got[i] for i in range(len(x))]


def test_hierarchy_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, s, (n, 3)) for c, s, n in (
        ([4, 0, 0], 0.3, 30), ([4, 1.2, 0], 0.2, 25), ([0, 4, 0], 0.5, 30), ([0, 0, 4], 0.1, 12), ([1, 1, 1], 2.0, 25))])
    x[50:60] = x[50]                                                  # copies
    want = brute(x, 8, 4)
    assert len(set(want)) >= 4
    # short lists, small blocks and narrow bands change the work, not the result
    assert labels(spark, x, 8, 4, graph_k=4, block_rows=50, band_edges=30) == want


def test_copies_close_together_are_joined_before_what_is_further(spark):
    """Two groups of 20 copies 0.001 apart and a chain with steps of 0.05 to 0.1."""
    turn = np.concatenate([np.zeros(20), np.full(20, 0.001), 1.5 + np.cumsum(np.random.default_rng(2).uniform(0.05, 0.1, 15))])
    x = np.stack([np.cos(turn), np.sin(turn)], axis=1)
    got = labels(spark, x, 10, 5)
    assert got == brute(x, 10, 5)
    assert len({c for c in got if c >= 0}) == 2 and len(set(got[:40])) == 1


def test_odd_vectors(spark):
    same = np.ones((7, 2))
    assert labels(spark, same, 3, 2) == [-1] * 7                    # one component only: the whole set is no cluster
    zero = np.concatenate([np.zeros((5, 2)), np.ones((5, 2)), -np.ones((5, 2))])
    assert sorted(map(labels(spark, zero, 4, 2).count, (0, 1, 2))) == [5, 5, 5]
    empty = spark.createDataFrame([], "triple_id long, vec array<double>")
    assert cluster_density(empty, 3).count() == 0


def test_components(spark, monkeypatch):
    from tripleselect.operators import components
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(200 + i, 201 + i) for i in range(40)] + [(7, 7)]
    df = spark.createDataFrame(edges + [(None, 3)], "a long, b long")
    short = {tuple(r) for r in connected_components(df).collect()}
    monkeypatch.setattr(components, "LOCAL_EDGES", 0)
    assert {tuple(r) for r in connected_components(df).collect()} == short
    comp = dict(short)
    assert all(comp[a] == comp[b] for a, b in edges if a != b) and all(comp[c] == c for c in comp.values())
    assert comp[240] == 200 and connected_components(df.limit(0)).count() == 0


def test_shortest_edges_out_are_those_of_all_pairs():
    import pyarrow as pa
    rng = np.random.default_rng(3)
    x = rng.normal(size=(260, 5))
    x[100:140] = x[100] + 1e-6 * rng.normal(size=(40, 5))       # near copies in several components
    x[140:150] = 0.0
    x[:140] /= np.linalg.norm(x[:140], axis=1, keepdims=True)
    x[150:] /= np.linalg.norm(x[150:], axis=1, keepdims=True)
    comp = rng.integers(0, 9, 260)
    core = np.round(rng.uniform(0, 1, 260), 1)                  # ties
    bound = np.where(np.arange(9) % 3 == 0, np.inf, np.where(np.arange(9) % 3 == 1, 0.6, 0.0))[comp]
    d = np.sqrt(np.maximum(np.round(2 - 2 * x @ x.T, 12), 0))
    w = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    want = {}
    for c in range(9):
        some = [(w[i, j], min(i, j), max(i, j), comp[j]) for i in np.flatnonzero(comp == c) for j in np.flatnonzero(comp != c)
                if w[i, j] <= bound[i]]
        if some:
            want[c] = min(some)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(comp[rows]), pa.array(core[rows]), pa.array(bound[rows]),
                                           pa.array([list(v) for v in x[rows]])], names=["node", "comp", "core", "bound", "vec"])

    got = {}
    for rows in np.array_split(rng.permutation(260), 3):
        out = density.Outside(batch(rows))
        for more in np.array_split(rng.permutation(260), 4):
            out.meet(batch(more))
        if (found := out.found()) is not None:
            for r in found.to_pylist():
                edge = (r["w"], r["lo"], r["hi"], r["other"])
                got[r["comp"]] = min(got.get(r["comp"], edge), edge)
    assert {c: e[1:] for c, e in got.items()} == {c: e[1:] for c, e in want.items()}
    assert all(abs(got[c][0] - want[c][0]) < 1e-9 for c in want)


def test_only_copies_are_joined_by_their_vectors(spark):
    """Zeros of either sign are one number, in the hash as in the vector."""
    x = [[0.0, 1.0], [-0.0, 2.0], [1.0, 0.0], [3.0, -0.0], [1.0, 1.0], None]
    df = spark.createDataFrame(list(enumerate(x)), "triple_id long, vec array<double>")
    nodes, members = density.folded(df, "triple_id", "vec")
    assert {r.id: r.node for r in members.collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    assert {(r.node, r.weight) for r in nodes.where("vec is not null").collect()} == {(0, 2), (2, 2), (4, 1)}
    plan = members._jdf.queryExecution().optimizedPlan().toString()
    assert "weight" in plan and "Union" in plan


def test_many_edges_of_a_round_are_united_in_one_task(spark, monkeypatch):
    from tripleselect.operators import components
    monkeypatch.setattr(components, "LOCAL_EDGES", 0)
    n = 3000
    at = np.random.default_rng(7).permutation(n)
    df = spark.createDataFrame([(int(at[i]), int(at[i + 1])) for i in range(n - 1) if i != 1000], "a long, b long")
    comp = {r.node: r.comp for r in connected_components(df, local_edges=n).collect()}
    assert {comp[int(v)] for v in at[:1001]} == {int(at[:1001].min())} and {comp[int(v)] for v in at[1001:]} == {int(at[1001:].min())}


def test_rounds_of_joins_keep_no_estimates(spark):
    """A join's estimate is the product of both sides'; kept by checkpoints, it doubles in digits with every round."""
    from tripleselect.session import cut_estimates
    df = start = cut_estimates(spark.range(5))
    for _ in range(6):
        df = cut_estimates(df.join(df.withColumnRenamed("id", "other"), F.col("id") == F.col("other")).select("id"))
    size = [x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() for x in (start, df)]
    assert size[0] == size[1] and df.count() == 5
