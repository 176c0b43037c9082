"""The walk in its three forms against step-by-step twins."""
import hashlib
import random

import numpy as np
import pytest

from tripleselect.operators import markov
from tripleselect.operators.markov import LazyTable, markov_sample
from tripleselect.operators.neighbors import antipodal_neighbors


def key(s):
    return int(hashlib.md5(s.encode()).hexdigest()[:15], 16)


def frame(spark, trans):
    rows = [(s, r + 1, d, 0.0) for s, ds in trans.items() for r, d in enumerate(ds)]
    return spark.createDataFrame(rows, "src long, rank int, dst long, dot double")


def twin(trans, k, walkers, seed, start, choice="std", steps=400):
    at = [start]
    for i in range(1, walkers):
        ds = trans.get(at[-1]) or [at[-1]]
        at.append(ds[key(f"{seed}:init:{i}:0") % len(ds)])
    seen, order, expanded = set(), [], set(at)
    for step in range(1, steps):
        new = []
        for w, s in enumerate(at):
            ds = trans.get(s) or [s]
            pool = [d for d in ds if d not in expanded] or ds if choice == "constraint" else ds
            new.append(pool[key(f"{seed}:{w}:{step}") % len(pool)])
        at = new
        expanded |= set(at)
        for s in at:
            if s not in seen:
                seen.add(s)
                order.append(s)
        if len(seen) >= k:
            return order[:k], step, True
    return order, step, False


def sample(got):
    samples, run = got
    return [r.triple_id for r in samples.orderBy("ordinal").collect()], run


def graph(n, degree, seed, ids=lambda i: i, sinks=False):
    rnd = random.Random(seed)
    return {ids(s): [ids(rnd.randrange(n)) for _ in range(degree)] for s in range(n) if s % 17 != 3 or not sinks}


@pytest.mark.parametrize("choice", ["std", "constraint"])
def test_eager_walk(spark, choice):
    trans = graph(90, 3, 1)
    got, run = sample(markov_sample(frame(spark, trans), 25, walkers=6, seed=5, start=0, choice=choice, n_rows=90))
    want, steps, done = twin(trans, 25, 6, 5, 0, choice)
    assert (got, run["steps"], run["complete"]) == (want, steps, done) and done


def test_walkers_stay_where_there_is_no_transition(spark):
    trans = graph(90, 2, 1, sinks=True)
    got, run = sample(markov_sample(frame(spark, trans), 90, walkers=4, seed=5, start=0, n_rows=90))
    want, _, done = twin(trans, 90, 4, 5, 0)
    assert got == want and not run["complete"] and not done


def test_lazy_walk_equals_eager_and_searches_each_state_once(spark):
    rng = np.random.default_rng(3)
    vecs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(200, 6)))],
                                 "triple_id long, vec array<double>")
    calls = []

    def search(states):
        calls.extend(r.state for r in states.collect())
        return antipodal_neighbors(states.withColumnRenamed("state", "triple_id").join(vecs, "triple_id"), vecs, 4)

    eager, run = sample(markov_sample(antipodal_neighbors(vecs, vecs, 4), 18, walkers=3, seed=9))
    lazy, lazy_run = sample(markov_sample(search, 18, walkers=3, seed=9, vectors=vecs))
    assert lazy == eager and lazy_run["steps"] == run["steps"] and lazy_run["complete"]
    assert len(calls) == len(set(calls)) == lazy_run["searched"] < 200
    assert set(eager) - set(calls) == set(eager) - set(calls) and len(calls) <= 3 * (run["steps"] + 4)


def test_lazy_table_searches_only_what_is_new(spark):
    seen = []

    def search(states):
        got = sorted(r.state for r in states.collect())
        seen.append(got)
        return spark.createDataFrame([(s, 1, s + 1) for s in got if s != 7], "src long, rank int, dst long")

    t = LazyTable(spark, search)
    for ask in ([1, 2, 2], [2, 3], [1, 3], [7]):
        t.of(spark.createDataFrame([(s,) for s in ask], "state long"))
    assert seen == [[1, 2], [3], [7]] and t.searched == 4 and t.searches == 3
    assert sorted((r.src, r.dst) for r in t._table.collect()) == [(1, 2), (2, 3), (3, 4), (7, 7)]


@pytest.mark.parametrize("walkers", [1, 5])
def test_doubled_walk(spark, walkers):
    trans = graph(300, 1, 4, sinks=True)
    for k in (8, 300):
        got, run = sample(markov_sample(frame(spark, trans), k, walkers=walkers, seed=2, start=11, n_rows=300))
        want, steps, done = twin(trans, k, walkers, 2, 11)
        assert got == want and run["complete"] == done and (not done or run["steps"] == steps)


def test_doubled_walk_over_a_long_path_takes_few_jobs(spark):
    n = 100_000
    df = spark.range(n).selectExpr("id AS src", "1 AS rank", "(id + 1) % 100000 AS dst", "0D AS dot")
    sc = spark.sparkContext
    sc.setJobGroup("long-path", "walk")
    try:
        samples, run = markov_sample(df, n, walkers=1, seed=1, start=0, n_rows=n)
        jobs = len(sc.statusTracker().getJobIdsForGroup("long-path"))
    finally:
        sc._jsc.clearJobGroup()
    first = samples.orderBy("ordinal").limit(3).collect()
    assert [r.triple_id for r in first] == [1, 2, 3] and samples.count() == n and run["steps"] == n and run["complete"]
    assert jobs < n / 500                       # Spark counts every shuffle of an adaptive query as a job


def test_max_rounds(spark):
    trans = graph(60, 3, 6)
    got, run = sample(markov_sample(frame(spark, trans), 60, walkers=2, seed=3, start=0, max_rounds=5, n_rows=60))
    want, _, _ = twin(trans, 60, 2, 3, 0, steps=6)
    assert got == want and run["steps"] == 5 and not run["complete"]
    one = {s: [(s + 1) % 50] for s in range(50)}
    got, run = sample(markov_sample(frame(spark, one), 50, walkers=1, seed=3, start=0, max_rounds=6, n_rows=50))
    assert got == [1, 2, 3, 4, 5, 6] and run["steps"] == 6 and not run["complete"]


@pytest.mark.parametrize("init", ["chain", "random"])
def test_ids_need_not_be_dense(spark, init):
    trans = graph(8, 2, 8, ids=lambda i: 100 + 7 * i)
    got, _ = sample(markov_sample(frame(spark, trans), 3, walkers=2, seed=4, init=init))
    assert set(got) <= {100 + 7 * i for i in range(8)}


def test_mean_init(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 5))
    vecs = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "triple_id long, vec array<double>")
    table = markov.EagerTable(antipodal_neighbors(vecs, vecs, 3))
    w = markov.init_walkers(table, table.states, 40, 5, 4, 1, "mean", vecs, 3)
    got = [r.state for r in w.orderBy("walker").collect()]

    def least(v):
        return sorted(range(40), key=lambda j: (round(float(x[j] @ v), 9), j))[:3]
    want = [5, least(x[5])[key("1:init:1:0") % 3]]
    for i in (2, 3):
        want.append(least((x[want[-1]] + x[want[-2]]) / 2)[key(f"1:init:{i}:0") % 3])
    assert got == want
