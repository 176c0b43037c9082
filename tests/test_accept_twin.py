"""The Spark sampler against a plain sequential loop over the same draws."""
import hashlib

import numpy as np
from pyspark.sql import functions as F

from conftest import SF01
from tripleselect.operators.accept import Schedule, accept_bulk, accept_sample, draw_idx
from tripleselect.sources import fixtures as fx


def _key(s: str) -> int:
    return int(hashlib.md5(s.encode()).hexdigest()[:15], 16)


def twin(X, n, k, t, seed, start=None, max_steps=None, max_draws=100000):
    """Sequential process: C as reference while |C| <= k, then k members
    frozen (smallest seeded key), stall fallback optional."""
    N = len(X)
    Xh = X / np.linalg.norm(X, axis=1, keepdims=True)
    x0 = start if start is not None else draw_idx(f"{seed}:start", 0, N)
    C, order, state = {x0}, [x0], x0
    ref = None
    cnt, best = 0, (None, 1.0)
    step = 0
    while len(C) < n and step < max_draws:
        step += 1
        if ref is None and len(C) > k:
            chosen = sorted(C, key=lambda i: (_key(f"{seed}:ref:{i}"), i))[:k]
            ref = Xh[chosen].mean(axis=0)
        i = draw_idx(seed, step, N)
        d = float(Xh[i] @ (ref if ref is not None else Xh[order].mean(axis=0)))
        if d < t.value(step):
            state, cnt, best = i, 0, (None, 1.0)
        elif max_steps:
            cnt += 1
            if d < best[1]:
                best = (i, d)
            if cnt >= max_steps:
                if best[0] is not None:
                    state = best[0]
                cnt, best = 0, (None, 1.0)
        if state not in C:
            C.add(state)
            order.append(state)
    return order, step


def _vectors(spark):
    tv = fx.triple_vectors(spark, SF01).select("triple_id", "vec")
    pdf = tv.orderBy("triple_id").toPandas()
    X = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["vec"]])
    return tv, X


def test_full_sampler_matches_sequential(spark):
    tv, X = _vectors(spark)
    for (n, k, t, m) in [(60, 20, 0.0, None), (40, 10, -0.02, 10), (30, 10, 0.02, None)]:
        sched = Schedule(t)
        r = accept_sample(tv, n, k, sched, seed=7, max_steps=m)
        got = [row.triple_id for row in r.samples.orderBy("ordinal").collect()]
        want, steps = twin(X, n, k, sched, 7, max_steps=m)
        assert got == want, (n, k, t, m)
        assert r.run["steps"] == steps
        assert r.run["complete"]


def test_schedule_sampler_matches_sequential(spark):
    tv, X = _vectors(spark)
    sched = Schedule(0.02, -0.02, 40 * 10)
    r = accept_sample(tv, 40, 10, sched, seed=3, max_steps=10)
    got = [row.triple_id for row in r.samples.orderBy("ordinal").collect()]
    want, steps = twin(X, 40, 10, sched, 3, max_steps=10)
    assert got == want
    assert r.run["steps"] == steps


def test_incomplete_run_is_flagged(spark):
    tv, X = _vectors(spark)
    # a threshold nothing passes: the run stops at the draw cap, incomplete
    r = accept_sample(tv, 30, 5, -5.0, seed=1, max_draws=3000)
    assert not r.run["complete"]
    assert r.samples.count() == 1


def test_run_without_limit_ends_when_no_row_can_pass(spark):
    tv, X = _vectors(spark)
    r = accept_sample(tv, 30, 5, -5.0, seed=1)
    assert not r.run["complete"]
    assert r.samples.count() == 1
    # every row passes, and no more than all rows can be had
    r = accept_sample(tv, len(X) + 5, 5, 2.0, seed=1)
    assert not r.run["complete"]
    assert r.samples.select("triple_id").distinct().count() == len(X)
