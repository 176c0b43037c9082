"""Acceptance-threshold sampling (the "MH" family).

Process: a set C starts at {x0}.  Step s draws row ``idx_s`` uniformly with
replacement; its mean cosine to a reference set is ``d``; the draw is
accepted (becomes the state) when ``d < t(s)``; the state is added to C
after every step.  While |C| <= k the reference set is all of C; at the
first step with |C| > k, k members are chosen once and frozen.  The run
stops when |C| reaches the target.  Optional rules: a linear threshold
schedule, and a stall fallback that, after ``max_steps`` consecutive
rejections, accepts the least similar candidate of that block.

Spark formulation
-----------------
* Draws are a pure function of (seed, step): ``idx = md5(seed:step) mod N``
  over dense row ids, so any step range can be generated by ``spark.range``
  on executors and every engine reproduces them.
* Warm-up (|C| <= k) is order dependent but bounded by k: draws are read in
  blocks and one ``applyInPandas`` group per run does the greedy pass.  The
  carried state is O(k + d): C's ids, the sum of C's unit vectors
  (mean cosine to C = x̂ · Σĉ / |C|), state, stall counter and best.
* After the freeze the mean cosine is the stateless projection
  ``d(x) = x̂ · r̄`` of the drawn rows.  Draws over a step range are joined
  to the narrow (id, d) table; accept = ``d < t(step)``; first accept per
  id = ``min(step)``; the sample is the ids with the smallest first step.
  The step range grows geometrically until enough distinct ids are found.
* Stall blocks are found without a single-partition window: the last
  accepted step before every draw comes from a per-bucket maximum, a
  running maximum over the (small) bucket table, and a per-bucket window.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleselect.functions.rand import hash_key
from tripleselect.functions.vectors import dot, with_l2_normalized
from tripleselect.operators.select import smallest_n_per_group

STEP_BUCKET = 4096


@dataclass
class Schedule:
    """Threshold ``t(s)`` used by draw ``s``: ``t0`` moving linearly to
    ``t1`` over ``horizon`` steps, constant afterwards.  The threshold is
    updated after each step, so draw ``s`` sees ``t(s - 1)``."""
    t0: float
    t1: float | None = None
    horizon: int = 0

    def column(self, step) -> F.Column:
        if self.t1 is None or self.horizon <= 0:
            return F.lit(float(self.t0))
        x = F.least(step - F.lit(1), F.lit(self.horizon)).cast("double")
        return F.lit(float(self.t0)) + F.lit(float(self.t1 - self.t0)) * x / F.lit(float(self.horizon))

    def value(self, step: int) -> float:
        if self.t1 is None or self.horizon <= 0:
            return float(self.t0)
        x = float(min(step - 1, self.horizon))
        return float(self.t0) + float(self.t1 - self.t0) * x / float(self.horizon)

    def final(self) -> float:
        return float(self.t0) if self.t1 is None or self.horizon <= 0 else float(self.t1)

    def highest_after(self, step: int) -> float:
        """The highest threshold that a draw after ``step`` can see."""
        return max(self.value(step + 1), self.final())


@dataclass
class RunResult:
    samples: DataFrame          # (run_id, ordinal, triple_id)
    run: dict = field(default_factory=dict)


def draws(spark: SparkSession, seed, n_rows: int, first: int, last: int) -> DataFrame:
    """(step, idx) for steps first..last: idx = md5('<seed>:<step>') mod N."""
    return (spark.range(first, last + 1).select(F.col("id").alias("step"))
                 .withColumn("idx", F.pmod(hash_key(seed, "step"), F.lit(n_rows))))


def draw_idx(seed, step: int, n_rows: int) -> int:
    """Driver-side twin of :func:`draws` for a single step."""
    import hashlib
    h = hashlib.md5(f"{seed}:{step}".encode()).hexdigest()[:15]
    return int(h, 16) % n_rows


def _check_dense(vectors: DataFrame, id_col: str) -> int:
    r = vectors.agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("lo"), F.max(id_col).alias("hi")).first()
    n = int(r["n"])
    if n == 0 or r["lo"] != 0 or r["hi"] != n - 1:
        raise ValueError("the sampler draws row positions: ids must be dense 0..N-1 (see sources.with_triple_id)")
    return n


# --------------------------------------------------------------------------- bulk step (frozen reference)

def projection(vectors: DataFrame, rbar: list[float], id_col: str = "triple_id", vec_col: str = "vec",
               drawn: DataFrame | None = None) -> DataFrame:
    """(id, d) with d = x̂ · r̄ for every row, or for the rows of ``drawn(idx)``."""
    lit = F.array(*[F.lit(float(v)) for v in rbar])
    rows = vectors.select(F.col(id_col).alias("idx"), F.col(vec_col).alias("vec"))
    if drawn is not None:
        rows = rows.join(drawn.select("idx").distinct(), "idx", "left_semi")
    return with_l2_normalized(rows, "vec").select("idx", dot("vec", lit).alias("d"))


def _last_accept(dr: DataFrame, base_step: int) -> DataFrame:
    """Add ``L`` = the last accepted step strictly before each step (or
    ``base_step``), via bucket maxima + a running maximum over buckets."""
    b = dr.withColumn("bkt", F.floor(F.col("step") / STEP_BUCKET))
    bmax = b.groupBy("bkt").agg(F.max(F.when(F.col("acc"), F.col("step"))).alias("bm"))
    prev = bmax.withColumn("pm", F.max("bm").over(Window.orderBy("bkt").rowsBetween(Window.unboundedPreceding, -1)))
    w = Window.partitionBy("bkt").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    inb = b.withColumn("im", F.max(F.when(F.col("acc"), F.col("step"))).over(w))
    return (inb.join(prev.select("bkt", "pm"), "bkt")
               .withColumn("L", F.greatest(F.coalesce("im", F.lit(base_step)), F.coalesce("pm", F.lit(base_step)),
                                           F.lit(base_step)))
               .drop("bkt", "im", "pm"))


def accept_events(spark: SparkSession, project: Callable[[DataFrame | None], DataFrame], seed, n_rows: int, first: int, last: int,
                  schedule: Schedule, max_steps: int | None) -> DataFrame:
    """(step, idx) of every state change in steps first..last, starting with
    a clean stall counter at step ``first``: regular accepts, plus (stall
    mode) the best candidate of each full block of ``max_steps`` rejections.
    Only drawn rows are projected, unless as many are drawn as there are."""
    drawn = draws(spark, seed, n_rows, first, last)
    proj = project(drawn if last - first + 1 < n_rows else None)
    dr = drawn.join(proj, "idx").withColumn("acc", F.col("d") < schedule.column(F.col("step")))
    acc = dr.where("acc").select("step", "idx")
    if not max_steps:
        return acc
    la = _last_accept(dr, first - 1).withColumn("blk", F.floor((F.col("step") - F.col("L") - 1) / max_steps))
    blocks = (la.groupBy("L", "blk")
                .agg(F.count(F.lit(1)).alias("c"), F.max(F.col("acc").cast("int")).alias("any_acc"),
                     F.min(F.when(F.col("d") < 1.0, F.struct("d", "step", "idx"))).alias("best"))
                .where((F.col("c") == max_steps) & (F.col("any_acc") == 0) & F.col("best").isNotNull())
                .select((F.col("L") + (F.col("blk") + 1) * max_steps).alias("step"), F.col("best.idx").alias("idx")))
    return acc.unionByName(blocks)


def _first_new(events: DataFrame, exclude: list[int]) -> DataFrame:
    ev = events.groupBy("idx").agg(F.min("step").alias("step"))
    if exclude:
        ev = ev.where(~F.col("idx").isin(exclude))
    return ev


def bulk_collect(spark: SparkSession, project: Callable[[DataFrame | None], DataFrame], seed, n_rows: int, start_step: int,
                 need: int, schedule: Schedule, max_steps: int | None, exclude: list[int],
                 max_draws: int | None) -> tuple[DataFrame, int, bool]:
    """The ``need`` ids (not in ``exclude``) with the earliest first state
    change after ``start_step``.  Returns (DataFrame(idx, step), last step,
    complete).  ``project(drawn)`` gives (idx, d) of the drawn rows.  The step
    range starts as if half of the rows passed and grows by what was found
    (twofold at least) until enough distinct ids appear, no further id can
    pass, or the caller's ``max_draws`` (none by default) is reached.  Under
    the stall rule any row with ``d < 1`` can still be taken, however rarely."""
    if need <= 0:
        return spark.createDataFrame([], "idx long, step long"), start_step, True
    pool = max(0.5 * n_rows, need + 1)
    m = int(max(4 * need, 2.6 * n_rows * (math.log(pool) - math.log(pool - need)) + 64))
    while True:
        last = start_step + m
        capped = bool(max_draws) and last >= max_draws
        if capped:
            last = max_draws
        ev = _first_new(accept_events(spark, project, seed, n_rows, start_step + 1, last, schedule, max_steps), exclude)
        ev = ev.persist()
        have = ev.count()
        if have >= need or capped or _exhausted(project(None), ev, exclude, last, schedule, max_steps):
            picked = _smallest_steps(ev, need)
            picked = picked.persist()
            mx = picked.agg(F.max("step")).first()[0]
            ev.unpersist()
            return picked, int(mx) if mx is not None else start_step, have >= need
        ev.unpersist()
        m = int(m * min(max(2.0, 1.5 * need / max(have, 1)), 64.0))


def _exhausted(proj: DataFrame, found: DataFrame, exclude: list[int], last: int, schedule: Schedule,
               max_steps: int | None) -> bool:
    """No row outside ``found`` and ``exclude`` can pass after step ``last``."""
    bound = 1.0 if max_steps else schedule.highest_after(last)
    rest = proj.where(F.col("d") < F.lit(bound)).join(found.select("idx"), "idx", "left_anti")
    if exclude:
        rest = rest.where(~F.col("idx").isin(exclude))
    return rest.isEmpty()


def _smallest_steps(ev: DataFrame, need: int) -> DataFrame:
    """The ``need`` rows of smallest (step, idx): step numbers are dense, so a
    bucket histogram over steps finds the cut without a global sort."""
    b = ev.withColumn("__b", F.floor(F.col("step") / STEP_BUCKET))
    hist = b.groupBy("__b").agg(F.count(F.lit(1)).alias("__c"))
    hist = (hist.withColumn("__before", F.coalesce(F.sum("__c").over(
        Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .where(F.col("__before") < need))
    kept = b.join(hist, "__b")
    whole = kept.where(F.col("__before") + F.col("__c") <= need)
    edge = (kept.where(F.col("__before") + F.col("__c") > need)
                .withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("step", "idx")))
                .where(F.col("__r") <= need - F.col("__before")).drop("__r"))
    return whole.unionByName(edge).select("idx", "step")


def accept_bulk(vectors: DataFrame, ref_ids: DataFrame, n: int, t: float | Schedule, seed=0,
                max_steps: int | None = None, max_draws: int | None = None, id_col: str = "triple_id",
                vec_col: str = "vec", run_id: str = "bulk") -> RunResult:
    """Bulk step alone, with a given (frozen) reference set: the first ``n``
    distinct ids to become the state, in order.  (run_id, ordinal,
    triple_id, step)."""
    from tripleselect.operators.evaluate import reference_mean
    spark = vectors.sparkSession
    t0 = time.time()
    n_rows = _check_dense(vectors, id_col)
    sched = t if isinstance(t, Schedule) else Schedule(float(t))
    rbar = reference_mean(vectors, ref_ids, id_col, vec_col).first()["rbar"]
    project = partial(projection, vectors, rbar, id_col, vec_col)
    picked, last, complete = bulk_collect(spark, project, seed, n_rows, 0, n, sched, max_steps, [], max_draws)
    out = (picked.withColumn("ordinal", F.row_number().over(Window.orderBy("step", "idx")))
                 .select(F.lit(run_id).alias("run_id"), "ordinal", F.col("idx").alias(id_col), "step"))
    return RunResult(out, dict(run_id=run_id, sampler="accept_bulk", steps=last, complete=complete,
                               seconds=time.time() - t0))


# --------------------------------------------------------------------------- warm-up (|C| <= k)

_STATE_SCHEMA = ("run_id string, c_ids array<long>, s_vec array<double>, state long, cnt int, "
                 "best_id long, best_d double, best_vec array<double>, step long, phase string")


def _warm_fn(k: int, target: int, schedule: Schedule, max_steps: int | None):
    def fn(dpdf: pd.DataFrame, spdf: pd.DataFrame) -> pd.DataFrame:
        st = spdf.iloc[0]
        c_ids = [int(x) for x in st["c_ids"]]
        cset = set(c_ids)
        s_vec = np.asarray(st["s_vec"], dtype=np.float64)
        state = int(st["state"])
        cnt = int(st["cnt"])
        best_id = None if pd.isna(st["best_id"]) else int(st["best_id"])
        best_d = float(st["best_d"])
        best_vec = None if st["best_vec"] is None else np.asarray(st["best_vec"], dtype=np.float64)
        step = int(st["step"])
        phase = st["phase"]
        dpdf = dpdf.sort_values("step")
        for s, idx, v in zip(dpdf["step"], dpdf["idx"], dpdf["vec"]):
            if phase != "warm":
                break
            x = np.asarray(v, dtype=np.float64)
            nx = np.linalg.norm(x)
            xh = x / nx if nx > 0 else x
            d = float(xh @ s_vec) / len(c_ids)
            new_vec = None
            if d < schedule.value(int(s)):
                state, new_vec = int(idx), xh
                cnt, best_id, best_d, best_vec = 0, None, 1.0, None
            elif max_steps:
                cnt += 1
                if d < best_d:
                    best_id, best_d, best_vec = int(idx), d, xh
                if cnt >= max_steps:
                    if best_id is not None:
                        state, new_vec = best_id, best_vec
                    cnt, best_id, best_d, best_vec = 0, None, 1.0, None
            step = int(s)
            if new_vec is not None and state not in cset:
                cset.add(state)
                c_ids.append(state)
                s_vec = s_vec + new_vec
            if len(c_ids) >= target:
                phase = "done"
            elif len(c_ids) > k:
                phase = "frozen"
        return pd.DataFrame([dict(run_id=st["run_id"], c_ids=c_ids, s_vec=s_vec.tolist(), state=state, cnt=cnt,
                                  best_id=best_id, best_d=best_d,
                                  best_vec=None if best_vec is None else best_vec.tolist(), step=step, phase=phase)])
    return fn


def warm_up(vectors: DataFrame, n_rows: int, x0: int, k: int, target: int, schedule: Schedule,
            max_steps: int | None, seed, run_id: str, max_draws: int | None,
            id_col: str = "triple_id", vec_col: str = "vec", block: int | None = None) -> dict:
    """Greedy pass until |C| > k (or the target), block by block.  Returns
    the final state as a dict (bounded: k + 1 ids and two d-vectors).  Ends
    early, in phase ``warm``, after the caller's ``max_draws`` (none by
    default) or when no row outside C can pass any more."""
    spark = vectors.sparkSession
    x0v = with_l2_normalized(vectors.where(F.col(id_col) == x0).select(vec_col), vec_col).first()[0]
    state = dict(run_id=run_id, c_ids=[int(x0)], s_vec=[float(v) for v in x0v], state=int(x0), cnt=0,
                 best_id=None, best_d=1.0, best_vec=None, step=0,
                 phase="done" if target <= 1 else ("frozen" if k < 1 else "warm"))
    block = block or 16 * (k + 1)
    vec = vectors.select(F.col(id_col).alias("idx"), F.col(vec_col).alias("vec"))
    size = 1
    while state["phase"] == "warm":
        first = state["step"] + 1
        last = first + block - 1
        if max_draws and first > max_draws:
            break
        if max_draws:
            last = min(last, max_draws)
        dr = draws(spark, seed, n_rows, first, last).join(vec, "idx").withColumn("run_id", F.lit(run_id))
        sdf = spark.createDataFrame([state], _STATE_SCHEMA)
        out = (dr.groupBy("run_id").cogroup(sdf.groupBy("run_id"))
                 .applyInPandas(_warm_fn(k, target, schedule, max_steps), _STATE_SCHEMA))
        row = out.first()
        state = row.asDict(recursive=True)
        state["step"] = int(state["step"])
        block = min(block * 2, 1 << 16)
        # C is what the distances depend on: if it stayed as it is, ask whether any row can still join it
        if state["phase"] == "warm" and len(state["c_ids"]) == size and not max_draws:
            proj = projection(vectors, [v / size for v in state["s_vec"]], id_col, vec_col)
            bound = 1.0 if max_steps else schedule.highest_after(state["step"])
            if proj.where((F.col("d") < F.lit(bound)) & ~F.col("idx").isin(state["c_ids"])).isEmpty():
                break
        size = len(state["c_ids"])
    return state


# --------------------------------------------------------------------------- full sampler

def accept_sample(vectors: DataFrame, n: int, k: int = 100, t: float | Schedule = 0.65, seed=0,
                  start: int | None = None, max_steps: int | None = None, max_draws: int | None = None,
                  id_col: str = "triple_id", vec_col: str = "vec", run_id: str = "accept",
                  params: dict | None = None) -> RunResult:
    """Full process: warm-up with C as reference set, freeze k members of C
    (the k with the smallest seeded key), then the bulk step.  Returns the
    samples in order of addition (ordinal 1 = start) and a run record
    (steps, seconds, complete)."""
    from tripleselect.operators.evaluate import reference_mean
    spark = vectors.sparkSession
    t_start = time.time()
    n_rows = _check_dense(vectors, id_col)
    sched = t if isinstance(t, Schedule) else Schedule(float(t))
    x0 = int(start) if start is not None else draw_idx(f"{seed}:start", 0, n_rows)
    st = warm_up(vectors, n_rows, x0, k, n, sched, max_steps, seed, run_id, max_draws, id_col, vec_col)
    c_ids = list(st["c_ids"])
    steps = int(st["step"])
    complete = st["phase"] == "done"
    rows = [(run_id, i + 1, int(c)) for i, c in enumerate(c_ids)]
    base = spark.createDataFrame(rows, f"run_id string, ordinal long, {id_col} long")
    if st["phase"] == "frozen":
        ref_key = spark.createDataFrame([(int(c),) for c in c_ids], "ref_id long").withColumn(
            "__k", hash_key(f"{seed}:ref", "ref_id"))
        ref = smallest_n_per_group(ref_key, [], "__k", k, "ref_id").select("ref_id")
        rbar = reference_mean(vectors, ref, id_col, vec_col).first()["rbar"]
        project = partial(projection, vectors, rbar, id_col, vec_col)
        picked, last, complete = bulk_collect(spark, project, seed, n_rows, steps, n - len(c_ids), sched,
                                              max_steps, c_ids, max_draws)
        steps = last if complete else (max_draws or last)
        more = (picked.withColumn("ordinal", F.row_number().over(Window.orderBy("step", "idx")) + len(c_ids))
                      .select(F.lit(run_id).alias("run_id"), "ordinal", F.col("idx").alias(id_col)))
        base = base.unionByName(more)
    run = dict(run_id=run_id, sampler="accept", steps=steps, complete=bool(complete),
               seconds=time.time() - t_start, params=params or {})
    return RunResult(base, run)


def accept_sweep(vectors: DataFrame, n: int, ks: list[int], ts: list[float], seed=0,
                 max_steps_list: list[int | None] | None = None, start: int | None = None,
                 max_draws: int | None = None, id_col: str = "triple_id", vec_col: str = "vec",
                 prefix: str = "accept") -> tuple[DataFrame, DataFrame]:
    """Parameter grid k x t [x max_steps]: one run per point.  Returns
    (samples, runs) tables; run_id encodes the point."""
    spark = vectors.sparkSession
    samples, runs = None, []
    for k in ks:
        for m in (max_steps_list or [None]):
            for t in ts:
                rid = ".".join(str(x) for x in ([prefix, k, t] + ([m] if m else []) + [n]))
                r = accept_sample(vectors, n, k, t, seed, start, m, max_draws, id_col, vec_col, rid,
                                  dict(k=str(k), t=str(t), max_steps=str(m)))
                samples = r.samples if samples is None else samples.unionByName(r.samples)
                runs.append((rid, "accept", {kk: vv for kk, vv in r.run["params"].items()}, n,
                             int(r.run["steps"]), float(r.run["seconds"]), bool(r.run["complete"])))
    runs_df = spark.createDataFrame(runs, "run_id string, sampler string, params map<string,string>, n long, "
                                          "steps long, seconds double, complete boolean")
    return samples, runs_df
