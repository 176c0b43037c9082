"""Antipodal Markov walk.

States are triples; a state's transitions are its ``n`` most dissimilar
triples (antipodal top-n, see ``neighbors``), each chosen with equal
probability.  ``walkers`` walkers step together; the sample is the set of
states visited after each step (a walker's starting state counts only when
revisited), cut to ``k`` in order of first visit (step, walker).

A choice is a seeded draw ``md5(seed:walker:step) mod n``, a pure function, so
a walk gives the same sample in any engine and however it is run here:

* ``EagerTable``: all transitions are written once to the shared checkpoint
  folder, in parts by hash of the source state.  A job takes ``STEPS_A_JOB``
  steps: each joins the (broadcast) walkers with the parts that their states
  name, and every walker carries the states it passed.
* ``LazyTable``: transitions are searched when a walker first stands on a
  state.  Each step anti-joins the walkers' states with the states searched
  before and searches only the rest, so a walk that visits few states never
  pays for the neighbours of all.
* With one transition a state (``n = 1``) a walk is a path of a function and
  ``doubled_walk`` takes 1, 2, 4, 8 ... steps at once by pointer doubling.

A walk that finds nothing new for a while is ended once no unvisited state can
be reached from its walkers.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleselect.functions.rand import hash_key
from tripleselect.functions.vectors import mean_vector
from tripleselect.session import cut_lineage, ensure_checkpoint_dir, shared_path

STEPS_A_JOB = 4
#: Rows of a part of the stored transitions, and walkers that may be broadcast.
PART_ROWS, BROADCAST_WALKERS = 500_000, 100_000
CHECK_EVERY = 2      # jobs between two looks at the visited states; further steps only add later visits
QUIET_STEPS = 32     # steps without a new state before reachability is tested; doubles after every test
TRAIL = "array<struct<step:bigint,state:bigint>>"


def _counts(transitions: DataFrame) -> DataFrame:
    return transitions.groupBy("src").agg(F.count(F.lit(1)).alias("cnt"))


def choose_std(walkers: DataFrame, transitions: DataFrame, counts: DataFrame, seed, step_col: str = "step") -> DataFrame:
    """One uniform transition per walker: (walker, state) -> (walker, state).
    A state without transitions keeps its walker where it is."""
    w = walkers.join(counts, walkers.state == counts.src, "left").drop("src")
    w = w.withColumn("pick", F.when(F.col("cnt") > 0, F.pmod(hash_key(seed, "walker", step_col), F.col("cnt")) + 1))
    t = transitions.select(F.col("src").alias("state"), F.col("rank").alias("pick"), F.col("dst"))
    return (w.join(t, ["state", "pick"], "left")
             .select("walker", F.coalesce("dst", "state").alias("state")))


def choose_constraint(walkers: DataFrame, transitions: DataFrame, counts: DataFrame, expanded: DataFrame,
                      seed, step_col: str = "step") -> DataFrame:
    """Uniform choice among transitions that lead to states not yet
    expanded (``expanded``: state); when every transition leads to an
    expanded state, uniform among all of them."""
    cand = (walkers.join(transitions.select(F.col("src").alias("state"), "rank", "dst"), "state")
                   .join(expanded.select(F.col("state").alias("dst")).distinct(), "dst", "left_anti"))
    cand = cand.withColumn("crn", F.row_number().over(Window.partitionBy("walker").orderBy("rank")))
    ccnt = cand.groupBy("walker").agg(F.count(F.lit(1)).alias("ccnt"))
    w = walkers.join(ccnt, "walker", "left").withColumn(
        "cpick", F.when(F.col("ccnt") > 0, F.pmod(hash_key(seed, "walker", step_col), F.col("ccnt")) + 1))
    fresh = (w.where(F.col("cpick").isNotNull())
              .join(cand.select("walker", F.col("crn").alias("cpick"), "dst"), ["walker", "cpick"])
              .select("walker", F.col("dst").alias("state")))
    rest = choose_std(w.where(F.col("cpick").isNull()).select("walker", "state", step_col), transitions, counts, seed,
                      step_col)
    return fresh.unionByName(rest)


# ------------------------------------------------------------------ transition tables

def with_sinks(transitions: DataFrame, states: DataFrame) -> DataFrame:
    """``(src, rank, dst, cnt)`` with one transition to itself for each of
    ``states(src)`` that has none, so that its walker stays."""
    t = transitions.select("src", "rank", "dst")
    t = t.withColumn("cnt", F.count(F.lit(1)).over(Window.partitionBy("src")))
    stay = states.select("src").distinct().join(t, "src", "left_anti")
    return t.unionByName(stay.select("src", F.lit(1).alias("rank"), F.col("src").alias("dst"), F.lit(1).cast("long").alias("cnt")))


class EagerTable:
    """All transitions, written once, in parts by hash of ``src``."""

    steps = STEPS_A_JOB

    def __init__(self, transitions: DataFrame, extra: list[int] = ()):
        spark = transitions.sparkSession
        t = cut_lineage(transitions.select("src", "rank", "dst"))
        more = spark.createDataFrame([(int(s),) for s in extra], "src long")
        rows, self.n = t.agg(F.count(F.lit(1)), F.max("rank")).first()
        self.parts = max(1, -(-rows // PART_ROWS))
        folder = shared_path(spark, "transitions")
        laid = with_sinks(t, t.select(F.col("dst").alias("src")).unionByName(more)).withColumn("part", self.part_of("src"))
        laid.repartition(self.parts, "part").write.partitionBy("part").parquet(folder)
        self.states = t.where("rank = 1").select("src")
        self._table = spark.read.schema("src long, rank int, dst long, cnt long, part int").parquet(folder)

    def part_of(self, state: str | Column) -> Column:
        return F.pmod(F.xxhash64(state), F.lit(self.parts)).cast("int")

    def of(self, states: DataFrame) -> DataFrame:
        """The transitions of at least ``states(state)``."""
        return self._table


class LazyTable:
    """Transitions searched on demand.  ``search(states)`` returns ``(src,
    rank, dst)`` for ``states(state)``; what it finds is appended to a table
    in the shared checkpoint folder, and no state is searched twice."""

    steps = 1

    def __init__(self, spark: SparkSession, search: Callable[[DataFrame], DataFrame]):
        self.search, self.folder, self.searches, self.searched = search, shared_path(spark, "lazy"), 0, 0
        self._schema = "src long, rank int, dst long, cnt long"
        spark.createDataFrame([], self._schema).write.parquet(self.folder)
        self._spark, self.n = spark, None

    @property
    def _table(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(self.folder)

    def of(self, states: DataFrame) -> DataFrame:
        """The transitions of at least ``states(state)``; searches the new ones."""
        known = self._table.select(F.col("src").alias("state"))
        new = cut_lineage(states.select("state").distinct().join(known, "state", "left_anti"))
        n = new.count()
        if n:
            self.searches, self.searched = self.searches + 1, self.searched + n
            found = cut_lineage(with_sinks(self.search(new), new.select(F.col("state").alias("src"))))
            if self.n is None:
                self.n = found.agg(F.max("rank")).first()[0]
            found.select("src", F.col("rank").cast("int").alias("rank"), "dst", "cnt").write.mode("append").parquet(self.folder)
        return self._table


def _small(w: DataFrame, walkers: int) -> DataFrame:
    """Broadcast a walker table of checked size (the filter lets the parts be pruned)."""
    return F.broadcast(w.where("walker >= 0")) if walkers <= BROADCAST_WALKERS else w


def advance(w: DataFrame, table, walkers: int, picks: list[tuple[int, Column]]) -> DataFrame:
    """Walkers ``(walker, state)`` after the given steps; ``picks`` has each
    step's number and draw.  Adds ``trail``, the states passed."""
    w = w.select("walker", "state", F.array().cast(TRAIL).alias("trail"))
    for step, draw in picks:
        t = table.of(w)
        m = _small(w.withColumn("draw", draw), walkers)
        on = (t["src"] == m["state"]) & (t["rank"] == F.pmod(m["draw"], t["cnt"]) + 1)
        if "part" in t.columns:
            on = on & (t["part"] == table.part_of(m["state"]))
        w = t.join(m, on).select("walker", t["dst"].alias("state"), F.concat(
            "trail", F.array(F.struct(F.lit(step).cast("long").alias("step"), t["dst"].alias("state")))).alias("trail"))
    return w


def advance_constraint(w: DataFrame, table, walkers: int, step: int, draw: Column, expanded: DataFrame) -> DataFrame:
    """One step that prefers states outside ``expanded(state)``."""
    t = table.of(w)
    m = _small(w.select("walker", "state"), walkers)
    on = t["src"] == m["state"]
    if "part" in t.columns:
        on = on & (t["part"] == table.part_of(m["state"]))
    cand = t.join(m, on).select("walker", "rank", "dst")
    known = expanded.select(F.col("state").alias("dst"), F.lit(True).alias("known")).distinct()
    cand = cand.join(known, "dst", "left").withColumn("to", F.struct("rank", "dst"))
    # a walker has as many candidates as its state has transitions
    lists = cand.groupBy("walker").agg(F.sort_array(F.collect_list("to")).alias("every"),
                                       F.sort_array(F.collect_list(F.when(F.col("known").isNull(), F.col("to")))).alias("fresh"))
    pool = F.when(F.size("fresh") > 0, F.col("fresh")).otherwise(F.col("every"))
    got = lists.withColumn("pool", pool).select(
        "walker", F.get("pool", F.pmod(draw, F.size("pool")).cast("int"))["dst"].alias("state"))
    return got.select("walker", "state", F.array(F.struct(F.lit(step).cast("long").alias("step"), F.col("state").alias("state"))).alias("trail"))


# ------------------------------------------------------------------ starts

def state_at(states: DataFrame, n: int, index: DataFrame) -> DataFrame:
    """``index(walker, idx)`` -> ``(walker, state)``: the state at place
    ``idx`` (from 0) of all ``states(src)`` in ascending order."""
    from tripleselect.operators.select import rank_within
    lo, hi = states.agg(F.min("src"), F.max("src")).first()
    if lo == 0 and hi == n - 1:                     # dense ids: the place is the id
        return index.select("walker", F.col("idx").alias("state"))
    place = rank_within(states.select("src").distinct(), [], ["src"]).select((F.col("rank") - 1).alias("idx"), F.col("src").alias("state"))
    return index.join(place, "idx").select("walker", "state")


def init_walkers(table, states: DataFrame, n_rows: int, x0: int, walkers: int, seed, init: str = "chain",
                 vectors: DataFrame | None = None, n: int = 1, id_col: str = "triple_id", vec_col: str = "vec") -> DataFrame:
    """(walker, state) for ``walkers`` walkers.

    ``chain``: walker i is a uniform transition of walker i - 1;
    ``mean``: walker i is drawn from the ``n`` antipodal neighbours of the mean
    of walkers i - 1 and i - 2 (one search of one vector per hop);
    ``random``: uniform states."""
    spark = states.sparkSession
    if init == "random":
        draws = spark.range(walkers).select(F.col("id").alias("walker"), F.pmod(hash_key(f"{seed}:init", "id"), F.lit(n_rows)).alias("idx"))
        return state_at(states, n_rows, draws)
    at = [int(x0)]

    def pick(i: int) -> Column:
        return hash_key(f"{seed}:init", F.lit(i), F.lit(0))

    def hops(first: int, last: int) -> None:
        one = spark.createDataFrame([(0, at[-1])], "walker long, state long")
        got = advance(one, table, 1, [(i, pick(i)) for i in range(first, last)]).first()
        at.extend(int(s["state"]) for s in got["trail"])

    if init == "mean":
        if walkers > 1:
            hops(1, 2)
        for i in range(2, walkers):
            from tripleselect.operators.neighbors import exact_neighbors
            pair = vectors.where(F.col(id_col).isin(at[i - 1], at[i - 2])).agg(
                F.max(F.when(F.col(id_col) == at[i - 1], F.col(vec_col))).alias("a"),
                F.max(F.when(F.col(id_col) == at[i - 2], F.col(vec_col))).alias("b"))
            q = pair.select(F.lit(-1).cast("long").alias(id_col), mean_vector("a", "b").alias(vec_col))
            nb = exact_neighbors(q, vectors.select(id_col, vec_col), n, largest=False, id_col=id_col, vec_col=vec_col)
            nb = nb.withColumn("cnt", F.count(F.lit(1)).over(Window.partitionBy("src")))
            at.append(int(nb.where(F.col("rank") == F.pmod(pick(i), F.col("cnt")) + 1).first()["dst"]))
    else:
        for first in range(1, walkers, 2 * table.steps):
            hops(first, min(first + 2 * table.steps, walkers))
    return spark.createDataFrame(list(enumerate(at)), "walker long, state long")


# ------------------------------------------------------------------ walks

def can_grow(walkers: DataFrame, table, visited: DataFrame) -> bool:
    """Whether a state outside ``visited`` can be reached from the walkers."""
    seen = front = cut_lineage(walkers.select("state").distinct())
    while True:
        t = table.of(front)
        front = cut_lineage(t.join(front.select(F.col("state").alias("src")), "src", "left_semi")
                            .select(F.col("dst").alias("state")).distinct().join(seen, "state", "left_anti"))
        if front.isEmpty():
            return False
        if not front.join(visited.select("state"), "state", "left_anti").isEmpty():
            return True
        seen = cut_lineage(seen.unionByName(front))


def first_visits(visits: DataFrame) -> DataFrame:
    """The first of the ``visits(walker, state, step)`` of each state."""
    return (visits.groupBy("state").agg(F.min(F.struct("step", "walker")).alias("f"))
                  .select("f.walker", "state", "f.step"))


def doubled_walk(table: EagerTable, walkers: DataFrame, k: int, max_steps: int | None = None) -> tuple[DataFrame, int, bool]:
    """``(first visits, steps, complete)`` of walkers over a table with one
    transition a state.

    One table holds every state's place after 2^j steps and, for states
    visited within the first 2^j steps, the first visit.  Joining it with
    itself doubles both: a visit of ``x`` at step ``t`` is one of the place of
    ``x`` at ``t + 2^j``.  Later visits of a state are dropped with what
    follows them, since an earlier visit is followed by the same states.  It
    ends when ``k`` states are visited or a doubling finds no other.
    """
    t = table.of(walkers).select(F.col("src").alias("state"), F.col("dst").alias("to"))
    first = (walkers.join(t, "state").select("walker", F.col("to").alias("state"), F.lit(1).cast("long").alias("step")))
    first = first_visits(first).select("state", F.struct("step", "walker").alias("seen"))
    now = cut_lineage(t.join(first, "state", "left"))
    length, have, complete = 1, -1, False
    while True:
        n = now.where("seen IS NOT NULL").count()
        complete = n >= k
        if complete or n == have or (max_steps is not None and length >= max_steps):
            break
        have = n
        far = now.select(F.col("state").alias("to"), F.col("to").alias("next"))
        moved = now.join(far, "to")
        visit = moved.where("seen IS NOT NULL").groupBy(F.col("to").alias("state")).agg(
            F.min(F.struct((F.col("seen.step") + length).alias("step"), F.col("seen.walker").alias("walker"))).alias("later"))
        now = cut_lineage(moved.select("state", "next", "seen").join(visit, "state", "left")
                               .select("state", F.col("next").alias("to"), F.least("seen", "later").alias("seen")))
        length *= 2
    visits = now.where("seen IS NOT NULL").select("seen.walker", "state", "seen.step")
    if max_steps is not None:
        visits = visits.where(F.col("step") <= max_steps)
        complete = complete and visits.count() >= k
    last = visits.agg(F.max("step")).first()[0] or 0
    return visits, (last if max_steps is None or last < max_steps else max_steps), complete


def markov_sample(transitions: DataFrame | Callable[[DataFrame], DataFrame], k: int, walkers: int = 1, seed=0,
                  start: int | None = None, init: str = "chain", choice: str = "std", max_rounds: int | None = None,
                  n_rows: int | None = None, vectors: DataFrame | None = None, run_id: str = "markov",
                  id_col: str = "triple_id", vec_col: str = "vec"):
    """Walk until ``k`` distinct states are visited, no other state can be
    reached, or the caller's ``max_rounds`` (none by default) are over.
    Returns (samples(run_id, ordinal, triple_id), run dict).

    ``transitions`` is a table ``(src, rank, dst)`` or, for a lazy walk, a
    search ``states(state) -> (src, rank, dst)``; a lazy walk takes its states
    from ``vectors``.  The run says how many states were searched."""
    t0 = time.time()
    lazy = callable(transitions)
    spark = vectors.sparkSession if lazy else transitions.sparkSession
    ensure_checkpoint_dir(spark)
    if lazy:
        table = LazyTable(spark, transitions)
        states = vectors.select(F.col(id_col).alias("src"))
    else:
        table = EagerTable(transitions, [] if start is None else [start])
        states = table.states
    if n_rows is None:
        n_rows = states.count()
    if start is None:
        from tripleselect.operators.accept import draw_idx
        at = spark.createDataFrame([(0, draw_idx(f"{seed}:start", 0, n_rows))], "walker long, idx long")
        start = state_at(states, n_rows, at).first()["state"]
    w = cut_lineage(init_walkers(table, states, n_rows, start, walkers, seed, init, vectors, table.n or 1, id_col, vec_col))
    run = dict(run_id=run_id, sampler="markov")
    if not lazy and table.n == 1:
        visited, step, complete = doubled_walk(table, w, k, max_rounds)
    else:
        visited, step, complete = _stepped_walk(table, w, k, walkers, seed, choice, max_rounds)
    # the first k states are cut out before they are numbered; the k-th one's step is the last step that counts
    kept = cut_lineage(visited.select("state", F.struct("step", "walker").alias("f")).orderBy("f.step", "f.walker").limit(k))
    if complete:
        step = int(kept.agg(F.max("f.step")).first()[0])
    samples = kept.select(F.lit(run_id).alias("run_id"),
                          F.row_number().over(Window.orderBy("f.step", "f.walker")).alias("ordinal"),
                          F.col("state").alias(id_col))
    if lazy:
        run["searched"] = table.searched
    return samples, run | dict(steps=step, complete=complete, seconds=time.time() - t0)


def _stepped_walk(table, w: DataFrame, k: int, walkers: int, seed, choice: str,
                  max_rounds: int | None) -> tuple[DataFrame, int, bool]:
    """``(first visits, steps, complete)``, a few steps a job."""
    expanded, visited = w.select("state"), None
    step = before = checked = quiet = 0
    wait = QUIET_STEPS
    for job in itertools.count(1):
        n = 1 if choice == "constraint" else table.steps
        n = min(n, (max_rounds or step + n) - step)
        picks = [(s, hash_key(seed, "walker", F.lit(s))) for s in range(step + 1, step + n + 1)]
        # the next walker table is built from this one, so its lineage is cut; it holds one row per walker
        if choice == "constraint":
            w = cut_lineage(advance_constraint(w, table, walkers, *picks[0], expanded))
            expanded = expanded.unionByName(w.select("state"))
        else:
            w = cut_lineage(advance(w, table, walkers, picks))
        step += n
        passed = w.select("walker", F.explode("trail").alias("v")).select("walker", "v.state", "v.step")
        visited = passed if visited is None else visited.unionByName(passed)
        if job % CHECK_EVERY and step != max_rounds:
            continue
        visited = cut_lineage(first_visits(visited))      # only a state's first visit counts
        if choice == "constraint":
            expanded = cut_lineage(expanded.distinct())
        have = visited.count()
        if have >= k or step == max_rounds:
            return visited, step, have >= k
        quiet, before, checked = (quiet + step - checked if have == before else 0), have, step
        if quiet >= wait:
            if not can_grow(w, table, visited):
                return visited, step, False
            wait *= 2
