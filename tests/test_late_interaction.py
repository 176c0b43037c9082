"""MaxSim over stored blocks against the join of all token pairs."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleselect.functions.vectors import dot
from tripleselect.operators import evaluate as ev
from tripleselect.operators import neighbors

TOKENS = "id long, tok int, vec array<float>"


def joined(pairs, qt, dt, key):
    """Every pair expanded to its token pairs."""
    per = (pairs.select(*dict.fromkeys([*key, "qid", "docno"])).join(qt.select("qid", F.col("tok").alias("qtok"), F.col("vec").alias("qv")), "qid")
                .join(dt.select("docno", F.col("vec").alias("dv")), "docno")
                .groupBy(*key, "qtok").agg(F.max(dot("qv", "dv")).alias("best")))
    return per.groupBy(*key).agg(F.sum("best").alias("score"))


def tables(spark):
    rng = np.random.default_rng(3)
    rows = [(i, t, [float(x) for x in rng.normal(size=4)]) for i in range(40) for t in range(1 + i % 3)]
    rows += [(3, 0, [9.0, 0.0, 0.0, 0.0]), (5, None, [1.0] * 4), (5, None, [2.0] * 4), (6, 9, None), (7, 9, [1.0]), (8, 9, []),
             (9, 9, [1.0, None, 1.0, 1.0]), (None, 0, [1.0] * 4), (41, 0, None), (42, 0, [float("nan")] * 4)]
    tok = spark.createDataFrame(rows, TOKENS)
    pairs = [(k, "x", int(q), int(d)) for k, (q, d) in enumerate(rng.integers(0, 44, size=(300, 2)))]
    pairs += [(0, "x", 1, 2), (1, None, 1, 2), (None, "x", 3, 8), (2, "y", None, 3), (3, "y", 3, None), *((9, "z", 4, d) for d in range(44))]
    return (spark.createDataFrame(pairs, "k long, side string, qid long, docno long"), tok.withColumnRenamed("id", "qid"),
            tok.withColumnRenamed("id", "docno"))


@pytest.mark.parametrize("key", [("qid", "docno"), ("k", "side")])
def test_maxsim_equals_the_joined_tokens(spark, monkeypatch, key):
    monkeypatch.setattr(ev, "ASKED", 7)
    monkeypatch.setattr(ev, "PRODUCTS", 20)
    monkeypatch.setattr(neighbors, "BLOCK_BYTES", 600)
    pairs, qt, dt = tables(spark)

    def rows(df):
        return sorted(map(str, ([*r[:-1], r[-1] if r[-1] is None else round(r[-1], 9)] for r in df.collect())))
    want = rows(joined(pairs, qt, dt, key))
    assert len(want) > 100 and rows(ev.maxsim(pairs, qt, dt, key)) == want
    assert ev.maxsim(pairs.limit(0), qt, dt, key).count() == 0


def test_maxsim_copies_no_vector_per_pair(spark):
    pairs, qt, dt = tables(spark)
    plan = ev.maxsim(pairs, qt, dt)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Generate" not in plan and "Aggregate" not in plan
