"""The scorer slot of the selection jobs."""
from pyspark.sql import functions as F

from tripleselect.plans import jobs


def test_any_scorer_takes_the_place_of_bm25(spark):
    rows = [(i, "q", "p" * (i % 7 + 1), "n" * (i % 3 + 1)) for i in range(40)]
    triples = spark.createDataFrame(rows, "triple_id long, query string, psg_pos string, psg_neg string")
    groups = triples.select("triple_id", F.pmod("triple_id", F.lit(2)).cast("int").alias("cluster_id"))

    def by_length(pairs):
        return pairs.select("triple_id", "side", F.length("passage").cast("double").alias("score"))

    got = jobs.select_cluster_bm25_margin(triples, groups, 6, 2, scorer=by_length).collect()
    assert len(got) == 6
    score = {i: float(len(p) - len(n)) for i, _, p, n in rows}
    for c in (0, 1):
        mine = sorted((r.rank, r.triple_id, r.score) for r in got if r.cluster_id == c)
        best = sorted((score[i], i) for i in score if i % 2 == c)
        assert all(s == score[i] and best[rank - 1] == (s, i) for rank, i, s in mine)
    assert jobs.select_cluster_bm25(triples, groups, 4, 2, scorer=by_length).count() == 4
