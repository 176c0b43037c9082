"""Readers and writers: TSV triples with awkward text, dense ids, runs."""
from pyspark.sql import functions as F

from tripleselect.sources.io import read_runs, read_triples, with_triple_id, write_run, write_triples


def test_tsv_roundtrip_keeps_awkward_text(spark, tmp_path):
    rows = [("q\tone", 'say "hi"', None), ("line\nbreak", "", "plain"), ("x", "y", "z")]
    df = spark.createDataFrame(rows, "query string, psg_pos string, psg_neg string")
    path = str(tmp_path / "t")
    write_triples(df.coalesce(1), path, kind="text")
    back = read_triples(spark, path, kind="text").orderBy("triple_id").collect()
    assert [r.triple_id for r in back] == [0, 1, 2]
    got = {(r.query, r.psg_pos, r.psg_neg) for r in back}
    assert got == {("q one", 'say "hi"', ""), ("line break", "", "plain"), ("x", "y", "z")}


def test_with_triple_id_is_dense(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 3).alias("v"))
    ids = with_triple_id(df)
    r = ids.agg(F.min("triple_id"), F.max("triple_id"), F.countDistinct("triple_id")).first()
    assert tuple(r) == (0, 999, 1000)


def test_runs_roundtrip_and_pruning(spark, tmp_path):
    s = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("b", 1, 9)], "run_id string, ordinal long, triple_id long")
    r = spark.createDataFrame([("a", 3), ("b", 1)], "run_id string, steps long")
    write_run(s, r, str(tmp_path / "runs"), mode="overwrite")
    ss, rr = read_runs(spark, str(tmp_path / "runs"), ["a"])
    assert sorted((x.ordinal, x.triple_id) for x in ss.collect()) == [(1, 5), (2, 7)]
    assert [x.steps for x in rr.collect()] == [3]


def test_ids_follow_path_and_line(spark, tmp_path):
    from tripleselect.sources.io import read_triples
    want = []
    for name, n in (("a", 2), ("b", 50), ("c", 10)):
        rows = [f"{name}{i}\tp\tn" for i in range(n)]
        (tmp_path / f"{name}.tsv").write_text("\n".join(rows) + "\n")
        want += [r.split("\t")[0] for r in rows]
    got = read_triples(spark, str(tmp_path), kind="ids").orderBy("triple_id").collect()
    assert [r.triple_id for r in got] == list(range(62)) and [r.qid for r in got] == want
