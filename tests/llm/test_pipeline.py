"""The pipeline on a small set of planted documents."""
import pyarrow as pa
import pyarrow.parquet as pq


def test_planted_documents(spark, tmp_path):
    import corpus_pipeline
    words = [f"w{i}" for i in range(4000)]
    docs = [(i, " ".join(words[i * 30:i * 30 + 60]), "en", f"s{i % 3}") for i in range(100)]
    item = " ".join(f"item{i}" for i in range(20))
    docs += [(200, docs[5][1], "en", "s1"), (201, docs[6][1] + " tail", "en", "s1"),
             (202, "start " + item + " end", "en", "s2")]
    docs += [(300 + i, " ".join(words[i:i + 30]) + " idiot scum moron", "en", "s0") for i in range(0, 2000, 50)]
    ids, text, lang, source = zip(*docs)
    pq.write_table(pa.table({"doc_id": ids, "text": text, "lang": lang, "source": source,
                             "n_chars": [len(t) for t in text]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": [item]}), tmp_path / "benchmark.parquet")
    pq.write_table(pa.table({"doc_id": ids, "quality": [1] * len(ids), "toxic": [int(i >= 300) for i in ids]}),
                   tmp_path / "labels.parquet")
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r.doc_id for r in at.select("doc_id").collect()}
    assert seen["toxicity"] == {i for i in ids if i < 300}
    assert seen["near_dedup"] == seen["toxicity"] - {200, 201}
    assert seen["decontaminate"] == seen["near_dedup"] - {202}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= seen["decontaminate"] and out
    assert sorted(r.start for r in out)[0] == 0
