"""Column functions and the documented decisions on reference quirks."""
import hashlib

from pyspark.sql import functions as F

from tripleselect.functions.rand import hash_key
from tripleselect.functions.text import clean_text, run_name, tokens, tsv_safe
from tripleselect.functions.vectors import block_weights, cosine_margin, vector_view
from tripleselect.operators.accept import Schedule, draw_idx


def test_clean_text_deletes_not_replaces(spark):
    df = spark.createDataFrame([("a\tb\nc d!",), (None,)], "t string")
    got = [r.c for r in df.select(clean_text("t").alias("c")).collect()]
    assert got == ["abc d", ""]          # words around tabs/newlines join (P1); null -> '' (D19)


def test_tokens_lower_and_drop_empty(spark):
    df = spark.createDataFrame([("  Hello  World ",)], "t string")
    assert df.select(tokens("t").alias("x")).first().x == ["hello", "world"]


def test_run_name_strips_suffix_not_characters(spark):
    df = spark.createDataFrame([("kpl.100.pkl",), ("plain",)], "f string")
    got = [r.n for r in df.select(run_name("f", "exp").alias("n")).collect()]
    assert got == ["exp.kpl.100", "exp.plain"]   # D12


def test_tsv_safe(spark):
    df = spark.createDataFrame([("a\tb\r\nc",)], "t string")
    assert df.select(tsv_safe("t").alias("x")).first().x == "a b  c"


def test_gamma_clipping():
    assert block_weights(1.0, 1.0, True) == (1.0, 1.0, 0.0)
    assert block_weights(1.0, 1.0, False) == (1.0, 1.0, -1.0)   # D5 reproduces the unclipped value


def test_schedule_uses_previous_step():
    s = Schedule(0.1, -0.1, 10)
    assert s.value(1) == 0.1 and abs(s.value(6) - 0.0) < 1e-15 and s.value(11) == -0.1 and s.value(50) == -0.1


def test_hash_key_is_portable(spark):
    df = spark.range(5).select(hash_key(42, "id").alias("k"), "id")
    for r in df.collect():
        assert r.k == int(hashlib.md5(f"42:{r.id}".encode()).hexdigest()[:15], 16)
    assert draw_idx(42, 7, 10 ** 9) == 1409445407 % 10 ** 9


def test_views_and_margin(spark):
    v = [1.0, 0.0, 1.0, 0.0, 0.0, 1.0]          # dim 2: q=(1,0) p=(1,0) n=(0,1)
    df = spark.createDataFrame([(v,)], "v array<double>")
    r = df.select(vector_view("v", 2, "query").alias("q"), vector_view("v", 2, "pos").alias("p"),
                  vector_view("v", 2, "trunc", 1).alias("t"), cosine_margin("v", 2).alias("m")).first()
    assert r.q == [1.0, 0.0] and r.p == [1.0, 0.0, 1.0, 0.0] and r.t == [1.0, 1.0, 0.0] and r.m == 1.0


def test_a_filter_on_normalised_vectors_computes_a_row_s_norm_once(spark):
    from tripleselect.functions.vectors import dot, with_l2_normalized
    df = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None])], "id long, v array<double>")
    n = with_l2_normalized(df, "v")
    assert [r.v for r in n.orderBy("id").collect()] == [[0.6, 0.8], [0.0, 0.0], None, [1.0, None]]
    plan = n.select("id", dot("v", "v").alias("d")).where("d > 0.5")._jdf.queryExecution().optimizedPlan().toString()
    condition = next(x for x in plan.splitlines() if "Filter" in x)
    assert condition.count("SQRT") == 2          # one for each side of the product
