"""BM25 counts and scores against plain Python, on odd rows."""
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tripleselect.functions.text import KEEP_CHARS_PATTERN, clean_text, tokens
from tripleselect.operators import bm25

ODD = "Ünïted\tsta\ntes  a_b [x] `y` {z} @A-Z~ \x00\x7f 𝒳12 é"
ROWS = [  # triple_id, side, cluster, query, passage
    (1, "pos", 0, "red fish Blue", "a red red fish"), (1, "neg", 0, "red fish Blue", "blue blue, BLUE sky"),
    (2, "pos", 0, "red red", "nothing here"), (3, "pos", 1, ODD, ODD + " a b"), (3, "neg", 1, None, "red"),
    (4, "pos", 1, "", None), (5, "pos", None, "red", "red"), (None, "pos", 0, "red", "red"), (6, "pos", 1, "red a", "red"),
    (6, "pos", 1, "red a", "a a"), (7, "neg", 1, "red", " ")]


def _toks(x):
    return re.sub("[^A-Za-z0-9 ]+", "", x or "").lower().split()


def _scores(rows, scoped):
    scopes = {}
    for i, side, c, _, p in rows:
        scopes.setdefault((c, side) if scoped else (), []).append(_toks(p))
    out = Counter()
    for i, side, c, q, p in rows:
        texts, t = scopes[(c, side) if scoped else ()], _toks(p)
        avgdl = sum(map(len, texts)) / len(texts)
        qtf, tf = Counter(_toks(q)), Counter(t)
        for w in qtf.keys() & tf.keys() if not (scoped and c is None) else ():
            df = sum(w in x for x in texts)
            out[i, side] += (qtf[w] * math.log2((len(texts) - df + 0.5) / (df + 0.5)) * tf[w] * 2.2
                             / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / avgdl)))
    return sorted(((i or -1, s, round(0.0 if i is None else out[i, s], 6) + 0.0) for i, s, *_ in rows))


@pytest.mark.parametrize("scoped", [False, True])
def test_pairs_equal_plain_counting_over_small_slices(spark, monkeypatch, scoped):
    monkeypatch.setattr(bm25, "SLICE_BYTES", 16)
    pairs = spark.createDataFrame(ROWS, "triple_id long, side string, cluster_id int, query string, passage string").coalesce(1)
    scope = ("cluster_id", "side") if scoped else ()
    st = bm25.bm25_stats(pairs.withColumn("text", F.col("passage")), "text", scope, vocab=bm25.query_vocab(pairs))
    got = bm25.bm25_pairs(pairs, st).collect()
    assert sorted((r.triple_id or -1, r.side, round(r.score, 6) + 0.0) for r in got) == _scores(ROWS, scoped)


def test_texts_are_not_tokenised_in_the_jvm_for_pairs(spark, monkeypatch):
    """The pairs' passages are read once for statistics and once for what they share."""
    calls = []
    whole = bm25._toks
    monkeypatch.setattr(bm25, "_toks", lambda c: calls.append(c) or whole(c))
    pairs = spark.createDataFrame(ROWS, "triple_id long, side string, cluster_id int, query string, passage string")
    st = bm25.bm25_stats(pairs.withColumn("text", F.col("passage")), "text", vocab=bm25.query_vocab(pairs))
    bm25.bm25_pairs(pairs, st).collect()
    assert calls == ["query"]


def test_cleaner_keeps_letters_digits_and_blanks_only(spark):
    every = [chr(i) for i in [*range(0x3000), 0xD7FF, 0xE000, 0xFFFD, 0xFFFF, 0x10000, 0x1D4B3, 0x10FFFF]]
    df = spark.createDataFrame([(f"a{c}b",) for c in every], "text string")
    got = df.select("text", clean_text("text").alias("c")).collect()
    assert all(r.c == re.sub("[^A-Za-z0-9 ]+", "", r.text) for r in got)
    assert re.compile(KEEP_CHARS_PATTERN.replace(r"\x{10FFFF}", chr(0x10FFFF))).sub("", "a-Z é 9") == "aZ  9"
    assert spark.createDataFrame([(ODD,)], "text string").select(tokens(clean_text("text"))).first()[0] == _toks(ODD)
