"""Prefix trie, token counts and hard negatives against brute force."""
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleselect.llm import hard_negatives, prefix_trie, token_counts
from tripleselect.llm.queries import tokenizer_path

WORDS_FILE = "word_bpe_49k.json"


# ---- prefix trie

def md5_key(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, md5_key(role or "", text or ""), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    new = {}
    for c, q in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        new[c] = own.get(base, [])[:h] + q[h:]
    members = {}
    for c, q in new.items():
        for d in range(len(q) + 1):
            members.setdefault(tuple(q[:d]), []).append(c)
    children = {}
    for n in members:
        if n:
            children.setdefault(n[:-1], []).append(n)
    out = []
    for n, cs in members.items():
        below = [x for x in members if x[:len(n)] == n]
        ends = sorted(c for c in cs if len(new[c]) == len(n))
        out.append((min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), len(children.get(n, [])),
                    sum(x not in children for x in below),
                    sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit("x"))
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(df))
    return sorted((tuple(r)[1:] for r in got.collect()), key=str)


def test_trie_odd_rows(spark):
    long_one = [(7, i, "user", f"turn {i}") for i in range(700)]
    rows = [(0, 1, "user", "hello"), (0, None, "system", "first"), (0, 2, None, "x"), (1, 0, "user", None), (1, 0, "user", None),
            (2, 5, "user", "é" * 5000), (None, 0, "user", "no id"), (-3, 0, "a", "b"), (103, 0, "user", "hello"),
            (104, 0, None, None), (105, 3, "user", "tie b"), (105, 3, "user", "tie a")] + long_one
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_without_rows(spark):
    assert trie_rows(spark, []) == []
    assert trie_rows(spark, [(None, 1, "a", "b")]) == []


def test_trie_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", 60)
    rnd = random.Random(3)
    rows = []
    for c in range(400):                     # a third of all conversations are copies of one
        n = 3 if c % 3 == 0 else rnd.randint(1, 7)
        for t in range(n):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"same {t}" if c % 3 == 0 else f"say {rnd.randint(0, 2)}"))
    rnd.shuffle(rows)
    assert trie_rows(spark, rows) == brute_trie(rows)


# ---- token counts

def library(texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path(WORDS_FILE))
    return [len(e.ids) for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_of_odd_rows(spark, odd, empty):
    got = token_counts.with_token_counts(odd.withColumn("n_bytes", F.lit(-1)), tokenizer_path(WORDS_FILE), name="tokens")
    assert got.columns == [*odd.columns, "n_bytes", "tokens"]
    rows = got.collect()
    assert len(rows) == 8 and [r.tokens for r in rows] == library([r.text for r in rows])
    assert token_counts.with_token_counts(empty, tokenizer_path(WORDS_FILE)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_counts_equal_the_library(seed):
    rnd = random.Random(seed)
    pools = ["abcdefghijklmnopqrstuvwxyz", "aeinrst'", "abc '’", "0123 a'", "é ü ñ ß İ Σ ς ΑΣ", "日本語 한국 ١٢ Ⅷ ½ ²",
             "́ë å   \u0085​", "!?.,;:'\"-_*#<|>/w", "😀👍🏽", "ABC DÉF' ", "'re've'll's't'm'd "]
    specials = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext|", "</w>"]
    texts = []
    for _ in range(1500):
        pool = "".join(rnd.sample(pools, rnd.randint(1, 4)))
        t = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 80)))
        texts.append(t + rnd.choice(specials) + t[:5] if rnd.random() < 0.2 else t)
    got = token_counts.compiled(tokenizer_path(WORDS_FILE)).counts(texts)
    assert got.tolist() == library(texts)


def test_counts_do_not_depend_on_chunks_and_slices(monkeypatch):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("ab're 1!é\n") for _ in range(rnd.randint(0, 900))) for _ in range(60)] + ["x" * 3000, None, ""]
    machine = token_counts.compiled(tokenizer_path(WORDS_FILE))
    whole = machine.counts(texts).tolist()
    assert whole == library(texts)
    for chunk, size in ((1, 50), (7, 64), (64, 1000)):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        monkeypatch.setattr(token_counts, "SLICE", size)
        assert machine.counts(texts).tolist() == whole


def test_full_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 20)
    machine = token_counts.Compiled(tokenizer_path(WORDS_FILE))
    texts = ["one two three four five six seven eight nine ten", "eleven twelve thirteen", "one, two"]
    assert machine.counts(texts).tolist() == library(texts)


def test_other_tokenizer_files_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        token_counts.Compiled(tokenizer_path("byte_bpe_50k.json"))


def test_state_maps_compose():
    nxt, _ = token_counts.splitter()
    rnd = np.random.default_rng(0)
    maps = rnd.integers(0, token_counts.N_STATES, (token_counts.N_STATES, 37)).astype(np.uint8)
    state, want = token_counts.BETWEEN, []
    for k in range(37):
        want.append(state)
        state = maps[state, k]
    assert token_counts.compose(maps).tolist() == want


# ---- hard negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank string"


def brute_negatives(rows):
    clean, anchors = {}, {}
    for i, v, lab in rows:
        if i is None or v is None or lab is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        key = (lab, tuple(np.floor(256 * np.float32(v).astype(float))))
        clean.setdefault(i, set()).add(key)
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, key), key)

    def dot(a, b):
        return int(sum(x * y for x, y in zip(a, b)))

    out = []
    for a, (lab, va) in anchors.items():
        def best(same):
            s = {}
            for i, vs in clean.items():
                for lb, v in vs:
                    if i != a and (lb == lab) == same:
                        s[i] = max(s.get(i, -10**18), dot(va, v))
            return s
        pos = sorted(best(True).items(), key=lambda x: (-x[1], x[0]))[:5]
        for p, ps in pos:
            ok = {}
            for i, vs in clean.items():
                for lb, v in vs:
                    ns = dot(va, v)
                    if i != a and lb != lab and 30 * ps <= 100 * ns <= 90 * ps:
                        ok[i] = max(ok.get(i, -10**18), ns)
            for r, (i, ns) in enumerate(sorted(ok.items(), key=lambda x: (-x[1], x[0]))[:10], 1):
                out.append((a, p, r, i, ps, ns))
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, 1.5, "x") for r in rows], SCHEMA)
    part = hard_negatives.taking_part(df)
    got = hard_negatives.hard_negatives(part, part.where(F.col("vec_id") % 100 == 0))
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("dims", [3, 24])
def test_negatives_against_brute_force(spark, monkeypatch, dims):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 64)
    rnd = np.random.default_rng(dims)
    rows = [(i, rnd.normal(0.2, 1, dims).astype(np.float32).tolist(), int(rnd.integers(0, 4))) for i in range(900)]
    same = rows[100][1]
    rows += [(900 + i, same, i % 4) for i in range(150)]          # a group of copies: ties
    assert mined(spark, rows) == brute_negatives(rows)


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [[1.0, 0.5, 0.25], [0.9, 0.5, 0.25], [0.5, 0.5, 0.5], [0.6, 0.1, 0.0], [0.4, 0.4, 0.1]]
    rows = [(0, v[0], 1), (0, v[1], 1), (1, v[1], 1), (1, v[1], 1), (2, v[2], 2), (2, v[2], 2), (3, v[3], 2), (4, v[4], 3),
            (5, [nan, 1.0, 1.0], 2), (6, [inf, 1.0, 1.0], 2), (7, [None, 1.0, 1.0], 2), (8, None, 2), (9, v[2], None),
            (None, v[2], 2), (10, [0.7], 2), (11, [], 2), (12, v[2] + [9.0], 3), (100, [-1.0, -0.5, -0.25], 1), (200, v[2], 9)]
    assert mined(spark, rows) == brute_negatives(rows)
    assert mined(spark, [r for r in rows if r[0] not in (0, 100, 200)]) == []
    assert mined(spark, []) == []


def test_negatives_of_several_anchor_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", 200)
    rnd = np.random.default_rng(1)
    rows = [(i * 20, rnd.normal(0.3, 1, 8).astype(np.float32).tolist(), int(rnd.integers(0, 2))) for i in range(60)]
    assert mined(spark, rows) == brute_negatives(rows)


def test_index_prunes_but_loses_nothing():
    rnd = np.random.default_rng(4)
    x, a = rnd.normal(size=(500, 40)).round(2), rnd.normal(size=(30, 40)).round(2)
    x[::7] *= 0.05
    s = hard_negatives.Searches(np.arange(30), np.zeros(30), a, np.arange(30), np.zeros(30), np.zeros(30), np.zeros(30), 5, True,
                                np.full(30, 9.0))
    s.prepare()
    ai, xi, score = hard_negatives.pairs_above(s, np.ascontiguousarray(x[:, s.order]))
    full = a @ x.T
    assert sorted(zip(ai, xi)) == sorted(zip(*np.nonzero(full >= 9.0)))
    assert np.allclose(score, full[ai, xi])


def test_language_calibration_uses_every_row_left_out(spark):
    from tripleselect.llm import language_id
    rows = spark.range(12000).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("x"), *[F.substring(F.md5((F.col("id") * 7 + i).cast("string")), 1, 6) for i in range(3)]).alias("text"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("lang")).repartition(4)
    model = language_id.build_model(language_id.count_grams(rows, F.lit(False)).select("lang", "gram", "n").toPandas())
    found = language_id.calibration(rows, model)
    cal = found.toPandas()
    assert len(cal) == 12000                                # more than the 4000 rows that were once enough
    own = {name: part["own"].to_numpy() for name, part in cal.groupby("lang")}
    got, total = language_id.upper_limits(found), language_id.total_losses(found)
    for name in ("a", "b"):
        assert abs(got[name] - np.quantile(own[name], language_id.REJECT_QUANTILE)) < 1e-9
    all_rows = rows.toPandas()
    h, n = model.entropies(list(all_rows["text"]))
    truth = np.array([model.langs.index(x) for x in all_rows["lang"]])
    z = -(h - h.min(axis=1, keepdims=True)) * np.sqrt(n)[:, None]
    for i, s in enumerate(language_id.SCALES):
        want = (np.log(np.exp(z * s).sum(axis=1)) - z[np.arange(len(z)), truth] * s).mean()
        assert abs(total[i] / language_id.LOSS_PARTS / 12000 - want) < 1e-9
