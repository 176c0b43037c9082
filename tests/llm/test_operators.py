"""Each operator on odd rows, on an empty table, and against brute force."""
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tripleselect.llm import (decontaminate, kd_shards, language_id, line_dedup, mixing, near_dedup, quality_cotrain,
                              quality_rules, token_planes, toxicity)
from tripleselect.llm.common import fold, marked_rows, shared_folder
from tripleselect.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_kd_shards(spark, odd, empty):
    got = kd_shards.with_slots(kd_shards.kd_shards(odd, ["n_chars", "doc_id"], ["source"], shards=3)).collect()
    assert len(got) == 8 and {r.shard for r in got} <= {0, 1, 2}
    assert sorted(r["size"] for r in got) == sorted(len((r.text or "").encode()) + 1 for r in odd.collect())
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert kd_shards.kd_shards(empty, ["n_chars"], ["source"], shards=4).count() == 0
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.repeat(F.lit("x"), 50)).otherwise(
        F.repeat(F.lit("y"), (F.col("id") % 200).cast("int"))).alias("text"), F.lit("s").alias("source"))
    sums = [r[0] for r in kd_shards.kd_shards(many, ["doc_id"], ["source"], shards=8).groupBy("shard").agg(F.sum("size")).select(
        "sum(size)").collect()]
    assert len(sums) == 8 and max(sums) - min(sums) < 0.02 * max(sums)      # two thirds are copies of one text


def test_mixing(spark, odd, empty):
    got = mixing.words_taken(odd).collect()
    assert len(got) == 8 and mixing.words_taken(empty).count() == 0
    assert all(r.taken <= 2 * r["size"] for r in got)
    assert sorted(r["size"] for r in got) == sorted(len(WORD.findall(r.text or "")) for r in odd.collect())
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37).cast("int")).alias("text"),
                                   F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("b"), F.col("id") % 5)).alias("source"))
    rows = mixing.words_taken(docs)
    by = rows.groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r.t - r.target) <= 1 for r in by)
    assert abs(sum(r.target for r in by) - 1.5 * sum(r.source_size for r in by)) < 1e-6
    again = mixing.words_taken(docs.repartition(3))
    assert rows.select("doc_id", "taken").exceptAll(again.select("doc_id", "taken")).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = sum(len(WORD.findall(r.text)) for r in mixed.collect())
    assert words == sum(r.t for r in by)


def test_shards_draw_their_source_counts(spark):
    """Equal shards, exact totals, and counts that scatter as a multinomial draw's do."""
    sources = spark.createDataFrame([(1, 64_000, 96_000.0), (2, 30_000, 20_000.0), (3, 5_000, 10_000.0), (4, 0, 0.0)],
                                    "src long, source_size long, target double")
    slots = mixing.slots_of(sources, 64, 20, 17).cache()
    counts = {(r.shard, r.src): r.slots for r in mixing.shard_counts(slots).collect()}
    total = {s: sum(n for (_, x), n in counts.items() if x == s) for s in (1, 2, 3)}
    words = {r.src: r.w for r in slots.groupBy("src").agg(F.sum("words").alias("w")).collect()}
    assert words == {1: 96_000, 2: 20_000, 3: 10_000}
    sizes = [sum(n for (j, _), n in counts.items() if j == shard) for shard in range(20)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == sum(total.values())
    share = {s: total[s] / sum(sizes) for s in total}
    z = [(counts.get((j, s), 0) - sizes[j] * share[s]) / (sizes[j] * share[s] * (1 - share[s])) ** 0.5 for j in range(20) for s in total]
    assert 0.6 < np.mean(np.square(z)) < 1.5 and max(map(abs, z)) < 4.5
    other = {(r.shard, r.src): r.slots for r in mixing.shard_counts(mixing.slots_of(sources, 64, 20, 18)).collect()}
    assert other != counts


def test_mixed_rows_keep_their_own_columns(spark, odd, empty):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, text, "s", "en", 15, 1, 2, 3, 4), (1, text, "s", "de", 99, 5, 6, 7, 8), (1, text, "t", "fr", 7, 0, 0, 0, 0),
            (1, text, "t", "fr", 7, 0, 0, 0, 0), (None, text, None, "xx", 3, 9, 9, 9, 9), (2, "b c d e", "s", "en", 7, 1, 1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, __id long, "
                                       "__spans long, __key long, __w long")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = mixed.collect()
    known = {(r[0], r[2], r[3], *r[5:]) for r in rows}
    assert {(r.doc_id, r.source, r.lang, *r[5:]) for r in got} <= known
    taken = mixing.words_taken(docs).collect()
    assert sum(len(WORD.findall(r.text)) for r in got) == sum(r.taken for r in taken)
    by = {}
    for r in got:
        by[r.source] = by.get(r.source, 0) + len(WORD.findall(r.text))
    want = {}
    for r in mixing.mix(docs)[0].join(mixing.mix(docs)[2], "src").groupBy("source").agg(F.sum("n").alias("n")).collect():
        want[r.source] = r.n
    assert by == want and {r.lang for r in got if r.source == "s"} == {"en", "de"}
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert all(r.text and WORD.findall(r.text) for r in mixing.mixed_documents(odd).collect())
    assert mixing.mixed_documents(empty).count() == 0


def test_targets_equal_resharing_step_by_step(spark):
    rng = random.Random(8)
    for _ in range(3):
        sizes = {f"s{i:02d}": rng.choice([0, 1, 10, 500, 20_000]) for i in range(9)} | {None: 70}
        names = sorted(k for k in sizes if k) + [None]
        weight = dict(zip(names, (5, 2, 1) * 4))
        open_, want, left = set(names), {}, 1.5 * sum(sizes.values())
        while open_:
            total = sum(weight[k] for k in open_)
            over = [k for k in open_ if left * weight[k] / total > 2 * sizes[k]]
            if not over:
                want |= {k: left * weight[k] / total for k in open_}
                break
            for k in over:
                want[k] = 2.0 * sizes[k]
                open_.remove(k)
            left = 1.5 * sum(sizes.values()) - sum(want.values())
        got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        assert {r.source for r in got} == set(names) and all(abs(r.target - want[r.source]) < 1e-6 for r in got)


def test_swap_or_not_is_a_permutation(spark):
    for n in (1, 2, 7, 100):
        got = mixing.swap_or_not(spark.range(n).select(F.col("id").alias("x")), "x", F.lit(n), F.lit(3)).collect()
        assert sorted(r.x for r in got) == list(range(n))


def test_tiling_against_brute_force():
    def brute(doc, item, least):
        free_d, free_i, out = [True] * len(doc), [True] * len(item), 0
        while True:
            best = (0, 0, 0)
            for j in range(len(item)):
                for i in range(len(doc)):
                    n = 0
                    while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and free_d[i + n] and free_i[j + n]:
                        n += 1
                    if n > best[0]:
                        best = (n, i, j)
            n, i, j = best
            if n < least:
                return out
            out += n
            free_d[i:i + n] = [False] * n
            free_i[j:j + n] = [False] * n
    rng = random.Random(5)
    for _ in range(60):
        item = [rng.randrange(6) for _ in range(rng.randrange(3, 25))]
        cut = rng.randrange(len(item))
        doc = [rng.randrange(6) for _ in range(8)] + item[cut:] + [9] + item[:cut] + [rng.randrange(6) for _ in range(5)]
        tiles = decontaminate.greedy_tiles(np.array(doc), np.array(item), 3)
        assert all(doc[i:i + n] == item[j:j + n] and n >= 3 for i, j, n in tiles)
        # equally long matches may be marked in another order
        assert abs(sum(n for _, _, n in tiles) - brute(doc, item, 3)) <= 3


def test_decontaminate(spark, odd, empty):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (None, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "xx " + item.upper().replace(" ", ", ") + " yy"),
                                  (2, "six seven eight nine ten zz one two three four five"),
                                  (3, "one two three four five and then other words")], "doc_id long, text string")
    got = {r.doc_id: [h.item_id for h in r.hits] for r in decontaminate.with_hits(docs, bench).collect()}
    assert got == {1: ["7"], 2: ["7"], 3: []}
    assert decontaminate.decontaminated(odd, bench).count() == 8
    assert decontaminate.decontaminated(odd, bench).columns == odd.columns
    assert decontaminate.decontaminated(empty, bench).count() == 0
    assert decontaminate.decontaminated(odd, bench.limit(0)).count() == 8


def test_banded_distance_and_links(spark):
    def lev(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    def edit(rng, a, most):
        b = list(a)
        for _ in range(rng.randrange(most + 1)):
            k, r = rng.randrange(len(b) + 1), rng.random()
            b[k:k + (r < 0.7)] = rng.choice("abé") if r > 0.3 else ""
        return "".join(b)
    rng = random.Random(3)
    rows = [(a, edit(rng, a, 4)) for a in ("".join(rng.choice("abé") for _ in range(rng.randrange(15))) for _ in range(600))]
    for r in spark.createDataFrame(rows, "x string, y string").select(
            "x", "y", line_dedup.banded_distance(F.col("x"), F.col("y"), 2).alias("d")).collect():
        assert min(r.d, 3) == min(lev(r.x, r.y), 3)
    lines = sorted({edit(rng, b, 3) for b in ("".join(rng.choice("abcd ") for _ in range(rng.randrange(24, 40)))
                                              for _ in range(40)) for _ in range(4)})
    df = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(lines)], "id long, line string, len int")
    got = {(r.a, r.b): r.distance for r in line_dedup.edit_links(df).collect()}
    want = {(i, j): lev(lines[i], lines[j]) for i in range(len(lines)) for j in range(i + 1, len(lines))
            if min(len(lines[i]), len(lines[j])) >= 24}
    assert got == {k: v for k, v in want.items() if v <= 2}


def test_line_dedup(odd, empty):
    got = line_dedup.document_lines(odd).collect()
    assert len(got) == 7 and sum(not r.kept for r in got) == 2          # the repeated row's line, the repeated line
    assert line_dedup.document_lines(empty).count() == 0


def test_short_lines_join_by_one_edit_for_twelve_characters(spark):
    rng = random.Random(9)
    texts = {"The anhely eran.", "The, anhely eran.", "Heti eror anesti.", "Heti, eror anesti."}
    for n in [*range(9, 28)] * 6:
        base = "".join(rng.choice("abcd ") for _ in range(n))
        texts.add(base)
        for edits in (1, 2, 3):
            t = list(base)
            for _ in range(edits):
                at = rng.randrange(len(t))
                t[at:at + 1] = rng.choice([[], [rng.choice("abcd")], [t[at], rng.choice("abcd")]])
            texts.add("".join(t))
    texts = sorted(texts)

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row = row, [i]
            for j, e in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != e)))
        return row[-1]

    want = {(i, j): d for i, x in enumerate(texts) for j, y in enumerate(texts) if i < j and abs(len(x) - len(y)) <= 2
            and (d := distance(x, y)) <= min(2, max(len(x), len(y)) // 12)}
    assert any(max(len(texts[i]), len(texts[j])) < 24 for i, j in want)
    assert any(len(texts[i]) != len(texts[j]) and max(len(texts[i]), len(texts[j])) in (24, 25) for i, j in want)
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "id long, line string, len int")
    assert {(r.a, r.b): r.distance for r in line_dedup.near_links(df).collect()} == want
    docs = spark.createDataFrame([(1, "The anhely eran.\nto be"), (2, "The, anhely eran.\nto bee")], "doc_id long, text string")
    got = {(r.doc_id, r.line_no): (r.n_links, r.kept) for r in line_dedup.document_lines(docs).collect()}
    assert got == {(1, 0): (1, True), (1, 1): (0, True), (2, 0): (1, False), (2, 1): (0, True)}


def test_prob_minhash_estimates(spark):
    rng = np.random.default_rng(1)
    items = rng.integers(1, 2 ** 62, 60).astype(np.uint64)
    wa, wb = rng.integers(1, 5, 40).astype(float), rng.integers(1, 5, 40).astype(float)
    a, b = items[:40], items[20:]
    won = near_dedup.prob_minhash(np.r_[np.zeros(40, int), np.ones(40, int)], np.r_[a, b], np.r_[wa, wb], 2, 4096)
    x, y = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    both = set(x) & set(y)
    want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in set(x) | set(y)) for i in both)
    assert abs((won[0] == won[1]).mean() - want) < 0.03


def test_near_dedup(spark, odd, empty):
    rng = random.Random(2)
    base = [[f"w{rng.randrange(500)}" for _ in range(120)] for _ in range(30)]
    rows, n = [], 0
    for words in base:
        for k in range(4):
            w = list(words)
            if k:
                w[rng.randrange(len(w))] = f"new{n}"
            if k == 3:
                w = [f"other{n}-{i}" for i in range(50)] + w[:30]
            rows.append((n, " ".join(w)))
            n += 1
    docs = spark.createDataFrame(rows + [rows[0]], "doc_id long, text string")
    got = near_dedup.near_classes(docs).collect()
    assert len(got) == len(rows) + 1
    sh = {i: set(zip(*[t.split()[k:] for k in range(5)])) for i, t in rows}
    cls = {i: i for i in sh}
    for i in sh:
        for j in range(i):
            if len(sh[i] & sh[j]) >= 0.8 * len(sh[i] | sh[j]):
                low = min(cls[i], cls[j])
                cls = {k: low if v in (cls[i], cls[j]) else v for k, v in cls.items()}
    assert {r.doc_id: r.class_id for r in got} == cls
    assert near_dedup.near_deduplicated(docs).count() == len(set(cls.values()))
    assert near_dedup.near_classes(odd).count() == 8
    assert near_dedup.near_deduplicated(odd).count() == 7               # the repeated row goes, null texts stay
    assert near_dedup.near_deduplicated(odd).columns == odd.columns
    assert near_dedup.near_classes(empty).count() == 0


def test_near_dedup_finds_texts_with_a_repeated_passage(spark):
    """Jaccard 0.83, probability Jaccard 0.5 to 0.6: two kinds of similarity, both are to be found."""
    rows = []
    for k in range(20):
        words = [f"t{k}w{i}" for i in range(104)]
        passage = [f"t{k}p{i}" for i in range(16)]
        times = 1 if k % 4 == 3 else (10, 50, 200)[k % 4]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + passage * times))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    sh = {i: set(zip(*[t.split()[k:] for k in range(5)])) for i, t in rows}
    for i in range(0, 40, 2):
        assert len(sh[i] & sh[i + 1]) >= 0.8 * len(sh[i] | sh[i + 1])
    assert got == {i: i - i % 2 for i in sh}


def test_toxicity_and_quality_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 1), (6, 0, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    train = fold(F.col("doc_id"), 5) >= 0
    model = toxicity.fit(odd, labels, train)
    scores = [r[0] for r in odd.select(toxicity.score_column(odd, model)).collect()]
    assert len(scores) == 8 and all(0 <= s <= 1 for s in scores)
    assert toxicity.not_toxic(odd, model).columns == odd.columns
    none = toxicity.fit(empty, labels, train)
    assert toxicity.not_toxic(odd, none).count() == 8
    rows = quality_cotrain.view_rows(odd)
    q = quality_cotrain.fit(rows, labels, train)
    assert q is None and rows.select(quality_cotrain.score_column(rows, q).alias("s")).where("s = 0.5").count() == 8
    assert quality_cotrain.fit(quality_cotrain.view_rows(empty), labels, train) is None


def test_cotraining_learns(spark):
    rows = [(i, " ".join(["clean", "words", "here"] * 9) if i % 4 else " ".join(["ju%%%", "nk###", "$$$a"] * 9), f"s{i % 3}", "en")
            for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 200)], "doc_id long, quality int")
    views = quality_cotrain.view_rows(docs.union(docs.where("doc_id < 3")).withColumn("key", F.lit("clash")))
    m = quality_cotrain.fit(views, labels.union(labels.where("doc_id = 5")), F.lit(True))
    got = views.select("doc_id", quality_cotrain.score_column(views, m).alias("s")).collect()
    assert len(got) == 303 and all((r.s >= 0.5) == (r.doc_id % 4 > 0) for r in got)


def test_cotraining_picks_from_all_unlabelled_texts(spark):
    """The surest texts of each view at both ends, copies once, against a plain sort."""
    rng = np.random.default_rng(0)
    rows = [(int(k), sorted(rng.choice(50, 6, replace=False).tolist()), sorted(rng.choice(20, 3, replace=False).tolist()))
            for k in rng.permutation(500)]
    pool = spark.createDataFrame(rows, "key long, t array<int>, m array<int>").repartition(7)
    models = [(np.r_[rng.normal(size=50), np.zeros(10)], 0.1), (rng.normal(size=20), -0.2)]
    taken, number = {3, 7, 11}, {0: 12, 1: 9}
    got = quality_cotrain.most_confident(pool, models, taken, number)
    for v in (0, 1):
        for y, sign in ((1, 1), (0, -1)):
            z = {k: sign * (models[v][0][f[v]].sum() + models[v][1]) for k, *f in rows if k not in taken}
            want = [k for k in sorted(z, key=lambda k: (-z[k], k)) if z[k] >= quality_cotrain.CONFIDENT][:number[y]]
            mine = got[got["list"] == 2 * v + y].sort_values("rank")["key"].tolist()[:number[y]]
            assert mine == want


def test_language_id(spark, odd, empty):
    en, de = "the house is on the hill and the dog ", "das haus steht auf dem berg und der hund "
    rows = [(i, (en if i % 2 else de) * (1 + i % 3), "en" if i % 2 else "de") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language_id.fit(docs, fold(F.col("doc_id"), 3) != 1)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, m).collect()}
    assert got == {i: lang for i, _, lang in rows}
    # each language's chances of the next symbol add up to one after any context
    ctx = m.keys[len(m.keys) // 2] >> language_id.BITS
    grams = (ctx << language_id.BITS) + np.arange(language_id.CLASSES)
    for k in range(len(m.langs)):
        p = np.exp(m.back[k][ctx] + m.low[k][grams & language_id.SUFFIX]).astype(float)
        at = np.searchsorted(m.keys, grams).clip(max=len(m.keys) - 1)
        known = m.keys[at] == grams
        p[known] = np.exp(m.logp[k][at[known]])
        assert abs(p.sum() - 1) < 1e-3
    out = {r.doc_id: r for r in language_id.identify(odd, m).collect()}
    assert out[2].lang_pred == out[3].lang_pred == out[4].lang_pred == "und" and out[2].score == 0
    none = language_id.fit(empty, F.lit(True))
    assert {r.lang_pred for r in language_id.identify(odd, none).collect()} == {"und"}


def test_language_counts_cover_all_rows_and_whole_texts(spark, monkeypatch):
    texts = ["the cat  sat, on 12 mats", "über straße", "", None, "x" * 50 + " y" * 70, "Ω Ж z"]
    whole = list(language_id.grams(texts))
    monkeypatch.setattr(language_id, "SLICE_CHARS", 7)
    cut = list(language_id.grams(texts))
    want = sorted((int(d), int(k)) for ds, ks in whole for d, k in zip(ds, ks))
    assert len(cut) > 10 and sorted((int(d), int(k)) for ds, ks in cut for d, k in zip(ds, ks)) == want
    # every training row teaches, whatever its hash: one row a language
    for i in range(12):
        docs = spark.createDataFrame([(i, "the house on the hill", "en"), (100 + i, "das haus auf dem berg", "de")],
                                     "doc_id long, text string, lang string")
        assert language_id.fit(docs, F.lit(True)).langs == ["de", "en"]
    counts = language_id.count_grams(docs, F.lit(False)).toPandas()
    brute = {}
    for lang, text in (("en", "the house on the hill"), ("de", "das haus auf dem berg")):
        t = " " + text
        for j in range(1, len(t)):
            g = sum(int(language_id.fold_table()[ord(t[j - k])]) << (language_id.BITS * k) for k in range(4) if j >= k)
            brute[lang, g] = brute.get((lang, g), 0) + 1
    assert {(r.lang, r.gram): r.n for r in counts.itertuples()} == brute and (counts["n"] == counts["kept"]).all()


def test_token_planes_round_trip(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = tokenizer_path()
    tok = Tokenizer.from_file(path)
    extra = odd.select("doc_id", "text").union(spark.createDataFrame(
        [(50, " two  blanks \n x\t\r\n y"), (51, "<|endoftext|> it's 'tis\n\nnew"), (52, "a <|endoftext|> b"),
         (53, "x<|endoftext|>")], "doc_id long, text string"))
    want = sorted((r.doc_id is not None, r.doc_id or 0, zlib.crc32(np.array(
        tok.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4").tobytes())) for r in extra.collect())
    for planes in ("byte", "bit"):
        folder = shared_folder(spark, "t")
        token_planes.write_token_planes(extra, folder, path, block_ids=500, planes=planes)
        got = token_planes.read_token_planes(spark, folder).orderBy("start").collect()
        assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [w[:2] for w in want]
        assert sorted(r.ids_crc32 for r in got) == sorted(w[2] for w in want)
        assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    folder = shared_folder(spark, "t")
    token_planes.write_token_planes(empty, folder, path)
    assert token_planes.read_token_planes(spark, folder).count() == 0


def test_rules_and_ablation(spark, odd, empty):
    led = quality_rules.ledger(odd)
    rows = {r.doc_id: r for r in led.collect()}
    assert rows[6].n_dup_lines == 1 and rows[2].n_words == 0 and rows[5].n_words == 30_000
    assert rows[5].n_repeat_words == 30_000 and rows[1].n_repeat_words == 0
    brute = {}
    text = "a b c d e f g h x a b c d e f g h y z"
    t = spark.createDataFrame([(1, text)], "doc_id long, text string")
    brute[1] = 16
    assert quality_rules.measure(t).first().n_repeat_words == brute[1]
    ab = quality_rules.ablation(led).collect()
    base = {r.rule: r for r in ab if r.version == "base"}
    assert base["few_words"].rule_failed == 7 and base["repeated_windows"].only_this_rule == 1
    assert quality_rules.ledger(empty).count() == 0


def test_a_worker_holds_the_caches_of_one_operator():
    """The stages of a pipeline run in the same worker processes."""
    path = tokenizer_path()
    token_planes.encoder(path).encode(pa.array(["some words of a text"]))
    assert token_planes.encoder(path).rows and not near_dedup.WORDS          # kept from call to call
    near_dedup.shingles(["other words of one more text"])
    assert near_dedup.WORDS and not token_planes._ENCODERS
    toxicity.Cached(len)["word"]
    assert not near_dedup.WORDS
    ids, sizes = token_planes.encoder(path).encode(pa.array(["some words"]))
    assert len(ids) == sizes.sum() > 0


def test_line_join_shuffles_only_texts_of_candidates(spark):
    """Keys stand where the texts are read; repeated and lone lines leave no text."""
    lone = ["".join(random.Random(i).choices("abcdefgh ", k=40)) for i in range(200)]
    near = ["the first of two lines that differ by a letter", "the first of two lines that differ by a lettar"]
    rows = [(hash(t) & (1 << 60) - 1, t, len(t)) for t in lone * 2 + near * 3]
    lines = spark.createDataFrame(rows, "id long, line string, len int")
    keyed = line_dedup.distinct_lines(lines)
    assert keyed.count() == 202 and "line" not in keyed.columns
    links = line_dedup.near_links(lines).collect()
    assert [r.distance for r in links] == [1]
    need = spark.createDataFrame([(links[0].a,), (links[0].b,)], "id long")
    assert sorted(r.line for r in line_dedup.marked_lines(lines, need).collect()) == sorted(near)
    assert "BroadcastHashJoin" in line_dedup.marked_lines(lines, need)._jdf.queryExecution().toString()


def test_token_planes_encoder_works_out_no_offsets():
    """Ids are those of the plain call, which computes offsets of every token
    and is not made; pieces known and new are looked up in one pass."""
    from tokenizers import Tokenizer
    path = tokenizer_path()
    texts = ["", "one", "one two  three\n four", " ".join(f"w{i}é{i * 7919 % 1000}" for i in range(2500)), "one two",
             "tab\there", "w1é919 new w2é838", "a " * 300]
    plain = Tokenizer.from_file(path)
    enc = token_planes.PieceEncoder(path)

    class Counted:
        calls = 0

        def encode(self, *a, **kw):
            Counted.calls += 1
            return plain.encode(*a, **kw)

        def __getattr__(self, name):
            return getattr(plain, name)

    enc.tok = Counted()
    for _ in range(2):
        ids, sizes = enc.encode(pa.array(texts))
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [x for w in want for x in w] and sizes.tolist() == [len(w) for w in want]
    assert Counted.calls == 0


def test_line_join_meets_equally_long_lines_once(spark):
    """Lines of one length are index and probe at once: a pair has one row for
    each segment it shares, not one in either role, so three at most."""
    near = ["a line of a group whose members differ in one letter: " + c for c in "abcdefghij"]
    rows = [(i, t, len(t)) for i, t in enumerate(near)]
    lines = spark.createDataFrame(rows, "id long, line string, len int")
    assert line_dedup.met_lines(line_dedup.distinct_lines(lines)).count() == 45 * 2
    assert line_dedup.near_links(lines).count() == 45


def test_line_keys_are_those_of_the_substrings():
    """A prefix hash gives equal keys for equal characters, whatever stands
    before them and however many bytes they have; profiles count modulo 64."""
    lines = ["é" * 5 + "abcdefghijklmnopqrstuvwx", "abcdefghijklmnopqrstuvwxyz", "e" * 5000 + "ntß", "short line 1", "ß"]
    texts = line_dedup.LineTexts(pa.array(["skipped", *lines]).slice(1))
    assert texts.length.tolist() == [len(x) for x in lines]
    n = np.array([24, 24])
    a, b = texts.key(np.array([0, 1]), 2, n, 0, np.array([5, 0]), n)
    assert a == b
    one = line_dedup.LineTexts(pa.array([lines[1]]))
    assert one.key(np.array([0]), 2, n[:1], 0, np.array([0]), n[:1])[0] == a
    for x, p in zip(lines, texts.profile().tolist()):
        assert p >> 60 == len(x) % 8
        assert [p >> 6 * k & 63 for k in range(10)] == [x.count(c) % 64 for c in line_dedup.LETTERS]
    flat, sizes = texts.index(2)
    assert sizes.tolist() == [3, 3, 3, 2, 0] and len(flat) == sizes.sum()


def test_near_duplicate_texts_without_candidates_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(2000)] + [(5000, None)], "doc_id long, text string")
    need = docs.where("doc_id % 500 = 7").select(near_dedup.text_key(F.col("text")).alias("node"))
    one = near_dedup.node_texts(docs, need)
    assert sorted(r.text for r in one.collect()) == sorted(f"text number {i}" for i in (7, 507, 1007, 1507))
    plan = one._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.rindex("Aggregate(key=[node"):]               # below the first step of the grouping of the texts
    assert "BroadcastHashJoin" in scan
    key = F.xxhash64("doc_id")
    assert 4 <= marked_rows(docs, key, docs.where("doc_id % 500 = 7"), key).count() < 20


def test_linked_classes_are_joined_as_a_whole(spark):
    comps = spark.createDataFrame([(x, c) for c, xs in (("a", "abc"), ("d", "de"), ("f", "fgh")) for x in xs],
                                  "node string, comp string")
    links = spark.createDataFrame([("h", "e"), ("z", "y"), ("y", "b")], "a string, b string")
    got = {r.node: r.comp for r in near_dedup.joined_classes(comps, links).collect()}
    assert got == dict(zip("abcdefghyz", "aaaddddd" + "aa"))
