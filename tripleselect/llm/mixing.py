"""Mixing sources to target weights, on DataFrame and SQL functions only.

The words of a source form one stream (documents in a seeded hash order) that
is packed into blocks of ``block_words``.  A source's target number of words
becomes a number of slots.  The slots of all sources are dealt to output shards
of equal size by one pseudorandom permutation, so every shard's source counts
are a multinomial draw with the sources' shares as chances, conditioned on the
totals that the targets fix.  Slot ``r`` of an epoch is mapped through a
pseudorandom permutation of the source's block indexes (swap-or-not rounds, one
permutation per epoch), and slots join blocks by (source, block index).  The
join key is a block, so a hot source is spread like any other.

Full blocks are permuted; a source's shorter last block closes each epoch and
the last slot is cut, so the words taken from a source equal its rounded
target exactly, and no document is taken more than ``max_epochs`` times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleselect.llm.common import WORD, cut_lineage, text_key

WEIGHTS = (5, 2, 1)
ROUNDS = 16
#: Slots made from one row; keeps a hot source's slots from being made by one task.
SLOT_CHUNK = 4096
#: Documents numbered together within a source.
ROWS_PER_BUCKET = 2_000


def source_targets(sizes: DataFrame, total_share: float = 1.5, max_epochs: int = 2,
                   weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sizes(source, source_size)`` -> plus ``src`` (rank by code point,
    null last), ``weight``, ``target``.

    Weights repeat in rank order.  Targets are ``min(max_epochs * size,
    level * weight)`` where the one ``level`` makes them add up to
    ``total_share`` of all sizes: what resharing every excess by weight ends
    in.  The level is found by running sums over sources sorted by the level
    at which they reach their limit (one row per source).
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("src") - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", w).withColumn("limit", F.col("source_size") * float(max_epochs))
    s = s.withColumn("full_at", F.col("limit") / F.col("weight"))
    up = Window.orderBy("full_at", "src")
    s = (s.withColumn("want", F.sum("source_size").over(Window.partitionBy()) * float(total_share))
          .withColumn("capped", F.coalesce(F.sum("limit").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
          .withColumn("open", F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))))
    s = s.withColumn("level", (F.col("want") - F.col("capped")) / F.col("open"))
    # the first source that its level does not fill sets the level of all after it
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "src", "level")))
                     .over(Window.partitionBy())["level"])
    return s.select("source", "src", "source_size", "weight",
                    F.coalesce(F.least(F.col("limit"), F.col("level") * F.col("weight")), F.col("limit")).alias("target"))


def swap_or_not(df: DataFrame, x: str, n: Column, *key: Column) -> DataFrame:
    """Replace ``x`` in ``[0, n)`` by its image under a keyed permutation of
    ``[0, n)``.  Each round pairs ``x`` with ``k - x mod n`` and swaps the two
    on a hash bit of the larger, which keeps it a bijection for any ``n``."""
    cols = [c for c in df.columns if c != x]
    for r in range(ROUNDS):
        df = df.select(*cols, x, F.pmod(F.pmod(F.xxhash64(*key, F.lit(r), F.lit("k")), n) - F.col(x), n).alias("__y"))
        big = F.greatest(x, "__y")
        df = df.select(*cols, F.when(F.xxhash64(*key, F.lit(r), big).bitwiseAND(F.lit(1)) == 1, F.col("__y"))
                       .otherwise(F.col(x)).alias(x))
    return df


def streams(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """``(rows, sources)``: every document row with ``size, src, off`` (place
    of its first word in its source's stream), and the sizes per source.

    Documents are numbered inside hash buckets of about ``ROWS_PER_BUCKET``
    rows and bucket totals are summed up per source, so no window holds a
    whole source.  The order depends on ids and texts alone.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    base = cut_lineage(docs.select("doc_id", "source", text_key(F.col("text")).alias("tkey"), size.alias("size")))
    buckets = max(1, base.count() // ROWS_PER_BUCKET)
    h = F.xxhash64(F.lit(seed), "doc_id", "tkey")
    base = base.withColumn("h", h).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    totals = base.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sizes = totals.groupBy("source").agg(F.sum("n").alias("source_size"))
    by_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(F.col("source").alias("s0"), F.col("bucket").alias("b0"),
                         F.coalesce(F.sum("n").over(by_source), F.lit(0)).alias("before"))
    inside = (Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "tkey")
                    .rowsBetween(Window.unboundedPreceding, -1))
    rows = (base.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
                .join(offs, F.col("source").eqNullSafe(F.col("s0")) & (F.col("bucket") == F.col("b0")))
                .select("doc_id", "source", "tkey", "size", (F.col("before") + F.col("own")).alias("off")))
    return rows, sizes


def slots_of(sources: DataFrame, block_words: int, shards: int, seed: int) -> DataFrame:
    """One row per drawn slot: ``src, slot, epoch, block, words, shard``.
    Shards hold equally many slots, give or take one."""
    b = F.lit(block_words)
    s = sources.where(F.col("source_size") > 0).select(
        "src", "source_size", F.least(F.round("target"), F.col("target") + 1).cast("long").alias("goal"))
    per = F.ceil(F.col("source_size") / b)
    s = s.select("src", "source_size", "goal", per.alias("per"), F.floor(F.col("source_size") / b).alias("full"))
    s = s.withColumn("slots", F.floor(F.col("goal") / F.col("source_size")) * F.col("per")
                     + F.ceil((F.col("goal") % F.col("source_size")) / b)).where(F.col("slots") > 0)
    # a slot's number over all sources (one row per source here)
    before = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("first", F.coalesce(F.sum("slots").over(before), F.lit(0))).withColumn(
        "all", F.sum("slots").over(Window.partitionBy()))
    s = s.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SLOT_CHUNK))))
    # a fixed number of partitions: chunks are tiny rows, which would else be merged into one task
    s = s.repartition(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src", "chunk")
    s = s.withColumn("slot", F.explode(F.sequence(
        F.col("chunk") * SLOT_CHUNK, F.least(F.col("slots"), (F.col("chunk") + 1) * SLOT_CHUNK) - 1)))
    s = s.select("src", "slot", "source_size", "goal", "full", "all", F.floor(F.col("slot") / F.col("per")).alias("epoch"),
                 (F.col("slot") % F.col("per")).alias("r"), (F.col("first") + F.col("slot")).alias("place"))
    s = swap_or_not(s, "place", F.col("all"), F.lit(seed), F.lit("shard"))
    s = s.withColumn("shard", F.floor(F.col("place") * shards / F.col("all")).cast("int")).drop("place", "all")
    s = s.withColumn("x", F.col("r"))
    n = F.greatest("full", F.lit(1))
    s = swap_or_not(s, "x", n, F.lit(seed), F.col("src"), F.col("epoch"))
    s = cut_lineage(s)   # else filters of later joins are pushed through, and copied in, every round
    last = F.col("r") >= F.col("full")
    length = F.when(last, F.col("source_size") - F.col("full") * b).otherwise(b)
    before = F.col("epoch") * F.col("source_size") + F.col("r") * b
    return s.select("src", "slot", "epoch", F.when(last, F.col("full")).otherwise(F.col("x")).alias("block"),
                    F.least(length, F.col("goal") - before).alias("words"), "shard")


def shard_counts(slots: DataFrame) -> DataFrame:
    """The draw: slots and words of each source per output shard."""
    return slots.groupBy("shard", "src").agg(F.count(F.lit(1)).alias("slots"), F.sum("words").alias("words"))


def mix(docs: DataFrame, block_words: int = 64, shards: int = 64, seed: int = 17, total_share: float = 1.5,
        max_epochs: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mix all documents: ``(parts, rows, sources)``.

    ``parts``: one row per stretch of a document that a slot takes: ``shard,
    src, slot, epoch, off`` (the document's place in its source), ``at`` (first
    word in the document), ``n`` (words).  ``rows``: the documents with their
    ``size, src, off`` (one row per input row, repeated rows included).
    ``sources``: sizes, weights and targets.  Null texts have no words and are
    never taken; null sources are a source of their own, the last.  An empty
    table gives empty results.  Extra columns are ignored.
    """
    rows, sizes = streams(docs, seed)
    sources = cut_lineage(source_targets(sizes, total_share, max_epochs))
    rows = cut_lineage(rows.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
                           .select("r.doc_id", "r.tkey", "r.size", "s.src", "r.off", "s.source_size", "s.target"))
    slots = slots_of(sources, block_words, shards, seed)
    b = F.lit(block_words)
    blocks = (rows.where(F.col("size") > 0).select("src", "off", "size", F.explode(F.sequence(
                  F.floor(F.col("off") / b), F.floor((F.col("off") + F.col("size") - 1) / b))).alias("block"))
                  .withColumn("lo", F.greatest("off", F.col("block") * b))
                  .withColumn("hi", F.least(F.col("off") + F.col("size"), (F.col("block") + 1) * b)))
    cut = F.least(F.col("hi"), F.col("block") * b + F.col("words"))
    parts = (slots.join(blocks, ["src", "block"])
                  .select("shard", "src", "slot", "epoch", "off", (F.col("lo") - F.col("off")).alias("at"),
                          (cut - F.col("lo")).alias("n")).where(F.col("n") > 0))
    return parts, rows, sources


def words_taken(docs: DataFrame, **kw) -> DataFrame:
    """Per input row: ``doc_id, size, source_size, target, taken`` and
    ``shards``, in how many output shards its words are."""
    parts, rows, _ = mix(docs, **kw)
    # a document's stretches are few: its words by those of a block, twice
    taken = parts.groupBy("src", "off").agg(F.sum("n").alias("taken"), F.size(F.collect_set("shard")).cast("long").alias("shards"))
    return (rows.join(taken.withColumnRenamed("src", "s0").withColumnRenamed("off", "o0"),
                      (F.col("src") == F.col("s0")) & (F.col("off") == F.col("o0")) & (F.col("size") > 0), "left")
                .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
                        F.coalesce("shards", F.lit(0)).cast("long").alias("shards")))


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The mix as documents, with the input's columns: one row per document
    and epoch in which words of it are taken.  A document taken whole keeps
    its text; of others the taken stretches remain, in their order, words
    joined by single spaces.  ``n_chars``, if present, is the new length.

    Null and empty texts have no words and never occur; a null id or source is
    a value like any other; repeated rows, and rows equal in id and text but
    not in other columns, are each mixed with their own columns; an empty
    table gives no rows.  Columns may have any names.
    """
    parts, rows, _ = mix(docs, **kw)
    spans = parts.groupBy("src", "off", "epoch").agg(
        F.sort_array(F.collect_list(F.struct("at", "n"))).alias("spans"), F.sum("n").alias("taken"))
    same = Window.partitionBy("doc_id", "tkey")
    rows = rows.where(F.col("size") > 0).withColumn("copies", F.count(F.lit(1)).over(same)).withColumn(
        "copy", F.when(F.col("copies") > 1, F.row_number().over(same.orderBy("src", "off"))).otherwise(1))
    who = cut_lineage(rows.join(spans, ["src", "off"]).select(
        F.col("doc_id").alias("id"), F.col("tkey").alias("key"), "copy", "copies", "spans", (F.col("taken") == F.col("size")).alias("whole")))
    # a row's own columns travel as one value, so their names meet no others
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"),
                       text_key(F.col("text")).alias("key"))

    def met(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        r = right.select(*[F.col(c).alias(f"w_{c}") for c in right.columns])
        on = F.col("id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key"))
        for c in more:
            on = on & (F.col(c) == F.col(f"w_{c}"))
        return left.join(r, on).select("row", F.col("w_spans").alias("spans"), F.col("w_whole").alias("whole"))

    both = met(base, who.where("copies = 1"))
    repeated = cut_lineage(who.where("copies > 1").select("id", "key").distinct())
    n = repeated.count()
    if n:                       # rows of one id and text: the first in the source's order is the first copy, and so on
        few = F.broadcast(repeated) if n <= 100_000 else repeated
        few = few.select(F.col("id").alias("i"), F.col("key").alias("k"))
        own = base.join(few, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left_semi")
        own = own.withColumn("copy", F.row_number().over(Window.partitionBy("id", "key").orderBy(
            F.col("row.source").asc_nulls_last(), F.xxhash64("row"))))
        both = both.unionByName(met(own, who.where("copies > 1"), "copy"))
    words = F.array_remove(F.split("row.text", r"[\x20\x09-\x0D]+"), "")
    both = both.withColumn("words", F.when(~F.col("whole"), words))
    piece = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(
        "words", (s["at"] + 1).cast("int"), s["n"].cast("int")))), " ")
    both = both.withColumn("new", F.when(F.col("whole"), F.col("row.text")).otherwise(piece))
    return both.select(*[F.col("new").alias(c) if c == "text" else
                         F.length("new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else
                         F.col("row").getField(c).alias(c) for c in docs.columns])
