"""Sharding by K-d tree partitioning.

Documents are points in a space of metadata dimensions.  A node is split at
the weighted median (weight: bytes) of its widest dimension until its share of
bytes is one leaf's.  Medians are found by histogram refinement: each pass
counts the bytes of every open node in 16384 cells of its current key range and
narrows the range to the cell that holds the cut, until the cell holds next to
nothing.  A pass is one map-side-combined aggregation over the narrow metadata
table, whatever the number of nodes; texts are read once, for their size.
Cells and nodes are tables: nothing is collected but a counter a pass.  Nodes
are sent to the points as long as there are few, so points are not shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleselect.llm.common import crc32_utf8, cut_lineage

#: A dimension has this many steps; a key is the step followed by a hash, which splits ties.
STEP_BITS = 31
CELL_BITS = 14
#: A cut is exact enough when its cell holds less than this share of the node's bytes.
SLACK = 1e-4
#: Up to so many nodes are broadcast (some 60 bytes each); more are joined by a shuffle, when none is hot any longer.
MAX_SENT = 1 << 16


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def metadata(docs: DataFrame, numeric: list[str], categories: list[str]) -> DataFrame:
    """Narrow table: ``doc_id, size, text_crc32, tie`` and one coordinate in
    ``[0, 2^31)`` per dimension, scaled by the dimension's range (numbers;
    null is the least) or hashed (categories)."""
    top = float((1 << STEP_BITS) - 1)
    cols = [F.col("doc_id").cast("long").alias("doc_id"), byte_size(F.col("text")).alias("size"),
            crc32_utf8(F.col("text")).alias("text_crc32"), F.xxhash64("doc_id", "text").alias("h")]
    raw = docs.select(*cols, *[F.col(c).cast("double").alias(f"n{i}") for i, c in enumerate(numeric)],
                      *[F.xxhash64(c).alias(f"c{i}") for i, c in enumerate(categories)])
    raw = cut_lineage(raw)
    names = ["size_dim"] + [f"n{i}" for i in range(len(numeric))]
    raw = raw.withColumn("size_dim", F.log2("size"))
    ext = raw.agg(*[F.min(n).alias(f"lo_{n}") for n in names], *[F.max(n).alias(f"hi_{n}") for n in names]).first()
    dims = []
    for n in names:
        lo, hi = ext[f"lo_{n}"], ext[f"hi_{n}"]
        span = (hi - lo) if lo is not None and hi is not None and math.isfinite(hi - lo) and hi > lo else 0.0
        dims.append(F.coalesce(((F.col(n) - F.lit(lo)) / F.lit(span) * top).cast("long"), F.lit(0)) if span
                    else F.lit(0).cast("long"))
    dims += [F.shiftrightunsigned(F.col(f"c{i}"), 64 - STEP_BITS) for i in range(len(categories))]
    return raw.select("doc_id", "size", "text_crc32",
                      F.shiftrightunsigned("h", 64 - STEP_BITS).alias("tie"), F.array(*dims).alias("dims"))


def sent(nodes: DataFrame, count: int) -> DataFrame:
    """``nodes`` (at most ``count`` rows) as the small side of a join."""
    return F.broadcast(nodes) if count <= MAX_SENT else nodes


def kept_apart(nodes: DataFrame, count: int) -> DataFrame:
    """``nodes`` checkpointed; few rows are read again by few tasks."""
    done = cut_lineage(nodes)
    return done.coalesce(4) if count <= MAX_SENT else done


def split_level(points: DataFrame, nodes: DataFrame, dims: int, count: int) -> tuple[DataFrame, DataFrame]:
    """Split every node with more than one leaf to come.

    ``nodes``: ``node, leaves, first`` (its first leaf number), ``count`` rows
    at most.  Returns the points with their new node and the new nodes.
    """
    open_nodes = nodes.where(F.col("leaves") > 1)
    box = points.groupBy("node").agg(F.sum("size").alias("bytes"), *[
        f(F.col("dims")[i]).alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))])
    box = box.select("node", "bytes", F.array(*[F.col(f"lo{i}") for i in range(dims)]).alias("los"),
                     F.array(*[F.col(f"hi{i}") for i in range(dims)]).alias("his"))
    widths = F.zip_with("his", "los", lambda h, l: h - l)
    box = box.withColumn("dim", (F.array_position(widths, F.array_max(widths)) - 1).cast("int"))
    step = F.lit(1 << STEP_BITS)
    cuts = kept_apart(box.join(sent(open_nodes, count), "node").select(
        "node", "leaves", "first", "dim", "bytes",
        (F.col("bytes") * F.floor(F.col("leaves") / 2) / F.col("leaves")).alias("goal"),
        (F.element_at("los", F.col("dim") + 1) * step).alias("lo"),
        (F.element_at("his", F.col("dim") + 1) * step + ((1 << STEP_BITS) - 1)).alias("hi"),
        F.lit(0).cast("long").alias("below"), F.lit(False).alias("done"), F.lit(0).cast("long").alias("cell_bytes")), count)
    key = F.element_at("dims", F.col("dim") + 1) * step + F.col("tie")
    pts = points.withColumnRenamed("node", "node0")
    while cuts.where(~F.col("done")).limit(1).count():
        todo = cuts.where(~F.col("done"))
        w = F.shiftright(F.col("hi") - F.col("lo"), CELL_BITS) + 1
        hist = (pts.join(sent(todo.select("node", "dim", "lo", "hi", w.alias("w")), count), F.col("node0") == F.col("node"))
                   .withColumn("key", key).where((F.col("key") >= F.col("lo")) & (F.col("key") <= F.col("hi")))
                   .groupBy("node", F.expr("CAST((key - lo) DIV w AS INT)").alias("cell"))
                   .agg(F.sum("size").alias("n"), F.min("key").alias("kmin"), F.max("key").alias("kmax")))
        run = Window.partitionBy("node").orderBy("cell")
        at = (hist.withColumn("upto", F.sum("n").over(run)).join(sent(todo.select("node", "below", "goal"), count), "node")
                  .where(F.col("below") + F.col("upto") >= F.col("goal"))
                  .groupBy("node").agg(F.min(F.struct("cell", "upto", "n", "kmin", "kmax")).alias("c")))
        nxt = at.join(sent(todo, count), "node").select(
            "node", "leaves", "first", "dim", "bytes", "goal", F.col("c.kmin").alias("lo"), F.col("c.kmax").alias("hi"),
            (F.col("below") + F.col("c.upto") - F.col("c.n")).alias("below"),
            ((F.col("c.kmin") == F.col("c.kmax")) | (F.col("c.n") <= F.col("bytes") * SLACK)).alias("done"),
            F.col("c.n").alias("cell_bytes"))
        cuts = kept_apart(nxt.unionByName(cuts.where("done")), count)
    # the last cell goes to the side that leaves the cut nearer to its goal
    half = F.floor(F.col("leaves") / 2)
    with_cell = 2 * (F.col("goal") - F.col("below")) >= F.col("cell_bytes")
    plan = cuts.select("node", "dim", F.when(with_cell, F.col("hi")).otherwise(F.col("lo") - 1).alias("bound"))
    moved = (pts.join(sent(plan, count), F.col("node0") == F.col("node"), "left").withColumn("key", key)
                .withColumn("node1", F.when(F.col("node").isNull(), F.col("node0"))
                            .when(F.col("key") <= F.col("bound"), F.col("node0") * 2).otherwise(F.col("node0") * 2 + 1)))
    new_points = cut_lineage(moved.select(*[c for c in points.columns if c != "node"], F.col("node1").alias("node")))
    left = cuts.select((F.col("node") * 2).alias("node"), half.alias("leaves"), "first")
    right = cuts.select((F.col("node") * 2 + 1).alias("node"), (F.col("leaves") - half).alias("leaves"),
                        (F.col("first") + half).alias("first"))
    kept = nodes.where(F.col("leaves") <= 1)
    return new_points, left.unionByName(right).unionByName(kept).select(
        F.col("node").cast("long"), F.col("leaves").cast("long"), F.col("first").cast("long"))


def kd_shards(docs: DataFrame, numeric: list[str], categories: list[str], shards: int | None = None,
              target_bytes: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard`` for every input row.

    Give the number of ``shards`` or the ``target_bytes`` of one.  Equal
    points (copies) are split by a hash of id and text, so a hot group never
    fills a shard; identical rows stay together.  An empty table gives no
    rows; nulls take the least coordinate.  Extra columns are ignored.
    """
    pts = metadata(docs, numeric, categories)
    total = pts.agg(F.sum("size")).first()[0] or 0
    n = shards or max(1, math.ceil(total / target_bytes))
    spark = docs.sparkSession
    points = pts.withColumn("node", F.lit(1).cast("long"))
    nodes = spark.range(1).select(F.lit(1).cast("long").alias("node"), F.lit(n).cast("long").alias("leaves"),
                                  F.lit(0).cast("long").alias("first"))
    if total:
        for level in range(math.ceil(math.log2(n))):
            points, nodes = split_level(points, nodes, 1 + len(numeric) + len(categories), min(1 << level, n))
    return points.join(sent(nodes.select("node", "first"), n), "node").select(
        "doc_id", "size", "text_crc32", F.col("first").cast("int").alias("shard"))


def with_slots(rows: DataFrame) -> DataFrame:
    """Add ``slot``: gapless numbers from 0 in each shard.  Rows are numbered
    inside the partitions of a checkpointed table, and partition totals are
    summed up per shard, so no task holds a shard."""
    base = cut_lineage(rows).withColumn("__part", F.spark_partition_id())
    own = F.row_number().over(Window.partitionBy("shard", "__part").orderBy("doc_id", "text_crc32"))
    counts = base.groupBy("shard", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("shard").orderBy("__part")
                                          .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (base.withColumn("__own", own)
                .join(counts.select("shard", "__part", before.alias("__before")), ["shard", "__part"])
                .withColumn("slot", F.col("__before") + F.col("__own") - 1).drop("__part", "__own", "__before"))
