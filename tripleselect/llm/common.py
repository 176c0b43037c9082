"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tripleselect.session import cut_lineage, ensure_checkpoint_dir, ship_package

#: A word is a run of characters other than space and the controls 9-13.
WORD = r"[^\x20\x09-\x0D]+"


#: Bits of the set that keeps rows without a wanted key from being shuffled (a power of 2).
MARKS = 1 << 26


#: What empties a cache of this worker process, by the operator that filled it.
_HELD: dict[str, Callable[[], None]] = {}


def hold(operator: str, clear: Callable[[], None]) -> None:
    """``operator`` goes on to fill a cache in this worker process, ``clear``
    empties it; the caches of other operators are emptied now, so that a worker
    of several stages never holds more than one stage's."""
    if operator not in _HELD:
        for other in list(_HELD):
            _HELD.pop(other)()
        _HELD[operator] = clear
        pa.default_memory_pool().release_unused()


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_key(text: Column) -> Column:
    """128-bit identity of a text (md5 of its UTF-8 bytes); null for null."""
    return F.md5(F.encode(text, "UTF-8"))


def crc32_utf8(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; a null text counts as empty."""
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def fold(doc_id: Column, folds: int) -> Column:
    """``crc32(doc_id as text) mod folds``; -1 when the id is null."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(-1)).cast("int")


def marked_rows(rows: DataFrame, key: Column, need: DataFrame, need_key: Column) -> DataFrame:
    """The ``rows`` whose ``key`` (a 64-bit hash) may be among ``need_key`` of
    ``need``: all that are, and few others.  A broadcast set of ``MARKS`` bits
    (in words of 64) drops the rest before a shuffle; an exact join follows."""
    def mark(k: Column) -> Column:
        return k.bitwiseAND(F.lit(MARKS - 1))

    bit = "shiftleft(1L, cast(__mark & 63 as int))"
    words = need.select(mark(need_key).alias("__mark")).groupBy(F.shiftright("__mark", 6).alias("__word")).agg(
        F.expr(f"bit_or({bit})").alias("__bits"))
    return (rows.withColumn("__mark", mark(key)).withColumn("__word", F.shiftright("__mark", 6))
                .join(F.broadcast(words), "__word").where(f"__bits & {bit} != 0").select(*rows.columns))


def least_hash_rows(docs: DataFrame, marked: DataFrame, rows: int) -> DataFrame:
    """The ``docs`` rows of about ``rows`` marked documents, those whose
    ``doc_id`` has the least hash, with the columns of ``marked(doc_id, ...)``.

    Ids are chosen on the narrow column first, so texts of other documents are
    never shuffled; the chosen side has at most ``rows`` rows and is broadcast.
    """
    chosen = (docs.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().join(marked, "doc_id")
                  .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return docs.join(F.broadcast(cut_lineage(chosen)), "doc_id")


def map_slices(df: DataFrame, fn, schema: str, text: tuple[str, ...], chars: int) -> DataFrame:
    """``mapInPandas`` over slices of the Arrow batches whose ``text`` columns
    hold about ``chars`` bytes together (one row at least), so that a batch of
    long texts is never turned into Python objects as a whole."""
    out_schema = to_arrow_schema(StructType.fromDDL(schema))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = sum(pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in text)
            group = (np.cumsum(size) - size) // chars if b.num_rows else size
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    yield b.slice(lo, hi - lo).to_pandas()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in fn(slices(batches)):
            yield pa.RecordBatch.from_pandas(pdf, schema=out_schema, preserve_index=False)

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, comp)`` for every node of an undirected edge list, ``comp``
    being the smallest node of its component.

    Alternating large-star / small-star rounds: each round re-hangs a node's
    larger (smaller) neighbours on its smallest one, so a long chain halves
    with every round.  Runs until the edge set no longer changes; every round
    is checkpointed.  Sizes are those of the edge list, never of its square.
    """
    e = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                         .where(F.col("u") != F.col("v")).distinct())
    nodes = e
    before = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (both.where(F.col("v") > F.col("u")).join(low, "u")
                     .select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u")
                      .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
                      .select("x.*").where(F.col("u") != F.col("v")).distinct())
        e = cut_lineage(small)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    seen = nodes.select(F.col("u").alias("node")).unionByName(nodes.select(F.col("v").alias("node"))).distinct()
    return (seen.join(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp")), "node", "left")
                .select("node", F.coalesce("comp", "node").alias("comp")))
