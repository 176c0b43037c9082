"""Prefix trie of conversations by vertical bitmaps.

Conversations are cut into shards, ranges of conversation ids.  A shard's
index has one bitset of its conversations per (position, turn); the trie is
walked depth first: a node's bitset intersected with the postings of the next
position gives its children, the popcount its members, and the intersection
with the conversations of exactly that length its end list.  Shards only ever
meet as nodes: a node is known everywhere by a 128-bit digest of the turns
from the root, so a first turn that every conversation shares is one row per
shard, however many conversations have it.

Sums over subtrees count every node once although several shards hold it: the
shard of its smallest member owns a node, adds it in its own walk order, and
the shards' sums are then added.

Rows: turns are ordered by ``turn``, null first, ties by the digest of role
and text; null role or text counts as empty; a null ``conv_id`` names no
conversation and takes no part; repeated rows are turns of their own; other
columns are ignored.  An empty table has no root.  The turns of one
conversation are handled by one task, and so are the ids that end in one node
when their hash is taken, in order, piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleselect.session import cut_lineage

#: Turns of a shard, about.
SHARD_TURNS = 40_000
ROOT = b"\0" * 16
LOCAL = ("shard int, pre int, size int, depth int, path binary, parent binary, conv_id long, members long, chars int, "
         "leaf boolean, n_ends int, ends string")


def turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, turn_key, chars)``: each turn's place from 1, a 128-bit
    digest of role and text, and the text's code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    narrow = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("turn_key"),
        F.length(text).cast("int").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "turn_key")
    return narrow.select("conv_id", F.row_number().over(order).alias("pos"), "turn_key", "chars")


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from its base."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 6


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``(conv_id, part, pos, turn_key, chars)`` of every conversation with its
    first turns replaced by those of its base, the conversation at the hundred
    below.  Part 0 is one row without a turn that stands for the conversation
    itself, part 1 the base's turns and part 2 its own that are left."""
    own = cut_lineage(turns(conversations))
    convs = own.where("pos = 1").select("conv_id", shared_turns(F.col("conv_id")).alias("h"),
                                        (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    heads = own.where((F.col("conv_id") % 100 == 0) & (F.col("pos") <= 5)).withColumnRenamed("conv_id", "base")
    taken = convs.join(heads, "base").where(F.col("pos") <= F.col("h"))
    kept = own.where(F.col("pos") > shared_turns(F.col("conv_id")))
    mark = convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("turn_key"),
                        F.lit(0).alias("chars"))
    return (mark.unionByName(taken.select("conv_id", F.lit(1).alias("part"), "pos", "turn_key", "chars"))
                .unionByName(kept.select("conv_id", F.lit(2).alias("part"), "pos", "turn_key", "chars")))


class Shard:
    """The vertical index of one shard and its depth-first walk."""

    def __init__(self, conv: np.ndarray, key: list, chars: np.ndarray):
        """Rows in the order of conversation and place; a null key starts a conversation."""
        self.ids, self.turn, self.chars = [], [], []
        for c, k, n in zip(conv.tolist(), key, chars.tolist()):
            if k is None:
                self.ids.append(c)
                self.turn.append([])
                self.chars.append([])
            else:
                self.turn[-1].append(k)
                self.chars[-1].append(n)
        self.posting: dict[tuple[int, bytes], int] = {}
        self.length: dict[int, int] = {}
        at: dict[tuple[int, bytes], list[int]] = {}
        for i, ks in enumerate(self.turn):
            for p, k in enumerate(ks):
                at.setdefault((p, k), []).append(i)
            at.setdefault((len(ks), b""), []).append(i)
        for (p, k), members in at.items():
            bits = bitset(members)
            if k:
                self.posting[p, k] = bits
            else:
                self.length[p] = bits

    def walk(self) -> Iterator[list]:
        """Nodes in depth-first order: ``[depth, path, parent, smallest member,
        members, chars of the last text, leaf, end list]``."""
        if not self.ids:
            return
        everyone = (1 << len(self.ids)) - 1
        stack = [(everyone, 0, ROOT, None, 0)]
        while stack:
            bits, depth, path, parent, chars = stack.pop()
            smallest = (bits & -bits).bit_length() - 1
            if bits & (bits - 1) == 0:                      # one member: the rest is its own chain
                own, lens = self.turn[smallest], self.chars[smallest]
                c = self.ids[smallest]
                while True:
                    last = depth == len(own)
                    yield [depth, path, parent, c, 1, chars, last, [c] if last else []]
                    if last:
                        break
                    path, parent, chars = hashlib.md5(path + own[depth]).digest(), path, lens[depth]
                    depth += 1
                continue
            ends = bits & self.length.get(depth, 0)
            rest, children = bits & ~ends, []
            while rest:
                first = (rest & -rest).bit_length() - 1
                k = self.turn[first][depth]
                child = rest & self.posting[depth, k]
                rest &= ~child
                children.append((child, depth + 1, hashlib.md5(path + k).digest(), path, self.chars[first][depth]))
            yield [depth, path, parent, self.ids[smallest], bits.bit_count(), chars, not children,
                   [self.ids[i] for i in members_of(ends)]]
            stack.extend(reversed(children))


def bitset(members: list[int]) -> int:
    """Integer with the given (ascending) bits."""
    if len(members) == 1:
        return 1 << members[0]
    marks = np.zeros(members[-1] + 1, np.uint8)
    marks[members] = 1
    return int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")


def members_of(bits: int) -> list[int]:
    if bits & (bits - 1) == 0:
        return [bits.bit_length() - 1] if bits else []
    raw = np.frombuffer(bits.to_bytes(-(-bits.bit_length() // 8), "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


def shard_tries(rows: DataFrame) -> DataFrame:
    """The nodes of every shard's trie (``LOCAL``): ``pre`` is the walk order,
    ``size`` the nodes of the subtree, ``ends`` the comma-joined ids that end
    there.  ``rows`` as from :func:`rebuilt`."""
    rows = cut_lineage(rows)
    n = max(1, -(-rows.count() // SHARD_TURNS))
    laid = rows.repartitionByRange(n, "conv_id").sortWithinPartitions("conv_id", "part", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        shard = TaskContext.get().partitionId()
        nodes = list(Shard(table["conv_id"].to_numpy(), table["turn_key"].to_pylist(), table["chars"].to_numpy()).walk())
        size, open_nodes = np.ones(len(nodes), np.int32), []
        for i, node in enumerate(nodes):
            while open_nodes and nodes[open_nodes[-1]][0] >= node[0]:
                done = open_nodes.pop()
                size[done] = i - done
            open_nodes.append(i)
        for done in open_nodes:
            size[done] = len(nodes) - done
        for at in range(0, len(nodes), 10_000):
            part = nodes[at:at + 10_000]
            cols = list(zip(*part))
            yield pa.RecordBatch.from_arrays([
                pa.array([shard] * len(part), pa.int32()), pa.array(range(at, at + len(part)), pa.int32()),
                pa.array(size[at:at + len(part)], pa.int32()), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()),
                pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()),
                pa.array(cols[5], pa.int32()), pa.array(cols[6], pa.bool_()),
                pa.array([len(e) for e in cols[7]], pa.int32()), pa.array([",".join(map(str, e)) for e in cols[7]], pa.string())],
                names=[f.split()[0] for f in LOCAL.split(", ")])

    return laid.select("conv_id", "turn_key", "chars").mapInArrow(run, LOCAL)


def end_hashes(local: DataFrame) -> DataFrame:
    """``(path, ends_sha256)`` of nodes where conversations end.  Shards are
    ranges of ids, so a node's lists follow one another by shard; they are
    read in that order, never held together."""
    lists = local.where("n_ends > 0").select("path", "shard", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            paths, shas = [], []
            for path, ends in zip(b.column("path").to_pylist(), b.column("ends").to_pylist()):
                if path != now:
                    if now is not None:
                        paths.append(now)
                        shas.append(state.hexdigest())
                    now, state = path, hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), pa.array(shas, pa.string())], names=["path", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())],
                                             names=["path", "ends_sha256"])

    return (lists.repartition("path").sortWithinPartitions("path", "shard").mapInArrow(run, "path binary, ends_sha256 string"))


def subtree_sums(shared: DataFrame) -> DataFrame:
    """Per shard and node, sums over the part of its subtree that the shard
    owns; a subtree is a stretch of the walk order."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pre", ignore_index=True)
        own = (pdf["conv_id"] == pdf["smallest"]).to_numpy()
        end = np.arange(len(pdf)) + pdf["size"].to_numpy()

        def below(values):
            total = np.concatenate([[0], np.cumsum(np.where(own, values, 0))])
            return total[end] - total[:-1]

        depth = pdf["depth"].to_numpy()
        above, last = np.full(len(pdf), -1), np.full(int(depth.max()) + 2, -1)
        for i, d in enumerate(depth.tolist()):
            above[i], last[d] = (last[d - 1] if d else -1), i
        smallest = pdf["smallest"].to_numpy()
        inner = above >= 0
        children = np.bincount(above[inner & own], minlength=len(pdf))
        return pd.DataFrame({
            "path": pdf["path"], "conv_id": smallest, "depth": depth, "n_convs": pdf["n_convs"],
            "parent_conv_id": np.where(inner, smallest[above], 0),
            "n_children": children, "n_leaves": below(pdf["is_leaf"].to_numpy().astype(np.int64)),
            "saved_tokens": below((pdf["n_convs"].to_numpy() - 1) * pdf["chars"].to_numpy().astype(np.int64)),
            "owned": own})

    return shared.groupBy("shard").applyInPandas(
        run, "path binary, conv_id long, depth long, n_convs long, parent_conv_id long, n_children long, n_leaves long, "
             "saved_tokens long, owned boolean")


def merge_tries(local: DataFrame) -> DataFrame:
    """One row per node of the whole trie, from the shards' nodes."""
    local = cut_lineage(local)
    node = local.groupBy("path").agg(F.min("conv_id").alias("smallest"), F.sum("members").alias("n_convs"),
                                     F.min("leaf").alias("is_leaf"))
    shared = local.select("shard", "pre", "size", "depth", "path", "conv_id", "chars").join(node, "path")
    sums = subtree_sums(shared)
    # the owner's row has the node's own columns; the others only add
    out = sums.groupBy("path").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_conv_id").alias("parent_conv_id"),
        F.min("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"))
    nothing = hashlib.sha256(b"").hexdigest()
    return out.join(end_hashes(local), "path", "left").select(
        F.col("path").alias("node"), "conv_id", "depth",
        F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def prefix_trie(rows: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations laid out as by :func:`rebuilt`."""
    return merge_tries(shard_tries(rows))
