"""Token-id output as bit-plane-shuffled binary files.

A shard file holds the ids of a contiguous range of documents:

    magic                          8 bytes  b"TSPLANE1"
    chunk 0 .. chunk n-1           zstandard frames, one per plane
    footer                         zstandard frame of a pickled-free JSON header
                                   followed by the raw index arrays
    footer length                  8 bytes, little-endian
    magic                          8 bytes

The ids of all documents of a shard form one stream that is cut into blocks
of ``block_ids`` unsigned 32-bit little-endian integers (the last block is
shorter).  A block is transposed into planes: byte planes (all first bytes,
all second bytes, ...) or, with ``planes="bit"``, 32 bit planes.  Each plane
is compressed on its own; the footer's chunk index stores where each plane of
each block lies, so a reader can fetch any range of ids.  The footer also
stores doc ids, a null flag and lengths, in stream order.

Writing is safe under retries: every task attempt writes a file under a name
of its own and returns one manifest row; the manifest table, committed by
Spark, names the files that count.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleselect.llm.common import hold

MAGIC = b"TSPLANE1"
MANIFEST = "shard int, file string, docs long, ids long, bytes long"
#: Documents encoded together; bounds the memory of a task besides one Arrow batch.
SLICE_DOCS = 2000
#: Pieces that a worker remembers with their ids.
CACHE_PIECES = 800_000
#: White space other than single blanks and line feeds: such texts are encoded without splitting.
ODD_SPACE = (r"[^\S\n ]|[\x00-\x09\x0b-\x1f\x7f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}"
             r"\x{205f}\x{3000}\x{feff}]|  | \n|\n ")


# ------------------------------------------------------------------ encoding

class PieceEncoder:
    """Ids of whole texts through a byte-level BPE tokenizer.

    The tokenizer never merges across the boundary before a blank that
    follows a non-space character, so a text is split there, each distinct
    piece is encoded once, and ids are gathered per text.  Texts with other
    white space patterns, and texts that hold an added token's string, are
    encoded whole.  Ids equal ``encode(text, add_special_tokens=False)``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.whole_texts = "|".join([ODD_SPACE, *added])
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        for s, i in vocab.items():
            self.opens[i] = s.startswith("Ġ")
        self.first: dict[str, np.ndarray] = {}
        self.rows: dict[str, int] = {}
        self.pool = np.empty(1 << 16, "<u4")
        self.used = 0
        self.start = np.empty(1 << 12, np.int64)          # by piece: its place in the pool
        self.size = np.empty(1 << 12, np.int32)

    def whole(self, *texts: str) -> np.ndarray:
        """Ids of the texts, one after another (the plain call works out offsets too)."""
        return np.concatenate([np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(list(texts), add_special_tokens=False)])

    def _learn(self, pieces: list[str]) -> None:
        for i in range(0, len(pieces), 1000):
            part = pieces[i:i + 1000]
            # short runs of pieces: a long one costs more for each piece
            ids = self.whole(*[" " + " ".join(part[j:j + 100]) for j in range(0, len(part), 100)])
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) != len(part):      # a piece holds an inner opening token: one by one
                each = [self.whole(" " + p) for p in part]
                ids, sizes = np.concatenate(each), np.array([len(x) for x in each])
            else:
                sizes = np.diff(np.append(cuts, len(ids)))
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
            self.pool[self.used:self.used + len(ids)] = ids
            at = self.used + np.cumsum(sizes) - sizes
            self.used += len(ids)
            n = len(self.rows)
            while n + len(part) > len(self.start):
                self.start = np.concatenate([self.start, np.empty_like(self.start)])
                self.size = np.concatenate([self.size, np.empty_like(self.size)])
            self.start[n:n + len(part)], self.size[n:n + len(part)] = at, sizes
            self.rows.update(zip(part, range(n, n + len(part))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text (no end id)."""
        if len(self.rows) > CACHE_PIECES:
            self.rows, self.used = {}, 0
        odd = pc.match_substring_regex(texts, self.whole_texts).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts)
        split = pc.split_pattern(plain, " ")
        lens = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.dictionary_encode(split.flatten())
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        row = np.fromiter(map(self.rows.get, words, repeat(-1)), np.int64, len(words))
        new, known = np.flatnonzero(row < 0), len(self.rows)
        self._learn(words[new].tolist())
        row[new] = np.arange(known, len(self.rows))
        lead = np.cumsum(lens) - lens
        n, at = self.size[row].astype(np.int64)[codes], self.start[row][codes]
        heads = [self.first.get(words[codes[p]]) for p in lead]
        n[lead] = 0                          # a text's first piece has no blank before it
        ends = np.cumsum(n)
        flat = self.pool[np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        body = np.add.reduceat(n, lead) if len(lead) else n[:0]
        parts, sizes, pos = [], np.zeros(len(texts), np.int64), 0
        for i, h in enumerate(heads):
            if odd[i]:
                h = self.whole(texts[i].as_py())
            elif h is None:
                h = self.whole(words[codes[lead[i]]])
                if len(self.first) < CACHE_PIECES:
                    self.first[words[codes[lead[i]]]] = h
            parts += [h, flat[pos:pos + body[i]]]
            pos += body[i]
            sizes[i] = len(h) + body[i]
        return (np.concatenate(parts) if parts else np.empty(0, "<u4")), sizes


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and tokenizer file."""
    hold("token_planes", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


# ------------------------------------------------------------------ file format

def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """Transpose a block of unsigned 32-bit ids into byte or bit planes."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def open_fs(uri: str):
    """Filesystem and path of a shared folder (a URI or a plain path)."""
    from pyarrow import fs
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


class PlaneWriter:
    """Streams ids into one shard file; holds at most one block of ids."""

    def __init__(self, uri: str, block_ids: int, planes: str, level: int):
        import zstandard
        fs, path = open_fs(uri)
        fs.create_dir(os.path.dirname(path), recursive=True)
        self.out, self.zip = fs.open_output_stream(path), zstandard.ZstdCompressor(level=level)
        self.block, self.planes = block_ids, planes
        self.rest: list[np.ndarray] = []
        self.held = self.ids = 0
        self.pos = len(MAGIC)
        self.sizes: list[int] = []
        self.doc_ids: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.lens: list[np.ndarray] = []
        self.out.write(MAGIC)

    def _flush(self, ids: np.ndarray) -> None:
        for p in to_planes(ids, self.planes):
            z = self.zip.compress(p)
            self.out.write(z)
            self.sizes.append(len(z))
            self.pos += len(z)

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.nulls.append(nulls)
        self.lens.append(lens)
        self.ids += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            all_ids = np.concatenate(self.rest)
            cut = len(all_ids) // self.block * self.block
            for i in range(0, cut, self.block):
                self._flush(all_ids[i:i + self.block])
            self.rest, self.held = [all_ids[cut:]], len(all_ids) - cut

    def close(self) -> tuple[int, int, int]:
        """Number of documents, ids and bytes written."""
        if self.held:
            self._flush(np.concatenate(self.rest))
        cols = [np.concatenate(x) if x else np.empty(0, t) for x, t in
                ((self.doc_ids, "<i8"), (self.nulls, "u1"), (self.lens, "<i8"))]
        head = json.dumps({"ids": self.ids, "block": self.block, "planes": self.planes, "docs": len(cols[0]),
                           "frames": len(self.sizes)}).encode()
        body = b"".join([struct.pack("<q", len(head)), head, np.array(self.sizes, "<i8").tobytes(),
                         cols[0].astype("<i8").tobytes(), cols[1].astype("u1").tobytes(),
                         cols[2].astype("<i8").tobytes()])
        z = self.zip.compress(body)
        self.out.write(z + struct.pack("<q", len(z)) + MAGIC)
        self.out.close()
        return len(cols[0]), self.ids, self.pos + len(z) + 16


class PlaneReader:
    """Reads a shard file: the document index, and ids block by block."""

    def __init__(self, uri: str):
        import zstandard
        fs, path = open_fs(uri)
        self.file, self.unzip = fs.open_input_file(path), zstandard.ZstdDecompressor()
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"not a plane file: {uri}")
        n = struct.unpack("<q", tail[:8])[0]
        body = self.unzip.decompress(self.file.read_at(n, size - 16 - n))
        h = struct.unpack("<q", body[:8])[0]
        self.head = json.loads(body[8:8 + h])
        at, d, f = 8 + h, self.head["docs"], self.head["frames"]
        self.sizes = np.frombuffer(body, "<i8", f, at)
        self.doc_ids = np.frombuffer(body, "<i8", d, at + 8 * f)
        self.nulls = np.frombuffer(body, "u1", d, at + 8 * f + 8 * d)
        self.lens = np.frombuffer(body, "<i8", d, at + 8 * f + 9 * d)
        self.per = 4 if self.head["planes"] == "byte" else 32
        self.offsets = len(MAGIC) + np.cumsum(self.sizes) - self.sizes

    def blocks(self) -> Iterator[np.ndarray]:
        left = self.head["ids"]
        for i in range(0, len(self.sizes), self.per):
            n = min(left, self.head["block"])
            raw = self.file.read_at(int(self.sizes[i:i + self.per].sum()), int(self.offsets[i]))
            cut = np.concatenate([[0], np.cumsum(self.sizes[i:i + self.per])])
            yield from_planes([self.unzip.decompress(raw[cut[k]:cut[k + 1]]) for k in range(self.per)], n)
            left -= n

    def documents(self) -> Iterator[tuple[int, int, int]]:
        """``(index, number of ids, crc32 of the ids)`` of each document; a
        document may span blocks, of which one is held at a time."""
        blocks, buf, pos = self.blocks(), np.empty(0, "<u4"), 0
        for i, n in enumerate(self.lens):
            crc, need = 0, int(n)
            while need:
                if pos == len(buf):
                    buf, pos = next(blocks), 0
                take = min(need, len(buf) - pos)
                crc = zlib.crc32(buf[pos:pos + take], crc)
                pos += take
                need -= take
            yield i, int(n), crc


# ------------------------------------------------------------------ Spark jobs

def write_token_planes(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, block_ids: int = 1 << 16,
                       planes: str = "byte", level: int = 3) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write shard files in ascending
    ``doc_id`` order (null ids first, equal ids by a hash of the text) under ``folder``.

    One range-partitioning shuffle of the texts orders them; each partition
    becomes one shard.  Null texts count as empty; every document gets
    ``end_id`` appended.  Returns the manifest, read back from
    ``folder/manifest``; other files in the folder are left by lost attempts.
    Extra columns are ignored.  An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
                   .repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc, out, uri = None, None, ""
        for b in batches:
            for i in range(0, b.num_rows, SLICE_DOCS):
                part = b.slice(i, SLICE_DOCS)
                if out is None:
                    enc, uri = encoder(tokenizer), f"{folder}/shards/{uuid.uuid4().hex}.planes"
                    out = PlaneWriter(uri, block_ids, planes, level)
                ids, lens = enc.encode(part.column(1))
                ends = np.cumsum(lens)
                ids = np.insert(ids, ends, end_id)
                doc = part.column(0)
                out.add(pc.fill_null(doc, 0).to_numpy(zero_copy_only=False),
                        doc.is_null().to_numpy(zero_copy_only=False).astype("u1"), ids, lens + 1)
        if out is not None:
            n, total, size = out.close()
            yield pa.RecordBatch.from_pylist([{"shard": TaskContext.get().partitionId(), "file": uri, "docs": n,
                                               "ids": total, "bytes": size}],
                                             schema=pa.schema([("shard", pa.int32()), ("file", pa.string()),
                                                               ("docs", pa.int64()), ("ids", pa.int64()),
                                                               ("bytes", pa.int64())]))

    ordered.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_planes(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, read back from the shard files: ``doc_id, start`` (ids
    of all documents before it), ``n_tokens`` (with the end id),
    ``ids_crc32``, ``shard``.  One task reads a shard block by block."""
    man = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # one row per shard file: the running total needs no more than the manifest
    man = man.withColumn("base", F.coalesce(F.sum("ids").over(
        Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    files = max(1, man.count())

    def read(batches):
        import pandas as pd
        for pdf in batches:
            for shard, uri, base in zip(pdf["shard"], pdf["file"], pdf["base"]):
                r, rows = PlaneReader(uri), []
                start = int(base)
                for i, n, crc in r.documents():
                    rows.append((i, start, n, crc))
                    start += n
                    if len(rows) == 20_000 or i == len(r.lens) - 1:
                        idx = np.array([x[0] for x in rows])
                        ids = pd.array(r.doc_ids[idx], "Int64")
                        ids[r.nulls[idx] == 1] = pd.NA
                        yield pd.DataFrame({"doc_id": ids, "start": [x[1] for x in rows],
                                            "n_tokens": [x[2] for x in rows], "ids_crc32": [x[3] for x in rows],
                                            "shard": shard})
                        rows = []

    return (man.select("shard", "file", "base").repartitionByRange(files, "shard")
               .mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"))
