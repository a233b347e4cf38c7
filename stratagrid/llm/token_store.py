"""Token ids in seekable zstandard files.

A shard is a series of independent zstandard frames, one for each document in ascending doc_id order, each the
document's ids as little-endian unsigned integers of `width` bytes. Behind them come two skippable frames, so that any
zstandard reader can decompress the whole file:

- magic 184D2A50: the width (8 bytes), then the documents' ids (int64) and a byte for each that is 1 if it is null;
- magic 184D2A5E, the seek table of the zstandard seekable format: for each frame the compressed size, the size and
  the low half of the xxh64 of its content (32 bits each), then the number of frames, a descriptor (80: with
  checksums) and the magic number 8F92EAB1.

A reader fetches the tail, and then only the frames of the documents that it wants; a checksum that differs raises.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding, shared, text as tx

INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
#: Bytes of text in a shard, about: at most, and at least where there are tasks to spare.
MOST, LEAST = 256 << 20, 8 << 20
MANIFEST = "shard int, path string, documents bigint, tokens bigint, bytes bigint"


class Corrupt(ValueError):
    """A frame or table that differs from its checksum or format."""


class Writer:
    def __init__(self, stream, width: int, level: int = 3):
        self.stream, self.width, self.at, self.tokens = stream, width, 0, 0
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype(f"<u{self.width}").tobytes()
        packed = self.packer.compress(raw)
        self.stream.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(doc_id)
        self.at += len(packed)
        self.tokens += len(ids)

    def finish(self) -> int:
        n = len(self.ids)
        index = struct.pack("<Q", self.width) + np.array([x or 0 for x in self.ids], "<i8").tobytes() + bytes(x is None for x in self.ids)
        table = np.array(self.frames, ENTRY).tobytes() + struct.pack("<IBI", n, 0x80, FOOTER_MAGIC)
        for magic, body in ((INDEX_MAGIC, index), (SEEK_MAGIC, table)):
            self.stream.write(struct.pack("<II", magic, len(body)) + body)
            self.at += 8 + len(body)
        return self.at


class Reader:
    """Random access to a shard: ids(i) decompresses the i-th document alone."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != FOOTER_MAGIC or not flags & 0x80:
            raise Corrupt("not a seekable shard with checksums")
        length = n * ENTRY.itemsize + 9
        head, table = self._frame(size - length - 8, length, SEEK_MAGIC)
        self.table = np.frombuffer(table, ENTRY, n)
        self.begin = np.append(0, np.cumsum(self.table["packed"].astype(np.int64)))
        _, index = self._frame(int(self.begin[-1]), head - int(self.begin[-1]) - 8, INDEX_MAGIC)
        self.width = struct.unpack("<Q", index[:8])[0]
        null = index[8 + 8 * n :]
        self.doc_ids = [None if z else int(x) for x, z in zip(np.frombuffer(index, "<i8", n, 8), null, strict=True)]
        self.counts = self.table["size"].astype(np.int64) // self.width
        self.unpacker = zstandard.ZstdDecompressor()

    def _frame(self, at: int, length: int, magic: int) -> tuple[int, bytes]:
        got = self.source.read_at(length + 8, at)
        if len(got) != length + 8 or struct.unpack("<II", got[:8]) != (magic, length):
            raise Corrupt("a skippable frame is not where the tail says")
        return at, got[8:]

    def ids(self, i: int) -> np.ndarray:
        e = self.table[i]
        raw = self.unpacker.decompress(self.source.read_at(int(e["packed"]), int(self.begin[i])), max_output_size=int(e["size"]))
        if len(raw) != e["size"] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != e["check"]:
            raise Corrupt(f"document {i} differs from its checksum")
        return np.frombuffer(raw, f"<u{self.width}")

    def find(self, doc_id: int | None) -> list[int]:
        return [i for i, x in enumerate(self.doc_ids) if x == doc_id]


def open_shard(path: str) -> Reader:
    store, name = pafs.FileSystem.from_uri(path)
    return Reader(store.open_input_file(name))


def _write(folder: str, tokenizer: str, end_id: int, width: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoding.encoder(tokenizer), TaskContext.get()
        store, base = pafs.FileSystem.from_uri(folder)
        # a name of this attempt's own: a lost or repeated attempt leaves a file that no manifest names
        name = f"shard-{task.partitionId():06d}-{uuid.uuid4().hex}.zst"
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{name}", compression=None) as stream:
            out = Writer(stream, width, level)
            for b in batches:
                for i, j, buf, off in tx.slices(b.column("text")):
                    got, counts = enc.encode(buf, off)
                    at = np.append(0, np.cumsum(counts))
                    for k, doc in enumerate(b.column("doc_id").slice(i, j - i).to_pylist()):
                        out.add(doc, np.append(got[at[k] : at[k + 1]], np.uint32(end_id)))
            size = out.finish()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "path": [f"{folder}/{name}"], "documents": pa.array([len(out.ids)], pa.int64()), "tokens": pa.array([out.tokens], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return tx.trimmed(run)


def write(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 1, width: int = 4, level: int = 3) -> list:
    """Encode docs into shards under folder, ascending by doc_id from shard to shard; returns the manifest's rows.

    Null ids come first, equal ids by their texts' hashes, so that they can be in several shards. A null or empty text has
    end_id alone. The manifest has a row for each shard; a shard has about MOST bytes of text at most, less where there
    are more tasks than that makes.
    """
    spark = docs.sparkSession
    shared.prepare(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total, tasks = shared.text_bytes(docs, text), int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(shared.parts(total, MOST, least=1), min(tasks, shared.parts(total, LEAST, least=1)))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return sorted(ranged.mapInArrow(_write(folder, tokenizer or encoding.default_tokenizer(), end_id, width, level), MANIFEST).collect())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
            shard = open_shard(path)
            starts = start + np.append(0, np.cumsum(shard.counts))
            for i in range(0, len(shard.doc_ids), 2000):
                part = range(i, min(i + 2000, len(shard.doc_ids)))
                crc = [zlib.crc32(shard.ids(k).astype("<u4")) for k in part]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([shard.doc_ids[k] for k in part], pa.int64()), "start": pa.array(starts[i : part.stop]), "n_tokens": pa.array(shard.counts[i : part.stop]), "ids_crc32": pa.array(crc, pa.int64())})


def digests(spark: SparkSession, manifest: list) -> DataFrame:
    """A row for each document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    start, rows = 0, []
    for m in manifest:
        rows.append((m.path, start))
        start += m.tokens
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    shards = spark.createDataFrame(rows, "path string, start bigint")
    return shards.repartition(max(1, len(rows))).mapInArrow(_read, schema)
